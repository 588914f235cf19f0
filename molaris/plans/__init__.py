"""Rule sets: which ages, checks, tables, metrics and findings a report has."""
