"""DataFrame transformations, from raw records to reports, findings and lists."""
