"""Spark SQL expressions as text: cleaning, dates, gum codes, exact rounding, rules.

Expressions are built as SQL text and parsed once by Spark; composing the same trees call
by call from Python takes longer than running most reports.
"""
