"""Rules are Spark SQL expressions; these wrappers settle what null means.

In a rule, arithmetic and ordered comparisons follow SQL (null in, null out) and the
final null counts as *not met*. Text tests must not let null escape into a negation:
write ``x <=> 'v'`` for equal, ``NOT (x <=> 'v')`` for not equal, and
``coalesce(x IN (...), false)`` before negating a membership test.
"""

from __future__ import annotations

Rule = str | bool | None


def met(rule: Rule) -> str:
    """Boolean expression that is never null. No rule means every row meets it."""
    if rule is None:
        return "true"
    if isinstance(rule, bool):
        return str(rule).lower()
    return f"coalesce(CAST(({rule}) AS BOOLEAN), false)"


def amount(rule: Rule) -> str:
    """Numeric value of a rule, null where it is not a number."""
    if rule is None or isinstance(rule, bool):
        return "0D" if rule is False else "1D"
    return f"try_cast(({rule}) AS DOUBLE)"
