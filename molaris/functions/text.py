"""Text cleaning as built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from molaris.functions.sql import quoted, quoted_list

# What counts as blank in an exported record.
# Compared after trimming, case-sensitive.
NULL_TOKENS = ["<NA>", "<null>", "<NULL>", "NULL", "null", "NaN", "nan", "", "-"]
# Compared before trimming: what a text-file reader already takes for missing.
FILE_NULL_TOKENS = [
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "",
]
# Dates outside this window (such as Buddhist-era years) are not valid dates.
FIRST_VALID_TIME = "1677-09-21 00:12:43.145225"
LAST_VALID_TIME = "2262-04-11 23:47:16.854775"

# Every character for which str.isspace() holds; plain trim() removes spaces only.
SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

INFINITIES = [s + w for s in ("", "+", "-") for w in ("inf", "infinity", "Inf", "Infinity", "INF", "INFINITY")]
_ISO_TIME = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"


_DECIMAL_END = quoted_list("0123456789.")


def _ascii_start(c: str) -> str:
    """Starts with a visible ASCII character; a plain comparison of bytes."""
    return f"({c} >= '!' AND {c} < '\u007f')"


def _clean_ends(c: str) -> str:
    spaces = quoted_list(SPACES)
    return (f"({_ascii_start(c)} OR substring({c}, 1, 1) NOT IN {spaces}) "
            f"AND substring({c}, -1, 1) NOT IN {spaces}")


def _trim(c: str) -> str:
    return f"trim(BOTH {quoted(SPACES)} FROM {c})"


def strip(c: str) -> str:
    """Trim Unicode whitespace on both ends.

    Trimming a set of characters costs far more than a look at both ends, which settles
    nearly every value.
    """
    return f"IF({_clean_ends(c)}, {c}, {_trim(c)})"


def blank_to_null(c: str) -> str:
    """Trimmed text, null where the value is one of the blank tokens."""
    blanks = quoted_list(dict.fromkeys(FILE_NULL_TOKENS + NULL_TOKENS))
    trimmed = f"IF({_trim(c)} IN {quoted_list(NULL_TOKENS)}, NULL, {_trim(c)})"
    return f"IF({c} IN {blanks}, NULL, IF({_clean_ends(c)}, {c}, {trimmed}))"


def to_number(c: str) -> str:
    """Stripped text to double, null when it is not a plain number.

    A cast alone would also take Java literals (``5d``, ``0x1p3``), so the text has to
    end like a decimal number and hold no ``x``. No blank token is a number.
    """
    plain = f"substring({c}, -1, 1) IN {_DECIMAL_END} AND NOT contains({c}, 'x') AND NOT contains({c}, 'X')"
    return f"IF(({plain}) OR {c} IN {quoted_list(INFINITIES)}, try_cast({c} AS DOUBLE), NULL)"


def to_time(c: str, layouts: Sequence[str] = ()) -> str:
    """Stripped text to timestamp without zone; null for anything but the known layouts and for
    dates outside the valid window.

    Layouts: ``yyyy-MM-dd``, ``yyyyMMdd``, each with an optional time of day, then the given patterns in their
    order. The choice is made per value, so it does not depend on which row comes first.
    """
    def part(start: int, size: int) -> str:
        return f"substring({c}, {start}, {size})"

    day = f"{part(1, 4)}, '-', {part(5, 2)}, '-', {part(7, 2)}"
    clock = f"' ', {part(9, 2)}, ':', {part(11, 2)}, ':', {part(13, 2)}"
    digits = f"{c} RLIKE '^[0-9]+$'"
    iso = (f"CASE length({c}) WHEN 8 THEN IF({digits}, concat({day}), NULL) "
           f"WHEN 14 THEN IF({digits}, concat({day}, {clock}), NULL) "
           f"ELSE IF({c} RLIKE {quoted(_ISO_TIME)}, {c}, NULL) END")
    known = f"try_cast({iso} AS TIMESTAMP_NTZ)"
    more = [f"CAST(try_to_timestamp({c}, {quoted(layout)}) AS TIMESTAMP_NTZ)" for layout in layouts]
    return f"coalesce({', '.join([known, *more])})" if more else known


def valid_time(t: str) -> str:
    """The time itself inside the supported window, else null."""
    return (f"CASE WHEN {t} BETWEEN TIMESTAMP_NTZ '{FIRST_VALID_TIME}' "
            f"AND TIMESTAMP_NTZ '{LAST_VALID_TIME}' THEN {t} END")


def drop_number_prefix(c: str) -> str:
    """``01-Name`` to ``Name``; digits of any script count."""
    pattern = r"(?U)^\d+-"
    return strip(f"regexp_replace({c}, {quoted(pattern)}, '')")


def file_name(c: str) -> str:
    """Plain file name from the URI-escaped ``_metadata.file_name``."""
    return f"url_decode(replace({c}, '+', '%2B'))"
