"""Column helpers: the reference's scalar and validation rules as built-in
Spark expressions (JVM-side, whole-stage codegen; no Python UDF).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schemas import TASK_PRIORITIES, TASK_STATUSES, USER_ROLES

# --- fixed values: validation patterns and thresholds -----------------------
PHONE_PATTERN = r"^(?:\+94|0)?7[0-9]{8}$"   # mobile number, optional +94 / 0 prefix
PHONE_STRIP = r"[\s-]"                       # spaces and dashes removed first
NAME_MAX_DIGIT_SHARE = 0.7                   # a name may be at most 70 % digits
NAME_MIN_LENGTH = 2
PASSWORD_MIN_LENGTH = 6
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"  # plain documented shape check
# ---------------------------------------------------------------------------

# JavaScript's \s covers Unicode spaces; Java's does not unless (?U) is set.
_JS_SPACE = r"(?U)\s"
_JS_TRIM = r"^(?U)\s+|(?U)\s+$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_date(d: _dt.date | str) -> Column:
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d)


def enum_ordinal(c: Column | str, members: list[str]) -> Column:
    """Position of an ENUM value in its declaration (1-based, 0 if unknown).

    MySQL sorts ENUM columns by this index, not alphabetically.
    """
    return F.array_position(F.array(*[F.lit(m) for m in members]), _c(c))


def priority_ordinal(c: Column | str = "priority") -> Column:
    return enum_ordinal(c, TASK_PRIORITIES)


def js_trim(c: Column | str) -> Column:
    """``String.prototype.trim``: strips Unicode white space at both ends."""
    return F.regexp_replace(_c(c), _JS_TRIM, "")


def clean_phone(c: Column | str) -> Column:
    """remove spaces and dashes; a missing phone becomes ''."""
    return F.coalesce(F.regexp_replace(_c(c), r"(?U)[\s-]", ""), F.lit(""))


def phone_valid(c: Column | str) -> Column:
    """mobile number shape after stripping spaces and dashes; empty is false."""
    x = _c(c)
    stripped = F.regexp_replace(x, r"(?U)[\s-]", "")
    return F.when(x.isNull() | (x == ""), F.lit(False)).otherwise(stripped.rlike(PHONE_PATTERN))


def full_name_valid(c: Column | str) -> Column:
    """trimmed name not empty, not all digits, at most 70 % digits among its
    non-space characters, at least two characters long."""
    x = _c(c)
    t = js_trim(x)
    non_space = F.length(F.regexp_replace(t, _JS_SPACE, ""))
    digits = F.length(F.regexp_replace(t, r"[^0-9]", ""))
    too_many_digits = (non_space > 0) & (digits / non_space > F.lit(NAME_MAX_DIGIT_SHARE))
    ok = (
        (t != "")
        & ~t.rlike(r"^[0-9]+$")
        & ~too_many_digits
        & (F.length(t) >= NAME_MIN_LENGTH)
    )
    return F.when(x.isNull(), F.lit(False)).otherwise(ok)


def status_valid(c: Column | str) -> Column:
    """one of the five task statuses (NULL is not valid)."""
    return F.coalesce(_c(c).isin(*TASK_STATUSES), F.lit(False))


def role_valid(c: Column | str) -> Column:
    return F.coalesce(_c(c).isin(*USER_ROLES), F.lit(False))


def normalise_text(c: Column | str) -> Column:
    """F8: HTML-escape ``& < > " ' / \\ ` `` and trim, as the request sanitiser does."""
    x = js_trim(_c(c))
    # --- fixed values: escape table, in the order it is applied --------------
    for raw, esc in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"),
                     ("/", "&#x2F;"), ("\\", "&#x5C;"), ("`", "&#96;")):
        x = F.replace(x, F.lit(raw), F.lit(esc))
    return x


_EPOCH_NTZ = "1970-01-01 00:00:00"


def ntz_micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a wall-clock (timestamp_ntz) value,
    independent of the session time zone: NTZ minus NTZ is an exact interval."""
    iv = _c(c).cast("timestamp_ntz") - F.lit(_EPOCH_NTZ).cast("timestamp_ntz")
    days = F.extract(F.lit("DAY"), iv).cast("bigint")
    hours = F.extract(F.lit("HOUR"), iv).cast("bigint")
    minutes = F.extract(F.lit("MINUTE"), iv).cast("bigint")
    seconds = F.extract(F.lit("SECOND"), iv)
    return ((days * 24 + hours) * 60 + minutes) * 60_000_000 + (seconds * 1_000_000).cast("bigint")


def utc_instant(c: Column | str) -> Column:
    """The instant whose UTC wall clock is the given NTZ value (the data model's
    timestamps are UTC by contract); no session-zone cast, so no DST gaps."""
    return F.timestamp_micros(ntz_micros(c))


def whole_hours(start: Column | str, end: Column | str) -> Column:
    """``TIMESTAMPDIFF(HOUR, start, end)``: elapsed whole hours, truncated toward
    zero (plain arithmetic on wall-clock micros: no zone, no DST)."""
    diff = ntz_micros(end) - ntz_micros(start)
    per_hour = F.lit(3_600_000_000)
    return F.when(diff >= 0, F.floor(diff / per_hour)).otherwise(-F.floor(-diff / per_hour)).cast("bigint")


def abs_whole_hours(start: Column | str, end: Column | str) -> Column:
    """``getTimeDifference``: floor of the absolute difference in hours."""
    micros = F.abs(ntz_micros(end) - ntz_micros(start))
    return F.floor(micros / F.lit(3_600_000_000)).cast("bigint")


def format_date(c: Column | str) -> Column:
    """``formatDate``: ISO date string."""
    return F.date_format(F.to_date(_c(c)), "yyyy-MM-dd")


def format_time(c: Column | str) -> Column:
    """``formatTime``: append seconds to ``HH:mm``."""
    return F.concat(_c(c), F.lit(":00"))


def clock_time(c: Column | str) -> Column:
    """``HH:mm`` of a timestamp_ntz value (read from its wall clock)."""
    return F.substring(_c(c).cast("timestamp_ntz").cast("string"), 12, 5)


def task_code(ts: Column | str) -> Column:
    """D8: 'T' + last six digits of the epoch milliseconds of ``ts`` (UTC)."""
    millis = F.floor(ntz_micros(ts) / F.lit(1000)).cast("bigint")
    return F.concat(F.lit("T"), F.substring(millis.cast("string"), -6, 6))


def count_when(cond: Column) -> Column:
    """``COUNT(CASE WHEN cond THEN 1 END)``: 0 on empty input."""
    return F.count(F.when(cond, F.lit(1)))


def sum_when(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)``: NULL on empty input, like SQL."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")
