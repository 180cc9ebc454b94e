"""Scalar functions whose meaning differs from the built-in ones of the same name. All are built-in expressions underneath."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pattern letters of to_char and what they are here.
CHAR_PATTERNS = {"YYYY": "yyyy", "MM": "MM", "DD": "dd", "HH24": "HH", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS"}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def concat(*items: Column | str) -> Column:
    """Nulls are skipped."""
    return F.concat(*[F.coalesce(col(x).cast("string"), F.lit("")) for x in items])


def substring(text: Column | str, start: int, length: int | None = None) -> Column:
    """1-based; a start below 1 uses up length."""
    text = col(text)
    if length is None:
        return F.substr(text, F.lit(max(start, 1)))
    if length < 0:
        raise ValueError("negative substring length not allowed")
    first = max(start, 1)
    return F.substr(text, F.lit(first), F.lit(max(start + length - first, 0)))


def trim(text: Column | str, chars: str | None = None, side: str = "both") -> Column:
    """All white space of Unicode, or the given characters."""
    text = col(text)
    if chars is not None:
        return {"both": F.btrim, "left": F.ltrim, "right": F.rtrim}[side](text, F.lit(chars))
    space = r"[\s\p{Z}\x{85}]+"
    out = F.regexp_replace(text, f"^{space}", "") if side in ("both", "left") else text
    return F.regexp_replace(out, f"{space}$", "") if side in ("both", "right") else out


def regexp_replace_first(text: Column | str, pattern: str, replacement: str) -> Column:
    """Only the first match; `replacement` is plain text."""
    text = col(text)
    at = F.regexp_instr(text, F.lit(f"({pattern})"))
    found = F.regexp_substr(text, F.lit(f"({pattern})"))
    swapped = F.concat(F.substr(text, F.lit(1), at - 1), F.lit(replacement), F.substr(text, at + F.char_length(found)))
    return F.when(at > 0, swapped).otherwise(text)


def split_part(text: Column | str, delimiter: str, n: int) -> Column:
    """Empty before the first and behind the last part."""
    text = col(text)
    return F.split_part(text, F.lit(delimiter), F.lit(n)) if n >= 1 else F.when(text.isNotNull(), F.lit(""))


def strpos(text: Column | str, part: str) -> Column:
    return F.instr(col(text), part)


def int_div(a: Column | str, b: Column | str) -> Column:
    """Integer division towards zero; a zero divisor is an error."""
    a, b = col(a).cast("long"), col(b).cast("long")
    return F.floor(F.abs(a) / F.abs(b)).cast("long") * F.signum(a).cast("long") * F.signum(b).cast("long")


def _micros(ts: Column | str) -> Column:
    """Microseconds from 1970-01-01 on the clock of the value itself, whatever the session's time zone."""
    since = col(ts).cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    minutes = (F.extract(F.lit("DAY"), since).cast("long") * 24 + F.extract(F.lit("HOUR"), since)) * 60 + F.extract(F.lit("MINUTE"), since)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("long")


def date_part(unit: str, ts: Column | str) -> Column:
    """A double; dow counts from Sunday 0, isodow from Monday 1; epoch in seconds."""
    ts = col(ts).cast("timestamp_ntz")
    if unit == "epoch":
        return _micros(ts) / F.lit(1e6)
    if unit == "dow":
        return (F.dayofweek(ts) - 1).cast("double")
    if unit == "isodow":
        return (F.weekday(ts) + 1).cast("double")
    return F.date_part(F.lit(unit), ts).cast("double")


def to_char(ts: Column | str, pattern: str) -> Column:
    for ours, theirs in CHAR_PATTERNS.items():
        pattern = pattern.replace(ours, theirs)
    return F.date_format(col(ts), pattern)


def age(a: Column | str, b: Column | str) -> Column:
    """`D days HH:MM:SS` between two times."""
    seconds = F.floor(_micros(a) / 1_000_000) - F.floor(_micros(b) / 1_000_000)
    rest = F.abs(seconds) % 86400
    days = F.signum(seconds).cast("long") * F.floor(F.abs(seconds) / 86400)
    return F.format_string("%d days %02d:%02d:%02d", days, F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)


def date_bin(ts: Column | str, seconds: int) -> Column:
    """The start of the bin of so many seconds, aligned to 1970-01-01."""
    over = F.pmod(_micros(ts), F.lit(seconds * 1_000_000))
    return col(ts).cast("timestamp_ntz") - F.make_dt_interval(secs=(over.cast("decimal(20,6)") / 1_000_000).cast("decimal(18,6)"))


def is_distinct_from(a: Column | str, b: Column | str) -> Column:
    return ~col(a).eqNullSafe(col(b))
