"""Byte sizes, rates, durations and percentages, as Python functions and as Columns."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
BINARY = ("k", "m", "g", "t")
NAMES = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")
_SIZE = re.compile(r"(.*?)([kmgt]i?b|[kmgt]|b)?\Z", re.DOTALL)
#: What a number may look like in a Column.
_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?"


def _factor(suffix: str) -> int:
    if suffix in ("", "b"):
        return 1
    power = BINARY.index(suffix[0]) + 1
    return 1000**power if len(suffix) == 2 else 1024**power


def parse_size(text: str) -> int:
    """Bytes of "10", "3k", "7kib" or "0.5TB": letters alone and IEC suffixes are binary, SI ones decimal."""
    number, suffix = _SIZE.match(text.strip().lower()).groups()
    try:
        if "_" in number:
            raise ValueError(number)
        value = float(number) * _factor(suffix or "")
    except ValueError:
        raise ValueError(f"not a size: {text!r}") from None
    if not 0 <= value < 2**63 or math.isnan(value):
        raise ValueError(f"not a size: {text!r}")
    return int(value)


def parse_size_column(text: Column) -> Column:
    """parse_size over a column; null where the text is no size."""
    t = F.lower(F.trim(text))
    suffix = F.regexp_extract(t, r"([kmgt]i?b|[kmgt]|b)?\z", 1)
    number = F.trim(F.substring(t, F.lit(1), F.length(t) - F.length(suffix)))
    factor = F.lit(1.0)
    for k, s in enumerate(BINARY, 1):
        factor = F.when(suffix.isin(s, s + "ib"), float(1024**k)).when(suffix == s + "b", float(1000**k)).otherwise(factor)
    value = F.when(number.rlike(rf"\A{_NUMBER}\z"), number.try_cast("double")) * factor
    return F.when((value >= 0) & (value < float(2**63)), value.cast("long"))


def format_bytes(n: int) -> str:
    if n < 0:
        return "-" + format_bytes(-n)
    value, k = float(n), 0
    while value >= 1024 and k < len(NAMES) - 1:
        value, k = value / 1024, k + 1
    return f"{n} B" if k == 0 else f"{value:.0f} {NAMES[k]}" if value >= 100 else f"{value:.1f} {NAMES[k]}"


def _half_even(value: Column, digits: int) -> Column:
    """Text of an exact binary value, ties to even, as printf does it elsewhere (Java's rounds ties up)."""
    return F.bround(value.cast(f"decimal(38,18)"), digits).cast("string")


def format_bytes_column(n: Column) -> Column:
    size = F.abs(n.cast("double"))
    k = F.least(F.lit(len(NAMES) - 1), F.greatest(F.lit(0), *[F.when(size >= float(1024**i), i).otherwise(0) for i in range(1, len(NAMES))]))
    value = size / F.pow(F.lit(1024.0), k)
    unit = F.element_at(F.array(*map(F.lit, NAMES)), k + 1)
    said = F.when(k == 0, F.abs(n).cast("string")).when(value >= 100, _half_even(value, 0)).otherwise(_half_even(value, 1))
    return F.concat(F.when(n < 0, "-").otherwise(""), said, F.lit(" "), unit)


def format_rate(per_second: float) -> str:
    return format_bytes(int(per_second)) + "/s" if per_second > 0 and math.isfinite(per_second) else "0 B/s"


def format_duration(seconds: float) -> str:
    s = max(0, int(seconds))
    return f"{s}s" if s < 60 else f"{s // 60}m{s % 60:02d}s" if s < 3600 else f"{s // 3600}h{s // 60 % 60:02d}m"


def format_percent(part: int, total: int) -> str:
    return f"{100 * part / total:.0f}%" if total > 0 else "100%"


def format_percent_column(part: Column, total: Column) -> Column:
    return F.when(total <= 0, "100%").otherwise(F.concat(_half_even(100 * part.cast("double") / total, 0), F.lit("%")))


def truncate_left(text: str, width: int) -> str:
    return text if len(text) <= width else text[-width:] if width <= 3 else "..." + text[3 - width :]


def truncate_left_column(text: Column, width: int) -> Column:
    tail = F.right(text, F.lit(max(width - 3, 0)))
    return F.when(F.length(text) <= width, text).otherwise(F.right(text, F.lit(width)) if width <= 3 else F.concat(F.lit("..."), tail))
