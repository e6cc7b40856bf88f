"""Security codes, dates and safe numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_vendor_code(symbol: Column) -> Column:
    """'600519.SH' or '600519' -> 'sh.600519'; without a suffix, 6... is sh, all else sz."""
    s = F.upper(F.trim(symbol))
    code, suffix = F.substring_index(s, ".", 1), F.lower(F.substring(s, F.instr(s, ".") + 1, F.length(s)))
    dotted = F.concat(suffix, F.lit("."), code)
    return F.when(F.instr(s, ".") > 0, dotted).when(s.startswith("6"), F.concat(F.lit("sh."), s)).otherwise(F.concat(F.lit("sz."), s))


def from_vendor_code(code: Column) -> Column:
    """'sh.600519' -> '600519.SH'; anything without exactly one dot stays."""
    parts = F.split(F.trim(code), "\\.", -1)
    return F.when(F.size(parts) == 2, F.concat(F.get(parts, 1), F.lit("."), F.upper(F.get(parts, 0)))).otherwise(code)


def with_exchange_suffix(code: Column) -> Column:
    """Bare code -> code with its exchange: 6 SH, 0 and 3 SZ, 4 and 8 BJ, else SZ."""
    c = F.trim(code)
    first = F.substring(c, 1, 1)
    suffix = F.when(first == "6", ".SH").when(first.isin("0", "3"), ".SZ").when(first.isin("4", "8"), ".BJ").otherwise(".SZ")
    return F.concat(c, suffix)


def bare_code(symbol: Column) -> Column:
    """'600519.SH' or 'SH600519' -> '600519'."""
    s = F.upper(F.trim(symbol))
    cut = F.regexp_replace(s, "\\.(SH|SZ|BJ)$", "")
    prefixed = (cut == s) & (F.length(s) == 8) & F.substring(s, 1, 2).isin("SH", "SZ", "BJ")
    return F.when(prefixed, F.substring(s, 3, 6)).otherwise(cut)


def compact_date(d: Column) -> Column:
    """'2024-01-05' or '2024/01/05' -> '20240105'; raises for what isn't eight digits."""
    s = F.regexp_replace(d.cast("string"), "[-/]", "")
    return F.when(s.isNull() | s.rlike("^[0-9]{8}$"), s).otherwise(F.raise_error(F.concat(F.lit("not a YYYYMMDD date: "), s)))


def as_date(d: Column) -> Column:
    return F.to_date(compact_date(d), "yyyyMMdd")


def dashed_date(d: Column) -> Column:
    return F.date_format(as_date(d), "yyyy-MM-dd")


def soft_date(d: Column) -> Column:
    """Date, or null for blank or unreadable text."""
    s = F.nullif(F.trim(d.cast("string")), F.lit(""))
    return F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd")), F.try_to_timestamp(s, F.lit("yyyyMMdd")), F.try_to_timestamp(s, F.lit("yyyy/MM/dd"))).cast("date")


def safe_double(c: Column) -> Column:
    """Double, or null for what isn't a finite number or is blank."""
    v = F.trim(c.cast("string")).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)
