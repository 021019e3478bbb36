"""Cleaning and coercion of source strings, as column expressions. Bad input gives null, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ORDINAL_TOKENS, VOLATILE_KEYS


def norm_name(x: Column) -> Column:
    """White space runs to one blank, trimmed, upper case; '' is null."""
    return F.nullif(F.upper(F.trim(F.regexp_replace(x, "\\s+", " "))), F.lit(""))


def to_text(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def to_float(x: Column) -> Column:
    """A finite number or null."""
    v = F.trim(x).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def to_int(x: Column) -> Column:
    """Toward zero: '1.9' is 1."""
    v = to_float(x)
    return F.when(F.abs(v) < 9.2e18, v.cast("bigint"))


def to_bool(x: Column) -> Column:
    return F.when(x.isNull() | (x == ""), None).otherwise(x.isin("1", "True", "true"))


def to_iso_date(x: Column) -> Column:
    """The date of an ISO date or date-time; any other layout is null."""
    head = F.substring(F.trim(x), 1, 10)
    return F.when(head.rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def txn_key_bulk(x: Column) -> Column:
    """group-procedure-year-sequence to procedure-year-sequence."""
    p = F.split(F.trim(x), "-")
    whole = (F.size(p) == 4) & (F.get(p, F.lit(1)) != "") & (F.get(p, F.lit(2)) != "") & (F.get(p, F.lit(3)) != "")
    return F.when(whole, F.concat_ws("-", F.get(p, F.lit(1)), F.get(p, F.lit(2)), F.get(p, F.lit(3))))


def txn_key_gateway(x: Column) -> Column:
    """procedure-sequence-year to procedure-year-sequence."""
    p = F.split(F.trim(x), "-")
    whole = (F.size(p) == 3) & (F.get(p, F.lit(0)) != "") & (F.get(p, F.lit(1)) != "") & (F.get(p, F.lit(2)) != "")
    return F.when(whole, F.concat_ws("-", F.get(p, F.lit(0)), F.get(p, F.lit(2)), F.get(p, F.lit(1))))


def per_m2(amount: Column, area: Column) -> Column:
    """amount / area in decimals, half up to two places; null unless the area is positive."""
    return F.when(area > 0, F.round(amount.cast("decimal(14,2)") / F.nullif(area.cast("decimal(12,2)"), F.lit(0)), 2))


def per_property(total: Column, count: Column) -> Column:
    return total / F.when(count > 0, count).otherwise(F.lit(1))


def joined_ref(parts: Sequence[Column], sep: str = "|") -> Column:
    """All parts as text, null as ''."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def is_offplan_bulk(reg_type: Column) -> Column:
    return F.coalesce(reg_type == "Off-Plan Properties", F.lit(False))


def freehold(kind: str, flag: Column | None = None) -> Column:
    """What each source says of freehold: bulk sales nothing, bulk rents '1', gateway sales false if missing, gateway rents null if missing."""
    if kind == "bulk_sale":
        return F.lit(None).cast("boolean")
    if kind == "bulk_rent":
        return F.coalesce(flag == "1", F.lit(False))
    if kind == "gateway_sale":
        return F.coalesce(to_bool(flag), F.lit(False))
    return to_bool(flag)


def record_hash(endpoint: Column, payload: Column) -> Column:
    """sha256 of the endpoint and the payload's lasting fields in key order: equal content, equal hash."""
    fields = F.map_filter(F.from_json(payload, "map<string,string>"), lambda k, _: ~k.isin(list(VOLATILE_KEYS)))
    ordered = F.map_from_entries(F.array_sort(F.map_entries(fields)))
    return F.sha2(F.concat(endpoint, F.lit("|"), F.to_json(ordered)), 256)


def parent_names(name: Column, tokens: Sequence[str] = ORDINAL_TOKENS) -> Column:
    """Shorter names left by stripping trailing ordinal and direction words, most specific first."""
    words = F.split(name, " ")
    n = F.size(words)
    drops = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    usable = F.filter(drops, lambda k: F.forall(F.slice(words, n - k + 1, k), lambda w: F.upper(w).isin(list(tokens))))
    return F.transform(usable, lambda k: F.array_join(F.slice(words, 1, n - k), " "))


def pct_change(value: Column, before: Column) -> Column:
    return (value / F.nullif(before, F.lit(0)) - 1) * 100


def cagr_pct(start: Column, end: Column, years: Column) -> Column:
    return F.when((start > 0) & (end > 0) & (years > 0), (F.pow(end / start, F.lit(1.0) / years) - 1) * 100)


def half_up(x: Column, places: int = 2) -> Column:
    """Rounded half up by way of a decimal, as a double, so that engines agree on ties."""
    return F.round(x.cast("decimal(20,6)"), places).cast("double")
