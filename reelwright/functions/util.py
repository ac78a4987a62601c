"""Small helpers shared by the column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(col: Column) -> Column:
    """True for null and for the empty string."""
    return F.coalesce(col == "", F.lit(True))


def non_blank(col: Column) -> Column:
    return ~blank(col)


def first_non_blank(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def first_filled(*cols: Column) -> Column:
    """``first_non_blank`` that names each input once, for inputs that are costly to compute."""
    filled = F.filter(F.array(*cols), lambda c: c.isNotNull() & (c != ""))
    return F.try_element_at(filled, F.lit(1))


def literal_map(entries: Mapping[str, object]) -> Column:
    """A constant map column; Catalyst folds it once per plan."""
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    """True when ``text`` holds one of ``needles``; null counts as no match."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | text.contains(needle)
    return F.coalesce(hit, F.lit(False))


def fixed(value: Column, digits: int) -> Column:
    """Number with a fixed count of decimals as text, ties to even."""
    exact = F.bround(value.cast("decimal(38,12)"), digits)
    return exact.cast(f"decimal(38,{digits})").cast("string")


def printed(value: Column, digits: int) -> Column:
    """Double with a fixed count of decimals as text, as printf writes it: rounded by its exact binary value."""
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * digits))


def lower_keys(provider_ids: Column) -> Column:
    """Provider map with lower-case keys (needs spark.sql.mapKeyDedupPolicy=LAST_WIN)."""
    return F.transform_keys(provider_ids, lambda k, _: F.lower(k))


def provider_id(provider_ids: Column, provider: str) -> Column:
    """Case-insensitive read of one provider id; the last spelling of the key wins."""
    hits = F.filter(F.map_entries(provider_ids), lambda e: F.lower(e["key"]) == provider)
    return F.try_element_at(hits, F.lit(-1))["value"]
