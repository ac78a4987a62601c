"""Text shown in reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelwright.functions.util import fixed


def format_size(size: Column, zero_label: str = "0 B") -> Column:
    """Size in the largest binary unit up to PB, two decimals."""
    value = size.cast("double")
    expr = F.when(F.coalesce(size, F.lit(0)) == 0, F.lit(zero_label))
    units = ("B", "KB", "MB", "GB", "TB", "PB")
    for power, unit in enumerate(units):
        text = F.concat(fixed(value / F.lit(float(1024**power)), 2), F.lit(f" {unit}"))
        last = power == len(units) - 1
        expr = expr.otherwise(text) if last else expr.when(value < float(1024 ** (power + 1)), text)
    return expr


def format_rating(community: Column, critic: Column) -> Column:
    own, press = fixed(community, 1), fixed(critic / 10.0, 1)
    return (
        F.when(community.isNotNull() & critic.isNotNull(), F.concat(own, F.lit("/"), press))
        .when(community.isNotNull(), own)
        .when(critic.isNotNull(), F.concat(F.lit("RT:"), press))
        .otherwise(F.lit("none"))
    )


def format_days_left(days: Column) -> Column:
    return (
        F.when(days.isNull(), F.lit("never"))
        .when(days == 0, F.lit("now"))
        .when(days < 30, F.concat(days.cast("string"), F.lit("d")))
        .when(days < 365, F.concat(F.floor(days / 30).cast("string"), F.lit("mo")))
        .otherwise(F.concat(fixed(days / 365.25, 1), F.lit("yr")))
    )


def truncate(text: Column, limit: int) -> Column:
    """Text cut so that it fits ``limit`` characters with its ellipsis."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))
    ).otherwise(text)


def preview(text: Column, limit: int = 240) -> Column:
    """Trimmed text; an ellipsis follows the first ``limit`` characters of a longer one."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    return F.when(
        F.length(clean) > limit, F.concat(F.substring(clean, 1, limit), F.lit("…"))
    ).otherwise(clean)


def format_title(name: Column, series_name: Column) -> Column:
    title = F.coalesce(name, F.lit("Unknown"))
    return F.when(
        F.coalesce(series_name, F.lit("")) != "", F.concat(series_name, F.lit(" - "), title)
    ).otherwise(title)


def display_name_year(name: Column, year: Column) -> Column:
    """Name with the year after it, unless it is there already or unknown."""
    digits = year.cast("string")
    return F.when(
        (F.coalesce(year, F.lit(0)) == 0) | name.contains(digits), name
    ).otherwise(F.concat(name, F.lit(" ("), digits, F.lit(")")))
