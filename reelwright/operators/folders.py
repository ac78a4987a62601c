"""Libraries by a table of folder rules, looked up by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright.functions.util import non_blank
from reelwright.operators.grouping import spread_join

OTHER_LIBRARY = "Other"


def folders_of(path: Column) -> Column:
    """The folders of a path, outermost first: what stands between two slashes."""
    parts = F.split(F.coalesce(path, F.lit("")), "/")
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))


def _runs(folders: Column, longest: Column) -> Column:
    """All runs of up to ``longest`` neighbouring folders, as texts."""
    def from_place(start: Column) -> Column:
        most = F.least(longest, F.size(folders) - start + 1)
        return F.transform(F.sequence(F.lit(1), most), lambda n: F.array_join(F.slice(folders, start, n), "/"))

    places = F.when(F.size(folders) > 0, F.sequence(F.lit(1), F.size(folders))).otherwise(F.array().cast("array<int>"))
    return F.when(longest > 0, F.array_distinct(F.flatten(F.transform(places, from_place))))


def folder_libraries(folders: DataFrame, rules: DataFrame) -> DataFrame:
    """(folder, library) of the folders that a rule fits.

    A rule (priority, folders, library) names one folder or several neighbouring ones, as in ``/Movies/4K/``, and fits
    a path that has them in a row. The rule with the least priority wins, then the least library name. Each folder
    emits its runs of neighbours, as long as the longest rule, and meets the rules by equality: the work follows
    the folders, not folders times rules. Rules without a folder, a priority or a library fit nothing.
    """
    trimmed = rules.select("priority", F.trim("folders", F.lit("/")).alias("run"), "library")
    whole = trimmed.where(non_blank(F.col("run")) & F.col("priority").isNotNull() & F.col("library").isNotNull())
    first = whole.groupBy("run").agg(F.min(F.struct("priority", "library")).alias("rule"))
    longest = F.coalesce(whole.agg(F.max(F.size(F.split("run", "/")))).scalar(), F.lit(0))
    runs = folders.select("folder").distinct().withColumn("longest", longest).select(
        "folder", F.explode(_runs(folders_of(F.concat("folder", F.lit("/"))), F.col("longest"))).alias("run"))
    met = spread_join(runs, first, "run")
    return met.groupBy("folder").agg(F.min("rule").alias("rule")).select("folder", F.col("rule.library").alias("library"))


def with_library(items: DataFrame, rules: DataFrame, path: str = "path", name: str = "guessed_library",
                 other: str = OTHER_LIBRARY) -> DataFrame:
    """Every item with the library of its folder as ``name``; ``other`` where no rule fits or the path is null."""
    folder = F.regexp_extract(F.coalesce(path, F.lit("")), r"(?s)^(.*)/", 1)
    keyed = items.withColumn("_folder", folder)
    found = folder_libraries(keyed.select(F.col("_folder").alias("folder")), rules)
    joined = spread_join(keyed, found.select(F.col("folder").alias("_folder"), F.col("library").alias("_library")), "_folder", "left")
    return joined.withColumn(name, F.coalesce("_library", F.lit(other))).drop("_folder", "_library")
