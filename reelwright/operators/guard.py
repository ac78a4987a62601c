"""Whether removing a file could take a kept file's folder with it; from paths alone.

A media server that removes an item may remove the item's whole folder. A folder named after
the file is always lost; any other folder stays only when another file directly in it stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright import constants as K
from reelwright.functions import paths as P
from reelwright.functions.util import non_blank
from reelwright.operators.grouping import attach_group_values, spread_join, with_hash
from reelwright.session import written


def known_paths(decisions: DataFrame, library_paths: DataFrame | None = None) -> DataFrame:
    """Distinct paths of all kept and removed items, and of the library when given."""
    paths = decisions.select("path")
    if library_paths is not None:
        paths = paths.unionByName(library_paths.select("path"))
    return paths.where(non_blank(F.col("path"))).distinct()


def delete_paths(decisions: DataFrame) -> DataFrame:
    """Distinct paths that the run removes."""
    return decisions.where("role = 'delete'").select("path").where(non_blank(F.col("path"))).distinct()


def surviving_paths(known: DataFrame, deletes: DataFrame) -> DataFrame:
    """(npath, dir) of the known paths that stay after the run; a path known in several spellings is one."""

    def different(rows: DataFrame) -> DataFrame:
        return with_hash(rows.select(P.path_norm(F.col("path")).alias("npath")), ["npath"]).distinct()

    # One shuffle a side: the join goes by the hash and the path too.
    staying = different(known).join(different(deletes), ["_hash", "npath"], "left_anti")
    return staying.select("npath", P.parent_dir(F.col("npath")).alias("dir"))


def delete_safe(pairs: DataFrame, known: DataFrame, deletes: DataFrame) -> DataFrame:
    """Adds ``safe`` and ``reason`` to rows with keeper_path and delete_path.

    The neighbours that stay are counted once per folder and joined on the folder, so the work
    is linear in paths whatever the size of a folder.
    """
    survivors = written(surviving_paths(known, deletes), "survivors")
    per_dir = survivors.groupBy("dir").agg(F.count("*").alias("n_direct"))
    staying = survivors.select(F.col("npath").alias("kp"), F.lit(True).alias("keeper_stays"))
    rows = (
        pairs.withColumn("dp", P.path_norm(F.col("delete_path")))
        .withColumn("kp", P.path_norm(F.col("keeper_path")))
        .withColumn("dir", P.parent_dir(F.col("dp")))
    )
    rows = spread_join(spread_join(rows, per_dir, "dir", "left"), staying, "kp", "left")
    own = F.when(
        F.coalesce("keeper_stays", F.lit(False)) & (P.parent_dir(F.col("kp")) == F.col("dir"))
        & (F.col("kp") != F.col("dp")), F.lit(1),
    ).otherwise(F.lit(0))
    folder = P.path_norm(F.col("dir"))
    inside = (folder != "") & (
        (F.col("kp") == folder) | F.col("kp").startswith(F.concat(folder, F.lit("/")))
    )
    rows = rows.withColumn("others", F.coalesce("n_direct", F.lit(0)) - own).withColumn(
        "verdict",
        F.when(F.col("dp") == "", F.lit("no delete path"))
        .when(F.col("kp") == "", F.lit("no keeper path"))
        .when(~inside, F.lit("other folder"))
        .when(P.is_per_title(F.col("dp")), F.lit("title folder"))
        .when(F.col("others") > 0, F.lit("shared folder"))
        .otherwise(F.lit("dedicated folder")),
    )
    reason = (
        F.when(F.col("verdict") == "title folder",
               F.concat(F.lit("keeper lies in the folder named after this title: "), F.col("dir")))
        .when(F.col("verdict") == "dedicated folder",
              F.concat(F.lit("keeper would be left alone in the folder: "), F.col("dir")))
        .when(F.col("verdict") == "shared folder",
              F.concat(F.lit("shared folder, surviving items: "), F.col("others").cast("string")))
        .otherwise(F.col("verdict"))
    )
    return rows.withColumn("safe", ~F.col("verdict").isin("title folder", "dedicated folder")).withColumn(
        "reason", reason
    ).drop("dp", "kp", "dir", "n_direct", "keeper_stays", "others")


def cleanup_delete_safe(targets: DataFrame, known: DataFrame, deletes: DataFrame) -> DataFrame:
    """Adds ``safe`` and ``reason`` to rows with delete_path when no keeper is named.

    Safe when nothing below the folder stays, or when the folder is not the title's own and at
    least two files directly in it stay: then each of them still vouches for the other.
    """
    survivors = surviving_paths(known, deletes)
    direct = survivors.groupBy("dir").agg(F.count("*").alias("n_direct"))
    below = (
        survivors.select(F.explode(P.ancestors(F.col("dir"))).alias("dir"))
        .groupBy("dir").agg(F.count("*").alias("n_below"))
    )
    rows = (
        targets.withColumn("dp", P.path_norm(F.col("delete_path")))
        .withColumn("dir", P.parent_dir(F.col("dp")))
    )
    rows = spread_join(spread_join(rows, below, "dir", "left"), direct, "dir", "left")
    n_below = F.coalesce("n_below", F.lit(0))
    verdict = (
        F.when(F.col("dp") == "", F.lit("no delete path"))
        .when(n_below == 0, F.lit("nothing stays"))
        .when(P.is_per_title(F.col("dp")), F.lit("title folder"))
        .when(F.coalesce("n_direct", F.lit(0)) >= 2, F.lit("shared folder"))
        .otherwise(F.lit("dedicated folder"))
    )
    return (
        rows.withColumn("reason", verdict)
        .withColumn("safe", ~F.col("reason").isin("title folder", "dedicated folder"))
        .drop("dp", "dir", "n_below", "n_direct")
    )


def guard_pass(decisions: DataFrame, known: DataFrame, attempted: bool = False) -> DataFrame:
    """Enriched delete rows with the guard's verdict and their status."""
    deletes = delete_paths(decisions)
    pairs = (
        decisions.where("role = 'delete'")
        .withColumn("keeper_path", F.col("keep_path"))
        .withColumn("delete_path", F.col("path"))
    )
    checked = delete_safe(pairs, known, deletes)
    passed = F.lit("success" if attempted else "not_attempted")
    return checked.withColumn("status", F.when(F.col("safe"), passed).otherwise(F.lit("skipped_unsafe")))


def duration_review(keeper_ticks: Column, delete_ticks: Column) -> Column:
    """Why two runtimes do not prove the same content; null when they do."""
    known = (F.coalesce(keeper_ticks, F.lit(0)) != 0) & (F.coalesce(delete_ticks, F.lit(0)) != 0)
    keeper = keeper_ticks / F.lit(float(K.TICKS_PER_SECOND))
    delete = delete_ticks / F.lit(float(K.TICKS_PER_SECOND))
    allowed = F.greatest(
        F.lit(K.FOLD_DURATION_TOLERANCE) * F.greatest(keeper, delete),
        F.lit(K.FOLD_DURATION_FLOOR_SECONDS),
    )
    return (
        F.when(~known, F.lit("duration unknown"))
        .when(F.abs(keeper - delete) > allowed, F.concat(
            F.lit("duration mismatch (keeper "), F.bround(keeper, 0).cast("bigint").cast("string"),
            F.lit("s, delete "), F.bround(delete, 0).cast("bigint").cast("string"), F.lit("s)")))
    )


def fold_safe_plan(guarded: DataFrame) -> DataFrame:
    """Refused rows that a file-level removal could serve, each ok or needs_review.

    The group size is an aggregate joined back, so a mis-grouped set of any size is handled.
    """
    planned = guarded.where(
        ~F.col("safe") & non_blank(F.col("keeper_path")) & non_blank(F.col("delete_path"))
        & (F.col("keeper_path") != F.col("delete_path"))
    )
    sized = attach_group_values(planned, ["group_id"], n_planned=F.count("*"))
    duration = duration_review(F.col("keep_runtime_ticks"), F.col("runtime_ticks"))
    oversized = F.when(
        F.col("n_planned") > K.FOLD_MAX_GROUP_DELETES,
        F.concat(F.lit("group too large ("), F.col("n_planned").cast("string"), F.lit(" planned deletes)")),
    )
    review = F.concat_ws("; ", duration, oversized)
    return sized.select(
        "group_id", "item_id", "keeper_path", "delete_path", "reason",
        F.when(review == "", F.lit("ok")).otherwise(F.lit("needs_review")).alias("status"),
        review.alias("review_reason"),
    )


def owned_folder(files: DataFrame) -> DataFrame:
    """Adds ``owned``: the folder is the file's own, by name or because nothing else is in it.

    The file's converted sibling and extras do not count as something else.
    """
    rows = (
        files.withColumn("dir", P.parent_dir(F.col("path")))
        .withColumn("_name", P.basename(F.col("path")))
        .withColumn("_stem", P.stem(F.col("_name")))
    )
    primary = P.is_video(F.col("_name")) & ~P.is_extra(F.col("_name"))
    per_dir = rows.groupBy("dir").agg(F.count_if(primary).alias("n_primary"))
    siblings = rows.where(primary).select(
        "dir", F.col("_name").alias("_sibling"), F.lit(1).alias("has_sibling")
    ).distinct()
    named = rows.withColumn("_primary", primary.cast("int")).withColumn(
        "_sibling", F.concat("_stem", F.lit(f"{K.CONVERTED_SUFFIX}.mkv")))
    joined = spread_join(named, per_dir, "dir").join(siblings, ["dir", "_sibling"], "left")
    others = F.col("n_primary") - F.col("_primary") - F.coalesce("has_sibling", F.lit(0))
    owned = P.is_per_title(F.col("path")) | (others == 0)
    return joined.withColumn("owned", owned).drop(
        "dir", "_name", "_stem", "_sibling", "_primary", "n_primary", "has_sibling"
    )


def safe_output_path(owned_files: DataFrame) -> DataFrame:
    """Adds ``output_path``: where a converted copy survives the removal of its original."""
    path = F.col("path")
    folder = P.parent_dir(path)
    name = P.path_stem(path)
    target = F.concat(name, F.lit(f"{K.CONVERTED_SUFFIX}.mkv"))
    season = P.season_folder(folder)

    def join(*parts: Column) -> Column:
        return F.regexp_replace(F.concat_ws("/", *parts), "^//+", "/")

    above = P.parent_dir(folder)
    output = (
        F.when(~F.col("owned"), join(folder, target))
        .when(name.rlike(K.EPISODE_IN_NAME), join(F.coalesce(season, above), target))
        .otherwise(join(above, F.concat(name, F.lit(K.CONVERTED_SUFFIX)), target))
    )
    return owned_files.withColumn("output_path", output)
