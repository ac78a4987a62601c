"""Figures and rows of the decision report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwright.functions import display
from reelwright.functions.util import non_blank
from reelwright.operators.select import language_message


def dedupe_stats(decisions: DataFrame) -> DataFrame:
    """One row of totals over decision rows (role, size, status)."""
    kept, gone = F.col("role") == "keep", F.col("role") == "delete"
    size = F.coalesce(F.col("size").try_cast("bigint"), F.lit(0))
    totals = decisions.agg(
        F.count_if(kept).alias("total_groups"),
        F.count_if(kept).alias("items_to_keep"),
        F.count_if(gone).alias("items_to_delete"),
        F.count_if(gone & (F.col("status") == "success")).alias("deleted"),
        F.count_if(gone & (F.col("status") == "failed")).alias("failed"),
        F.count_if(gone & ~F.coalesce("status", F.lit("skipped")).isin("success", "failed")).alias("skipped"),
        F.coalesce(F.sum(F.when(kept, size)), F.lit(0)).alias("size_to_keep"),
        F.coalesce(F.sum(F.when(gone, size)), F.lit(0)).alias("size_to_delete"),
    )
    total = F.col("size_to_keep") + F.col("size_to_delete")
    return totals.select(
        "*",
        F.when(total > 0, F.col("size_to_delete") / F.nullif(total, F.lit(0)) * 100.0)
        .otherwise(F.lit(0.0)).alias("percentage_saved"),
        display.format_size(F.col("size_to_delete")).alias("space_saved"),
    )


def group_age_flags(decisions: DataFrame) -> DataFrame:
    """Per group the newest and the oldest copy, and whether the newest is being removed."""
    stamped = F.struct("date_added", "role", "item_id")
    groups = decisions.groupBy("group_id").agg(F.max(stamped).alias("new"), F.min(stamped).alias("old"))
    return groups.select(
        "group_id",
        F.col("new.date_added").alias("newest_date_added"), F.col("new.item_id").alias("newest_id"),
        (F.col("new.role") == "delete").alias("newest_is_deleted"),
        F.col("old.date_added").alias("oldest_date_added"), F.col("old.item_id").alias("oldest_id"),
        (F.col("old.role") == "keep").alias("oldest_is_kept"),
    )


def decision_report_rows(decisions: DataFrame) -> DataFrame:
    """One row per removed copy, with the title, codec and size of the kept one.

    Rows stay long: a group of any size never becomes one cell.
    """
    numbered = F.col("season").isNotNull() & F.col("episode").isNotNull()
    short = display.truncate(F.col("name"), 15)
    title = F.when(
        non_blank(F.col("series_name")),
        F.when(numbered, F.concat(F.col("series_name"), F.lit(" S"), F.col("season").cast("string"),
                                  F.lit("E"), F.col("episode").cast("string")))
        .otherwise(F.concat(F.col("series_name"), F.lit(" - "), short)),
    ).otherwise(short)
    keepers = decisions.where("role = 'keep'").select(
        "group_id", F.col("item_id").alias("keep_item"), title.alias("title"),
        F.coalesce("codec", F.lit("unknown")).alias("keep_codec"),
        F.coalesce("size", F.lit(0)).alias("keep_size"), F.col("name").alias("keep_name"),
    )
    gone = decisions.where("role = 'delete'").select(
        "group_id", F.col("item_id").alias("delete_item"), F.col("name").alias("delete_name"),
        F.when(F.col("status") == "success", F.lit("Deleted"))
        .when(F.col("status") == "failed", F.lit("Failed")).otherwise(F.lit("Pending")).alias("status_label"),
    )
    return gone.join(keepers, "group_id").select(
        "group_id", "keep_item", "title", "keep_codec", "keep_size", "delete_item",
        (F.col("delete_name") == F.col("keep_name")).alias("same_name"),
        display.truncate(F.col("delete_name"), 10).alias("delete_label"), "status_label",
    )


def language_usage_summary(decisions: DataFrame, priorities: Sequence[str]) -> DataFrame:
    """How often language priority was used, and the explanation it gave."""
    kept = decisions.where("role = 'keep'").withColumn("message", language_message(priorities))
    return kept.groupBy("message").agg(
        F.count("*").alias("n_groups"),
        F.bool_or("selected_by_language").alias("used"),
        F.bool_or("changed_by_language").alias("changed"),
    )
