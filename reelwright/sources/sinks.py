"""Report and decision tables as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright.functions import display, quality


def write_decisions(decisions: DataFrame, path: str, run: str) -> None:
    """Append the decisions of a run, partitioned by run and role."""
    decisions.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run", "role").parquet(path)


def cleanup_report(candidates: DataFrame) -> DataFrame:
    """Report rows of retention candidates."""
    return candidates.select(
        "item_id", "name", F.col("production_year").alias("year"), F.col("community_rating").alias("rating"),
        "critic_rating", "threshold", F.bround("age", 2).alias("age_years"), "library",
        F.coalesce("size", F.lit(0)).alias("size_bytes"), display.format_size(F.col("size")).alias("size_human"),
        "path",
    )


def report_header(rows: DataFrame, size: str) -> DataFrame:
    total = F.coalesce(F.sum(size), F.lit(0))
    return rows.agg(F.count("*").alias("n_rows"), total.alias("total_size_bytes")).withColumn(
        "total_size_human", display.format_size(F.col("total_size_bytes")))


def write_json_report(header: DataFrame, rows: DataFrame, path: str) -> None:
    """One JSON document per row beside a one-row header, so a report of any size streams out."""
    header.write.mode("overwrite").json(f"{path}/header")
    rows.write.mode("overwrite").json(f"{path}/rows")


def check_report(compared: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """(proposal_id, should_download, report): the comparison as one JSON document each."""
    found = F.col("status") == "found"

    def when_found(value: Column) -> Column:
        return F.when(found, value)

    scores = F.struct(
        F.bround("existing_score", 2).alias("existing_score"),
        F.bround("proposed_score", 2).alias("proposed_score"),
        F.bround("score_diff", 2).alias("score_diff"),
        F.when(F.col("proposed_score") > F.col("existing_score"), "proposed").otherwise("existing").alias("winner"),
        quality.rounded_score(F.col("existing_breakdown")).alias("existing_breakdown"),
        quality.rounded_score(F.col("proposed_breakdown")).alias("proposed_breakdown"),
    )
    proposed = F.struct(*[F.col(c) for c in ("resolution", "codec", "size_mb", "audio_languages")])
    document = F.struct(
        "status", "recommendation", "reason",
        when_found(F.struct(F.col("existing_id").alias("id"), *fields)).alias("existing"),
        F.when(F.col("status") != "excluded", proposed).alias("proposed"),
        when_found(scores).alias("quality_comparison"),
    )
    return compared.select(
        "proposal_id", (F.col("recommendation") == "download").alias("should_download"),
        F.to_json(document).alias("report"),
    )
