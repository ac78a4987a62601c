"""Item-added events: bodies as JSON or raw text, routed to two queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwright import schemas
from reelwright.constants import ITEM_ADDED_EVENTS
from reelwright.functions.util import first_filled, non_blank

ITEM = "Type string, Id string, ratingKey string, SeriesId string, SeriesName string, Name string, title string"


def read_stream(spark: SparkSession, path: str, fmt: str = "json", max_files: int = 100) -> DataFrame:
    """Event bodies from files that appear in a folder."""
    return spark.readStream.schema(schemas.ITEM_ADDED).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


def _raw(body: Column, key: str) -> Column:
    return F.regexp_extract(body, rf'"(?:{key})"\s*:\s*"([^"]+)"', 1)


def parse_events(rows: DataFrame) -> DataFrame:
    """Event name, the item to describe and the item whose genres count.

    Genres belong to the series of an episode, descriptions to the item itself. The body is read
    as a map, as its keys come in two spellings; one that is no JSON object is searched for the
    same fields as text.
    """
    fields = F.from_json(F.trim("body"), "map<string,string>")
    parsed = rows.withColumn("_f", fields)
    item_text = F.coalesce(*[F.try_element_at("_f", F.lit(k)) for k in ("Item", "Metadata", "item")])
    parsed = parsed.withColumn("_item", F.from_json(item_text, ITEM))
    item = F.col("_item")
    json = F.size("_f") > 0
    own_id = first_filled(item["Id"], item["ratingKey"])
    title = F.coalesce(first_filled(item["Name"], item["title"], F.try_element_at("_f", F.lit("Title"))), F.lit("unknown"))
    event = first_filled(F.try_element_at("_f", F.lit("Event")), F.try_element_at("_f", F.lit("event")))
    named = parsed.select(
        *rows.columns, json.alias("_json"), F.coalesce(item["Type"] == "Episode", F.lit(False)).alias("_episode"),
        F.when(json, F.coalesce(event, F.lit(""))).otherwise(_raw(F.col("body"), "[Ee]vent")).alias("event"),
        F.when(json, own_id).otherwise(first_filled(_raw(F.col("body"), "Id"))).alias("desc_id"),
        F.when(json, title).otherwise(
            F.coalesce(first_filled(_raw(F.col("body"), "Name|title|Title")), F.lit("unknown"))).alias("_title"),
        F.coalesce(item["Name"], F.lit("")).alias("_name"), first_filled(item["SeriesId"]).alias("_series_id"),
        F.coalesce(first_filled(item["SeriesName"]), F.lit("unknown")).alias("_series"),
    )
    episode = F.coalesce(F.col("_json"), F.lit(False)) & F.col("_episode")
    of_series = episode & F.col("_series_id").isNotNull()
    return named.select(
        *rows.columns, "event", "desc_id",
        F.when(episode, F.concat("_series", F.lit(" – "), "_name")).otherwise(F.col("_title")).alias("desc_name"),
        F.when(of_series, F.col("_series_id")).otherwise(F.col("desc_id")).alias("genre_id"),
        F.when(of_series, F.col("_series")).when(episode, F.col("_name")).otherwise(F.col("_title")).alias("genre_name"),
    )


def item_added(parsed: DataFrame) -> DataFrame:
    """Only events that announce a new item, with both ids."""
    return parsed.where(
        F.lower("event").isin(*ITEM_ADDED_EVENTS) & non_blank(F.col("desc_id")) & non_blank(F.col("genre_id")))


def route_events(added: DataFrame) -> DataFrame:
    """Two rows per event: (queue, id, name) for genres and for descriptions."""
    entries = F.array(
        F.struct(F.lit("descriptions").alias("queue"), F.col("desc_id").alias("id"), F.col("desc_name").alias("name")),
        F.struct(F.lit("genres").alias("queue"), F.col("genre_id").alias("id"), F.col("genre_name").alias("name")),
    )
    kept = [c for c in added.columns if c not in ("body", "event", "desc_id", "desc_name", "genre_id", "genre_name")]
    return added.select(*kept, F.explode(entries).alias("e")).select(*kept, "e.*")
