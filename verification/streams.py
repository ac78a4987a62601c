"""Queries of the event family, batch and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelwright.operators.debounce import debounce_batches
from reelwright.session import checkpoint_dir
from reelwright.sources.catalogue import scan_playback
from reelwright.sources.events import item_added, parse_events, route_events
from reelwright.streaming import late, queue
from reelwright.streaming.sessions import run_sessions
from verification.bridge import Bridge
from verification.registry import fragment, query

fragment("o_bodies", """SELECT event_id, ts, event_id % 7 = 0 AS raw, event_id % 3 = 0 AS is_ep, CASE event_type WHEN 'view' THEN 'library.new' WHEN 'click' THEN 'Item.Added' WHEN 'purchase' THEN 'itemadded'
WHEN 'signup' THEN 'system.itemadded' ELSE 'playback.start' END AS event, CASE WHEN event_id % 50 <> 0 THEN (event_id % 400)::varchar END AS id, 'Item ' || event_id % 400 || ' v' || event_id AS name,
CASE WHEN event_id % 9 <> 0 THEN 'u' || user_id END AS series_id, CASE WHEN event_id % 2 = 0 THEN 'Series ' || user_id ELSE 'unknown' END AS series_name FROM events""")
fragment("o_parsed", """SELECT event_id, ts, event, id AS desc_id, CASE WHEN is_ep AND NOT raw THEN series_name || ' – ' || name ELSE name END AS desc_name,
CASE WHEN is_ep AND NOT raw AND series_id IS NOT NULL THEN series_id ELSE id END AS genre_id, CASE WHEN is_ep AND NOT raw AND series_id IS NOT NULL THEN series_name ELSE name END AS genre_name FROM o_bodies""")
fragment("o_routed", """SELECT event_id, ts, 'descriptions' AS queue, desc_id AS id, desc_name AS name FROM o_parsed WHERE lower(event) <> 'playback.start' AND desc_id IS NOT NULL AND genre_id IS NOT NULL
UNION ALL SELECT event_id, ts, 'genres', genre_id, genre_name FROM o_parsed WHERE lower(event) <> 'playback.start' AND desc_id IS NOT NULL AND genre_id IS NOT NULL""")
fragment("o_gaps", """SELECT *, sum(opens) OVER (ORDER BY ts, event_id, queue ROWS UNBOUNDED PRECEDING) AS batch_no FROM
(SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id, queue)) >= 300000000, true) THEN 1 ELSE 0 END AS opens FROM o_routed)""")
fragment("o_batches", """SELECT strftime(min(ts) OVER (PARTITION BY batch_no), '%Y-%m-%d %H:%M:%S.%f') AS batch_start, max(ts) OVER (PARTITION BY batch_no) AS batch_end, queue, id, name, ts, event_id FROM o_gaps""")


def _routed(b: Bridge):
    return route_events(item_added(parse_events(b.item_added)))


@query("source_events", "SELECT event_id, event, desc_id, desc_name, genre_id, genre_name FROM o_parsed")
def _(b: Bridge):
    return parse_events(b.item_added).select("event_id", "event", "desc_id", "desc_name", "genre_id", "genre_name")


@query("route_events", "SELECT event_id, queue, id, name FROM o_routed")
def _(b: Bridge):
    return _routed(b).select("event_id", "queue", "id", "name")


@query("debounce_batches", "SELECT batch_start, queue, id, arg_max(name, (ts, event_id)) AS name, count(*) AS n_events FROM o_batches GROUP BY ALL")
def _(b: Bridge):
    rows = debounce_batches(_routed(b))
    return rows.select(F.date_format("batch_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("batch_start"), "queue", "id", "name", "n_events")


def _folder(b: Bridge, name: str) -> str:
    return f"{checkpoint_dir(b.spark)}/{name}-{uuid.uuid4().hex}"


def _feed(rows, folder: str, run, parts: int = 3) -> None:
    """The rows as a file stream in ranges of event time: one run of the stream per range.

    ``run`` starts the stream and goes on from its checkpoint. A last run gets one tick, a row with a
    time long after all others and nothing else, which moves the watermark past them.
    """
    spark = rows.sparkSession
    cuts = rows.select(F.unix_micros("ts").cast("double").alias("t")).approxQuantile("t", [i / parts for i in range(1, parts)], 0.01)
    micros = F.unix_micros("ts")
    place = sum((F.when(micros >= int(c), 1).otherwise(0) for c in cuts), F.lit(0))
    end = rows.agg((F.max("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts"))
    tick = end.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    for part in [*(rows.where(place == i) for i in range(parts)), tick]:
        part.write.mode("append").parquet(folder)
        run(spark.readStream.schema(rows.schema).parquet(folder)).awaitTermination()


@query("debounce_stream", "SELECT batch_start, queue, id, arg_max(name, (ts, event_id)) AS name, count(*) AS n_events FROM o_batches GROUP BY ALL")
def _(b: Bridge):
    """The queue run over the events as a file stream, to the close of its last batch."""
    base = _folder(b, "queue")

    def flush(batch, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    _feed(b.item_added, f"{base}/in", lambda stream: queue.run_queue(stream, f"{base}/state", f"{base}/checkpoint", flush))
    rows = b.spark.read.schema("batch_start timestamp, queue string, id string, name string, n_events bigint").parquet(f"{base}/out/*")
    return rows.select(F.date_format("batch_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("batch_start"), "queue", "id", "name", "n_events")


@query("flush_batches", """SELECT 'genres' AS queue, p::varchar AS item_id, array_to_string(merged, '|') AS value FROM o_cmp
WHERE len(ext) > 0 AND len(missing) > 0 AND p::varchar IN (SELECT id FROM o_routed WHERE queue = 'genres')
UNION ALL SELECT 'descriptions', p::varchar, coalesce(o, y::varchar) FROM (SELECT p, CASE WHEN sk_overview <> '' THEN sk_overview WHEN cs_overview <> '' THEN cs_overview WHEN en_overview <> '' THEN en_overview END AS o,
CASE WHEN sk_tagline <> '' THEN sk_tagline WHEN cs_tagline <> '' THEN cs_tagline WHEN en_tagline <> '' THEN en_tagline END AS t, try_cast(year_text AS int) AS y
FROM b_genres g JOIN b_localized l ON l.key = CASE WHEN type = 'Series' THEN 'tv:' ELSE 'movie:' END || tmdb WHERE NOT negative AND p::varchar IN (SELECT id FROM o_routed WHERE queue = 'descriptions'))
WHERE o IS NOT NULL OR t IS NOT NULL OR y IS NOT NULL""")
def _(b: Bridge):
    """Closed batches run the genre pass and the description pass over the items they name, to the last batch."""
    base = _folder(b, "flush")
    items = b.genre_items.withColumn("item_id", F.col("p").cast("string")).select(
        "item_id", "name", "type", "provider_ids", "genres", "genre_items", "locked_fields",
        F.lit("").alias("overview"), F.lit(None).cast("string").alias("overview_lang"), F.array().cast("array<string>").alias("taglines"),
        F.lit(None).cast("string").alias("tagline_lang"), F.lit("en").alias("title_lang"), F.lit(None).cast("int").alias("production_year"),
        F.lit(None).cast("string").alias("series_id"), F.lit(None).cast("int").alias("season"), F.lit(None).cast("int").alias("episode"))
    flush = queue.flush_to_tables(items, b.genre_snapshot, b.localized, base)
    _feed(b.item_added, f"{base}/in", lambda stream: queue.run_queue(stream, f"{base}/state", f"{base}/checkpoint", flush), 2)
    genres = b.spark.read.schema("item_id string, new_genres array<string>").parquet(f"{base}/genres/*")
    texts = b.spark.read.schema("item_id string, set_overview string, set_year int").parquet(f"{base}/descriptions/*")
    return genres.select(F.lit("genres").alias("queue"), "item_id", F.array_join("new_genres", "|").alias("value")).unionByName(
        texts.select(F.lit("descriptions").alias("queue"), "item_id", F.coalesce("set_overview", F.col("set_year").cast("string")).alias("value"))).distinct()


@query("session_summary_stream", """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS batch_start, strftime(max(ts) + INTERVAL 300 SECOND, '%Y-%m-%d %H:%M:%S.%f') AS quiet_from, count(*) AS n_events
FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM
(SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 300000000 THEN 0 ELSE 1 END AS opens FROM events)) GROUP BY user_id, session""")
def _(b: Bridge):
    """Counts per user and quiet-time session, over the events as a file stream."""
    base = _folder(b, "summary")
    rows = b.table("events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")

    def run(stream):
        return queue.session_summary(stream, "user_id").writeStream.format("parquet").option("path", f"{base}/out").option(
            "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()

    _feed(rows, f"{base}/in", run)
    counts = b.spark.read.schema("user_id bigint, batch_start timestamp, quiet_from timestamp, n_events bigint").parquet(f"{base}/out")
    day = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return counts.select("user_id", F.date_format("batch_start", day).alias("batch_start"), F.date_format("quiet_from", day).alias("quiet_from"), "n_events")


@query("sessions_stream", """SELECT user_id, item_id, event_id, title, strftime(stop_ts, '%Y-%m-%d %H:%M:%S.%f') AS stop_ts, duration_min, content_type, date FROM o_sessions""")
def _(b: Bridge):
    """The streaming twin of playback_sessions, to the last start that met no stop."""
    base = _folder(b, "sessions")

    def emit(sessions, batch_id: int) -> None:
        sessions.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    _feed(scan_playback(b.activity), f"{base}/in", lambda stream: run_sessions(stream, f"{base}/state", f"{base}/checkpoint", emit))
    schema = "user_id string, item_id string, event_id bigint, title string, stop_ts timestamp, duration_min double, content_type string, date string"
    return b.spark.read.schema(schema).parquet(f"{base}/out/*").withColumn("stop_ts", F.date_format("stop_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


LATE_PARTS = 4
_SPAN = "(max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1)"
fragment("o_arrivals", f"""SELECT event_id, ts, user_id, part + CASE WHEN event_id % 5 = 3 THEN 1 ELSE 0 END AS part FROM
(SELECT event_id, ts, user_id, ((epoch_us(ts) - min(epoch_us(ts)) OVER ()) * {LATE_PARTS} // {_SPAN})::int AS part FROM events)
UNION ALL SELECT event_id, ts, user_id, part + 1 FROM (SELECT event_id, ts, user_id, ((epoch_us(ts) - min(epoch_us(ts)) OVER ()) * {LATE_PARTS} // {_SPAN})::int AS part FROM events) WHERE event_id % 7 = 0""")
fragment("o_clocks", """SELECT part + 1 AS part, max(epoch_us(max(ts))) OVER (ORDER BY part) - (SELECT (max(epoch_us(ts)) - min(epoch_us(ts))) // 1000000 // 12 * 1000000 FROM events) AS clock FROM o_arrivals GROUP BY part""")
fragment("o_judged", """SELECT a.event_id, a.part, CASE WHEN epoch_us(ts) < clock THEN 'late' ELSE 'in time' END AS kind FROM o_arrivals a LEFT JOIN o_clocks USING (part)""")


@query("late_rows", """SELECT event_id, 'kept' AS kind, min(part) AS part, 1::bigint AS n FROM o_judged WHERE kind = 'in time' GROUP BY event_id
UNION ALL SELECT event_id, 'late', part, count(*) FROM o_judged WHERE kind = 'late' GROUP BY ALL
UNION ALL SELECT event_id, 'repeated', max(part), count(*) - 1 FROM o_judged WHERE kind = 'in time' GROUP BY event_id HAVING count(*) > 1""")
def _(b: Bridge):
    """Events fed out of order: a fifth come one range of time later, a seventh come again; what is kept, late and repeated."""
    base = _folder(b, "late")
    rows = b.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    micros = F.unix_micros("ts")
    low, high = rows.agg(F.min(micros), F.max(micros)).first()
    rows = rows.withColumn("part", F.expr(f"(unix_micros(ts) - {low}) * {LATE_PARTS} div {high - low + 1}").cast("int"))
    later = F.when(F.col("event_id") % 5 == 3, F.col("part") + 1).otherwise(F.col("part"))
    fed = rows.withColumn("part", later).unionByName(rows.where("event_id % 7 = 0").withColumn("part", F.col("part") + 1))
    for part in range(LATE_PARTS + 1):
        fed.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{base}/in")
        stream = b.spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint").parquet(f"{base}/in")
        late.run_late(stream, ["event_id"], f"{base}/out", f"{base}/checkpoint", (high - low) // 1_000_000 // 12).awaitTermination()

    def table(kind: str, n):
        found = b.spark.read.option("basePath", f"{base}/out/{kind}").parquet(f"{base}/out/{kind}/*")
        return found.groupBy("event_id", F.lit(kind).alias("kind"), F.col("batch").cast("int").alias("part")).agg(n.cast("bigint").alias("n"))

    return table("kept", F.count("*")).unionByName(table("late", F.count("*"))).unionByName(table("repeated", F.sum("n")))
