"""The events table as a script of probe operations, and that script as a log, reports and interactions.

Every user is a probe. Errors, views, clicks and other purchases are events with one to four words; a signup produces a
snapshot; a purchase merges the latest earlier snapshot of the next user, if there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import clocks as C
from causeway.functions import words as W
from causeway.operators import timeline as T
from causeway.sources import wire

CODES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
SIZES = {"event": 1, "event_payload": 2, "event_time": 3, "event_payload_time": 4, "produce": 2, "merge": 4}
#: Positions whose entries make up one report of a probe: at most four words each.
REPORT_SPAN = 4096


def _case(c: Column, values: dict) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(c == k, v)
    return out


def script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(probe_id, pos, op, n_words, event_id, payload_raw, time_ns, peer, src_pos)"""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = events.agg((F.max("user_id") + 1).alias("users"))  # one row
    ns = F.expr("unix_micros(cast(convert_timezone('UTC', current_timezone(), cast(ts as timestamp_ntz)) as timestamp)) * 1000")
    rows = events.join(F.broadcast(users)).select(
        (F.col("user_id") + 1).alias("probe_id"),
        F.col("event_id").alias("pos"),
        "event_type",
        _case(F.col("event_type"), CODES).otherwise(5).cast("long").alias("event_id"),
        F.floor(F.col("value") * 100 + 0.5).cast("long").alias("payload_raw"),
        ns.alias("time_ns"),
        ((F.col("user_id") + 1) % F.col("users") + 1).alias("peer"),
    )
    # Purchases look back along the log of the probe that they might hear from; its signups are marks in it.
    asks = rows.where("event_type = 'purchase'").withColumn("owner", F.col("peer")).withColumn("mark", F.lit(None).cast("long"))
    marks = rows.where("event_type = 'signup'").withColumn("owner", F.col("probe_id")).withColumn("mark", F.col("pos"))
    heard = T.running(asks.unionByName(marks), "owner", "pos", F.col("mark"), "src_pos", "max").where("mark is null").drop("owner", "mark")
    every = heard.unionByName(rows.where("event_type <> 'purchase'").withColumn("src_pos", F.lit(None).cast("long")))
    op = F.when(F.col("event_type") == "signup", "produce").when(F.col("src_pos").isNotNull(), "merge")
    op = op.when(F.col("event_type") == "error", "event").when(F.col("event_type") == "click", "event_time").when(F.col("event_type") == "purchase", "event_payload_time").otherwise("event_payload")
    return every.withColumn("op", op).withColumn("n_words", _case(F.col("op"), SIZES).cast("long")).drop("event_type")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """script with ticks and event_count."""
    return T.instants(script(spark, sf_dir))


def interactions(segmented: DataFrame) -> DataFrame:
    """(dst_probe, dst_ticks, src_probe, src_ticks, pos): the source's segment is the one that its snapshot closed."""
    merges = segmented.where("op = 'merge'").select("probe_id", "ticks", "peer", "src_pos", "pos")
    sources = segmented.where("op = 'produce'").select(F.col("pos").alias("src_pos"), (F.col("ticks") - 1).alias("src_ticks"))
    return merges.join(sources, "src_pos").select(F.col("probe_id").alias("dst_probe"), F.col("ticks").alias("dst_ticks"), F.col("peer").alias("src_probe"), "src_ticks", "pos")


def with_words(segmented: DataFrame) -> DataFrame:
    """segmented with src_ticks and words, the entry's words in the log."""
    edges = interactions(segmented).select("pos", "src_ticks")
    rows = segmented.join(edges, "pos", "left")
    clock = lambda probe, ticks: [W.clock_word(probe), C.pack(*C.at_ordinal(ticks))]
    own, foreign = clock(F.col("probe_id"), F.col("ticks")), clock(F.col("peer"), F.col("src_ticks"))
    event, timed = W.event_word(F.col("event_id")), W.time_words(F.col("time_ns"))
    loaded = [W.payload_word(F.col("event_id")), W.payload_raw(F.col("payload_raw"))]
    words = _case(F.col("op"), {"event": F.array(event), "event_payload": F.array(*loaded), "event_time": F.array(*timed, event), "event_payload_time": F.array(*timed, *loaded), "produce": F.array(*own), "merge": F.array(*own, *foreign)})
    return rows.withColumn("words", words)


def reports(segmented: DataFrame, span: int = REPORT_SPAN, numbered: bool = False, fields: dict[str, Column] | None = None) -> DataFrame:
    """(content): one binary report for each stretch of span positions of a probe that holds entries.

    Its clock is the probe's at the end, its frontier the probe's before. Numbers are those of stretches, or, numbered, of
    the probe's reports. A report's size is bounded by the span, so no group grows with the input. fields go into its header.
    """
    rows = with_words(segmented).withColumn("seq_num", F.call_function("div", F.col("pos"), F.lit(span).cast("long")))
    before = F.col("ticks") - F.col("op").isin("produce", "merge").cast("long")
    grouped = rows.groupBy("probe_id", "seq_num").agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("log"), F.max("ticks").alias("ticks"), F.min(before).alias("before"))
    if numbered:
        grouped = T.running(grouped, "probe_id", "seq_num", F.lit(1).cast("long"), "nth").withColumn("seq_num", F.col("nth") - 1)
    epoch, ticks = C.at_ordinal(F.col("ticks"))
    first, past = C.at_ordinal(F.col("before"))
    own = F.array(F.struct(F.col("probe_id").alias("probe_id"), first.alias("epoch"), past.alias("ticks")))
    header = {"probe_id": F.col("probe_id"), "clock_word": C.pack(epoch, ticks), "seq_num": F.col("seq_num"), "time_resolution": F.lit(1000), "wall_clock_id": F.lit(1)} | (fields or {})
    return grouped.select(wire.encoded_report(header, own, F.flatten(F.transform("log", lambda x: x["words"]))).alias("content"))
