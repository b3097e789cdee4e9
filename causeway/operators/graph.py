"""Interactions between probes, happens-before, frontiers and what external logs and expectations say about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import clocks as C
from causeway.functions import words as W
from causeway.operators.scan import BLOCK, frontier_scan
from causeway.operators.tables import drop, shared_path, written
from causeway.operators.timeline import previous, running


def interactions_of(entries: DataFrame) -> DataFrame:
    """(dst_probe, dst_clock, src_probe, src_clock) of decoded entries: a self clock with a foreign clock right behind it.

    Logging the first may push an old clock out, and the recorder may tell between both that it has no room for that one.
    """
    by = Window.partitionBy("probe_id", "seq_num").orderBy("entry_idx")
    ahead = {f"next_{c}": F.lead(c).over(by) for c in ("kind", "clock_probe_id", "clock_word")}
    logged = entries.where(~F.coalesce(F.col("event_id") == W.INTERNAL_EVENTS["num_clocks_overflowed"], F.lit(False)))
    pairs = logged.withColumns(ahead).where("kind = 'clock' and next_kind = 'clock' and clock_probe_id = probe_id and next_clock_probe_id <> probe_id")
    return pairs.select(F.col("probe_id").alias("dst_probe"), F.col("clock_word").alias("dst_clock"), F.col("next_clock_probe_id").alias("src_probe"), F.col("next_clock_word").alias("src_clock"))


def marked_interactions(entries: DataFrame) -> DataFrame:
    """(dst_probe, dst_clock, src_probe, src_clock, adjacent) of every foreign clock in decoded entries (probe_id, seq_num, ...).

    A merge logs the probe's own clock and the foreign one behind it. The recorder may log events of its own between both, and a
    report may end there: such an interaction is whole but not adjacent. Where something else lies between, where a report
    is missing, or where the own clock has been pushed out, the interaction is broken: dst_clock and adjacent are null. So it
    is where a whole report of nothing but the recorder's own events lies between.
    """
    here = Window.partitionBy("probe_id", "seq_num").orderBy("entry_idx").rowsBetween(Window.unboundedPreceding, -1)
    own = (F.col("kind") == "clock") & (F.col("clock_probe_id") == F.col("probe_id"))
    told = F.coalesce(W.is_internal(F.col("event_id")), F.lit(False))
    # The last entry that is not the recorder's own: its clock if it is one of the probe itself, null if it is something else.
    said = F.when(~told, F.struct(F.when(own, F.col("clock_word")).alias("clock"), F.col("entry_idx").alias("at")))
    rows = entries.withColumn("_said", said).withColumn("_last", F.last("_said", True).over(here))
    ends = rows.groupBy("probe_id", "seq_num").agg(F.max(F.when(F.col("_said").isNotNull(), F.struct("entry_idx", "_said"))).alias("_end"))
    ends = previous(ends, "probe_id", "seq_num", F.struct(F.col("seq_num").alias("seq"), F.col("_end._said.clock").alias("clock")), "_prior")
    past = ends.select("probe_id", "seq_num", F.when(F.col("_prior.seq") == F.col("seq_num") - 1, F.col("_prior.clock")).alias("_before"))
    heard = rows.where(F.coalesce(F.col("clock_probe_id") != F.col("probe_id"), F.lit(False))).join(past, ["probe_id", "seq_num"], "left")
    clock = F.when(F.col("_last").isNotNull(), F.col("_last.clock")).otherwise(F.col("_before"))
    adjacent = F.when(clock.isNotNull(), F.coalesce(F.col("_last.at") == F.col("entry_idx") - 1, F.lit(False)))
    return heard.select(F.col("probe_id").alias("dst_probe"), clock.alias("dst_clock"), F.col("clock_probe_id").alias("src_probe"), F.col("clock_word").alias("src_clock"), adjacent.alias("adjacent"))


def dangling(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges whose source segment (probe_id, ticks) is not known."""
    return edges.join(known.select(F.col("probe_id").alias("src_probe"), F.col("ticks").alias("src_ticks")).distinct(), ["src_probe", "src_ticks"], "left_anti")


def happens_after(edges: DataFrame, probe: int, ticks: int) -> DataFrame:
    """(probe_id, ticks): of every probe, the first segment that the given one happens before or is.

    A probe's segments follow each other, so what is reached is a suffix, and its first segment says it all. Each round
    follows only edges out of what the last one improved; tables are written, so plans stay short.
    """
    spark = edges.sparkSession
    root = shared_path(spark, "reach")
    edges = written(edges.select("src_probe", "src_ticks", "dst_probe", "dst_ticks").distinct(), f"{root}/edges")
    new = known = written(spark.createDataFrame([(probe, ticks)], "probe_id long, ticks long"), f"{root}/0")
    n = 0
    while not new.isEmpty():
        n += 1
        out = edges.join(new, (edges.src_probe == new.probe_id) & (edges.src_ticks >= new.ticks)).groupBy(F.col("dst_probe").alias("probe_id")).agg(F.min("dst_ticks").alias("ticks"))
        old = known.select("probe_id", F.col("ticks").alias("had"))
        new = written(out.join(old, "probe_id", "left").where("had is null or ticks < had").select("probe_id", "ticks"), f"{root}/new{n}")
        known = written(known.unionByName(new).groupBy("probe_id").agg(F.min("ticks").alias("ticks")), f"{root}/{n}")
        drop(spark, f"{root}/{n - 1}")
        if n > 1:
            drop(spark, f"{root}/new{n - 1}")
    drop(spark, f"{root}/edges")
    return known


def frontier(clocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(probe_id, neighbor_id, epoch, ticks): the latest clock of each neighbour, folding clocks by pos.

    Later is not an order across the wrap of epochs, so a fold must follow pos there. Pairs that never come near the wrap
    on both sides need no order and take a maximum, which aggregates before the shuffle; the others are folded in blocks of
    positions (`frontier_scan`), so that one pair with most rows is many tasks.
    """
    keys = ["probe_id", "neighbor_id"]
    part = F.call_function("div", F.col("pos"), F.lit(block).cast("long"))
    rows = clocks.withColumn("_part", part)
    parts = rows.groupBy(*keys, "_part").agg((F.max("epoch") >= C.NEAR_MAX).alias("high"), (F.min("epoch") <= C.NEAR_MIN).alias("low"), F.max(F.struct("epoch", "ticks")).alias("c"))
    pairs = parts.groupBy(*keys).agg(F.bool_or("high").alias("high"), F.bool_or("low").alias("low"), F.max("c").alias("c"))
    plain = pairs.where("not (high and low)").select(*keys, F.col("c.epoch").alias("epoch"), F.col("c.ticks").alias("ticks"))
    # Rows are told by pair and block, of which a hot pair has many.
    needed = parts.select(*keys, "_part").join(pairs.where("high and low").select(*keys), keys)
    ordered = rows.join(needed, [*keys, "_part"], "left_semi").select(*keys, "pos", "epoch", "ticks")
    return plain.unionByName(frontier_scan(ordered, block))


def tracked_neighbours(clocks: DataFrame, capacity: int) -> DataFrame:
    """(probe_id, neighbor_id) that fit a frontier of that many clocks, the probe's own included; first seen, first kept."""
    seen = clocks.groupBy("probe_id", "neighbor_id").agg(F.min("pos").alias("first"))
    by = Window.partitionBy("probe_id").orderBy("first", "neighbor_id")
    return seen.withColumn("r", F.row_number().over(by)).where(F.col("r") < capacity).select("probe_id", "neighbor_id")


def expectations(timeline: DataFrame, manifest: DataFrame) -> DataFrame:
    """(event_id, name, expected, unmet, failures): expectations are payload events that hold unless the payload is 0.

    tags of the manifest are a list, parted by semicolons; of an event that bears both tags both are counted.
    """
    counted = timeline.groupBy("event_id").agg(F.count("*").alias("n"), F.count_if(F.col("payload_raw") == 0).alias("zero"))
    tags = F.transform(F.split("tags", ";"), lambda t: F.lower(F.trim(t)))
    holds, fails = F.array_contains(tags, "expectation"), F.array_contains(tags, "failure")
    named = counted.join(manifest, counted.event_id == manifest.id).where(holds | fails)
    return named.select("event_id", "name", F.when(holds, F.col("n")).otherwise(0).alias("expected"), F.when(holds, F.col("zero")).otherwise(0).alias("unmet"), F.when(fails, F.col("n")).otherwise(0).alias("failures"))


def correlate(log: DataFrame, timeline: DataFrame) -> DataFrame:
    """log rows (probe_id, ticks, event_count, ...) with pos, the timeline's place of that instant."""
    return log.join(timeline.select("probe_id", "ticks", "event_count", "pos"), ["probe_id", "ticks", "event_count"], "left")


def correlate_as_of(log: DataFrame, timeline: DataFrame) -> DataFrame:
    """log rows with pos: the last place of their segment at or before their event_count; null if there is none."""
    segment = F.struct("probe_id", "ticks").alias("segment")
    places = timeline.select(segment, (F.col("event_count") * 2).alias("at"), "pos", F.lit(None).cast("struct<" + ",".join(f"`{c}`:{t}" for c, t in log.dtypes) + ">").alias("line"))
    asks = log.select(segment, (F.col("event_count") * 2 + 1).alias("at"), F.lit(None).cast("long").alias("pos"), F.struct("*").alias("line"))
    known = running(places.unionByName(asks), "segment", "at", F.col("pos"), "found", "max").where("line is not null")
    return known.select("line.*", F.col("found").alias("pos"))
