"""Segments, instants, retention and losses: running values along each probe's log.

One probe may hold a large share of all rows. Running values are therefore taken in two steps: within blocks of
positions, each its own window partition, and over the blocks' totals, of which there are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of one block.
BLOCK = 1 << 16


def running(df: DataFrame, key: str, pos: str, value: Column, name: str, how: str = "sum", block: int = BLOCK) -> DataFrame:
    """df with name: the sum (or max) of value over the rows of the key up to and with this one, by pos; nulls add nothing."""
    fold = {"sum": F.sum, "max": F.max}[how]
    dealt = df.withColumn("_v", value).withColumn("_b", F.call_function("div", F.col(pos), F.lit(block).cast("long")))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(key, "_b").agg(fold("_v").alias("_t")).select(key, "_b", fold("_t").over(before).alias("_t"))
    inside = Window.partitionBy(key, "_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    here = fold("_v").over(inside)
    both = F.coalesce(here, F.lit(0)) + F.coalesce("_t", F.lit(0)) if how == "sum" else F.greatest(here, F.col("_t"))
    return dealt.join(totals, [key, "_b"]).withColumn(name, both).drop("_v", "_b", "_t")


def previous(df: DataFrame, key: str, pos: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """df with name: the value in the key's row before this one by pos, null in its first; in blocks, like `running`."""
    dealt = df.withColumn("_v", value).withColumn("_b", F.call_function("div", F.col(pos), F.lit(block).cast("long")))
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy(key, "_b").agg(F.max(F.struct(F.col(pos).alias("pos"), "_v")).alias("_end")).select(key, "_b", F.max("_end").over(earlier)["_v"].alias("_past"))
    inside = Window.partitionBy(key, "_b").orderBy(pos)
    rows = dealt.withColumn("_nth", F.row_number().over(inside)).withColumn("_lag", F.lag("_v").over(inside)).join(ends, [key, "_b"])
    return rows.withColumn(name, F.when(F.col("_nth") == 1, F.col("_past")).otherwise(F.col("_lag"))).drop("_v", "_b", "_past", "_nth", "_lag")


def segments(script: DataFrame) -> DataFrame:
    """script with ticks: boundaries (rows that tick) up to and with each row; the row that ticks opens its segment."""
    return running(script, "probe_id", "pos", F.col("op").isin("produce", "merge").cast("long"), "ticks")


def accepted(script: DataFrame) -> DataFrame:
    """script without merges of a probe's own snapshots: these neither tick nor are logged."""
    return script.where((F.col("op") != "merge") | F.coalesce(F.col("peer") != F.col("probe_id"), F.lit(True)))


def instants(script: DataFrame, block: int = BLOCK) -> DataFrame:
    """script with ticks, as `segments` gives them, and event_count: events in the segment up to and with each row, 0 at its
    opening.

    Rows are dealt once. Within a block the counts and the events at the last opening are running values; from the blocks'
    ends comes what is open before each block.
    """
    opens = F.col("op").isin("produce", "merge")
    inside = Window.partitionBy("probe_id", "_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = script.withColumn("_b", F.call_function("div", F.col("pos"), F.lit(block).cast("long")))
    rows = rows.withColumn("_ticks", F.sum(opens.cast("long")).over(inside)).withColumn("_n", F.sum((~opens).cast("long")).over(inside))
    rows = rows.withColumn("_base", F.max(F.when(opens, F.col("_n"))).over(inside))
    before = Window.partitionBy("probe_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("probe_id", "_b").agg(F.max(F.struct("pos", "_ticks", "_n", "_base")).alias("_end"))
    ends = ends.withColumn("_past", F.coalesce(F.sum("_end._n").over(before), F.lit(0)))
    opened = F.max(F.col("_past") + F.col("_end._base")).over(before)
    ends = ends.select("probe_id", "_b", F.coalesce(F.sum("_end._ticks").over(before), F.lit(0)).alias("_told"), (F.col("_past") - F.coalesce(opened, F.lit(0))).alias("_open"))
    placed = rows.join(ends, ["probe_id", "_b"]).withColumn("ticks", F.col("_told") + F.col("_ticks"))
    return placed.withColumn("event_count", F.col("_n") - F.coalesce("_base", -F.col("_open"))).drop("_b", "_ticks", "_n", "_base", "_told", "_open")


def retained(script: DataFrame, capacity: int) -> DataFrame:
    """Rows that a bounded log of that many words still holds; whole entries only, the oldest go first."""
    written = running(script, "probe_id", "pos", F.col("n_words"), "_written")
    totals = script.groupBy("probe_id").agg(F.sum("n_words").alias("_total"))
    kept = written.join(totals, "probe_id").where(F.col("_total") - F.col("_written") + F.col("n_words") <= capacity)
    return kept.drop("_written", "_total")


def missed(script: DataFrame, capacity: int) -> DataFrame:
    """(probe_id, written_words, missed_words): words, not events."""
    totals = script.groupBy("probe_id").agg(F.sum("n_words").alias("written_words"))
    held = retained(script, capacity).groupBy("probe_id").agg(F.sum("n_words").alias("_held"))
    return totals.join(held, "probe_id", "left").select("probe_id", "written_words", (F.col("written_words") - F.coalesce("_held", F.lit(0))).alias("missed_words"))


def report_gaps(reports: DataFrame) -> DataFrame:
    """(probe_id, seq_num, missing): reports before which others of the probe are missing."""
    by = Window.partitionBy("probe_id").orderBy("seq_num")
    gap = F.col("seq_num") - F.lag("seq_num", 1, -1).over(by) - 1
    return reports.select("probe_id", "seq_num").distinct().withColumn("missing", gap).where("missing > 0")


def once(reports: DataFrame) -> DataFrame:
    """Reports without repeats, where restarts are tracked; others stay, as their numbers start again."""
    tracked = reports.where("persistent_epoch").dropDuplicates(["probe_id", "epoch", "seq_num"])
    return tracked.unionByName(reports.where("not persistent_epoch"))


def time_regressions(timeline: DataFrame) -> DataFrame:
    """(probe_id, pos, time_ns, latest_ns): timed rows that lie before an earlier row's time."""
    timed = timeline.where("time_ns is not null").select("probe_id", "pos", "time_ns")
    known = running(timed, "probe_id", "pos", F.col("time_ns"), "latest_ns", "max")
    return known.where("time_ns < latest_ns")


def restart_epochs(restarts: DataFrame) -> DataFrame:
    """restarts (probe_id, call_no, tracked, next_epoch) with epoch and invalid.

    A tracked probe takes the provider's epoch, and 0 with an error where it has none; others count up from 0 and wrap.
    """
    tracked = F.col("tracked")
    return restarts.withColumn("epoch", F.when(tracked, F.coalesce("next_epoch", F.lit(0))).otherwise(F.col("call_no") % 65536)).withColumn("invalid", tracked & F.col("next_epoch").isNull())


def report_restarts(reports: DataFrame) -> DataFrame:
    """reports (probe_id, nth, seq_num) with restart_no: how often their probe had started again, counted in order of arrival nth.

    A recorder numbers its reports from 0, so a number that is not greater than the one before tells of a restart; a report
    that comes again right away does not. Reports lost around a restart do not hide it while what is left steps back.
    """
    steps = previous(reports, "probe_id", "nth", F.col("seq_num"), "_before")
    return running(steps, "probe_id", "nth", F.coalesce(F.col("seq_num") < F.col("_before"), F.lit(False)).cast("long"), "restart_no").drop("_before")


def restart_ranges(reports: DataFrame) -> DataFrame:
    """(probe_id, restart_no, from_nth, epoch): from which arrival on each start of a probe holds, with the epoch it began in, as
    headers tell; reports: what `report_restarts` gives, with epoch."""
    first = F.min(F.struct("nth", "epoch")).alias("s")
    return reports.groupBy("probe_id", "restart_no").agg(first).select("probe_id", "restart_no", F.col("s.nth").alias("from_nth"), F.col("s.epoch").alias("epoch"))


def at_restart(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows (probe_id, nth, ...) with restart_no and start_epoch of the range that holds at nth, null before the first: one sort of
    both, in blocks, and the last range so far."""
    given = [c for c in rows.columns if c not in ("probe_id", "nth")]
    mark = F.struct(F.col("from_nth").alias("nth"), "restart_no", F.col("epoch").alias("start_epoch"))
    marks = ranges.select("probe_id", (2 * F.col("from_nth")).alias("at"), mark.alias("mark"))
    asks = rows.select("probe_id", (2 * F.col("nth") + 1).alias("at"), "nth", F.struct(F.lit(True).alias("is_row"), *given).alias("row"))
    known = running(marks.unionByName(asks, allowMissingColumns=True), "probe_id", "at", F.col("mark"), "range", "max").where("row.is_row")
    return known.select("probe_id", "nth", *(F.col("row").getField(c).alias(c) for c in given), "range.restart_no", "range.start_epoch")


def ring_index(seq: Column, capacity: int, power_of_two: bool = False) -> Column:
    """Slot of a sequence number; a power-of-two ring uses the largest power that fits its capacity."""
    if power_of_two:
        return seq.bitwiseAND(F.lit((1 << (capacity.bit_length() - 1)) - 1).cast("long"))
    return F.pmod(seq, F.lit(capacity).cast("long"))
