"""Decoded reports as a timeline: segments, events within them, losses, and what the recorder's own events mean.

A report's log may start within a segment. Its frontier names the probe's last clock that was drained before, so every
report is placed on its own; only the number of events in a segment that goes on from report to report is carried over,
as running values over reports. After a loss that number is unknown until the probe's next clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import words as W
from causeway.operators.tables import shared_path, written
from causeway.operators.timeline import previous, running

#: Written at the head of a report or in place of its log; they are no part of the log and count as no event.
OUTSIDE = ("items_missed", "insufficient_report_buffer")


def _is(name: str) -> Column:
    return F.coalesce(F.col("event_id") == W.INTERNAL_EVENTS[name], F.lit(False))


def timeline(reports: DataFrame, entries: DataFrame) -> DataFrame:
    """entries with clock_at, the packed clock of their segment, event_count, the events of it up to and with each, and meaning.

    reports: (probe_id, seq_num, frontier), each once; entries: what `entries.parse` makes of them by probe_id and seq_num.
    event_count is null where a loss makes it unknown; meaning names events of the recorder's own. A clock that overflows
    is told of before it is logged: such an event opens the new segment.
    """
    by = Window.partitionBy("probe_id", "seq_num").orderBy("entry_idx")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    meaning = F
    for name, code in W.INTERNAL_EVENTS.items():
        meaning = meaning.when(F.col("event_id") == code, name)
    overflow, invalid = _is("clock_overflowed"), _is("invalid_next_epoch")
    own = (F.col("kind") == "clock") & (F.col("clock_probe_id") == F.col("probe_id"))
    rows = entries.withColumn("meaning", meaning)
    # An own clock right behind the overflow that announced it goes on with the segment that is open already.
    told = F.lag(overflow, 1, False).over(by) | (F.lag(invalid, 1, False).over(by) & F.lag(overflow, 2, False).over(by))
    counts = F.col("kind").isin("event", "event_payload", "time") & ~F.coalesce(F.col("meaning").isin(*OUTSIDE), F.lit(False))
    # It may head the next report, with or without the other event that an overflow can bring.
    heads = own & ((F.col("entry_idx") == 0) | ((F.col("entry_idx") == 1) & F.lag(invalid, 1, False).over(by)))
    rows = rows.withColumn("_own", own).withColumn("_heads", heads).withColumn("_told", told).withColumn("_counts", counts.cast("long"))
    opened = F.when(overflow, F.col("payload_raw").bitwiseAND(F.lit(65535).cast("long")) * 65536 + 1).when(F.col("_own") & ~F.col("_told"), F.col("clock_word"))
    rows = rows.withColumn("_opens", opened).withColumn("_n", F.sum("_counts").over(upto))
    rows = rows.withColumn("_clock", F.last("_opens", True).over(upto)).withColumn("_base", F.last(F.when(F.col("_opens").isNotNull(), F.col("_n") - F.col("_counts")), True).over(upto))

    tail = F.max(F.struct("entry_idx", "_clock", "_base", "_n", (overflow | (invalid & F.col("_told"))).alias("told"))).alias("s")
    ends = rows.groupBy("probe_id", "seq_num").agg(tail, F.max(_is("items_missed")).alias("missed"), F.max(F.when(F.col("_heads"), F.col("clock_word"))).alias("first"))
    self_clock = F.filter("frontier", lambda c: c["probe_id"] == F.col("probe_id"))
    start = F.when(F.size(self_clock) > 0, F.element_at(self_clock, 1)["epoch"].cast("long") * 65536 + F.element_at(self_clock, 1)["ticks"])
    # Reports without entries hold a place in the sequence.
    ends = reports.select("probe_id", "seq_num", start.alias("_start")).join(ends, ["probe_id", "seq_num"], "left")
    ends = ends.select("probe_id", "seq_num", "_start", F.coalesce("s._n", F.lit(0)).alias("_all"), F.col("s._clock").alias("_last"), (F.col("s._n") - F.col("s._base")).alias("_tail"), F.coalesce("missed", F.lit(False)).alias("missed"), F.coalesce("s.told", F.lit(False)).alias("told"), "first")
    # One row a report: each running value below reads it twice, and without this the windows over all entries as often.
    ends = written(ends, shared_path(ends.sparkSession, "ends"))
    ends = previous(ends, "probe_id", "seq_num", F.struct("seq_num", "told", "_last"), "_prior")
    adjoins = F.coalesce(F.col("_prior.seq_num"), F.lit(-1).cast("long")) == F.col("seq_num") - 1
    ends = ends.withColumn("_lost", ~adjoins | F.col("missed"))
    # An overflow at the end of the last report has announced the clock at the head of this one.
    goes_on = ~F.col("_lost") & F.coalesce(F.col("_prior.told") & (F.col("first") == F.col("_prior._last")), F.lit(False))
    ends = ends.withColumn("_goes_on", goes_on)
    only_that = F.col("_goes_on") & (F.col("_last") == F.col("first"))
    # What a report leaves open: events since its last clock, known or not; reports without a clock add to it.
    anchor = F.when(F.col("_last").isNotNull() & ~only_that, F.struct(F.col("seq_num").alias("seq"), F.lit(True).alias("known"), F.col("_tail").alias("n")))
    anchor = anchor.when(F.col("_lost"), F.struct(F.col("seq_num").alias("seq"), F.lit(False).alias("known"), F.lit(0).cast("long").alias("n")))
    ends = running(ends.withColumn("_anchor", anchor), "probe_id", "seq_num", F.col("_all"), "_upto").withColumn("_sum", F.col("_upto") - F.col("_all"))
    at = F.struct(F.col("_anchor.seq").alias("seq"), F.col("_anchor.known").alias("known"), F.col("_anchor.n").alias("n"), F.col("_upto").alias("sum"))
    ends = running(ends, "probe_id", "seq_num", F.when(F.col("_anchor").isNotNull(), at), "_latest", "max")
    ends = previous(ends, "probe_id", "seq_num", F.col("_latest"), "_open")
    carried = F.when(F.col("_open").isNull(), F.col("_sum")).when(F.col("_open.known"), F.col("_open.n") + F.col("_sum") - F.col("_open.sum"))
    ends = ends.withColumn("_carried", F.when(~F.col("_lost"), carried))
    placed = rows.join(ends.select("probe_id", "seq_num", "_start", "_carried", "_goes_on", "_prior", F.col("first").alias("_first")), ["probe_id", "seq_num"])
    still = F.col("_clock").isNull() | (F.col("_goes_on") & (F.col("_clock") == F.col("_first")))
    count = F.when(still, F.col("_carried") + F.col("_n")).otherwise(F.col("_n") - F.col("_base"))
    clock = F.coalesce("_clock", F.when(F.col("_carried").isNotNull() & F.col("_prior.told"), F.col("_prior._last")), "_start")
    return placed.select(*entries.columns, clock.alias("clock_at"), count.alias("event_count"), "meaning")


def distinct_events(rows: DataFrame) -> DataFrame:
    """timeline rows (with persistent_epoch) without what a restart repeats.

    Restarts that are not tracked start a probe's clocks again, so its events come as duplicates of (probe_id, clock_at,
    event_count, entry); where restarts are tracked, and where the count is unknown, every row stays.
    """
    again = ~F.col("persistent_epoch") & F.col("event_count").isNotNull()
    key = [c for c in ("probe_id", "clock_at", "event_count", "kind", "event_id", "payload_raw", "clock_probe_id", "clock_word") if c in rows.columns]
    return rows.where(again).dropDuplicates(key).unionByName(rows.where(~again))
