"""The decoded timeline reads its entries once for the rows, not again for each running value over reports."""

from causeway.operators import decoded
from causeway.operators.entries import FIELDS


def test_the_ends_of_reports_are_made_once(spark):
    reports = spark.createDataFrame([(1, 0, [(1, 0, 3)])], "probe_id long, seq_num long, frontier array<struct<probe_id: long, epoch: int, ticks: int>>")
    entries = spark.createDataFrame([(1, 0, 0, 0, 1, "event", 5, None, None, None, None)], f"probe_id long, seq_num long, entry_idx int, word_off int, {FIELDS}")
    rows = decoded.timeline(reports, entries)
    leaves = [line for line in rows._jdf.queryExecution().analyzed().toString().splitlines() if "entry_idx" in line and ("LogicalRDD" in line or "LocalRelation" in line)]
    assert len(leaves) == 1
    assert [(r.clock_at, r.event_count) for r in rows.collect()] == [(3, 1)]
