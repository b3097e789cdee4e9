"""What reads and writes reports does so once, however often fields are mentioned."""

import pytest
from pyspark.sql import functions as F

from causeway.plans import queries
from causeway.sources import capture, wire

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["report_frontier", "report_gap", "report_header"])
def test_bytes_are_made_once(spark, name):
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("collect_list") <= 4 and len(plan) < 200_000
    assert plan.count("_report(") == 1


def test_words_and_numbers_that_are_missing(spark):
    rows = spark.sql("select * from values (1, 1L, array(1L, 2L)), (2, null, array(1L)), (3, 1L, array(1L, null)), (4, -1L, array()), (5, 1L << 62, array(4294967295L)) as t(k, seq, log)")
    clocks = F.array(F.struct(F.lit(7).alias("probe_id"), F.lit(3).alias("epoch"), F.lit(9).alias("ticks")))
    made = rows.select("k", wire.encoded_report({"probe_id": F.lit(7), "seq_num": F.col("seq")}, clocks, F.col("log").cast("array<long>")).alias("content"))
    got = {r.k: r for r in wire.with_payload(wire.with_header(made)).collect()}
    assert [got[k].error for k in range(1, 6)] == [None, "MissingHeader", "MissingHeader", None, None]
    assert [got[k].seq_num for k in (1, 4, 5)] == [1, None, 1 << 62]
    assert got[1].words == [1, 2] and got[4].words == [] and got[5].words == [(1 << 32) - 1] and got[2].words is None
    assert [tuple(c) for c in got[1].frontier] == [(7, 3, 9)] and got[2].frontier is None


def test_short_splits_read_a_file_about_once(tmp_path):
    report = wire.FINGERPRINT.to_bytes(4, "little") + bytes(29)
    (tmp_path / "f").write_bytes(report * 20_000)
    read = []

    class File:
        def read_at(self, n, at):
            read.append(n)
            return (report * 20_000)[at : at + n]

    size, each = len(report) * 20_000, 1 << 14
    window = min(max(each, capture.LEAST), capture.WINDOW)
    found = [at for start in range(0, size, each) for at, _, _ in capture.Bytes(File(), size, window).rows(start, min(start + each, size), None, start == 0)]
    assert found == list(range(0, size, len(report))) and sum(read) < 6 * size
