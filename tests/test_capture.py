"""Many reports a file: read in splits, as a stream while files grow, and written once in spite of failures."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from causeway.sources import capture, wire


def report(probe, seq, words, clocks=()):
    head = wire.FINGERPRINT.to_bytes(4, "little") + probe.to_bytes(4, "little") + (1).to_bytes(4, "little") + seq.to_bytes(8, "little")
    head += bytes(7) + len(clocks).to_bytes(2, "little") + len(words).to_bytes(4, "little")
    return head + b"".join(c.to_bytes(8, "little") for c in clocks) + b"".join(w.to_bytes(4, "little") for w in words)


def some(rnd, n):
    # Payloads bear fingerprints and whole headers of reports.
    fake = [wire.FINGERPRINT, 3, 1, 1, 0, 0, 0, 0, 0]
    return [report(rnd.randrange(1, 5), i, fake * rnd.randrange(3) + [rnd.randrange(1 << 32) for _ in range(rnd.randrange(9))], [7] * rnd.randrange(3)) for i in range(n)]


def rows(df):
    return sorted((r.offset, bytes(r.content)) for r in df.collect())


def one_by_one(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, p))
        at += len(p)
    return out


@pytest.mark.parametrize("split", [50, 333, 1 << 20])
def test_a_file_of_many_reports_is_read_in_several_tasks(spark, tmp_path, split):
    reports = some(random.Random(split), 120)
    (tmp_path / "a.bin").write_bytes(b"".join(reports))
    df = capture.read_capture(spark, str(tmp_path), split_bytes=split)
    assert rows(df) == one_by_one(reports)
    size = sum(map(len, reports))
    assert df.rdd.getNumPartitions() == -(-size // split)
    mine = capture.read_capture(spark, str(tmp_path / "a.bin"), split_bytes=split).where("probe_id = 2")
    assert rows(mine) == [r for r in one_by_one(reports) if r[1][4] == 2]
    two = capture.read_capture(spark, str(tmp_path), split_bytes=split).where("probe_id in (1, 3) and offset > 100")
    assert rows(two) == [r for r in one_by_one(reports) if r[1][4] in (1, 3) and r[0] > 100]


@pytest.mark.parametrize("split", [61, 1 << 20])
def test_damage_is_told_and_the_rest_is_read(spark, tmp_path, split):
    rnd = random.Random(9)
    good = some(rnd, 60)
    parts = [*good[:20], b"junk" + bytes(90) + wire.FINGERPRINT.to_bytes(4, "little"), *good[20:40], b"\x01" * 3, *good[40:], good[0][:-1] if len(good[0]) > 33 else good[0][:20]]
    (tmp_path / "a.bin").write_bytes(b"".join(parts))
    (tmp_path / "empty.bin").write_bytes(b"")
    got = capture.read_capture(spark, str(tmp_path), split_bytes=split).collect()
    assert sorted((r.offset, bytes(r.content)) for r in got) == one_by_one(parts)
    assert sum(r.probe_id is None for r in got) == 3
    told = capture.decoded(capture.read_capture(spark, str(tmp_path), split_bytes=split)).groupBy("error").count().collect()
    assert {r.error: r["count"] for r in told}[None] == 60
    assert capture.read_capture(spark, str(tmp_path / "empty.bin")).count() == 0


def test_a_growing_file_is_streamed_up_to_its_last_whole_report(spark, tmp_path):
    rnd = random.Random(3)
    reports = some(rnd, 90)
    raw = b"".join(reports)
    (tmp_path / "in").mkdir()
    got = []

    def run():
        stream = capture.stream_capture(spark, str(tmp_path / "in"), split_bytes=200)
        stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.path[-1], r.offset, bytes(r.content)) for r in got)

    for cut in (len(raw) // 3 + 5, len(raw) // 3 + 9, len(raw)):
        (tmp_path / "in" / "a").write_bytes(raw[:cut])
        if cut == len(raw):
            (tmp_path / "in" / "b").write_bytes(reports[0] + reports[1])
        whole = [("a", at, p) for at, p in one_by_one(reports) if at + len(p) <= cut]
        assert run() == whole + ([("b", at, p) for at, p in one_by_one(reports[:2])] if cut == len(raw) else [])


def test_a_failed_task_and_a_replayed_batch_leave_each_report_once(spark, tmp_path):
    reports = some(random.Random(4), 80)
    at, out = str(tmp_path / "out"), str(tmp_path / "streamed")
    frame = spark.createDataFrame([(r,) for r in [*reports, *reports[:7]]], "content binary").repartition(4)
    capture.write_capture(frame, at)
    keys = {(r[4], r[12]) for r in reports}
    assert len(capture.read_capture(spark, at, committed=True).collect()) == len(keys)
    # An attempt that failed after it had written: its file is there, but no manifest lists it.
    lost = capture.CaptureWriter(at)

    def broken(rows):
        for i, r in enumerate(rows):
            if i == 3:
                raise ValueError("lost")
            yield r

    def attempt(part):
        try:
            lost.write(broken(part))
        except ValueError:
            pass
        return iter(())

    frame.rdd.mapPartitions(attempt).count()
    assert len(list(Path(at).glob("reports-*"))) > 4
    assert rows(capture.read_capture(spark, at, committed=True).where("probe_id > 0").withColumn("offset", F.lit(0))) == sorted((0, r) for r in {(r[4], r[12]): r for r in reports}.values())
    # A batch that is committed again changes nothing.
    sink = capture.CaptureStreamWriter(out)
    named = [capture.Written(m) for m in ("x", "y")]
    sink.commit(named, 7)
    capture.CaptureStreamWriter(out).commit([capture.Written("z")], 7)
    assert [p.read_text() for p in Path(out).glob("_manifests/*.json")] == ['["x", "y"]']


def test_stream_to_stream(spark, tmp_path):
    reports = some(random.Random(5), 40)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"".join(reports))
    for _ in range(2):
        stream = capture.stream_capture(spark, str(tmp_path / "in")).select("content")
        stream.writeStream.format(capture.NAME).option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = capture.read_capture(spark, str(tmp_path / "out"), committed=True).collect()
    assert sorted(bytes(r.content) for r in got) == sorted(reports)
