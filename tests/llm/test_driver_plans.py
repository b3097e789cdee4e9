"""What operators of many small steps leave on the driver."""

from __future__ import annotations

from causeway.llm import _common, line_dedup


def test_few_rows_are_not_dealt(spark, monkeypatch):
    rows = spark.createDataFrame([(d, p, d % 2 * p % 3, p % 2) for d in range(6) for p in range(20)], "doc_id long, pos int, a long, b long")
    few = line_dedup._intervals(rows, ["a", "b"], 120)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "broadcast" not in plan
    monkeypatch.setattr(line_dedup, "FEW", 119)
    dealt = line_dedup._intervals(rows, ["a", "b"], 120)
    assert "Generate" in dealt._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(few.collect()) == sorted(dealt.collect())


def test_repeats_are_the_same_dealt_or_not(spark, monkeypatch):
    texts = ["a\nb\nc\nd\ne", "x\nb\nc\nd\ny", "c\nd\ne\na\nb\nc\nd", "a\na\na\na", "a\nb\nc\nd\ne"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    few = sorted(line_dedup.remove_repeats(docs).collect())
    monkeypatch.setattr(line_dedup, "FEW", 0)
    assert sorted(line_dedup.remove_repeats(docs).collect()) == few


def test_driver_collects_as_tables_are_written(spark):
    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    before, tables = collections(), _common.Tables(spark, "collects")
    for _ in range(_common.COLLECT):
        tables.put(spark.range(1))
    tables.clear()
    assert collections() > before
