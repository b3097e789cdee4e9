"""Rounds join in one way at every size, as long as no line or interval has many rows."""

from causeway.llm import line_dedup
from causeway.llm._common import Tables


def joins(spark, monkeypatch, copies, few):
    """Whether the rounds' joins deal their rows, and the prefixes found."""
    real, dealt = line_dedup.split_join, []

    def spy(left, right, keys, n, total, deal, few=None):
        if few is None:
            return real(left, right, keys, n, total, deal)
        dealt.append(total > few)
        return real(left, right, keys, n, total, deal, few)

    monkeypatch.setattr(line_dedup, "split_join", spy)
    monkeypatch.setattr(line_dedup, "FEW", few)
    texts = [f"a{c}\nb{c}\nc{c}\nd{c}{x}" for c in range(copies) for x in ("", "", "x")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tables = Tables(spark, "same")
    state, _ = line_dedup.repeated_prefixes(tables.put(line_dedup.lines(docs)), tables)
    monkeypatch.setattr(line_dedup, "split_join", real)
    return dealt, sorted((r.doc_id, r.pos, r.size) for r in state.collect())


def test_five_times_the_rows_join_in_the_same_way(spark, monkeypatch):
    small, _ = joins(spark, monkeypatch, 2, 24)
    large, found = joins(spark, monkeypatch, 10, 24)
    assert small == large and not any(large)
    # A line of more rows than one task should join is still dealt, with the same result.
    every, same = joins(spark, monkeypatch, 10, 2)
    assert every[0] and same == found and len(found) == 10 * (4 + 3)
