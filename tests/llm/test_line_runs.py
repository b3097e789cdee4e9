"""Short repeated runs and lines whose words are not parted by spaces."""

from causeway.llm import line_dedup


def cut(spark, texts, *least):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in line_dedup.remove_repeats(docs, *least).orderBy("doc_id").collect()]


def test_short_runs_go_too(spark):
    assert cut(spark, ["Share this page\nfirst", "second\nShare this page", "Share this page\nthird\nfirst"]) == ["Share this page\nfirst", "second", "third"]


def test_words_are_parted_by_any_white_space(spark):
    row = "\t".join("abcdefghij")
    assert cut(spark, [row, f"{row}\nown", "x y\nx y"], 10) == [row, "own", "x y\nx y"]


def test_wide_gaps_are_no_words_and_white_lines_are_blank(spark):
    gap = "x" + " " * 12 + "y"
    assert cut(spark, [gap, gap, "\t\r\nz"], 10) == [gap, gap, "\t\r\nz"]
    assert cut(spark, ["a\n\t", "b\n\t", " a\t\r\nc"]) == ["a\n\t", "b\n\t", "c"]


def test_extra_columns_may_have_any_name(spark):
    rows = [(i, 7, f"c{i}", "dot", 1, "same line") for i in range(3)]
    docs = spark.createDataFrame(rows, ["doc_id", "n_removed", "cuts", "a.b", "_way", "text"])
    out = line_dedup.remove_repeats(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(0, "c0", "dot", 1, "same line", 0), (1, "c1", "dot", 1, "", 1), (2, "c2", "dot", 1, "", 1)]
    kept = line_dedup.keep_first_runs(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [rows[0]]


def test_a_line_of_most_documents_is_dealt_over_tasks(spark):
    docs = spark.range(9000).selectExpr("id AS doc_id", "concat('own ', id, '\nvery common', if(id % 3 = 0, '\nmore', '')) AS text")
    out = line_dedup.remove_repeats(docs).groupBy("n_removed").count().collect()
    assert {(r.n_removed, r["count"]) for r in out} == {(0, 1), (1, 6000), (2, 2999)}


def test_a_long_text_with_very_many_cuts_takes_linear_time(spark):
    import time

    n = 100_000
    text = "\n".join(f"again and again\nnew line {i}" for i in range(n))
    docs = spark.createDataFrame([(1, "again and again"), (2, text)], "doc_id long, text string")
    start = time.monotonic()
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.remove_repeats(docs).collect()}
    assert time.monotonic() - start < 120
    assert got == {1: ("again and again", 0), 2: ("\n".join(f"new line {i}" for i in range(n)), n)}
    kept = {r.doc_id: r.text for r in line_dedup.keep_first_runs(docs).collect()}
    assert kept[2] == got[2][0]
