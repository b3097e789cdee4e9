"""The pipeline against one made of plain Python, and on odd tables."""

import re
from collections import Counter, defaultdict

import pytest
import sentencepiece

import corpus_pipeline
from causeway.llm import decontamination, queries, rule_ensemble
from tests.llm.test_dedup import WHITE
from tests.llm.test_near_copies import exact_groups

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def first_runs(docs):
    """Texts without later copies of line runs, and without documents of which nothing is left."""
    lines = {d: [(i, x.strip(WHITE)) for i, x in enumerate(t.split("\n")) if x.strip(WHITE)] for d, t in docs}
    seen, out = defaultdict(list), []
    for d, text in docs:
        own, gone = lines[d], set()
        for p in range(len(own)):
            k = 0
            for e, q in seen[own[p][1]]:
                n = 0
                while p + n < len(own) and q + n < len(lines[e]) and own[p + n][1] == lines[e][q + n][1]:
                    n += 1
                k = max(k, n)
            gone.update(range(p, p + k))
            seen[own[p][1]].append((d, p))
        cut, begin = set(), None
        for p in range(len(own) + 1):
            if p in gone:
                begin = p if begin is None else begin
            elif begin is not None:
                cut.update(range(own[begin][0], own[p - 1][0] + 1))
                begin = None
        left = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in cut)
        if not gone or left.strip(WHITE):
            out.append((d, left))
    return out


def holds(words, item):
    need = len(item) - decontamination.allowed(len(item))
    if sum((Counter(words) & Counter(item)).values()) < need:
        return False
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row) <= decontamination.allowed(len(item))


def test_pipeline_equals_plain_python(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in rule_ensemble.classify(docs, labels).where("predicted = 1").collect()}
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect() if r.doc_id in good)
    rows = first_runs(rows)
    group = exact_groups(rows)
    rows = [(d, t) for d, t in rows if group[d] == d]
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub(r"[!-/:-@\[-`{-~]", "", re.sub("[A-Z]", lambda m: m[0].lower(), t))) if w]
    items = [w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := split(r.text or ""))]
    rows = [(d, t) for d, t in rows if not any(holds(split(t), w) for w in items)]
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d: library.encode(t) for d, t in rows} and len(got) > 50


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_of_odd_tables(spark, tmp_path, empty):
    same = " ".join(f"w{i}" for i in range(60))
    odd = [(None, None, None, None, None), (None, "no id, but words stand here.", "en", "a", 1), (1, same, "en", "a", 1), (1, same, "en", "a", 1), (2, "", "en", "a", 0), (3, same + " more", "en", "a", 1), (4, "x " * 50_000, None, None, 1)]
    spark.createDataFrame([] if empty else odd, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "ids", "ends"]
    # Nothing is rejected without labels; of copies the smallest doc_id stays once, rows without one stay.
    assert sorted((r.doc_id or 0) for r in out.collect()) == ([] if empty else [0, 0, 1, 2, 4])


def test_what_operators_write_is_dropped(spark):
    from causeway.llm._common import Tables, scratch

    kept = Tables(spark, "kept")
    docs = kept.put(spark.createDataFrame([(1, "a line\nb"), (2, "a line\nc")], "doc_id long, text string"))
    with scratch():
        inner = Tables(spark, "inner")
        table = inner.put(docs)
        out = kept.put(table)
    assert out.count() == docs.count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(table._table_path).count()
