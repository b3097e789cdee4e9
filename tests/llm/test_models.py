"""Classifier, codec, language model, decontamination, PII, neighbours, archives and pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from causeway.llm import context_tree, decontamination, nn_descent, pii, queries, rule_ensemble, sentencepiece_codec, warc_store
from causeway.llm._common import Tables

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, score double, n long"
ODD = [(1, None, 0.0, 1), (2, "", 0.0, 1), (3, "  \t\n", 0.0, 1), (4, "a  b　 ﬁ é 😀\x00 end", 0.0, 1), (4, "twice", 0.0, 1), (None, "no id", 0.0, 1), (7, "long " * 30000, 0.0, 1)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def test_rules_of_a_forest_are_conjunctions():
    said = "Tree 0 (weight 1.0):\n    If (feature 0 <= 1.5)\n     If (feature 1 <= 2.0)\n      Predict: 0.0\n     Else (feature 1 > 2.0)\n      Predict: 1.0\n    Else (feature 0 > 1.5)\n     Predict: 1.0\n"
    rules = {r.bounds for r in rule_ensemble.rules_of(said, ("a", "b"))}
    inf = float("inf")
    assert rules == {(("a", -inf, 1.5),), (("a", -inf, 1.5), ("b", -inf, 2.0)), (("a", -inf, 1.5), ("b", 2.0, inf)), (("a", 1.5, inf),)}


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op1_rule_ensemble(spark, sf).toPandas()
    assert (rows.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in rows.doc_id]).all()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = rows[rows.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.9


def test_compiled_rules_equal_plain_evaluation(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    stats = rule_ensemble.with_statistics(docs)
    model = rule_ensemble.fit(stats.join(labels.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id").drop("doc_id"))
    assert any(len(rule.bounds) > 1 for _, rule in model.weighted)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in stats.select("*", model.score().alias("score")).collect():
        values = dict(zip(rule_ensemble.STATISTICS, rule_ensemble.statistics(texts[r.doc_id]), strict=True))
        total = model.intercept + sum(w for w, rule in model.weighted if all(low < values[k] <= high for k, low, high in rule.bounds))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)))


def test_statistics_of_a_text():
    got = dict(zip(rule_ensemble.STATISTICS, rule_ensemble.statistics(b"Ab ab ab 12!\nAb ab ab 12!"), strict=True))
    assert got["log_words"] == math.log1p(8) and got["word_bytes"] == 18 / 8 and got["upper_share"] == 2 / 12
    assert got["digit_share"] == 4 / 25 and got["distinct_words"] == 3 / 8 and got["top_word"] == 0.5 and got["same_as_last"] == 2 / 7 * 7 / 8
    assert got["distinct_lines"] == 0.5 and got["line_words"] == 4 and got["bang_share"] == 2 / 25


def test_classifier_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    rows = rule_ensemble.classify(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert rule_ensemble.classify(odd.limit(0), labels).collect() == []


def test_codec_equals_the_library(spark, odd):
    model = queries.piece_model()
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = sentencepiece_codec.encode(docs, model).collect()
    want = Counter()
    for d, t in docs.collect():
        ids = lib.encode(t or "")
        want[d, tuple(ids), lib.decode(ids)] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in rows) == want


def test_spans_cover_the_text():
    c = sentencepiece_codec.codec(queries.piece_model())
    for text in ("one two", " é😀x", "a" * 50, ""):
        raw = text.encode()
        ids, ends = c.encode(raw)
        assert len(ids) == len(ends) and list(ends) == sorted(ends)
        assert not raw or ends[-1] == len(raw)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_unigram_base_and_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", fold(t)), None]
    c = Counter(w for r in docs if not held(r.doc_id) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in queries.op7_context_tree(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        t, g = tokens(r.text), got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(r.doc_id), len(t), sum(w in c for w in t), n)
        assert g.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert g.score <= 0 and math.isfinite(g.score)


def test_model_beats_a_uniform_one_on_held_out_text(spark):
    rows = queries.op7_context_tree(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out and length(text) > 200").collect()
    bits = sum(-r.score for r in rows) * math.log2(10) / sum(len(r.text.encode()) for r in rows)
    assert bits < 4


def slow_mixture(corpus, text, depth):
    """log10 of the weighted chance of a text, by the recursion over whole trees before and after each bit."""
    seen, children = Counter(), {}
    context = lambda t, i: tuple(t[i - k] if i >= k else 0 for k in range(1, depth + 1))
    bits = lambda b: [(b >> (8 - j) if j else 0, j, b >> (7 - j) & 1) for j in range(8)]
    for t in corpus:
        for i, b in enumerate(t):
            ctx = context(t, i)
            for prefix, j, bit in bits(b):
                for d in range(depth + 1):
                    seen[ctx[:d], prefix, j, bit] += 1
                    if d < depth:
                        children.setdefault((ctx[:d], prefix, j), set()).add(ctx[d])

    def kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    def weight(ctx, prefix, j, path=(), bit=None):
        on = bit is not None and path[: len(ctx)] == ctx
        own = kt(*(seen[ctx, prefix, j, x] + (on and bit == x) for x in (0, 1)))
        if len(ctx) == depth:
            return own
        below = children.get((ctx, prefix, j), set()) | ({path[len(ctx)]} if on else set())
        rest = sum(weight((*ctx, c), prefix, j, path, bit) for c in below)
        top = max(own, rest)
        return top + math.log(math.exp(own - top) + math.exp(rest - top)) - math.log(2)

    total = 0.0
    for i, b in enumerate(text):
        for prefix, j, bit in bits(b):
            total += weight((), prefix, j, context(text, i), bit) - weight((), prefix, j)
    return total / math.log(10)


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_mixture_equals_the_recursion(spark, depth):
    rng = random.Random(depth)
    docs = [(i, "".join(rng.choice("aab bé\n") for _ in range(rng.randrange(30)))) for i in range(40)]
    docs[3] = (3, "never seen: zq")
    held = {d for d, _ in docs if zlib.crc32(str(d).encode()) % 7 == 2}
    corpus = [t.encode() for d, t in docs if d not in held]
    got = {r.doc_id: r.score for r in context_tree.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), depth).collect()}
    for d, t in docs:
        assert got[d] == pytest.approx(slow_mixture(corpus, t.encode(), depth), rel=1e-5, abs=1e-5)
    assert held and any(got[d] for d in held)


def test_a_deeper_model_needs_fewer_bits(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = {r.doc_id: len((r.text or "").encode()) for r in docs.collect()}
    bits = []
    for depth in (2, 5):
        rows = context_tree.score(docs, depth).where("held_out").collect()
        bits.append(sum(-r.score for r in rows) * math.log2(10) / sum(size[r.doc_id] for r in rows))
    assert bits[1] < bits[0] < 4


def test_stretches_cut_texts_anywhere_alike():
    texts = [b"", b"abcdefghij" * 7, b"x", b"0123456789" * 3]
    for size in (1, 7, 1000):
        got = {i: [] for i in range(4)}
        for held, grams in context_tree.stretches(texts, 3, size):
            at = 0
            for i, n in held:
                got[i] += grams[at : at + n].tolist()
                at += n
        for i, t in enumerate(texts):
            padded = bytes(3) + t
            assert got[i] == [padded[k + 2] << 24 | padded[k + 1] << 16 | padded[k] << 8 | padded[k + 3] for k in range(len(t))]


def test_language_model_of_odd_rows(spark, odd):
    rows = context_tree.score(odd).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert context_tree.score(odd.limit(0)).collect() == []


def edits(a, b):
    """Least edits of a within b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"v{i}" for i in range(3000)]
    items = [(i, [rng.choice(words) for _ in range(rng.choice((4, 12, 25, 60)))]) for i in range(25)]
    docs = []
    for d in range(120):
        text = [rng.choice(words) for _ in range(rng.randrange(80))]
        if d % 2:
            part = list(rng.choice(items)[1])
            for _ in range(rng.randrange(0, max(1, len(part) // 4))):
                at = rng.randrange(len(part))
                part[at : at + 1] = rng.choice(([], [rng.choice(words)], [part[at], "extra"]))
            text[len(text) // 2 : len(text) // 2] = part
        docs.append((d, " ".join(text).upper(), 0.0, 1))
    bench = spark.createDataFrame([*((i, " ".join(w) + "?") for i, w in items), (90, None), (91, "!")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.edits for r in decontamination.contaminated(spark.createDataFrame(docs + ODD[:3], DOCS), bench).collect()}
    want = {}
    for d, text, *_ in docs:
        for i, w in items:
            if (e := edits(w, text.lower().split())) <= decontamination.allowed(len(w)):
                want[d, i] = e
    assert set(found) <= set(want) and all(found[k] >= want[k] for k in found)
    assert len(found) >= 0.97 * len(want)
    assert all(k in found for k, e in want.items() if e == 0)


def test_decontamination_names_the_stretch(spark):
    item = [f"i{k}" for k in range(20)]
    edited = [*item[:5], "new", "newer", *item[5:12], *item[13:]]
    docs = [(1, " ".join(["a", "b", *item, "c"])), (2, " ".join(["x"] * 7 + edited + ["y"] * 9)), (3, "word " * 60_000 + " ".join(item)), (None, " ".join(item)), (1, "clean"), (4, "clean")]
    bench = spark.createDataFrame([(5, " ".join(item)), (6, " ".join(item))], "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.begin_word, r.end_word, r.edits) for r in decontamination.contaminated(rows, bench).collect()}
    assert got == {(d, i, a, b, e) for i in (5, 6) for d, a, b, e in ((1, 2, 22, 0), (2, 7, 28, 3), (3, 60_000, 60_020, 0), (None, 0, 20, 0))}
    assert sorted((r.doc_id or 0) for r in decontamination.keep_clean(rows, bench).collect()) == [0, 4]


def test_stages_keep_rows_without_a_doc_id(spark):
    docs = spark.createDataFrame([(None, "spam !!! ||| $$$", "l", "s", 3), (1, "fine words stand here, quite plainly.", "l", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rule_ensemble.keep_good(docs, labels).columns == docs.columns
    for keep in (lambda d: rule_ensemble.keep_good(d, labels), lambda d: decontamination.keep_clean(d, spark.createDataFrame([(1, "spam")], "item_id long, text string"))):
        assert None in {r.doc_id for r in keep(docs).collect()}


def test_decontamination_of_nothing(spark, odd):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(odd, bench).collect() == []
    assert decontamination.keep_clean(odd, bench).count() == len(ODD)


def slow_pii(text):
    t, out = text or "", []
    luhn = lambda d: sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    for kind, pattern, ok in kinds:
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, t) if ok(m[0])]
    return out


def test_pii_base_equals_the_patterns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op5_pii(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        want, g = slow_pii(r.text), got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
        assert g.spans.split(",")[: len(want)] == want or not want


def test_pii_of_odd_texts(spark, odd):
    more = ["😀 a@b.co, 1.2.3.4.5 and 999.1.1.1 4111 1111 1111 1111 +44 (0)20 7946-0958", "x@y.z@q.r 0001.2.3.4 +1-2", "4111-1111-1111-1112 12345678901234567890"]
    rows = pii.find(odd.unionByName(spark.createDataFrame([(50 + i, t, 0.0, 1) for i, t in enumerate(more)], DOCS))).collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.base] == slow_pii(r.text)
    assert pii.find(odd.limit(0)).collect() == []


def test_pii_terms_that_give_an_entity_away_are_removed(spark):
    docs = [(i, f"mail bob@home.org of agent Zarquon today\nother words w{i}", 0.0, 1) for i in range(4)] + [(10 + i, f"mail today of agent number w{i}", 0.0, 1) for i in range(40)]
    found = pii.find(spark.createDataFrame(docs, DOCS))
    assert {s.value for r in found.collect() for s in r.added} == {"Zarquon"}
    clean = {r.doc_id: r.text for r in pii.sanitise(found).collect()}
    assert clean[0] == "mail [EMAIL] of agent  today\nother words w0" and clean[11] == docs[5][1]


def test_neighbours_recall_and_distances(spark):
    rows = queries.op8_nn_descent(spark, SF).collect()
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None and len(r.embedding)}
    ids = np.array([i for i, v in sorted(vectors.items()) if np.isfinite(v).all() and v.any()])
    x = np.stack([vectors[i] for i in ids])
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - vectors[q]) ** 2).sum(1))
        order = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(order) + 1))
        for r in mine:
            assert r.score == pytest.approx(d[np.flatnonzero(ids == r.vec_id)[0]], abs=1e-12)
        hits += len(set(order) & {r.vec_id for r in mine})
        total += len(order)
    assert hits >= 0.9 * total


def test_neighbours_of_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, 0.0]), (6, [1.0, None]), (None, [1.0, 1.0]), (7, [0.0, 1.0])]
    out = nn_descent.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in out] == [(0, 5), (0, 1), (0, 7)] and out[0].score == 0
    assert nn_descent.neighbours(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


def test_archives_round_trip(spark):
    big = "<p>" + "x" * 2000
    pages = [(1, "http://a", big, 0), (5, "http://b", big, 0), (3, None, big, 0), (4, "u", None, 0), (6, "u u", "small", 0), (7, "u", "small", 0), (None, "u", "é", 0)]
    tables = Tables(spark, "w")
    manifest = tables.put(warc_store.write(spark.createDataFrame(pages, "page_id long, url string, html string, n int").repartition(2), f"{tables.root}/a"))
    rows = {r.page_id: r for r in warc_store.read(manifest).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in rows.items()} == {1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), 4: ("response", None), 6: ("response", None), 7: ("response", None), None: ("response", None)}
    assert bytes(rows[5].payload).decode() == big and rows[1].payload_digest == hashlib.sha1(big.encode()).hexdigest() and rows[None].payload_bytes == 2
    path = manifest.first().path.removeprefix("file:")
    with open(path, "rb") as f:
        assert int.from_bytes(f.read(4), "little") == warc_store.DICTIONARY_MAGIC


def test_archives_of_no_pages_and_of_long_ones(spark):
    schema = "page_id long, url string, html string, n int"
    for pages in ([], [(1, None, None, 0), (2, "u", "é" * 3_000_000, 0), (3, "v", "é" * 3_000_000, 0), (3, "v", "é" * 3_000_000, 0)]):
        tables = Tables(spark, "w")
        manifest = tables.put(warc_store.write(spark.createDataFrame(pages, schema), f"{tables.root}/a"))
        rows = warc_store.read(manifest).collect()
        assert sorted((r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in rows) == ([] if not pages else [(1, "response", 0, None), (2, "revisit", 6_000_000, 3), (3, "response", 6_000_000, None), (3, "response", 6_000_000, None)])


def test_pipeline_keeps_clean_documents(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "ends"]
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.count() <= docs.count()
        docs = after
