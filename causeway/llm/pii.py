r"""Personal data: fixed kinds by pattern, and terms that give protected values away, in DataFrame operations only.

Base kinds are e-mail addresses, IP addresses, card numbers and phone numbers. Their values are the protected entities.
A term discloses an entity by their pointwise mutual information as a share of the entity's information content:

    disclosure(e, t) = log(p(e | t) / p(e)) / -log p(e),   p(e | t) = (n_et + PRIOR p(e)) / (n_t + PRIOR)

with n_e, n_t and n_et of N documents that hold the entity, the term, and both, p(e) = n_e / N. The estimate is drawn
towards independence by PRIOR documents, so that a value of one document is estimated like any other and a term needs
more than its own rarity the fewer documents there are. Terms that stand on a line with the entity, found there as a value,
somewhere and reach DISCLOSURE are spans of kind term in every document that holds them, with the entity or without. All counts are over
all documents. `sanitise` generalises base values to their kind and removes terms.

Places are code points. A pattern's matches and the text between them give the places: lengths add up. Patterns start
only where no character of their first class stands before, or right behind the last match, so that a search looks at
each character a bounded number of times; running sums and maxima go by blocks, and told terms meet a text's words in one
sorted array where there are many, so that time follows the text.

Nulls and odd rows: a null text counts as empty; a null doc_id is searched for base kinds and lends its counts, but takes
no terms; rows count each as a document, those that repeat a doc_id too, and take each other's terms; extra columns are
ignored; no documents, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm._common import Tables, split_join

PRIOR, DISCLOSURE = 1.0, 0.8
#: Told terms go to all tasks while they are no more than this; beyond, they meet documents in a shuffled join.
BROADCAST_BYTES = 8 << 20
#: Terms of a document that one pattern looks for; more are sorted among its words.
FEW = 24
KINDS = ("email", "ip", "card", "phone")
# Fixed patterns of the base kinds, with possessive repeats where what follows cannot match inside them. A start within a
# run of the first class fails where the run's own start fails, and is tried right behind a match only.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that any match implies; most texts are not searched further.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
_SPANS = "array<struct<start:int,end:int,value:string>>"


#: Items of an array that are folded at once; running values of long arrays go by blocks of them.
BLOCK = 128
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _prefixes(values: Column, fold) -> Column:
    """The folds of every prefix of an array that is not empty, by appending."""
    add = lambda out, x: F.concat(out, F.array(fold(F.element_at(out, -1), x)))
    return F.aggregate(F.slice(values, 2, F.size(values)), F.slice(values, 1, 1), add)


def running(values: Column, fold) -> Column:
    """The folds of every prefix of an array: within blocks, and over the blocks' last ones."""

    def blocks(v):
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        return F.transform(starts, lambda i: _prefixes(F.slice(v, i * BLOCK + 1, F.lit(BLOCK)), fold))

    def joined(b):
        before = _prefixes(F.transform(b, lambda x: F.element_at(x, -1)), fold)
        rest = F.zip_with(F.slice(b, 2, F.size(b)), F.slice(before, F.lit(1), F.size(b) - 1), lambda x, o: F.transform(x, lambda y: fold(o, y)))
        return F.flatten(F.concat(F.slice(b, 1, 1), rest))

    return let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(let(blocks(v), joined)))


def matches(text: Column, pattern: Column) -> Column:
    """Leftmost matches that do not overlap, as spans (start, end, value)."""

    def spans(values):
        steps = F.zip_with(F.split(text, pattern, -1), values, lambda g, v: F.length(g) + F.length(v))  # null behind the last match
        ends = running(F.slice(steps, F.lit(1), F.size(values)), lambda a, x: a + x)
        return F.zip_with(ends, values, lambda e, v: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), spans)


def _marked(rows: Column, mark, keep) -> Column:
    """The (start, end, value) of sorted rows for which keep(row, the greatest mark up to it) holds."""

    def kept(r):
        latest = running(F.transform(r, mark), lambda a, x: F.greatest(a, x))
        both = F.zip_with(r, latest, lambda x, m: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), keep(x, m).alias("ok")))
        return F.transform(F.filter(both, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    return let(F.array_sort(rows), kept)


def _row(value, is_mark: bool, start, end) -> Column:
    return F.struct(value.alias("value"), F.lit(0 if is_mark else 1).alias("order"), start.alias("start"), end.alias("end"))


def told_spans(text: Column, terms: Column) -> Column:
    """Spans of the words that are among the terms: sorted together, a word is told if the last term before it is the word."""
    none = F.lit(0)
    words = F.transform(matches(text, F.lit(WORD)), lambda w: _row(w["value"], False, w["start"], w["end"]))
    rows = F.concat(words, F.transform(terms, lambda t: _row(t, True, none, none)))
    found = _marked(rows, lambda r: F.when(r["order"] == 0, r["value"]), lambda r, m: (r["order"] == 1) & (r["value"] == F.coalesce(m, F.lit(""))))
    return F.array_sort(found)


def few_spans(text: Column, terms: Column) -> Column:
    """`told_spans` by one pattern, whose time is the text's length times the number of terms."""
    quoted = F.transform(terms, lambda t: F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.concat(F.lit(r"(?<![^\x20\x09-\x0D])(?:"), F.array_join(quoted, "|"), F.lit(r")(?![^\x20\x09-\x0D])"))
    return matches(text, pattern)


def clear_of(spans: Column, base: Column) -> Column:
    """Spans, disjoint and sorted, that overlap no base span: of those that begin before a span's end, none ends after its start."""
    mine = F.transform(spans, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    other = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("order"), b["start"].alias("start"), b["end"].alias("end"), b["value"].alias("value")))
    return _marked(F.concat(mine, other), lambda r: F.when(r["order"] == 1, r["end"]), lambda r, m: (r["order"] == 0) & (F.coalesce(m, F.lit(0)) <= r["start"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(value, r"\."), lambda p: ~p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _keeps(kind: str):
    return lambda s: _valid(kind, s["value"])


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(kind).alias("kind")))


def base_spans(text: Column) -> Column:
    """array of (start, end, value, kind) by kind as listed, then start."""
    parts = []
    for kind in KINDS:
        hint = text.contains(HINTS[kind]) if kind == "email" else text.rlike(HINTS[kind])
        found = F.when(hint, matches(text, F.lit(PATTERNS[kind]))).otherwise(F.array().cast(_SPANS))
        parts.append(_named(kind, F.filter(found, _keeps(kind))))
    return F.concat(*parts)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _read_once(docs: DataFrame, tables: Tables) -> DataFrame:
    """(rid, doc_id, words, told): of every row its distinct words, and of each line with values those and the line's words.

    No base kind reaches across lines, so the lines' values are the text's.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    values = lambda line: F.array_distinct(F.transform(base_spans(line), lambda s: s["value"]))
    named = lambda line: let(values(line), lambda v: F.struct(v.alias("values"), F.when(F.size(v) > 0, F.array_distinct(_words(line))).alias("words")))
    told = F.filter(F.transform(F.split(F.col("text"), "\n"), named), lambda x: F.size(x["values"]) > 0)
    hint = F.col("text").rlike("|".join(HINTS.values()))
    none = F.array().cast("array<struct<values:array<string>,words:array<string>>>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return tables.put(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.array_distinct(_words(F.col("text"))).alias("words"), F.when(hint, told).otherwise(none).alias("told")))


def _together(read: DataFrame, held: DataFrame, beside: DataFrame, tables: Tables) -> DataFrame:
    """(entity, term, n_et) of the pairs beside: in how many rows both stand.

    held: (rid, entity, size), size being the row's number of words. A row's entity meets either the terms beside it anywhere
    or the row's words, whichever are fewer; so a list of very many values costs what stands on their lines.
    """
    candidates = beside.groupBy("entity").agg(F.count("*").alias("k"), F.collect_list("term").alias("terms"))
    sizes = held.groupBy("entity").agg(F.count("*").alias("m"))
    total = held.count()
    known = split_join(held, candidates.select("entity", "k").join(sizes, "entity"), ["entity"], "m", total, ["rid"])
    known = tables.put(known)
    few, many = known.where("k <= size"), known.where("k > size")
    words = read.where(F.size("told") > 0).select("rid", "words")
    by_entity = split_join(few, candidates.select("entity", "terms").join(few.groupBy("entity").agg(F.count("*").alias("m")), "entity"), ["entity"], "m", total, ["rid"])
    by_entity = by_entity.select("rid", "entity", F.explode("terms").alias("term")).join(words.select("rid", F.explode("words").alias("term")), ["rid", "term"]).select("entity", "term")
    by_row = split_join(many, words.join(many.groupBy("rid").agg(F.count("*").alias("m")), "rid"), ["rid"], "m", total, ["entity"])
    by_row = by_row.select("entity", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n")).join(beside, ["entity", "term"])
    counted = by_entity.groupBy("entity", "term").agg(F.count("*").alias("n"))
    return counted.unionByName(by_row).groupBy("entity", "term").agg(F.sum("n").alias("n_et"))


def disclosing_terms(docs: DataFrame, tables: Tables, prior: float = PRIOR, least: float = DISCLOSURE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, terms): the terms to take out of each document."""
    read = _read_once(docs, tables)
    held = read.where(F.size("told") > 0).select("rid", F.size("words").alias("size"), F.explode(F.array_distinct(F.flatten(F.col("told.values")))).alias("entity"))
    entities = held.groupBy("entity").agg(F.count("*").alias("n_e"))
    lines = read.select(F.explode("told").alias("line")).select(F.explode("line.values").alias("entity"), F.col("line.words").alias("words"))
    beside = lines.select("entity", F.explode("words").alias("term")).where(F.instr("term", F.col("entity")) == 0).distinct()
    joint = tables.put(_together(read, held, tables.put(beside), tables))
    holds = read.select("doc_id", F.explode("words").alias("term"))
    terms = holds.groupBy("term").agg(F.count("*").alias("n_t"))
    # Entities and terms that stand in very many pairs are split in these joins.
    total = joint.count()
    entities = tables.put(entities.join(joint.groupBy("entity").agg(F.count("*").alias("m")), "entity"))
    terms = tables.put(terms.join(joint.groupBy("term").agg(F.count("*").alias("m")), "term"))
    known = split_join(joint, entities, ["entity"], "m", total, ["term"])
    known = split_join(known, terms, ["term"], "m", total, ["entity"])
    n = float(max(read.count(), 2))
    share = F.col("n_e") / n
    given = (F.col("n_et") + prior * share) / (F.col("n_t") + prior)
    known = known.withColumn("share", F.when(share < 1, F.log(given / share) / -F.log(share)).otherwise(0.0))
    told = tables.put(known.where(F.col("share") >= least).groupBy("term").agg(F.max("n_t").alias("n_t")))
    size, total = told.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0)), F.coalesce(F.sum("n_t"), F.lit(0))).first()
    holds = holds.where("doc_id is not null")
    held = holds.join(F.broadcast(told), "term") if size <= broadcast_bytes else split_join(holds, told, ["term"], "n_t", total, ["doc_id"])
    return held.groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def find(docs: DataFrame, few: int = FEW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text, base, added): spans (start, end, value, kind) of the base kinds and of disclosing terms."""
    tables = Tables(docs.sparkSession, "pii")
    terms = tables.put(disclosing_terms(docs, tables, broadcast_bytes=broadcast_bytes))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(terms, "doc_id", "left")
    rows = rows.withColumn("base", base_spans(F.col("text")))
    told = F.when(F.size("terms") <= few, few_spans(F.col("text"), F.col("terms"))).otherwise(told_spans(F.col("text"), F.col("terms")))
    clear = clear_of(told, F.col("base"))
    added = F.when(F.col("terms").isNotNull(), clear).otherwise(F.array().cast(_SPANS))
    return rows.select("doc_id", "text", "base", _named("term", added).alias("added"))


def sanitise(found: DataFrame) -> DataFrame:
    """(doc_id, text) with base values generalised to [KIND] and terms removed; overlapping spans go as one, under the first's kind."""
    text, size = F.col("text"), F.length("text")

    def cleaned(spans):
        ends = running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
        upto = F.concat(F.array(F.lit(0)), ends)
        label = lambda s: F.when(s["kind"] == "term", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        part = lambda s, b: F.when(s["start"] >= b, F.concat(F.substring(text, b + 1, s["start"] - b), label(s))).otherwise("")
        parts = F.zip_with(spans, F.slice(upto, F.lit(1), F.size(spans)), part)
        return F.concat(F.array_join(parts, ""), F.substring(text, F.array_max(upto) + 1, size))

    return found.select("doc_id", let(F.array_sort(F.concat("base", "added")), cleaned).alias("text"))
