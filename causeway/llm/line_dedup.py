r"""Removal of repeated line runs, by a suffix array over line sequences, in DataFrame operations only.

A document is the sequence of its non-blank lines; a line's symbol is the 128-bit hash of its trimmed text. Suffixes are
grouped by prefix doubling: in round k, suffixes that share their first 2^k lines form one interval of the suffix array,
named by the place (doc_id, line) of its earliest suffix; pairs of names, of a suffix and of the one 2^k lines on, give
the intervals of 2^(k+1) lines. Intervals of one suffix are done and leave. Names stand in for ranks: only which suffixes
lie in one interval and which of them is earliest is needed, so the array is kept as its intervals and never put in
order. Longest common prefixes come from them: going back from the longest round to the first, each suffix adds 2^k lines
to its prefix whenever the interval that this gives still has an earlier member. So every suffix ends with the exact
length of its longest common prefix with any earlier one.

A run of lines that repeats an earlier run is deleted, however short; the first copy stays. Callers may ask for a least
number of words `[^\x20\x09-\x0D]+`; lines are trimmed of that white space too. Minima and counts are aggregated before
each shuffle; where they are joined back, the rows of a line or interval that holds a large share of all are dealt over
many tasks (`split_join`), so that a line which most documents hold is split.

Nulls and odd rows: a null text counts as empty; blank lines belong to no run, and go only where they lie inside one;
rows with a null doc_id take no part and stay whole; rows that repeat a doc_id are one document to the array, and what is
found for it is cut from each. Ties do not arise: places differ. Extra columns pass through, whatever their names; only
n_removed gives way to the count of that name. Empty input, empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm._common import Tables, split_join

#: Words of a repeated run from which its later copies are deleted: every run.
MIN_WORDS = 1
#: Rows of a few numbers of one key that one task may join: where no key can have more, none are dealt, whatever the rows in all.
FEW = 1 << 17
# ASCII white space.
SPACE = " \t\n\x0b\x0c\r"


def _at():
    return F.struct("doc_id", "pos")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, at, words, a, b): non-blank lines, pos counting only those, at counting all; a and b are the symbol."""
    every = F.transform(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"), lambda x, i: F.struct(i.alias("at"), _trimmed(x).alias("line")))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.filter(every, lambda s: s.line != "")).alias("pos", "s"))
    line = F.col("s.line")
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    return rows.select("doc_id", "pos", F.col("s.at").alias("at"), words.alias("words"), F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _few(total: int, most: int) -> int:
    """For `split_join`, the rows in all up to which none are dealt: any number where no key has more than FEW rows."""
    return total if most <= FEW else FEW


def _intervals(pairs: DataFrame, keys: list[str], total: int, most: int | None = None) -> DataFrame:
    """(doc_id, pos, name) of the rows whose keys others share; the name is the earliest place. most bounds the rows of a key."""
    groups = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.min(_at()).alias("earliest")).where("n > 1")
    few = _few(total, total if most is None else most)
    return split_join(pairs, groups, keys, "n", total, ["doc_id", "pos"], few).select("doc_id", "pos", F.col("earliest").alias("name"))


def _largest(rows: DataFrame, *keys: str) -> int:
    """Rows of the key that has most."""
    return rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def repeated_prefixes(rows: DataFrame, tables: Tables) -> tuple[DataFrame | None, DataFrame]:
    """((doc_id, pos, size, name) of suffixes whose first size lines occur earlier, rows of lines that occur again)."""
    total = rows.count()
    often = rows.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b", "n")
    shared = split_join(rows, often, ["a", "b"], "n", total, ["doc_id", "pos"])
    again = tables.put(shared.groupBy("doc_id", "pos").agg(F.max(F.struct("a", "b", "at", "words")).alias("s")).select("doc_id", "pos", "s.*"))
    most = _largest(again, "a", "b")
    rounds, sizes, mosts = [tables.put(_intervals(again, ["a", "b"], again.count(), most))], [], []
    while size := rounds[-1].count():
        now, step = rounds[-1], 1 << (len(rounds) - 1)
        # Intervals only split: one that is small enough for a task stays so.
        most = _largest(now, "name") if most > FEW and sizes else most
        sizes.append(size)
        mosts.append(most)
        after = now.select("doc_id", (F.col("pos") - step).alias("pos"), F.col("name").alias("next"))
        rounds.append(tables.put(_intervals(now.join(after, ["doc_id", "pos"]), ["name", "next"], size, most)))
    state = None
    for k in range(len(rounds) - 2, -1, -1):
        step, ranks = 1 << k, rounds[k]
        enter = ranks.where(F.col("name") < _at()).select("doc_id", "pos", F.lit(step).alias("size"), "name")
        if state is None:
            state = tables.put(enter)
            continue
        # The earliest suffix of an interval speaks for it while it goes its own way.
        firsts = state.select("name.doc_id", "name.pos", "size", "name").distinct()
        taking = state.unionByName(firsts)
        ahead = ranks.select("doc_id", F.col("pos").alias("on"), F.col("name").alias("next"))
        tried = taking.withColumn("on", F.col("pos") + F.col("size")).join(ahead, ["doc_id", "on"]).drop("on")
        least = tried.groupBy("name", "size", "next").agg(F.min(_at()).alias("first"), F.count("*").alias("n"))
        # All that is in state is in the next longer round's intervals, and no interval has more firsts than members.
        total = 2 * sizes[k + 1]
        longer = split_join(tried, least, ["name", "size", "next"], "n", total, ["doc_id", "pos"], _few(total, 2 * mosts[k + 1])).where(F.col("first") < _at())
        longer = longer.select("doc_id", "pos", (F.col("size") + step).alias("size"), F.col("first").alias("name"))
        merged = state.unionByName(longer).unionByName(enter)
        # A suffix's longest prefix so far wins; of equal sizes there is one.
        after = tables.put(merged.groupBy("doc_id", "pos").agg(F.max(F.struct("size", "name")).alias("s")).select("doc_id", "pos", "s.*"))
        tables.drop(state)
        state = after
    tables.drop(*rounds)
    return state, again


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, first, last, n): original line numbers of maximal stretches of later copies, and their non-blank lines."""
    from pyspark.sql import Window

    tables = Tables(docs.sparkSession, "lines")
    rows = tables.put(lines(docs))
    state, again = repeated_prefixes(rows, tables)
    tables.drop(rows)
    if state is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, first int, last int, n long")
    by = Window.partitionBy("doc_id").orderBy("pos")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    known = again.select("doc_id", "pos", "at", "words").join(state.select("doc_id", "pos", "size"), ["doc_id", "pos"], "left")
    summed = tables.put(known.withColumn("total", F.sum("words").over(so_far)))
    ends = summed.select("doc_id", F.col("pos").alias("end"), F.col("total").alias("upto"))
    begun = summed.withColumn("end", F.col("pos") + F.col("size") - 1).join(ends, ["doc_id", "end"], "left")
    long_enough = F.col("upto") - F.col("total") + F.col("words") >= min_words
    reach = F.max(F.when(long_enough, F.col("end"))).over(so_far)
    gone = begun.withColumn("reach", reach).where(F.col("reach") >= F.col("pos"))
    islands = gone.withColumn("island", F.col("pos") - F.row_number().over(by))
    return islands.groupBy("doc_id", "island").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")).drop("island")


def _cut(docs: DataFrame, min_words: int) -> DataFrame:
    """(row, text, n): the rows of docs as structs, their text without later copies of runs, the lines cut."""
    tables = Tables(docs.sparkSession, "runs")
    cuts = tables.put(repeated_runs(docs, min_words)).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("cuts"), F.sum("n").alias("n"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("*").alias("row"))
    # Cuts grow with the documents: the same merge join at every size.
    joined = rows.join(cuts.hint("merge"), "doc_id", "left")
    text = F.col("row.text").cast("string")
    return joined.select("row", F.when(F.col("cuts").isNull(), text).otherwise(_without(text, F.col("cuts"))).alias("text"), F.coalesce("n", F.lit(0)).alias("n"))


def _without(text: Column, cuts: Column) -> Column:
    """text without the lines of cuts, disjoint (first, last): the stretches between sorted cuts, each line looked at once."""

    def between(x):
        stretch = lambda c, i: F.slice(x["lines"], F.when(i == 0, 1).otherwise(F.get(x["cuts"], i - 1)["last"] + 2), F.greatest(c["first"] - F.when(i == 0, 0).otherwise(F.get(x["cuts"], i - 1)["last"] + 1), F.lit(0)))
        rest = F.slice(x["lines"], F.element_at(x["cuts"], -1)["last"] + 2, F.size(x["lines"]))
        return F.array_join(F.concat(F.flatten(F.transform(x["cuts"], stretch)), rest), "\n")

    # Both arrays are made once, then walked together.
    return F.transform(F.array(F.struct(F.split(text, "\n").alias("lines"), F.array_sort(cuts).alias("cuts"))), between)[0]


def _columns(docs: DataFrame) -> list[Column]:
    """The columns of docs out of `_cut`, text as cut."""
    return [F.col("text") if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of line runs cut from text, and n_removed, the number of non-blank lines cut."""
    docs = docs.drop("n_removed")
    return _cut(docs, min_words).select(*_columns(docs), F.col("n").alias("n_removed"))


def keep_first_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """remove_repeats in the columns of docs, without documents of which nothing is left."""
    out = _cut(docs, min_words).where((F.col("n") == 0) | (_trimmed(F.coalesce("text", F.lit(""))) != ""))
    return out.select(*_columns(docs))
