"""Prefix trie of conversations by partition refinement.

A conversation is its sequence of turns; a node of the trie is a distinct beginning of d turns, the root that of none.
Equal conversations are one sequence with many members. Refinement starts with all sequences in one class, the root's.
Turn by turn each active class is split by the next turn; every part is a node. A class of one sequence retires: the rest
of it is a unary chain, whose nodes are read off its turns at once. So rounds go as deep as two different sequences have
turns in common, and each reads the turns of its depth only. Folding back goes from the deepest round to the root and adds
up leaves and saved words, starting from the tops of the chains, whose own sums are running sums along a sequence.

A turn's symbol is the first half of the SHA-256 of role and text; a sequence is known by its number of turns and two
64-bit sums over hashes of (depth, symbol). Turns are numbered within a conversation by a sort over all rows, so that a
conversation with a large share of all turns is spread over tasks; classes with a large share of all sequences are dealt
over tasks where they are joined (`split_join`), minima and counts are taken before each shuffle, and texts never move.
A node's members are hashed as one stream of their sorted ids, a row for each 4096 numbers of a range of ids.

Nulls and odd rows: a null turn comes first, null role and text count as empty; turns that tie are in the order of their
symbols, repeated rows follow each other; rows with a null conv_id take no part; extra columns are ignored; without
conversations there is no node, not even the root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm._common import Tables, batches, split_join
from causeway.operators.timeline import running

#: Conversations of which one lends its first turns to the others, and turns that it lends at most, less one.
FAMILY, LENT = 20, 4
#: Bits of the ids that one row of a node's members spans.
SPAN = 12
WORD = r"[^\x20\x09-\x0D]+"
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def symbols(conversations: DataFrame, tables: Tables) -> DataFrame:
    """(conv_id, depth, sym, words) of conversations (conv_id, turn, role, text): depth counts from 1, sym names (role, text)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role, text = empty("role"), empty("text")
    sym = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), sym.alias("sym"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "sym"]
    # The place in the scan tells repeated rows apart, so that ranges can part them.
    dealt = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*order, "copy").sortWithinPartitions(*order)
    placed = tables.put(dealt.select("conv_id", "sym", "words", F.monotonically_increasing_id().alias("id")))
    part = F.shiftright("id", 33).alias("part")
    parts = placed.groupBy("conv_id", part).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", (F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0)) - 1).alias("zero"))
    return placed.withColumn("part", part).join(parts, ["conv_id", "part"]).select("conv_id", (F.col("id") - F.col("zero")).alias("depth"), "sym", "words")


def with_lent_turns(turns: DataFrame, family: int = FAMILY, lent: int = LENT) -> DataFrame:
    """turns rebuilt: of conversation c the first h turns become those of conversation c - c % family (fewer if it has fewer,
    none if it is absent), h being crc32 of c in decimal modulo lent."""
    h = lambda c: F.crc32(c.cast("string").cast("binary")) % lent
    conv = F.col("conv_id")
    every = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("base", conv - conv % family)
    heads = turns.where((conv % family == 0) & (F.col("depth") < lent)).withColumnRenamed("conv_id", "base")
    sizes = every.where(conv % family == 0).select("base", F.least("n", F.lit(lent)).alias("has"))
    shift = every.join(sizes, "base", "left").select("conv_id", "n", (h(conv) - F.least(h(conv), F.coalesce("has", F.lit(0)))).alias("shift"))
    total = turns.count()
    own = turns.where(F.col("depth") > h(conv))
    own = split_join(own, shift, ["conv_id"], "n", total, ["depth"]).select("conv_id", (F.col("depth") - F.col("shift")).alias("depth"), "sym", "words")
    return own.unionByName(heads.join(every.select("conv_id", "base"), "base").where(F.col("depth") <= h(conv)).select("conv_id", "depth", "sym", "words"))


def _sequences(turns: DataFrame, conversations: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(sequences (seq, size, n_convs), members (conv_id, seq)): seq is the smallest of the conversations that are equal."""
    wide = lambda c: F.sum(c.cast("decimal(20,0)"))
    known = turns.groupBy("conv_id").agg(F.count("*").alias("size"), wide(F.xxhash64("depth", "sym")).alias("a"), wide(F.xxhash64("sym", "depth", F.lit(1))).alias("b"))
    none = F.lit(0)
    key = ["size", "a", "b"]
    known = tables.put(conversations.join(known, "conv_id", "left").select("conv_id", *(F.coalesce(c, none.cast(t)).alias(c) for c, t in (("size", "long"), ("a", "decimal(38,0)"), ("b", "decimal(38,0)")))))
    equal = tables.put(known.groupBy(*key).agg(F.min("conv_id").alias("seq"), F.count("*").alias("n_convs")))
    members = split_join(known, equal, key, "n_convs", known.count(), ["conv_id"]).select("conv_id", "seq")
    return equal.select("seq", "size", "n_convs"), tables.put(members)


class _Log:
    """A table that grows by one write a round, so that no plan grows with the rounds."""

    def __init__(self, tables: Tables, name: str):
        self.tables, self.path, self.schema = tables, f"{tables.root}/{name}", None

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)
        self.schema = df.schema

    def rows(self) -> DataFrame:
        return self.tables.spark.read.schema(self.schema).parquet(self.path)


def _refined(turns: DataFrame, sequences: DataFrame, root: int | None, tables: Tables) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """(nodes of classes by round, tops of chains, (seq, depth, node) of sequences that end in such a class).

    A node of round d is (node, parent, n_convs, words): node is its smallest member, parent that of the class before.
    A top is (seq, depth, parent, n_convs, size).
    """
    total = sequences.count()
    rounds, tops, ended = [], _Log(tables, "tops"), _Log(tables, "ended")
    active = tables.put(sequences.withColumn("node", F.lit(root).cast("long")))
    while True:
        depth = len(rounds) + 1
        ended.add(active.where(F.col("size") < depth).select("seq", F.lit(depth - 1).cast("long").alias("depth"), "node"))
        now = turns.where(F.col("depth") == depth).select(F.col("conv_id").alias("seq"), "sym", "words")
        going = tables.put(active.where(F.col("size") >= depth).join(now, "seq"))
        parts = tables.put(going.groupBy("node", "sym").agg(F.min("seq").alias("child"), F.sum("n_convs").alias("n_convs"), F.first("words").alias("words"), F.count("*").alias("n"), F.first("size").alias("size")))
        tops.add(parts.where("n = 1").select(F.col("child").alias("seq"), F.lit(depth).cast("long").alias("depth"), F.col("node").alias("parent"), "n_convs", "size"))
        many = parts.where("n > 1")
        rounds.append(many.select(F.col("child").alias("node"), F.col("node").alias("parent"), "n_convs", "words"))
        before, active = active, split_join(going.select("seq", "size", "n_convs", "node", "sym"), many.select("node", "sym", "child", "n"), ["node", "sym"], "n", total, ["seq"])
        active = tables.put(active.select("seq", "size", "n_convs", F.col("child").alias("node")))
        tables.drop(going, before)
        if active.isEmpty():
            return rounds, tops.rows(), ended.rows()


def _chains(turns: DataFrame, tops: DataFrame, tables: Tables) -> DataFrame:
    """Nodes of the unary chains: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, is_top, parent)."""
    right = tops.select("seq", F.col("depth").alias("top"), "parent", "n_convs", "size", F.col("size").alias("n"))
    rows = split_join(turns.withColumnRenamed("conv_id", "seq"), right, ["seq"], "n", max(turns.count(), 1), ["depth"]).where("depth >= top")
    rows = tables.put(rows.withColumn("own", (F.col("n_convs") - 1) * F.col("words")))
    # What is saved from a node on: the chain's sum without what comes before.
    some = rows.where("n_convs > 1")
    sums = some.groupBy("seq").agg(F.sum("own").alias("all"), F.count("*").alias("n"))
    with_sums = running(some, "seq", "depth", F.col("own"), "upto")
    shared = split_join(with_sums, sums, ["seq"], "n", max(turns.count(), 1), ["depth"]).withColumn("saved", F.col("all") - F.col("upto") + F.col("own"))
    every = shared.drop("all", "upto").unionByName(rows.where("n_convs = 1").withColumn("saved", F.lit(0).cast("long")))
    is_top = F.col("depth") == F.col("top")
    return every.select(
        F.col("seq").alias("conv_id"), "depth", F.when(is_top, F.col("parent")).otherwise(F.col("seq")).alias("parent_conv_id"), "n_convs",
        (F.col("depth") < F.col("size")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), is_top.alias("is_top"),
    )


def trie(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of turns (conv_id, depth, sym, words) of the given conversations (conv_id), those without turns too.

    nodes: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens): the smallest member and the depth
    name a node, so that its last turn is the member's turn of that number. saved_tokens are the words that a model need not
    read again if each node's last turn is read once, over the subtree. members: (conv_id, seq, node, depth), where each
    conversation ends and the smallest that is equal to it.
    """
    tables = Tables(turns.sparkSession, "trie")
    sequences, members = _sequences(turns, conversations, tables)
    known = tables.put(turns.join(sequences.select(F.col("seq").alias("conv_id")), "conv_id", "left_semi").repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id"))
    smallest = sequences.agg(F.min("seq")).first()[0]
    rounds, tops, ended = _refined(known, sequences, smallest, tables)
    chains = tables.put(_chains(known, tops, tables))
    sums = [F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")]
    top_rows = tables.put(chains.where("is_top").select("depth", F.col("parent_conv_id").alias("parent"), "n_leaves", "saved_tokens"))
    root = sequences.agg(F.min("seq").alias("node"), F.sum("n_convs").alias("n_convs")).where("node is not null")
    root = root.select("node", F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("words"))
    levels = [root, *rounds]
    inner, below = _Log(tables, "inner"), None
    for depth in range(len(levels) - 1, -1, -1):
        under = top_rows.where(F.col("depth") == depth + 1).select("parent", "n_leaves", "saved_tokens")
        if below is not None:
            under = under.unionByName(below.select("parent", "n_leaves", "saved_tokens"))
        got = under.groupBy(F.col("parent").alias("node")).agg(*sums)
        here = levels[depth].join(got, "node", "left")
        saved = (F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved_tokens", F.lit(0))
        here = here.select("node", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), saved.alias("saved_tokens"))
        below = tables.put(here)
        inner.add(below.select(F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens"))
    nodes = chains.drop("is_top").unionByName(inner.rows())
    ends = ended.select("seq", "depth", "node").unionByName(tops.select("seq", F.col("size").alias("depth"), F.col("seq").alias("node")))
    counts = sequences.join(ends, "seq").select("seq", "depth", "node", F.col("n_convs").alias("n"))
    placed = split_join(members, counts, ["seq"], "n", max(members.count(), 1), ["conv_id"])
    return nodes, placed.select("conv_id", "seq", "node", "depth")


def members_sha256(members: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of the nodes at which conversations end: the SHA-256 of their sorted ids, parted by commas."""
    some = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = members.groupBy("node", "depth", F.shiftright("conv_id", SPAN).alias("part")).agg(some.alias("ids"))

    def run(source):
        at, digest, out = None, None, []
        for b in batches(source):
            for node, depth, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (node, depth) == at:
                    digest.update(b"," + ids.encode())
                    continue
                if at:
                    out.append((*at, digest.hexdigest()))
                at, digest = (node, depth), hashlib.sha256(ids.encode())
            if len(out) >= 4096:
                yield table(out)
                out = []
        if at:
            yield table([*out, (*at, digest.hexdigest())])

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["node", "depth", "ends_sha256"])

    ordered = parts.repartition("node", "depth").sortWithinPartitions("node", "depth", "part")
    return ordered.mapInArrow(run, "node long, depth long, ends_sha256 string")


def with_ends(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """nodes with ends_sha256; that of no ids where none ends."""
    known = members_sha256(members).select(F.col("node").alias("conv_id"), "depth", "ends_sha256")
    return nodes.join(known, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_MEMBERS)))
