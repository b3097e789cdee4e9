"""Causal order of any two segments: an index of what each segment has heard of, and what can be asked of it.

Probes are the chains of the causal graph: a probe's segments follow each other, so all that a segment can know of another
probe is said by one number, the latest of its segments that happened before. Such numbers change only where a probe
hears something new, so the index keeps, for each (probe, known probe), the steps of a rising staircase. Whether one
segment happened before another, or neither before the other, is then one lookup of the last step.

The index is the fixpoint of handing on what is known. In each round only what the last round has added travels: a fact
of a segment leaves by the first snapshot at or after it that each neighbour hears, found by a running value over both
snapshots and facts; later snapshots to the same neighbour carry nothing that it has not heard. What a receiver knows
already is left out. There are as many rounds as hops that news makes at most.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.tables import drop, shared_path, written
from causeway.operators.timeline import running

log = logging.getLogger(__name__)


def hearers(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src_probe").alias("probe_id"), F.col("dst_probe").alias("hearer")).distinct()


def first_hearers(edges: DataFrame, facts: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """facts (probe_id, ticks, ...) with hearer and heard_ticks: of each neighbour the first segment that hears of the fact.

    Running minima from the latest snapshot back; a probe pair with many snapshots is taken in blocks. pairs: `hearers` of the
    edges, where they are at hand.
    """
    given = [c for c in facts.columns if c not in ("probe_id", "ticks")]
    pair = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst")).alias("pair")
    asks = facts.join(hearers(edges) if pairs is None else pairs, "probe_id").select(pair("probe_id", "hearer"), (1 - 2 * F.col("ticks")).alias("back"), F.lit(None).cast("long").alias("less"), "ticks", *given)
    marks = edges.select(pair("src_probe", "dst_probe"), (-2 * F.col("src_ticks")).alias("back"), (-F.col("dst_ticks")).alias("less"))
    known = running(marks.unionByName(asks, allowMissingColumns=True), "pair", "back", F.col("less"), "first", "max")
    asked = known.where("less is null and first is not null")
    return asked.select(F.col("pair.src").alias("probe_id"), "ticks", *given, F.col("pair.dst").alias("hearer"), (-F.col("first")).alias("heard_ticks"))


def _news(labels: DataFrame | None, heard: DataFrame, root: str) -> DataFrame:
    """heard facts that say more than the labels, and than other heard ones, of the same or an earlier segment.

    What is heard, and the labels that it touches, are read several times and written to root first.
    """
    pair = F.struct("probe_id", "known_probe").alias("pair")
    most = heard.groupBy("probe_id", "ticks", "known_probe").agg(F.max("known_ticks").alias("known_ticks"))
    most = written(most, f"{root}/heard")
    none = F.lit(None).cast("long")
    rows = most.select(pair, "ticks", (4 * F.col("ticks") + 1).alias("at"), none.alias("v"), F.col("known_ticks").alias("asks"))
    rows = rows.unionByName(most.select(pair, "ticks", (4 * F.col("ticks") + 2).alias("at"), F.col("known_ticks").alias("v"), none.alias("asks")))
    if labels is not None:
        touched = written(labels.join(most.select("probe_id", "known_probe").distinct(), ["probe_id", "known_probe"], "left_semi"), f"{root}/touched")
        rows = rows.unionByName(touched.select(pair, "ticks", (4 * F.col("ticks")).alias("at"), F.col("known_ticks").alias("v"), none.alias("asks")))
    told = running(rows, "pair", "at", F.col("v"), "had", "max").where("asks is not null and (had is null or had < asks)")
    return told.select(F.col("pair.probe_id").alias("probe_id"), "ticks", F.col("pair.known_probe").alias("known_probe"), F.col("asks").alias("known_ticks"))


def causal_index(edges: DataFrame) -> DataFrame:
    """(probe_id, ticks, known_probe, known_ticks): from this segment of probe_id on, all of known_probe up to known_ticks
    happened before; known_ticks rises with ticks.

    edges: (src_probe, src_ticks, dst_probe, dst_ticks), each from a segment to one that heard of it. Rows with a null take
    no part, repeated ones count once; where edges contradict each other, so that a segment happens before itself, both
    orders hold. Each round's tables are written to the shared folder.
    """
    spark = edges.sparkSession
    root = shared_path(spark, "order")
    edges = written(edges.select("src_probe", "src_ticks", "dst_probe", "dst_ticks").where("src_probe <> dst_probe").dropna().distinct(), f"{root}/edges")
    heard = edges.select(F.col("dst_probe").alias("probe_id"), F.col("dst_ticks").alias("ticks"), F.col("src_probe").alias("known_probe"), F.col("src_ticks").alias("known_ticks"))
    pairs = written(hearers(edges), f"{root}/pairs")
    new = written(_news(None, heard, f"{root}/step0"), f"{root}/labels/round=0")
    n = 0
    while not new.isEmpty():
        n += 1
        labels = spark.read.schema(new.schema).parquet(f"{root}/labels")
        onward = first_hearers(edges, new, pairs).where("hearer <> known_probe")
        heard = onward.select(F.col("hearer").alias("probe_id"), F.col("heard_ticks").alias("ticks"), "known_probe", "known_ticks")
        new = written(_news(labels, heard, f"{root}/step{n}"), f"{root}/labels/round={n}")
        drop(spark, f"{root}/step{n - 1}")
    log.info("causal index complete after %d rounds", n)
    # Steps that a later round has made idle go.
    labels = spark.read.schema(new.schema).parquet(f"{root}/labels")
    index = written(_news(None, labels, f"{root}/last"), f"{root}/index")
    for name in ("edges", "pairs", "labels", f"step{n}", "last"):
        drop(spark, f"{root}/{name}")
    return index


def known_at(index: DataFrame, asks: DataFrame) -> DataFrame:
    """asks (probe_id, ticks, known_probe, ...) with known_ticks: the latest segment of known_probe that happened before that
    one of probe_id, null if none."""
    given = [c for c in asks.columns if c not in ("probe_id", "known_probe")]
    pair = F.struct("probe_id", "known_probe").alias("pair")
    marks = index.select(pair, (2 * F.col("ticks")).alias("at"), F.col("known_ticks").alias("v"), F.lit(False).alias("is_ask"))
    rows = asks.select(pair, (2 * F.col("ticks") + 1).alias("at"), F.lit(None).cast("long").alias("v"), F.lit(True).alias("is_ask"), F.struct(*given).alias("given"))
    told = running(marks.unionByName(rows, allowMissingColumns=True), "pair", "at", F.col("v"), "known_ticks", "max").where("is_ask")
    return told.select("pair.probe_id", "pair.known_probe", "given.*", "known_ticks")


def relations(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (probe_a, ticks_a, probe_b, ticks_b, ...) with relation: before, after, same or concurrent; both where edges
    contradict each other."""
    given = F.struct("*").alias("row")
    ways = F.explode(F.array(
        F.struct(F.col("probe_b").alias("probe_id"), F.col("ticks_b").alias("ticks"), F.col("probe_a").alias("known_probe"), F.col("ticks_a").alias("needs"), F.lit("before").alias("way")),
        F.struct(F.col("probe_a").alias("probe_id"), F.col("ticks_a").alias("ticks"), F.col("probe_b").alias("known_probe"), F.col("ticks_b").alias("needs"), F.lit("after").alias("way")),
    )).alias("w")
    numbered = written(pairs.withColumn("_nth", F.monotonically_increasing_id()), shared_path(pairs.sparkSession, "pairs"))
    # On one probe the ticks say it; the index has such pairs only where edges contradict each other.
    other = numbered.where("probe_a <> probe_b").select(F.col("_nth"), ways).select("_nth", "w.*")
    told = known_at(index, other).where("known_ticks >= needs").groupBy("_nth").agg(F.bool_or(F.col("way") == "before").alias("before"), F.bool_or(F.col("way") == "after").alias("after"))
    at = F.when(F.col("probe_a") == F.col("probe_b"), F.when(F.col("ticks_a") < F.col("ticks_b"), "before").when(F.col("ticks_a") > F.col("ticks_b"), "after").otherwise("same"))
    at = at.when(F.col("before") & F.col("after"), "both").when(F.col("before"), "before").when(F.col("after"), "after").otherwise("concurrent")
    return numbered.join(told, "_nth", "left").withColumn("relation", at).drop("_nth", "before", "after").select(*pairs.columns, "relation")


def reach(index: DataFrame, segments: DataFrame) -> DataFrame:
    """segments (probe_id, ticks) with n_heard: the number of other probes that have heard of the segment, directly or not.

    What a probe knows in the end is one number for each other probe; of each probe those numbers are counted downwards, and a
    segment takes the count at the last one above it.
    """
    last = index.groupBy("probe_id", "known_probe").agg(F.max("known_ticks").alias("upto"))
    ends = last.groupBy(F.col("known_probe").alias("probe_id"), F.col("upto").alias("ticks")).agg(F.count("*").alias("n"))
    marks = ends.select("probe_id", (-2 * F.col("ticks")).alias("back"), "n", F.lit(False).alias("is_ask"), "ticks")
    asks = segments.select("probe_id", (1 - 2 * F.col("ticks")).alias("back"), F.lit(None).cast("long").alias("n"), F.lit(True).alias("is_ask"), "ticks")
    return running(marks.unionByName(asks), "probe_id", "back", F.col("n"), "n_heard").where("is_ask").select("probe_id", "ticks", "n_heard")
