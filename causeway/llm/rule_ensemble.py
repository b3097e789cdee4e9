"""Quality classifier: a sparse ensemble of rules over text statistics.

A forest is grown on labelled rows; every path from a root to a node becomes a conjunctive rule; a lasso logistic
regression over the rules keeps few of them; and the kept rules are compiled into one Spark column expression, which
scores any table of statistics without Python.

Nulls and odd rows: a null text counts as empty, whose statistics are zero; it gets a score like any other. Labels other
than 0 and 1 and null keys are left out; a document with several labels counts as 1 if at least half of them say so.
Repeated rows are scored each. With labels of one kind or none, the score is the smoothed share of ones, the same for
all. `keep_good` keeps rows without a doc_id, and drops rows that repeat a doc_id together if one of them is rejected.
Extra columns are ignored. Empty input gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import log1p
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm._common import Tables, batches, bounded_batches, octets

TREES, LEVELS, LASSO = 16, 4, 0.0005
#: A document is kept from this score on.
KEEP = 0.3

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper_share", "digit_share", "mark_share", "bang_share", "bar_share",
    "stop_share", "line_share", "wide_share", "distinct_words", "top_word", "same_as_last", "distinct_lines", "line_words",
)

_UPPER, _LOWER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True


def statistics(text: bytes) -> list[float]:
    """The values of STATISTICS for one whole text."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [log1p(size), *[0.0] * (len(STATISTICS) - 1)]
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = int(c[_UPPER].sum()), int(c[_LOWER].sum())
    lines = text.split(b"\n")
    counts = Counter(words)
    return [
        log1p(size),
        log1p(n),
        sum(map(len, words)) / n,
        upper / max(upper + lower, 1),
        int(c[_DIGIT].sum()) / size,
        int(c[[35, 36, 37, 38, 42, 64, 94, 126, 60, 62, 92]].sum()) / size,
        int(c[[33, 63]].sum()) / size,
        int(c[124]) / size,
        int(c[[44, 46]].sum()) / n,
        len(lines) / n,
        int(c[128:].sum()) / size,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(eq, words[1:], words)) / n,
        len(set(lines)) / len(lines),
        n / len(lines),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, *STATISTICS) of every row."""
    bounded_batches(docs.sparkSession)

    def run(source):
        for b in batches(source):
            values = list(zip(*(statistics(t) for t in octets(b.column(1))), strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.float64()) for v in values)], names=["doc_id", *STATISTICS])

    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction: for each named statistic, an open lower and a closed upper bound."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low > float("-inf"):
                out = out & (F.col(name) > low)
            if high < float("inf"):
                out = out & (F.col(name) <= high)
        return out


def rules_of(description: str, names: tuple[str, ...] = STATISTICS) -> list[Rule]:
    """Rules of all paths in a forest's printed description, each once."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, str, str, float]] = []
    for line in description.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if not m:
            if "Tree" in line:
                path = []
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, names[int(m[2])], m[3], float(m[4]))]
        box: dict[str, tuple[float, float]] = {}
        for _, name, op, at in path:
            low, high = box.get(name, (float("-inf"), float("inf")))
            box[name] = (low, min(high, at)) if op == "<=" else (max(low, at), high)
        found.setdefault(Rule(tuple((k, *box[k]) for k in sorted(box))))
    return list(found)


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weighted: tuple[tuple[float, Rule], ...]

    def score(self) -> Column:
        """The compiled ensemble: probability of label 1 from the columns of STATISTICS."""
        total = F.lit(float(self.intercept))
        for w, rule in self.weighted:
            total = total + F.when(rule.column(), float(w)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def fit(labelled: DataFrame, trees: int = TREES, levels: int = LEVELS, lasso: float = LASSO) -> RuleModel:
    """From rows of STATISTICS and label (0.0 or 1.0)."""
    n, ones = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        return RuleModel(float(np.log((ones + 1) / (n - ones + 1))), ())
    data = labelled.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"), *STATISTICS)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=levels, seed=7, featureSubsetStrategy="onethird", minInstancesPerNode=max(1, min(20, n // 100))).fit(data)
    rules = rules_of(forest.toDebugString)
    if not rules:
        return RuleModel(float(np.log((ones + 1) / (n - ones + 1))), ())
    design = data.select("label", array_to_vector(F.array(*(r.column().cast("double") for r in rules))).alias("features"))
    linear = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(design)
    kept = tuple((float(w), r) for w, r in zip(linear.coefficients.toArray(), rules, strict=True) if w)
    return RuleModel(float(linear.intercept), kept)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; rows of the fold by crc32 of the doc_id are never learned from."""
    tables = Tables(docs.sparkSession, "rules")
    stats = tables.put(with_statistics(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q")).where("q in (0, 1) and doc_id is not null")
    marks = marks.where(~held_out).groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("double").alias("label"))
    labelled = tables.put(stats.join(marks, "doc_id").drop("doc_id"))
    score = fit(labelled).score()
    out = stats.select("doc_id", held_out.alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= KEEP).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps."""
    verdict = classify(docs, labels).where("predicted = 0").select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(verdict, docs.doc_id.cast("long") == verdict.bad_id, "left_anti")
