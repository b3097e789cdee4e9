"""Wall-clock times of different probes: which can be compared, which lie close to each other, which contradict the causal order.

A report's header names the wall clock that its times are read from, 0 for one of the probe's own, and how fine it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import words as W


def timed(entries: DataFrame, reports: DataFrame) -> DataFrame:
    """entries that have a time, with domain and time_resolution from the headers of their reports (probe_id, seq_num,
    wall_clock_id, time_resolution, each once): times of one domain can be compared, no others."""
    clock = F.col("wall_clock_id")
    domain = F.when(W.local_only(clock), -F.col("probe_id")).otherwise(clock.cast("long"))
    heads = reports.select("probe_id", "seq_num", domain.alias("domain"), "time_resolution")
    return entries.where("time_ns is not null").join(heads, ["probe_id", "seq_num"])


def close_pairs(rows: DataFrame, within_ns: int) -> DataFrame:
    """Pairs of timed rows (probe_id, domain, time_ns, id) of one domain and different probes whose times are at most within_ns
    apart: (id_a, id_b, apart_ns) with time_a <= time_b, smaller id first where times are equal.

    A band join in slots as long as the band: a row meets its own slot and the next, so that only rows that are close are
    compared. The result itself grows with what is close.
    """
    slot = F.call_function("div", F.col("time_ns"), F.lit(within_ns).cast("long"))
    a = rows.select("domain", F.col("probe_id").alias("probe_a"), F.col("time_ns").alias("time_a"), F.col("id").alias("id_a"), F.explode(F.array(slot, slot + 1)).alias("slot"))
    b = rows.select("domain", F.col("probe_id").alias("probe_b"), F.col("time_ns").alias("time_b"), F.col("id").alias("id_b"), slot.alias("slot"))
    apart = F.col("time_b") - F.col("time_a")
    near = a.join(b, ["domain", "slot"]).where((F.col("probe_a") != F.col("probe_b")) & apart.between(0, within_ns) & ((apart > 0) | (F.col("id_a") < F.col("id_b"))))
    return near.select("id_a", "id_b", apart.alias("apart_ns"))


def contradictions(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges (dst_probe, dst_clock, src_probe, src_clock) whose times deny them: something in the source's segment is timed later
    than something in the segment that heard of it, by more than both resolutions.

    rows: timed rows (probe_id, clock_at, domain, time_resolution, time_ns). Adds domain, src_ns, the last time of the source's
    segment, dst_ns, the first of the other. Edges across domains, and of segments without times, are left out.
    """
    spans = rows.groupBy("probe_id", "clock_at", "domain").agg(F.min("time_ns").alias("least"), F.max("time_ns").alias("most"), F.max("time_resolution").alias("res"))
    src = spans.select(F.col("probe_id").alias("src_probe"), F.col("clock_at").alias("src_clock"), "domain", F.col("most").alias("src_ns"), F.col("res").alias("src_res"))
    dst = spans.select(F.col("probe_id").alias("dst_probe"), F.col("clock_at").alias("dst_clock"), "domain", F.col("least").alias("dst_ns"), F.col("res").alias("dst_res"))
    both = edges.join(src, ["src_probe", "src_clock"]).join(dst, ["dst_probe", "dst_clock", "domain"])
    return both.where(F.col("src_ns") > F.col("dst_ns") + F.col("src_res") + F.col("dst_res")).select(*edges.columns, "domain", "src_ns", "dst_ns")
