"""Registered trace queries over the events table, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import clocks as C
from causeway.functions import errors as R
from causeway.functions import words as W
from causeway.operators import decoded as D
from causeway.operators import entries as E
from causeway.operators import graph as G
from causeway.operators import order as O
from causeway.operators import scan as X
from causeway.operators import timeline as T
from causeway.operators import wallclock as V
from causeway.plans import script as S
from causeway.sources import capture, wire
from causeway.streaming import live, reader

CAPACITY = 48
SHORT_SPAN = 64
#: Spreads event ids over 32-bit words and 16-bit epochs (Knuth's multiplier and a prime).
SPREAD, STEP = 2654435761, 7919


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _written(spark: SparkSession, df: DataFrame) -> DataFrame:
    return G.written(df, G.shared_path(spark, "trace"))


def segment_summary(spark, sf_dir):
    """Events, payload sum and time span of every causal segment."""
    rows = T.segments(S.script(spark, sf_dir))
    counted = (~F.col("op").isin("produce", "merge")).cast("long")
    return rows.groupBy("probe_id", "ticks").agg(F.sum(counted).alias("n_events"), F.sum(counted * F.col("payload_raw")).alias("payload_sum"), (F.max("time_ns") - F.min("time_ns")).alias("span_ns"))


def segment_ticks(spark, sf_dir):
    epoch, ticks = C.at_ordinal(F.col("ticks"))
    return T.segments(S.script(spark, sf_dir)).select("probe_id", "pos", epoch.cast("long").alias("epoch"), ticks.cast("long").alias("ticks"))


def event_count(spark, sf_dir):
    return S.timeline(spark, sf_dir).select("probe_id", "pos", "ticks", "event_count")


def now(spark, sf_dir):
    """The last instant of every probe."""
    last = F.max(F.struct("pos", "ticks", "event_count")).alias("s")
    return S.timeline(spark, sf_dir).groupBy("probe_id").agg(last).select("probe_id", "s.ticks", "s.event_count")


def ring_retention(spark, sf_dir):
    return T.retained(S.script(spark, sf_dir), CAPACITY).select("probe_id", "pos", "n_words")


def missed_words(spark, sf_dir):
    return T.missed(S.script(spark, sf_dir), CAPACITY)


def ring_index(spark, sf_dir):
    pos = F.col("event_id")
    return _events(spark, sf_dir).select("event_id", T.ring_index(pos, 48).alias("slot"), T.ring_index(pos, 48, True).alias("slot_pow2"))


def interactions(spark, sf_dir):
    return S.interactions(T.segments(S.script(spark, sf_dir))).select("dst_probe", "dst_ticks", "src_probe", "src_ticks")


def dangling_edges(spark, sf_dir):
    """Edges whose source was not collected: segments of every seventh probe are missing."""
    rows = T.segments(S.script(spark, sf_dir))
    edges = S.interactions(rows)
    return G.dangling(edges, rows.where("probe_id % 7 <> 0").select("probe_id", "ticks").unionByName(edges.where("src_probe % 7 <> 0 and src_ticks = 0").select(F.col("src_probe").alias("probe_id"), F.col("src_ticks").alias("ticks")))).select("dst_probe", "dst_ticks", "src_probe", "src_ticks")


def happens_before(spark, sf_dir):
    return G.happens_after(S.interactions(T.segments(S.script(spark, sf_dir))), 1, 0)


def chunk_entries(spark, sf_dir):
    """Entries of each probe's whole log out of chunks of one to seven words, which cut entries anywhere."""
    words = T.running(S.with_words(T.segments(S.script(spark, sf_dir))), "probe_id", "pos", F.col("n_words"), "upto")
    each = words.select("probe_id", (F.col("upto") - F.col("n_words")).alias("from"), F.posexplode("words").alias("i", "word")).select("probe_id", (F.col("from") + F.col("i")).alias("at"), "word")
    size = F.col("probe_id") % 7 + 1
    chunk = F.call_function("div", F.col("at"), size).alias("chunk")
    chunks = each.groupBy("probe_id", chunk).agg(F.min("at").alias("start"), F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words"))
    rows = X.parse_chunks(chunks.select("probe_id", "start", "words"))
    return rows.select("probe_id", "word_pos", "missed", "kind", F.col("n_words").cast("long").alias("n_words"), "event_id", "payload_raw", "clock_probe_id", "clock_word", "time_ns")


def causal_order(spark, sf_dir):
    """How each event relates to another one, by the index of the causal order."""
    rows = _written(spark, T.segments(S.script(spark, sf_dir)).select("probe_id", "pos", "op", "ticks", "peer", "src_pos"))
    n = rows.agg((F.max("pos") + 1).alias("n"))  # one row
    a = rows.join(F.broadcast(n)).select(F.col("pos"), F.col("probe_id").alias("probe_a"), F.col("ticks").alias("ticks_a"), ((F.col("pos") * STEP + 1) % F.col("n")).alias("other"))
    b = rows.select(F.col("pos").alias("other"), F.col("probe_id").alias("probe_b"), F.col("ticks").alias("ticks_b"))
    return O.relations(O.causal_index(S.interactions(rows)), a.join(b, "other")).select("pos", "other", "relation")


def causal_reach(spark, sf_dir):
    """How many other probes have heard of each segment in the end."""
    rows = _written(spark, T.segments(S.script(spark, sf_dir)).select("probe_id", "pos", "op", "ticks", "peer", "src_pos"))
    return O.reach(O.causal_index(S.interactions(rows)), rows.select("probe_id", "ticks").distinct()).select("probe_id", "ticks", F.coalesce("n_heard", F.lit(0)).alias("n_heard"))


def _wrapping(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    epoch = F.when(e % 3 == 0, 65530 + e % 6).when(e % 3 == 1, e * STEP % 9).otherwise(e % 65536)
    return _events(spark, sf_dir).select((F.col("user_id") + 1).alias("probe_id"), (F.length("event_type") % 4 + 1000).cast("long").alias("neighbor_id"), e.alias("pos"), epoch.cast("long").alias("epoch"), (e * STEP % 65536).alias("ticks"))


def frontier_fold(spark, sf_dir):
    return G.frontier(_wrapping(spark, sf_dir))


def frontier_of_interactions(spark, sf_dir):
    edges = S.interactions(T.segments(S.script(spark, sf_dir)))
    epoch, ticks = C.at_ordinal(F.col("src_ticks"))
    return G.frontier(edges.select(F.col("dst_probe").alias("probe_id"), F.col("src_probe").alias("neighbor_id"), "pos", epoch.cast("long").alias("epoch"), ticks.cast("long").alias("ticks")))


def frontier_capacity(spark, sf_dir):
    return G.tracked_neighbours(_wrapping(spark, sf_dir), 3)


def _clock_pairs(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    a = (F.when(e % 4 == 0, e % 4).when(e % 4 == 1, 65532 + e % 3).otherwise(e * STEP % 65536)).cast("long")
    b = (F.when(e % 5 == 0, 65531 + e % 4).otherwise(e % 7)).cast("long")
    ticks = F.when(e % 11 == 0, 65535).when(e % 11 == 1, 0).otherwise(e * SPREAD % 65536).cast("long")
    return _events(spark, sf_dir).select("event_id", a.alias("epoch_a"), ticks.alias("ticks_a"), b.alias("epoch_b"), (e % 3).alias("ticks_b"), (e % 2).alias("id_a"), (e % 3 % 2).alias("id_b"))


def clock_next_prev(spark, sf_dir):
    e, t = F.col("epoch_a"), F.col("ticks_a")
    (ne, nt), (pe, pt), (se, over) = C.following(e, t), C.preceding(e, t), C.added(e, F.lit(1000))
    names = {"next_epoch": ne, "next_ticks": nt, "prev_epoch": pe, "prev_ticks": pt, "sum_epoch": se}
    return _clock_pairs(spark, sf_dir).select("event_id", C.pack(e, t).alias("word"), *(c.cast("long").alias(n) for n, c in names.items()), over.alias("wrapped"))


def clock_unpack(spark, sf_dir):
    w = F.col("event_id") * SPREAD % (1 << 32)
    return _events(spark, sf_dir).select("event_id", C.epoch_of(w).alias("epoch"), C.ticks_of(w).alias("ticks"), C.pack(C.epoch_of(w), C.ticks_of(w)).alias("word"))


def clock_compare(spark, sf_dir):
    a, b = (F.col("epoch_a"), F.col("ticks_a")), (F.col("epoch_b"), F.col("ticks_b"))
    by_id = C.compare(F.col("id_a"), *a, F.col("id_b"), *b).cast("long")
    instant = C.instant_compare(F.col("id_a"), C.pack(*a), F.col("ticks_b"), F.col("id_b"), C.pack(*b), F.col("id_b")).cast("long")
    return _clock_pairs(spark, sf_dir).select("event_id", by_id.alias("by_clock"), C.later(*a, *b).alias("a_later"), C.later(*b, *a).alias("b_later"), instant.alias("by_instant"))


def word_classify(spark, sf_dir):
    w = F.col("event_id") * SPREAD % (1 << 32)
    return _events(spark, sf_dir).select("event_id", w.alias("word"), W.kind(w).alias("kind"), W.as_probe_id(w).alias("as_probe_id"), W.as_event_id(w).alias("as_event_id"), W.as_time_ns(w, F.col("event_id")).alias("as_time_ns"), W.is_internal(W.as_event_id(w)).alias("internal"))


def word_encode(spark, sf_dir):
    e = F.col("event_id")
    ns = e * SPREAD % (1 << 61)
    hi, lo = W.time_words(ns)
    return _events(spark, sf_dir).select("event_id", W.payload_word(e).alias("payload_word"), W.clock_word(e).alias("clock_word"), hi.alias("paired_high"), lo.alias("low"), W.time_words(ns, False)[0].alias("unpaired_high"))


def id_validation(spark, sf_dir):
    x = F.col("event_id") * SPREAD - F.lit(1 << 30)
    return _events(spark, sf_dir).select("event_id", W.probe_id(x).alias("probe_id"), W.event_id(x).alias("any_event_id"), W.event_id(x, False).alias("user_event_id"), W.recording_error(x, F.col("event_id") % 4096 * (1 << 50)).alias("error"))


def time_units(spark, sf_dir):
    ns = F.col("time_ns")
    low, high = W.ns_parts(ns)
    rows = S.script(spark, sf_dir).select("pos", "time_ns")
    return rows.select("pos", "time_ns", low.alias("low"), high.alias("high"), W.whole(ns, 10**9).alias("secs"), W.whole(ns, 10**6).alias("millis"), W.whole(ns, 10**3).alias("micros"), W.valid_ns(ns * 2).alias("doubled"), W.truncated_ns(ns * 2).alias("doubled_truncated"))


def time_regressions(spark, sf_dir):
    """Times out of order within a probe; every tenth row's clock is set back by an hour."""
    rows = S.script(spark, sf_dir).withColumn("time_ns", F.when(F.col("pos") % 10 == 0, F.col("time_ns") - 3600 * 10**9).otherwise(F.col("time_ns")))
    return T.time_regressions(rows)


def payload_typed(spark, sf_dir):
    word = F.col("event_id") * SPREAD % (1 << 32)
    # All exponents; every eleventh is that of infinity, every other of these without a fraction.
    high = word.bitwiseOR(F.lit(0x7F800000).cast("long"))
    raw = F.when(F.col("event_id") % 22 == 0, high.bitwiseAND(F.lit(0xFF800000).cast("long"))).when(F.col("event_id") % 11 == 0, high).otherwise(word)
    kinds = ("i8", "u8", "i16", "u16", "i32", "u32", "bool", "f32")
    return _events(spark, sf_dir).select("event_id", *(W.payload(raw, k).alias(k) for k in kinds))


def description_filled(spark, sf_dir):
    return S.script(spark, sf_dir).where("op = 'event_payload'").select("pos", W.filled(F.lit("value was {} cents"), F.col("payload_raw")).alias("said"))


def _reports(spark, sf_dir, span: int = S.REPORT_SPAN) -> DataFrame:
    return wire.with_header(S.reports(T.segments(S.script(spark, sf_dir)), span))


def report_header(spark, sf_dir):
    return _reports(spark, sf_dir).select("probe_id", "clock_word", "seq_num", "persistent_epoch", "time_resolution", "wall_clock_id", "n_clocks", "n_log_entries", F.length("content").cast("long").alias("bytes"), "error")


def report_errors(spark, sf_dir):
    """Reports cut short, with another fingerprint or another probe id."""
    content, pos = F.col("content"), F.col("seq_num") + F.col("probe_id")
    broken = F.when(pos % 5 == 0, F.substring(content, 1, 20)).when(pos % 5 == 1, F.substring(content, 1, 33)).when(pos % 5 == 2, F.unhex(F.concat(F.lit("00"), F.hex(F.substring(content, F.lit(2), F.length(content))))))
    broken = broken.when(pos % 5 == 3, F.unhex(F.concat(F.hex(F.substring(content, 1, 4)), F.lit("00000000"), F.hex(F.substring(content, F.lit(9), F.length(content)))))).otherwise(content)
    rows = _reports(spark, sf_dir).select((pos % 5).alias("damage"), broken.alias("content"))
    return wire.with_header(rows).groupBy("damage", "error").agg(F.count("*").alias("n"))


def _entries(spark, sf_dir) -> DataFrame:
    return E.parse(wire.with_payload(_reports(spark, sf_dir)), ["probe_id", "seq_num"])


def entry_parse(spark, sf_dir):
    return _entries(spark, sf_dir).select("probe_id", "seq_num", "kind", F.col("n_words").cast("long").alias("n_words"), "event_id", "payload_raw", "clock_probe_id", "clock_word", "time_ns")


def report_frontier(spark, sf_dir):
    whole = wire.with_payload(_reports(spark, sf_dir)).select("seq_num", F.explode("frontier").alias("c"))
    return whole.select("seq_num", "c.probe_id", F.col("c.epoch").cast("long").alias("epoch"), F.col("c.ticks").cast("long").alias("ticks"))


def decoded_interactions(spark, sf_dir):
    """The interaction graph from bytes alone."""
    return G.interactions_of(_entries(spark, sf_dir))


def decoded_timeline(spark, sf_dir):
    """Segments and event counts from bytes alone, after every third report of each probe has been lost."""
    rows = _written(spark, T.segments(S.script(spark, sf_dir)))
    whole = _written(spark, wire.with_payload(wire.with_header(S.reports(rows, SHORT_SPAN, True))).where("(seq_num + probe_id) % 3 <> 0").select("probe_id", "seq_num", "frontier", "words"))
    rows = D.timeline(whole, _written(spark, E.parse(whole.select("probe_id", "seq_num", "words"), ["probe_id", "seq_num"])))
    return rows.select("probe_id", "seq_num", "kind", "event_id", "payload_raw", "clock_probe_id", "clock_word", "time_ns", "clock_at", "event_count")


def event_dedupe(spark, sf_dir):
    """Every probe restarts once and records its first events again; even probes track restarts."""
    rows = _written(spark, S.timeline(spark, sf_dir).where("op not in ('produce', 'merge')").select("probe_id", F.col("ticks").alias("clock_at"), "event_count", (F.col("probe_id") % 2 == 0).alias("persistent_epoch")))
    rows = rows.withColumn("event_count", F.when(F.col("event_count") % 5 != 0, F.col("event_count")))
    return D.distinct_events(rows.unionByName(rows.where("clock_at < 2")))


def snapshot_codec(spark, sf_dir):
    """Every snapshot as its 12 bytes, and back."""
    rows = T.segments(S.script(spark, sf_dir)).where("op = 'produce'")
    epoch, ticks = C.at_ordinal(F.col("ticks") - 1)
    rows = rows.select("pos", wire.encoded_snapshot(F.col("probe_id"), epoch, ticks).alias("b"))
    return rows.select("pos", F.lower(F.hex("b")).alias("bytes"), wire.decoded_snapshot(F.col("b")).alias("s")).select("pos", "bytes", "s.probe_id", "s.epoch", "s.ticks", "s.error")


def report_gap(spark, sf_dir):
    """Gaps after every third report has been lost; short reports, so that small tables have several a probe."""
    return T.report_gaps(_reports(spark, sf_dir, SHORT_SPAN).where("(seq_num + probe_id) % 3 <> 0").select("probe_id", "seq_num"))


def report_dedupe(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("probe_id"), (F.col("event_id") % 2).alias("epoch"), (F.col("event_id") % 7).alias("seq_num"), (F.col("user_id") % 2 == 0).alias("persistent_epoch"))
    return T.once(rows)


def expectations(spark, sf_dir):
    manifest = spark.createDataFrame([(5, "view has a value", "producer;EXPECTATION"), (2, "error", "failure"), (1, "click", "producer; not an expectation"), (3, "sale", "expectation; failure"), (4, "none", None)], "id long, name string, tags string")
    rows = S.script(spark, sf_dir).where("op not in ('produce', 'merge')").withColumn("payload_raw", F.when(F.col("pos") % 9 == 0, 0).otherwise(F.col("payload_raw")))
    return G.expectations(rows, manifest).select("event_id", "name", *(F.col(c).cast("long").alias(c) for c in ("expected", "unmet", "failures")))


def log_correlation(spark, sf_dir):
    """An external log of instants, as errors leave it, and the places in the timeline that it names."""
    rows = _written(spark, S.timeline(spark, sf_dir).select("probe_id", "pos", "op", "ticks", "event_count"))
    log = rows.where("op = 'event'").select("probe_id", "ticks", "event_count", F.concat(F.lit("error at "), F.col("pos")).alias("line"))
    return G.correlate(log, rows)


def log_as_of(spark, sf_dir):
    """An external log whose instants lie between events, or behind the last of a segment."""
    rows = _written(spark, S.timeline(spark, sf_dir).select("probe_id", "pos", "op", "ticks", "event_count"))
    log = rows.where("op = 'event'").select("probe_id", "ticks", (F.col("event_count") - 3 + F.col("pos") % 7).alias("event_count"), F.concat(F.lit("error at "), F.col("pos")).alias("line"))
    return G.correlate_as_of(log, rows)


def _clocked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(decoded reports, script) of probes whose headers name four wall clocks, 0 among them, and three resolutions; the clock of
    every fifth probe is five days slow."""
    late = F.when(F.col("probe_id") % 5 == 0, F.col("time_ns") - 432000 * 10**9).otherwise(F.col("time_ns"))
    rows = _written(spark, S.script(spark, sf_dir).withColumn("time_ns", late))
    clock = F.call_function("div", F.col("probe_id"), F.lit(2).cast("long")) % 4
    whole = S.reports(_written(spark, T.segments(rows)), fields={"wall_clock_id": clock, "time_resolution": F.col("probe_id") % 3 * 1000})
    return _written(spark, wire.with_payload(wire.with_header(whole)).drop("content")), rows


def time_domains(spark, sf_dir):
    """Of probes that hear from each other, whether their times can be compared, as their reports' headers tell."""
    whole, _ = _clocked(spark, sf_dir)
    edges = G.interactions_of(E.parse(whole.select("probe_id", "seq_num", "words"), ["probe_id", "seq_num"])).select("dst_probe", "src_probe").distinct()
    heads = whole.groupBy("probe_id").agg(F.max("wall_clock_id").alias("clock"), F.max("time_resolution").alias("res"))
    dst, src = (heads.select(F.col("probe_id").alias(f"{x}_probe"), F.col("clock").alias(f"{x}_clock"), F.col("res").alias(f"{x}_res")) for x in ("dst", "src"))
    a, b = F.col("dst_clock"), F.col("src_clock")
    return edges.join(dst, "dst_probe").join(src, "src_probe").select("dst_probe", "src_probe", W.comparable(a, b, F.col("dst_probe"), F.col("src_probe")).alias("comparable"), W.local_only(a).alias("local_only"), W.unspecified(F.col("dst_res")).alias("unspecified"))


def time_contradictions(spark, sf_dir):
    """Interactions that the times of their segments deny, where these can be compared."""
    whole, _ = _clocked(spark, sf_dir)
    entries = _written(spark, E.parse(whole.select("probe_id", "seq_num", "words"), ["probe_id", "seq_num"]))
    rows = V.timed(D.timeline(whole, entries), whole)
    return V.contradictions(G.interactions_of(entries), rows)


def close_times(spark, sf_dir):
    """Events of different probes within ten minutes by the same wall clock."""
    whole, rows = _clocked(spark, sf_dir)
    at = rows.where("op in ('event_time', 'event_payload_time')").select("probe_id", F.call_function("div", F.col("pos"), F.lit(S.REPORT_SPAN).cast("long")).alias("seq_num"), "time_ns", F.col("pos").alias("id"))
    return V.close_pairs(V.timed(at, whole), 600 * 10**9)


def report_restarts(spark, sf_dir):
    """Which start of its probe each report belongs to, by steps back in the numbers, after every third report has been lost."""
    whole = wire.with_header(S.reports(T.segments(S.script(spark, sf_dir)), SHORT_SPAN, True)).where("(seq_num + probe_id) % 3 <> 0")
    n, each = F.col("seq_num"), 4 + F.col("probe_id") % 3
    rows = _written(spark, whole.select("probe_id", n.alias("nth"), (n % each).alias("seq_num"), (F.call_function("div", n, each) + F.col("probe_id")).alias("epoch")))
    told = T.report_restarts(rows)
    return T.at_restart(rows.select("probe_id", "nth", "seq_num"), T.restart_ranges(told))


def marked_interactions(spark, sf_dir):
    """Interactions with the recorder's own events between both clocks, and some whose own clock is gone."""
    rows = S.with_words(T.segments(S.script(spark, sf_dir)))
    w, pos = F.col("words"), F.col("pos")
    event = lambda x: F.array(F.lit(x).cast("long"))
    head = F.when(pos % 7 == 0, event(9)).otherwise(F.slice(w, 1, 2))
    between = F.when(pos % 3 == 0, event(W.INTERNAL_EVENTS["num_clocks_overflowed"])).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("words", F.when(F.col("op") == "merge", F.concat(head, between, F.slice(w, 3, 2))).otherwise(w))
    logs = rows.groupBy("probe_id", F.call_function("div", pos, F.lit(S.REPORT_SPAN).cast("long")).alias("seq_num")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"])).alias("words"))
    return G.marked_interactions(_written(spark, E.parse(logs, ["probe_id", "seq_num"])))


def internal_events(spark, sf_dir):
    """What the recorder's own events mean in decoded reports: how often each was logged, and the sum of what it carries."""
    rows = S.with_words(T.segments(S.script(spark, sf_dir)))
    pos, code = F.col("pos"), lambda name: F.lit(W.INTERNAL_EVENTS[name]).cast("long")
    more = F.when(pos % 5 == 0, F.array(code("invalid_next_epoch"))).when(pos % 5 == 1, F.array(W.payload_word(code("items_missed")), pos % 1000)).when(pos % 5 == 2, F.array(code("time_only"))).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("words", F.concat("words", more))
    logs = rows.groupBy("probe_id", F.call_function("div", pos, F.lit(S.REPORT_SPAN).cast("long")).alias("seq_num")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"])).alias("words"))
    logs = _written(spark, logs.withColumn("frontier", F.array().cast("array<struct<probe_id:long,epoch:int,ticks:int>>")))
    told = D.timeline(logs, _written(spark, E.parse(logs.select("probe_id", "seq_num", "words"), ["probe_id", "seq_num"])))
    return told.where("meaning is not null").groupBy("probe_id", "meaning").agg(F.count("*").alias("n"), F.coalesce(F.sum("payload_raw"), F.lit(0)).alias("carried"))


def self_snapshots(spark, sf_dir):
    """Ticks where every fourth row of a probe that merges merges its own snapshot, which is no merge."""
    rows = S.script(spark, sf_dir).withColumn("peer", F.when(F.col("pos") % 4 == 0, F.col("probe_id")).otherwise(F.col("peer")))
    return T.segments(T.accepted(rows)).select("probe_id", "pos", "op", "ticks")


def error_summary(spark, sf_dir):
    """The errors of damaged reports, of numbers that are no event ids or times, and of restarts, by the table of errors."""
    content, pos = F.col("content"), F.col("seq_num") + F.col("probe_id")
    whole = _written(spark, _reports(spark, sf_dir).select("probe_id", "seq_num", "content"))
    damaged = whole.select(F.when(pos % 3 == 0, F.substring(content, 1, 20)).when(pos % 3 == 1, F.substring(content, 1, 33)).otherwise(F.concat(content, content)).alias("content"))
    ids = id_validation(spark, sf_dir).select("error")
    restarts = restart_epochs(spark, sf_dir).select(F.when(F.col("invalid"), "InvalidNextEpoch").alias("error"))
    return R.summary(wire.with_header(damaged).select("error").unionByName(ids).unionByName(restarts))


def le_numbers(spark, sf_dir):
    """Little-endian numbers of 2, 4 and 8 bytes, also beyond 63 bits."""
    e = F.col("event_id")
    high, low = e * SPREAD % (1 << 32), e * STEP % (1 << 32)
    raw = F.unhex(F.concat(wire.le_hex(low, 4), wire.le_hex(high, 4))).alias("b")
    return _events(spark, sf_dir).select("event_id", raw).select("event_id", wire.read_le(F.col("b"), 4, 2).alias("u16"), wire.read_le(F.col("b"), 4, 4).alias("u32"), wire.read_u64(F.col("b"), 0).cast("string").alias("u64"))


def capture_reports(spark, sf_dir):
    """Reports written to captures, each once though some come twice, and read back in splits."""
    at = G.shared_path(spark, "capture")
    given = _written(spark, S.reports(T.segments(S.script(spark, sf_dir))))
    capture.write_capture(given.unionByName(given.where("length(content) % 3 = 0")), at)
    rows = capture.decoded(capture.read_capture(spark, at, True, 1 << 14))
    return rows.select("probe_id", "clock_word", "seq_num", "persistent_epoch", "time_resolution", "wall_clock_id", "n_clocks", "n_log_entries", F.length("content").cast("long").alias("bytes"), "error")


def restart_epochs(spark, sf_dir):
    """Signups as restarts; even probes are tracked, and a provider fails now and then."""
    rows = T.running(S.script(spark, sf_dir).where("op = 'produce'"), "probe_id", "pos", F.lit(1).cast("long"), "n")
    call = F.col("n") - 1
    rows = rows.select("probe_id", call.alias("call_no"), (F.col("probe_id") % 2 == 0).alias("tracked"), F.when(F.col("pos") % 4 != 0, call + 100).alias("next_epoch"))
    return T.restart_epochs(rows).select("probe_id", "call_no", "epoch", "invalid")


def _in_runs(spark, rows: DataFrame, make, mode: str = "append") -> DataFrame:
    """What make(stream) gives of rows that arrive in runs (column run), one stream started anew for each; batch numbers them."""
    root, rows = G.shared_path(spark, "stream"), _written(spark, rows)
    given = rows.drop("run")
    for run in range(rows.agg(F.coalesce(F.max("run"), F.lit(-1))).first()[0] + 1):
        rows.where(F.col("run") == run).drop("run").write.mode("append").parquet(f"{root}/in")
        out = make(spark.readStream.schema(given.schema).parquet(f"{root}/in"))
        put = lambda df, batch: df.write.mode("overwrite").parquet(f"{root}/out/batch={batch}")
        out.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start().awaitTermination()
    schema = make(given).schema.add("batch", "integer")
    return spark.read.schema(schema).parquet(f"{root}/out")


def _cut_logs(spark, sf_dir) -> DataFrame:
    """(run, probe_id, start, words): each report's words as a log of its own, in chunks of three runs.

    A log is cut within an entry and before another one. Of every four probes, one log lacks the middle, of one the last
    chunk starts too early, and of one the middle comes again.
    """
    whole = wire.with_payload(_reports(spark, sf_dir)).select((F.col("seq_num") * (1 << 31) + F.col("probe_id")).alias("log"), "words")
    whole = _written(spark, whole.withColumn("n", F.size("words")))
    third = F.greatest(F.floor(F.col("n") / 3), F.lit(1)).cast("int")
    later = E.parse(whole.select("log", "n", "words"), ["log", "n"]).where("3 * word_off >= 2 * n").groupBy("log").agg(F.min("word_off").alias("second"))
    cut = whole.join(later, "log", "left").select("log", "words", "n", third.alias("first"), F.coalesce("second", "n").alias("second"))
    piece = lambda run, a, b: F.struct(F.lit(run).alias("run"), a.cast("long").alias("start"), F.slice("words", a + 1, b - a).alias("words"))
    none, first, second, n = F.lit(0), F.col("first"), F.col("second"), F.col("n")
    middle, mode = piece(1, first, second), F.col("log") % 4
    pieces = F.when(mode == 1, F.array(piece(0, none, first), piece(2, second, n))).when(mode == 2, F.array(piece(0, none, first), middle, piece(2, first, n)))
    pieces = pieces.when(mode == 3, F.array(piece(0, none, first), middle, piece(2, first, second), piece(2, second, n))).otherwise(F.array(piece(0, none, first), middle, piece(2, second, n)))
    return cut.select(F.col("log").alias("probe_id"), F.explode(pieces).alias("c")).select("c.run", "probe_id", "c.start", "c.words")


def _read(rows: DataFrame) -> DataFrame:
    return rows.where("probe_id > 0").select((F.col("probe_id") % (1 << 31)).alias("probe_id"), "missed", "kind", F.col("n_words").cast("long").alias("n_words"), "event_id", "payload_raw", "clock_probe_id", "clock_word", "time_ns")


def stream_entries(spark, sf_dir):
    """Entries that the streaming reader puts together from chunks of logs, in three runs of one stream."""
    return _read(_in_runs(spark, _cut_logs(spark, sf_dir), reader.read_entries))


def stream_reordered(spark, sf_dir):
    """The same entries from chunks that come last first: they wait for those before them, and what never comes is lost when the
    last run has moved the watermark beyond the time to wait."""
    late = F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("run"))
    chunks = _cut_logs(spark, sf_dir).withColumn("run", 2 - F.col("run")).withColumn("sent_at", late)
    mark = spark.range(1).select(F.lit(3).alias("run"), F.lit(0).cast("long").alias("probe_id"), F.lit(0).cast("long").alias("start"), F.array(F.lit(1).cast("long")).alias("words"), F.timestamp_seconds(F.lit(1_700_003_600)).alias("sent_at"))
    return _read(_in_runs(spark, chunks.unionByName(mark), lambda s: reader.read_entries(s.withWatermark("sent_at", "0 seconds") if s.isStreaming else s, "10 minutes")))


def live_timeline(spark, sf_dir):
    """The decoded timeline as reports arrive, in three runs; every third report of each probe never does."""
    whole = wire.with_payload(wire.with_header(S.reports(T.segments(S.script(spark, sf_dir)), SHORT_SPAN, True))).where("(seq_num + probe_id) % 3 <> 0")
    rows = whole.select(F.least(F.call_function("div", F.col("seq_num"), F.lit(4).cast("long")), F.lit(2)).cast("int").alias("run"), "probe_id", "seq_num", "frontier", "words")
    return _in_runs(spark, rows, live.timeline).select("probe_id", "seq_num", "kind", "event_id", "payload_raw", "clock_probe_id", "clock_word", "time_ns", "clock_at", "event_count")


def live_frontier(spark, sf_dir):
    """Frontiers as clocks arrive, in three runs: the last change of each neighbour's clock is its latest."""
    rows = _wrapping(spark, sf_dir)
    n = rows.agg((F.max("pos") + 1).alias("n"))  # one row
    changes = _in_runs(spark, rows.join(F.broadcast(n)).withColumn("run", F.floor(F.col("pos") * 3 / F.col("n")).cast("int")).drop("n"), live.frontier, "update")
    return changes.groupBy("probe_id", "neighbor_id").agg(F.max(F.struct("batch", "epoch", "ticks")).alias("c")).select("probe_id", "neighbor_id", "c.epoch", "c.ticks")


def stream_gaps(spark, sf_dir):
    """Gaps after every third report has been lost, of reports that come out of order in three runs, some of them again."""
    rows = _reports(spark, sf_dir, SHORT_SPAN).where("(seq_num + probe_id) % 3 <> 0").select("probe_id", "seq_num", ((F.col("seq_num") * 7 + F.col("probe_id")) % 3).cast("int").alias("run"))
    again = rows.where("run = 0 and seq_num % 2 = 0").withColumn("run", F.lit(2))
    return live.open_gaps(_in_runs(spark, rows.unionByName(again), live.report_changes)).select("probe_id", "seq_num", "missing")


NAMES = (
    "segment_summary segment_ticks event_count now ring_retention missed_words ring_index interactions dangling_edges happens_before frontier_fold "
    "frontier_of_interactions frontier_capacity clock_next_prev clock_unpack clock_compare word_classify word_encode id_validation time_units "
    "time_regressions payload_typed description_filled report_header report_errors entry_parse report_frontier decoded_interactions snapshot_codec "
    "report_gap report_dedupe expectations log_correlation restart_epochs stream_entries decoded_timeline event_dedupe log_as_of time_domains "
    "causal_order causal_reach chunk_entries stream_reordered live_timeline live_frontier stream_gaps "
    "time_contradictions close_times report_restarts marked_interactions internal_events le_numbers capture_reports self_snapshots error_summary"
).split()


def queries() -> dict:
    return {name: globals()[name] for name in NAMES}


_TICKS = "op IN ('produce', 'merge')"
_SCRIPT = f"""
ev AS (SELECT user_id + 1 AS probe_id, event_id AS pos, event_type, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS event_id,
       CAST(floor(value * 100 + 0.5) AS BIGINT) AS payload_raw, epoch_us(ts) * 1000 AS time_ns, (user_id + 1) % (SELECT max(user_id) + 1 FROM events) + 1 AS peer FROM events),
heard AS (SELECT pos, asks, max(mark) OVER (PARTITION BY owner ORDER BY pos) AS src_pos FROM (
       SELECT pos, probe_id AS owner, pos AS mark, false AS asks FROM ev WHERE event_type = 'signup'
       UNION ALL SELECT pos, peer, NULL, true FROM ev WHERE event_type = 'purchase')),
sized AS (SELECT ev.*, src_pos, CASE WHEN event_type = 'signup' THEN 'produce' WHEN src_pos IS NOT NULL THEN 'merge' WHEN event_type = 'error' THEN 'event' WHEN event_type = 'click' THEN 'event_time'
       WHEN event_type = 'purchase' THEN 'event_payload_time' ELSE 'event_payload' END AS op FROM ev LEFT JOIN heard ON heard.pos = ev.pos AND heard.asks),
script AS (SELECT *, CASE op WHEN 'event' THEN 1 WHEN 'event_payload' THEN 2 WHEN 'event_time' THEN 3 WHEN 'produce' THEN 2 ELSE 4 END AS n_words FROM sized),
seg AS (SELECT *, CAST(sum(CASE WHEN {_TICKS} THEN 1 ELSE 0 END) OVER (PARTITION BY probe_id ORDER BY pos) AS BIGINT) AS ticks FROM script),
tl AS (SELECT *, CAST(sum(CASE WHEN {_TICKS} THEN 0 ELSE 1 END) OVER (PARTITION BY probe_id, ticks ORDER BY pos) AS BIGINT) AS event_count FROM seg),
edges AS (SELECT d.pos, d.probe_id AS dst_probe, d.ticks AS dst_ticks, d.peer AS src_probe, s.ticks - 1 AS src_ticks FROM seg d JOIN seg s ON s.pos = d.src_pos WHERE d.op = 'merge')
"""


def _epoch(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0 ELSE ({n} - 1) // 65535 % 65536 END"


def _tick(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0 ELSE ({n} - 1) % 65535 + 1 END"


def _packed(n: str) -> str:
    return f"({_epoch(n)}) * 65536 + {_tick(n)}"


def _le(x: str, size: int) -> str:
    return " || ".join(f"printf('%02x', ({x}) >> {8 * i} & 255)" for i in range(size))


# From each segment of interest the first segment of each other probe's that hears of it, hop by hop.
_HEARD = """hops AS (SELECT src_probe, src_ticks, dst_probe, min(dst_ticks) AS dst_ticks FROM edges GROUP BY ALL),
reach AS (SELECT DISTINCT probe_id AS probe_a, ticks AS ticks_a, probe_id, ticks FROM seg UNION SELECT probe_a, ticks_a, dst_probe, dst_ticks FROM reach JOIN hops ON src_probe = probe_id AND src_ticks >= ticks),
told AS (SELECT probe_a, ticks_a, probe_id, min(ticks) AS ticks FROM reach WHERE probe_id <> probe_a GROUP BY ALL)"""
_WRAPPING = f"""w AS (SELECT user_id + 1 AS probe_id, length(event_type) % 4 + 1000 AS neighbor_id, event_id AS pos,
    CASE event_id % 3 WHEN 0 THEN 65530 + event_id % 6 WHEN 1 THEN event_id * {STEP} % 9 ELSE event_id % 65536 END AS epoch, event_id * {STEP} % 65536 AS ticks FROM events)"""
_PAIRS = f"""p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 65532 + event_id % 3 ELSE event_id * {STEP} % 65536 END AS epoch_a,
    CASE event_id % 11 WHEN 0 THEN 65535 WHEN 1 THEN 0 ELSE event_id * {SPREAD} % 65536 END AS ticks_a,
    CASE WHEN event_id % 5 = 0 THEN 65531 + event_id % 4 ELSE event_id % 7 END AS epoch_b, event_id % 3 AS ticks_b, event_id % 2 AS id_a, event_id % 3 % 2 AS id_b FROM events)"""


def _later(a: str, b: str) -> str:
    return f"(NOT (epoch_{a} = epoch_{b} AND ticks_{a} = ticks_{b}) AND ((epoch_{b} >= 65532 AND epoch_{a} <= 3) OR epoch_{a} * 65536 + ticks_{a} > epoch_{b} * 65536 + ticks_{b}))"


_TIMED = """td AS (SELECT probe_id, ticks, pos, CASE WHEN probe_id % 5 = 0 THEN time_ns - 432000000000000 ELSE time_ns END AS time_ns, CASE WHEN probe_id // 2 % 4 = 0 THEN -probe_id ELSE probe_id // 2 % 4 END AS domain
    FROM seg WHERE op IN ('event_time', 'event_payload_time'))"""
_MASK = (1 << 32) - 1
_BLOCK = S.REPORT_SPAN
_ENTRIES = f"""
en AS (SELECT probe_id, pos // {_BLOCK} AS seq_num, CASE op WHEN 'event_time' THEN 'event' WHEN 'event_payload_time' THEN 'event_payload' WHEN 'produce' THEN 'clock' WHEN 'merge' THEN 'clock' ELSE op END AS kind,
    CASE WHEN {_TICKS} THEN 2 ELSE n_words END AS n_words, CASE WHEN {_TICKS} THEN NULL ELSE event_id END AS event_id, CASE WHEN op IN ('event_payload', 'event_payload_time') THEN payload_raw & {_MASK} END AS payload_raw,
    CASE WHEN {_TICKS} THEN probe_id END AS clock_probe_id, CASE WHEN {_TICKS} THEN {_packed('ticks')} END AS clock_word, CASE WHEN op IN ('event_time', 'event_payload_time') THEN time_ns END AS time_ns FROM seg
    UNION ALL SELECT dst_probe, pos // {_BLOCK}, 'clock', 2, NULL, NULL, src_probe, {_packed('src_ticks')}, NULL FROM edges)"""


def _report_rows(span: int) -> str:
    return f"rp AS (SELECT probe_id, pos // {span} AS seq_num, max(ticks) AS ticks, CAST(sum(n_words) AS BIGINT) AS n FROM seg GROUP BY ALL)"


_REPORTS = _report_rows(_BLOCK)
_WORD = f"event_id * {SPREAD} % {1 << 32}"
_RAW = f"r AS (SELECT event_id, CASE WHEN event_id % 22 = 0 THEN (({_WORD}) | {0x7F800000}) & {0xFF800000} WHEN event_id % 11 = 0 THEN ({_WORD}) | {0x7F800000} ELSE {_WORD} END AS x FROM events)"


def _signed(bits: int) -> str:
    low = f"(x & {(1 << bits) - 1})"
    return f"CASE WHEN {low} >= {1 << (bits - 1)} THEN {low} - {1 << bits} ELSE {low} END"


ORACLE_SQL: dict[str, str] = {
    "segment_summary": f"WITH {_SCRIPT} SELECT probe_id, ticks, CAST(sum(CASE WHEN {_TICKS} THEN 0 ELSE 1 END) AS BIGINT) AS n_events, CAST(sum(CASE WHEN {_TICKS} THEN 0 ELSE payload_raw END) AS BIGINT) AS payload_sum, max(time_ns) - min(time_ns) AS span_ns FROM seg GROUP BY probe_id, ticks",
    "segment_ticks": f"WITH {_SCRIPT} SELECT probe_id, pos, {_epoch('ticks')} AS epoch, {_tick('ticks')} AS ticks FROM seg",
    "event_count": f"WITH {_SCRIPT} SELECT probe_id, pos, ticks, event_count FROM tl",
    "now": f"WITH {_SCRIPT} SELECT probe_id, arg_max(ticks, pos) AS ticks, arg_max(event_count, pos) AS event_count FROM tl GROUP BY probe_id",
    "ring_retention": f"WITH {_SCRIPT} SELECT probe_id, pos, CAST(n_words AS BIGINT) AS n_words FROM (SELECT *, sum(n_words) OVER (PARTITION BY probe_id ORDER BY pos DESC) AS later FROM script) WHERE later <= {CAPACITY}",
    "missed_words": f"WITH {_SCRIPT} SELECT probe_id, CAST(sum(n_words) AS BIGINT) AS written_words, CAST(sum(CASE WHEN later > {CAPACITY} THEN n_words ELSE 0 END) AS BIGINT) AS missed_words FROM (SELECT *, sum(n_words) OVER (PARTITION BY probe_id ORDER BY pos DESC) AS later FROM script) GROUP BY probe_id",
    "ring_index": "SELECT event_id, event_id % 48 AS slot, event_id & 31 AS slot_pow2 FROM events",
    "interactions": f"WITH {_SCRIPT} SELECT dst_probe, dst_ticks, src_probe, src_ticks FROM edges",
    "dangling_edges": f"WITH {_SCRIPT} SELECT dst_probe, dst_ticks, src_probe, src_ticks FROM edges WHERE src_probe % 7 = 0",
    "happens_before": f"WITH RECURSIVE {_SCRIPT}, reach AS (SELECT CAST(1 AS BIGINT) AS probe_id, CAST(0 AS BIGINT) AS ticks UNION SELECT dst_probe, dst_ticks FROM reach JOIN edges ON src_probe = probe_id AND src_ticks >= ticks) SELECT probe_id, min(ticks) AS ticks FROM reach GROUP BY probe_id",
    "chunk_entries": f"""WITH {_SCRIPT}, o AS (SELECT *, CAST(sum(n_words) OVER (PARTITION BY probe_id ORDER BY pos) AS BIGINT) - n_words AS off FROM seg)
        SELECT probe_id, off AS word_pos, CAST(0 AS BIGINT) AS missed, CASE op WHEN 'event_time' THEN 'event' WHEN 'event_payload_time' THEN 'event_payload' WHEN 'produce' THEN 'clock' WHEN 'merge' THEN 'clock' ELSE op END AS kind,
            CAST(CASE WHEN {_TICKS} THEN 2 ELSE n_words END AS BIGINT) AS n_words, CASE WHEN NOT {_TICKS} THEN CAST(event_id AS BIGINT) END AS event_id, CASE WHEN op IN ('event_payload', 'event_payload_time') THEN payload_raw & {_MASK} END AS payload_raw,
            CASE WHEN {_TICKS} THEN probe_id END AS clock_probe_id, CASE WHEN {_TICKS} THEN CAST({_packed('ticks')} AS BIGINT) END AS clock_word, CASE WHEN op IN ('event_time', 'event_payload_time') THEN time_ns END AS time_ns FROM o
        UNION ALL SELECT o.probe_id, off + 2, 0, 'clock', 2, NULL, NULL, src_probe, CAST({_packed('src_ticks')} AS BIGINT), NULL FROM o JOIN edges ON edges.pos = o.pos""",
    "causal_order": f"""WITH RECURSIVE {_SCRIPT}, {_HEARD}, p AS (SELECT a.pos, b.pos AS other, a.probe_id AS pa, a.ticks AS ta, b.probe_id AS pb, b.ticks AS tb FROM seg a JOIN seg b ON b.pos = (a.pos * {STEP} + 1) % (SELECT max(pos) + 1 FROM seg))
        SELECT pos, other, CASE WHEN pa = pb THEN CASE WHEN ta < tb THEN 'before' WHEN ta > tb THEN 'after' ELSE 'same' END WHEN x.ticks <= tb THEN 'before' WHEN y.ticks <= ta THEN 'after' ELSE 'concurrent' END AS relation
        FROM p LEFT JOIN told x ON x.probe_a = pa AND x.ticks_a = ta AND x.probe_id = pb LEFT JOIN told y ON y.probe_a = pb AND y.ticks_a = tb AND y.probe_id = pa""",
    "causal_reach": f"WITH RECURSIVE {_SCRIPT}, {_HEARD} SELECT s.probe_id, s.ticks, count(h.probe_id) AS n_heard FROM (SELECT DISTINCT probe_id, ticks FROM seg) s LEFT JOIN told h ON h.probe_a = s.probe_id AND h.ticks_a = s.ticks GROUP BY ALL",
    "frontier_fold": f"""WITH {_WRAPPING}, f AS (SELECT probe_id, neighbor_id, list_reduce(list({{'e': epoch, 't': ticks}} ORDER BY pos), lambda s, c:
        CASE WHEN c.e = s.e AND c.t = s.t THEN s WHEN s.e >= 65532 AND c.e <= 3 THEN c WHEN c.e * 65536 + c.t > s.e * 65536 + s.t THEN c ELSE s END) AS c FROM w GROUP BY probe_id, neighbor_id)
        SELECT probe_id, CAST(neighbor_id AS BIGINT) AS neighbor_id, c.e AS epoch, c.t AS ticks FROM f""",
    "frontier_of_interactions": f"WITH {_SCRIPT} SELECT dst_probe AS probe_id, src_probe AS neighbor_id, {_epoch('max(src_ticks)')} AS epoch, {_tick('max(src_ticks)')} AS ticks FROM edges GROUP BY dst_probe, src_probe",
    "frontier_capacity": f"WITH {_WRAPPING} SELECT probe_id, CAST(neighbor_id AS BIGINT) AS neighbor_id FROM (SELECT probe_id, neighbor_id, row_number() OVER (PARTITION BY probe_id ORDER BY min(pos), neighbor_id) AS r FROM w GROUP BY probe_id, neighbor_id) WHERE r < 3",
    "clock_next_prev": f"WITH {_PAIRS} SELECT event_id, epoch_a * 65536 + ticks_a AS word, CASE WHEN ticks_a = 65535 THEN (epoch_a + 1) % 65536 ELSE epoch_a END AS next_epoch, CASE WHEN ticks_a = 65535 THEN 1 ELSE ticks_a + 1 END AS next_ticks, CASE WHEN ticks_a = 0 THEN greatest(epoch_a - 1, 0) ELSE epoch_a END AS prev_epoch, CASE WHEN ticks_a = 0 THEN 0 ELSE ticks_a - 1 END AS prev_ticks, (epoch_a + 1000) % 65536 AS sum_epoch, epoch_a + 1000 > 65535 AS wrapped FROM p",
    "clock_unpack": f"SELECT event_id, ({_WORD}) >> 16 AS epoch, ({_WORD}) & 65535 AS ticks, {_WORD} AS word FROM events",
    "clock_compare": f"WITH {_PAIRS} SELECT event_id, CASE WHEN id_a = id_b THEN CAST(sign((epoch_a * 65536 + ticks_a) - (epoch_b * 65536 + ticks_b)) AS BIGINT) END AS by_clock, {_later('a', 'b')} AS a_later, {_later('b', 'a')} AS b_later, CASE WHEN id_a = id_b THEN CASE WHEN epoch_a * 65536 + ticks_a <> epoch_b * 65536 + ticks_b THEN CAST(sign((epoch_a * 65536 + ticks_a) - (epoch_b * 65536 + ticks_b)) AS BIGINT) ELSE CAST(sign(ticks_b - id_b) AS BIGINT) END END AS by_instant FROM p",
    "word_classify": f"WITH x AS (SELECT event_id, {_WORD} AS w FROM events), y AS (SELECT *, CASE WHEN (w & 3221225471) BETWEEN 1 AND {W.MAX_ID} THEN w & 3221225471 END AS e FROM x) SELECT event_id, w AS word, CASE WHEN w >> 29 = 7 THEN 'paired_time' WHEN w >> 30 = 3 THEN 'time' WHEN w >> 30 = 2 THEN 'clock' WHEN w >> 30 = 1 THEN 'event_payload' ELSE 'event' END AS kind, w & 2147483647 AS as_probe_id, e AS as_event_id, ((w & 536870911) << 32) + event_id AS as_time_ns, e BETWEEN {W.MAX_USER_EVENT + 1} AND {W.MAX_ID} AS internal FROM y",
    "word_encode": f"WITH x AS (SELECT event_id, event_id * {SPREAD} % {1 << 61} AS ns FROM events) SELECT event_id, event_id | 1073741824 AS payload_word, event_id | 2147483648 AS clock_word, (ns >> 32) | 3758096384 AS paired_high, ns & {_MASK} AS low, (ns >> 32) | 3221225472 AS unpaired_high FROM x",
    "id_validation": f"WITH x AS (SELECT event_id, event_id * {SPREAD} - {1 << 30} AS x, event_id % 4096 * {1 << 50} AS ns FROM events) SELECT event_id, CASE WHEN x BETWEEN 1 AND {W.MAX_ID} THEN x END AS probe_id, CASE WHEN x BETWEEN 1 AND {W.MAX_ID} THEN x END AS any_event_id, CASE WHEN x BETWEEN 1 AND {W.MAX_USER_EVENT} THEN x END AS user_event_id, CASE WHEN x NOT BETWEEN 1 AND {W.MAX_ID} THEN 'InvalidEventId' WHEN ns NOT BETWEEN 0 AND {W.MAX_NS} THEN 'InvalidWallClockTime' END AS error FROM x",
    "time_units": f"WITH {_SCRIPT} SELECT pos, time_ns, time_ns & {_MASK} AS low, time_ns >> 32 AS high, time_ns // 1000000000 AS secs, time_ns // 1000000 AS millis, time_ns // 1000 AS micros, CASE WHEN time_ns * 2 BETWEEN 0 AND {W.MAX_NS} THEN time_ns * 2 END AS doubled, (time_ns * 2) & {W.MAX_NS} AS doubled_truncated FROM ev",
    "time_regressions": f"WITH {_SCRIPT}, t AS (SELECT probe_id, pos, CASE WHEN pos % 10 = 0 THEN time_ns - 3600000000000 ELSE time_ns END AS time_ns FROM ev), m AS (SELECT *, max(time_ns) OVER (PARTITION BY probe_id ORDER BY pos) AS latest_ns FROM t) SELECT * FROM m WHERE time_ns < latest_ns",
    "payload_typed": f"WITH {_RAW} SELECT event_id, {_signed(8)} AS i8, x & 255 AS u8, {_signed(16)} AS i16, x & 65535 AS u16, {_signed(32)} AS i32, x AS u32, x <> 0 AS bool, CASE WHEN x >= 2147483648 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN ((x >> 23) & 255) = 255 THEN CASE WHEN (x & 8388607) = 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END WHEN ((x >> 23) & 255) = 0 THEN (x & 8388607)::DOUBLE / 8388608.0::DOUBLE * pow(2.0::DOUBLE, -126.0::DOUBLE) ELSE ((x & 8388607)::DOUBLE / 8388608.0::DOUBLE + 1.0::DOUBLE) * pow(2.0::DOUBLE, ((x >> 23) & 255)::DOUBLE - 127.0::DOUBLE) END AS f32 FROM r",
    "description_filled": f"WITH {_SCRIPT} SELECT pos, 'value was ' || payload_raw || ' cents' AS said FROM script WHERE op = 'event_payload'",
    "report_header": f"WITH {_SCRIPT}, {_REPORTS} SELECT probe_id, {_packed('ticks')} AS clock_word, seq_num, false AS persistent_epoch, CAST(1000 AS BIGINT) AS time_resolution, CAST(1 AS BIGINT) AS wall_clock_id, CAST(1 AS BIGINT) AS n_clocks, n AS n_log_entries, 41 + 4 * n AS bytes, CAST(NULL AS VARCHAR) AS error FROM rp",
    "report_errors": f"WITH {_SCRIPT}, {_REPORTS} SELECT (seq_num + probe_id) % 5 AS damage, CASE (seq_num + probe_id) % 5 WHEN 0 THEN 'MissingHeader' WHEN 1 THEN 'IncompletePayload' WHEN 2 THEN 'InvalidFingerprint' WHEN 3 THEN 'InvalidProbeId' END AS error, count(*) AS n FROM rp GROUP BY ALL",
    "entry_parse": f"WITH {_SCRIPT}, {_ENTRIES} SELECT probe_id, seq_num, kind, CAST(n_words AS BIGINT) AS n_words, CAST(event_id AS BIGINT) AS event_id, payload_raw, clock_probe_id, CAST(clock_word AS BIGINT) AS clock_word, time_ns FROM en",
    "report_frontier": f"WITH {_SCRIPT}, rf AS (SELECT probe_id, pos // {_BLOCK} AS seq_num, min(ticks - CASE WHEN {_TICKS} THEN 1 ELSE 0 END) AS before FROM seg GROUP BY ALL) SELECT seq_num, probe_id, {_epoch('before')} AS epoch, {_tick('before')} AS ticks FROM rf",
    "decoded_interactions": f"WITH {_SCRIPT} SELECT dst_probe, {_packed('dst_ticks')} AS dst_clock, src_probe, {_packed('src_ticks')} AS src_clock FROM edges",
    "decoded_timeline": f"""WITH {_SCRIPT}, nr AS (SELECT probe_id, pos // {SHORT_SPAN} AS stretch, row_number() OVER (PARTITION BY probe_id ORDER BY pos // {SHORT_SPAN}) - 1 AS seq_num, bool_or({_TICKS}) AS has_clock FROM seg GROUP BY probe_id, pos // {SHORT_SPAN}),
        kept AS (SELECT *, seq_num - lag(seq_num, 1, -1) OVER (PARTITION BY probe_id ORDER BY seq_num) > 1 AS lost FROM nr WHERE (seq_num + probe_id) % 3 <> 0),
        anchored AS (SELECT *, coalesce(last_value(CASE WHEN has_clock THEN true WHEN lost THEN false END IGNORE NULLS) OVER (PARTITION BY probe_id ORDER BY seq_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AND NOT lost AS carried FROM kept),
        placed AS (SELECT tl.*, seq_num, carried OR max(CASE WHEN {_TICKS} THEN 1 ELSE 0 END) OVER (PARTITION BY tl.probe_id, seq_num ORDER BY pos) = 1 AS known FROM tl JOIN anchored a ON a.probe_id = tl.probe_id AND a.stretch = tl.pos // {SHORT_SPAN}),
        decoded AS (SELECT probe_id, seq_num, CASE op WHEN 'event_time' THEN 'event' WHEN 'event_payload_time' THEN 'event_payload' WHEN 'produce' THEN 'clock' WHEN 'merge' THEN 'clock' ELSE op END AS kind, CASE WHEN NOT {_TICKS} THEN CAST(event_id AS BIGINT) END AS event_id,
            CASE WHEN op IN ('event_payload', 'event_payload_time') THEN payload_raw & {_MASK} END AS payload_raw, CASE WHEN {_TICKS} THEN probe_id END AS clock_probe_id, CASE WHEN {_TICKS} THEN CAST({_packed('ticks')} AS BIGINT) END AS clock_word,
            CASE WHEN op IN ('event_time', 'event_payload_time') THEN time_ns END AS time_ns, CAST({_packed('ticks')} AS BIGINT) AS clock_at, CASE WHEN known THEN event_count END AS event_count FROM placed
            UNION ALL SELECT p.probe_id, seq_num, 'clock', NULL, NULL, src_probe, CAST({_packed('src_ticks')} AS BIGINT), NULL, CAST({_packed('p.ticks')} AS BIGINT), event_count FROM placed p JOIN edges e ON e.pos = p.pos) SELECT * FROM decoded""",
    "event_dedupe": f"WITH {_SCRIPT}, e AS (SELECT probe_id, ticks AS clock_at, CASE WHEN event_count % 5 <> 0 THEN event_count END AS event_count, probe_id % 2 = 0 AS persistent_epoch FROM tl WHERE NOT {_TICKS}), d AS (SELECT * FROM e UNION ALL SELECT * FROM e WHERE clock_at < 2) SELECT * FROM d WHERE persistent_epoch OR event_count IS NULL UNION ALL SELECT DISTINCT * FROM d WHERE NOT persistent_epoch AND event_count IS NOT NULL",
    "log_as_of": f"WITH {_SCRIPT}, l AS (SELECT probe_id, ticks, event_count - 3 + pos % 7 AS event_count, 'error at ' || pos AS line FROM tl WHERE op = 'event') SELECT l.probe_id, l.ticks, l.event_count, line, max(tl.pos) AS pos FROM l LEFT JOIN tl ON tl.probe_id = l.probe_id AND tl.ticks = l.ticks AND tl.event_count <= l.event_count GROUP BY ALL",
    "time_domains": f"WITH {_SCRIPT} SELECT DISTINCT dst_probe, src_probe, (dst_probe // 2 % 4 = src_probe // 2 % 4 AND dst_probe // 2 % 4 <> 0) OR dst_probe = src_probe AS comparable, dst_probe // 2 % 4 = 0 AS local_only, dst_probe % 3 = 0 AS unspecified FROM edges",
    "time_contradictions": f"""WITH {_SCRIPT}, {_TIMED}, s AS (SELECT probe_id, ticks, domain, min(time_ns) AS lo, max(time_ns) AS hi, probe_id % 3 * 1000 AS res FROM td GROUP BY ALL)
        SELECT dst_probe, {_packed('dst_ticks')} AS dst_clock, src_probe, {_packed('src_ticks')} AS src_clock, a.domain, a.hi AS src_ns, b.lo AS dst_ns FROM edges JOIN s a ON a.probe_id = src_probe AND a.ticks = src_ticks JOIN s b ON b.probe_id = dst_probe AND b.ticks = dst_ticks AND a.domain = b.domain WHERE a.hi > b.lo + a.res + b.res""",
    "close_times": f"WITH {_SCRIPT}, {_TIMED} SELECT a.pos AS id_a, b.pos AS id_b, b.time_ns - a.time_ns AS apart_ns FROM td a JOIN td b ON a.domain = b.domain AND a.probe_id <> b.probe_id AND b.time_ns BETWEEN a.time_ns AND a.time_ns + 600000000000 AND (b.time_ns > a.time_ns OR a.pos < b.pos)",
    "report_restarts": f"""WITH {_SCRIPT}, nr AS (SELECT probe_id, row_number() OVER (PARTITION BY probe_id ORDER BY pos // {SHORT_SPAN}) - 1 AS nth FROM seg GROUP BY probe_id, pos // {SHORT_SPAN}),
        k AS (SELECT probe_id, nth, nth % (4 + probe_id % 3) AS seq_num, nth // (4 + probe_id % 3) + probe_id AS epoch FROM nr WHERE (nth + probe_id) % 3 <> 0),
        c AS (SELECT *, CASE WHEN seq_num < lag(seq_num) OVER (PARTITION BY probe_id ORDER BY nth) THEN 1 ELSE 0 END AS again FROM k),
        r AS (SELECT *, CAST(sum(again) OVER (PARTITION BY probe_id ORDER BY nth) AS BIGINT) AS restart_no FROM c)
        SELECT probe_id, nth, seq_num, restart_no, first_value(epoch) OVER (PARTITION BY probe_id, restart_no ORDER BY nth) AS start_epoch FROM r""",
    "marked_interactions": f"WITH {_SCRIPT} SELECT dst_probe, CASE WHEN pos % 7 <> 0 THEN {_packed('dst_ticks')} END AS dst_clock, src_probe, {_packed('src_ticks')} AS src_clock, CASE WHEN pos % 7 <> 0 THEN pos % 3 <> 0 END AS adjacent FROM edges",
    "internal_events": f"WITH {_SCRIPT} SELECT probe_id, CASE pos % 5 WHEN 0 THEN 'invalid_next_epoch' WHEN 1 THEN 'items_missed' ELSE 'time_only' END AS meaning, count(*) AS n, CAST(sum(CASE WHEN pos % 5 = 1 THEN pos % 1000 ELSE 0 END) AS BIGINT) AS carried FROM seg WHERE pos % 5 < 3 GROUP BY ALL",
    "self_snapshots": f"WITH {_SCRIPT}, s AS (SELECT * FROM script WHERE op <> 'merge' OR pos % 4 <> 0) SELECT probe_id, pos, op, CAST(sum(CASE WHEN {_TICKS} THEN 1 ELSE 0 END) OVER (PARTITION BY probe_id ORDER BY pos) AS BIGINT) AS ticks FROM s",
    "error_summary": f"""WITH {_SCRIPT}, {_REPORTS}, x AS (SELECT event_id * {SPREAD} - {1 << 30} AS x, event_id % 4096 * {1 << 50} AS ns FROM events),
        e AS (SELECT CASE (seq_num + probe_id) % 3 WHEN 0 THEN 'MissingHeader' WHEN 1 THEN 'IncompletePayload' END AS error FROM rp
              UNION ALL SELECT CASE WHEN x NOT BETWEEN 1 AND {W.MAX_ID} THEN 'InvalidEventId' WHEN ns NOT BETWEEN 0 AND {W.MAX_NS} THEN 'InvalidWallClockTime' END FROM x
              UNION ALL SELECT CASE WHEN probe_id % 2 = 0 AND pos % 4 = 0 THEN 'InvalidNextEpoch' END FROM script WHERE op = 'produce')
        SELECT CASE error WHEN 'MissingHeader' THEN 'report' WHEN 'IncompletePayload' THEN 'report' WHEN 'InvalidEventId' THEN 'id' WHEN 'InvalidWallClockTime' THEN 'time' ELSE 'restart' END AS found_in, error, error <> 'MissingHeader' AS readable, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY ALL""",
    "le_numbers": f"SELECT event_id, {_WORD} & 65535 AS u16, {_WORD} AS u32, CAST(CAST({_WORD} AS HUGEINT) * {1 << 32} + event_id * {STEP} % {1 << 32} AS VARCHAR) AS u64 FROM events",
    "snapshot_codec": f"WITH {_SCRIPT}, s AS (SELECT pos, probe_id, {_epoch('(ticks - 1)')} AS epoch, {_tick('(ticks - 1)')} AS ticks FROM seg WHERE op = 'produce') SELECT pos, {_le('probe_id', 4)} || {_le('ticks', 2)} || {_le('epoch', 2)} || '00000000' AS bytes, probe_id, epoch, ticks, CAST(NULL AS VARCHAR) AS error FROM s",
    "report_gap": f"WITH {_SCRIPT}, {_report_rows(SHORT_SPAN)}, g AS (SELECT probe_id, seq_num, seq_num - lag(seq_num, 1, -1) OVER (PARTITION BY probe_id ORDER BY seq_num) - 1 AS missing FROM rp WHERE (seq_num + probe_id) % 3 <> 0) SELECT * FROM g WHERE missing > 0",
    "report_dedupe": "WITH r AS (SELECT user_id AS probe_id, event_id % 2 AS epoch, event_id % 7 AS seq_num, user_id % 2 = 0 AS persistent_epoch FROM events) SELECT DISTINCT * FROM r WHERE persistent_epoch UNION ALL SELECT * FROM r WHERE NOT persistent_epoch",
    "expectations": f"WITH {_SCRIPT}, t AS (SELECT event_id, CASE WHEN pos % 9 = 0 THEN 0 ELSE payload_raw END AS payload FROM script WHERE NOT {_TICKS}) SELECT CAST(event_id AS BIGINT) AS event_id, CASE event_id WHEN 5 THEN 'view has a value' WHEN 3 THEN 'sale' ELSE 'error' END AS name, CASE event_id WHEN 2 THEN 0 ELSE count(*) END AS expected, CASE event_id WHEN 2 THEN 0 ELSE count(*) FILTER (payload = 0) END AS unmet, CASE event_id WHEN 5 THEN 0 ELSE count(*) END AS failures FROM t WHERE event_id IN (2, 3, 5) GROUP BY event_id",
    "log_correlation": f"WITH {_SCRIPT} SELECT probe_id, ticks, event_count, 'error at ' || pos AS line, pos FROM tl WHERE op = 'event'",
    "restart_epochs": f"WITH {_SCRIPT}, c AS (SELECT probe_id, pos, row_number() OVER (PARTITION BY probe_id ORDER BY pos) - 1 AS call_no FROM script WHERE op = 'produce') SELECT probe_id, call_no, CASE WHEN probe_id % 2 <> 0 THEN call_no % 65536 WHEN pos % 4 = 0 THEN 0 ELSE call_no + 100 END AS epoch, probe_id % 2 = 0 AND pos % 4 = 0 AS invalid FROM c",
    "stream_entries": f"""WITH {_SCRIPT}, r AS (SELECT *, pos // {_BLOCK} AS seq_num, sum(n_words) OVER (PARTITION BY probe_id, pos // {_BLOCK} ORDER BY pos) - n_words AS off, sum(n_words) OVER (PARTITION BY probe_id, pos // {_BLOCK}) AS n FROM seg),
        e AS (SELECT probe_id, seq_num, off, n, CASE WHEN {_TICKS} THEN 2 ELSE n_words END AS size, CASE op WHEN 'event_time' THEN 'event' WHEN 'event_payload_time' THEN 'event_payload' WHEN 'produce' THEN 'clock' WHEN 'merge' THEN 'clock' ELSE op END AS kind,
            CASE WHEN NOT {_TICKS} THEN event_id END AS event_id, CASE WHEN op IN ('event_payload', 'event_payload_time') THEN payload_raw & {_MASK} END AS payload_raw, CASE WHEN {_TICKS} THEN probe_id END AS clock_probe_id,
            CASE WHEN {_TICKS} THEN {_packed('ticks')} END AS clock_word, CASE WHEN op IN ('event_time', 'event_payload_time') THEN time_ns END AS time_ns FROM r
            UNION ALL SELECT r.probe_id, r.seq_num, off + 2, n, 2, 'clock', NULL, NULL, src_probe, {_packed('src_ticks')}, NULL FROM r JOIN edges ON edges.pos = r.pos),
        h AS (SELECT probe_id, seq_num, greatest(n // 3, 1) AS h1, coalesce(min(off) FILTER (3 * off >= 2 * n), n) AS h2 FROM e GROUP BY probe_id, seq_num, n),
        c AS (SELECT e.*, h1, h2 FROM e JOIN h USING (probe_id, seq_num))
        SELECT probe_id, CAST(0 AS BIGINT) AS missed, kind, CAST(size AS BIGINT) AS n_words, CAST(event_id AS BIGINT) AS event_id, payload_raw, clock_probe_id, CAST(clock_word AS BIGINT) AS clock_word, time_ns FROM c WHERE probe_id % 4 <> 1 OR off + size <= h1 OR off >= h2
        UNION ALL SELECT probe_id, CAST(h2 - coalesce(max(off + size) FILTER (off + size <= h1), 0) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM c WHERE probe_id % 4 = 1 AND h2 > h1 GROUP BY probe_id, seq_num, h1, h2""",
}

# Streams end with the rows of what they follow.
ORACLE_SQL |= {"stream_reordered": ORACLE_SQL["stream_entries"], "live_timeline": ORACLE_SQL["decoded_timeline"], "live_frontier": ORACLE_SQL["frontier_fold"], "stream_gaps": ORACLE_SQL["report_gap"], "capture_reports": ORACLE_SQL["report_header"]}
