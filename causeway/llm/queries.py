"""The operators as registered queries, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import context_tree, decontamination, line_dedup, nn_descent, pii, prefix_trie, rule_ensemble, sentencepiece_codec, simhash_dedup, spelling, substring_dedup, token_store, warc_store
from causeway.llm._common import Tables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), piece_model())
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join("ids", ",")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"), sha(F.array_join("ends", ",")).alias("ends_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.array_remove(F.transform("base", lambda s: s["kind"] == kind), False)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(said(F.col("base")).cast("binary"), 256).alias("base_sha256"), said(F.concat("base", "added")).alias("spans"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(_table(spark, sf_dir, "documents"))


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.neighbours(_table(spark, sf_dir, "embeddings"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "warc")
    manifest = tables.put(warc_store.write(_table(spark, sf_dir, "pages"), f"{tables.root}/archives"))
    return warc_store.read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def byte_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "turns")
    given = _table(spark, sf_dir, "conversations")
    turns = tables.put(prefix_trie.with_lent_turns(tables.put(prefix_trie.symbols(given, tables))))
    every = given.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return prefix_trie.with_ends(*prefix_trie.trie(turns, every))


def op13_repair_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "ids")
    manifest = tables.put(token_store.write(_table(spark, sf_dir, "documents"), f"{tables.root}/files", byte_model()))
    ids = F.col("ids")
    return token_store.read(manifest).select("doc_id", "start", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.crc32(ids).alias("ids_crc32"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


# CRC-32 of decimal numbers: its table, and the fold of a text's characters.
_CRC = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps)"""
_TRIE = f"""
WITH {_CRC},
t AS (SELECT conv_id, sym, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sym) AS k FROM (
      SELECT conv_id, turn, left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS sym,
             len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x) + 1), lambda i: ascii(x[i]))), lambda s, b: xor(s >> 8, steps[(xor(s, b) & 255) + 1])), 4294967295) % 4 AS h
      FROM (SELECT conv_id, conv_id::VARCHAR AS x, count(*) AS n FROM t GROUP BY ALL), crc),
r AS (SELECT c.conv_id, k AS d, sym, words FROM c JOIN t ON t.conv_id = c.base AND k <= h
      UNION ALL SELECT c.conv_id, k - c.h + least(c.h, coalesce(b.n, 0)), sym, words FROM c JOIN t ON t.conv_id = c.conv_id AND k > c.h LEFT JOIN c b ON b.conv_id = c.base),
m AS (SELECT conv_id, d, words, sha256(string_agg(sym, '') OVER (PARTITION BY conv_id ORDER BY d)) AS key FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
ends AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT conv_id, arg_max(key, d) AS key FROM m GROUP BY conv_id) GROUP BY key),
n AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM m GROUP BY key, d),
p AS (SELECT n.*, up.key AS parent, a.conv_id AS parent_conv_id FROM n LEFT JOIN m up ON up.conv_id = n.conv_id AND up.d = n.d - 1 LEFT JOIN n a ON a.key = up.key),
k AS (SELECT parent AS key, count(*) AS n_children FROM p WHERE parent IS NOT NULL GROUP BY parent),
s AS (SELECT m.key, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * n.words) AS saved FROM n LEFT JOIN k ON k.key = n.key JOIN m ON m.conv_id = n.conv_id AND m.d <= n.d GROUP BY m.key)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM p JOIN s ON s.key = p.key LEFT JOIN k ON k.key = p.key LEFT JOIN ends ON ends.key = p.key"""

ORACLE_SQL: dict[str, str] = {
    "op11_prefix_trie": _TRIE,
    "op10_warc_store": """
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
               CASE WHEN page_id = keeper OR octet_length(encode(coalesce(html, ''))) < 1000 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = keeper OR octet_length(encode(coalesce(html, ''))) < 1000 THEN NULL ELSE keeper END AS refers_to
        FROM (SELECT page_id, html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages)""",
}
