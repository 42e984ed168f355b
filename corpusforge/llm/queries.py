"""Registered queries of the operators: ``QUERIES`` and, where SQL can say the same, ``SQL``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import (bpe_codec, decontaminate, exact_dedup, hard_negatives, html_extract, ngram_join, pair_index, pii, quality,
                             rotated_clusters, sharding, toxicity, warc)
from corpusforge.llm.common import read, stored

# Scores from here on count as label 1.
THRESHOLD = 0.3
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PAIR_VOCABULARY = "byte_bpe_50k.json"


def codec() -> bpe_codec.Codec:
    import public_tokenizers

    return bpe_codec.Codec.from_file(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def encoded_digests(docs: DataFrame) -> DataFrame:
    c = codec()
    # in one stage both steps would hold a Python worker per task each, and the workers, which change places, the tables of both
    both = bpe_codec.decode(stored(bpe_codec.encode(docs, c), "token-ids", "zstd"), c)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items found in every document."""
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its validated numbers and dates under pseudonyms (by a key that is only for show)."""
    return pii.pseudonymise(read(spark, sf_dir, "documents"), b"corpusforge demonstration key")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of the ids and of the decoded bytes."""
    return encoded_digests(read(spark, sf_dir, "documents"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits among the captures of all pages, resolved; headers as sorted ``name: value`` lines."""
    out = warc.resolve_revisits(warc.captures(read(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return out.withColumn("headers", F.array_join(lines, "\n"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document after its obfuscated words are restored."""
    out = toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document: which row stays, and the size of its group."""
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"), hash_all=True)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of at least 0.75 on 5-word shingles."""
    return ngram_join.similar_components(read(spark, sf_dir, "documents"))


def op9_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards with near equal bytes, tokens and rows; equal texts share a shard."""
    out = sharding.shard(read(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                      "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    out = quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("text_key")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; a seventh of the vectors first take the next label."""
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the pair occurrence index and decoded; digests of the ids and of the decoded text."""
    import public_tokenizers

    return pair_index.decimal_digests(read(spark, sf_dir, "documents"), pair_index.Vocabulary.from_file(public_tokenizers.path(PAIR_VOCABULARY)))


def op13_rotated_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of all vectors, three rounds."""
    return rotated_clusters.clusters(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_pii": op2_pii,
    "op3_main_text": op3_main_text,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_toxicity": op6_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_ngram_join": op8_ngram_join,
    "op9_vector_shards": op9_vector_shards,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_pair_index_bpe": op12_pair_index_bpe,
    "op13_rotated_clusters": op13_rotated_clusters,
}

def _clusters_sql(rounds: int = 3) -> str:
    """The rounds one after another, a vector's components as rows."""
    parts = ["""
        WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
                  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        part AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS i, unnest(v) AS x FROM kept),
        c0 AS MATERIALIZED (SELECT k, unnest(range(1, 65)) AS i, unnest(v) AS c
                  FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, v FROM kept QUALIFY k < 16))"""]
    for n in range(rounds + 1):
        parts.append(f"""
        a{n} AS MATERIALIZED (SELECT r, min(d) AS distance, arg_min(k, (d, k)) AS cluster
                  FROM (SELECT r, k, sum((x - c) * (x - c))::BIGINT AS d FROM part JOIN c{n} USING (i) GROUP BY r, k) GROUP BY r)""")
        if n < rounds:
            parts.append(f"""
        c{n + 1} AS MATERIALIZED (SELECT k, i, coalesce((s - ((s % m) + m) % m) // m, c)::BIGINT AS c FROM c{n} LEFT JOIN
                  (SELECT cluster AS k, i, sum(x)::BIGINT AS s, count(*) AS m FROM a{n} JOIN part USING (r) GROUP BY cluster, i) USING (k, i))""")
    return ",".join(parts) + f"""
        SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
               sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
        FROM a{rounds} JOIN kept USING (r)
             JOIN (SELECT k AS cluster, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k) USING (cluster)
    """


_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL = {
    "op1_decontamination": f"""
        WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
        item_windows AS (SELECT DISTINCT item_id, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS words
                         FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        doc_windows AS (SELECT doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS words
                        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
        hits AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, words)),
        covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        listed AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
                   FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
    """,
    "op11_hard_negatives": """
        WITH t AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (SELECT a.vec_id AS anchor_id, t.vec_id AS id, a.label = t.label AS same, list_inner_product(a.v, t.v)::BIGINT AS score
              FROM t a JOIN t ON a.vec_id % 50 = 0 AND a.vec_id <> t.vec_id),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
               id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3
    """,
    "op13_rotated_clusters": _clusters_sql(),
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
