"""The registered queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    collocations, exact_dedup, line_spread, mixing, multi_index, near_dedup, periodic_runs, pieces, repair_ids, secret_scan, sharding,
    token_counts, toxicity,
)
from .common import table


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def vocabulary(name: str) -> str:
    """A vocabulary file of the public tokenizers; its folder is a setting of the machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = repair_ids.write_blocks(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), base=50_257)
    return repair_ids.read_documents(stored)


def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def piece_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), sharding.tree(8), sharding.tree(9))


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_spread.drop_spread_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_periods(table(spark, sf_dir, "documents"))
    return periodic_runs.digest(periodic_runs.periodic_runs(docs))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_near_dedup": near_groups,
    "op2_repair_ids": token_ids,
    "op3_toxicity": toxic_scores,
    "op5_pieces": piece_digest,
    "op6_multi_index": neighbours,
    "op4_hash_tree_shards": shards,
    "op7_secret_spread": secret_spans,
    "op8_line_spread": line_dedup,
    "op9_source_mix": mixture,
    "op10_exact_dedup": exact,
    "op11_token_counts": token_lengths,
    "op12_periodic_runs": repetitions,
    "op13_collocations": phrases,
}

ORACLES = {
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op9_source_mix": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM s),
w AS (SELECT *, CAST([5, 2, 1][turn % 3 + 1] AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM r),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM w),
t AS (SELECT *, least(cap, coalesce(max(CASE WHEN cap / weight >= here THEN here END) OVER () * weight, cap)) AS target FROM l),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(least(t.target / nullif(t.source_size, 0), 3.0), 0) AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) +
  CASE WHEN (CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 1) / 4503599627370496.0::DOUBLE
    <= rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM x""",
    "op8_line_spread": r"""
WITH l AS (SELECT doc_id, coalesce(source, '<null>') AS site, UNNEST(string_split(coalesce(text, ''), chr(10))) AS line,
    UNNEST(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
b AS (SELECT trim(line) AS line, min((doc_id, pos)) AS first FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT site) >= 6),
m AS (SELECT l.*, b.line IS NOT NULL AND (l.doc_id, l.pos) <> b.first AS gone FROM l LEFT JOIN b ON trim(l.line) = b.line)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256
FROM m GROUP BY doc_id""",
    "op13_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, UNNEST(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (SELECT lang, UNNEST(words) AS w1, UNNEST(words[2:]) AS w2, UNNEST(words[3:]) AS w3 FROM w),
t AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS f FROM g GROUP BY ALL),
f1 AS MATERIALIZED (SELECT lang, w1, sum(f)::HUGEINT AS f FROM t GROUP BY ALL HAVING sum(f) >= 10),
f2 AS MATERIALIZED (SELECT lang, w1, w2, sum(f)::HUGEINT AS f FROM t WHERE w2 IS NOT NULL GROUP BY ALL HAVING sum(f) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM t GROUP BY lang),
c3 AS MATERIALIZED (SELECT lang, w1, w2, w3, f::HUGEINT AS a FROM t WHERE w3 IS NOT NULL AND f >= 10),
h AS (SELECT lang, w1, w2, max(a) AS over FROM (SELECT lang, w1, w2, a FROM c3 UNION ALL SELECT lang, w2, w3, a FROM c3) GROUP BY ALL),
two AS (SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, x.f AS l, y.f AS r, 1000000 * p.f * p.f // (x.f * y.f) AS score
  FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
  LEFT JOIN h ON h.lang = p.lang AND h.w1 = p.w1 AND h.w2 = p.w2 WHERE (h.over IS NULL OR 100 * h.over < 50 * p.f)),
cuts AS (SELECT c.*, x.f AS l1, y.f AS r1, u.f AS l2, v.f AS r2, 1000000 * a * a // (x.f * y.f) AS s1, 1000000 * a * a // (u.f * v.f) AS s2
  FROM c3 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  JOIN f2 u ON u.lang = c.lang AND u.w1 = c.w1 AND u.w2 = c.w2 JOIN f1 v ON v.lang = c.lang AND v.w1 = c.w3),
three AS (SELECT lang, w1 || ' ' || w2 || ' ' || w3 AS phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END AS l,
  CASE WHEN s1 <= s2 THEN r1 ELSE r2 END AS r, least(s1, s2) AS score FROM cuts),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM (SELECT * FROM two UNION ALL SELECT * FROM three))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM k JOIN n USING (lang) WHERE rank <= 2000""",
}
