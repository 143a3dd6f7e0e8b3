"""The queries opN_<name> with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ctph, hilbert, langid, lsa, negatives, secret_ledger, simhash, substrings, suffixes, toxicity, urltree, whitening
from .common import table


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard_documents(table(spark, sf_dir, "documents"))


def op2_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op4_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_hyperdimensional_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op7_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsa.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(table(spark, sf_dir, "pages"))


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.scan_documents(table(spark, sf_dir, "documents"), secret_ledger.ledger_path(spark))


def op11_distance_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), "vec_id % 100 = 0")


def op12_induced_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op13_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.long_form(whitening.whiten(table(spark, sf_dir, "embeddings")))


QUERIES = {f.__name__: f for f in (op1_hilbert_shards, op2_ctph, op3_bpe, op4_weak_toxicity, op5_hyperdimensional_lang, op6_fm_substrings, op7_covering_simhash, op8_latent_leaks, op9_template_tree, op10_secret_ledger, op11_distance_keys, op12_induced_suffixes, op13_exact_whitening)}

#: The others are beyond SQL: CRC-32, XXH64, tokenizers, training, graphs, eigenvectors, and the places of pattern matches.
ORACLE_SQL: dict[str, str] = {
    # Windows by the digest of their words; all but the first of each are gone with the words that they cover.
    "op6_fm_substrings": r"""WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i+19], ' ')) AS k FROM d, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS i) WHERE len(w) >= 20),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late) GROUP BY 1),
pos AS (SELECT d.doc_id, unnest(d.w) AS word, unnest(range(1, len(d.w) + 1)) AS p FROM d JOIN gone USING (doc_id)),
kept AS (SELECT pos.doc_id, array_to_string(list(word ORDER BY pos.p), ' ') AS t, count(*) AS n FROM pos ANTI JOIN (SELECT doc_id, unnest(p) AS p FROM gone) g ON pos.doc_id = g.doc_id AND pos.p = g.p GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, CASE WHEN g.doc_id IS NULL THEN 0 ELSE len(d.w) - coalesce(k.n, 0) END::BIGINT AS n_removed,
sha256(CASE WHEN g.doc_id IS NULL THEN array_to_string(d.w, ' ') ELSE coalesce(k.t, '') END) AS kept_sha256 FROM d LEFT JOIN gone g USING (doc_id) LEFT JOIN kept k USING (doc_id)""",
    # All anchors' scores; positives by rank, then the band's first rows for each of them.
    "op11_distance_keys": """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS a, a.label = r.label AS alike, r.vec_id, list_dot_product(a.v, r.v)::BIGINT AS s FROM r AS a JOIN r ON a.vec_id % 100 = 0 AND (a.label <> r.label OR a.vec_id <> r.vec_id)),
p AS (SELECT a, vec_id, s FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, vec_id) <= 5)
SELECT p.a AS anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.vec_id ORDER BY s.s DESC, s.vec_id)::INT AS rank, s.vec_id AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.alike AND 80 * p.s <= 100 * s.s AND s.s <= p.s QUALIFY rank <= 5""",
    # Windows of 400 bytes as 800 hexadecimal digits; bytes under one that is there twice are gone.
    "op12_induced_suffixes": """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, o, h[2 * o + 1 : 2 * o + 998] AS h FROM d, LATERAL (SELECT unnest(range(0, len(h) // 2 - 399, 100)) AS o) WHERE len(h) >= 800),
w AS (SELECT r, o + i AS i, md5_number(h[2 * i + 1 : 2 * i + 800]) AS k FROM c, LATERAL (SELECT unnest(range(0, len(h) // 2 - 399)) AS i)),
m AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
b AS (SELECT r, i, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) > 400 AS new FROM m),
g AS (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS g FROM b),
s AS (SELECT r, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY r, g),
q AS (SELECT r, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a)::BIGINT AS n FROM s GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(len(a), 0)::BIGINT AS n_spans,
sha256(unhex(CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda k: h[2 * (CASE WHEN k = 0 THEN 0 ELSE z[k] END) + 1 : CASE WHEN k = len(a) THEN len(h) ELSE 2 * a[k + 1] END]), '') END)) AS kept_sha256
FROM d LEFT JOIN q USING (r)""",
}
