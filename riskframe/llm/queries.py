"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import bpe, centroids, decontaminate, html_text, licenses, ngram_join, phrases, pii, quality, secret_scan, sentence_piece, topk, toxicity
from riskframe.llm.tables import fold, labelled, read

#: Labelled rows that the two classifiers may be fitted on.
MOST_LABELS = 20_000
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
THRESHOLD = 0.3


def scored(docs: DataFrame, held: int, n: int) -> DataFrame:
    held_out = F.coalesce(fold(F.col("doc_id"), n) == held, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labelled(read(spark, sf_dir, "labels"), "toxic", 4, 2, MOST_LABELS))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scored(toxicity.score(docs, toxicity_model(spark, sf_dir, docs)), 2, 4)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_hash")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(read(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, labelled(read(spark, sf_dir, "labels"), "quality", 5, 0, MOST_LABELS))
    return scored(quality.score(docs, model), 0, 5)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents have no paths: source and language stand for their directories."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan_licenses(read(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(read(spark, sf_dir, "documents")).drop("text_hash", "component_key")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, with_ids=False)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op13_sentence_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_piece.encode(read(spark, sf_dir, "documents"), PIECES, with_ids=False)


def queries() -> dict:
    each = (op1_toxicity, op2_pii, op3_decontamination, op4_secrets, op5_html_text, op6_quality, op7_licenses, op8_ngram_join, op9_bpe, op10_topk, op11_centroids, op12_phrases, op13_sentence_piece)
    return {f.__name__: f for f in each}


DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT item_id, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i, w FROM b WHERE len(w) > 0
), g AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM bw
), dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n
), h AS (
  SELECT dw.doc_id, dw.i, dw.n, g.item_id FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM dw) dw JOIN g ON g.n = dw.n AND g.gram = dw.gram
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""

NGRAM_JOIN_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)
), r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other
)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), t AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 10
"""


CENTROIDS_SQL = (
    """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS c, e AS m FROM v ORDER BY sha256('2:' || vec_id) LIMIT 40
)"""
    + "".join(
        f""", a{i} AS MATERIALIZED (
  SELECT vec_id, e, min(struct_pack(d := CAST(list_sum(list_transform(range(1, 65), lambda i: (e[i] - m[i]) * (e[i] - m[i]))) AS BIGINT), c := c)) AS b FROM v, c{i} GROUP BY vec_id, e
), s{i} AS (
  SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT b.c AS c, unnest(range(1, 65)) AS i, unnest(e) AS x FROM a{i}) GROUP BY c, i
), c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(w.m, c{i}.m) AS m FROM c{i} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{i} GROUP BY c) w ON w.c = c{i}.c
)"""
        for i in range(6)
    )
    + """
SELECT a5.vec_id, b.c AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c5.m, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON c5.c = b.c
"""
)

PHRASES_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p
), m AS (
  SELECT lang, w, unnest(range(1, 6)) AS m FROM w WHERE len(w) > 0
), g AS (
  SELECT lang, m, list_slice(w, i, i + m - 1) AS g FROM (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM m WHERE len(w) >= m)
), f AS MATERIALIZED (
  SELECT lang, m, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100
), n AS (
  SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang
), c AS (
  SELECT lang, m, g, f AS a, unnest(range(1, m)) AS k FROM f WHERE m > 1
), s AS (
  SELECT c.lang, c.m, c.g, c.a, k, x.f AS l, y.f AS r, n.n, 1000 * CAST(a AS HUGEINT) * n.n // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:c.m] JOIN n ON n.lang = c.lang
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), i AS (
  SELECT DISTINCT lang, g[i : i + d - 1] AS g, f FROM (SELECT lang, m, g, f, d, unnest(range(1, m - d + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS d FROM f WHERE m > 2))
), o AS (
  SELECT lang, g, max(f) AS f FROM i GROUP BY ALL
), t AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = b.g WHERE 100 * coalesce(o.f, 0) < 100 * a
)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": DECONTAMINATION_SQL, "op8_ngram_join": NGRAM_JOIN_SQL, "op10_topk": TOPK_SQL, "op11_centroids": CENTROIDS_SQL, "op12_phrases": PHRASES_SQL}
