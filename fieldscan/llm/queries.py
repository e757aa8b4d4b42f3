"""The registered queries of this package and the SQL their results must equal."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, gnat, jaccard, linedup, maxent, nbest, repair, simhash, tokencounts, topk, toxicity, trie, warc
from .common import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v b ON q.vec_id <> b.vec_id
  WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
""")
def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors, by integer inner product, of every vector whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK_WORDS = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


@register(f"""
WITH RECURSIVE d AS (SELECT doc_id, {_BLANK_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, min(y)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON doc_id = x GROUP BY doc_id, n.n
""")
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every text: five-word shingles, similarity of 0.75 or more."""
    return jaccard.similar(table(spark, sf_dir, "documents"))


@register()
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup takes out of every text and what it leaves, as size and digest."""
    found = linedup.dedup_lines(table(spark, sf_dir, "documents"))
    lines = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    return found.select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_chunks_removed"), lines.alias("n_lines_removed"),
        F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"),
    )


@register()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text, through a digest cache that starts empty."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), path, new_folder(spark, "token-cache"))


@register()
def op5_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every text, written to files compressed by Re-Pair and read back."""
    path = new_folder(spark, "ids")
    repair.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return repair.digests(repair.read_blocks(spark, path))


@register()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every text, learned from the labels of three quarters of the ids."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register()
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of every text under the maximum-entropy model of nine tenths of them."""
    return maxent.score(table(spark, sf_dir, "documents"))


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


@register(f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(0, len(w) - least(10, len(w)) + 1) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
spans AS (
  SELECT k, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM d, sizes, unnest(range(1, len(w) - CAST(n AS BIGINT) + 2)) t(i) WHERE len(w) >= n),
found AS (SELECT k, i, spans.n, item FROM spans JOIN win ON spans.win = win.win AND spans.n = win.n),
hit AS (SELECT k, count(DISTINCT i + j) AS n_hit FROM found, unnest(range(0, n)) t(j) GROUP BY k),
items AS (
  SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT k, item FROM found) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN items USING (k)
""")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every text lie in a ten-word window of a benchmark item."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
g AS (SELECT html, max(page_id) AS answer, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT page_id, payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN page_id < answer THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < answer THEN answer END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html AND payload_bytes >= 1000
""")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives with revisit records, and read back."""
    found = warc.archive_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register()
def op10_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best segmentations of every text into pieces, each as a digest (null for none), their scores, and decoding."""
    found = nbest.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"], with_ids=False)
    digest = lambda k: F.get("digests", F.lit(k))
    return found.select(
        "row.doc_id", "n_pieces", digest(0).alias("ids_crc32"), digest(1).alias("second_ids_crc32"), digest(2).alias("third_ids_crc32"),
        F.element_at("scores", 1).alias("best_score"), F.element_at("scores", -1).alias("last_score"), F.size("scores").cast("long").alias("n_best"), "decodes",
    )


@register("""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows of another label for each of the five best positives of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return gnat.hard_negatives(vectors, F.col("vec_id") % 50 == 0, gnat.changed_label(F.col("vec_id"), F.col("label")))


# The checksum of a decimal id, bit by bit: eight steps a character.
_STEP = "(CASE WHEN i % 8 = 0 THEN xor(crc, ascii(substr(id, i // 8 + 1, 1))) ELSE crc END)"
_CRC32 = f"""xor(4294967295, list_reduce(range(0, 8 * length(id)),
  lambda crc, i: xor({_STEP} >> 1, CASE WHEN ({_STEP} & 1) = 1 THEN 3988292384 ELSE 0 END), 4294967295))"""


@register(f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS turn
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS id, list(turn ORDER BY i) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, {_CRC32} % 6 AS h FROM c),
r AS (
  SELECT h.conv_id, list_concat(coalesce(c.own[1 : h], []), h.own[h + 1 :]) AS turns
  FROM h LEFT JOIN c ON c.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d AS depth, turns[1 : d] AS pre, len(turns) = d AS ends FROM r, unnest(range(0, len(turns) + 1)) u(d)),
n AS (
  SELECT depth, pre, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(length(pre[depth].text), 0) AS points,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS ids
  FROM p GROUP BY depth, pre),
k AS (SELECT depth - 1 AS depth, pre[1 : depth - 1] AS pre, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, pre)),
s AS (
  SELECT p.depth, p.pre, sum((f.n_convs - 1) * f.points) AS saved_tokens, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves
  FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.depth, p.pre)
SELECT f.conv_id, f.depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(f.ids, '')) AS ends_sha256
FROM f JOIN s USING (depth, pre) LEFT JOIN n up ON up.depth = f.depth - 1 AND up.pre = f.pre[1 : f.depth - 1]
""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


@register()
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every text and its component: fingerprints of at most three differing bits link."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))
