"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.workdir import new_dir

from . import bpe, decontaminate, jaccard, lexical, licenses, lloyd, quality, repeats, shards, topk, toxicity, urls, warc
from .sample import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
TOXIC_HELD_OUT = (5, 0)
QUALITY_HELD_OUT = (3, 1)
URL_RULES = (
    urls.rule("allow", "org/"),
    urls.rule("block", "example.org/es/"),
    urls.rule("block", "example.org/en/1"),
    urls.rule("allow", "com/fr/"),
    urls.rule("block", "com/de/"),
)
SHARDS = 24
CENTROIDS, ROUNDS = 16, 3


def _crc_entry(n: int) -> int:
    for _ in range(8):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


#: The checksum's table for the SQL, made from its polynomial.
CRC_TABLE = "[" + ", ".join(f"{_crc_entry(n)}::BIGINT" for n in range(256)) + "]"


def held_out(fold: tuple[int, int]):
    return F.coalesce(remainder(F.col("doc_id"), fold[0]) == fold[1], F.lit(False))


def judged(scores: DataFrame, fold: tuple[int, int], *more: str) -> DataFrame:
    predicted = (F.col("score") >= 0.5).cast("int")
    return scores.select("doc_id", held_out(fold).alias("held_out"), "score", predicted.alias("predicted"), *more)


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), ~held_out(TOXIC_HELD_OUT))
    return judged(toxicity.score(docs, model), TOXIC_HELD_OUT, F.size("offending").alias("n_offending"))


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "warc")
    listed = warc.write_archives(read(spark, sf_dir, "pages"), folder)
    return warc.read_archives(listed, folder).drop("url", "html")


@query
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents")).documents().drop("class_id")


@query
def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5, any_length=True)


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode_texts(docs, RANKS, PATTERN).drop("text")
    return bpe.with_digests(encoded, RANKS, PATTERN).drop("ids")


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), URL_RULES)


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source/lang/thousand/hundred/id.txt.

    Ids that end in 0 lie a level higher, those that end in 00 two levels.
    """
    n = F.col("doc_id")
    thousand, hundred = (F.concat(F.floor(n / k).cast("string"), F.lit("/")) for k in (1000, 100))
    below = F.when(n % 100 == 0, "").when(n % 10 == 0, thousand).otherwise(F.concat(thousand, hundred))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), below, n.cast("string"), F.lit(".txt"))
    return docs.select("doc_id", "text", path.alias("path"))


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that open or close with a notice are the licence files of their directories."""
    text = F.coalesce("text", F.lit(""))
    ends = F.concat_ws("\n", F.substring_index(text, "\n", 1), F.substring_index(text, "\n", -1))
    return licenses.scan(
        as_files(read(spark, sf_dir, "documents")), ends.rlike(licenses.HINT), kept=("doc_id", "path")
    )


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"), ~held_out(QUALITY_HELD_OUT))
    return judged(quality.score(docs, model), QUALITY_HELD_OUT, "n_passages", "top_passage")


@query
def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_by_bytes(read(spark, sf_dir, "documents"), SHARDS)


@query
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 50)


@query
def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(read(spark, sf_dir, "embeddings"), k=CENTROIDS, rounds=ROUNDS)


@query
def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(read(spark, sf_dir, "documents")).summary().drop("removed")


ORACLE["op2_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (
  SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS hex,
    max(page_id) OVER (PARTITION BY payload) AS original FROM p),
bits AS (
  SELECT *, list_reduce(list_transform(string_split(hex, ''), lambda x:
    substr('0000000100100011010001010110011110001001101010111100110111101111',
      4 * (strpos('0123456789abcdef', x) - 1) + 1, 4)), lambda a, b: a || b) AS b FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(b, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INT)
    + 4 * CAST(substr(b, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(b, 5 * i + 4, 1) AS INT)
    + CAST(substr(b, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM bits
"""

ORACLE["op4_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
    CAST(list_sum(list_transform(list_zip(q.x, d.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

ORACLE["op10_shards"] = f"""
WITH t AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h
  FROM documents),
crc AS (
  SELECT doc_id, size, CAST(xor(list_reduce(list_concat([4294967295::BIGINT],
    list_transform(regexp_extract_all(h, '..'), lambda b: CAST('0x' || b AS BIGINT))),
    lambda c, b: xor(c >> 8, ({CRC_TABLE})[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS BIGINT) AS text_crc32 FROM t),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS total FROM crc),
cut AS (
  SELECT *, CAST(least((2 * before + size) * {SHARDS} // (2 * total), {SHARDS} - 1) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""

ORACLE["op3_ngram_jaccard"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS shingle
  FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
overlap AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY 1, 2),
link AS (
  SELECT a, b FROM overlap JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * o >= 75 * (na.n + nb.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id,
  (SELECT count(*) FROM link WHERE link.a = d.doc_id) AS n_links
FROM d LEFT JOIN n USING (doc_id)
"""

ORACLE["op6_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS words
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS words
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(k) WHERE len(w) >= n),
hit AS (SELECT r.doc_id, r.k, r.n, x.item_id FROM runs r JOIN win x ON r.n = x.n AND r.words = x.words),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE["op13_repeats"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (
  SELECT doc_id, k, md5(array_to_string(w[k : k + 49], ' ')) AS run FROM d, unnest(range(1, len(w) - 48)) AS r(k)
  WHERE len(w) >= 50),
again AS (SELECT doc_id, k FROM (SELECT *, min(doc_id) OVER (PARTITION BY run) AS first FROM runs) WHERE first < doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(k, k + 50)) AS p FROM again) GROUP BY 1),
kept AS (
  SELECT d.doc_id, len(w) AS n, coalesce(len(p), 0) AS n_removed,
    coalesce((SELECT string_agg(word, ' ' ORDER BY i) FROM (SELECT unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i)
      WHERE p IS NULL OR NOT list_contains(p, i)), '') AS kept
  FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM kept
"""

ORACLE["op11_lexical"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
total AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS length FROM d WHERE len(w) > 0),
t AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM b) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, total),
part AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length))) AS part
  FROM tf JOIN weight USING (term), total),
score AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM b JOIN part USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
WHERE rank <= 50
"""


def _lloyd_sql(k: int, rounds: int) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS (
  SELECT vec_id, c, CAST(sum((v.x - m.x) * (v.x - m.x)) AS BIGINT) AS distance FROM v JOIN m{r} m USING (place) GROUP BY 1, 2),
n{r} AS (
  SELECT vec_id, c, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) AS k FROM d{r}) WHERE k = 1)""")
        if r < rounds:
            steps.append(f"""
t{r} AS (SELECT c, place, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM v JOIN n{r} USING (vec_id) GROUP BY 1, 2),
m{r + 1} AS (
  SELECT c, place, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM m{r} LEFT JOIN t{r} USING (c, place))""")
    return f"""
WITH kept AS (
  SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS (
  SELECT vec_id, unnest(range(64)) AS place,
    unnest(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS x FROM kept),
seed AS (
  SELECT vec_id, CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS c FROM kept),
m0 AS (SELECT c, place, x FROM v JOIN seed USING (vec_id) WHERE c < {k}),{",".join(steps)},
digest AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY place)) AS sha FROM m{rounds} GROUP BY 1)
SELECT vec_id, c AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM n{rounds} JOIN digest USING (c)
"""


ORACLE["op12_lloyd"] = _lloyd_sql(CENTROIDS, ROUNDS)
