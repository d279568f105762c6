"""The registered query of each operator: its production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorpool.llm import (
    archive,
    bpe,
    html_text,
    leaks,
    packing,
    periodic_runs,
    secret_scan,
    shards,
    shingle_join,
    token_counts,
    toxicity,
    vector_codes,
    vector_dedup,
)
from motorpool.llm.common import scratch, table

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "byte_bpe_50k.json"


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encoding_digests(docs, public_tokenizers.path(TOKENIZER))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"), 24)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that every distinct text is encoded."""
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path(TOKENIZER), scratch(spark, "token-cache"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads the result from the ordered index of the archives it has written."""
    pages = table(spark, sf_dir, "pages")
    archive.write(pages, archives := scratch(spark, "warc"))
    index = archive.merged_index(spark, archives, scratch(spark, "warc-runs"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_copies(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 1024 tokens, 128 segments and 1024 loss-bearing tokens at most."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def planted(docs: DataFrame) -> DataFrame:
    """The documents whose hash ends in 0 go on periodically from a word on; all others stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def periodic(words: Column) -> Column:
        g, n = F.floor(h / 10), F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(at, lambda i: F.get(words, i.cast("int"))), " ")

    # An array of one, so that the words are cut once.
    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise(text))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(text).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, some of which are made periodic first; the digests of the runs and of what is kept."""
    found = periodic_runs.periodic_runs(planted(table(spark, sf_dir, "documents")))
    order = lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))
    best = F.array_max(F.transform("runs", order))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select(
        "vec_id",
        F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"),
        "error",
        "label_error",
        F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"),
    )


# The digest's 40 hexadecimal digits are 160 bits: 32 digits of 5 bits.
OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS head FROM p
), b AS (
  SELECT page_id, payload_bytes, head,
    array_to_string(list_transform(range(0, 4), lambda q: array_to_string(list_transform(range(0, 8), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST((CAST('0x' || substr(hex, 1 + CAST(q AS INTEGER) * 10, 10) AS BIGINT) >> CAST(35 - 5 * i AS BIGINT)) & 31 AS INTEGER), 1)), '')), '') AS payload_digest
  FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM b
"""


OP3_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS size
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = len(v)
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), linked AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(list_transform(a.v, lambda x: x / a.size), list_transform(b.v, lambda x: x / b.size)) >= 0.93
), reach AS (
  SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM reach r JOIN linked l ON r.v = l.a
)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, m.vec_id = m.component_id AS kept
FROM (SELECT v AS vec_id, min(c) AS component_id FROM reach GROUP BY v) m
LEFT JOIN (SELECT a, count(*) AS n FROM linked GROUP BY a) n ON m.vec_id = n.a
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT p.b, r.c FROM reach r JOIN p ON r.v = p.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id, coalesce(l.n, 0) AS n_links
FROM s JOIN (SELECT v, min(c) AS c FROM reach GROUP BY v) m ON s.doc_id = m.v
LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) l ON s.doc_id = l.a
"""


def _op13_sql() -> str:
    """Four rounds of nearest entries and floored means, written out one after another."""
    ctes = [
        """x AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(1024 * CAST(v AS DOUBLE)) AS BIGINT)) AS v
              FROM embeddings WHERE embedding IS NOT NULL
                AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = len(embedding))""",
        """parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS v
                  FROM x, (SELECT unnest([0, 1, 2, 3]) AS p))""",
        """b0 AS MATERIALIZED (SELECT p, e, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts)
                WHERE e < 256)""",
    ]
    for i in range(5):
        ctes.append(
            f"""a{i} AS MATERIALIZED (SELECT vec_id, label, p, v, min(d) % 256 AS e, min(d) // 256 AS d
                  FROM (SELECT t.*, 256 * CAST(list_sum(list_transform(list_zip(t.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) + b.e AS d
                        FROM parts t JOIN b{i} b ON t.p = b.p) GROUP BY vec_id, label, p, v)"""
        )
        if i < 4:
            ctes.append(
                f"""b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{i} b
                    LEFT JOIN (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY k) AS v
                               FROM (SELECT p, e, k, CAST(sum(c) AS BIGINT) AS s, count(*) AS n
                                     FROM (SELECT p, e, unnest(v) AS c, generate_subscripts(v, 1) AS k FROM a{i}) GROUP BY p, e, k)
                               GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)"""
            )
    return "WITH " + ",\n".join(ctes) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, k))
   FROM (SELECT p, e, unnest(v) AS c, generate_subscripts(v, 1) AS k FROM b4)) AS codebooks_sha256
FROM (SELECT vec_id, label, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
      FROM a4 GROUP BY vec_id, label)
"""


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_secret_scans,
        op2_bpe,
        op3_embedding_dedup,
        op4_sharding,
        op5_html_extraction,
        op6_token_counts,
        op7_warc,
        op8_decontamination,
        op9_toxicity,
        op10_shingle_join,
        op11_packing,
        op12_periodic_runs,
        op13_vector_codes,
    )
}
SQL: dict[str, str] = {
    "op3_embedding_dedup": OP3_SQL,
    "op7_warc": OP7_SQL,
    "op10_shingle_join": OP10_SQL,
    "op13_vector_codes": _op13_sql(),
}
