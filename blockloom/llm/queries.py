"""The training-data queries, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, chat, jaccard_join, packing, quality, token_counts, topk, toxicity, warc
from .common import bound_batches

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


#: The end id of op7's documents, and the strings that its tokenizer file reads as ids.
END_ID = 1
SPECIAL = {"<|endoftext|>": 50256}


def packed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents in windows; the rank file holds the vocabulary of byte_bpe_50k.json."""
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, END_ID, SPECIAL)


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, table(spark, sf_dir, "documents"))


@query(
    "op2_jaccard_join",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents
    ), g AS (
      SELECT DISTINCT doc_id, array_to_string(t[i:i + least(5, len(t)) - 1], ' ') AS gram
      FROM w, unnest(range(1, len(t) - least(5, len(t)) + 2)) AS r(i) WHERE len(t) > 0
    ), n AS (
      SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
    ), l AS (
      SELECT p.x, p.y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL) p
      JOIN n nx ON nx.doc_id = p.x JOIN n ny ON ny.doc_id = p.y WHERE 5 * common >= 4 * (nx.n + ny.n - common)
    ), r AS (
      SELECT x AS doc_id, y AS root FROM l UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.root
    )
    SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(root) FROM r WHERE r.doc_id = d.doc_id), d.doc_id)) AS class_id,
           (SELECT count(*) FROM l WHERE l.x = d.doc_id) AS n_links
    FROM documents d
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(spark, table(spark, sf_dir, "documents"))


@query("op4_nearest")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark, table(spark, sf_dir, "embeddings"))


@query(
    "op5_exact_top_k",
    """
    WITH v AS (
      SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
      FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
      SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(generate_series(1, len(q.vec)), lambda i: q.vec[i] * c.vec[i])) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)
      WHERE q.vec_id % 20 = 0
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, CAST(score AS BIGINT) AS score
    FROM scored
    QUALIFY rank <= 20
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(spark, table(spark, sf_dir, "embeddings"))


@query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "score", "toxic")


@query(
    "op8_preference_format",
    r"""
    WITH clean AS (
      SELECT conv_id AS pair_id, turn, s.role AS role, s.text AS text FROM (
        SELECT conv_id, turn, min({'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')}) AS s
        FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn)
    ), final AS (
      SELECT pair_id, max(turn) AS last, arg_max(text, turn) AS answer FROM clean WHERE role = 'assistant' GROUP BY pair_id
    ), swapped AS (
      SELECT c.pair_id, c.turn, c.role, CASE WHEN c.turn = f.last THEN coalesce(o.answer, '') ELSE c.text END AS text
      FROM clean c LEFT JOIN final f ON f.pair_id = c.pair_id LEFT JOIN final o ON o.pair_id = c.pair_id + 1
    ), paired AS (
      SELECT c.pair_id, c.turn, c.role, c.text AS chosen, r.text AS rejected,
             min(CASE WHEN c.text <> r.text THEN c.turn END) OVER (PARTITION BY c.pair_id) AS first
      FROM clean c JOIN swapped r ON c.pair_id = r.pair_id AND c.turn = r.turn
    ), parts AS (
      SELECT pair_id, 'prompt' AS part, turn, role, chosen AS text FROM paired WHERE first IS NULL OR turn < first
      UNION ALL SELECT pair_id, 'chosen', turn, role, chosen FROM paired WHERE turn >= first
      UNION ALL SELECT pair_id, 'rejected', turn, role, rejected FROM paired WHERE turn >= first
    ), shown AS (
      SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered FROM parts
    ), laid AS (
      SELECT *, CAST(length(rendered) AS BIGINT) AS n_chars,
             CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM shown
    ), masked AS (
      SELECT *, CASE WHEN role = 'assistant' AND part <> 'prompt' THEN start + length(role) + 13 END AS t0,
             CASE WHEN role = 'assistant' AND part <> 'prompt' THEN start + n_chars END AS t1,
             CAST('0x' || substr(sha256(concat_ws(':', turn, start, n_chars, sha256(rendered))), 1, 15) AS BIGINT) AS word
      FROM laid
    )
    SELECT pair_id,
           count(*) FILTER (part = 'prompt') AS prompt_turns, CAST(coalesce(sum(n_chars) FILTER (part = 'prompt'), 0) AS BIGINT) AS prompt_chars,
           coalesce(bit_xor(word) FILTER (part = 'prompt'), 0) AS prompt_digest,
           count(*) FILTER (part = 'chosen') AS chosen_turns, CAST(coalesce(sum(n_chars) FILTER (part = 'chosen'), 0) AS BIGINT) AS chosen_chars,
           coalesce(bit_xor(word) FILTER (part = 'chosen'), 0) AS chosen_digest,
           count(*) FILTER (part = 'rejected') AS rejected_turns, CAST(coalesce(sum(n_chars) FILTER (part = 'rejected'), 0) AS BIGINT) AS rejected_chars,
           coalesce(bit_xor(word) FILTER (part = 'rejected'), 0) AS rejected_digest,
           CAST(coalesce(sum(t1 - t0) FILTER (part = 'chosen'), 0) AS BIGINT) AS chosen_target_chars,
           CAST(coalesce(sum(t1 - t0) FILTER (part = 'rejected'), 0) AS BIGINT) AS rejected_target_chars,
           coalesce(bit_xor(CAST('0x' || substr(sha256(concat_ws(':', part, t0, t1)), 1, 15) AS BIGINT)) FILTER (t0 IS NOT NULL), 0) AS mask_digest
    FROM masked GROUP BY pair_id
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = chat.segments_of(chat.other_answers(spark, table(spark, sf_dir, "conversations")))
    return chat.paired(segments.withColumn("rendered", F.sha2(F.col("rendered").cast("binary"), 256)))


@query(
    "op10_revisits",
    r"""
    WITH placed AS (
      SELECT page_id, html, CASE WHEN url IS NOT NULL AND page_id % 3 = 0 THEN 'https://shared.example/' || CAST(page_id % 16 AS VARCHAR) ELSE url END AS url FROM pages
    ), bare AS (
      SELECT page_id, url, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM placed
    ), cut AS (
      SELECT page_id, url, md5(coalesce(html, '')) AS digest, CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) AS bytes,
             regexp_replace(lower(regexp_extract(b, '^[^/?]*', 0)), ':(80|443)$', '') AS host,
             regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
             list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'),
               lambda p: p <> '' AND NOT regexp_full_match(p, '(utm_[a-z]+|ref|fbclid|gclid)(=.*)?'))) AS params
      FROM bare
    ), addressed AS (
      SELECT *, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS address FROM cut
    ), answered AS (
      SELECT page_id AS of, page_id * 4 AS at, address, digest, bytes, CASE WHEN page_id % 9 = 0 THEN '"edition"' ELSE '"' || digest || '"' END AS etag FROM addressed WHERE page_id % 5 <> 2
    ), asked AS (
      SELECT page_id, url, address, page_id * 4 + CASE WHEN page_id % 13 = 0 THEN 20003 ELSE 3 END AS at,
             CASE WHEN page_id % 5 = 0 THEN '"none"' WHEN page_id % 7 = 0 OR page_id % 11 = 0 THEN NULL
                  WHEN page_id % 9 IN (0, 3) THEN '"edition"' ELSE '"' || digest || '"' END AS tag,
             CASE WHEN page_id % 5 <> 0 AND page_id % 7 = 0 THEN CAST(page_id % 28 AS VARCHAR) END AS day
      FROM addressed
    ), found AS (
      SELECT q.*, r.of, r.digest, r.bytes, r.etag FROM asked q ASOF LEFT JOIN answered r ON r.address = q.address AND r.at <= q.at
    ), judged AS (
      SELECT *, CASE WHEN of IS NULL THEN 'no earlier response'
                     WHEN tag IS NOT NULL THEN CASE WHEN tag = etag THEN 'resolved' ELSE 'validator mismatch' END
                     WHEN day IS NOT NULL THEN CASE WHEN day = CAST(of % 28 AS VARCHAR) THEN 'resolved' ELSE 'validator mismatch' END
                     ELSE 'no validator' END AS outcome
      FROM found
    )
    SELECT page_id * 2 + 1 AS record_id, url, "at", CASE WHEN outcome = 'resolved' THEN of * 2 END AS refers_to, outcome,
           CASE WHEN outcome = 'resolved' THEN digest END AS payload_digest,
           CASE WHEN outcome = 'resolved' THEN
             'cache-control: max-age=90' || chr(10) || 'content-length: ' || bytes || chr(10) || 'content-type: text/html' || chr(10)
             || 'etag: ' || CASE WHEN tag IS NULL THEN etag ELSE 'W/' || tag END || chr(10)
             || 'last-modified: ' || coalesce(day, CAST(of % 28 AS VARCHAR))
           ELSE
             'cache-control: max-age=90' || chr(10) || 'content-length: 0'
             || CASE WHEN tag IS NULL THEN '' WHEN tag = '"none"' THEN chr(10) || 'etag: ' || tag ELSE chr(10) || 'etag: W/' || tag END
             || CASE WHEN day IS NULL THEN '' ELSE chr(10) || 'last-modified: ' || day END || chr(10) || 'server: edge'
           END AS headers
    FROM judged
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.records_of_pages(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", warc.header_text(F.col("headers")))
