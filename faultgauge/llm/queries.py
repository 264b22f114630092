"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultgauge.llm import bpe, exact_dedup, merkle, mixing, order_minhash, quality, separators, site_tree, spelling, suffix_dedup, syncmers, topk, warc
from faultgauge.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op3_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every document, and its text decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(table(spark, sf, "documents"), path, public_tokenizers.PATTERN)


@query
def op10_syncmers(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return syncmers.fingerprints(table(spark, sf, "documents"))


@query
def op8_warc_index(spark: SparkSession, sf: str) -> DataFrame:
    """Every page written to archives and read back; the pages carry no time, so their ids stand for seconds."""
    # ids may be hashes of any size; a time has to stay within a century
    seconds = F.timestamp_seconds(F.lit(1_600_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 31)))
    index = warc.capture_index(table(spark, sf, "pages").withColumn("captured", seconds))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op8_warc_index"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html,
         min(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS first,
         CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS bits
  FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + list_sum(list_transform(range(0, 5),
           lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS INT), 1) AS INT) * CAST(pow(2, 4 - j) AS INT))) AS INT), 1)), '')
         AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
"""


@query
def op9_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best partners of every vector whose id is divisible by 20."""
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE["op9_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op1_site_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    return site_tree.extract(table(spark, sf, "pages"))


@query
def op4_order_minhash(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return order_minhash.classes(table(spark, sf, "documents"))


@query
def op7_weak_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Score and decision of the quality classifier for every document."""
    return quality.classify(table(spark, sf, "documents"))


#: Shares of tokens that the mixture is to have.
LANGUAGES = {"en": 0.45, "de": 0.2, "fr": 0.2, "es": 0.15}


def labelled_languages(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, domain`` of the documents that the table of labels covers."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("domain"))
    return docs.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")


@query
def op6_soft_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of all documents for a mixture of languages, which are known only for labelled ones."""
    return mixing.rates(table(spark, sf, "documents"), labelled_languages(spark, sf), LANGUAGES)


@query
def op5_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without its repeated strings of 400 bytes; ``text`` is what is left of it."""
    found = suffix_dedup.removed(table(spark, sf, "documents").select("doc_id", "text"))
    digest = F.sha2(F.col("kept"), 256).alias("kept_sha256")
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", digest, F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


@query
def op2_separator_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts of all documents, found in flat token files."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return separators.document_counts(table(spark, sf, "documents"), path, public_tokenizers.PATTERN)


@query
def op11_heavy_split(spark: SparkSession, sf: str) -> DataFrame:
    """Group of equal texts of every document, and the row that stays."""
    return exact_dedup.groups(table(spark, sf, "documents"))


ORACLE["op11_heavy_split"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


#: CRC-32 (reflected polynomial 0xEDB88320) of a list of bytes in DuckDB; ``crc`` holds the table of its 256 remainders.
CRC_TABLE = """crc AS (
  SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)),
    lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS remainders)"""


def crc32_sql(bytes_sql: str) -> str:
    return (
        f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_sql}), "
        "lambda r, b: xor(r >> 8, remainders[xor(r & 255, b) + 1])), 4294967295)"
    )


@query
def op13_postorder_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Proof of every document, tested on texts of which every second one has lost its line ends."""
    docs = table(spark, sf, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    lost = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.proofs(merkle.build(docs, presented={"text": lost}))


def _manifest_sql(levels: int = 12) -> str:
    """Level by level over whole tables; trees of up to 3 ^ levels leaves."""

    def field(name: str, value: str | None = None) -> str:
        v = f"CAST({value or name} AS VARCHAR)"
        return f"CASE WHEN {v} IS NULL THEN '-' ELSE concat(strlen({v}), ':', {v}) END"

    def leaf(text: str) -> str:
        return f"sha256(concat({', '.join([*map(field, merkle.FIELDS[:-1]), field('text', text)])}))"

    lost = f"CASE WHEN {crc32_sql('''list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))''')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
    steps = [CRC_TABLE, f"""docs AS MATERIALIZED (
  SELECT *, {leaf('text')} AS leaf, {leaf(lost)} AS shown FROM documents, crc)""", """d0 AS MATERIALIZED (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, leaf, shown AS folded, '' AS proof,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM docs)""", "a0 AS MATERIALIZED (SELECT tree, i, leaf AS h FROM d0)"]

    def climb(nodes: str, rows: str) -> None:
        for k in range(levels):
            steps.append(f"""{nodes}{k}s AS MATERIALIZED (
  SELECT *, count(*) OVER (PARTITION BY tree) AS c, concat(lag(h, 2) OVER run, lag(h) OVER run) AS l, concat(lead(h) OVER run, lead(h, 2) OVER run) AS r
  FROM {nodes}{k} WINDOW run AS (PARTITION BY tree, i // 3 ORDER BY i))""")
            steps.append(f"""{nodes}{k + 1} AS MATERIALIZED (
  SELECT tree, i // 3 AS i, CASE WHEN any_value(c) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
  FROM {nodes}{k}s GROUP BY tree, i // 3)""")
            steps.append(f"""{rows}{k + 1} AS MATERIALIZED (
  SELECT d.* REPLACE (d.i // 3 AS i, proof || l || r AS proof, CASE WHEN c = 1 THEN folded ELSE sha256(l || folded || r) END AS folded)
  FROM {rows}{k} d JOIN {nodes}{k}s s ON s.tree = d.tree AND s.i = d.i)""")

    climb("a", "d")
    steps.append(f"b0 AS MATERIALIZED (SELECT 0 AS tree, tree AS i, h FROM a{levels})")
    steps.append(f"""e0 AS MATERIALIZED (
  SELECT d.doc_id, d.leaf, a.h AS subroot, d.folded, d.proof, 0 AS tree, d.tree AS i FROM d{levels} d JOIN a{levels} a ON a.tree = d.tree)""")
    climb("b", "e")
    return f"""WITH {', '.join(steps)}
SELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = b.h AS verified
FROM e{levels} JOIN b{levels} b ON true"""


ORACLE["op13_postorder_manifest"] = _manifest_sql()


@query
def op12_reduced_alphabet(spark: SparkSession, sf: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.variants(table(spark, sf, "documents"))


_RUN_BYTES = "flatten(list_transform(string_split(key, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) - 64 AS BIGINT)] END))"

ORACLE["op12_reduced_alphabet"] = f"""
WITH RECURSIVE {CRC_TABLE},
tokens AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS t FROM documents),
runs AS (
  SELECT doc_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM tokens WHERE length(t) >= 6 GROUP BY ALL),
hashed AS (SELECT run, c, {crc32_sql(_RUN_BYTES)} AS h FROM (SELECT *, concat(doc_id, ':', run) AS key FROM runs), crc),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word,
         CAST(sum(c) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(c) >= 5),
cuts AS (
  SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest
  FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k FROM near),
forms AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
         CASE WHEN r.m >= 5 * w.n THEN r.other END AS form, CASE WHEN r.m >= 5 * w.n THEN r.m END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.k = 1),
steps AS (
  SELECT word, word AS root, form AS onward FROM forms
  UNION ALL SELECT s.word, s.onward, f.form FROM steps s JOIN forms f ON f.word = s.onward)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM forms f JOIN steps s ON s.word = f.word AND s.onward IS NULL
"""
