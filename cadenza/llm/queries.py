"""Registered queries of the training-data operators, with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm.decontaminate import WINDOW, contamination
from cadenza.llm.html_text import main_text
from cadenza.llm.lang_id import identify_languages
from cadenza.llm.licenses import CONTAINED, PHRASES, TEMPLATES, license_scan
from cadenza.llm.merkle import manifest
from cadenza.llm.mixing import mix
from cadenza.llm.near_dedup import near_duplicates
from cadenza.llm.nearest import nearest
from cadenza.llm.prefix_trie import trie
from cadenza.llm.secrets import scan_secrets
from cadenza.llm.sharding import shard_documents
from cadenza.llm.token_files import round_trip as token_round_trip
from cadenza.llm.warc import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"
_ALNUM = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

NEAR_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM d, unnest(range(1, greatest(2, len(w) - 3))) u(i) WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM ways UNION SELECT r.x, b.y FROM reach r JOIN ways b ON r.y = b.x),
least_of AS (SELECT x, min(y) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of ON x = d.doc_id
"""

LEAKS_SQL = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS k
  FROM b, unnest(range(1, greatest(2, len(w) - {WINDOW} + 2))) u(i) WHERE len(w) > 0
),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM d, (SELECT DISTINCT n FROM windows) x, unnest(range(1, len(w) - n + 2)) u(i)
),
hits AS (SELECT doc_id, item, i, n FROM places JOIN windows USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) u(p) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_BASE = ", ".join(
    "list_filter(range(0, len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(phrase.split())) + f") AS at_{label}"
    for phrase, label in PHRASES
)
_ALL_AT = " || ".join(f"at_{label}" for _, label in PHRASES)
_BASE_SET = "[" + ", ".join(f"CASE WHEN len(at_{label}) > 0 THEN '{label}' END" for _, label in PHRASES) + "]"
_TEMPLATE_ROWS = ", ".join(f"({k}, '{label}', {sorted(set(text.split()))})" for k, (label, text) in enumerate(TEMPLATES))

LICENSES_SQL = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS low, {_ALNUM} AS w FROM documents),
base AS (SELECT doc_id, w, {_BASE} FROM d),
templates(t, label, own) AS (VALUES {_TEMPLATE_ROWS}),
blocks AS (
  SELECT doc_id, line, list_distinct(regexp_extract_all(block, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS b
  FROM (SELECT doc_id, unnest(string_split(low, chr(10))) AS block, generate_subscripts(string_split(low, chr(10)), 1) AS line FROM d)
),
met AS (
  SELECT doc_id, line, t, label, own, len(list_intersect(own, b)) AS c FROM blocks, templates
  WHERE 100 * len(list_intersect(own, b)) >= {CONTAINED} * len(own)
),
found AS (
  SELECT doc_id, list(DISTINCT label) AS found, max(c / len(own)) AS best FROM met m
  WHERE NOT EXISTS (SELECT 1 FROM met o WHERE o.doc_id = m.doc_id AND o.line = m.line
    AND len(o.own) > len(m.own) AND list_has_all(o.own, m.own)) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len({_ALL_AT}) AS BIGINT) AS n_base,
  CAST(list_min({_ALL_AT}) AS BIGINT) AS first_word, CAST(list_max({_ALL_AT}) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list_filter({_BASE_SET}, lambda x: x IS NOT NULL)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_filter({_BASE_SET}, lambda x: x IS NOT NULL) || coalesce(found, CAST([] AS VARCHAR[])))), ','), '') AS labels,
  CASE WHEN len({_ALL_AT}) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM base LEFT JOIN found USING (doc_id)
"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(hex, 1 + 5 * (k // 4), 5) AS INTEGER) >> (15 - 5 * (k % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""


def _crc(value: str) -> str:
    """Unsigned crc32 of a number's decimal digits, bit by bit (CRC-32's fixed polynomial)."""
    byte = "list_reduce(list_prepend(xor(acc, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    digits = f"list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda acc, b: {byte}), 4294967295)"


def _part(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"


_LEAF = "sha256(" + " || ".join(_part(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_LOW_TEXT = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MERKLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_LEAF.replace("{text}", "text")} AS leaf,
    CASE WHEN {_crc("doc_id")} % 5 = 0 THEN {_LEAF.replace("{text}", _LOW_TEXT)} END AS bent
  FROM documents
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM d
),
low(k, s, place, n, h) AS (
  SELECT 0, s, place, n, leaf FROM placed
  UNION ALL
  SELECT k + 1, s, place // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY place)) FROM low WHERE n > 1 GROUP BY k, s, place // 16, n
),
tops AS (SELECT s, h AS subroot, k FROM low WHERE n = 1),
high(k, place, n, h) AS (
  SELECT 0, s, (SELECT count(*) FROM tops), subroot FROM tops
  UNION ALL
  SELECT k + 1, place // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY place)) FROM high WHERE n > 1 GROUP BY k, place // 16, n
),
whole AS (
  SELECT k, s, place, n, h FROM low WHERE n > 1
  UNION ALL SELECT 1000 + k, -1, place, n, h FROM high WHERE n > 1
),
beside AS (
  SELECT k, s, place, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM whole WINDOW run AS (PARTITION BY k, s, place // 16 ORDER BY place)
),
walk(doc_id, leaf, s, own, k, grp, place, proof, fold) AS (
  SELECT doc_id, leaf, s, place, 0, s, place, '', coalesce(bent, leaf) FROM placed
  UNION ALL
  SELECT w.doc_id, w.leaf, w.s, w.own, CASE WHEN b.k IS NULL THEN 1000 ELSE w.k + 1 END, CASE WHEN b.k IS NULL THEN -1 ELSE w.grp END,
    CASE WHEN b.k IS NULL THEN w.s ELSE w.place // 16 END, w.proof || coalesce(b.l || b.r, ''),
    CASE WHEN b.k IS NULL THEN w.fold ELSE sha256(b.l || w.fold || b.r) END
  FROM walk w LEFT JOIN beside b ON b.k = w.k AND b.s = w.grp AND b.place = w.place WHERE b.k IS NOT NULL OR w.grp >= 0
),
ended AS (SELECT *, row_number() OVER (PARTITION BY s, own ORDER BY k DESC) AS last FROM walk),
root AS (SELECT h AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM ended JOIN tops USING (s), root WHERE last = 1
"""

TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
),
c AS (SELECT conv_id, list(said ORDER BY i) AS own, {_crc("conv_id")} % 6 AS h FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, coalesce(b.own[1:c.h], []) || c.own[c.h + 1:] AS p
  FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100
),
m AS (SELECT conv_id, len(p) AS whole, unnest(range(0, len(p) + 1)) AS d, p FROM r),
n AS (
  SELECT p[1:d] AS k, d, min(conv_id) AS conv_id, count(*) AS n_convs, list(conv_id ORDER BY conv_id) FILTER (whole = d) AS ends FROM m GROUP BY 1, 2
),
kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
own AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * length(n.k[n.d].text) END AS saved
  FROM n LEFT JOIN kids USING (k, d)
),
tree AS (
  SELECT a.k, a.d, count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens
  FROM own a JOIN (SELECT *, unnest(range(0, d + 1)) AS up FROM own) b ON a.d = b.up AND b.k[1:b.up] = a.k GROUP BY 1, 2
)
SELECT o.conv_id, o.d AS depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens,
  sha256(coalesce(array_to_string(o.ends, ','), '')) AS ends_sha256
FROM own o JOIN tree USING (k, d) LEFT JOIN own u ON u.d = o.d - 1 AND u.k = o.k[1:o.d - 1]
"""


@query(NEAR_SQL)
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op7_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


@query(LEAKS_SQL)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("n_near")


@query()
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


@query()
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


@query(LICENSES_SQL)
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


@query(WARC_SQL)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


@query()
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


@query()
def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


@query(MERKLE_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


@query()
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


@query(TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))
