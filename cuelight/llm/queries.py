"""One query per operator over the driver tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_bpe, conversation_repair, decontamination, embedding_dedup, nearest, packing, quality, secret_scan, simhash, token_counts, url_filter, vector_codes, warc
from .tables import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 2048 ids."""
    return packing.pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


RULES = (
    url_filter.Rule("org/", "allow"), url_filter.Rule("example.org/es/", "block"), url_filter.Rule("example.org/en/1", "block"),
    url_filter.Rule("com/fr/", "allow"), url_filter.Rule("com/de/", "block"),
)


@query("op2_url_filter")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


@query("op3_secrets")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


@query("op4_nearest", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_warc", """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), named AS (
  SELECT page_id, payload_bytes, h, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::BIGINT, 1)), 'string_agg', '') AS payload_digest,
    min(page_id) OVER (PARTITION BY h) AS least
  FROM hashed
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to FROM named
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, and the records of every page's url fetched by its key through the index."""
    folder, pages = warc.default_folder(spark), table(spark, sf_dir, "pages")
    archive = warc.write_archives(pages, folder)
    return warc.read_archives(archive, folder, pages, keep_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_embedding_dedup", """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b
), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT node AS vec_id, coalesce(any_value(n), 0) AS n_links, min(root) AS component_id, min(root) = node AS kept
FROM reach LEFT JOIN degree ON a = node GROUP BY node
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    return byte_bpe.round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op10_simhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _nearest_entries(name: str, books: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT a.id, a.p, any_value(a.v) AS v, min([list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - c.v[i]) * (a.v[i] - c.v[i])))::BIGINT, c.e]) AS best
  FROM parts a JOIN {books} c USING (p) GROUP BY a.id, a.p
)"""


def _moved_entries(name: str, books: str, found: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM {books} c LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT p, best[2] AS e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM {found}, (SELECT unnest(range(1, w + 1)) AS i FROM width) GROUP BY ALL
    ) GROUP BY p, e
  ) m USING (p, e)
)"""


@query("op11_vector_codes", f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), width AS (SELECT max(len(x)) // 16 AS w FROM kept),
parts AS MATERIALIZED (SELECT id, p, x[p * w + 1:(p + 1) * w] AS v FROM kept, width, (SELECT unnest(range(16)) AS p)),
c0 AS MATERIALIZED (SELECT p, id - 1 AS e, v FROM parts WHERE id <= 64),
{_nearest_entries('a0', 'c0')}, {_moved_entries('c1', 'c0', 'a0')},
{_nearest_entries('a1', 'c1')}, {_moved_entries('c2', 'c1', 'a1')},
{_nearest_entries('a2', 'c2')},
books AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM c2)),
coded AS (SELECT id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM a2 GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (id), books
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, errors and codebooks of all vectors."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256")


def _plus(weight: str, cost: str, edit: str) -> str:
    """A weight is its cost in eight digits before its audit, so that the lesser text is the lesser weight; ~: none."""
    return f"(CASE WHEN {weight} = '~' THEN '~' ELSE printf('%08d', {weight}[:8]::INT + {cost}) || {weight}[9:] || '{edit}' END)"


def _repair_inserts(source: str) -> str:
    return f"""SELECT *, least(a, {_plus('u2', '5', 'I')}) AS a2 FROM (
    SELECT *, least(u, {_plus('least(z, s, a)', '5', 'I')}) AS u2 FROM ({source}))"""


def _repair_step(before: str) -> str:
    """Weights z (nothing yet), s, u, a after a row, from those before it."""
    some = "least(z, s, a2)"

    def keep(initial: str, source: str) -> str:
        return f"CASE WHEN open AND initial = '{initial}' THEN {_plus(source, 'stays', 'K')} ELSE '~' END"

    def rerole(source: str) -> str:
        return f"CASE WHEN open THEN {_plus(source, '1 + stays', 'R')} ELSE '~' END"

    return f"""SELECT conv_id, i, {_plus('z', '2', 'D')} AS z, least({_plus('s', '2', 'D')}, {keep('s', 'z')}) AS s,
    least({_plus('u2', '2', 'D')}, {keep('u', some)}, {rerole(some)}) AS u,
    least({_plus('a2', '2', 'D')}, {keep('a', 'u2')}, {rerole('u2')}) AS a
  FROM ({_repair_inserts(before)})"""


_REPAIR_ROWS = """SELECT w.conv_id, f.i, z, s, u, a, f.initial, f.fault NOT IN ('blank', 'duplicate') AS open,
      CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END AS stays
    FROM walk w JOIN faulty f ON f.conv_id = w.conv_id AND f.i = w.i + 1"""


@query("op12_conversation_repair", f"""
WITH RECURSIVE sums AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS b))
), drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce([4294967295] || list_transform(str_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS lot
  FROM conversations, sums
), damaged AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN lot = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM drawn WHERE lot <> 0
), placed AS (
  SELECT *, role[1] AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), faulty AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM placed
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, max(i) AS n,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, '00000000' AS z, '~' AS s, '~' AS u, '~' AS a FROM stats
  UNION ALL
  {_repair_step(_REPAIR_ROWS)}
), best AS (
  SELECT conv_id, least(z, a2)[:8]::BIGINT AS cost, least(z, a2)[9:] AS audit
  FROM ({_repair_inserts('SELECT w.* FROM walk w JOIN stats t ON t.conv_id = w.conv_id AND t.n = w.i')})
), edits AS (
  SELECT conv_id, unnest(str_split(audit, '')) AS edit, unnest(range(len(audit))) AS k FROM best WHERE audit <> ''
), met AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER so_far AS i, count(*) FILTER (edit <> 'D') OVER so_far AS m
  FROM edits WINDOW so_far AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)
), said AS (
  SELECT e.conv_id, e.k, e.edit, e.m, f.role, CASE WHEN e.edit = 'I' THEN '' ELSE f.text END AS text,
    first_value(e.edit = 'K' AND f.initial = 's') OVER (PARTITION BY e.conv_id ORDER BY e.k) AS headed
  FROM met e LEFT JOIN faulty f ON f.conv_id = e.conv_id AND f.i = e.i WHERE e.edit <> 'D'
), hashes AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (m % 2 = 1) = headed THEN 'assistant' ELSE 'user' END || ':' || text, chr(10) ORDER BY k))
    AS repaired_sha256 FROM said GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN hashes USING (conv_id)
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged and repaired."""
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damage(rows), rows)


@query("op13_decontamination", """
WITH docs AS (
  SELECT row_number() OVER () AS key, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), phrases AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), found AS MATERIALIZED (
  SELECT DISTINCT key, i, n, item_id FROM (
    SELECT key, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM (SELECT key, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM phrases))
  ) JOIN phrases USING (n, phrase)
), hits AS (SELECT key, count(DISTINCT place) AS n_hit FROM (SELECT key, unnest(range(i, i + n)) AS place FROM found) GROUP BY key),
met AS (
  SELECT key, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
  FROM (SELECT DISTINCT key, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY key
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (key) LEFT JOIN met USING (key)
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that test items hold."""
    return decontamination.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
