"""The operators' queries over the test tables, and DuckDB statements for those SQL can express."""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickreports.llm import (
    collision_search,
    fingerprints,
    html_text,
    language_id,
    lm_scoring,
    merkle,
    mixing,
    near_dups,
    packing,
    ranked_search,
    repeats,
    topk,
    url_filters,
)
from clickreports.llm.steps import ship

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZERS = "public_tokenizers"  # the package that knows where the vocabulary files are
PACKING_TOKENIZER = "byte_bpe_50k.json"
SCORING_VOCABULARY = "piece_bpe_32k.model"

# A blocklist's log as the pages give rise to it, in SQL that Spark and DuckDB both read:
# every page dates one entry for its own path, its host and its host's parent domain.
CRAWL_SQL = """
SELECT page_id, url,
       TIMESTAMP '2024-01-01 00:00:00' + (page_id * 7919 % 5184000) * INTERVAL 1 SECOND AS fetched
FROM pages
"""
ENTRIES_SQL = """
WITH parts AS (
  SELECT page_id,
         lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host,
         lower(regexp_extract(url, '://([^/?#]+/[^/?#]+/[0-9]+)', 1)) AS prefix
  FROM pages
)
SELECT CASE page_id % 3 WHEN 0 THEN host
                        WHEN 1 THEN regexp_replace(host, '^[^.]*[.]', '')
                        ELSE prefix || '/' END AS pattern,
       CASE WHEN page_id % 7 IN (0, 1) THEN 'block' WHEN page_id % 7 = 2 THEN 'allow' ELSE 'remove' END AS action,
       TIMESTAMP '2024-01-01 00:00:00' + (page_id * 104729 % 5184000) * INTERVAL 1 SECOND AS dated
FROM parts
WHERE host <> '' AND (page_id % 3 <> 2 OR prefix <> '')
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import importlib

    return importlib.import_module(TOKENIZERS).path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the list entries active when it was fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures, entries = (spark.sql(q.replace("FROM pages", "FROM {pages}"), pages=pages) for q in (CRAWL_SQL, ENTRIES_SQL))
    return url_filters.evaluate(captures, entries)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.token_pieces(docs, tokenizer_path(PACKING_TOKENIZER)))


def op3_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.replicate(docs, mixing.source_rates(docs))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeats.remove_repeats(docs, length=100, keep_text=False)
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", "n_bytes", "n_removed", n_spans, "kept_sha256")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.learn(pages)).select("page_id", "url", "text", "n_chars")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    evidence = language_id.page_evidence(table(spark, sf_dir, "pages"))
    found = language_id.identify(docs, language_id.fit(docs), evidence, host_column="source")
    return found.drop("row").withColumnsRenamed({"id": "doc_id", "accepted": "kept"})


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scoring.score(docs, tokenizer_path(SCORING_VOCABULARY), class_column=None)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof under the manifest, and the root its content leads to.

    Where 5 divides the CRC of the decimal id, the content at hand is the text in lower case.
    """
    docs = table(spark, sf_dir, "documents")
    struck = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    present = F.when(struck, lower_ascii("text")).otherwise(F.col("text"))
    found = merkle.audit(docs, ["doc_id", "source", "lang", "n_chars", "text"], {"text": present})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def lower_ascii(column: str) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def _shipped(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(ship(spark), sf_dir)

    return run


def queries() -> dict[str, Query]:
    found = (
        op1_url_filters,
        op2_best_fit_packing,
        op3_top_k_search,
        op4_mixing,
        op5_near_duplicates,
        op6_fingerprints,
        op7_suffix_array_dedup,
        op8_html_extraction,
        op9_language_id,
        op10_lm_scoring,
        op11_ranked_search,
        op12_merkle_manifest,
        op13_collision_search,
    )
    return {query.__name__: _shipped(query) for query in found}


_OP1_SQL = f"""
WITH captures AS ({CRAWL_SQL}), entries AS ({ENTRIES_SQL}),
one AS (
  SELECT pattern, dated,
         CASE min(CASE action WHEN 'block' THEN 0 WHEN 'allow' THEN 1 ELSE 2 END)
           WHEN 0 THEN 'block' WHEN 1 THEN 'allow' ELSE 'remove' END AS action
  FROM entries GROUP BY pattern, dated
), intervals AS (
  SELECT pattern, action, dated AS valid_from, lead(dated) OVER (PARTITION BY pattern ORDER BY dated) AS valid_to
  FROM one
), hosts AS (
  SELECT *, nullif(regexp_replace(lower(regexp_extract(url, '{url_filters.HOST}', 1)), '[.]$', ''), '') AS host,
         list_filter(string_split(regexp_extract(url, '{url_filters.PATH}', 1), '/'), lambda s: s <> '') AS segments
  FROM captures
), asked AS (
  SELECT DISTINCT url, fetched, host, segments, string_split(host, '.') AS labels FROM hosts WHERE host IS NOT NULL
), candidates AS (
  SELECT url, fetched, len(segments) - n AS place, host || '/' || array_to_string(segments[1:n], '/') || '/' AS pattern
  FROM asked, unnest(range(1, len(segments) + 1)) AS t(n)
  UNION ALL
  SELECT url, fetched, len(segments) + n - 1, array_to_string(labels[n:], '.')
  FROM asked, unnest(range(1, len(labels) + 1)) AS t(n)
), decided AS (
  SELECT c.url, c.fetched, arg_min(action, place) AS action, arg_min(pattern, place) AS pattern,
         arg_min(valid_from, place) AS valid_from
  FROM candidates c JOIN intervals i USING (pattern)
  WHERE action <> 'remove' AND c.fetched >= valid_from AND (valid_to IS NULL OR c.fetched < valid_to)
  GROUP BY c.url, c.fetched
)
SELECT h.page_id, h.url, h.fetched, h.host,
       CASE WHEN h.host IS NULL OR h.fetched IS NULL THEN 'invalid' ELSE coalesce(d.action, 'unlisted') END AS verdict,
       d.pattern, d.valid_from
FROM hosts h LEFT JOIN decided d ON h.url = d.url AND h.fetched = d.fetched
"""

_OP3_SQL = """
WITH points AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS codes
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r AS query, q.vec_id AS query_id, p.r, p.vec_id,
         CAST(list_sum(list_transform(list_zip(q.codes, p.codes), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM points q JOIN points p ON q.r <> p.r AND len(q.codes) = len(p.codes) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def mixing_sql(docs: str, columns: str) -> str:
    """The Poisson replication of a table or statement, all its ``columns`` and the copies."""
    return f"""
WITH RECURSIVE docs AS (SELECT *, row_number() OVER () AS r FROM ({docs})), sizes AS (
  SELECT source, sum(greatest(coalesce(n_chars, 0), 0)::DOUBLE) AS size FROM docs GROUP BY source
), total AS (
  SELECT sum(size) AS size, sum(CASE WHEN size > 0 THEN sqrt(size) ELSE 0 END) AS weight FROM sizes
), rates AS (
  SELECT s.source,
         CASE WHEN s.size > 0 THEN sqrt(s.size) / t.weight * t.size * 1.0::DOUBLE / s.size ELSE 1.0 END AS rate
  FROM sizes s, total t
), parted AS (
  SELECT source, rate, CAST(greatest(ceil(rate / {mixing.WHOLE}), 1) AS INTEGER) AS parts FROM rates
), each AS (
  SELECT source, parts, rate / parts AS rate FROM parted
), tabled AS (
  SELECT source, parts, rate, 0 AS n, exp(-rate) AS p, exp(-rate) AS below FROM each
  UNION ALL
  SELECT source, parts, rate, n + 1, p * rate / (n + 1), below + p * rate / (n + 1) FROM tabled
  WHERE n < ceil(rate + 12 * sqrt(rate) + 40)
), tables AS (
  SELECT source, parts, list(below ORDER BY n) AS below FROM tabled GROUP BY source, parts
), numbers AS (
  SELECT d.*, t.below, coalesce(CAST(doc_id AS VARCHAR), '') AS name, unnest(range(0, t.parts)) AS part
  FROM docs d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
), uniform AS (
  SELECT *, CAST('0x' || substr(md5('mix' || CASE WHEN part > 0 THEN '/part ' || CAST(part AS VARCHAR) ELSE '' END || '/' || name), 1, 13) AS BIGINT)
              / 4503599627370496.0::DOUBLE AS u
  FROM numbers
), drawn AS (
  SELECT r, {columns}, name, CAST(sum(len(list_filter(below, lambda b: b <= u))) AS BIGINT) AS copies
  FROM uniform GROUP BY ALL
)
SELECT {columns}, CAST(copy AS INTEGER) AS copy,
       md5('mix/order/' || name || '/' || CAST(copy AS VARCHAR)) AS shuffle_key
FROM drawn, unnest(range(0, copies)) AS t(copy)
"""


_OP4_SQL = mixing_sql("SELECT * FROM documents", "doc_id, text, lang, source, n_chars")


def near_duplicates_sql(docs: str, words: int) -> str:
    """Components of linked documents, all pairs counted; for small tables."""
    shingle = f"list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' '))"
    return f"""
WITH RECURSIVE docs AS ({docs}), split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM docs
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= {words} THEN list_distinct({shingle})
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM split
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), common AS (
  SELECT a.doc_id AS p, b.doc_id AS q, a.n AS n, b.n AS m, count(*) AS k
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT p, q FROM common WHERE 100 * k >= 80 * (n + m - k) UNION ALL
  SELECT q, p FROM common WHERE 100 * k >= 80 * (n + m - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM docs
  UNION
  SELECT r.a, l.q FROM reach r JOIN links l ON r.b = l.p
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM sets s JOIN reach r ON s.doc_id = r.a GROUP BY s.doc_id, s.s
"""


_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)
_OP11_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents
), sizes AS (
  SELECT r, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes
), places AS (
  SELECT r, doc_id, 50 + (50 * n * docs) // terms AS m FROM sizes, totals
), tfs AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term
), asked AS (
  SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tfs, totals GROUP BY term
), scored AS (
  SELECT a.item_id, p.r, p.doc_id, CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * p.m))) AS BIGINT) AS score
  FROM asked a JOIN weights w USING (term) JOIN tfs t USING (term) JOIN places p ON p.r = t.r
  GROUP BY a.item_id, p.r, p.doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

_CRC_STEP = "CASE WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END"
_CRC_BYTE = f"list_reduce(range(8), lambda crc, bit: {_CRC_STEP}, xor(sofar, ascii(digit)::BIGINT))"


def _field_sql(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


_LEAF_SQL = "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {text})"
_OP12_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT *, coalesce('1' || source, '0') AS tree,
         xor(list_reduce(string_split(CAST(doc_id AS VARCHAR), ''), lambda sofar, digit: {_CRC_BYTE}, 4294967295::BIGINT),
             4294967295::BIGINT) % 5 = 0 AS struck
  FROM documents
), hashed AS (
  SELECT doc_id, tree, {_LEAF_SQL.format(text=_field_sql("text"))} AS leaf,
         {_LEAF_SQL.format(text=_field_sql("CASE WHEN struck THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"))} AS claim
  FROM docs
), leaves AS (
  SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf, claim) AS id,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, claim) - 1 AS place
  FROM hashed
), nodes AS (
  SELECT tree, 0 AS level, place, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 16, sha256(string_agg(digest, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS width FROM nodes) WHERE width > 1
  GROUP BY tree, level, place // 16
), subroots AS (
  SELECT tree, arg_max(digest, level) AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM nodes GROUP BY tree
), tops AS (
  SELECT 0 AS level, place, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 16, sha256(string_agg(digest, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER () AS width FROM tops) WHERE width > 1
  GROUP BY level, place // 16
), forest AS (
  SELECT tree, level, place, digest, count(*) OVER (PARTITION BY tree, level) AS width FROM nodes
), tip AS (
  SELECT level, place, digest, count(*) OVER (PARTITION BY level) AS width FROM tops
), climbed AS (
  SELECT id, tree, 0 AS level, place, claim AS digest, '' AS proof FROM leaves
  UNION ALL
  SELECT c.id, c.tree, c.level + 1, c.place // 16,
         sha256(string_agg(CASE WHEN n.place = c.place THEN c.digest ELSE n.digest END, '' ORDER BY n.place)),
         any_value(c.proof) || coalesce(string_agg(CASE WHEN n.place <> c.place THEN n.digest END, '' ORDER BY n.place), '')
  FROM climbed c JOIN forest n ON n.tree = c.tree AND n.level = c.level AND n.place // 16 = c.place // 16
  WHERE n.width > 1
  GROUP BY c.id, c.tree, c.level, c.place // 16
), below AS (
  SELECT id, tree, arg_max(digest, level) AS digest, arg_max(proof, level) AS proof FROM climbed GROUP BY id, tree
), topped AS (
  SELECT id, 0 AS level, s.place, digest, proof FROM below JOIN subroots s USING (tree)
  UNION ALL
  SELECT c.id, c.level + 1, c.place // 16,
         sha256(string_agg(CASE WHEN n.place = c.place THEN c.digest ELSE n.digest END, '' ORDER BY n.place)),
         any_value(c.proof) || coalesce(string_agg(CASE WHEN n.place <> c.place THEN n.digest END, '' ORDER BY n.place), '')
  FROM topped c JOIN tip n ON n.level = c.level AND n.place // 16 = c.place // 16
  WHERE n.width > 1
  GROUP BY c.id, c.level, c.place // 16
), ends AS (
  SELECT id, arg_max(digest, level) AS folded_root, arg_max(proof, level) AS proof FROM topped GROUP BY id
), top AS (SELECT arg_max(digest, level) AS root FROM tops)
SELECT l.doc_id, l.leaf, s.subroot, top.root, sha256(e.proof) AS proof_sha256, e.folded_root, e.folded_root = top.root AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN ends e USING (id), top
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": _OP1_SQL,
        "op3_top_k_search": _OP3_SQL,
        "op4_mixing": _OP4_SQL,
        "op5_near_duplicates": near_duplicates_sql("SELECT doc_id, text FROM documents", 2),
        "op11_ranked_search": _OP11_SQL,
        "op12_merkle_manifest": _OP12_SQL,
    }
