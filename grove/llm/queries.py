"""Queries over the driver's tables that apply each operator of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm.fingerprints import edited_likeness
from grove.llm.lm import lm_scores
from grove.llm.mixing import mix
from grove.llm.ngram_join import ngram_components
from grove.llm.packing import pack
from grove.llm.pii import KINDS, joined, personal_data
from grove.llm.quality import quality_rules
from grove.llm.simhash import simhash_components
from grove.llm.spelling import spelling_variants
from grove.llm.suffixes import suffix_dedup
from grove.llm.tokens import token_counts
from grove.llm.trie import conversation_trie
from grove.llm.urls import url_filter


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_docs(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_docs(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_docs(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_docs(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(_docs(spark, sf_dir).select("doc_id", "text"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined(of(*KINDS[:4])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_docs(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(_docs(spark, sf_dir))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_docs(spark, sf_dir))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_docs(spark, sf_dir))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_docs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_suffix_dedup, op3_packing, op4_quality_rules, op5_pii, op6_mixing, op7_token_counts, op8_fingerprints, op9_ngram_join, op10_url_filters, op11_spelling_variants, op12_conversation_trie, op13_simhash)}
#: Shingle sets, links by counting common shingles, and everything that links reach.
_COMPONENTS = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, coalesce(min(r.b), d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""
#: The table of crc32, a row with a list of 256 numbers.
_CRC = """tb(i, c, k) AS (SELECT range::BIGINT, range::BIGINT, 0 FROM range(256) UNION ALL SELECT i, xor(c >> 1, (c & 1) * 3988292384), k + 1 FROM tb WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM tb WHERE k = 8)"""
#: Deletions by checksum, links by equal texts without one code point, chains of forms.
_VARIANTS = f"""
WITH RECURSIVE {_CRC},
r AS MATERIALIZED (SELECT i, w, count(*) AS n FROM (SELECT coalesce(doc_id::VARCHAR, '') AS i, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(i || ':' || w, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END))), lambda a, x: xor(a >> 8, tab[xor(a & 255, x) + 1])), 4294967295::BIGINT) AS h FROM r, tab),
v AS MATERIALIZED (SELECT w, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS w, n FROM h) WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
x AS MATERIALIZED (SELECT w, n, i, w[:i - 1] || w[i + 1:] AS x FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v)),
l AS (SELECT a.w AS a, a.n AS na, b.w AS b, b.n AS nb FROM x a JOIN x b ON a.i = b.i AND a.x = b.x AND a.w != b.w UNION SELECT x.w, x.n, v.w, v.n FROM x JOIN v ON v.w = x.x UNION SELECT v.w, v.n, x.w, x.n FROM x JOIN v ON v.w = x.x),
b AS MATERIALIZED (SELECT a, na, count(*) AS k, min({{'n': -nb, 'w': b}}) AS b FROM l GROUP BY ALL),
f AS MATERIALIZED (SELECT a AS w, b.w AS form, -b.n AS form_n FROM b WHERE -b.n >= 2 * na),
s(w, top) AS (SELECT w, form FROM f UNION ALL SELECT s.w, f.form FROM s JOIN f ON f.w = s.top)
SELECT v.w AS word, f.form, coalesce(e.top, v.w) AS root, v.n, coalesce(b.k, 0)::BIGINT AS n_near, f.form_n
FROM v LEFT JOIN b ON b.a = v.w LEFT JOIN f ON f.w = v.w LEFT JOIN (SELECT w, top FROM s WHERE top NOT IN (SELECT w FROM f)) e ON e.w = v.w
"""
#: Rebuilt turns as lists, a node for each first part of a list, sums over the nodes that a smallest member passes.
_TRIE = f"""
WITH RECURSIVE {_CRC},
o AS MATERIALIZED (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS m FROM conversations WHERE conv_id IS NOT NULL),
h AS MATERIALIZED (SELECT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda a, x: xor(a >> 8, tab[xor(a & 255, x) + 1])), 4294967295::BIGINT) % 9 AS h FROM (SELECT DISTINCT c FROM o), tab),
z AS (SELECT h.c, 0 AS own, o.i, o.m FROM h JOIN o ON o.c = h.base AND o.i < h.h UNION ALL SELECT h.c, 1, o.i, o.m FROM h JOIN o ON o.c = h.c AND o.i >= h.h),
t AS MATERIALIZED (SELECT h.c, coalesce(list(z.m ORDER BY own, i) FILTER (WHERE z.m IS NOT NULL), []) AS t FROM h LEFT JOIN z ON z.c = h.c GROUP BY h.c),
p AS MATERIALIZED (SELECT c, d, sha256(t[:d]::VARCHAR) AS k, CASE WHEN d > 0 THEN sha256(t[:d-1]::VARCHAR) END AS up, d = len(t) AS last, CASE WHEN d > 0 THEN strlen(t[d].t) ELSE 0 END AS b FROM (SELECT c, t, unnest(range(len(t) + 1)) AS d FROM t)),
n AS MATERIALIZED (SELECT k, any_value(d) AS d, any_value(up) AS up, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(b) AS s, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '')) AS e FROM p GROUP BY k),
k AS MATERIALIZED (SELECT up, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY up),
s AS (SELECT p.k, count(*) FILTER (WHERE k.n IS NULL) AS leaves, sum(n.s) AS saved FROM n JOIN p ON p.c = n.c AND p.d <= n.d LEFT JOIN k ON k.up = n.k GROUP BY p.k)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, u.c AS parent_conv_id, n.n AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.e AS ends_sha256
FROM n JOIN s ON s.k = n.k LEFT JOIN k ON k.up = n.k LEFT JOIN n u ON u.k = n.up
"""
ORACLE_SQL: dict[str, str] = {"op9_ngram_join": _COMPONENTS, "op11_spelling_variants": _VARIANTS, "op12_conversation_trie": _TRIE}
