"""The registered queries of these operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletide.llm.divergence import divergence
from tripletide.llm.html_text import extract_text
from tripletide.llm.language import languages
from tripletide.llm.licenses import license_labels
from tripletide.llm.lines import without_boilerplate
from tripletide.llm.mixing import mix
from tripletide.llm.near_dup import near_duplicates
from tripletide.llm.prefixes import regrouped_trie
from tripletide.llm.quality import quality_scores
from tripletide.llm.suffixes import repeated_passages
from tripletide.llm.tables import table
from tripletide.llm.templates import leaks
from tripletide.llm.token_files import token_digest
from tripletide.llm.vectors import similar_vectors

WEIGHTS = (5, 2, 1)


def tokenizer() -> str:
    """The tokenizer file of the queries; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"), tokenizer())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), WEIGHTS).select("doc_id", "size", "source_size", "target", "taken")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op4_similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"),
        F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"),
    )


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents"))


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regrouped_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files, op2_mixing, op3_html_text, op4_similar_vectors, op5_quality, op6_boilerplate_lines,
        op7_near_duplicates, op8_repeated_passages, op9_leaks, op10_language,
        op11_divergence, op12_licenses, op13_prefixes,
    )
}

_COMPONENTS = """
reach(a, b) AS (SELECT {id}, {id} FROM {nodes} UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
component AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
"""

SQL = {
    "op2_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, (SELECT sum(n) FROM s)::DOUBLE AS total FROM s),
r AS (SELECT *, 3.0::DOUBLE * n / weight AS ratio FROM w),
c AS (SELECT *, (total - coalesce(sum(3 * n) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / sum(weight) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS each_ FROM r),
l AS (SELECT min_by(each_, ratio) AS level FROM c WHERE each_ <= ratio),
t AS (SELECT c.*, CASE WHEN level * weight > 3 * n THEN (3 * n)::DOUBLE ELSE level * weight END AS target FROM c, l),
u AS (SELECT *, floor(target + 0.5)::BIGINT AS wanted FROM t),
placed AS (SELECT d.doc_id, d.size, u.n, u.target, u.wanted, (sum(d.size) OVER (PARTITION BY u.k ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS first
           FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, n AS source_size, target, CASE WHEN n = 0 THEN 0 ELSE wanted // n * size + greatest(0, least(size, wanted % n - first)) END::BIGINT AS taken FROM placed
""",
    "op4_similar_vectors": f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x != 0)) > 0),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id != b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
links AS (SELECT a, count(*) AS n_links FROM edges GROUP BY a),
{_COMPONENTS.format(id="vec_id", nodes="embeddings")}
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN links ON links.a = vec_id JOIN component ON component.a = vec_id
""",
    "op6_boilerplate_lines": """
WITH l AS (SELECT source, trim(line) AS line FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) != ''),
b AS (SELECT line FROM l WHERE source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= 10),
p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
m AS (SELECT p.*, b.line IS NOT NULL AS gone FROM p LEFT JOIN b ON trim(p.line) = b.line),
o AS (SELECT doc_id, count(*) FILTER (trim(line) != '') AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM m GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(text) AS n_chars, md5(text) AS text_md5 FROM o
""",
    "op7_near_duplicates": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
       ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sh),
pairs AS (SELECT p.doc_id AS a, q.doc_id AS b, p.n AS n, q.n AS m, count(*) AS shared FROM e p JOIN e q ON p.x = q.x AND p.doc_id != q.doc_id GROUP BY ALL),
edges AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (n + m - shared)),
{_COMPONENTS.format(id="doc_id", nodes="documents")}
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sh JOIN component ON a = doc_id
""",
    "op11_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
dense AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v))::BIGINT AS p FROM dense JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n) AS n FROM dense GROUP BY ALL),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v))::BIGINT AS q FROM l JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT p.lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 10
""",
    "op13_prefixes": r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
  lambda crc, byte: list_reduce(range(8), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(crc, byte)), 4294967295::BIGINT), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, i, role, text FROM c JOIN t ON t.conv_id = base AND i < h
  UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t USING (conv_id) WHERE i >= h),
p AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY part, i) AS turns FROM r GROUP BY conv_id),
m AS (SELECT c.conv_id, coalesce(turns, []) AS turns FROM c LEFT JOIN p USING (conv_id)),
d AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM m),
k AS (SELECT conv_id, depth, turns[1:depth] AS prefix, md5(to_json(turns[1:depth])::VARCHAR) AS node, len(turns) = depth AS ended FROM d),
g AS (SELECT node, depth, any_value(prefix) AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '') AS ends FROM k GROUP BY node, depth),
u AS (SELECT *, md5(to_json(prefix[1:depth - 1])::VARCHAR) AS up,
  CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(prefix[depth].t, '[^\x20\x09-\x0D]+')) END AS saved FROM g),
kids AS (SELECT up AS node, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY up),
o AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN kids USING (node)),
below AS (SELECT md5(to_json(prefix[1:d])::VARCHAR) AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM o) GROUP BY 1)
SELECT o.conv_id, o.depth, parent.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(o.ends) AS ends_sha256
FROM o JOIN below USING (node) LEFT JOIN o AS parent ON o.depth > 0 AND parent.node = o.up
""",
}
