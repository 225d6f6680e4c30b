"""What the driver entry registers for the corpus operators: queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from queryloom.llm import bm25, bpe, embedding_dedup, html_extract, packing, pii, simhash_dedup, substring_dedup, suffix_dedup, toxicity
from queryloom.llm._common import table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; the operators themselves take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked by the score as it is shown, so that other sums of the same terms rank alike."""
    docs = table(spark, sf_dir, "documents")
    found = bm25.search(docs, docs.where(F.col("doc_id") % 100 == 0)).select("query_id", "doc_id", F.round("score", 6).alias("score"))
    return found.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")).alias("rank"), "doc_id", "score")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.classes(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"), pii.key_of(spark))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_toxicity, op3_bpe, op4_embedding_dedup, op5_bm25_search, op6_html_extract, op7_simhash_dedup, op8_substring_dedup, op9_pii, op10_packing)}


#: Recursive CTE: the smallest node reachable over links(a, b), which holds both directions.
_REACH = "reach(node, root) AS (SELECT DISTINCT a, a FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b)"

ORACLE = {
    "op4_embedding_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{_REACH},
component AS (SELECT node, MIN(root) AS root FROM reach GROUP BY node),
degree AS (SELECT a, COUNT(*) AS n FROM links GROUP BY a)
SELECT vec_id, COALESCE(n, 0) AS n_links, COALESCE(root, vec_id) AS component_id, COALESCE(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN degree ON a = vec_id LEFT JOIN component ON node = vec_id""",
    "op5_bm25_search": """
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM w GROUP BY doc_id, term),
n AS (SELECT doc_id, SUM(tf) AS n FROM tf GROUP BY doc_id),
total AS (SELECT CAST(COUNT(*) AS DOUBLE) AS docs, (SELECT SUM(n) FROM n) / COUNT(*) AS mean FROM documents),
idf AS (SELECT term, ln(1 + (docs - COUNT(*) + 0.5) / (COUNT(*) + 0.5)) AS idf FROM tf, total GROUP BY term, docs),
score AS (SELECT q.doc_id AS query_id, d.doc_id, ROUND(SUM(q.tf * idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
  FROM tf q JOIN tf d ON d.term = q.term JOIN idf ON idf.term = q.term JOIN n ON n.doc_id = d.doc_id, total
  WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, d.doc_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0) WHERE rank <= 10""",
    "op7_simhash_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING COUNT(*) >= 0.8 * (nx.n + ny.n - COUNT(*))),
{_REACH},
component AS (SELECT node, MIN(root) AS root FROM reach GROUP BY node),
c AS (SELECT doc_id, COALESCE(root, doc_id) AS class_id FROM documents LEFT JOIN component ON node = doc_id)
SELECT doc_id, class_id, COUNT(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM c""",
    "op8_substring_dedup": """
WITH w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
gone AS (SELECT DISTINCT win.doc_id, i + k AS place FROM win JOIN (SELECT s, MIN(doc_id) AS first_id FROM win GROUP BY s) f ON f.s = win.s AND f.first_id < win.doc_id, range(13) t(k)),
words AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, COUNT(*) AS n FROM words ANTI JOIN (SELECT doc_id, place AS i FROM gone) g USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - COALESCE(n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    """SQL over whole tables, where SQL can say it; the others are tested against brute force."""
    return dict(ORACLE)
