"""Batch retrieval over ``documents``, ``embeddings`` and the query texts of ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from innings.functions import vectors as Vx
from innings.functions.text import SPACE_PATTERN, tokens
from innings.operators import quality as Qy
from innings.operators import retrieval as R
from innings.operators import vector_index as X
from innings.plans.registry import query
from innings.plans.sql import add_block, sql
from innings.plans.texts import doc_corpus
from innings.session import stored
from innings.sources.adapter import deliveries, table

N_LABELS = 10


def corpus(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("doc_type"), F.col("source").alias("team"), "text")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return docs.join(vectors, "doc_id", "left")


def label_vectors(spark, sf):
    """One exemplar per label: the vector with the smallest id."""
    return table(spark, sf, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))


def questions(spark, sf):
    """Every benchmark text; its vector is the exemplar of the label its id falls on."""
    items = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), "text", (F.col("item_id") % N_LABELS).cast("int").alias("label"))
    return items.join(label_vectors(spark, sf), "label", "left").select("query_id", "text", "vector")


def vector_queries(spark, sf):
    """Every vector whose id is divisible by 100 asks against all."""
    return vector_docs(spark, sf).where(F.col("doc_id") % 100 == 0).withColumnRenamed("doc_id", "query_id")


def keyed_vectors(spark, sf, rows, key):
    """A vector for rows without one of their own, by a digest of their key."""
    vectors = vector_docs(spark, sf).withColumnsRenamed({"doc_id": "_vec_id"})
    n = vectors.agg(F.max("_vec_id") + 1).scalar()
    number = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n
    return rows.withColumn("_n", number).join(vectors, F.col("_n") == F.col("_vec_id"), "left").drop("_n", "_vec_id")


def vector_docs(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def _words(source: str, key: str, alias: str) -> str:
    return (f"SELECT * FROM (SELECT {key} AS {alias}, unnest(regexp_split_to_array(lower(text), '{SPACE_PATTERN}')) AS term "
            f"FROM {source}) w WHERE term <> ''")


def bm25_blocks(prefix: str, docs: str, key: str, queries: str, needs: list[str], k: int = 80) -> None:
    """``<prefix>tf``, ``<prefix>idf`` and ranked hits ``<prefix>hits`` over the named sources."""
    p = prefix
    add_block(f"{p}idf", f"""
{p}tok AS MATERIALIZED ({_words(docs, key, 'doc_id')}),
{p}dl AS MATERIALIZED (SELECT x.{key} AS doc_id, COUNT(term) AS dl FROM {docs} x LEFT JOIN {p}tok ON {p}tok.doc_id = x.{key} GROUP BY 1),
{p}st AS MATERIALIZED (SELECT COUNT(*) AS n, SUM(dl) / COUNT(*) AS avgdl FROM {p}dl),
{p}tf AS MATERIALIZED (SELECT term, doc_id, COUNT(*) AS tf FROM {p}tok GROUP BY 1, 2),
{p}raw AS MATERIALIZED (SELECT term, COUNT(*) AS df, ln((SELECT n FROM {p}st) - COUNT(*) + 0.5::DOUBLE) - ln(COUNT(*) + 0.5::DOUBLE) AS r
  FROM {p}tf GROUP BY 1),
{p}idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25::DOUBLE * (SELECT AVG(r) FROM {p}raw) ELSE r END AS idf FROM {p}raw)""",
              needs)
    add_block(f"{p}hits", f"""
{p}qt AS (SELECT query_id, term, COUNT(*) AS qn FROM ({_words(queries, 'query_id', 'query_id')}) z GROUP BY 1, 2),
{p}sc AS (SELECT query_id, tf.doc_id, round(SUM(qn * idf * tf * 2.5::DOUBLE /
   (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avgdl FROM {p}st)))), 6) AS score
  FROM {p}qt q JOIN {p}idf i ON i.term = q.term JOIN {p}tf tf ON tf.term = q.term JOIN {p}dl dl ON dl.doc_id = tf.doc_id
  GROUP BY 1, 2),
{p}hits AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id
   ORDER BY score DESC, doc_id) AS rank FROM {p}sc WHERE score > 0) r WHERE rank <= {k})""", [f"{p}idf"])


_COS = ("list_dot_product(q.vector::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.vector::DOUBLE[], "
        "q.vector::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])))")

add_block("lv", "lv AS (SELECT label, arg_min(embedding, vec_id) AS vector FROM embeddings GROUP BY 1)", [])
add_block("qs", """
qs AS (SELECT item_id AS query_id, text, vector FROM benchmark LEFT JOIN lv ON lv.label = item_id % 10)""", ["lv"])
bm25_blocks("b_", "documents", "doc_id", "qs", ["qs"])


def _dense(name: str, queries: str, where: str, needs: list[str], k: int) -> None:
    add_block(name, f"""
{name} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id
   ORDER BY score DESC, doc_id) AS rank FROM (SELECT q.query_id, e.vec_id AS doc_id, round({_COS}, 6) AS score
    FROM {queries} q CROSS JOIN embeddings e {where}) s) r WHERE rank <= {k})""", needs)


add_block("eq", "eq AS (SELECT label AS query_id, vector FROM lv)", ["lv"])
_dense("dx", "eq", "", ["eq"], 80)
add_block("vq", "vq AS (SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id % 100 = 0)", [])
_dense("dv", "vq", "", ["vq"], 80)
_dense("dq", "qs", "JOIN documents t ON t.doc_id = e.vec_id AND t.lang = 'en'", ["qs"], 80)

add_block("fused", """
fused AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)
   AS rank FROM (SELECT query_id, doc_id, round(SUM(1.0::DOUBLE / (60 + rank)), 9) AS score
    FROM (SELECT query_id, doc_id, rank FROM dq UNION ALL SELECT query_id, doc_id, rank FROM b_hits) u GROUP BY 1, 2) f) r
  WHERE rank <= 80)""", ["dq", "b_hits"])
add_block("rr", f"""
ov AS (SELECT f.query_id, f.doc_id, COUNT(t.term) AS shared FROM fused f
   JOIN b_qt ON b_qt.query_id = f.query_id LEFT JOIN b_tf t ON t.doc_id = f.doc_id AND t.term = b_qt.term GROUP BY 1, 2),
rr AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT ov.query_id, ov.doc_id, round((1 + COALESCE({_COS}, 0.0)) * (shared /
     (SELECT COUNT(*) FROM b_qt WHERE b_qt.query_id = ov.query_id)), 6) AS score
   FROM ov JOIN qs q ON q.query_id = ov.query_id LEFT JOIN embeddings e ON e.vec_id = ov.doc_id) s) r WHERE rank <= 12)""",
          ["fused"])


@query("token_counts", f"""
WITH t AS ({_words('documents', 'doc_id', 'doc_id')})
SELECT d.doc_id, COUNT(term) AS n_tokens, COUNT(DISTINCT term) AS n_distinct FROM documents d
LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY 1""")
def token_counts(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", tokens("text").alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("n_tokens"),
                        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query("bm25_idf", sql("b_idf", "SELECT term, df, round(idf, 6) AS idf FROM b_idf"))
def bm25_idf(spark, sf):
    return R.bm25_index(table(spark, sf, "documents")).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_topk", sql("b_hits", "SELECT * FROM b_hits"))
def bm25_topk(spark, sf):
    return R.bm25_search(questions(spark, sf), R.bm25_index(table(spark, sf, "documents")))


@query("dense_topk", sql("dv", "SELECT * FROM dv"))
def dense_topk(spark, sf):
    return R.dense_search(vector_queries(spark, sf), vector_docs(spark, sf))


@query("dense_topk_filtered", sql("dq", "SELECT * FROM dq"))
def dense_topk_filtered(spark, sf):
    return R.dense_search(questions(spark, sf), corpus(spark, sf), filters={"doc_type": "en", "team": None})


@query("l2_normalise", """
SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS size_before,
 round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS total_after
FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS v FROM embeddings) s""")
def l2_normalise(spark, sf):
    scaled = table(spark, sf, "embeddings").withColumn("v", F.transform(Vx.doubles("embedding"), lambda x: x * (F.col("label") + 1)))
    total = F.aggregate(Vx.l2norm("v"), F.lit(0.0), lambda s, x: s + x)
    return scaled.select("vec_id", F.round(Vx.norm(F.col("v")), 6).alias("size_before"), F.round(total, 6).alias("total_after"))


@query("int8_quantise", """
WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127.0::DOUBLE
  AS step FROM embeddings),
c AS (SELECT vec_id, step, unnest(v) AS x FROM s)
SELECT vec_id, round(MAX(step), 9) AS step, CAST(SUM(round_even(x / step, 0)) AS BIGINT) AS code_sum,
 round(MAX(abs(x - round_even(x / step, 0) * step)), 9) AS max_error FROM c GROUP BY 1""")
def int8_quantise(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", Vx.doubles("embedding").alias("v")).withColumn(
        "step", Vx.int8_scale("v")).withColumn("q", Vx.int8_codes(F.col("v"), F.col("step")))
    back = Vx.int8_decode(F.col("q"), F.col("step"))
    error = F.array_max(F.zip_with("v", back, lambda a, b: F.abs(a - b)))
    codes = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    # The error first: a select that also renames ``step`` would feed the rounded step to the lambda.
    return rows.withColumn("max_error", F.round(error, 9)).select(
        "vec_id", F.round("step", 9).alias("step"), codes.alias("code_sum"), "max_error")


@query("rrf_hybrid", sql("fused", "SELECT * FROM fused"))
def rrf_hybrid(spark, sf):
    docs, asked = corpus(spark, sf), questions(spark, sf)
    return R.retrieve(asked, docs, filters={"doc_type": "en"}, use_rerank=False)


@query("rerank_topn", sql("rr", "SELECT query_id, doc_id, score, rank FROM rr WHERE rank <= 5"))
def rerank_topn(spark, sf):
    docs, asked = corpus(spark, sf), questions(spark, sf)
    fused = R.retrieve(asked, docs, filters={"doc_type": "en"}, use_rerank=False)
    return R.rerank(fused, asked, docs, n=5)


@query("hybrid_retrieve", sql("rr", "SELECT * FROM rr"))
def hybrid_retrieve(spark, sf):
    return R.retrieve(questions(spark, sf), corpus(spark, sf), filters={"doc_type": "en"})


def _fused(name: str, lists: list[str], k: int) -> None:
    votes = " UNION ALL ".join(f"SELECT query_id, doc_id, rank FROM {x}" for x in lists)
    add_block(name, f"""
{name} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)
   AS rank FROM (SELECT query_id, doc_id, round(SUM(1.0::DOUBLE / (60 + rank)), 9) AS score FROM ({votes}) u GROUP BY 1, 2) f) r
  WHERE rank <= {k})""", lists)


add_block("sq", """
sq AS (SELECT concat(item_id, ':', i) AS query_id, item_id, s[i] AS text, vector
  FROM (SELECT item_id, s, unnest(range(1, len(s) + 1)) AS i
   FROM (SELECT item_id, string_split(text, '. ') AS s FROM benchmark) a) b LEFT JOIN lv ON lv.label = item_id % 10)""", ["lv"])
bm25_blocks("s_", "documents", "doc_id", "sq", ["sq"])
_dense("s_dense", "sq", "", ["sq"], 80)
_fused("s_fused", ["s_dense", "s_hits"], 8)


@query("rrf_multi", sql("s_fused", """
SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
 FROM (SELECT CAST(split_part(query_id, ':', 1) AS BIGINT) AS query_id, doc_id, round(SUM(1.0::DOUBLE / (60 + rank)), 9) AS score FROM s_fused GROUP BY 1, 2) f) r
WHERE rank <= 8"""))
def rrf_multi(spark, sf):
    """Every sentence of a benchmark text is a subquery of it, asked for words and for its item's vector."""
    parts = questions(spark, sf).select("query_id", "vector", F.posexplode(F.split("text", r"\. ")).alias("i", "text"))
    asked = parts.select(F.concat_ws(":", "query_id", F.col("i") + 1).alias("query_id"), "text", "vector")
    sparse = R.bm25_search(asked, R.bm25_index(table(spark, sf, "documents")))
    dense = R.dense_search(asked, vector_docs(spark, sf))
    hits = R.top_k(R.rrf(dense, sparse), 8)
    item = F.split_part("query_id", F.lit(":"), F.lit(1)).cast("long")
    return R.rrf_multi(hits.select(item.alias("query_id"), "doc_id", "rank"))


_KEYED = "CAST(concat('0x', substr(md5({}), 1, 8)) AS BIGINT) % (SELECT MAX(vec_id) + 1 FROM embeddings)"
add_block("mq", f"""
mq AS (SELECT x.query_id, x.text, x.batter, x.bowler, e.embedding AS vector FROM (SELECT y.*, {_KEYED.format('query_id')} AS n
   FROM (SELECT DISTINCT concat(batter, ':', bowler) AS query_id,
    concat(batter, ' vs ', bowler, ' head to head performance') AS text, batter, bowler FROM h) y) x
  LEFT JOIN embeddings e ON e.vec_id = x.n)""", ["h"])
add_block("cdocs", f"""
cdocs AS (SELECT c.doc_id, c.doc_type, c.text, e.embedding FROM (SELECT y.*, {_KEYED.format('doc_id')} AS n
   FROM (SELECT doc_id, doc_type, text FROM sdocs UNION ALL SELECT doc_id, doc_type, text FROM pdocs
    UNION ALL SELECT doc_id, doc_type, text FROM vdocs) y) c LEFT JOIN embeddings e ON e.vec_id = c.n)""",
          ["sdocs", "pdocs", "vdocs"])
bm25_blocks("p_", "cdocs", "doc_id", "mq", ["cdocs", "mq"])
add_block("p_dense", f"""
p_dense AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)
   AS rank FROM (SELECT q.query_id, e.doc_id, round({_COS}, 6) AS score FROM mq q CROSS JOIN cdocs e
    WHERE e.doc_type = 'player_profile' AND e.embedding IS NOT NULL AND q.vector IS NOT NULL) s) r WHERE rank <= 80)""",
          ["mq", "cdocs"])
_fused("p_fused", ["p_dense", "p_hits"], 80)


def matchup_contexts(spark, sf):
    """Pairs against the whole corpus; the filter binds the dense list to player profiles."""
    pairs = deliveries(spark, sf).select("batter", "bowler").distinct()
    pairs = keyed_vectors(spark, sf, pairs, F.concat_ws(":", "batter", "bowler"))
    docs = stored(keyed_vectors(spark, sf, doc_corpus(spark, sf), F.col("doc_id")), "matchup-docs")
    return R.matchup_context(pairs, docs), docs


@query("matchup_context", sql("p_fused", """
SELECT query_id, batter, bowler, doc_id, score, rank FROM p_fused JOIN mq USING (query_id) WHERE rank <= 3"""))
def matchup_context(spark, sf):
    return matchup_contexts(spark, sf)[0].select("query_id", "batter", "bowler", "doc_id", "score", "rank")


@query("context_blocks", sql("rr", """
SELECT query_id, string_agg(concat('[SOURCE ', rank, ': ', upper(lang), ' – ', d.doc_id, ']', chr(10), substr(text, 1, 1200)),
 concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank) AS context, COUNT(*) AS n_sources
FROM rr JOIN documents d ON d.doc_id = rr.doc_id GROUP BY 1"""))
def context_blocks(spark, sf):
    docs = corpus(spark, sf)
    return R.context_blocks(R.retrieve(questions(spark, sf), docs, filters={"doc_type": "en"}), docs)


def _cells(spark, sf):
    return X.cell_index(vector_docs(spark, sf))


@query("ann_recall")
def ann_recall(spark, sf):
    """Recall of the ten best from as many cells as promise 0.9, and the share of all vectors that were scored."""
    asked, docs, index = vector_queries(spark, sf), vector_docs(spark, sf), _cells(spark, sf)
    found = stored(X.cell_search(asked, index, 10, X.probes_for(index, 10)), "ann-hits")
    share = found.groupBy("query_id").agg(F.round(F.first("scored") / int(index.size.sum()), 6).alias("share"))
    return R.recall(found, R.dense_search(asked, docs, 10)).join(share, "query_id")


@query("ann_exact", sql("dv", "SELECT * FROM dv WHERE rank <= 10"))
def ann_exact(spark, sf):
    """From cells, going on until no other can hold a better hit."""
    index = _cells(spark, sf)
    probes = max(1, len(index.size) // 8)
    return X.cell_search(vector_queries(spark, sf), index, 10, probes, exact=True).drop("scored")


@query("int8_search", sql("dv", "SELECT * FROM dv WHERE rank <= 10"))
def int8_search(spark, sf):
    """Codes of one byte a component first, then the vectors that could be among the ten best."""
    return X.code_search(vector_queries(spark, sf), X.code_index(vector_docs(spark, sf)), 10).drop("scored")


add_block("rq", """
rq AS (SELECT query_id, found, relevant, round(COALESCE(found / returned, 0.0), 6) AS precision_at_k,
  round(COALESCE(found / relevant, 0.0), 6) AS recall_at_k FROM (
 SELECT q.vec_id AS query_id, (SELECT COUNT(*) FROM embeddings t WHERE t.label = q.label) AS relevant,
  CAST((SELECT COUNT(*) FROM dv JOIN embeddings e ON e.vec_id = dv.doc_id WHERE dv.query_id = q.vec_id AND rank <= 10
    AND e.label = q.label) AS BIGINT) AS found,
  (SELECT COUNT(*) FROM dv WHERE dv.query_id = q.vec_id AND rank <= 10) AS returned
 FROM embeddings q WHERE q.vec_id % 100 = 0) s)""", ["dv"])


def quality_table(spark, sf):
    """Every vector whose id is divisible by 100 asks; vectors of its label are what it looks for."""
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    asked = vector_queries(spark, sf)
    wanted = asked.select("query_id").join(labels, F.col("query_id") == F.col("doc_id")).select("query_id", "label")
    return Qy.label_quality(R.dense_search(asked, vector_docs(spark, sf), 10), wanted, labels, 10)


@query("retrieval_quality", sql("rq", "SELECT * FROM rq"))
def retrieval_quality(spark, sf):
    return quality_table(spark, sf)


@query("metric_gate", sql("rq", """
SELECT metric, value, threshold, value >= threshold AS passed FROM (
 SELECT 'context_precision' AS metric, round(AVG(precision_at_k), 6) AS value, 0.55::DOUBLE AS threshold FROM rq
 UNION ALL SELECT 'context_recall', round(AVG(recall_at_k), 6), 0.55::DOUBLE FROM rq) s"""))
def metric_gate(spark, sf):
    means = quality_table(spark, sf).agg(
        F.round(F.avg("precision_at_k"), 6).alias("context_precision"), F.round(F.avg("recall_at_k"), 6).alias("context_recall"))
    metrics = means.unpivot([], ["context_precision", "context_recall"], "metric", "value")
    thresholds = spark.createDataFrame([("context_precision", 0.55), ("context_recall", 0.55)], "metric string, threshold double")
    return Qy.gate(metrics, thresholds)
