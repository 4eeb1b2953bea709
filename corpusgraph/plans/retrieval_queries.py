"""Registered queries of retrieval, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.functions import text as T
from corpusgraph.operators import retrieval as R
from corpusgraph.operators import vectors as V
from corpusgraph.sources.shared import write_table

from . import standins as S
from .graph_queries import matched_sql

Q: dict = {}
O: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


def vectors(spark, d):
    return S.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def vector_queries(spark, d):
    """Every vector whose id is divisible by 100 asks."""
    return S.table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def corpus(spark, d):
    """Documents as chunks of three pages under two headings."""
    i = F.col("doc_id")
    path = F.when(i % 2 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>"))
    return S.table(spark, d, "documents").select(i.alias("chunk_id"), F.col("text").alias("content"), i.alias("document_id"), F.concat(F.lit("doc_"), i.cast("string")).alias("file"), (i % 3).cast("int").alias("page_no"), path.alias("heading_path"), "source")


def questions(spark, d):
    """Each benchmark item asks with its words of even place, and after a nation."""
    words = F.split("text", r"\s+")
    nation = F.concat(F.lit("nation_"), (F.col("item_id") % 25).cast("string"))
    return S.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.array_join(F.filter(words, lambda w, i: i % 2 == 0), " "), nation).alias("question"))


def documents_where():
    """Hybrid search over the sources whose name does not end in 1."""
    return ~F.endswith("source", F.lit("1"))


VECTORS = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
V_MANY = f"{VECTORS}, dist AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_cosine_distance(q.e, c.e) AS distance FROM v AS q, v AS c WHERE q.vec_id % 100 = 0), vhits AS (SELECT query_id, chunk_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS INT) AS rank FROM dist QUALIFY rank <= 10)"
_DOCS = "docs_ AS (SELECT doc_id, text FROM documents WHERE {where})"
_TOK = "list_filter(string_split_regex(lower({0}), '\\s+'), lambda w: w <> '')"
_ASKED = "asked AS (SELECT item_id AS query_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w, i: i % 2 = 1), ' ') || ' nation_' || (item_id % 25) AS question FROM benchmark)"


def words_sql(where: str = "true") -> str:
    return f"""{_ASKED}, {_DOCS.format(where=where)},
tok AS MATERIALIZED (SELECT doc_id AS chunk_id, {_TOK.format("text")} AS w FROM docs_),
each AS (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM tok),
posted AS MATERIALIZED (SELECT chunk_id, any_value(dl) AS dl, term, count(*) AS tf FROM each GROUP BY chunk_id, term),
stats AS MATERIALIZED (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
terms AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS lift FROM (SELECT term, count(*) AS df FROM posted GROUP BY term) CROSS JOIN stats),
lifts AS MATERIALIZED (SELECT avg(lift) AS mean_lift FROM terms),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN lift < 0 THEN 0.25 * mean_lift ELSE lift END AS idf FROM terms CROSS JOIN lifts)"""


def bm25_sql(k: int, where: str = "true") -> str:
    return f"""{words_sql(where)}, qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOK.format("question")}) AS term FROM asked) GROUP BY query_id, term),
scores AS MATERIALIZED (SELECT query_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN idf USING (term) JOIN posted USING (term), stats GROUP BY query_id, chunk_id),
khits AS (SELECT query_id, chunk_id, coalesce(score, 0) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(score, 0), 9) DESC, chunk_id) AS INT) AS rank
  FROM (SELECT query_id, chunk_id FROM asked, tok) LEFT JOIN scores USING (query_id, chunk_id) QUALIFY rank <= {k})"""


def vectors_sql(k: int) -> str:
    """Hits of the offline embeddings; needs asked and docs_."""
    place = "('0x' || left(md5(w), 2))::INT % 64"
    part = lambda table, key, text: f"SELECT {key} AS id, place, count(*) AS n FROM (SELECT {key}, {place} AS place FROM (SELECT {key}, unnest({_TOK.format(chr(34) + 't' + chr(34))}) AS w FROM (SELECT {key}, CASE WHEN regexp_matches({text}, '\\S') THEN {text} ELSE '[empty]' END AS t FROM {table}))) GROUP BY {key}, place"
    return f"""dv AS MATERIALIZED ({part("docs_", "doc_id", "text")}), qv AS MATERIALIZED ({part("asked", "query_id", "question")}),
dn AS (SELECT id, sqrt(sum(n * n)) AS norm FROM dv GROUP BY id), qn AS (SELECT id, sqrt(sum(n * n)) AS norm FROM qv GROUP BY id),
dots AS (SELECT qv.id AS query_id, dv.id AS chunk_id, sum(qv.n * dv.n) AS dot FROM qv JOIN dv USING (place) GROUP BY qv.id, dv.id),
vhits AS (SELECT query_id, chunk_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INT) AS rank
  FROM (SELECT qn.id AS query_id, dn.id AS chunk_id, round(1 - coalesce(dot, 0) / (qn.norm * dn.norm), 9) AS distance FROM qn CROSS JOIN dn LEFT JOIN dots ON query_id = qn.id AND chunk_id = dn.id) QUALIFY rank <= {k})"""


MERGED = """both_ AS (SELECT query_id, chunk_id, 0 AS turn, rank FROM vhits UNION ALL SELECT query_id, chunk_id, 1, rank FROM khits),
first AS (SELECT query_id, chunk_id, min({'turn': turn, 'rank': rank}) AS spot FROM both_ GROUP BY query_id, chunk_id),
merged AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY spot.turn, spot.rank) AS INT) AS ordinal, CASE spot.turn WHEN 0 THEN 'vector' ELSE 'keyword' END AS channel FROM first)"""


def reranked_sql(k: int, least: float) -> str:
    """The best of merged (query_id, chunk_id, ordinal, channel)."""
    words = lambda c: f"list_distinct({_TOK.format(c)})"
    return f"""sc AS (SELECT query_id, chunk_id, ordinal, channel, text AS content, len(list_intersect({words("question")}, {words("text")})) / len({words("question")}) AS score FROM merged JOIN asked USING (query_id) JOIN documents ON doc_id = chunk_id),
pa AS (SELECT *, max(score >= {least}) OVER (PARTITION BY query_id) AS passed, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS by_score FROM sc),
ranked AS (SELECT query_id, chunk_id, content, channel, score, CAST(CASE WHEN passed THEN by_score ELSE ordinal END AS INT) AS rank FROM pa WHERE CASE WHEN passed THEN score >= {least} AND by_score <= {k} ELSE ordinal <= {min(k, 3)} END)"""


@query("v1_vector_search", f"WITH {VECTORS} SELECT c.vec_id AS chunk_id, round(list_cosine_distance(q.e, c.e), 5) AS distance FROM v AS q, v AS c WHERE q.vec_id = (SELECT min(vec_id) FROM v) AND c.label <= 4 ORDER BY list_cosine_distance(q.e, c.e), c.vec_id LIMIT 10")
def _(spark, d):
    v = vectors(spark, d)
    return R.vector_search(v, v.orderBy("chunk_id").first()["embedding"], 10, F.col("label") <= 4).withColumn("distance", F.round("distance", 5))


@query("v2_vector_search_many", f"WITH {V_MANY} SELECT query_id, chunk_id, rank, round(distance, 5) AS distance FROM vhits")
def _(spark, d):
    return R.vector_search_many(vectors(spark, d), vector_queries(spark, d), 10).withColumn("distance", F.round("distance", 5))


@query("v3_vector_search_lsh", None)
def _(spark, d):
    return R.vector_search_lsh(vectors(spark, d), vector_queries(spark, d), 10, 64)


@query("v3_inverted_lists", None)
def _(spark, d):
    return V.search_lists(V.build_lists(vectors(spark, d), 64), vector_queries(spark, d), 10)


@query("v3_inverted_lists_documents", None)
def _(spark, d):
    """Every document whose id is divisible by 100 asks for the documents nearest to it by the offline embedding."""
    v = write_table(R.hashed_embeddings(corpus(spark, d), "chunk_id", "content"), "document-vectors")
    return V.search_lists(V.build_lists(v, 64), v.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id"), 10)


@query("v4_check_dim", "SELECT vec_id AS query_id, len(embedding) = 64 AS dim_ok FROM embeddings")
def _(spark, d):
    return R.check_dim(vectors(spark, d).withColumnRenamed("chunk_id", "query_id"), 64).select("query_id", "dim_ok")


@query("s31_l2_normalize", "SELECT label, round(sum(list_inner_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))), 3) AS total FROM embeddings GROUP BY label")
def _(spark, d):
    n = vectors(spark, d).select("label", T.l2_normalize("embedding").alias("u"))
    return n.groupBy("label").agg(F.round(F.sum(T.dot("u", "u")), 3).alias("total"))


@query("l1_lexical_stats", f"WITH {words_sql()} SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def _(spark, d):
    return R.lexical_stats(R.term_counts(corpus(spark, d))).withColumn("avgdl", F.round("avgdl", 6))


@query("l2_bm25_idf", f"WITH {words_sql()} SELECT term, df, round(idf, 6) AS idf FROM idf")
def _(spark, d):
    return R.bm25_idf(write_table(R.term_counts(corpus(spark, d)), "bm25-terms")).withColumn("idf", F.round("idf", 6))


@query("l3_bm25_search", f"WITH {bm25_sql(10)} SELECT query_id, chunk_id, rank, round(score, 5) AS score FROM khits")
def _(spark, d):
    return R.bm25_search(corpus(spark, d), questions(spark, d), 10).withColumn("score", F.round("score", 5))


@query("l3_bm25_search_where", f"WITH {bm25_sql(10, 'NOT suffix(source, chr(49))')} SELECT query_id, chunk_id, rank, round(score, 5) AS score FROM khits")
def _(spark, d):
    return R.bm25_search(corpus(spark, d), questions(spark, d), 10, documents_where()).withColumn("score", F.round("score", 5))


@query("h1_hybrid_candidates", f"WITH {bm25_sql(10)}, {vectors_sql(10)}, {MERGED} SELECT query_id, chunk_id, ordinal, channel FROM merged")
def _(spark, d):
    c, q = corpus(spark, d), questions(spark, d)
    v = R.vector_search_many(R.hashed_embeddings(c, "chunk_id", "content"), R.hashed_embeddings(q, "query_id", "question"), 10)
    return R.merge_hybrid(v, R.bm25_search(c, q, 10))


KEYWORD_RANKED = f"{bm25_sql(10)}, merged AS (SELECT query_id, chunk_id, rank AS ordinal, 'keyword' AS channel FROM khits), {reranked_sql(5, 0.3)}"


def _reranked(spark, d):
    hits = R.bm25_search(corpus(spark, d), questions(spark, d), 10).select("query_id", "chunk_id", F.col("rank").alias("ordinal"))
    full = hits.join(corpus(spark, d), "chunk_id").join(questions(spark, d), "query_id")
    return R.rerank(full, R.coverage_score(), 5, 0.3)


@query("rr1_rerank", f"WITH {KEYWORD_RANKED} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM ranked")
def _(spark, d):
    return _reranked(spark, d).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def page_tables(assets):
    return assets.filter("page_no = 2").withColumns({"num_rows": (F.col("document_id") % 7).cast("int"), "num_cols": F.lit(2)})


_CITE = "'doc_' || chunk_id || CASE WHEN chunk_id % 3 > 0 THEN ' | p.' || (chunk_id % 3) ELSE '' END || CASE WHEN chunk_id % 2 = 0 THEN ' | A > B' ELSE '' END"
_HITS = f"h AS (SELECT query_id, '## Retrieved Document Sections' || chr(10) || string_agg('### [' || rank || '] ' || {_CITE} || chr(10) || content || chr(10), chr(10) ORDER BY rank) AS h FROM ranked GROUP BY query_id)"
_ON_PAGE = "SELECT DISTINCT query_id, document_id, assets.page_no, asset_id, caption FROM ranked JOIN assets ON document_id = chunk_id AND assets.page_no = chunk_id % 3 WHERE chunk_id % 3 > 0"
_PAGES = f"""{S.ASSETS}, im AS (SELECT query_id, '## Available Document Images' || chr(10) || string_agg('- Image p.' || page_no || ': "' || caption || '" (id: ' || asset_id || ')', chr(10) ORDER BY document_id, page_no, asset_id) || chr(10) AS i FROM ({_ON_PAGE}) GROUP BY query_id),
ta AS (SELECT query_id, '## Available Document Tables' || chr(10) || string_agg('- Table p.' || page_no || ' (' || (document_id % 7) || 'x2): "' || caption || '"', chr(10) ORDER BY document_id, page_no, asset_id) || chr(10) AS t FROM ({_ON_PAGE}) WHERE page_no = 2 GROUP BY query_id)"""


@query("x1_context", f"WITH {KEYWORD_RANKED}, {_HITS}, {_PAGES} SELECT query_id, concat_ws(chr(10), h, i, t) AS context FROM h LEFT JOIN im USING (query_id) LEFT JOIN ta USING (query_id)")
def _(spark, d):
    hits, assets = write_table(_reranked(spark, d), "hits"), S.assets(spark, d)
    return R.assemble_context(hits, None, R.page_assets(hits, assets), R.page_assets(hits, page_tables(assets)))


@query("x2_context_flat", f"WITH {KEYWORD_RANKED} SELECT query_id, string_agg('[' || rank || '] ' || {_CITE} || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM ranked GROUP BY query_id")
def _(spark, d):
    return R.assemble_context_flat(_reranked(spark, d))


@query("s6_citations", f"WITH x AS (SELECT doc_id AS chunk_id FROM documents) SELECT chunk_id, {_CITE} AS citation FROM x")
def _(spark, d):
    i = F.col("chunk_id")
    path = F.when(i % 2 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>"))
    return corpus(spark, d).select(i, T.format_citation(F.concat(F.lit("doc_"), i.cast("string")), (i % 3).cast("int"), path).alias("citation"))


@query("s19_question_keywords", "WITH k AS (SELECT item_id, unnest(string_split_regex(lower(trim(text)), '\\s+')) AS w FROM benchmark), b AS (SELECT DISTINCT item_id, regexp_replace(w, '^[.,?!:;\"''()\\[\\]{}]+|[.,?!:;\"''()\\[\\]{}]+$', '', 'g') AS kw FROM k) SELECT item_id, kw FROM b WHERE length(kw) >= 2")
def _(spark, d):
    return S.table(spark, d, "benchmark").select("item_id", F.explode(T.question_keywords("text")).alias("kw"))


@query("q1_retrieve", f"WITH {bm25_sql(24)}, {vectors_sql(24)}, {MERGED}, {reranked_sql(8, 0.15)} SELECT query_id, chunk_id, rank, channel, round(score, 6) AS score FROM ranked")
def _(spark, d):
    return R.retrieve(corpus(spark, d), questions(spark, d)).select("query_id", "chunk_id", "rank", "channel", F.round("score", 6).alias("score"))


@query("q1_retrieve_where", f"WITH {bm25_sql(24, 'NOT suffix(source, chr(49))')}, {vectors_sql(24)}, {MERGED}, {reranked_sql(8, 0.15)} SELECT query_id, chunk_id, rank, channel, round(score, 6) AS score FROM ranked")
def _(spark, d):
    return R.retrieve(corpus(spark, d), questions(spark, d), where=documents_where()).select("query_id", "chunk_id", "rank", "channel", F.round("score", 6).alias("score"))


@query("q2_retrieve_vector", f"WITH {_ASKED}, {_DOCS.format(where='true')}, {vectors_sql(5)}, ranked AS (SELECT query_id, chunk_id, rank, text AS content FROM vhits JOIN documents ON doc_id = chunk_id) SELECT query_id, string_agg('[' || rank || '] ' || {_CITE} || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM ranked GROUP BY query_id")
def _(spark, d):
    return R.assemble_context_flat(R.retrieve_vector(corpus(spark, d), questions(spark, d)))


_GRAPH_TEXT = f"""e AS (SELECT query_id, string_agg('- ' || id || ' [' || entity_type || ']' || CASE WHEN description <> '' THEN ': ' || description ELSE '' END, chr(10) ORDER BY place) AS e FROM matched JOIN nodes USING (id) GROUP BY query_id),
r AS (SELECT query_id, string_agg('- ' || source || ' → ' || target || ': ' || description, chr(10) ORDER BY place) AS r FROM rels GROUP BY query_id),
g AS (SELECT query_id, '## Knowledge Graph Insights' || chr(10) || 'Entities found in documents:' || chr(10) || e || coalesce(chr(10) || chr(10) || 'Relationships:' || chr(10) || r, '') || chr(10) AS g FROM e LEFT JOIN r USING (query_id))"""


@query("q3_answer_contexts", f"WITH {bm25_sql(24)}, {vectors_sql(24)}, {MERGED}, {reranked_sql(8, 0.15)}, {S.GRAPH}, {matched_sql()}, {_GRAPH_TEXT}, {_HITS}, {_PAGES} SELECT query_id, coalesce(nullif(concat_ws(chr(10), g, h, i, t), ''), 'No relevant documents found for this query.') AS context FROM (SELECT DISTINCT query_id FROM asked) LEFT JOIN g USING (query_id) LEFT JOIN h USING (query_id) LEFT JOIN im USING (query_id) LEFT JOIN ta USING (query_id)")
def _(spark, d):
    assets = S.assets(spark, d)
    return R.answer_contexts(corpus(spark, d), questions(spark, d), S.nodes(spark, d), S.edges(spark, d), assets, page_tables(assets))


@query("x3_chat_context", None)
def _(spark, d):
    from corpusgraph.operators import chat

    return chat.assemble_chat_context(_reranked(spark, d))
