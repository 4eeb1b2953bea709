"""Registered queries of the knowledge graph, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.functions import text as T
from corpusgraph.operators import graph as G

from . import standins as S

Q: dict = {}
O: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


def graph(spark, d):
    return S.nodes(spark, d), S.edges(spark, d)


@query("a8_degree", f"WITH {S.GRAPH} SELECT id, degree FROM degrees")
def _(spark, d):
    return G.degree(S.edges(spark, d))


@query("f4_kg_entities", f"WITH {S.GRAPH} SELECT id, coalesce(degree, 0) AS degree, entity_type FROM nodes LEFT JOIN degrees USING (id) WHERE contains(lower(id), '1') AND entity_type = 'Nation' ORDER BY degree DESC, id LIMIT 5 OFFSET 2")
def _(spark, d):
    return G.kg_entities(*graph(spark, d), "1", "nation", 5, 2).select("id", "degree", "entity_type")


@query("f5_entity_list", f"WITH {S.GRAPH} SELECT id, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN degrees USING (id) WHERE contains(lower(id), 'mach') OR contains(lower(description), 'mach')")
def _(spark, d):
    return G.entity_list(*graph(spark, d), "MACH", "type").select("id", "degree")


@query("f6_kg_relationships", f"WITH {S.GRAPH} SELECT source, target, description FROM edges WHERE lower(source) = 'nation_1' OR lower(target) = 'nation_1' ORDER BY source, target LIMIT 500")
def _(spark, d):
    return G.kg_relationships(S.edges(spark, d), "NATION_1").select("source", "target", "description")


@query("g8_neighbours", f"WITH {S.GRAPH} SELECT target AS other, 'out' AS direction, description FROM edges WHERE source = 'NATION_2' UNION ALL SELECT source, 'in', description FROM edges WHERE target = 'NATION_2'")
def _(spark, d):
    return G.neighbours(S.edges(spark, d), "NATION_2")


@query("a6_kg_analytics", f"WITH {S.GRAPH}, d AS (SELECT id, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN degrees USING (id)) SELECT (SELECT count(*) FROM nodes) AS entity_count, (SELECT count(*) FROM edges) AS relationship_count, (SELECT round(avg(degree), 2) FROM d) AS avg_degree, (SELECT list(id ORDER BY degree DESC, id) FROM (SELECT * FROM d ORDER BY degree DESC, id LIMIT 10)) AS top, (SELECT list({{'entity_type': entity_type, 'n': n}} ORDER BY entity_type) FROM (SELECT entity_type, count(*) AS n FROM nodes GROUP BY entity_type)) AS types")
def _(spark, d):
    return G.kg_analytics(*graph(spark, d))


@query("a7_type_distribution", f"WITH {S.GRAPH} SELECT entity_type, count(*) AS n, count(*) / (SELECT count(*) FROM nodes) AS share FROM nodes GROUP BY entity_type")
def _(spark, d):
    return G.type_distribution(S.nodes(spark, d))


@query("a18_entity_types", f"WITH {S.GRAPH} SELECT DISTINCT entity_type FROM nodes")
def _(spark, d):
    return G.entity_types(S.nodes(spark, d))


@query("t9_top_entities", f"WITH {S.GRAPH} SELECT id, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN degrees USING (id) ORDER BY degree DESC, id LIMIT 10")
def _(spark, d):
    return G.kg_entities(*graph(spark, d), limit=10).select("id", "degree")


def asked(spark, d):
    """Each benchmark item asks with its text, and after a nation and a customer."""
    i = F.col("item_id")
    question = F.concat("text", F.lit(" nation_"), (i % 25).cast("string"), F.lit("? Customer#00000000"), (i % 10).cast("string"), F.lit(" or re, of furniture"))
    return S.table(spark, d, "benchmark").select(i.alias("query_id"), question.alias("question"))


ASKED = "asked AS (SELECT item_id AS query_id, text || ' nation_' || (item_id % 25) || '? Customer#00000000' || (item_id % 10) || ' or re, of furniture' AS question FROM benchmark)"


def matched_sql() -> str:
    """Entities and edges that the questions of asked name; needs the graph and asked."""
    return """kw AS (SELECT DISTINCT query_id, regexp_replace(w, '^[.,?!:;"\'\'()\\[\\]{}]+|[.,?!:;"\'\'()\\[\\]{}]+$', '', 'g') AS kw FROM (SELECT query_id, unnest(string_split_regex(lower(question), '\\s+')) AS w FROM asked)),
pieces AS (SELECT DISTINCT id, unnest(list_concat([lower(id)], string_split(lower(id), '-'))) AS piece FROM nodes),
found AS (SELECT DISTINCT query_id, id FROM kw, pieces WHERE length(kw) >= 2 AND (contains(piece, kw) OR contains(kw, piece))),
matched AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY id) AS INT) AS place FROM found QUALIFY place <= 20),
rels AS (SELECT query_id, source, target, description, CAST(row_number() OVER (PARTITION BY query_id ORDER BY source, target, description) AS INT) AS place FROM (SELECT DISTINCT query_id, source, target, edges.description FROM matched JOIN edges ON lower(source) = lower(id) OR lower(target) = lower(id)) QUALIFY place <= 30)"""


MATCHED = f"{S.GRAPH}, {ASKED}, {matched_sql()}"


@query("j4_match_entities", f"WITH {MATCHED} SELECT query_id, id, place FROM matched")
def _(spark, d):
    return G.match_entities(asked(spark, d), S.nodes(spark, d))


@query("j5_edges_touching", f"WITH {MATCHED} SELECT query_id, source, target, description, place FROM rels")
def _(spark, d):
    return G.edges_touching(G.match_entities(asked(spark, d), S.nodes(spark, d)), S.edges(spark, d))


@query("g7_graph_context", f"WITH {MATCHED}, e AS (SELECT query_id, string_agg('- ' || id || ' [' || entity_type || ']' || CASE WHEN description <> '' THEN ': ' || description ELSE '' END, chr(10) ORDER BY place) AS e FROM matched JOIN nodes USING (id) GROUP BY query_id), r AS (SELECT query_id, string_agg('- ' || source || ' → ' || target || ': ' || description, chr(10) ORDER BY place) AS r FROM rels GROUP BY query_id) SELECT query_id, 'Entities found in documents:' || chr(10) || e || coalesce(chr(10) || chr(10) || 'Relationships:' || chr(10) || r, '') AS insights FROM e LEFT JOIN r USING (query_id)")
def _(spark, d):
    return G.graph_context(asked(spark, d), *graph(spark, d))


@query("j6_related_entities", f"WITH {S.GRAPH}, top AS (SELECT id, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN degrees USING (id) WHERE length(id) >= 2 ORDER BY degree DESC, id LIMIT 200), a AS (SELECT o_orderkey AS answer_id, 'About NATION_' || (o_custkey % 30) || ' and region' AS answer FROM orders) SELECT answer_id, id, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY degree DESC, id) AS INT) AS place FROM a JOIN top ON contains(lower(answer), lower(id)) QUALIFY place <= 30")
def _(spark, d):
    a = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("answer_id"), F.concat(F.lit("About NATION_"), (F.col("o_custkey") % 30).cast("string"), F.lit(" and region")).alias("answer"))
    return G.related_entities(a, *graph(spark, d))


@query("g6_subgraph", f"WITH RECURSIVE {S.GRAPH}, both_ AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges), walk AS (SELECT 'NATION_3' AS id, 0 AS hop UNION SELECT target, hop + 1 FROM walk JOIN both_ ON source = id WHERE hop < 2), hops AS (SELECT id, CAST(min(hop) AS INT) AS hop FROM walk GROUP BY id) SELECT id, hop, degree FROM hops JOIN degrees USING (id) ORDER BY hop, degree DESC, id LIMIT 150")
def _(spark, d):
    return G.subgraph(*graph(spark, d), "NATION_3", 2, 150)


@query("g6_is_truncated", f"WITH RECURSIVE {S.GRAPH}, both_ AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges), walk AS (SELECT 'NATION_3' AS id, 0 AS hop UNION SELECT target, hop + 1 FROM walk JOIN both_ ON source = id WHERE hop < 2) SELECT count(DISTINCT id) > 20 AS is_truncated FROM walk")
def _(spark, d):
    g = graph(spark, d)
    return G.is_truncated(G.subgraph(*g, "NATION_3", 2, 20), *g, "NATION_3", 2)


@query("g6_subgraph_edges", f"WITH {S.GRAPH}, shown AS (SELECT r_name AS id FROM region UNION ALL SELECT n_name FROM nation) SELECT source, target, description AS label, 1.0::DOUBLE AS weight FROM edges WHERE source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown)")
def _(spark, d):
    return G.subgraph_edges(S.nodes(spark, d).filter("entity_type in ('Region', 'Nation')"), S.edges(spark, d))


@query("g7_small_graph", f"WITH {S.GRAPH}, few AS (SELECT * FROM nodes WHERE entity_type = 'Region' ORDER BY id LIMIT 10), e AS (SELECT string_agg('- ' || id || ' [Region]', chr(10) ORDER BY id) AS e FROM few), r AS (SELECT string_agg('- ' || source || ' → ' || target || ': ' || description, chr(10) ORDER BY source, target) AS r FROM edges WHERE target IN (SELECT id FROM few)) SELECT query_id, 'Entities found in documents:' || chr(10) || e || chr(10) || chr(10) || 'Relationships:' || chr(10) || r AS insights FROM (SELECT DISTINCT o_custkey AS query_id FROM orders), e, r")
def _(spark, d):
    q = S.table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.lit("zzzz ?").alias("question")).distinct()
    return G.graph_context(q, S.nodes(spark, d).filter("entity_type = 'Region'"), S.edges(spark, d))


MENTIONS = "mentions AS (SELECT o_orderkey AS position, CASE WHEN o_orderkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name, c_mktsegment AS type, round(o_totalprice % 100 / 100, 2) AS score FROM orders JOIN customer ON o_custkey = c_custkey)"


def mentions(spark, d):
    o, c = S.table(spark, d, "orders"), S.table(spark, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("position"), F.when(F.col("o_orderkey") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("type"), S.rounded(F.col("o_totalprice") % 100 / 100, 2).alias("score"))


@query("g1_merge_mentions", f"WITH {MENTIONS} SELECT name, type, score, position FROM mentions WHERE score >= 0.45 QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY score DESC, position) = 1")
def _(spark, d):
    return G.merge_mentions(mentions(spark, d))


RELATIONS = "relations AS (SELECT l_orderkey * 10 + l_linenumber AS position, 'part ' || (l_partkey % 40) AS source, CASE WHEN l_linenumber % 2 = 0 THEN 'Part ' ELSE 'part ' END || (l_suppkey % 40) AS target, CASE l_returnflag WHEN 'A' THEN 'made_by' ELSE 'sold_by' END AS relation_type FROM lineitem)"


def relations(spark, d):
    n = lambda c: (F.col(c) % 40).cast("string")
    return S.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), F.concat(F.lit("part "), n("l_partkey")).alias("source"),
        F.concat(F.when(F.col("l_linenumber") % 2 == 0, "Part ").otherwise("part "), n("l_suppkey")).alias("target"), F.when(F.col("l_returnflag") == "A", "made_by").otherwise("sold_by").alias("relation_type"),
    )


MERGED = f"{RELATIONS}, merged AS (SELECT source, target, relation_type, source || ' ' || replace(relation_type, '_', ' ') || ' ' || target || '.' AS description FROM relations WHERE lower(source) <> lower(target) QUALIFY row_number() OVER (PARTITION BY least(lower(source), lower(target)), greatest(lower(source), lower(target)), relation_type ORDER BY position, source, target) = 1)"


@query("g2_merge_relations", f"WITH {MERGED} SELECT * FROM merged")
def _(spark, d):
    return G.merge_relations(relations(spark, d))


@query("u2_ensure_entities", f"WITH {MERGED}, known AS (SELECT DISTINCT 'part ' || (p_partkey % 20) AS name FROM part), ends AS (SELECT lower(name) AS low, min(name) AS name FROM (SELECT source AS name FROM merged UNION ALL SELECT target FROM merged) GROUP BY lower(name)) SELECT name, 'Part' AS type, '' AS description FROM known UNION ALL SELECT name, 'Other', 'Entity inferred from relation extraction.' FROM ends WHERE low NOT IN (SELECT lower(name) FROM known)")
def _(spark, d):
    known = S.table(spark, d, "part").select(F.concat(F.lit("part "), (F.col("p_partkey") % 20).cast("string")).alias("name"), F.lit("Part").alias("type")).distinct()
    return G.ensure_entities(known, G.merge_relations(relations(spark, d)))


@query("tx5_decode_graph_log", "SELECT 0 AS part, s_name AS a, CASE WHEN s_suppkey % 2 = 0 THEN 'Other' ELSE 'Supplier' END AS b, 'sells' AS c, '' AS d FROM supplier UNION ALL SELECT 1, s_name, 'NATION_1', CASE WHEN s_suppkey % 3 = 0 THEN 'related to' ELSE 'Sells From' END, 'it does' FROM supplier")
def _(spark, d):
    s = S.table(spark, d, "supplier")
    kind, words = F.when(F.col("s_suppkey") % 2 == 0, "").otherwise("Supplier"), F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise("Sells_From")
    log = s.select(F.concat(F.lit("entity<|#|>"), "s_name", F.lit("<|#|>"), kind, F.lit("<|#|>sells\nnoise line\nrelation<|#|>"), "s_name", F.lit("<|#|>NATION_1<|#|>"), words, F.lit("<|#|>it does\n<|COMPLETE|>")).alias("output"))
    e, r = G.decode_graph_log(log)
    return e.select(F.lit(0).alias("part"), F.col("name").alias("a"), F.col("type").alias("b"), F.col("description").alias("c"), F.lit("").alias("d")).unionByName(r.select(F.lit(1).alias("part"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("keywords").alias("c"), F.col("description").alias("d")))


@query("s24_record_fields", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'related_to' ELSE 'Works_At_' || l_returnflag END AS relation, CASE WHEN l_linenumber % 3 = 0 THEN 'related to' ELSE 'Works At ' || l_returnflag END AS keywords, CASE WHEN l_linenumber % 3 = 0 THEN 'Other' ELSE 'Works At ' || l_returnflag END AS type, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'Works At ' || l_returnflag END AS field FROM lineitem")
def _(spark, d):
    raw = F.when(F.col("l_linenumber") % 3 == 0, F.lit(" <|#|>\n")).otherwise(F.concat(F.lit("Works\r\n<|COMPLETE|>At\t"), "l_returnflag", F.lit("<|#|>")))
    return S.table(spark, d, "lineitem").withColumn("x", raw).select("l_orderkey", "l_linenumber", *[T.sanitize_kg_field("x", k).alias(k) for k in ("relation", "keywords", "type", "field")])


@query("g3_decode_triplets", "SELECT s_suppkey, s_name AS head, 'org' AS head_type, 'NATION_' || s_nationkey AS tail, 'loc' AS tail_type, 'sells from' AS relation FROM supplier UNION ALL SELECT s_suppkey, s_name, 'per', 'the region', 'loc', 'Lies In' FROM supplier UNION ALL SELECT s_suppkey, 'NATION_' || s_nationkey, 'loc', s_name, 'org', 'hosts' FROM supplier WHERE s_suppkey % 2 = 0")
def _(spark, d):
    nation = F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string"))
    more = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" <relation> "), nation, F.lit(" <loc> "), "s_name", F.lit(" <org> hosts"))).otherwise(" <triplet> left <x> open <y>")
    log = F.concat(F.lit("tp_XX<s> <triplet> "), "s_name", F.lit(" <org> "), nation, F.lit(" <loc> sells  from <per> the region <loc> Lies In"), more, F.lit("</s><pad>"))
    s = S.table(spark, d, "supplier").select("s_suppkey", F.explode(G.decode_triplets(log)).alias("x"))
    return s.select("s_suppkey", "x.*")


@query("g5_build_graph", None)
def _(spark, d):
    nodes, edges = G.build_graph(S.chunks(spark, d))
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), F.col("documents").alias("n")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("weight").alias("n")))


@query("g5_corpus_graph", None)
def _(spark, d):
    g = G.corpus_graph(S.chunks(spark, d))
    nodes = g["nodes"].select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), F.col("entity_type").alias("type"), "description", F.col("documents").cast("double").alias("n"))
    return nodes.unionByName(g["edges"].select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("keywords").alias("type"), "description", F.col("weight").alias("n")))


@query("g4_record_lines", f"WITH {S.GRAPH} SELECT 'entity<|#|>' || id || '<|#|>' || entity_type || '<|#|>' || description AS line FROM nodes UNION ALL SELECT 'relation<|#|>' || source || '<|#|>' || target || '<|#|>place<|#|>' || description FROM edges")
def _(spark, d):
    return G.kg_lines_encode(S.nodes(spark, d).select(F.col("id").alias("name"), F.col("entity_type").alias("type"), "description"), S.edges(spark, d))
