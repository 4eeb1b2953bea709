"""Knowledge graph tables: mentions to nodes and edges, search, neighbourhoods, analytics, context text.

Unless a function says otherwise: a null id is a group of its own where rows are grouped and meets nothing where they are joined, a
null text gives null (and is no text where texts are looked into), equal rows count each, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions import text as T
from corpusgraph.operators.names import names_in_text
from corpusgraph.sources.shared import write_table


def degree(edges: DataFrame) -> DataFrame:
    """id, degree; a loop counts twice."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degree(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def kg_entities(nodes: DataFrame, edges: DataFrame, search: str = "", kind: str = "", limit: int = 200, offset: int = 0) -> DataFrame:
    df = nodes.filter(F.contains(F.lower("id"), F.lit(search.lower())))
    df = df.filter(F.lower("entity_type") == kind.lower()) if kind else df
    return with_degree(df, edges).orderBy(F.desc("degree"), "id").offset(offset).limit(limit)


def entity_list(nodes: DataFrame, edges: DataFrame, search: str = "", sort: str = "degree") -> DataFrame:
    """Search in names and descriptions; sorted by name, by type then degree, or by degree."""
    q = F.lit(search.lower())
    df = with_degree(nodes.filter(F.contains(F.lower("id"), q) | F.contains(F.lower("description"), q)), edges)
    order = {"name": ["id"], "type": ["entity_type", F.desc("degree"), "id"], "degree": [F.desc("degree"), "id"]}[sort]
    return df.orderBy(*order)


def entity_types(nodes: DataFrame) -> DataFrame:
    """entity_type: the different types, in order, null first."""
    return nodes.select("entity_type").distinct().orderBy("entity_type")


def kg_relationships(edges: DataFrame, entity: str = "", limit: int = 500) -> DataFrame:
    e = entity.lower()
    df = edges.filter((F.lower("source") == e) | (F.lower("target") == e)) if e else edges
    return df.orderBy("source", "target").limit(limit)


def neighbours(edges: DataFrame, entity: str) -> DataFrame:
    out = edges.filter(F.col("source") == entity).select(F.col("target").alias("other"), F.lit("out").alias("direction"), "description")
    return out.unionByName(edges.filter(F.col("target") == entity).select(F.col("source").alias("other"), F.lit("in").alias("direction"), "description"))


def kg_analytics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, types, the ten entities of highest degree, the mean degree."""
    d = with_degree(nodes, edges)
    counts = d.agg(F.count(F.lit(1)).alias("entity_count"), F.round(F.coalesce(F.avg("degree"), F.lit(0.0)), 2).alias("avg_degree"))
    rel = edges.agg(F.count(F.lit(1)).alias("relationship_count"))
    types = nodes.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).agg(F.sort_array(F.collect_list(F.struct("entity_type", "n"))).alias("types"))
    top = d.orderBy(F.desc("degree"), "id").limit(10).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("degree")).alias("d"), "id"))), lambda x: x["id"]).alias("top"))
    return counts.crossJoin(rel).crossJoin(types).crossJoin(top)


def type_distribution(nodes: DataFrame) -> DataFrame:
    n = nodes.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def match_entities(questions: DataFrame, nodes: DataFrame, max_entities: int = 20) -> DataFrame:
    """query_id, id, place: entities whose name (or a part of it between hyphens) holds a keyword of the question or is held by one.

    Keywords that stand in a name are found by one pass over the names (names_in_text); names that stand in a keyword meet it over the
    keyword's own substrings, so the join is one of equal strings, and a keyword's length bounds what it gives. Null names and
    questions meet nothing; of more than max_entities the first by id stay.
    """
    kws = questions.select("query_id", F.explode(T.question_keywords("question")).alias("kw")).distinct()
    low = F.lower("id")
    pieces = nodes.filter("id is not null").select("id", F.explode(F.array_distinct(F.concat(F.array(low), F.split(low, "-")))).alias("piece"))
    inside = names_in_text(pieces, "id", "piece", kws, "kw").distinct().join(kws, "kw").select("query_id", "id")
    words = kws.select("kw").distinct().withColumn("i", F.explode(F.sequence(F.lit(1), F.length("kw"))))
    parts = words.select("kw", F.explode(F.transform(F.sequence(F.lit(1), F.length("kw") - F.col("i") + 1), lambda n: F.substring("kw", F.col("i"), n))).alias("piece")).distinct()
    around = parts.join(pieces, "piece").join(kws, "kw").select("query_id", "id")
    # an empty part of a name stands in every keyword
    empty = pieces.filter("piece = ''").select("id").distinct().orderBy("id").limit(max_entities)
    around = around.unionByName(kws.select("query_id").distinct().crossJoin(F.broadcast(empty)))  # max_entities rows
    found = inside.unionByName(around).distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
    return found.withColumn("place", place).filter(F.col("place") <= max_entities)


def edges_touching(matched: DataFrame, edges: DataFrame, limit: int = 30) -> DataFrame:
    """query_id, source, target, description, place: edges with an end among a query's entities."""
    ends = edges.withColumn("end", F.explode(F.array_distinct(F.array(F.lower("source"), F.lower("target")))))
    met = matched.select("query_id", F.lower("id").alias("end")).join(ends, "end").select("query_id", "source", "target", "description").distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("source", "target", "description"))
    return met.withColumn("place", place).filter(F.col("place") <= limit)


def graph_context(questions: DataFrame, nodes: DataFrame, edges: DataFrame, max_entities: int = 20, max_edges: int = 30, small: int = 50, first: int = 10) -> DataFrame:
    """query_id, insights: the text of the matched entities and their relationships.

    A question that names no entity has no row, but in a graph of `small` nodes at most it gets the `first` ones by id.
    """
    matched = match_entities(questions, nodes, max_entities)
    if nodes.limit(small + 1).count() <= small:
        some = nodes.select("id").orderBy("id").limit(first).withColumn("place", F.row_number().over(Window.orderBy("id")))  # `first` rows
        unmet = questions.select("query_id").distinct().join(matched, "query_id", "left_anti")
        matched = matched.unionByName(unmet.crossJoin(F.broadcast(some)))
    kind = F.when(~F.col("entity_type").isin("", "Unknown"), F.concat(F.lit(" ["), "entity_type", F.lit("]"))).otherwise("")
    note = F.when(F.col("description") != "", F.concat(F.lit(": "), T.truncate("description", 200))).otherwise("")
    lines = matched.join(nodes, "id").withColumn("line", F.concat(F.lit("- "), "id", kind, note))
    collected = lambda df, name: df.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias(name))
    tie = F.when(F.col("description") != "", F.concat(F.lit(": "), T.truncate("description", 150))).otherwise("")
    rels = edges_touching(matched, edges, max_edges).withColumn("line", F.concat(F.lit("- "), "source", F.lit(" → "), "target", tie))
    met = collected(lines, "e").join(collected(rels, "r"), "query_id", "left")
    return met.select("query_id", F.concat(F.lit("Entities found in documents:\n"), "e", F.coalesce(F.concat(F.lit("\n\nRelationships:\n"), "r"), F.lit(""))).alias("insights"))


def related_entities(answers: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 30, pool: int = 200) -> DataFrame:
    """answer_id, id, place: entities among the `pool` of highest degree whose names (of two characters at least) the answer holds, whatever the case. Null answers hold none."""
    top = write_table(with_degree(nodes, edges).filter(F.length("id") >= 2).orderBy(F.desc("degree"), "id").limit(pool).select("id", F.lower("id").alias("name"), "degree"), "top-entities")
    met = names_in_text(answers.withColumn("_low", F.lower("answer")), "answer_id", "_low", top).distinct().join(F.broadcast(top), "name")  # pool rows
    place = F.row_number().over(Window.partitionBy("answer_id").orderBy(F.desc("degree"), "id"))
    return met.withColumn("place", place).filter(F.col("place") <= limit).select("answer_id", "id", "place")


def subgraph(nodes: DataFrame, edges: DataFrame, center: str = "*", depth: int = 3, max_nodes: int = 150) -> DataFrame:
    """id, hop, degree of the nodes within `depth` edges of the center (`*`: the node of highest degree), nearest and best-connected first."""
    deg = with_degree(nodes, edges)
    start = deg.orderBy(F.desc("degree"), "id").limit(1).select("id") if center == "*" else nodes.filter(F.col("id") == center).select("id")
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    seen = start.withColumn("hop", F.lit(0))
    for hop in range(1, depth + 1):
        edge = seen.filter(F.col("hop") == hop - 1).join(both, F.col("id") == F.col("source")).select(F.col("target").alias("id")).distinct()
        seen = seen.unionByName(edge.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)))
    return seen.join(deg.select("id", "degree"), "id").orderBy("hop", F.desc("degree"), "id").limit(max_nodes)


def is_truncated(shown: DataFrame, nodes: DataFrame, edges: DataFrame, center: str = "*", depth: int = 3) -> DataFrame:
    """One row, is_truncated: whether nodes within `depth` edges of the center were left out of a subgraph."""
    near = subgraph(nodes, edges, center, depth, (1 << 31) - 1).agg(F.count(F.lit(1)).alias("near"))
    return near.crossJoin(F.broadcast(shown.agg(F.count(F.lit(1)).alias("shown")))).select((F.col("near") > F.col("shown")).alias("is_truncated"))  # one row each


def subgraph_edges(shown: DataFrame, edges: DataFrame, cut: int = 80) -> DataFrame:
    """source, target, label (the description, cut short), weight of edges between nodes of a subgraph; a null weight is 1."""
    ends = edges.join(shown.select(F.col("id").alias("source")), "source", "left_semi").join(shown.select(F.col("id").alias("target")), "target", "left_semi")
    return ends.select("source", "target", F.substring(F.coalesce("description", F.lit("")), 1, cut).alias("label"), F.coalesce("weight", F.lit(1.0)).alias("weight"))


def merge_mentions(mentions: DataFrame, threshold: float = 0.45) -> DataFrame:
    """name, type, score, position: of mentions of one name whatever its case, the best (the first on a tie; those without a position come last)."""
    rank = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy(F.desc("score"), F.asc_nulls_last("position"), "name", "type"))
    return mentions.filter(F.col("score") >= threshold).withColumn("r", rank).filter("r = 1").select("name", "type", "score", "position")


def merge_relations(relations: DataFrame) -> DataFrame:
    """Relations without empty or equal ends; of those between two names (either way round) of one type the first."""
    a, b = F.lower("source"), F.lower("target")
    good = relations.filter((F.trim("source") != "") & (F.trim("target") != "") & (a != b))
    rank = F.row_number().over(Window.partitionBy(F.least(a, b), F.greatest(a, b), F.lower("relation_type")).orderBy("position", "source", "target"))
    note = F.concat("source", F.lit(" "), F.replace("relation_type", F.lit("_"), F.lit(" ")), F.lit(" "), "target", F.lit("."))
    return good.withColumn("r", rank).filter("r = 1").select("source", "target", "relation_type", note.alias("description"))


def ensure_entities(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """name, type, description: the entities and, as Other, the ends of relations that are none, with a fixed description."""
    known = entities.select(F.lower("name").alias("low"))
    ends = relations.select(F.explode(F.array("source", "target")).alias("name")).withColumn("low", F.lower("name")).groupBy("low").agg(F.min("name").alias("name"))
    # Fixed value: the description of an entity that only relations name.
    new = ends.join(known, "low", "left_anti").select("name", F.lit("Other").alias("type"), F.lit("Entity inferred from relation extraction.").alias("description"))
    own = entities if "description" in entities.columns else entities.withColumn("description", F.lit("").cast("string"))
    return own.select("name", "type", "description").unionByName(new)


def kg_lines_encode(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Record lines, entities first, each sorted by name whatever its case."""
    sep = "<|#|>"
    e = entities.select(F.lit(0).alias("part"), F.lower("name").alias("key"), F.concat_ws(sep, F.lit("entity"), "name", "type", "description").alias("line"))
    r = relations.select(F.lit(1).alias("part"), F.lower(F.concat_ws(" ", "source", "target")).alias("key"), F.concat_ws(sep, F.lit("relation"), "source", "target", "keywords", "description").alias("line"))
    return e.unionByName(r).orderBy("part", "key").select("line")


def kg_lines_decode(lines: Column) -> Column:
    """array<struct<kind, a, b, c, d>> of record lines; lines of another form are left out."""
    parts = F.transform(F.split(F.replace(lines, F.lit("<|COMPLETE|>"), F.lit("")), "\n"), lambda x: F.split(F.trim(x), r"<\|#\|>"))
    good = F.filter(parts, lambda p: ((F.get(p, F.lit(0)) == "entity") & (F.size(p) == 4)) | ((F.get(p, F.lit(0)) == "relation") & (F.size(p) == 5)))
    field = lambda p, i: F.trim(F.get(p, F.lit(i)))
    return F.transform(good, lambda p: F.struct(F.get(p, F.lit(0)).alias("kind"), *[field(p, i + 1).alias(n) for i, n in enumerate("abcd")]))


def decode_graph_log(log: DataFrame, column: str = "output") -> tuple[DataFrame, DataFrame]:
    """Entities (name, type, description) and relations (source, target, keywords, description) of extraction output."""
    rows = log.select(F.explode(kg_lines_decode(F.col(column))).alias("x")).select("x.*")
    e = rows.filter("kind = 'entity'").select(F.col("a").alias("name"), T.sanitize_kg_field("b", "type").alias("type"), F.col("c").alias("description"))
    r = rows.filter("kind = 'relation'").select(F.col("a").alias("source"), F.col("b").alias("target"), T.sanitize_kg_field("c", "keywords").alias("keywords"), F.col("d").alias("description"))
    return e, r


# Marks of generated triplets that carry nothing.
TRIPLET_NOISE = ("<s>", "<pad>", "</s>", "tp_XX", "__en__")


def decode_triplets(c: Column) -> Column:
    """array<struct<head, head_type, tail, tail_type, relation>> of `<triplet> head <type> tail <type> relation` strings.

    A head may be followed by several `<type> tail <type> relation` groups, each a triplet of its own; <relation> begins a head like
    <triplet>. The last triplet counts if head, tail and relation are there, the others if they have a relation. Null gives null.
    """
    bare = c
    for mark in TRIPLET_NOISE:
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    tokens = F.filter(F.split(bare, r"(?U)\s+"), lambda t: t != "")
    names = ("head", "head_type", "tail", "tail_type", "relation")
    row = lambda s: F.struct(*[(s[n] if n.endswith("type") else F.trim(s[n])).alias(n) for n in names])
    # reads: what a plain word belongs to ("" before the first head)
    start = F.struct(F.lit("").alias("reads"), *[F.lit("").alias(n) for n in names], F.array().cast("array<struct<head:string,head_type:string,tail:string,tail_type:string,relation:string>>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        heads = t.isin("<triplet>", "<relation>")
        kind = ~heads & F.startswith(t, F.lit("<")) & F.endswith(t, F.lit(">"))
        first = kind & s["reads"].isin("head", "relation")  # the type of the head, after which a tail begins
        second = kind & ~first  # the type of the tail, after which a relation begins
        word = lambda n: F.when(~heads & ~kind & (s["reads"] == n), F.concat(s[n], F.lit(" "), t))
        name = F.substr(t, F.lit(2), F.length(t) - 2)
        return F.struct(
            F.when(heads, "head").when(first, "tail").when(second, "relation").otherwise(s["reads"]).alias("reads"),
            F.when(heads, "").otherwise(F.coalesce(word("head"), s["head"])).alias("head"), F.when(first, name).otherwise(s["head_type"]).alias("head_type"),
            F.when(first, "").otherwise(F.coalesce(word("tail"), s["tail"])).alias("tail"), F.when(second, name).otherwise(s["tail_type"]).alias("tail_type"),
            F.when(heads | second, "").otherwise(F.coalesce(word("relation"), s["relation"])).alias("relation"),
            F.when((heads | first) & (s["relation"] != ""), F.array_append(s["out"], row(s))).otherwise(s["out"]).alias("out"),
        )

    whole = lambda s: (F.trim(s["head"]) != "") & (F.trim(s["tail"]) != "") & (F.trim(s["relation"]) != "")
    return F.aggregate(tokens, start, step, lambda s: F.when(whole(s), F.array_append(s["out"], row(s))).otherwise(s["out"]))


def capitalised_runs(chunks: DataFrame) -> DataFrame:
    """document_id, names: the offline extractor. Runs of capitalised words, the first of four letters at least; null content gives null."""
    return chunks.select("document_id", F.regexp_extract_all("content", F.lit(r"\b(\p{Lu}\p{Ll}{3,}(?: \p{Lu}\p{Ll}+)*)"), 1).alias("names"))


def build_graph(chunks: DataFrame, extractor: Callable[[DataFrame], DataFrame] = capitalised_runs) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, documents) and edges (source, target, weight) of a corpus.

    The extractor gives the names of each chunk in order (document_id, names), natively or by mapInPandas. Each name is related to the
    next one of its chunk, so a chunk gives no more edges than it has mentions. Weights add up over documents.
    """
    names = extractor(chunks)
    nodes = names.select("document_id", F.explode("names").alias("id")).groupBy("id").agg(F.count_distinct("document_id").alias("documents"))
    link = F.zip_with("names", F.slice("names", 2, F.size("names")), lambda a, b: F.struct(F.least(a, b).alias("source"), F.greatest(a, b).alias("target"), b.isNotNull().alias("whole")))
    pairs = names.filter(F.size("names") > 1).select(F.explode(link).alias("p")).filter("p.whole")
    return nodes, pairs.select("p.source", "p.target").filter("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


# --- the graph of a corpus ---------------------------------------------------------------------------------------------------------

#: What an extractor gives: for each chunk its text, the entities it names (start and end as 0-based characters), and relations in order.
EXTRACTED = (
    "document_id long, chunk_index int, content string, mentions array<struct<name: string, type: string, score: double, start: int, end: int>>, "
    "relations array<struct<source: string, target: string, relation_type: string>>"
)
#: Between descriptions of one entity or relation, and how many of them a row shows.
DESCRIPTION_MARK, SHOWN = "<SEP>", 8


def named_runs(chunks: DataFrame) -> DataFrame:
    """EXTRACTED rows of chunks (document_id, chunk_index, content), offline: runs of capitalised words, the first of four letters at least, are concepts, and each is related to the next one. Null content names nothing."""
    run_of = r"\b(\p{Lu}\p{Ll}{3,}(?: \p{Lu}\p{Ll}+)*)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = regex.compile(run_of)
        for batch in batches:
            mentions, relations = [], []
            for t in batch.column("content"):
                found = [(m[1], m.start(1), m.end(1)) for m in name.finditer(t.as_py() or "")]
                mentions.append([{"name": n, "type": "Concept", "score": 1.0, "start": a, "end": b} for n, a, b in found])
                relations.append([{"source": a[0], "target": b[0], "relation_type": "related_to"} for a, b in zip(found, found[1:], strict=False)])
            m = pa.array(mentions, pa.list_(pa.struct([("name", pa.string()), ("type", pa.string()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])))
            r = pa.array(relations, pa.list_(pa.struct([("source", pa.string()), ("target", pa.string()), ("relation_type", pa.string())])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("document_id", "chunk_index", "content")), m, r], ["document_id", "chunk_index", "content", "mentions", "relations"])

    return chunks.select(F.col("document_id").cast("long"), F.col("chunk_index").cast("int"), "content").mapInArrow(run, EXTRACTED)


def chunk_graph(extracted: DataFrame, threshold: float = 0.45) -> tuple[DataFrame, DataFrame]:
    """The entities and relations of each chunk (EXTRACTED rows), merged within it.

    Entities (document_id, chunk_index, low, at, name, type, description, score): of mentions of one name whatever its case the best of
    `threshold` at least, the first on a tie; ends of relations that no mention names follow as Other, with a fixed description and
    score 0. Relations (document_id, chunk_index, a, b, at, source, target, relation_type, description): without empty or equal ends,
    of those between two names (either way round) of one type the first.
    """
    chunk, text = ["document_id", "chunk_index"], F.col("content")
    each = extracted.select(*chunk, text, F.posexplode("mentions").alias("at", "m"))
    name, kind = T.sanitize_kg_field("m.name"), T.sanitize_kg_field("m.type", "type")
    said = T.mention_context(text, F.col("m.start"), F.col("m.end"), kind)
    score = F.coalesce("m.score", F.lit(0.0))
    each = each.select(*chunk, "at", name.alias("name"), kind.alias("type"), said.alias("description"), score.alias("score")).filter((F.col("name") != "") & (F.col("score") >= threshold))
    best = F.min(F.struct((-F.col("score")).alias("s"), "at", "name", "type", "description"))
    entities = each.groupBy(*chunk, F.lower("name").alias("low")).agg(best.alias("x")).select(*chunk, "low", "x.at", "x.name", "x.type", "x.description", (-F.col("x.s")).alias("score"))

    ties = extracted.select(*chunk, F.posexplode("relations").alias("at", "r"))
    ties = ties.select(*chunk, "at", T.sanitize_kg_field("r.source").alias("source"), T.sanitize_kg_field("r.target").alias("target"), T.sanitize_kg_field("r.relation_type", "relation").alias("relation_type"))
    a, b = F.lower("source"), F.lower("target")
    ties = ties.filter((F.col("source") != "") & (F.col("target") != "") & (a != b))
    first = F.min(F.struct("at", "source", "target", "relation_type"))
    ties = ties.groupBy(*chunk, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.lower("relation_type").alias("_kind")).agg(first.alias("x"))
    note = F.concat("x.source", F.lit(" "), F.replace("x.relation_type", F.lit("_"), F.lit(" ")), F.lit(" "), "x.target", F.lit("."))
    relations = ties.select(*chunk, "a", "b", "x.*", note.alias("description"))

    ends = relations.select(*chunk, F.posexplode(F.array("source", "target")).alias("side", "name"), "at").withColumn("low", F.lower("name"))
    new = ends.join(entities.select(*chunk, "low"), [*chunk, "low"], "left_anti").groupBy(*chunk, "low").agg(F.min(F.struct("at", "side", "name")).alias("x"))
    # Fixed value: the description of an entity that only relations name. They stand after all mentions of their chunk.
    other = new.select(*chunk, "low", (F.lit(1 << 30) + 2 * F.col("x.at") + F.col("x.side")).cast("int").alias("at"), F.col("x.name").alias("name"), F.lit("Other").alias("type"), F.lit("Entity inferred from relation extraction.").alias("description"), F.lit(0.0).alias("score"))
    return entities.unionByName(other), relations


def _first_descriptions(rows: DataFrame, key: list[str], shown: int) -> tuple[DataFrame, DataFrame]:
    """All different descriptions of a key, each where it first stands, and a row a key with the first `shown` of them joined."""
    where = ["document_id", "chunk_index", "at"]
    every = rows.groupBy(*key, "description").agg(F.min(F.struct(*where)).alias("x")).select(*key, "description", "x.*")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*where, "description"))
    few = every.withColumn("place", place).filter(F.col("place") <= shown)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("place", "description"))), lambda x: x["description"])
    return every, few.groupBy(*key).agg(F.array_join(lines, DESCRIPTION_MARK).alias("description"))


def corpus_graph(chunks: DataFrame, extractor: Callable[[DataFrame], DataFrame] = named_runs, threshold: float = 0.45, shown: int = SHOWN) -> dict[str, DataFrame]:
    """The graph of all chunks (document_id, chunk_index, content): tables nodes, edges, node_descriptions, edge_descriptions.

    The extractor gives EXTRACTED rows, natively or by mapInArrow or mapInPandas. Chunks are merged as chunk_graph says, then over the
    corpus, in order of document and chunk: nodes (low, id, entity_type, description, documents, mentions) have the name and type of the
    best mention (the first on a tie), edges (a, b, source, target, keywords, description, weight) the ends of the first relation of an
    unordered pair, its different types, and a weight of one a chunk and type. The descriptions tables hold every different
    description and where it first stands; a row of nodes or edges shows the first `shown` of them, so that a name in a third of all
    documents is a row like others. Everything is combined before it is shuffled. Chunks without names give nothing; repeated chunks
    count as often as they are given where their numbers differ, once where they do not.
    """
    entities, relations = (write_table(x, "graph-chunks") for x in chunk_graph(write_table(extractor(chunks), "extracted"), threshold))
    where = ["document_id", "chunk_index", "at"]
    best = F.min(F.struct((-F.col("score")).alias("s"), *where, "name", "type"))
    by_document = entities.groupBy("low", "document_id").agg(best.alias("x"), F.count(F.lit(1)).alias("n"))
    nodes = by_document.groupBy("low").agg(F.min("x").alias("x"), F.count(F.lit(1)).alias("documents"), F.sum("n").alias("mentions"))
    node_notes, told = _first_descriptions(entities, ["low"], shown)
    nodes = nodes.join(told, "low").select("low", F.col("x.name").alias("id"), F.col("x.type").alias("entity_type"), "description", "documents", "mentions")
    first = F.min(F.struct(*where, "source", "target"))
    edges = relations.groupBy("a", "b", "relation_type").agg(first.alias("x"), F.count(F.lit(1)).alias("n")).groupBy("a", "b").agg(F.min("x").alias("x"), F.sum("n").cast("double").alias("weight"), F.array_join(F.sort_array(F.collect_set("relation_type")), ",").alias("keywords"))
    edge_notes, told = _first_descriptions(relations, ["a", "b"], shown)
    edges = edges.join(told, ["a", "b"]).select("a", "b", "x.source", "x.target", "keywords", "description", "weight")
    return {"nodes": nodes, "edges": edges, "node_descriptions": node_notes, "edge_descriptions": edge_notes}
