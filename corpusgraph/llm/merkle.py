"""Merkle dataset manifest: a hash tree over all documents, and for every leaf its proof, found by pointer jumping."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import write_table

#: Nodes of a run, which become one node of the level above.
FAN_OUT = 16
#: Columns of a document that its leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the subroots of all sources, and what names of a source's own tree begin with; in this order they sort as the
#: sources do, null first.
TOP, NULL_SOURCE, SOURCE = "", "n", "s"

NODE = ("tree", "level", "idx")


def encoded(value: str | Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value as text."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**changed: Column) -> Column:
    """Lowercase hex SHA-256 of a document's encoded fields; changed gives other values of some."""
    return F.sha2(F.concat(*[encoded(changed.get(f, f)) for f in FIELDS]), 256)


def lowered(text: str = "text") -> Column:
    """The tampering: A-Z of the text in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf, tampered (the leaf after tampering; null for documents left alone), a row for each document.

    Tampered are the documents where 5 divides the unsigned crc32 of doc_id in decimal, so none without a doc_id.
    """
    docs = docs.select(*FIELDS)
    tree = F.when(F.col("source").isNull(), F.lit(NULL_SOURCE)).otherwise(F.concat(F.lit(SOURCE), F.col("source").cast("string")))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select(tree.alias("tree"), "doc_id", leaf_digest().alias("leaf"), F.when(hit, leaf_digest(text=lowered())).alias("tampered"))


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with idx, the place of a row (from 0) within its group in the given order, and n, the rows of its group.

    Rows are dealt by ranges of (group, order), so a group may lie in any number of tasks; a task's rows are numbered as they stand
    there, and the rows of a group in the tasks before are added. Rows equal in group and order are dealt by their place in df, which
    is why df should be a table.
    """
    by = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("_at")]
    dealt = df.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_at")
    rows = write_table(dealt.withColumn("_row", F.monotonically_increasing_id()), name)
    rows = rows.withColumns({"_part": F.shiftright("_row", 33), "_row": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))})
    # a row for each group that a task holds: as many as groups and tasks together at most
    parts = rows.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = write_table(parts.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(own).alias("n")), name)
    met = rows.join(shift, (F.col(group) == F.col("_group")) & (F.col("_part") == F.col("_p")))
    return met.select(*df.columns, (F.col("_row") + F.col("_shift")).alias("idx"), "n")


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _runs(nodes: DataFrame) -> DataFrame:
    """The runs of nodes (tree, n, idx, digest, ...): tree, n, up (the run's number), members in order (structs of at and the other columns)."""
    rest = [c for c in nodes.columns if c not in ("tree", "n", "idx")]
    member = F.struct((F.col("idx") % FAN_OUT).cast("int").alias("at"), *rest)
    return nodes.groupBy("tree", "n", F.floor(F.col("idx") / FAN_OUT).cast("long").alias("up")).agg(F.sort_array(F.collect_list(member)).alias("members"))


def _up(runs: DataFrame) -> DataFrame:
    """The nodes above runs."""
    return runs.select("tree", F.ceil(F.col("n") / FAN_OUT).cast("long").alias("n"), F.col("up").alias("idx"), F.sha2(_joined(F.transform("members", lambda m: m["digest"])), 256).alias("digest"))


def _sides(members: Column, at: Column) -> Column:
    """The digests left and right of a member of a run."""
    digest = F.transform(members, lambda m: m["digest"])
    return F.struct(_joined(F.slice(digest, F.lit(1), at)).alias("left"), _joined(F.slice(digest, at + 2, F.lit(FAN_OUT))).alias("right"))


#: Siblings of a node: the digests left and right of it.
STEPS = "array<struct<left: string, right: string>>"


def tree_levels(nodes: DataFrame, first: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Hashes nodes (tree, n, idx, digest; n nodes of a tree at level `first`) upwards until every tree has one node.

    Returns pointers, one DataFrame a level (tree, level, idx, digest, p_tree, p_level, p_idx, step: each node with its parent and its
    siblings), and the trees' roots (tree, level, digest). A level has a sixteenth of the nodes of the one below.
    """
    pointers, roots, level = [], [], first
    while True:
        roots.append(nodes.filter("n = 1").select("tree", F.lit(level).alias("level"), "digest"))
        going = write_table(_runs(nodes.filter("n > 1")), name)
        if not going.head(1):
            break
        members = going.select("tree", "up", "members", F.explode("members").alias("m"))
        pointers.append(
            members.select(
                "tree", F.lit(level).alias("level"), (F.col("up") * FAN_OUT + F.col("m.at")).alias("idx"), F.col("m.digest").alias("digest"),
                F.col("tree").alias("p_tree"), F.lit(level + 1).alias("p_level"), F.col("up").alias("p_idx"), _sides(F.col("members"), F.col("m.at")).alias("step"),
            )
        )
        nodes, level = _up(going), level + 1
    return pointers, functools.reduce(DataFrame.unionByName, roots)


def jump(pointers: DataFrame, name: str = "merkle-paths") -> DataFrame:
    """Paths of all nodes to the root: tree, level, idx, steps (siblings level by level), subroot, root.

    pointers: tree, level, idx, p_tree, p_level, p_idx (an ancestor; null at the root), steps (siblings up to below the ancestor),
    subroot (if the node is one or the way passes one), root (at the root alone). Each round joins a node to its ancestor's row, so
    that the distance doubles, and appends the ancestor's steps to its own. Nodes that have come to the root are put aside, so the
    root is never a key that all rows share, and an ancestor at a distance of d lies above level d or in the top tree, so the rows
    that are met are a sixteenth of all for each level of the distance.
    """
    rows, distance = write_table(pointers, name), 1
    while rows.filter("root is null").head(1):
        high = rows.filter((F.col("level") > distance) | (F.col("tree") == TOP))
        far = high.select([F.col(c).alias(f"a_{c}") for c in (*NODE, "p_tree", "p_level", "p_idx", "steps", "subroot", "root")])
        met = rows.filter("root is null").join(far, [F.col(f"p_{c}") == F.col(f"a_{c}") for c in NODE])
        further = met.select(
            *NODE, *[F.col(f"a_p_{c}").alias(f"p_{c}") for c in NODE], F.concat("steps", "a_steps").alias("steps"),
            F.coalesce("subroot", "a_subroot").alias("subroot"), F.col("a_root").alias("root"),
        )
        rows, distance = write_table(rows.filter("root is not null").unionByName(further), name), 2 * distance
    return rows.select(*NODE, "steps", "subroot", "root")


def manifest(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, leaf, subroot, root, proof (steps of siblings left and right, level by level), proof_sha256, folded_root, verified.

    Leaves of a source (null is a source) ascend by doc_id (null first, equal ids by digest); FAN_OUT consecutive nodes become their
    hash until one is left, the source's subroot, and the subroots by source likewise give the root. folded_root is what the leaf, or
    the tampered one, gives with its siblings, and verified says whether it is the root. A null field is encoded as such; rows that are
    equal in all fields are leaves side by side and each get a row with the proof of its place; an empty table gives no rows.

    Leaves stand in runs of FAN_OUT, one row a run, so that no leaf is sent with all its siblings: pointers are jumped from the node
    above a run, a sixteenth of the leaves, and each run is joined once to that node's whole path.
    """
    at_leaf = ranked(write_table(leaves(docs), "merkle-leaves"), "tree", ["doc_id", "leaf"], "merkle-ranked")
    base = write_table(_runs(at_leaf.withColumnRenamed("leaf", "digest")), "merkle-runs")

    # a tree of one leaf has no level above it: the leaf is the subroot
    inner, roots = tree_levels(_up(base.filter("n > 1")), 1, "merkle-level")
    alone = base.filter("n = 1").select("tree", F.lit(0).alias("level"), F.col("members")[0]["digest"].alias("digest"))
    subroots = write_table(roots.unionByName(alone), "merkle-subroots").withColumn("all", F.lit(TOP))
    top = write_table(ranked(subroots, "all", ["tree"], "merkle-top"), "merkle-top")
    outer, root = tree_levels(top.select(F.lit(TOP).alias("tree"), "n", "idx", "digest"), 0, "merkle-level")

    # a source's subroot is a leaf of the top tree: it goes by its own name, and points to where that leaf does
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    own = top.select(F.col("tree").alias("own"), F.col("level").alias("own_level"), F.col("idx").alias("own_idx"))
    parts = [p.select(*NODE, "p_tree", "p_level", "p_idx", F.array("step").alias("steps"), none.alias("subroot"), none.alias("root")) for p in inner]
    for level, p in enumerate(outer):
        to = ("p_tree", "p_level", "p_idx", F.array("step").alias("steps"))
        if level == 0:
            parts.append(p.join(own, F.col("idx") == F.col("own_idx")).select(F.col("own").alias("tree"), F.col("own_level").alias("level"), zero.alias("idx"), *to, F.col("digest").alias("subroot"), none.alias("root")))
        else:
            parts.append(p.select(*NODE, *to, none.alias("subroot"), none.alias("root")))
    # the root itself; of one source, its subroot
    end, subroot = (root, none) if outer else (top, F.col("digest"))
    parts.append(end.select("tree", "level", zero.alias("idx"), none.alias("p_tree"), F.lit(None).cast("int").alias("p_level"), F.lit(None).cast("long").alias("p_idx"), F.array().cast(STEPS).alias("steps"), subroot.alias("subroot"), F.col("digest").alias("root")))
    paths = jump(functools.reduce(DataFrame.unionByName, parts))

    # each run of leaves meets the path of the node above it, or, of a lone leaf, of the leaf itself
    lone = F.col("n") == 1
    runs = base.withColumns({"at_level": F.when(lone, 0).otherwise(1), "at_idx": F.when(lone, zero).otherwise(F.col("up"))})
    to = paths.select(F.col("tree").alias("t"), F.col("level").alias("l"), F.col("idx").alias("i"), "steps", "subroot", "root")
    met = runs.join(to, (F.col("tree") == F.col("t")) & (F.col("at_level") == F.col("l")) & (F.col("at_idx") == F.col("i")))
    each = met.select("n", "steps", "subroot", "root", "members", F.explode("members").alias("m"))
    proof = F.when(lone, F.col("steps")).otherwise(F.concat(F.array(_sides(F.col("members"), F.col("m.at"))), F.col("steps")))
    each = each.select(F.col("m.doc_id").alias("doc_id"), F.col("m.digest").alias("leaf"), "subroot", "root", proof.alias("proof"), F.coalesce("m.tampered", "m.digest").alias("start"))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("proof", F.col("start"), lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))
    each = each.withColumns({"proof_sha256": F.sha2(siblings, 256), "folded_root": folded})
    return each.select("doc_id", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def documents_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("proof")


def _fold_sql(table: str, levels: int, out: str) -> str:
    """SQL that hashes table (tree, idx, d) upwards, level by level: out_0 (the table) to out_{levels}, with each node's siblings."""
    parts = [f"{out}_0 AS MATERIALIZED (SELECT tree, idx, d, count(*) OVER (PARTITION BY tree) AS n FROM {table})"]
    for k in range(levels):
        run = f"PARTITION BY tree, idx // {FAN_OUT} ORDER BY idx ROWS BETWEEN"
        parts.append(
            f"{out}_s{k} AS MATERIALIZED (SELECT tree, idx, CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS l,"
            f" CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS r FROM {out}_{k}),"
            f"{out}_{k + 1} AS MATERIALIZED (SELECT tree, idx, d, count(*) OVER (PARTITION BY tree) AS n FROM (SELECT tree, idx // {FAN_OUT} AS idx, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY idx)) END AS d FROM {out}_{k} GROUP BY tree, idx // {FAN_OUT}))"
        )
    return ",\n".join(parts)


def _oracle(levels: int = 6, top_levels: int = 4) -> str:
    """DuckDB SQL of op13 for up to 16**levels documents a source and 16**top_levels sources."""
    code = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join([code("doc_id"), code("source"), code("lang"), code("n_chars"), code(text)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # DuckDB has no crc32: it is taken bit by bit over the digits, from a table of 256 remainders
    crc = """bits AS (SELECT CAST(i AS UBIGINT) AS i FROM range(256) AS r(i)),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || [CAST(x AS UBIGINT) FOR x IN range(8)], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS UBIGINT)) ELSE c // 2 END) AS v FROM bits)),
crcs AS (SELECT doc_id, xor(list_reduce([CAST(4294967295 AS UBIGINT)] || [CAST(ord(x) AS UBIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')], lambda c, x: xor(t[CAST(xor(c, x) % 256 AS INT) + 1], c // 256)), CAST(4294967295 AS UBIGINT)) AS crc FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table)"""
    steps = [("s", k) for k in range(levels)] + [("t", k) for k in range(top_levels)]
    proof = [f"coalesce({prefix}{k}.l || {prefix}{k}.r, '')" for prefix, k in steps]
    joins = "\n".join(f"JOIN s_s{k} AS s{k} ON s{k}.tree = a.tree AND s{k}.idx = a.idx // {FAN_OUT**k}" for k in range(levels))
    joins += "\nJOIN subroots AS b ON b.own = a.tree\n" + "\n".join(f"JOIN t_s{k} AS t{k} ON t{k}.idx = b.idx // {FAN_OUT**k}" for k in range(top_levels))
    return f"""WITH {crc},
a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS idx FROM (
  SELECT coalesce('s' || source, 'n') AS tree, doc_id, {leaf("text")} AS d, CASE WHEN crc % 5 = 0 THEN {leaf(lower)} END AS tampered FROM documents LEFT JOIN crcs USING (doc_id))),
{_fold_sql("a", levels, "s")},
subroots AS MATERIALIZED (SELECT tree AS own, d AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx FROM s_{levels}),
top AS (SELECT '' AS tree, idx, subroot AS d FROM subroots),
{_fold_sql("top", top_levels, "t")},
p AS (SELECT a.doc_id, a.d AS leaf, b.subroot, (SELECT d FROM t_{top_levels}) AS root, sha256({" || ".join(proof)}) AS proof_sha256, coalesce(a.tampered, a.d) AS start,
  {", ".join(f"s{k}.l AS sl{k}, s{k}.r AS sr{k}" for k in range(levels))}, {", ".join(f"t{k}.l AS tl{k}, t{k}.r AS tr{k}" for k in range(top_levels))}
FROM a {joins}),
""" + _steps_sql(levels, top_levels)


def _steps_sql(levels: int, top_levels: int) -> str:
    """The fold, a step a table, so that no expression repeats another."""
    names, parts, last = [("s", k) for k in range(levels)] + [("t", k) for k in range(top_levels)], [], "p"
    for i, (prefix, k) in enumerate(names):
        parts.append(f"f{i} AS (SELECT * REPLACE (CASE WHEN {prefix}l{k} IS NULL THEN start ELSE sha256({prefix}l{k} || start || {prefix}r{k}) END AS start) FROM {last})")
        last = f"f{i}"
    return ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, start AS folded_root, start = root AS verified FROM {last}"


ORACLE = _oracle()
