"""Mixing sources to target weights: subset-sum budget fitting over exact document lengths."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, numbered, with_row_names, write_table

#: Words in a document: runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one rank window of the selection holds, about.
BUCKET_ROWS = 4000


def fit_budget(lengths: list[int], counts: list[int], budget: int, seed: int = 42, exact_words: int = 1 << 14) -> list[int]:
    """How many documents of each length to take so that their words come as near below the budget as can be.

    First an even share of every length is taken; then single documents, in a seeded order of lengths, until the rest is at most
    exact_words; for this rest a bounded-knapsack table of reachable sums decides exactly (the largest reachable sum wins).
    """
    total = sum(n * k for n, k in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    take = [k * budget // total for k in counts]
    rest = budget - sum(n * k for n, k in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: zlib.crc32(f"{seed}:{lengths[i]}".encode()))
    for i in order:
        if rest <= exact_words:
            break
        more = min(counts[i] - take[i], rest // lengths[i], -(-(rest - exact_words) // lengths[i]))
        take[i] += more
        rest -= more * lengths[i]
    if not 0 < rest <= exact_words:
        return take
    sums, mask, steps = 1, (1 << (rest + 1)) - 1, []
    for i in order:
        left, size = min(counts[i] - take[i], rest // lengths[i]), 1
        while left and not sums >> rest & 1:
            k = min(size, left)
            steps.append((sums, i, k))
            sums |= sums << (k * lengths[i]) & mask
            left, size = left - k, size * 2
    best = sums.bit_length() - 1
    for before, i, k in reversed(steps):
        if not before >> best & 1:
            take[i] += k
            best -= k * lengths[i]
    return take


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row for each source: source, source_size, weight, target. Sources stand in order of code points (null last) and get the weights in turn.

    The budget, share times all words, is dealt by weight; a target stops at most times its source's size and the excess is dealt
    again. In order of cap / weight a source is capped if the even level of all not yet capped still reaches it.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    budget = share * F.sum("source_size").over(everything)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("capped", F.col("cap") * after <= (budget - before) * F.col("weight"))
    uncapped = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    capped = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    ranked = ranked.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise((budget - capped) * F.col("weight") / uncapped))
    return ranked.select("source", "source_size", "weight", "target")


def mix_to_targets(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 42, keep: tuple = ()) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, copies, taken (and the columns in keep).

    Each source is taken floor(target / source_size) times whole; what is left of its budget is filled by fit_budget over its
    documents' exact lengths, and of each length the documents with the smallest seeded hashes are taken.

    Null or empty texts have size 0 and are never needed (copies 0 beyond the whole ones); a null source is a source of its own;
    repeated rows are documents of their own, and which of several equal rows is taken does not show; an empty table gives no rows.
    """
    sizes = write_table(
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("h"), *keep),
        "mix-sizes",
    )
    targets = source_targets(sizes, weights, share, most)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int"))
    targets = write_table(targets.withColumn("rest", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("whole") * F.col("source_size"))), "mix-targets")

    lengths = sizes.filter("size > 0").groupBy("source", "size").count()
    t = targets.select(F.col("source").alias("t_source"), "rest")
    lengths = lengths.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source").filter("rest > 0")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        return pdf.assign(need=fit_budget(pdf["size"].tolist(), pdf["count"].tolist(), int(pdf["rest"].iloc[0]), seed))[["source", "size", "count", "need"]]

    # one group is a source's distinct lengths, not its documents
    needs = write_table(lengths.groupBy("source").applyInPandas(fit, "source string, size long, count long, need long"), "mix-needs")

    # Take the `need` smallest hashes of each (source, length). Long groups are cut by hash into buckets of about BUCKET_ROWS rows:
    # buckets wholly below the cut are taken, and only rows of the bucket it goes through are ranked.
    n = needs.select(F.col("source").alias("n_source"), F.col("size").alias("n_size"), "count", "need")
    met = (F.col("size") == F.col("n_size")) & F.col("source").eqNullSafe(F.col("n_source"))
    unit = (F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)))
    rows = sizes.join(n, met, "left").drop("n_source", "n_size").withColumn("bucket", F.floor(unit * F.ceil(F.col("count") / BUCKET_ROWS)))
    filled = rows.filter("need > 0").groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("filled"))
    upto = F.sum("filled").over(Window.partitionBy("source", "size").orderBy("bucket"))
    filled = filled.select(F.col("source").alias("n_source"), F.col("size").alias("n_size"), F.col("bucket").alias("n_bucket"), (upto - F.col("filled")).alias("before"))
    rows = rows.join(filled, met & (F.col("bucket") == F.col("n_bucket")), "left").drop("n_source", "n_size", "n_bucket")
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id", *keep))
    rows = rows.withColumn("edge", (F.col("need") > F.col("before")))
    rows = rows.withColumn("picked", F.coalesce(F.col("edge") & (rank <= F.col("need") - F.col("before")), F.lit(False)))
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target", "whole")
    out = rows.join(t, F.col("source").eqNullSafe(F.col("t_source"))).withColumn("copies", F.col("whole") + F.col("picked").cast("int"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)


def repeat_to_targets(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 42) -> DataFrame:
    """The documents (all their columns), each as often as mix_to_targets takes it. Copies of documents without words are 1 in a source that is taken whole, else 0."""
    marked = with_row_names(docs)
    copies = mix_to_targets(marked, weights, share, most, seed, ROW).groupBy(*ROW).agg(F.sum("copies").alias("_sum"), F.count(F.lit(1)).alias("_rows")).filter("_sum > 0")
    # equal rows share their copies evenly, the first ones taking what is left
    met = numbered(marked).join(copies, list(ROW)).withColumn("_n", F.floor(F.col("_sum") / F.col("_rows")) + (F.col("_i") <= F.col("_sum") % F.col("_rows")).cast("int"))
    return met.filter("_n > 0").withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int")))).select(docs.columns)
