"""Words of several syllables: a lexicon of compounds from a corpus, and tokens with compounds joined."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.sources.shared import write_table

from . import text as T

#: Compounds that a segmenter may hold, as all tasks get them; join_compounds has no bound.
MOST_COMPOUNDS = 1_000_000
#: Bits of the table by which join_compounds leaves pairs out.
MOST_BITS = 1 << 28


class Compounds:
    """A trie of compounds, each two words at least."""

    def __init__(self, compounds: Iterable[str]):
        self.root: dict = {}
        for compound in compounds:
            words = compound.lower().split()
            if len(words) > 1:
                node = self.root
                for w in words:
                    node = node.setdefault(w, {})
                node[""] = True  # a compound ends here; no word is empty

    def lengths(self, words: list[str], at: int) -> Iterator[int]:
        """How many words the compounds that begin at a place have."""
        node, i = self.root, at
        while i < len(words) and (node := node.get(words[i])) is not None:
            i += 1
            if "" in node:
                yield i - at

    def join(self, words: list[str], joiner: str = "_") -> list[str]:
        """The words with compounds joined, by the path of the fewest tokens; of several such paths the one whose first tokens are longest."""
        n = len(words)
        cost, take = [0] * (n + 1), [1] * n
        for at in range(n - 1, -1, -1):
            cost[at] = 1 + cost[at + 1]
            for k in self.lengths(words, at):
                if 1 + cost[at + k] <= cost[at]:
                    cost[at], take[at] = 1 + cost[at + k], k
        out, at = [], 0
        while at < n:
            out.append(joiner.join(words[at : at + take[at]]))
            at += take[at]
        return out


def segmenter(spark: SparkSession, compounds: Iterable[str], joiner: str = "_", tokens: Callable[[Column], Column] = T.word_tokens) -> Callable[[Column], Column]:
    """A tokenizer for lexical search whose tokens are those of `tokens` with compounds joined.

    Null texts have null tokens. More than MOST_COMPOUNDS are an error, since every task holds them.
    """
    known = sorted(set(compounds))
    if len(known) > MOST_COMPOUNDS:
        raise ValueError(f"{len(known)} compounds, {MOST_COMPOUNDS} at most")
    sent = spark.sparkContext.broadcast(known)

    @F.pandas_udf("array<string>")
    def joined(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = Compounds(sent.value)
        for s in parts:
            yield pd.Series([None if w is None else trie.join(list(w), joiner) for w in s], dtype=object)

    return lambda c: joined(tokens(c))


def learn_compounds(chunks: DataFrame, least: int = 5, bound: float = 3.0, tokens: Callable[[Column], Column] = T.word_tokens) -> DataFrame:
    """compound, n, pmi: pairs of neighbouring words that stand together `least` times at least and whose pointwise mutual information is `bound` at least.

    The information is the logarithm of how much more often the pair stands than if its words came by chance (the share of the pair
    among all pairs, over the shares of its words among all words). Every text counts whole; null texts and those of one word give no
    pairs. Counts are combined before they are shuffled, so a frequent word is a row a task.
    """
    words = chunks.select(F.coalesce(tokens(F.col("content")), F.array().cast("array<string>")).alias("w"))
    single = words.select(F.explode("w").alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    pairs = words.filter(F.size("w") > 1).select(F.explode(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    met = pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
    sizes = words.agg(F.sum(F.size("w")).alias("words"), F.sum(F.greatest(F.size("w") - 1, F.lit(0))).alias("pairs"))
    left, right = single.select("a", F.col("n").alias("na")), single.select(F.col("a").alias("b"), F.col("n").alias("nb"))
    each = met.filter(F.col("n") >= least).join(left, "a").join(right, "b").crossJoin(F.broadcast(sizes))  # one row
    pmi = F.log(F.col("n") / F.col("pairs")) - F.log(F.col("na") / F.col("words")) - F.log(F.col("nb") / F.col("words"))
    return each.withColumn("pmi", pmi).filter(F.col("pmi") >= bound).select(F.concat_ws(" ", "a", "b").alias("compound"), "n", "pmi")


def _bits(hashes: DataFrame) -> np.ndarray:
    """A bit table, 16 bits a hash, MOST_BITS at most, in which the bits of the hashes (h) are set: those it does not hold are not among them."""
    size = min(MOST_BITS, 1 << max(16, (16 * hashes.count()).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(size - 1))

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = []
            for i in range(batch.num_rows):
                bits = np.zeros(1 << 15, np.uint8)
                bits[batch.column("p")[i].values.to_numpy()] = 1
                blocks.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(blocks, pa.binary())], ["k", "bits"])

    blocks = hashes.select(F.shiftright(at, 15).cast("int").alias("k"), at.bitwiseAND(F.lit((1 << 15) - 1)).cast("int").alias("p")).groupBy("k").agg(F.collect_set("p").alias("p"))
    table = np.zeros((size >> 15, 1 << 12), np.uint8)
    for r in blocks.mapInArrow(filled, "k int, bits binary").toLocalIterator():  # all together the table's size
        table[r["k"]] = np.frombuffer(r["bits"], np.uint8)
    return table.ravel()


def join_compounds(texts: DataFrame, column: str, compounds: DataFrame, joiner: str = "_", tokens: Callable[[Column], Column] = T.word_tokens) -> DataFrame:
    """texts with the tokens of a column, compounds (compound: two words each) joined, as its new value, parted by single spaces; null stays null.

    Any number of compounds is joined: each text gets those among its own neighbouring words by joins, and no task or driver holds them
    all. A bit table of the compounds keeps most of the other pairs out of the shuffle; from some twenty million compounds on it fills up.
    """
    spark = texts.sparkSession
    words = F.split("compound", " ")
    known = write_table(compounds.select("compound", F.xxhash64(words[0], words[1]).alias("h")).distinct(), "compounds")
    sent = spark.sparkContext.broadcast(_bits(known.select("h")))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            h, key = batch.column("h").flatten().to_numpy(), np.repeat(batch.column("key").to_numpy(), np.diff(batch.column("h").offsets.to_numpy()))
            at = h & (8 * len(table) - 1)
            on = (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
            yield pa.RecordBatch.from_arrays([pa.array(key[on]), pa.array(h[on])], ["key", "h"])

    # equal texts have one key; texts that share one by chance share their compounds, all of them true ones
    keyed = texts.withColumn("_key", F.xxhash64(column))
    w = tokens(F.col(column))
    pairs = keyed.select(F.col("_key").alias("key"), w.alias("w")).filter(F.size("w") > 1)
    hashes = F.array_distinct(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.xxhash64(a, b)))
    met = pairs.select("key", hashes.alias("h")).mapInArrow(possible, "key long, h long").join(known, "h")
    own = met.groupBy(F.col("key").alias("_key")).agg(F.collect_set("compound").alias("_own"))

    @F.pandas_udf("string")
    def joined(w: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else " ".join(x if o is None else Compounds(o).join(list(x), joiner)) for x, o in zip(w, own, strict=True)], dtype=object)

    return keyed.join(own, "_key", "left").withColumn(column, joined(tokens(F.col(column)), F.col("_own"))).select(texts.columns)
