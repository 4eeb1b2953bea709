"""Which of many names stand in which texts: one pass over the texts with an automaton of all names."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.sources.shared import write_table

#: Bytes of names that one automaton holds; more names are looked for in several passes.
AUTOMATON_BYTES = 16 << 20

_BUILT: dict[str, ahocorasick.Automaton] = {}


def _automaton(number: str, names: list[str]) -> ahocorasick.Automaton:
    """The automaton of a list, built once by each Python worker, which keeps the latest only."""
    if number not in _BUILT:
        _BUILT.clear()
        found = ahocorasick.Automaton()
        for i, name in enumerate(names):
            found.add_word(name, i)
        found.make_automaton()
        _BUILT[number] = found
    return _BUILT[number]


def names_in_text(texts: DataFrame, key: str, text: str, names: DataFrame, name: str = "name") -> DataFrame:
    """key, name: the names that stand anywhere in each text, each once a row of texts.

    Both are compared as they are (lower-case them first). Names are broadcast in automata of AUTOMATON_BYTES; a text of any length is
    read once for each of them, whatever the number of names. Null or empty names are found nowhere, null texts hold none, keys may
    be null or repeat; without names or texts there are no rows.
    """
    known = write_table(names.select(F.col(name).cast("string").alias("name")).filter("name <> ''").distinct(), "names")
    size = known.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    shards = max(1, -(-size // AUTOMATON_BYTES))
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = []
    for shard in range(shards):
        mine = sorted(r[0] for r in known.filter(F.pmod(F.xxhash64("name"), F.lit(shards)) == shard).collect())  # AUTOMATON_BYTES about
        if not mine:
            continue
        sent, number = texts.sparkSession.sparkContext.broadcast(mine), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            names = sent.value
            found = _automaton(number, names)
            for batch in batches:
                at, hits = [], []
                for i, t in enumerate(batch.column("text")):
                    met = {n for _, n in found.iter(t.as_py())}
                    at += [i] * len(met)
                    hits += met
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), pa.array([names[n] for n in hits], pa.string())], ["key", "name"])

        out.append(rows.mapInArrow(run, f"key {kind}, name string"))
    found = functools.reduce(DataFrame.unionByName, out) if out else rows.select("key", F.col("text").alias("name")).limit(0)
    return found.select(F.col("key").alias(key), F.col("name").alias(name))
