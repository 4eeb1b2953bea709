"""Quality by lines: a linear-chain conditional random field labels every line good or bad; marginals, weighted by length, score a document."""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_slices, texts

#: Bound of the training sample: documents of each label (whole texts), and passes over it.
SAMPLE_DOCS, PASSES = 1500, 80
#: Score from which a document is predicted to be good.
THRESHOLD = 0.3

#: Bins of a feature; the last is for a neighbour that is not there.
BINS = 17
_SHARES = np.array([0.001, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])


def _class(of) -> np.ndarray:
    return np.array([of(b) for b in range(256)], bool)


_UPPER, _LOWER, _DIGIT = (_class(lambda b, lo=lo, hi=hi: lo <= b <= hi) for lo, hi in ((65, 90), (97, 122), (48, 57)))
_HIGH, _SPACE, _CONTROL = _class(lambda b: b >= 128), _class(lambda b: b in b" \t\x0b\x0c\r"), _class(lambda b: b < 32 and b not in b"\t\n\x0b\x0c\r")
_STOP, _BAR = _class(lambda b: b in b".,;:?'\"()-"), _class(lambda b: b in b"|\t")
_MARK = ~(_UPPER | _LOWER | _DIGIT | _HIGH | _SPACE | _CONTROL | _STOP | _BAR | _class(lambda b: b == 10))
_KIND = np.select([_UPPER, _LOWER, _DIGIT, _HIGH, _STOP, _BAR, _MARK], range(7), 7)
#: Features of a line, in the order in which Lines.of makes them.
FEATURES = (
    "bytes", "words", "word length", "upper case", "stops", "marks", "digits", "blanks", "non-ASCII", "bars", "control",
    "distinct words", "commonest word", "words as before", "words before marks", "first byte", "last byte", "line seen before", "longest run of a byte",
)


@dataclass
class Lines:
    """The lines of several texts that are not blank: features (lines, FEATURES) as bins, bytes of each, index of their text."""

    bins: np.ndarray
    size: np.ndarray
    text: np.ndarray

    @classmethod
    def of(cls, batch: list[bytes]) -> Lines:
        lines, owner, again, distinct, common, echo, words = [], [], [], [], [], [], []
        for i, text in enumerate(batch):
            seen = set()
            for line in text.split(b"\n"):
                w = line.split()
                if not w:
                    continue
                key = b" ".join(w)
                counts = Counter(w)
                lines.append(line)
                owner.append(i)
                again.append(key in seen)
                seen.add(key)
                words.append(len(w))
                distinct.append(len(counts))
                common.append(max(counts.values()))
                echo.append(sum(map(operator.eq, w, w[1:])))
        if not lines:
            return cls(np.zeros((0, len(FEATURES)), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))
        size = np.array([len(x) for x in lines], np.int64)
        data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
        start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        count = lambda hit: np.add.reduceat(hit.astype(np.int32), start)
        upper, lower, stops, marks, digits, blanks, high, bars, control = (count(c[data]) for c in (_UPPER, _LOWER, _STOP, _MARK, _DIGIT, _SPACE, _HIGH, _BAR, _CONTROL))
        after = np.concatenate([data[1:], [10]])
        ends = count((_MARK | _BAR)[data] & (_SPACE[after] | (after == 10)))
        # runs of one byte: how far each place is from the start of its run, the largest in a line
        place = np.arange(len(data))
        new = np.concatenate([[True], data[1:] != data[:-1]])
        run = np.maximum.reduceat(np.where(data == 10, 0, place - np.maximum.accumulate(np.where(new, place, 0)) + 1), start)
        words, seen_words = np.array(words), np.array(distinct)
        share = lambda x, of: np.searchsorted(_SHARES, x / np.maximum(of, 1), "right")
        log = lambda x: np.minimum(15, np.frexp(x.astype(float))[1])
        ink = size - blanks
        firsts, lasts = data[start], data[start + size - 1]
        bins = [
            log(size), log(words), np.minimum(15, ink // words), share(upper, upper + lower), share(stops, ink), share(marks, ink), share(digits, ink), share(blanks, size), share(high, ink), share(bars, ink), share(control, ink),
            share(seen_words, words), share(np.array(common), words), share(np.array(echo), words), share(ends, words), _KIND[firsts], _KIND[lasts], np.array(again, np.int64), log(run),
        ]
        return cls(np.stack(bins, axis=1).astype(np.uint8), size, np.array(owner, np.int64))


@dataclass
class Model:
    weights: np.ndarray  # (3, FEATURES, BINS): of the line before, the line, the line after; for good against bad
    bias: float
    moves: np.ndarray  # (2, 2) learned transitions between bad (0) and good (1)
    prior: float  # share of good documents among all labels to learn from; what texts without lines get

    def emissions(self, places: np.ndarray) -> np.ndarray:
        """Score of good against bad of each line, from the places that its features have among the weights."""
        return self.weights.ravel()[places].sum(axis=1) + self.bias


def feature_places(bins: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """(lines, 3 * FEATURES): where the features of a line and of its neighbours in its chain stand among the weights."""
    n, width = bins.shape
    none = np.full((1, width), BINS - 1, np.int64)
    bins = bins.astype(np.int64)
    same = (chain[1:] == chain[:-1])[:, None]
    before = np.concatenate([none, np.where(same, bins[:-1], none)]) if n else bins
    after = np.concatenate([np.where(same, bins[1:], none), none]) if n else bins
    at = np.arange(width) * BINS
    return np.concatenate([k * width * BINS + at + x for k, x in enumerate((before, bins, after))], axis=1)


def forward_backward(scores: np.ndarray, chain: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of good for each line, and expected transitions (2, 2) summed over all chains.

    chain numbers the chain of each line, lines of a chain side by side in order. All chains take a step at a time, the longer ones
    first in order, so that a step is one block and no chain is cut.
    """
    n = len(scores)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    first = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))
    length = np.diff(np.concatenate([first, [n]]))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    active = len(length) - np.searchsorted(np.sort(length), np.arange(length[0]), "right")  # chains longer than t
    top = np.maximum(scores, 0)
    e = np.exp(np.stack([-top, scores - top], axis=1))
    a = np.exp(moves - moves.max())
    alpha, beta = np.empty((n, 2)), np.ones((n, 2))
    x = e[first]
    alpha[first] = x / x.sum(axis=1, keepdims=True)
    for t in range(1, length[0]):
        at = first[: active[t]] + t
        x = (alpha[at - 1] @ a) * e[at]
        alpha[at] = x / x.sum(axis=1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(length[0] - 1, 0, -1):
        at = first[: active[t]] + t
        ahead = e[at] * beta[at]
        x = ahead @ a.T
        beta[at - 1] = x / x.sum(axis=1, keepdims=True)
        pair = alpha[at - 1][:, :, None] * a * ahead[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    gamma = alpha * beta
    return gamma[:, 1] / gamma.sum(axis=1), expected


def train(docs: list[tuple[int, np.ndarray]], prior: float, seed: int = 42) -> Model:
    """Fit weights and transitions by Adam on the log-likelihood of chains of lines; docs: label and bins of each document's lines.

    Each document is a chain whose lines have its label. As labels never change within a document, as many chains more are made of
    the first lines of one document and the last lines of another.
    """
    rng, width = np.random.default_rng(seed), len(FEATURES)
    model = Model(np.zeros((3, width, BINS)), 0.0, np.eye(2), prior)
    docs = [(y, x) for y, x in docs if len(x)]
    if len({y for y, _ in docs}) < 2:
        return model
    chains = [(x, np.full(len(x), y)) for y, x in docs]
    for i, j in enumerate(rng.permutation(len(docs)).tolist()):
        (y1, x1), (y2, x2) = docs[i], docs[j]
        head, tail = x1[: int(rng.integers(1, len(x1) + 1))], x2[int(rng.integers(len(x2))) :]
        chains.append((np.concatenate([head, tail]), np.repeat([y1, y2], [len(head), len(tail)])))
    bins, gold = np.concatenate([x for x, _ in chains]), np.concatenate([y for _, y in chains])
    chain = np.repeat(np.arange(len(chains)), [len(y) for _, y in chains])
    # a document counts alike, long or short
    weight = (1 / np.array([len(y) for _, y in chains]))[chain]
    places = feature_places(bins, chain)
    follows = np.flatnonzero(chain[1:] == chain[:-1])
    moved = np.bincount(gold[follows] * 2 + gold[follows + 1], minlength=4).reshape(2, 2)
    params = [model.weights, np.zeros(1), model.moves]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, PASSES + 1):
        good, expected = forward_backward(model.emissions(places), chain, model.moves)
        miss = (gold - good) * weight
        g_weights = np.bincount(places.ravel(), np.repeat(miss, places.shape[1]), model.weights.size).reshape(model.weights.shape)
        for k, (p, g) in enumerate(zip(params, (g_weights / len(chains), np.array([miss.sum() / len(chains)]), (moved - expected) / len(gold)), strict=True)):
            g = g - 1e-4 * p
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            p += 0.05 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
        model.bias = float(params[1][0])
    return model


def _id_text(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(_id_text(doc_id)) % 5


def fit(docs: DataFrame, labels: DataFrame, seed: int = 42) -> Model:
    """Learn from documents (doc_id, text) and labels (doc_id, quality 0 or 1).

    The sample is SAMPLE_DOCS labels of each quality with the smallest seeded hashes, and the whole texts of their documents. Other
    qualities, null ones and labels of null ids are left out; of several labels of one document each counts.
    """
    rows = labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    if not counts:
        return Model(np.zeros((3, len(FEATURES), BINS)), 0.0, np.eye(2), 0.5)
    place = F.xxhash64(F.lit(seed), _id_text("doc_id"))
    share = F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(min(1.0, 4 * SAMPLE_DOCS / v)))])
    drawn = rows.withColumn("h", place).filter(F.shiftrightunsigned("h", 11) / float(1 << 53) <= share[F.col("quality")])
    rank = F.row_number().over(Window.partitionBy("quality").orderBy("h", "doc_id"))
    picked = drawn.withColumn("rank", rank).filter(F.col("rank") <= SAMPLE_DOCS).select(F.col("doc_id").alias("l_id"), "quality", "h")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            lines = Lines.of(texts(batch))
            ends = np.searchsorted(lines.text, np.arange(batch.num_rows + 1))
            flat = [lines.bins[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("h"), pa.array(flat, pa.binary())], ["quality", "h", "bins"])

    met = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("l_id")).select("quality", "h", "text")
    sample = met.mapInArrow(features, "quality int, h long, bins binary").collect()  # a byte for each feature of a line of the sample
    rows = sorted((r["h"], r["quality"], bytes(r["bins"])) for r in sample)
    return train([(y, np.frombuffer(b, np.uint8).reshape(-1, len(FEATURES))) for _, y, b in rows], counts.get(1, 0) / sum(counts.values()), seed)


def line_marginals(model: Model, batch: list[bytes]) -> tuple[Lines, np.ndarray]:
    """The lines of texts, and the probability of each to be good."""
    lines = Lines.of(batch)
    return lines, forward_backward(model.emissions(feature_places(lines.bins, lines.text)), lines.text, model.moves)[0]


def score(docs: DataFrame, model: Model, with_lines: bool = False) -> DataFrame:
    """doc_id, score of each document (doc_id, text): the mean of its lines' probabilities to be good, weighted by their bytes.

    with_lines adds lines: bytes and probability of each line that is not blank. Texts that are null, empty or blank have the model's
    prior; a text without line breaks is one line; repeated rows are scored alike; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in text_slices(batches, "text"):
            n = batch.num_rows
            lines, good = line_marginals(model, texts(batch))
            total = np.bincount(lines.text, lines.size, n)
            mean = np.where(total > 0, np.bincount(lines.text, lines.size * good, n) / np.maximum(total, 1), model.prior)
            cols = [batch.column("doc_id"), pa.array(np.clip(mean, 0.0, 1.0))]
            if with_lines:
                ends = np.searchsorted(lines.text, np.arange(n + 1))
                each = [[{"bytes": int(s), "good": float(g)} for s, g in zip(lines.size[a:b], good[a:b], strict=True)] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                cols.append(pa.array(each, pa.list_(pa.struct([("bytes", pa.int64()), ("good", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", *(["lines"] if with_lines else [])])

    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, score double" + ", lines array<struct<bytes: long, good: double>>" * with_lines)


def score_held_out(docs: DataFrame, labels: DataFrame, seed: int = 42) -> DataFrame:
    """Learn from the labels of documents whose remainder is not 0 and score all documents: doc_id, held_out, score, predicted."""
    model = fit(docs, labels.filter(remainder() != 0), seed)
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    return score(docs, model).select("doc_id", (remainder() == 0).alias("held_out"), "score", predicted)


def documents_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_held_out(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
