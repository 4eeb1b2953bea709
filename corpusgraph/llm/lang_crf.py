"""Language ID by words: a linear-chain conditional random field labels the words of (code-switched) text by forward-backward."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_slices, texts

#: Label of texts without letters.
UNKNOWN = "und"
#: Words of one chain; longer texts are a row of chains, so that no word is left out and work per word is even.
CHAIN_WORDS = 64
#: Bytes of text that are labelled at a time, which take about a hundred times as much memory; longer texts go in parts of so many words.
SLICE_BYTES, PART_WORDS = 1 << 18, 512 * CHAIN_WORDS
#: Hash places of character trigrams, of affixes (three prefixes, three suffixes), and of words in the lexicon.
TRIGRAMS, AFFIXES, LEXICON = 1 << 15, 1 << 13, 1 << 15
#: Bounds of the training sample: documents of each language, words of each document, chains, passes.
SAMPLE_DOCS, SAMPLE_WORDS, CHAINS, PASSES = 150, 400, 600, 40

_LETTER = np.array([97 <= b <= 122 or 65 <= b <= 90 or b >= 128 for b in range(256)])
_ANY_LETTER = re.compile(r"[^\W\d_]")
_POWERS = np.cumprod(np.full(256, 0x100000001B3, np.uint64))


@dataclass
class Words:
    """Words (runs of letters, lower case) of several texts: bytes with 0 between words, places of words, index of their text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray

    @classmethod
    def of(cls, batch: list[bytes]) -> Words:
        low = [t.decode().lower().encode() for t in batch]
        data = np.frombuffer(b" ".join(low) + b" ", np.uint8)
        letter = _LETTER[data]
        edge = np.diff(np.concatenate([[0], letter.view(np.int8)]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        stops = np.cumsum([len(t) + 1 for t in low])
        return cls(np.where(letter, data, 0).astype(np.int64), start, end, np.searchsorted(stops, start, "right"))

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Trigram place of each byte (TRIGRAMS between words), six affix places of each word, lexicon place of each word."""
        b, s, e = self.data, self.start, self.end
        left, right = np.concatenate([[0], b[:-1]]), np.concatenate([b[1:], [0]])
        tri = ((left * 961 + b) * 961 + right) * 0x9E3779B1 >> 7 & (TRIGRAMS - 1)
        tri[b == 0] = TRIGRAMS
        n, last = e - s, len(b) - 1
        at = lambda i, ok: np.where(ok, b[np.clip(i, 0, last)], 0)
        a1, a2, a3 = b[s], at(s + 1, n > 1), at(s + 2, n > 2)
        z1, z2, z3 = b[e - 1], at(e - 2, n > 1), at(e - 3, n > 2)
        codes = [a1, a1 * 256 + a2, (a1 * 256 + a2) * 256 + a3, z1, z1 * 256 + z2, (z1 * 256 + z2) * 256 + z3]
        affix = np.stack([(c * 0x85EBCA6B + k * 0xC2B2AE35 >> 9) & (AFFIXES - 1) for k, c in enumerate(codes)])
        affix += np.arange(6)[:, None] * AFFIXES
        return tri, affix, self.lexicon()

    def lexicon(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.int64)
        where = np.arange(len(self.data)) - np.repeat(np.concatenate([[0], self.start]), np.diff(np.concatenate([[0], self.start, [len(self.data)]])))
        sums = np.add.reduceat(self.data.astype(np.uint64) * _POWERS[where & 255], self.start)
        return ((sums * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (LEXICON - 1)


@dataclass
class Model:
    labels: list[str]
    tri: np.ndarray  # (TRIGRAMS + 1, labels), the last row zero
    affix: np.ndarray  # (6 * AFFIXES, labels)
    lexicon: np.ndarray  # (LEXICON, labels): log odds over all training documents
    scale: np.ndarray  # learned weight of the lexicon, bias of each label
    moves: np.ndarray  # (labels, labels) learned transitions

    def emissions(self, words: Words, feats=None) -> np.ndarray:
        tri, affix, lex = feats or words.features()
        if not len(words.start):
            return np.zeros((0, len(self.labels)), np.float32)
        out = np.add.reduceat(self.tri[tri], words.start, axis=0)
        for row in affix:
            out += self.affix[row]
        return out + self.scale[0] * self.lexicon[lex] + self.scale[1:]


def forward_backward(scores: np.ndarray, valid: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the labels of chains (chains, words, labels), and expected transitions summed over all chains."""
    chains, steps, labels = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a = np.exp(moves - moves.max())
    alpha, beta, expected = np.empty_like(e), np.ones_like(e), np.zeros((labels, labels))
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        x = (alpha[:, t - 1] @ a) * e[:, t]
        alpha[:, t] = x / x.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        x = (e[:, t + 1] * beta[:, t + 1]) @ a.T
        x /= x.sum(axis=1, keepdims=True)
        beta[:, t] = np.where(valid[:, t + 1, None], x, 1)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    for t in range(1, steps):
        pair = alpha[:, t - 1, :, None] * a * (e[:, t] * beta[:, t])[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True) * valid[:, t, None, None]).sum(axis=0)
    return gamma, expected


def chains_of(words: Words, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores cut into chains of CHAIN_WORDS words of one text, padded; which places hold words; place of each word."""
    n = len(scores)
    first = np.flatnonzero(np.concatenate([[True], words.text[1:] != words.text[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [n]]))
    pieces = -(-size // CHAIN_WORDS)
    nth = np.arange(n) - np.repeat(first, size)
    place = np.repeat(np.cumsum(pieces) - pieces, size) * CHAIN_WORDS + nth
    total = int(pieces.sum())
    flat = np.zeros((total * CHAIN_WORDS, scores.shape[1]), np.float32)
    flat[place] = scores
    valid = np.zeros(total * CHAIN_WORDS, bool)
    valid[place] = True
    return flat.reshape(total, CHAIN_WORDS, -1), valid.reshape(total, CHAIN_WORDS), place


def marginals(model: Model, words: Words) -> np.ndarray:
    """(words, labels): the probability of each label for each word."""
    scores = model.emissions(words)
    if not len(scores):
        return scores
    cut, valid, place = chains_of(words, scores)
    steps = min(CHAIN_WORDS, int(valid.sum(axis=1).max()))
    gamma = np.zeros_like(cut)
    for k in range(0, len(cut), 4096):
        gamma[k : k + 4096, :steps] = _gamma(cut[k : k + 4096, :steps], valid[k : k + 4096, :steps], model.moves)
    return gamma.reshape(-1, len(model.labels))[place]


def _gamma(cut: np.ndarray, valid: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """forward_backward without the transitions, time first so that each step is one block."""
    e = np.exp(cut - cut.max(axis=2, keepdims=True)).transpose(1, 0, 2).copy()
    a = np.exp(moves - moves.max()).astype(np.float32)
    alpha, ok = np.empty_like(e), valid.T
    x = e[0]
    for t in range(len(e)):
        x = (x @ a) * e[t] if t else x
        x = x / x.sum(axis=1, keepdims=True)
        alpha[t] = x
    beta = np.ones_like(e[0])
    for t in range(len(e) - 2, -1, -1):
        x = (e[t + 1] * beta) @ a.T
        beta = np.where(ok[t + 1, :, None], x / x.sum(axis=1, keepdims=True), np.float32(1))
        alpha[t] *= beta
    alpha /= alpha.sum(axis=2, keepdims=True)
    return alpha.transpose(1, 0, 2)


def train(labels: list[str], lexicon: np.ndarray, sample: list[tuple[str, bytes]], seed: int = 42) -> Model:
    """Fit weights and transitions on code-switched chains made of runs of the sample's words, by Adam on the log-likelihood."""
    rng, n = np.random.default_rng(seed), len(labels)
    log = np.log(lexicon + 0.5) - np.log(lexicon.sum(axis=0, keepdims=True) + 0.5 * LEXICON)
    model = Model(labels, np.zeros((TRIGRAMS + 1, n), np.float32), np.zeros((6 * AFFIXES, n), np.float32), (log - log.mean(axis=1, keepdims=True)).astype(np.float32), np.array([0.5] + [0.0] * n, np.float32), np.eye(n, dtype=np.float32) * 2)
    if n < 2 or not sample:
        return model
    by_label = {k: [t.split() for name, t in sample if name == label] for k, label in enumerate(labels)}
    by_label = {k: [t for t in v if t] for k, v in by_label.items()}
    usable = [k for k, v in by_label.items() if v]
    if len(usable) < 2:
        return model
    chains, gold = [], []
    for _ in range(CHAINS):
        chain, tags = [], []
        while len(chain) < CHAIN_WORDS:
            k = usable[int(rng.integers(len(usable)))]
            t = by_label[k][int(rng.integers(len(by_label[k])))]
            size, at = int(rng.integers(6, 40)), int(rng.integers(len(t)))
            chain += t[at : at + size]
            tags += [k] * len(t[at : at + size])
        chains.append(b" ".join(chain[:CHAIN_WORDS]))
        gold.append(tags[:CHAIN_WORDS])
    words = Words.of(chains)
    feats = words.features()
    tri, affix, lex = feats
    # sample words are runs of letters already, so each chain has CHAIN_WORDS words
    gold = np.array(gold).ravel()
    owner = np.repeat(np.arange(len(words.start)), np.diff(np.concatenate([words.start, [len(words.data)]])))
    tri_own = tri[words.start[0] :]
    hot = np.eye(n, dtype=np.float32)[gold]
    pairs = gold.reshape(-1, CHAIN_WORDS)
    moved = np.zeros((n, n))
    np.add.at(moved, (pairs[:, :-1].ravel(), pairs[:, 1:].ravel()), 1)
    params = [model.tri, model.affix, model.scale, model.moves]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    valid = np.ones((CHAINS, CHAIN_WORDS), bool)
    for step in range(1, PASSES + 1):
        scores = model.emissions(words, feats)
        gamma, expected = forward_backward(scores.reshape(CHAINS, CHAIN_WORDS, n).astype(np.float64), valid, model.moves.astype(np.float64))
        miss = (hot - gamma.reshape(-1, n)).astype(np.float64)
        g_tri = np.stack([np.bincount(tri_own, miss[owner, k], TRIGRAMS + 1) for k in range(n)], axis=1)
        g_tri[TRIGRAMS] = 0
        g_affix = np.stack([np.bincount(affix.ravel(), np.tile(miss[:, k], 6), 6 * AFFIXES) for k in range(n)], axis=1)
        g_scale = np.concatenate([[(miss * model.lexicon[lex]).sum()], miss.sum(axis=0)])
        g_moves = moved - expected
        for k, (p, g) in enumerate(zip(params, (g_tri, g_affix, g_scale, g_moves), strict=True)):
            g = g / len(gold) - 1e-6 * p
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p += (0.15 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def fit(labelled: DataFrame, seed: int = 42) -> Model:
    """Learn from documents (doc_id, text, lang): the lexicon from the words of all of them, weights and transitions from a sample.

    The sample is SAMPLE_DOCS documents of each language with the smallest seeded hashes, and SAMPLE_WORDS consecutive words of each.
    """
    docs = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    labels = sorted(counts)
    if not labels:
        return Model([], np.zeros((TRIGRAMS + 1, 0), np.float32), np.zeros((6 * AFFIXES, 0), np.float32), np.zeros((LEXICON, 0), np.float32), np.zeros(1, np.float32), np.zeros((0, 0), np.float32))
    index = {x: i for i, x in enumerate(labels)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(labels) * LEXICON, np.int64)
        for batch in text_slices(batches, "text", SLICE_BYTES):
            data, own = texts(batch), np.array([index[x] for x in batch.column("lang").to_pylist()])
            for part in [data] if len(data) > 1 or len(data[0]) <= SLICE_BYTES else ([x] for x in whole_chains(data[0])):
                words = Words.of(part)
                sums += np.bincount(own[words.text] * LEXICON + words.lexicon(), minlength=len(sums))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["place", "n"])

    lexicon = np.zeros(len(labels) * LEXICON)
    table = docs.select("text", "lang").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # labels x LEXICON rows at most
    lexicon[table["place"].to_numpy(np.int64)] = table["n"].to_numpy(float)

    place = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    share = F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(min(1.0, 4 * SAMPLE_DOCS / v)))])
    drawn = docs.withColumn("h", place).filter(F.shiftrightunsigned("h", 11) / float(1 << 53) <= share[F.col("lang")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE_BYTES):
            words, out = Words.of(texts(batch)), []
            ends = np.searchsorted(words.text, np.arange(batch.num_rows + 1))
            for i, h in enumerate(batch.column("h").to_pylist()):
                n = ends[i + 1] - ends[i]
                at = ends[i] + (h % (n - SAMPLE_WORDS) if n > SAMPLE_WORDS else 0)
                spans = range(at, min(at + SAMPLE_WORDS, ends[i + 1]))
                out.append(b" ".join(words.data[words.start[j] : words.end[j]].astype(np.uint8).tobytes() for j in spans))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(out, pa.binary())], ["lang", "h", "words"])

    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "words"))
    sample = drawn.select("text", "lang", "h").mapInArrow(cut, "lang string, h long, words binary").withColumn("rank", rank).filter(F.col("rank") <= SAMPLE_DOCS)
    rows = sorted((r["lang"], bytes(r["words"])) for r in sample.select("lang", "words").collect())
    return train(labels, lexicon.reshape(len(labels), LEXICON).T, rows, seed)


def predict(model: Model, data: list[bytes]) -> tuple[list[str], np.ndarray, Words | None, np.ndarray]:
    """Label and score of each text, its words, and their marginals."""
    n = len(data)
    names, means = [UNKNOWN] * n, np.zeros(n)
    if not model.labels:
        return names, means, None, np.zeros((0, 0))
    words = Words.of(data)
    gamma = marginals(model, words)
    sizes = np.bincount(words.text, minlength=n)
    sums = np.stack([np.bincount(words.text, gamma[:, k], n) for k in range(len(model.labels))], axis=1)
    best = sums.argmax(axis=1)
    for i in np.flatnonzero(sizes).tolist():
        if data[i].isascii() or _ANY_LETTER.search(data[i].decode()):
            names[i], means[i] = model.labels[best[i]], min(1.0, sums[i, best[i]] / sizes[i])
    return names, means, words, gamma


def whole_chains(text: bytes) -> Iterator[bytes]:
    """The text in lower case, cut before every PART_WORDS-th word: the chains of the parts are those of the whole."""
    low = text.decode().lower().encode()
    letter = _LETTER[np.frombuffer(low, np.uint8)]
    starts = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    cuts = [0, *starts[PART_WORDS::PART_WORDS].tolist(), len(low)]
    for a, b in itertools.pairwise(cuts):
        yield low[a:b]


def languages(model: Model, data: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Label and score of each text; a text over SLICE_BYTES is labelled part by part, as its chains do not depend on each other."""
    names, means = [UNKNOWN] * len(data), np.zeros(len(data))
    short = [i for i, t in enumerate(data) if len(t) <= SLICE_BYTES or not model.labels]
    for i, name, mean in zip(short, *predict(model, [data[i] for i in short])[:2], strict=True):
        names[i], means[i] = name, mean
    for i in sorted({*range(len(data))} - {*short}):
        size, sums = 0, np.zeros(len(model.labels))
        for part in whole_chains(data[i]):
            words = Words.of([part])
            size += len(words.start)
            sums += marginals(model, words).sum(axis=0, dtype=float)
        if size and (data[i].isascii() or _ANY_LETTER.search(data[i].decode())):
            names[i], means[i] = model.labels[sums.argmax()], min(1.0, sums.max() / size)
    return names, means


def keep_known(docs: DataFrame, model: Model, min_score: float) -> DataFrame:
    """The documents (all their columns) whose language is known with min_score at least; lang becomes the predicted language.

    Null texts and those without letters go; repeated rows are judged alike; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE_BYTES):
            names, means = languages(sent.value, texts(batch))
            named = batch.set_column(place, batch.schema.field(place).with_type(pa.string()), pa.array(names, pa.string()))
            yield named.filter(pa.array([name != UNKNOWN and mean >= min_score for name, mean in zip(names, means, strict=True)]))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, model: Model, keep: tuple = (), with_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (and the columns in keep; with_spans: runs of words of one label).

    lang_pred is the label with the largest mean marginal over the words of the whole text (the first in order on a tie), score this
    mean. A text that is null or has no letters is `und` with score 0; so is every text if the model knows no label. Repeated rows
    each get a row; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the table sizes above and the number of labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in text_slices(batches, "text", SLICE_BYTES):
            n = batch.num_rows
            names, means, words, gamma = predict(model, texts(batch)) if with_spans else (*languages(model, texts(batch)), None, None)
            spans = [[] for _ in range(n)]
            if with_spans and len(gamma):
                tag = gamma.argmax(axis=1)
                first = np.flatnonzero(np.concatenate([[True], (tag[1:] != tag[:-1]) | (words.text[1:] != words.text[:-1])]))
                heads = np.searchsorted(words.text, np.arange(n))
                for a, b in zip(first.tolist(), np.concatenate([first[1:], [len(tag)]]).tolist(), strict=True):
                    spans[words.text[a]].append({"start": int(a - heads[words.text[a]]), "n": b - a, "lang": model.labels[tag[a]]})
            cols = [batch.column(c) for c in ("doc_id", *keep)] + [pa.array(names), pa.array(means)]
            if with_spans:
                cols.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *keep, "lang_pred", "score", *(["spans"] if with_spans else [])])

    narrow = docs.select("doc_id", *keep, *([] if "text" in keep else ["text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.select("doc_id", *keep).schema)
    return narrow.mapInArrow(run, schema + ", lang_pred string, score double" + ", spans array<struct<start: int, n: int, lang: string>>" * with_spans)


def remainder(doc_id):
    """crc32 of doc_id as text, modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3


def predict_held_out(docs: DataFrame, seed: int = 42) -> DataFrame:
    """Learn from the documents whose remainder is not 1 and predict all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.filter(remainder("doc_id") != 1), seed)
    return identify(docs, model).select("doc_id", (remainder("doc_id") == 1).alias("held_out"), "lang_pred", "score")
