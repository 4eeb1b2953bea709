"""Token-id output: tokenized documents packed with Simple-8b words into sharded, ordered files, and their reader."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_slices, write_table

# Fixed values of the file format: of each 64-bit word the upper 4 bits are the selector, the lower 60 hold COUNTS[selector]
# ids of WIDTHS[selector] bits each, the first id lowest. Selector 15 is the escape: its word holds no id, the next word is one raw 64-bit id.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
#: A block takes whole documents up to so many ids (or one longer document), and decodes by itself.
BLOCK_IDS = 1 << 16
#: Entries a Python worker keeps of encoded pieces; a bound on memory only, other pieces are encoded each time.
CACHE_WORDS = 800_000
#: Bytes of text that are encoded at a time (a single longer text stands alone), and pieces of it that are looked up at a time.
SLICE_BYTES = 1 << 22
PIECES = 1 << 20
#: A text is encoded whole if it is empty, white space stands at its end or beside other, or some is neither a space nor a line end.
WHOLE = r"\A\z|\A[ \n]|[ \n]\z|[ \n][ \n]|[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Kinds of UTF-8 bytes.
SPACE, ALNUM, MARK, HIGH = 1, 2, 3, 4
KINDS = np.array([SPACE if b in b" \n" else ALNUM if chr(b).isalnum() else MARK if 32 < b < 127 else 0 for b in range(128)] + [HIGH] * 128, np.uint8)


def pack(ids: np.ndarray) -> np.ndarray:
    """Ids (unsigned 64-bit) as Simple-8b words. Each word takes as many ids as fit one selector; a last word that is not full is padded with zeros."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    small = ids < np.uint64(1 << 60)
    bits = np.full(n, 64, np.uint8)
    bits[small] = np.maximum(1, np.frexp(ids[small].astype(np.float64))[1]).astype(np.uint8)
    exact = (ids[small] >> np.minimum(bits[small], 63).astype(np.uint64)) > 0  # rounding to double can only lose a bit
    bits[small] += exact.astype(np.uint8)
    bits[bits > 60] = 64
    # reach[i]: the selector with most ids, so that the ids from i on fit; missing ids past the end count as one bit
    padded = np.concatenate([bits, np.ones(64, np.uint8)])
    most, span = {1: padded}, 1
    while span < 32:
        a = most[span]
        most[2 * span] = np.maximum(a[:-span], a[span:])
        span *= 2
    choice = np.full(n, ESCAPE, np.uint8)
    for s in range(len(COUNTS) - 1, -1, -1):
        count, power = COUNTS[s], 1 << (COUNTS[s].bit_length() - 1)
        a = most[power]
        widest = np.maximum(a[:n], a[count - power : count - power + n])
        choice[widest <= WIDTHS[s]] = s
    steps = np.array([*COUNTS, 0, 1], np.int64)[choice].tolist()
    at, starts = 0, []
    put = starts.append
    while at < n:
        put(at)
        at += steps[at]
    starts = np.array(starts, np.int64)
    chosen = choice[starts]
    escaped = chosen == ESCAPE
    place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(escaped)[:-1]])
    out = np.zeros(len(starts) + int(escaped.sum()), np.uint64)
    out[place] = chosen.astype(np.uint64) << np.uint64(60)
    out[place[escaped] + 1] = ids[starts[escaped]]
    more = np.concatenate([ids, np.zeros(64, np.uint64)])
    for s, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        if (mine := chosen == s).any():
            first, words = starts[mine], out[place[mine]]
            for j in range(count):
                words |= more[first + j] << np.uint64(j * width)
            out[place[mine]] = words
    return out


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of Simple-8b words, all words of a selector at once."""
    words = np.asarray(words, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (selectors >= 14).any():  # what follows an escape is raw, whatever its upper bits
        for i in np.flatnonzero(selectors == ESCAPE).tolist():
            if not raw[i]:
                if i + 1 >= len(words):
                    raise ValueError("escape without a value")
                raw[i + 1] = True
        if ((selectors == 14) & ~raw).any():
            raise ValueError("unknown selector")
    counts = np.array([*COUNTS, 0, 0], np.int64)[selectors]
    counts[raw] = 1
    starts = np.concatenate([[0], np.cumsum(counts)])
    if starts[-1] < n:
        raise ValueError("too few words")
    out = np.zeros(int(starts[-1]), np.uint64)
    for s, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        mine = np.flatnonzero((selectors == s) & ~raw)
        if len(mine):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
            ids = (words[mine, None] >> shifts) & np.uint64((1 << width) - 1)
            out[(starts[mine, None] + np.arange(count)).ravel()] = ids.ravel()
    at = np.flatnonzero(raw)
    out[starts[at]] = words[at]
    return out[:n]


class Encoder:
    """The tokenizers library behind a cache of encoded pieces.

    A text whose words are parted by single spaces and line ends alone is cut before each of them, and before ASCII marks that follow a
    letter or digit: byte-level pre-tokenization also cuts there, so the ids of the pieces are the ids of the text. Any other text goes
    to the library whole. Pieces are looked up once for each slice of texts. For a word of Latin letters the library's model alone is asked.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        self.cuts = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not spec.get("normalizer")
        self.marks = [x["content"] for x in spec.get("added_tokens", [])]
        self.cuts = self.cuts and len(self._ids(["\n"])[0]) == 4
        self.known: dict[str, bytes] = {}
        if self.cuts:
            (self.line,) = self._ids(["\n"])
            # the byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for those from 256 on, in order
            plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
            self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - plain))}
            self.model = self.library.model

    def _ids(self, parts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(parts, add_special_tokens=False)]

    def _letters(self, piece: str) -> bytes:
        """Ids of letters (after a space or not), which pre-tokenization leaves whole, straight from the library's model."""
        mapped = piece.replace(" ", self.alphabet[32]) if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def encode(self, batch: list[str] | pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text; no text is null."""
        texts = batch.cast(pa.string()) if isinstance(batch, pa.Array) else pa.array(batch, pa.string())
        whole = np.ones(len(texts), bool)
        if self.cuts:
            whole = pc.match_substring_regex(texts, WHOLE).to_numpy(zero_copy_only=False)
            for mark in self.marks:
                whole = whole | pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        out = [b""] * len(texts)
        for way, mine in ((self._ids, whole), (self._cut, ~whole)):
            if mine.any():
                chosen = texts.filter(pa.array(mine))
                for i, ids in zip(np.flatnonzero(mine).tolist(), way(chosen.to_pylist() if way == self._ids else chosen), strict=True):
                    out[i] = ids
        return out

    def _cut(self, texts: pa.StringArray) -> list[bytes]:
        """Ids of texts that may be cut, each with a line end put before it so that all pieces of first words are alike."""
        lines = pc.binary_join_element_wise(pa.scalar("\n"), texts, pa.scalar(""))
        _, offsets, values = lines.buffers()
        offsets = np.frombuffer(offsets, np.int32)[: len(lines) + 1]
        data = np.frombuffer(values, np.uint8)[: offsets[-1]]
        starts = np.append(_starts(data), len(data)).astype(np.int32)
        parts, counts = [], [np.zeros(1, np.int64)]
        for a in range(0, len(starts) - 1, PIECES):
            bounds = starts[a : a + PIECES + 1]
            pieces = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), values).dictionary_encode()
            found = self._find(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            at = pieces.indices.to_numpy()
            n = sizes[at]
            ends = np.cumsum(n)
            shift = (np.cumsum(sizes) - sizes)[at] - (ends - n)
            parts.append(np.frombuffer(b"".join(found), "<u4")[np.repeat(shift, n) + np.arange(ends[-1])])
            counts.append(n)
        ids = np.concatenate(parts).tobytes()
        before = np.cumsum(np.concatenate(counts))[np.searchsorted(starts, offsets)].tolist()
        return [ids[4 * x + 4 : 4 * y] for x, y in zip(before, before[1:], strict=False)]  # without the line end

    def _find(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces, from the cache or the library."""
        found: list = list(map(self.known.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        rest = []
        for i in new:
            piece = pieces[i]
            word = piece[1:]
            if piece[0] in " \n" and word.isalpha() and (word.isascii() or max(word) < "\u0250"):
                found[i] = self._letters(piece) if piece[0] == " " else self.line + self._letters(word)
            else:
                rest.append(i)
        for i, ids in zip(rest, self._ids([pieces[i] for i in rest]), strict=True):
            found[i] = ids
        self.known.update((pieces[i], found[i]) for i in new[: max(0, CACHE_WORDS - len(self.known))])
        return found


def _starts(data: np.ndarray) -> np.ndarray:
    """Where the pieces of UTF-8 bytes start: at white space, and at ASCII marks behind an ASCII letter or digit or a letter of U+00C0 to U+00FF."""
    kinds = KINDS[data]
    starts = kinds == SPACE
    marks = kinds[1:] == MARK
    starts[1:] |= marks & (kinds[:-1] == ALNUM)
    at = np.flatnonzero(marks & (kinds[:-1] == HIGH)) + 1
    letter = (data[at - 2] == 0xC3) & (data[at - 1] != 0x97) & (data[at - 1] != 0xB7)  # all but the signs of multiplication and division
    starts[at[letter]] = True
    return np.flatnonzero(starts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


BLOCK = "part int, block long, first_id long, n_ids long, doc_ids array<long>, doc_tokens array<long>, words binary, offset_words array<long>, offset_ids array<long>"
#: Simple-8b words between two entries of a block's offsets.
OFFSET_EVERY = 1024


def block_offsets(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where to start in the middle of a block: an index of a word and that of its first id, for about every OFFSET_EVERY-th word (where that is the value of an escape, the word after it)."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([*COUNTS, 0, 0], np.int64)[selectors]
    value = np.zeros(len(words) + 1, bool)
    for i in np.flatnonzero(selectors == ESCAPE).tolist():
        if not value[i]:
            value[i + 1] = True
    counts[value[:-1]] = 1
    at = np.arange(0, len(words), OFFSET_EVERY)
    at += value[at]
    at = at[at < len(words)]
    return at, np.concatenate([[0], np.cumsum(counts)])[at]


def unpack_range(words: np.ndarray, offset_words: np.ndarray, offset_ids: np.ndarray, start: int, n: int) -> np.ndarray:
    """Ids start to start + n of a block; only the words between the offsets around them are decoded."""
    if not n:
        return np.empty(0, np.uint64)
    low = int(np.searchsorted(offset_ids, start, "right")) - 1
    high = int(np.searchsorted(offset_ids, start + n, "left"))
    end = int(offset_words[high]) if high < len(offset_words) else len(words)
    skipped = start - int(offset_ids[low])
    return unpack(words[int(offset_words[low]) : end], skipped + n)[skipped:]


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Encode documents in ascending doc_id order and write them to the shared folder; the result is the table of blocks as read back.

    Part p holds the documents of the p-th range of doc_id, in blocks of BLOCK_IDS ids; words is the Simple-8b payload, offset_words and
    offset_ids say where to start in it (block_offsets), doc_ids and doc_tokens which documents the block holds and how many ids of each.
    Null texts count as empty and get the end id alone; rows of one doc_id stand in order of their text; null doc_id comes last.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    ranged = keyed.repartitionByRange(partitions or _parts(docs), order[0]).sortWithinPartitions(*order)  # by doc_id alone: the sample of the range goes to the driver

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, tail = TaskContext.get().partitionId(), encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        number = first = held = 0
        ids, names, counts = [], [], []

        def flush():
            nonlocal number, first, held, ids, names, counts
            flat = np.frombuffer(b"".join(ids), "<u4")
            packed = pack(flat)
            offset_words, offset_ids = block_offsets(packed)
            row = pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "block": [number], "first_id": [first], "n_ids": [held], "doc_ids": pa.array([names], pa.list_(pa.int64())), "doc_tokens": pa.array([counts], pa.list_(pa.int64())), "words": pa.array([packed.astype("<u8").tobytes()], pa.binary()), "offset_words": pa.array([offset_words], pa.list_(pa.int64())), "offset_ids": pa.array([offset_ids], pa.list_(pa.int64()))}
            )
            number, first, held, ids, names, counts = number + 1, first + held, 0, [], [], []
            return row

        for batch in text_slices(batches, "text", SLICE_BYTES):
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), enc.encode(pc.fill_null(batch.column("text"), "")), strict=True):
                data += tail
                n = len(data) // 4
                if held and held + n > BLOCK_IDS:
                    yield flush()
                ids.append(data)
                names.append(doc_id)
                counts.append(n)
                held += n
        if held:
            yield flush()

    return write_table(ranged.mapInArrow(blocks, BLOCK), "token-blocks")


def read_token_files(blocks: DataFrame) -> DataFrame:
    """Decode every document from the blocks: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A block is decoded BLOCK_IDS ids at a time, started by its offsets, so a very long document is never held decoded. A block of no
    documents does not occur, and no blocks give no rows; null and repeated doc_ids come back as they were written.
    """
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each part, so at most as many as there are partitions
    starts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))

    def crcs_of(words: np.ndarray, offsets: list[np.ndarray], counts: np.ndarray) -> list[int]:
        out, begin = [], 0
        ends = np.cumsum(counts)
        for k in range(0, len(counts)):
            if k and ends[k] - begin <= held:  # in what is decoded
                a = int(ends[k - 1]) - begin
                out.append(zlib.crc32(data[4 * a : 4 * (int(ends[k]) - begin)]))
                continue
            start, crc = int(ends[k] - counts[k]), 0
            while start < ends[k]:
                begin, held = start, min(BLOCK_IDS, int(ends[-1]) - start)
                data = memoryview(unpack_range(words, *offsets, begin, held).astype("<u4").tobytes())
                stop = min(int(ends[k]), begin + held)
                crc = zlib.crc32(data[: 4 * (stop - begin)], crc)
                start = stop
            out.append(crc)
        return out

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, first_id, doc_ids, words = (batch.column(c)[row].as_py() for c in ("part", "first_id", "doc_ids", "words"))
                counts, *offsets = (batch.column(c)[row].values.to_numpy() for c in ("doc_tokens", "offset_words", "offset_ids"))
                crcs = crcs_of(np.frombuffer(words, "<u8"), offsets, counts)
                begins = np.cumsum(counts) - counts
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "part": pa.array([part] * len(crcs), pa.int32()), "begin": begins + first_id, "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    decoded = blocks.mapInArrow(decode, "doc_id long, part int, begin long, n_tokens long, ids_crc32 long")
    return decoded.join(F.broadcast(starts), "part").select("doc_id", (F.col("begin") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def _parts(docs: DataFrame) -> int:
    spark = docs.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
