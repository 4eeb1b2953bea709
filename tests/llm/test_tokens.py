import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusgraph.llm import tokens
from corpusgraph.llm.queries import tokenizer_path

ODD = [None, "", " ", "\n", "a  b", "x\n y", "tail ", " head", "a\n\n\nb", "nb  sp", "a   b", "don't <|endoftext|> stop.", "x\n <|endoftext|>", "tab\there", "né à, ünï. 漢字 😀", "a, b. c,", "1.5 2,", "word " * 5000, "same", "same"]


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 60000) | st.integers(0, 3), max_size=300))
@settings(max_examples=200, deadline=None)
def test_words_hold_every_id(ids):
    ids = np.array(ids, np.uint64)
    assert (tokens.unpack(tokens.pack(ids), len(ids)) == ids).all()


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 60000), min_size=1, max_size=400), st.data())
@settings(max_examples=200, deadline=None)
def test_a_block_is_read_from_any_place(ids, data):
    every, tokens.OFFSET_EVERY = tokens.OFFSET_EVERY, 4
    try:
        words = tokens.pack(np.array(ids, np.uint64))
        offsets = tokens.block_offsets(words)
    finally:
        tokens.OFFSET_EVERY = every
    start = data.draw(st.integers(0, len(ids)))
    n = data.draw(st.integers(0, len(ids) - start))
    assert tokens.unpack_range(words, *offsets, start, n).tolist() == ids[start : start + n]


def test_a_document_longer_than_a_block(spark):
    """A document of more ids than a block holds stands between short ones."""
    long = "\n".join(f"word{i} and {i * 7919 % 10007}, then" for i in range(12_000))
    rows = [(1, "a"), (2, long), (3, "b c"), (4, None)] + [(i, "w " * 150 + str(i)) for i in range(5, 40)]
    got = tokens.read_token_files(tokens.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(), partitions=1)).orderBy("doc_id").collect()
    want = [np.array([*ids, 2], "<u4") for ids in library_ids([t for _, t in rows])]
    assert len(want[1]) > tokens.BLOCK_IDS
    assert [(r["n_tokens"], r["ids_crc32"]) for r in got] == [(len(w), zlib.crc32(w.tobytes())) for w in want]


def library_ids(texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(tokenizer_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@given(st.lists(st.text(st.sampled_from("ab.,'!\n \t  é1漢<|>s"), max_size=12), max_size=30))
@settings(max_examples=150, deadline=None)
def test_parts_have_the_ids_of_the_whole(texts):
    got = tokens.encoder(tokenizer_path()).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == library_ids(texts)


@given(st.lists(st.lists(st.sampled_from(["a", "Zé", "é", "ÿ", "×", "÷", "ª", "ɐ", "1", "²", "\u0301", "漢", "😀", "\x00", "\x1c", "\x7f", "'", "'s", "'ll", "’", "\"", ".", ",", "**", "_", "#", "=", "<|endoftext|>", " ", " ", " ", "\n", "\n", "\xa0", "\u2028", "\x85", "\t"]), max_size=25).map("".join), max_size=12))
@settings(max_examples=600, deadline=None)
def test_cuts_at_marks_keep_the_ids(texts):
    enc = tokens.encoder(tokenizer_path())
    pieces, tokens.PIECES = tokens.PIECES, 5
    try:
        got = enc.encode(texts)
    finally:
        tokens.PIECES = pieces
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x.ids for x in enc.library.encode_batch(texts, add_special_tokens=False)]


def asked(enc, monkeypatch):
    """What the library is asked for from now on, without the empty lists."""
    pieces, letters, ids = [], enc._letters, enc._ids
    monkeypatch.setattr(enc, "_letters", lambda piece: pieces.append(piece) or letters(piece))
    monkeypatch.setattr(enc, "_ids", lambda parts: pieces.extend(parts) or ids(parts))
    return pieces


def test_a_word_is_encoded_once_whatever_marks_follow(monkeypatch):
    enc = tokens.Encoder(tokenizer_path())
    pieces = asked(enc, monkeypatch)
    texts = ["und Straßen Straßen, Straßen. Straßen### Straßen,***", "und Straßen; né né. né,"]
    got = [enc.encode(texts), enc.encode(texts)]
    assert sorted(pieces) == sorted(["und", " Straßen", " né", ",", ".", "###", ",***", ";"])
    assert [[np.frombuffer(x, "<u4").tolist() for x in g] for g in got] == [library_ids(texts)] * 2


def test_the_cache_never_exceeds_its_bound(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 30)
    enc = tokens.Encoder(tokenizer_path())
    for k in range(3):
        texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{'x' * k}" for i in range(j, j + 40)) for j in range(0, 200, 40)]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == library_ids(texts)
        assert len(enc.known) == 30


def test_round_trip(spark):
    rows = [(i, t, "z") for i, t in enumerate(ODD)] + [(3, "again", "z"), (None, "no id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")  # n_tokens: a clashing extra column
    got = [tuple(r) for r in tokens.read_token_files(tokens.write_token_files(docs, tokenizer_path(), partitions=3)).collect()]
    want, start = [], 0
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    for (i, _, _), ids in zip(ordered, library_ids([r[1] for r in ordered]), strict=True):
        data = np.array([*ids, 2], "<u4").tobytes()
        want.append((i, start, len(ids) + 1, zlib.crc32(data)))
        start += len(ids) + 1
    assert sorted(got, key=lambda r: r[1]) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.read_token_files(tokens.write_token_files(docs, tokenizer_path(), partitions=2)).collect() == []
