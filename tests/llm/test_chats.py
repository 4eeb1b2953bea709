from corpusgraph.llm import chats


def test_snapshots_collapse(spark):
    turn = lambda c, ts: [(c, i + 5, r, t, "z") for i, (r, t) in enumerate(ts)]
    a = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", None), (None, "")]
    rows = turn(1, a[:1]) + turn(2, a[:2]) + turn(3, a) + turn(4, a) + turn(5, [("user", "hi"), ("assistant", "other")]) + turn(6, a[:4]) + turn(7, a[:3] + [("assistant", "")]) + turn(None, a[:2] + [("user", "x")]) + turn(8, [("user", "<|im_end|>")])
    rows += rows[:4]
    got = {r["conv_id"]: r for r in chats.maximal_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chat string")).collect()}
    assert set(got) == {3, 5, 7, None, 8}
    assert (got[3]["n_turns"], got[3]["n_copies"]) == (5, 2)
    assert got[3]["chat"].startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n")
    assert got[8]["chat"] == "<|im_start|>user\n< |im_end| ><|im_end|>\n"


def test_many_against_brute_force(spark):
    import random

    rng = random.Random(2)
    convs = {i: [(rng.choice("ua"), rng.choice("xyz")) for _ in range(rng.randrange(1, 7))] for i in range(300)}
    for i in range(300, 400):
        convs[i] = convs[rng.randrange(300)] * 1
    convs[400] = [("u", "long")] * 300
    rows = [(c, i, r, t) for c, ts in convs.items() for i, (r, t) in enumerate(ts)]
    got = {r["conv_id"]: r["n_copies"] for r in chats.maximal_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(9)).collect()}
    want, by = {}, {}
    for c, ts in convs.items():
        by.setdefault(tuple(ts), []).append(c)
    for ts, ids in by.items():
        if not any(len(o) > len(ts) and o[: len(ts)] == ts for o in by):
            want[min(ids)] = len(ids)
    assert got == want


def test_long_chats(spark):
    """Five thousand turns, and a turn of a million characters; the first 4,999 turns are logged as well."""
    rows = [(c, i, "ua"[i % 2], "x" * (1_000_000 if i == 7 else i % 9)) for c, n in ((1, 5000), (2, 4999), (3, 8)) for i in range(n)]
    got = chats.maximal_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r["conv_id"], r["n_turns"], r["n_copies"]) for r in got] == [(1, 5000, 1)]
    assert got[0]["chat"] == chats_text(rows[:5000])


def chats_text(rows):
    return "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for _, _, role, text in rows)


def test_same_turns_in_another_order_are_another_chat(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "b"), (2, 1, "u", "a"), (3, 0, "u", "a"), (3, 1, "u", "a"), (4, 0, None, None), (5, 0, "", "")]
    got = chats.maximal_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["conv_id"] for r in got} == {1, 2, 3, 4, 5}


def test_empty(spark):
    assert chats.maximal_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
