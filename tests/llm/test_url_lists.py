import random

from corpusgraph.llm import url_lists


def keys_by_hand(host, path):
    labels = host.split(".")
    steps = [s for s in path.split("/") if s]
    return {f"host:{host}", *(f"domain:{'.'.join(labels[i:])}" for i in range(max(1, len(labels) - 1))), *(f"prefix:{host}/{'/'.join(steps[: i + 1])}" for i in range(len(steps)))}


def test_history_by_day(spark):
    rng = random.Random(1)
    hosts = ["a.b.example.com", "b.example.com", "x.org", "hot.net"]
    captures, urls = [], {}
    for i in range(400):
        h, p = hosts[min(3, rng.randrange(8))], rng.choice(["", "/", "/p", "/p/q.html", "/z//y/"])
        u = f"https://User@{h.upper()}:80{p}?q#f"
        urls[u] = (h, p)
        captures.append((i, u, rng.randrange(200)))
    patterns = ["host:hot.net", "domain:example.com", "domain:b.example.com", "prefix:x.org/p", "prefix:hot.net/z/y", "host:a.b.example.com"]
    entries = [(rng.choice("uvw"), rng.choice(patterns), rng.choice(["add", "add", "remove"]), rng.randrange(-20, 220)) for _ in range(150)]
    entries += entries[:20] + [(None, "host:x.org", "add", 1), ("u", None, "add", 1), ("u", "host:x.org", "add", None), ("u", "host:x.org", "keep", 3)]
    got = {r["page_id"]: r for r in url_lists.judge(spark.createDataFrame(captures, "page_id long, url string, day int"), spark.createDataFrame(entries, "list string, pattern string, action string, day int"), bucket_days=16).collect()}
    assert len(got) == len(captures)
    for page_id, u, day in captures:
        active = set()
        for name, pattern in {(e[0], e[1]) for e in entries if None not in e}:
            events = [(e[3], e[2] == "remove") for e in entries if e[:2] == (name, pattern) and e[3] is not None and e[3] <= day and e[2] != "keep"]
            if events and not max(events)[1] and pattern in keys_by_hand(*urls[u]):
                active.add((name, pattern))
        r = got[page_id]
        assert (r["n_active"], r["lists"], r["verdict"]) == (len(active), ",".join(sorted({a for a, _ in active})), "block" if active else "allow"), (u, day)


def test_odd_rows(spark):
    captures = spark.createDataFrame([(1, None, 5, "k"), (2, "no url", 5, "k"), (3, "http://x.org", None, "k"), (None, "http://x.org./", 5, "k"), (4, "http://x.org", 5, "k"), (4, "http://x.org", 5, "k"), (5, "", 5, "k")], "page_id long, url string, day int, lists string")
    entries = spark.createDataFrame([("l", "host:x.org", "add", 5)], "list string, pattern string, action string, day int")
    got = sorted((str(r["page_id"]), r["verdict"]) for r in url_lists.judge(captures, entries).collect())
    assert got == [("1", "allow"), ("2", "allow"), ("3", "allow"), ("4", "block"), ("4", "block"), ("5", "allow"), ("None", "block")]
    assert {r["verdict"] for r in url_lists.judge(captures, entries.limit(0)).collect()} == {"allow"}
    assert url_lists.judge(captures.limit(0), entries).collect() == []
