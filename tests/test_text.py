"""Golden cases of text expressions and splitters."""

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import metrics as M
from corpusgraph.functions import text as T
from corpusgraph.operators import chunking as K
from corpusgraph.operators import dedup, retrieval


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "c string").select(f(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [
    ("Page 3", True), ("- 12 -", False), ("3 / 10", True), ("----", True), ("MỤC LỤC", True), ("© 2024 Acme", True), ("A plain sentence about nothing in particular, long enough", False),
    ("x" * 280 + " all rights reserved", False), ("y. " * 90 + "all rights reserved", True), ("Disclaimer: none of this is so; it was all made up by one of us", True), ("Trang 5", True),
])
def test_boilerplate(spark, text, want):
    assert one(spark, text, T.is_boilerplate) == want


def test_normalize(spark):
    assert one(spark, "  A B \n c ", T.normalize_text) == "a b c"
    assert one(spark, "abc", T.char_shingles) == ["abc"]
    assert one(spark, "abcdef", T.char_shingles) == ["abcde", "bcdef"]
    assert one(spark, "a-b [c] 'd' | #", T.meaningful_len) == 4


def test_citations(spark):
    assert one(spark, "x [a3x9, IMG-p4f2] y [1][b2].", T.extract_citations) == ["a3x9", "IMG-p4f2", "1", "b2"]
    assert one(spark, "x [a3x9, IMG-p4f2] y [1].\n\n\n\nz", T.strip_citations) == "x y.\n\nz"
    assert one(spark, "# T\n**b** *i* `c` [My link](u) ![An image](v)\n```py\ncode\n```", T.markdown_to_text) == "T\nb i c My link An image\ncode"
    ids = spark.range(200).select(T.citation_id(F.lit("q"), F.col("id")).alias("x")).collect()
    assert all(len(r["x"]) == 4 and r["x"][0].isalpha() for r in ids)


def test_metadata_and_calls(spark):
    assert one(spark, '[{"key":"a","value":"1"},{"key":"a","value":"2"},{"key":"b","value":"3"}]', T.parse_custom_metadata) == {"a": "2", "b": "3"}
    assert one(spark, "not json", T.parse_custom_metadata) is None
    call = one(spark, 'go <tool_call>{"name":"f","arguments":{"q":1}}</tool_call> on', T.extract_tool_call)
    assert (call["name"], call["arguments"]) == ("f", '{"q":1}')
    assert one(spark, "<tool_call>{bad}</tool_call>", T.extract_tool_call)["name"] is None
    assert one(spark, "Đường Phố, 12!", T.match_form) == "duong pho 12"
    assert one(spark, "Đường Phố", T.heading_slug) == "duong-pho"
    assert one(spark, "\n ## **Big** title\nx", T.search_needle) == "Big title"
    assert one(spark, "Big cat. big", lambda c: T.highlight(c, F.lit("big of (x"))) == "<mark>Big</mark> cat. <mark>big</mark>"
    assert one(spark, "scan_page-12.png", T.page_from_name) == 12


def test_images(spark):
    assets = F.array(F.struct(F.lit("one").alias("caption"), F.lit("/1.png").alias("url")))
    assert one(spark, "a<!-- image -->b<!-- image -->c", lambda c: T.inject_images(c, assets)) == "a![one](/1.png)bc"
    named = F.array(F.struct(F.lit("x.png").alias("name"), F.lit("/u").alias("url")))
    assert one(spark, "![i](x.png)", lambda c: T.relink_images(c, named)) == "![i](/u)"


def test_metrics(spark):
    score = lambda text, f: one(spark, text, f)["score"]
    assert score("Sorry, no relevant information.", lambda c: M.refusal_accuracy(c, F.lit(False))) == 0
    assert score("word " * 30 + "no relevant information", lambda c: M.refusal_accuracy(c, F.lit(False))) == 0.8
    assert score("Good. It does not contain that [1]. " + "word " * 30, M.phantom_citations) == pytest.approx(0.3)
    assert score("[1, 2]", M.citation_format) == 0
    assert score("Tiếng Việt đó", lambda c: M.language_match(c, F.lit("vi"))) == 1


def test_recursive_splitter(spark):
    text = "\n\n".join(" ".join(f"w{i}{j}" for j in range(60)) for i in range(5))
    rows = K.chunk_recursive(spark.createDataFrame([(1, text), (2, "  "), (3, None), (4, "x" * 1200)], "document_id long, text string"), 200, 20).collect()
    assert {r["document_id"] for r in rows} == {1, 4}
    assert all(len(r["content"]) <= 200 for r in rows)
    words = {w for r in rows if r["document_id"] == 1 for w in r["content"].split()}
    assert words == set(text.split())
    for r in rows:
        if r["document_id"] == 1:
            assert text[r["char_start"] : r["char_end"]] == r["content"]


def test_sections(spark):
    md = "pre\n# A\nx\n### C\ny\n## B\nz\n# D\n# E\nlast"
    rows = K.split_sections(spark.createDataFrame([(1, md)], "document_id long, text string")).orderBy("section_no").collect()
    assert [(r["heading_path"], r["content"]) for r in rows] == [([], "pre"), (["A"], "x"), (["A", "C"], "y"), (["A", "B"], "z"), (["E"], "last")]


def test_blocks_and_html(spark):
    rows = K.split_blocks(spark.createDataFrame([(1, "a\nb\n\n```\nc\n\nd\n```\n\ne")], "document_id long, text string")).orderBy("block_no").collect()
    assert [r["content"] for r in rows] == ["a\nb", "```\nc\n\nd\n```", "e"]
    rows = K.split_blocks(spark.createDataFrame([(1, "a\n\n$$\nx\n\ny\n$$\n\nb")], "document_id long, text string")).orderBy("block_no").collect()
    assert [r["content"] for r in rows] == ["a", "$$\nx\n\ny\n$$", "b"]
    html = "<head><title>t</title></head><script>x</script><h2>T &amp; U</h2><p>one<p>two<ul><li>a<li>b</ul><nav>n</nav>"
    assert one(spark, html, K.html_to_markdown) == "## T & U\n\none\ntwo\n\n- a\n- b"


def test_near_chain_keeps_ends(spark):
    pairs = spark.createDataFrame([(1, 0, 1, 0.9), (1, 1, 2, 0.9)], "document_id long, a int, b int, similarity double")
    assert [tuple(r) for r in dedup.near_losers(pairs).collect()] == [(1, 1)]


def test_rerank_falls_back(spark):
    c = spark.createDataFrame([(1, i, 0.01 * i) for i in range(1, 6)] + [(2, 1, 0.9), (2, 2, 0.1)], "query_id long, ordinal int, s double")
    got = {(r["query_id"], r["ordinal"]) for r in retrieval.rerank(c, F.col("s"), 8).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (2, 1)}
