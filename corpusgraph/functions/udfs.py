"""The text functions under names of their own in SQL, and the recursive splitter as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions import text as T

#: Functions of one text that SQL gets, by their names in corpusgraph.functions.text; those that compare inside a lambda have no SQL form.
NAMES = (
    "strip", "normalize_text", "content_hash", "meaningful_len", "extract_citations", "strip_citations", "markdown_to_text", "strip_artifacts", "match_form", "heading_slug",
    "normalize_space", "has_table", "has_code", "diacritic_ratio", "clip_caption", "strip_page_markers", "normalize_page_dividers", "page_from_name", "sanitize_embed_input",
    "sanitize_kg_field", "is_small_talk",
)
#: Functions of several values, with the parameters that SQL gives them, in order.
SIGNATURES = {
    "strip_reasoning": "content STRING, thinking STRING", "format_citation": "file STRING, page INT, path ARRAY<STRING>", "source_label": "id STRING, file STRING, page INT, path ARRAY<STRING>",
    "contextualize": "path ARRAY<STRING>, content STRING", "mention_context": "content STRING, first INT, stop INT, kind STRING", "asset_url": "workspace STRING, image STRING",
    "estimate_chunks": "n BIGINT", "jaccard": "a ARRAY<BIGINT>, b ARRAY<BIGINT>", "encode_list": "items ARRAY<STRING>", "citation_id": "query BIGINT, place INT",
}


def register_udfs(spark: SparkSession, prefix: str = "cg_") -> list[str]:
    """Make the text functions callable in SQL and give their names; null gives what it gives in the function.

    Each is a temporary SQL function whose body is the native expression, so the optimizer sees through it. prefix + split_text(text,
    size, overlap) is a table function: a row (chunk_index, content) for each piece of a text, none for null.
    """
    made = []
    for name, parameters in ({n: "value STRING" for n in NAMES} | SIGNATURES).items():
        value = getattr(T, name)(*[F.col(p.split()[0]) for p in parameters.split(", ")])
        # the analyzed form writes comparisons as SQL does, the other one lambdas
        body = spark.createDataFrame([], parameters).select(value.alias("x"))._jdf.queryExecution().analyzed().expressions().apply(0).child().sql()
        body = value._jc.node().sql() if "lambdafunction(" in body else body
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURN {body}")
        made.append(prefix + name)

    @F.udtf(returnType="chunk_index int, content string")
    class SplitText:
        def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
            from corpusgraph.operators.chunking import split_recursive

            yield from enumerate(split_recursive(text or "", size, overlap))

    spark.udtf.register(f"{prefix}split_text", SplitText)
    return [*made, f"{prefix}split_text"]
