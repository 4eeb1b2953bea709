"""Text expressions over columns. All of them are native, so they stay in one generated stage with what is around them."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def let(value: Column, f) -> Column:
    """f(value) with value computed once, where f would otherwise compute it anew in each step of an inner lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(c: C) -> Column:
    """Without Unicode white space at either end."""
    return _sub(_sub(_c(c), r"(?U)\A\s+"), r"(?U)\s+\z")


def normalize_text(c: C) -> Column:
    """Lower case, white space runs as one space."""
    return _sub(F.lower(strip(c)), r"(?U)\s+", " ")


def content_hash(c: C) -> Column:
    return F.sha2(normalize_text(c).cast("binary"), 256)


def _gram_starts(chars: Column, n: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))


def _chars(c: C) -> Column:
    """Characters of the normalized text as an array: a place of an array is found at once, that of a string by counting from its start."""
    return F.regexp_extract_all(normalize_text(c), F.lit("(?s)(.)"), 1)


def char_shingles(c: C, n: int = 5) -> Column:
    """Distinct n-grams of characters of the normalized text; a shorter text is its own only shingle."""
    return F.array_distinct(let(_chars(c), lambda a: F.transform(_gram_starts(a, n), lambda i: F.array_join(F.slice(a, i + 1, F.lit(n)), ""))))


def shingle_hashes(c: C, n: int = 5) -> Column:
    """64-bit hashes of char_shingles, distinct: smaller to shuffle and faster to compare."""
    return F.array_distinct(let(_chars(c), lambda a: F.transform(_gram_starts(a, n), lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(n)]))))


def jaccard(a: C, b: C) -> Column:
    """Similarity of two sets given as arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(_c(a), _c(b)))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(F.array_union(_c(a), _c(b)))), F.lit(0.0))


def meaningful_len(c: C) -> Column:
    """Characters but for white space, rules, bullets, quotes and brackets."""
    return F.length(_sub(_c(c), r"""(?U)[\s\-_=~*|#>•·"'`(){}\[\]]+"""))


# Patterns of boilerplate chunks (matched at the start of the stripped text), and legal phrases that make a short text boilerplate.
BOILERPLATE = (
    r"^[\s\S]{0,30}(?:©|copyright|\(c\)|all\s+rights?\s+reserved)[\s\S]{0,300}$",
    r"^[\s\S]{0,30}(?:confidential|proprietary|internal\s+use\s+only)[\s\S]{0,300}$",
    r"^\s*(?:page|trang|p\.?)?\s*\d{1,4}\s*(?:[/of|trên]\s*\d{1,4})?\s*$",
    r"^\s*[-_=~*]{4,}\s*$",
    r"^\s*(?:table\s+of\s+contents?|mục\s+lục|nội\s+dung)\s*$",
    r"^\s*(?:draft|bản\s+nháp|watermark|confidential)\s*$",
    r"^[A-ZÀ-Ỹa-zà-ỹ\s\-|·•]{3,60}\s*[|·•\-—]\s*(?:page|trang|p\.?)?\s*\d{0,4}\s*$",
)
LEGAL_PHRASES = (
    "theo quy định của pháp luật", "không được sao chép", "bảo mật thông tin", "điều khoản sử dụng", "chịu trách nhiệm trước pháp luật", "bản quyền thuộc về",
    "all rights reserved", "without prior written consent", "this document is confidential", "for internal use only", "subject to change without notice",
    "disclaimer:", "terms and conditions", "no part of this publication",
)


def is_boilerplate(c: C) -> Column:
    """Whether a text is a page mark, a rule, a notice or the like; null for null. The text is stripped once and met by one pattern."""
    whole = "(?iuU)" + "|".join(f"(?:{p})" for p in BOILERPLATE)
    legal = "|".join(re.escape(phrase) for phrase in LEGAL_PHRASES)
    return let(strip(c), lambda t: t.rlike(whole) | ((F.length(t) < 300) & F.lower(t).rlike(legal)))


def format_citation(file: C, page: C, path: C) -> Column:
    """file | p.N | A > B, leaving out a page of 0 and an empty path."""
    page_part = F.when(_c(page) > 0, F.concat(F.lit("p."), _c(page).cast("string")))
    return F.concat_ws(" | ", _c(file), page_part, F.nullif(F.array_join(_c(path), " > "), F.lit("")))


def source_label(id_: C, file: C, page: C, path: C) -> Column:
    """Source [id] (file, page N, headings):"""
    page_part = F.when(_c(page) > 0, F.concat(F.lit("page "), _c(page).cast("string")))
    inside = F.concat_ws(", ", _c(file), page_part, F.nullif(F.array_join(_c(path), " > "), F.lit("")))
    return F.concat(F.lit("Source ["), _c(id_), F.lit("]"), F.when(inside != "", F.concat(F.lit(" ("), inside, F.lit(")"))).otherwise(""), F.lit(":"))


# Fixed value: the form of citations.
_CITED = r"\[(?:[a-z0-9]+|IMG-[a-z0-9]+)(?:,\s*(?:[a-z0-9]+|IMG-[a-z0-9]+))*\]"


def extract_citations(c: C) -> Column:
    """Cited ids in order; grouped ones apart."""
    groups = F.regexp_extract_all(_c(c), F.lit(f"({_CITED})"), 1)
    return F.flatten(F.transform(groups, lambda g: F.split(F.regexp_replace(g, r"[\[\]\s]", ""), ",")))


def strip_citations(c: C) -> Column:
    return strip(_sub(_sub(_c(c), r"\s*" + _CITED), r"\n{3,}", "\n\n"))


# The patterns of Markdown marks, in the order they go.
def markdown_to_text(c: C) -> Column:
    """Plain text of Markdown: fences give their inner lines, marks go."""
    t = strip_citations(c)
    t = F.regexp_replace(t, F.lit(r"(?s)```[^\n]*\n(.*?)\n?[^\n]*```"), F.lit("$1"))
    for pattern, to in (
        (r"`([^`]+)`", "$1"), (r"!\[([^\]]*)\]\([^)]+\)", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"),
        (r"__(.+?)__", "$1"), (r"_(.+?)_", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^[-*_]{3,}\s*$", ""), (r"\n{3,}", "\n\n"),
    ):
        t = _sub(t, pattern, to)
    return strip(t)


def strip_artifacts(c: C) -> Column:
    return _sub(_c(c), r"<unused\d+>:?\s*")


def encode_list(c: C, separator: str = "|") -> Column:
    return F.array_join(_c(c), separator)


def decode_list(c: C, separator: str = "|") -> Column:
    return F.filter(F.split(_c(c), "\\Q" + separator + "\\E"), lambda x: x != "")


@functools.cache
def _base_letters() -> tuple[str, str]:
    """Characters whose canonical decomposition is a letter or digit of ASCII and accents, and what they are without accents, in lower case; besides them the Vietnamese d."""
    found = {"đ": "d", "Đ": "d"}
    for code in range(0x80, 0x30000):
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not "\u0300" <= c <= "\u036f")
        if len(bare) == 1 and bare.isascii() and bare.isalnum():
            found[chr(code)] = bare.lower()
    return "".join(found), "".join(found.values())


def match_form(c: C) -> Column:
    """Lower case without accents (composed or not), anything but a-z and 0-9 as single spaces. Only texts beyond ASCII are looked through for accents."""
    accented, bare = _base_letters()
    accents = "".join(map(chr, range(0x300, 0x370)))  # go, as they have no counterpart
    plain = let(_c(c), lambda t: F.when(t.rlike(r"[^\x00-\x7f]"), F.translate(t, accented + accents, bare)).otherwise(t))
    return F.trim(_sub(F.lower(plain), r"[^a-z0-9]+", " "))


def heading_slug(c: C) -> Column:
    return F.substring(_sub(match_form(c), r"\s+", "-"), 1, 80)


def search_needle(c: C) -> Column:
    """The first line with text, without Markdown marks, cut to 220 characters."""
    lines = F.filter(F.transform(F.split(_c(c), "\n"), lambda x: strip(x)), lambda x: x != "")
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    return F.substring(F.trim(_sub(_sub(first, r"[`*_>#|]", " "), r"\s+", " ")), 1, 220)


def highlight(text: C, query: C) -> Column:
    """Words of the query of over two characters marked in the text, whatever their case."""
    words = F.filter(F.split(F.trim(_c(query)), r"\s+"), lambda w: F.length(w) > 2)
    literal = F.transform(words, lambda w: F.regexp_replace(w, r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    return F.when(F.size(literal) > 0, F.regexp_replace(_c(text), F.concat(F.lit("(?i)("), F.array_join(literal, "|"), F.lit(")")), F.lit("<mark>$1</mark>"))).otherwise(_c(text))


def question_keywords(c: C) -> Column:
    """Distinct lower-cased words of two characters at least, without punctuation at their edges."""
    words = F.split(F.trim(F.lower(_c(c))), r"\s+")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"""^[.,?!:;"'()\[\]{}]+|[.,?!:;"'()\[\]{}]+$""", ""))
    return F.array_distinct(F.filter(bare, lambda w: F.length(w) >= 2))


def word_tokens(c: C) -> Column:
    """Lower-cased words between white space: the default tokens of lexical search."""
    return F.filter(F.split(F.lower(_c(c)), r"\s+"), lambda w: w != "")


def sanitize_embed_input(c: C, limit: int | None = 32_000) -> Column:
    whole = F.coalesce(F.nullif(strip(c), F.lit("")), F.lit("[empty]"))
    return whole if limit is None else F.substring(whole, 1, limit)


def truncate(c: C, n: int) -> Column:
    return F.when(F.length(_c(c)) > n, F.concat(F.substring(_c(c), 1, n), F.lit("..."))).otherwise(_c(c))


# What an entity's description says before the text around it, and without such text.
MENTION_IN, MENTION_ALONE = ("Mentioned as ", " in context: "), " in the source text."


def mention_context(text: C, start: C, end: C, kind: C, around: int = 64) -> Column:
    """Description of an entity of a kind from what stands within `around` characters of a mention (0-based, end exclusive), cut to 180."""
    low = F.greatest(_c(start) - around, F.lit(0))
    near = strip(_sub(F.substring(_c(text), low + 1, _c(end) + around - low), r"(?U)\s+", " "))
    cut = F.when(F.length(near) > 180, F.concat(F.substring(near, 1, 177), F.lit("..."))).otherwise(near)
    return F.concat(F.lit(MENTION_IN[0]), _c(kind), F.when(cut == "", F.lit(MENTION_ALONE)).otherwise(F.concat(F.lit(MENTION_IN[1]), cut)))


def normalize_space(c: C) -> Column:
    return F.trim(_sub(_c(c), r"\s+", " "))


# The marks between the fields of a graph record and at its end.
KG_DELIMITERS = ("<|#|>", "<|COMPLETE|>")


def sanitize_kg_field(c: C, kind: str = "field") -> Column:
    """A field of a graph record, without delimiters, white space as single spaces; null counts as empty.

    An empty type is Other. Relations have underscores for spaces, and an empty one is related_to; keywords have spaces for
    underscores, and empty ones are "related to".
    """
    t = F.coalesce(_c(c), F.lit(""))
    for mark in KG_DELIMITERS:
        t = F.replace(t, F.lit(mark), F.lit(" "))
    t = strip(_sub(t, r"(?U)\s+", " "))
    or_else = lambda x, other: F.coalesce(F.nullif(x, F.lit("")), F.lit(other))
    if kind == "type":
        return or_else(t, "Other")
    if kind == "relation":
        return or_else(F.replace(t, F.lit(" "), F.lit("_")), "related_to")
    return or_else(F.replace(t, F.lit("_"), F.lit(" ")), "related to") if kind == "keywords" else t


def clip_caption(c: C, n: int = 500) -> Column:
    return F.substring(normalize_space(c), 1, n)


def has_table(c: C) -> Column:
    return F.contains(_c(c), F.lit("|")) & F.contains(_c(c), F.lit("---"))


def has_code(c: C) -> Column:
    return F.contains(_c(c), F.lit("```"))


def contextualize(path: C, c: C) -> Column:
    return F.when(F.size(_c(path)) > 0, F.concat(F.array_join(_c(path), " > "), F.lit(": "), F.substring(_c(c), 1, 100))).otherwise("")


def page_count(c: C, separator: str) -> Column:
    return F.when(_c(c) == "", 0).otherwise(F.size(F.split(_c(c), "\\Q" + separator + "\\E")))


def inject_images(md: C, assets: C, placeholder: str = "<!-- image -->") -> Column:
    """The nth placeholder becomes the nth image (array of struct<caption, url>); placeholders without an image go."""
    parts = F.split(_c(md), "\\Q" + placeholder + "\\E", -1)
    tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, i: F.concat(_image(F.get(_c(assets), i)), p))
    return F.concat(F.element_at(parts, 1), F.array_join(tail, ""))


def _image(a: Column) -> Column:
    return F.when(a.isNull(), "").otherwise(F.concat(F.lit("!["), F.coalesce(a["caption"], F.lit("")), F.lit("]("), a["url"], F.lit(")")))


def estimate_chunks(n: C, size: int = 500, overlap: int = 50) -> Column:
    return F.when(_c(n) <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(_c(n) / (size - overlap))))


def relink_images(md: C, assets: C) -> Column:
    """Links to asset names become links to their URLs, asset by asset (array of struct<name, url>)."""
    return F.aggregate(_c(assets), _c(md), lambda t, a: F.replace(t, F.concat(F.lit("]("), a["name"], F.lit(")")), F.concat(F.lit("]("), a["url"], F.lit(")"))))


def strip_page_markers(c: C) -> Column:
    return _sub(_sub(_c(c), r"\A\{\d+\}\s*"), r"\n\{\d+\}")


def normalize_page_dividers(c: C) -> Column:
    """Page markers {n} between rules become <!-- page n -->."""
    return _sub(_c(c), r"\n*\{(\d+)\}-{3,}\n*", "\n\n<!-- page $1 -->\n\n")


def strip_reasoning(content: C, thinking: C) -> Column:
    """Without <think> blocks; an empty rest falls back to the thinking text."""
    return F.coalesce(F.nullif(strip(_sub(_c(content), r"(?s)<think>.*?</think>")), F.lit("")), _c(thinking), F.lit(""))


_CALL = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"


def extract_tool_call(c: C) -> Column:
    """struct<name, arguments, rest> of a logged tool call; what is not JSON stays in the text."""
    body = F.from_json(F.regexp_extract(_c(c), _CALL, 1), "name string, arguments string")
    good = body["name"].isNotNull()
    return F.struct(body["name"].alias("name"), body["arguments"].alias("arguments"), F.when(good, strip(_sub(_c(c), _CALL))).otherwise(_c(c)).alias("rest"))


def normalize_entity_types(types: C, fallback: list[str]) -> Column:
    """Trimmed, without empty ones; the fallback if nothing is left."""
    kept = F.array_distinct(F.filter(F.transform(_c(types), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(F.array(*map(F.lit, fallback or ["Other"])))


def set_rating(ratings: C, key: C, value: C) -> Column:
    """The map with one rating set."""
    rest = F.map_filter(F.coalesce(_c(ratings), F.create_map().cast("map<string,string>")), lambda k, _: k != _c(key))
    return F.map_concat(rest, F.create_map(_c(key), _c(value)))


def page_from_name(c: C) -> Column:
    return F.coalesce(F.regexp_extract(_c(c), r"page[_-]?(\d+)", 1).try_cast("int"), F.lit(0))


def parse_custom_metadata(c: C) -> Column:
    """JSON list of {key, value} as a map, the last value of a key winning; null for what is no such list."""
    items = F.filter(F.from_json(_c(c), "array<struct<key:string,value:string>>"), lambda x: x["key"].isNotNull())
    last = F.filter(items, lambda x, i: ~F.exists(F.slice(items, i + 2, F.size(items)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def is_small_talk(c: C) -> Column:
    t = normalize_text(c)
    # Fixed value: greetings and thanks.
    greeting = (
        r"(?iuU)^(?:hi|hello|hey|alo|xin\s*chao|xin\s*chào|chao|chào|ok|okay|vâng|vang|da|dạ|thanks?|thank\s*you|cam\s*on|cảm\s*ơn|"
        r"bye|goodbye|tam\s*biet|tạm\s*biệt|hen\s*gap\s*lai|hẹn\s*gặp\s*lại)(?:[\s!,.?]+)?$"
    )
    return (t == "") | ((F.length(t) <= 80) & t.rlike(greeting))


# Fixed value: Vietnamese accented letters.
_VIETNAMESE = "áàảãạăắằẳẵặâấầẩẫậéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵđ"


def diacritic_ratio(c: C) -> Column:
    """Share of Vietnamese accented letters among letters; null without letters."""
    marked = F.length(_sub(F.lower(_c(c)), f"[^{_VIETNAMESE}]"))
    return F.try_divide(marked.cast("double"), F.length(_sub(_c(c), r"[^\p{L}]")))


def citation_id(query: C, rank: C, attempt: C | None = None) -> Column:
    """Four characters of a-z and 0-9 with a letter first, from a hash of (query, rank); the same for the same answer."""
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789"
    h = F.xxhash64(_c(query), _c(rank), *([] if attempt is None else [_c(attempt)]))
    at = lambda shift, n: F.substring(F.lit(alphabet), (F.pmod(F.shiftrightunsigned(h, shift), F.lit(n)) + 1).cast("int"), F.lit(1))
    return F.concat(at(0, 26), at(12, 36), at(24, 36), at(36, 36))


def citation_ids(query: C, n: C, attempts: int = 20) -> Column:
    """Array of n different citation ids of a query: a rank whose id is taken gets the next attempt's."""
    made = lambda r: F.concat(F.array(citation_id(query, r)), F.transform(F.sequence(F.lit(1), F.lit(attempts)), lambda a: citation_id(query, r, a)))
    free = lambda done, r: F.get(F.array_except(made(r), done), F.lit(0))
    return F.aggregate(F.sequence(F.lit(1), _c(n)), F.array().cast("array<string>"), lambda done, r: F.array_append(done, free(done, r)))


def dot(a: C, b: C) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: C) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: C, b: C) -> Column:
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalize(a: C) -> Column:
    n = norm(a)
    return F.transform(_c(a), lambda x: F.when(n > 0, x / n).otherwise(x))


def asset_url(workspace: C, image: C) -> Column:
    return F.format_string("/static/doc-images/kb_%s/images/%s.png", _c(workspace).cast("string"), _c(image).cast("string"))
