"""License scans: ordered signature rules behind a keyword prefilter, overlaps resolved by priority."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_slices, texts

# Words are lower-cased runs of letters and digits; other ASCII parts them. Rules see the words joined by single spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

# Phrases whose places are counted, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# License families. (label, keywords of the prefilter, pattern of the name; {v} is where a version stands, versions)
FAMILIES = (
    ("agpl", "affero", r"gnu affero general public license(?: agpl)?{v}|affero gpl{v}", ("1", "2", "3")),
    ("lgpl", "lesser|library", r"gnu (?:lesser|library) general public license(?: lgpl)?{v}|lesser gpl{v}", ("2", "2 1", "3")),
    ("gpl", "general public|gpl", r"gnu general public license(?: gpl)?{v}|gnu gpl{v}", ("1", "2", "3")),
    ("apache", "apache|asl", r"apache (?:software )?license{v}|asl{v}", ("1", "1 1", "2", "2 0")),
    ("mit", "mit|expat", r"mit (?:expat )?licen[sc]e{v}|expat licen[sc]e{v}", ()),
    ("bsd", "bsd", r"(?:modified |simplified |new |revised )?bsd(?: style)? licen[sc]e{v}|bsd {v}clause(?: licen[sc]e)?", ("2", "3", "4")),
    ("mpl", "mozilla", r"mozilla public license{v}", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", r"eclipse (?:public|distribution) license{v}", ("1 0", "2 0")),
    ("cddl", "common development", r"common development and distribution license{v}", ("1 0", "1 1")),
    ("cc0", "cc0|creative commons", r"cc0{v}|creative commons zero{v}", ("1 0",)),
    ("cc-by-nc-nd", "cc by|creative commons", r"cc by nc nd{v}|creative commons attribution non ?commercial no ?deriv(?:ative)?s{v}", ("3 0", "4 0")),
    ("cc-by-nc-sa", "cc by|creative commons", r"cc by nc sa{v}|creative commons attribution non ?commercial share ?alike{v}", ("2 0", "3 0", "4 0")),
    ("cc-by-nc", "cc by|creative commons", r"cc by nc{v}|creative commons attribution non ?commercial{v}", ("2 0", "3 0", "4 0")),
    ("cc-by-nd", "cc by|creative commons", r"cc by nd{v}|creative commons attribution no ?deriv(?:ative)?s{v}", ("3 0", "4 0")),
    ("cc-by-sa", "cc by|creative commons", r"cc by sa{v}|creative commons attribution share ?alike{v}", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "cc by|creative commons", r"cc by{v}|creative commons attribution{v}", ("2 0", "3 0", "4 0")),
    ("isc", "isc", r"isc licen[sc]e{v}", ()),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e{v}", ()),
    ("boost", "boost", r"boost software license{v}", ("1 0",)),
    ("artistic", "artistic", r"(?:perl )?artistic license{v}", ("1 0", "2 0")),
    ("unlicense", "unlicense", r"(?:the )?unlicense{v}", ()),
    ("wtfpl", "wtfpl", r"wtfpl{v}", ("2",)),
    ("odbl", "database", r"open (?:data commons )?(?:open )?database license{v}", ("1 0",)),
    ("gfdl", "free documentation", r"gnu free documentation license{v}", ("1 1", "1 2", "1 3")),
    ("ofl", "open font", r"(?:sil )?open font license{v}", ("1 1",)),
    ("eupl", "european union", r"european union public licen[sc]e{v}", ("1 1", "1 2")),
    ("psf", "python", r"(?:python software foundation|python) licen[sc]e{v}", ("2",)),
)

# Short names and SPDX ids, which count only where a license is granted. (label, keywords of the prefilter, name; {s} is a version)
SHORT = (
    ("agpl", "agpl", r"(?:gnu )?agpl{s}"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl{s}"),
    ("gpl", "gpl", r"(?:gnu )?gpl{s}"),
    ("apache", "apache|asl", r"(?:apache|asl){s}"),
    ("mit", "mit|expat", r"mit(?: 0)?|expat"),
    ("bsd", "bsd|0bsd", r"0 ?bsd|bsd"),
    ("mpl", "mpl", r"mpl{s}"),
    ("epl", "epl", r"epl{s}"),
    ("cddl", "cddl", r"cddl{s}"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib"),
    ("boost", "bsl|boost", r"(?:bsl|boost){s}"),
    ("artistic", "artistic", r"artistic{s}"),
    ("odbl", "odbl", r"odbl{s}"),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl{s}"),
    ("ofl", "ofl", r"(?:sil )?ofl{s}"),
    ("eupl", "eupl", r"eupl{s}"),
    ("psf", "psf|python", r"psf{s}|python 2 0"),
)
#: Of the version that may follow a short name, also without a space, and the priority beyond which grants are too weak for one.
SHORT_VERSION, SHORT_GRANTS = r"(?:(?: version)? ?v?[1-9](?: [0-9])?)?(?: or later| only)?", 25

# How a license is given. (priority, score, pattern; {n} is the name). The first of a set of overlapping detections is the one of lowest priority number.
GRANTS = (
    (10, 1.0, r"spdx license identifier {n}"),
    (20, 0.95, r"(?:is |are )?(?:dual )?licensed under (?:the )?(?:terms of )?(?:the )?(?:terms and conditions of the )?{n}"),
    (20, 0.95, r"(?:is |are )?released under (?:the )?(?:terms of )?(?:the )?{n}"),
    (20, 0.95, r"(?:is |are )?(?:re)?distributed under (?:the )?(?:terms of )?(?:the )?{n}"),
    (25, 0.9, r"(?:made |is |are )?available under (?:the )?(?:terms of )?(?:the )?{n}"),
    (25, 0.9, r"(?:is |are )?published under (?:the )?(?:terms of )?(?:the )?{n}"),
    (25, 0.9, r"subject to (?:the )?(?:terms of )?(?:the )?{n}"),
    (25, 0.9, r"(?:is |are )?(?:governed|covered) by (?:the )?(?:terms of )?(?:the )?{n}"),
    (30, 0.85, r"under (?:the )?(?:terms of )?(?:the )?{n}"),
    (40, 0.7, r"(?:see|read) (?:the )?{n}"),
    (40, 0.7, r"(?:copy of|text of) (?:the )?{n}"),
    (60, 0.5, r"{n}"),
)

# Rules of no family. (priority, score, label, keyword, pattern)
OTHERS = (
    (15, 0.9, "public-domain", "public domain", r"(?:dedicated to|released (?:in)?to|placed in|in) the public domain"),
    (15, 0.8, "proprietary", "rights reserved", r"all rights reserved"),
    (15, 0.9, "proprietary", "proprietary", r"proprietary and confidential"),
    (35, 0.6, "permissive-text", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    (35, 0.6, "permissive-text", "as is", r"the software is provided as is without warranty of any kind"),
    (35, 0.6, "bsd", "redistribution", r"redistribution and use in source and binary forms"),
)


@dataclass(frozen=True)
class Rule:
    priority: int
    score: float
    label: str
    keyword: bytes
    pattern: re.Pattern


def rules() -> list[Rule]:
    """Every grant of every family and the strong ones of every short name, in order of priority; a pattern stands between spaces."""
    out = []
    for order, (label, keyword, name, versions) in enumerate(FAMILIES):
        version = rf"(?: (?:version |v)?(?:{'|'.join(sorted(versions, key=len, reverse=True))}))?(?: or later| only)?" if versions else "(?: or later| only)?"
        named = "(?:" + name.replace("bsd {v}clause", f"bsd (?:{'|'.join(versions or ('x',))}) clause").replace("{v}", version) + ")"
        for priority, score, grant in GRANTS:
            pattern = re.compile(b"(?<= )" + grant.replace("{n}", named).encode() + b"(?= )")
            out.append(Rule(priority * 100 + order, score, label, keyword.encode(), pattern))
    for order, (label, keywords, name) in enumerate(SHORT):
        keyword = "|".join(k + v for k in keywords.split("|") for v in ("", *(f"{x}{i}" for x in ("", "v") for i in range(1, 10) if "{s}" in name)))
        named = "(?:" + name.replace("{s}", SHORT_VERSION) + ")"
        for priority, score, grant in GRANTS:
            if priority <= SHORT_GRANTS:  # after the long names of the same grant
                pattern = re.compile(b"(?<= )" + grant.replace("{n}", named).encode() + b"(?= )")
                out.append(Rule(priority * 100 + 50 + order, score, label, keyword.encode(), pattern))
    for order, (priority, score, label, keyword, pattern) in enumerate(OTHERS):
        out.append(Rule(priority * 100 + 90 + order, score, label, keyword.encode(), re.compile(b"(?<= )" + pattern.encode() + b"(?= )")))
    return sorted(out, key=lambda r: r.priority)


@dataclass(frozen=True)
class Detection:
    start: int  # words
    end: int
    label: str
    score: float


class Scanner:
    """The rules by keyword. A text without any keyword between spaces is not matched against a rule at all."""

    def __init__(self):
        self.by_keyword: dict[bytes, list[tuple[int, Rule]]] = {}
        for i, r in enumerate(rules()):
            for keyword in r.keyword.split(b"|"):
                self.by_keyword.setdefault(b" " + keyword + b" ", []).append((i, r))

    def detect(self, folded: bytes, spaces: np.ndarray) -> list[Detection]:
        """Detections in the words between spaces (given their places), in order of their place.

        Rules run in order of priority; a detection inside or across an interval already taken by a rule of lower number is
        suppressed, as is one around it, so the intervals that stand are apart.
        """
        mine = {i: r for k, v in self.by_keyword.items() if k in folded for i, r in v}
        starts, ends, standing = [], [], []
        for _, rule in sorted(mine.items()):
            for m in rule.pattern.finditer(folded):
                a, b = m.span()
                at = bisect_left(starts, b)
                if not at or ends[at - 1] <= a:
                    starts.insert(at, a)
                    ends.insert(at, b)
                    standing.insert(at, rule)
        first = np.searchsorted(spaces, np.array(starts, np.int64)) - 1
        last = np.searchsorted(spaces, np.array(ends, np.int64) + 1) - 1
        return [Detection(i, j, r.label, r.score) for i, j, r in zip(first.tolist(), last.tolist(), standing, strict=True)]

    def base(self, folded: bytes, spaces: np.ndarray) -> tuple[list[int], set[str]]:
        """Starts (words) of all places of the base phrases, and their labels."""
        places, labels = [], set()
        for phrase, label in BASE:
            needle, at = f" {phrase} ".encode(), -1
            while (at := folded.find(needle, at + 1)) >= 0:
                places.append(at)
                labels.add(label)
        return np.searchsorted(spaces, places).tolist(), labels


def scan(docs: DataFrame, with_detections: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (and detections).

    n_base counts the places of the base phrases, first_word and last_word are their smallest and largest start (null if none).
    labels are those of the base phrases and of the surviving detections, score the highest score of either (1 for a base phrase,
    0 for none). Null or empty texts have no words; repeated rows each get a row; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in text_slices(batches, "text"):
            rows = []
            for text in texts(batch):
                words = text.translate(_FOLD).split()
                folded = b" " + b" ".join(words) + b" "
                spaces = np.flatnonzero(np.frombuffer(folded, np.uint8) == 32)
                starts, base = scanner.base(folded, spaces)
                found = scanner.detect(folded, spaces)
                labels = base | {d.label for d in found}
                score = max([1.0 if base else 0.0, *(d.score for d in found)])
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, [vars(d) for d in found]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("score", pa.float64())])))
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
            cols = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            keep = len(names) if with_detections else len(names) - 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols[:keep]], ["doc_id", *names[:keep]])

    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double" + ", detections array<struct<start: int, end: int, label: string, score: double>>" * with_detections)
