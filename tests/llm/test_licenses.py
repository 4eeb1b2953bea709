import re

import numpy as np
import pytest

from corpusgraph.llm import licenses

ODD = [
    (1, None), (2, ""), (3, "Released under the MIT License."), (4, "under the mit LICENSE under-the-mit-license, cc by nc"), (None, "Apache License, Version 2.0"),
    (5, "x " * 50_000 + "CC BY-NC 4.0"), (6, "É under the mit licenseé"), (7, "cc by nc by nc cc by nc"), (8, "nothing"), (8, "nothing"),
]


def spaces(folded):
    return np.flatnonzero(np.frombuffer(folded, np.uint8) == 32)


def test_overlaps_and_long_texts():
    """Detections that stand are apart, also in a text of very many license lines."""
    text = b" " + b"licensed under the mit license subject to the mit license or gpl v3 see the apache license version 2 0 " * 20_000
    found = licenses.Scanner().detect(text, spaces(text))
    assert len(found) >= 60_000 and all(a.end <= b.start for a, b in zip(found, found[1:], strict=False))
    assert {d.label for d in found} >= {"mit", "apache"}


def base_by_hand(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    starts, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def detections_by_hand(text):
    """Every rule without the keyword prefilter."""
    folded = b" " + b" ".join((text or "").encode().translate(licenses._FOLD).split()) + b" "
    kept = []
    for r in licenses.rules():
        for m in r.pattern.finditer(folded):
            if not any(a < m.end() and m.start() < b for a, b, _ in kept):
                kept.append((*m.span(), r.label))
    return sorted({x[2] for x in kept})


def test_hundreds_of_rules():
    assert len(licenses.rules()) > 300


@pytest.mark.parametrize("text, label", [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Licensed under the Apache License, Version 2.0.", "apache"),
    ("SPDX-License-Identifier: CC0-1.0", "cc0"), ("GNU Lesser General Public License v2.1 or later", "lgpl"), ("the BSD 3-Clause License", "bsd"), ("dedicated to the public domain", "public-domain"),
    ("under the Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa"), ("GNU Affero General Public License", "agpl"), ("the man by the sea", ""),
])
def test_labels(text, label):
    folded = b" " + b" ".join(text.encode().translate(licenses._FOLD).split()) + b" "
    found = licenses.Scanner().detect(folded, spaces(folded))
    assert sorted({d.label for d in found}) == ([label] if label else [])
    for d in found:
        assert 0 <= d.start < d.end <= len(folded.split())


def check(rows, got):
    for (doc_id, text), r in zip(rows, got, strict=True):
        assert (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (doc_id, *base_by_hand(text))
        assert r["labels"] == ",".join(sorted({*detections_by_hand(text), *filter(None, r["base_labels"].split(","))}))
        assert 0 <= r["score"] <= 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in ODD], "doc_id long, text string, labels string").coalesce(1)
    check(ODD, licenses.scan(docs, with_detections=True).collect())
    assert licenses.scan(docs.limit(0)).collect() == []


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check([(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()], licenses.scan(docs).orderBy("doc_id").collect())


def test_short_names():
    tags = "AGPL-3.0-only:agpl LGPL-2.1:lgpl GPL-3.0-or-later:gpl Apache-2.0:apache MIT:mit BSD-3-Clause:bsd 0BSD:bsd MPL-2.0:mpl EPL-2.0:epl CDDL-1.0:cddl CC0-1.0:cc0 CC-BY-NC-ND-4.0:cc-by-nc-nd CC-BY-NC-SA-4.0:cc-by-nc-sa CC-BY-NC-4.0:cc-by-nc CC-BY-ND-4.0:cc-by-nd CC-BY-SA-4.0:cc-by-sa CC-BY-4.0:cc-by ISC:isc Zlib:zlib BSL-1.0:boost Artistic-2.0:artistic Unlicense:unlicense WTFPL:wtfpl ODbL-1.0:odbl GFDL-1.3-only:gfdl OFL-1.1:ofl EUPL-1.2:eupl PSF-2.0:psf"
    cases = {f"SPDX-License-Identifier: {t.split(':')[0]}": t.split(":")[1] for t in tags.split()}
    assert {label for label, *_ in licenses.FAMILIES} == set(cases.values())
    cases |= {"released under the GPL v3": "gpl", "released under the GPLv2": "gpl", "licensed under Apache 2.0": "apache", "licensed under the Apache License 2.0": "apache"}
    scanner = licenses.Scanner()
    for text, label in cases.items():
        folded = b" " + b" ".join(text.encode().translate(licenses._FOLD).split()) + b" "
        assert [d.label for d in scanner.detect(folded, spaces(folded))] == [label], text
    assert not scanner.detect(b" he went to mit and saw apache and gpl ", np.arange(0))
