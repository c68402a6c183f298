import random
import re
import time

import pytest

from wardspan.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    out = []
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(out)


def test_places_are_like_a_search_word_by_word():
    scan, rng = licenses.scanner(), random.Random(3)
    for _ in range(4000):
        text = " ".join(rng.choice(["MIT", "License", "gnu", "general", "public", "é", "apache", "cc", "by", "-", "x", "İ"]) for _ in range(rng.randrange(14)))
        n, found, _ = scan(text)
        assert (n, sorted((p["word"], p["label"]) for p in found if p["sort"] == "base")) == plain(text)


@pytest.mark.parametrize(
    "text, met, names",
    [
        ("MIT", True, ["mit"]), ("GPL-2.0-only OR MIT", True, ["gpl-2.0-only", "mit"]), ("GPL-2.0-only AND MIT", False, ["gpl-2.0-only", "mit"]),
        ("MIT AND (GPL-2.0-only OR ISC)", True, ["gpl-2.0-only", "isc", "mit"]), ("GPL-2.0-only WITH Classpath-exception-2.0", False, ["gpl-2.0-only"]),
        ("MIT OR GPL-2.0-only AND GPL-3.0-only", True, ["gpl-2.0-only", "gpl-3.0-only", "mit"]), ("Apache-2.0 */ int x;", True, ["apache-2.0"]),
    ],
)
def test_expressions(text, met, names):
    assert licenses.evaluate(licenses.postfix(text)) == (met, names)


@pytest.mark.parametrize("text", ["", "AND", "MIT OR", "(MIT", "WITH x"])
def test_broken_expressions(text):
    with pytest.raises(ValueError):
        licenses.postfix(text)


def test_many_tags_take_linear_time():
    scan = licenses.scanner()
    line = "// SPDX-License-Identifier: MIT OR GPL-2.0-only"
    for text in ("\n".join([line] * 100_000), " ".join([line] * 100_000), "SPDX-License-Identifier: " * 100_000, "SPDX-License-Identifier: (" * 100_000):
        began = time.process_time()
        n, found, accepted = scan(text)
        assert time.process_time() - began < 5
        if line in text:
            assert len(found) == 200_000 and accepted is True and found[-1]["word"] == n - 9 and n == len(WORD.findall(text.lower()))


def test_labels_of_tags_are_licences():
    scan = licenses.scanner()
    labels = lambda t: sorted({p["label"] for p in scan(t)[1] if p["sort"] == "tag"})
    assert labels("SPDX-License-Identifier: hello") == [] and labels("xSPDX-License-Identifier: MIT") == []
    assert labels("a SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0 OR LicenseRef-own") == ["gpl-2.0+", "licenseref-own"]
    assert [p["word"] for p in scan("é x SPDX-License-Identifier: MIT\rb SPDX-License-Identifier:ISC")[1] if p["sort"] == "tag"] == [2, 7]


def test_rows(spark):
    df = spark.createDataFrame([(1, "/* SPDX-License-Identifier: MIT OR GPL-2.0-only */ the MIT  license", 0), (2, None, 0), (3, "", 0), (3, "", 0)], "doc_id long, text string, places int")
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert sorted(p["label"] for p in rows[1]["places"]) == ["gpl-2.0-only", "mit", "mit"] and rows[1]["accepted"] is True
    assert rows[2]["n_words"] == 0 and rows[2]["places"] == [] and rows[3]["accepted"] is None
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_query(spark, small):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in licenses.op4_licenses(spark, small).collect():
        n, places = plain(texts[r["doc_id"]])
        at = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and 0 <= r["score"] <= 1


def labels_of(tag):
    _, places, accepted = licenses.scanner()(f"{licenses.TAG} {tag}")
    return {p["label"] for p in places if p["sort"] == "tag"}, accepted


def test_every_listed_identifier_is_found_and_no_other():
    for name in licenses.KNOWN:
        assert labels_of(name.upper())[0] == {name}, name
    assert labels_of("GPL-2.0+")[0] == {"gpl-2.0+"} and labels_of("LicenseRef-own.1")[0] == {"licenseref-own.1"}
    for name in ("BlueOak-1.0.0", "curl", "CECILL-2.1", "JSON", "CC-BY-NC-SA-4.0", "LGPL-2.1-or-later"):
        assert labels_of(name)[0] == {name.lower()}
    for name in ("mit-hello", "apache-9.9", "BSD-3-Clause-whatever-x", "gpl-2.0-later", "cc-by-5.0", "mit+0", "licenseref-"):
        assert labels_of(name)[0] == set(), name
    assert labels_of("curl AND mit-hello") == ({"curl"}, False)


def test_exceptions_after_with_are_known_ones(tmp_path):
    assert labels_of("Apache-2.0 WITH LLVM-exception") == ({"apache-2.0"}, True)
    assert labels_of("Apache-2.0 WITH some-exception") == ({"apache-2.0"}, False)
    assert labels_of("Apache-2.0 WITH some-exception OR MIT") == ({"apache-2.0", "mit"}, True)
    (tmp_path / "names").write_text("My-Licence-1.0\n\nother\n")
    assert {"my-licence-1.0", "other", "mit"} <= licenses.identifiers(str(tmp_path / "names"))


def test_notice_phrases():
    scan = licenses.scanner()
    for phrase, label in licenses.OWN_PHRASES.items():
        assert label in {p["label"] for p in scan(f"xx {phrase.upper()}, yy")[1]}, phrase
    assert {p["label"] for p in scan("Creative Commons Attribution-ShareAlike 4.0")[1]} == {"cc-by", "cc-by-sa"}
