import random
import re

import pytest

from tidemark.llm import licenses as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in lic.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_matches_brute_force(spark):
    rnd = random.Random(4)
    bits = ["MIT", "License", "license,", "the", "Apache--License", "general", "public", "GENERAL Public license", "é", "x1", "mit license mit license", "apache", "\n", "mit\x00license", "licensed"]
    texts = [None, "", "...", "MIT license", "xmit license", "mit licenses", "mit é license", "amit license mit"] + [rnd.choice([" ", ". ", "\n"]).join(rnd.choice(bits) for _ in range(rnd.randint(1, 60))) for _ in range(150)] + ["mit license " * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in lic.scan(df).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("MIT", {"mit"}, 0.9),
        ("MIT AND GPL-2.0-only", {"mit", "gpl"}, 0.2),
        ("MIT or GPL-2.0-only", {"mit"}, 0.9),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR Apache-2.0", {"apache"}, 0.8),
        ("(MIT OR GPL-2.0) AND (BSD-3-Clause OR AGPL-3.0)", {"mit", "bsd"}, 0.9),
        ("MIT AND (GPL-2.0 OR", {"unparsed"}, 0.1),
        ("LGPL-2.1-or-later WITH foo is the licence", {"lgpl", "exception"}, 0.4),
        ("MIT OR BSD-2-Clause", {"mit", "bsd"}, 0.9),
        ("", {"unparsed"}, 0.1),
    ],
)
def test_expressions(text, labels, score):
    assert lic.evaluate(text) == (labels, score)


def test_tags_in_texts(spark):
    texts = ["# SPDX-License-Identifier: Apache-2.0 OR MIT\nint main;", "é SPDX-License-Identifier: (GPL-2.0 AND MIT)\n MIT license", "All rights reserved."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in lic.scan(df).collect()}
    assert got[0].labels == "mit" and got[0].expressions == "Apache-2.0 or MIT" and got[0].score == 0.9
    assert got[1].labels == "gpl,mit" and got[1].base_labels == "mit" and got[1].score == 0.2
    assert got[2].labels == "proprietary" and got[2].score == 0


def test_empty_and_clashing_columns(spark):
    assert lic.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert lic.scan(spark.createDataFrame([(1, "mit license", "z")], "doc_id long, text string, labels string")).first().labels == "mit"


def test_long_expressions_are_read_to_the_end_of_the_line(spark):
    many = " AND ".join(["Apache-2.0"] * 900)
    texts = [f"SPDX-License-Identifier: ({many} AND GPL-2.0-only)\nMPL", f"x\nSPDX-License-Identifier: {many} AND GPL-2.0-only"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in lic.scan(df).collect():
        assert (r.labels, r.score) == ("apache,gpl", 0.2) and r.expressions.count("Apache") == 900


@pytest.mark.parametrize(
    ("identifier", "read"),
    [
        ("GPL-2.0+", ("gpl", "2.0", "or-later")), ("GPL-2.0-only", ("gpl", "2.0", "only")), ("gpl-3.0-or-later", ("gpl", "3.0", "or-later")), ("GPLv3+", ("gpl", "3", "or-later")),
        ("CC-BY-4.0", ("cc-by", "4.0", "")), ("CC-BY-NC-4.0", ("cc-by-nc", "4.0", "")), ("CC-BY-ND-3.0", ("cc-by-nd", "3.0", "")), ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd", "4.0", "")), ("CC-BY-SA-4.0", ("cc-by-sa", "4.0", "")),
        ("MIT", ("mit", "", "")), ("MITNFA", ("other", "", "")), ("MIT-0", ("public-domain", "", "")), ("ISC", ("isc", "", "")), ("EPL-2.0", ("epl", "2.0", "")), ("Zlib", ("zlib", "", "")), ("EUPL-1.2", ("eupl", "1.2", "")),
        ("BSD-3-Clause", ("bsd", "", "")), ("0BSD", ("bsd", "", "")), ("X11", ("mit", "", "")), ("CC0-1.0", ("public-domain", "1.0", "")), ("BUSL-1.1", ("busl", "1.1", "")), ("BSL-1.0", ("boost", "1.0", "")),
        ("LicenseRef-house", ("proprietary", "", "")), ("DocumentRef-x:LicenseRef-y", ("proprietary", "", "")), ("2.0", ("other", "", "")), ("Foo-1.0", ("other", "1.0", "")),
    ],
)
def test_identifiers(identifier, read):
    assert lic.read_identifier(identifier) == read


def test_every_label_has_a_value():
    assert {*lic.BASE.values(), *lic.NOTICES.values(), *lic.FAMILIES, "other", "unparsed", "exception"} == set(lic.FREEDOM)


def test_the_longer_notice_counts(spark):
    texts = ["Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution 4.0", "GNU Lesser General Public License", "SPDX-License-Identifier: GPL-2.0+ OR (MIT AND ISC)", "Creative Commons Attribution. creative commons attribution noderivs"]
    got = {r.doc_id: r for r in lic.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(5)] == ["cc-by-nc", "cc-by", "gpl,lgpl", "isc,mit", "cc-by,cc-by-nd"]
    assert got[3].grants == "gpl 2.0 or-later,isc,mit" and got[0].grants == "" and got[0].score == 0.2
    assert (got[2].n_base, got[2].first_word) == (1, 2)
