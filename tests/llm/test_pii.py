import hashlib
import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    odd, even = [int(c) for c in d[::-1]][0::2], [int(c) * 2 for c in d[::-1]][1::2]
    return (sum(odd) + sum(x - 9 if x > 9 else x for x in even)) % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab9012345.@+-_ %()é\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_base_spans_of_examples():
    text = "x a.b@c.d_e@f.g 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111-1111 1111 +1 (743) 555-3824, é me@x.org"
    assert pii.base_spans(text) == brute(text)
    assert pii.base_spans("1" * 200000 + " " + "a" * 200000 + "@") == []


def test_terms_that_disclose_an_entity(spark):
    rnd = random.Random(2)
    filler = lambda k: " ".join(f"w{rnd.randint(0, 400)}" for _ in range(k))
    rows = [(i, f"{filler(30)} common common common common. agent Zebulon, bob@corp.example wrote common {filler(9)}") for i in range(8)]
    rows += [(100 + i, f"{filler(20)} common wrote agent {filler(20)}") for i in range(60)]
    rows += [(200, None), (201, ""), (202, "lone@mail.example says hi"), (7, rows[7][1]), (None, "+1 (743) 555-3824"), (300, "x " * 40000 + "a@b.cd")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pii.find_personal_data(df).collect()
    assert len(got) == len(rows)
    texts = {}
    for d, t in rows:
        texts[d] = t
    for r in got:
        base = brute(texts[r.doc_id])
        name = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(name.encode()).hexdigest() and r.spans.startswith(name)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base) for x in pii.KINDS]
        terms = {(texts[r.doc_id] or "")[int(a) : int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k in ("removed", "generalised")}
        if r.doc_id is not None and r.doc_id < 100:
            assert "Zebulon" in terms and "common" not in terms and "wrote" not in terms
        elif r.doc_id in (100, 202, 300, None):
            assert not terms


def test_far_and_long_words_are_terms_and_every_place_is_marked(spark):
    rnd = random.Random(5)
    long = lambda: "x" * 150 + str(rnd.randint(0, 10**6))
    rows = [(i, f"{long()} {long()} secretcode {long()} {long()} {long()} a@b.example {long()} {long()} zebra {long()} then w{i} " + "pad " * 50 + "SecretCode, again") for i in range(6)]
    rows += [(100 + i, f"pad then w{i} word") for i in range(50)] + [(200, "a@b.example " + "pad " * 30 + "zebra"), (201, "zebra")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = dict(rows)
    clean = {r.doc_id: r.text for r in pii.sanitised_corpus(df).collect()}
    for r in pii.find_personal_data(df).collect():
        found = [texts[r.doc_id][int(a) : int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k in ("removed", "generalised")]
        if r.doc_id < 6:
            assert sorted(found) == ["SecretCode", "secretcode", "zebra"]
            assert r.sanitised_sha256 == hashlib.sha256(clean[r.doc_id].encode()).hexdigest()
            assert not any(w in clean[r.doc_id].lower() for w in ("secretcode", "zebra", "a@b")) and "<email>" in clean[r.doc_id]
        else:
            assert found == (["zebra"] if r.doc_id == 200 else [])
    assert clean[201] == "zebra" and clean[100] == texts[100]


def test_disclosing_terms_match_brute_force(spark):
    rnd = random.Random(11)
    people, rows = [f"p{i}@x.example" for i in range(6)], []
    for i in range(150):
        words = [f"t{rnd.randint(0, 60)}" for _ in range(rnd.randint(3, 25))]
        for _ in range(rnd.randint(0, 2)):
            k = rnd.randint(0, 5)
            words[rnd.randint(0, len(words)) : 0] = [f"name{k}"] * rnd.randint(0, 1) + [people[k]]
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    near, holds, has = {}, {}, {}
    for i, t in rows:
        words = t.split()
        free = [w for w in words if "@" not in w]
        for w in set(free):
            holds.setdefault(w, set()).add(i)
        for j, w in enumerate(words):
            if "@" in w:
                has.setdefault(w, set()).add(i)
                at = sum("@" not in x for x in words[:j])
                for x in free[max(0, at - pii.CONTEXT) : at + pii.CONTEXT]:
                    near.setdefault((w, x), set()).add(i)
    want = {}
    for (e, x), docs in near.items():
        pmi, ic = math.log(len(rows) * len(docs) / (len(has[e]) * len(holds[x]))), math.log(len(rows) / len(has[e]))
        if len(docs) >= pii.SUPPORT and pmi >= pii.GENERALISE * ic:
            want[e, x] = "removed" if pmi >= pii.REMOVE * ic else "generalised"
    names = {int(h): x for h, x in zip(pii._hash_terms([*holds, *(f"email:{e}" for e in has)]), [*holds, *has])}
    got = pii.disclosing_terms(pii.scan_entities(df), df).collect()
    assert want and {(names[r.entity], names[r.term]): r.kind for r in got} == want and {r["class"] for r in got} == {"email"}
    for r in pii.find_personal_data(df).collect():
        t = dict(rows)[r.doc_id]
        mine = {x for (e, x) in want if e in t.split()}
        marked = {(int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k in ("removed", "generalised")}
        assert marked == {m.span() for m in re.finditer(r"\S+", t) if m[0] in mine}


def test_counts_of_terms_match_brute_force(spark):
    texts = ["One, two (two) three", "two.", "TWO three", None, "", "four"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    keys = {int(h): t for h, t in zip(pii._hash_terms(["one", "two", "three", "none"]), ["one", "two", "three", "none"])}
    terms = spark.createDataFrame([(k,) for k in keys], "term long")
    got = {keys[r.term]: r.n for r in pii.term_documents(df, terms).collect() if r.term in keys}
    assert got == {"one": 1, "two": 3, "three": 2}


def test_empty_and_clashing_columns(spark):
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a@b.cd", 1, "x")], "doc_id long, text string, row int, base string")
    assert pii.find_personal_data(df).first().n_email == 1
