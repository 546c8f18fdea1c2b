"""Licence scans: Aho-Corasick for phrases and identifier tags, shunting-yard for expressions.

A text is lower-cased and its words set one space apart; one automaton finds notice phrases and
identifier tags in it. What follows a tag is read from the text itself as a licence expression:
identifiers joined by WITH, AND, OR (in falling precedence) and parentheses. It is brought to
postfix order by a shunting-yard and evaluated: AND takes the labels of both sides and the lower
permissiveness, OR the labels of the freer side (of both if they are as free), WITH keeps the
left side and adds "exception". An expression that cannot be read gives the label "unparsed".
Identifiers are read as family, version and grant (`grants` lists them: "gpl 2.0 or-later"); variants that forbid
commercial use or changes have labels of their own.

score is the permissiveness of all that was found together (the least), 0 where nothing was.

Nulls: a null text is empty and gives zeros, nulls and empty strings. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.textkit import LOWER, Words, map_batches, pieces

# Phrases of the contract, by label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notices, by label. Of two that begin at the same word the longer one counts.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "zlib license": "zlib",
    "this software is provided as is without any express or implied warranty": "zlib",
    "boost software license": "boost",
    "python software foundation license": "python",
    "artistic license": "artistic",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "european union public license": "eupl",
    "common development and distribution license": "cddl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "free documentation license": "gfdl",
    "open font license": "ofl",
    "open database license": "odbl",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noderivs": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "creative commons attribution noncommercial noderivs": "cc-by-nc-nd",
    "creative commons zero": "public-domain",
    "this is free and unencumbered software released into the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "server side public license": "sspl",
    "business source license": "busl",
    "all rights reserved": "proprietary",
}
# Permissiveness of labels, 1 without conditions, 0 without rights.
FREEDOM = {
    "public-domain": 1.0, "exception": 1.0,
    "mit": 0.9, "bsd": 0.9, "isc": 0.9, "zlib": 0.9, "boost": 0.9, "python": 0.8, "apache": 0.8, "artistic": 0.7, "cc-by": 0.7, "ofl": 0.7,
    "mpl": 0.5, "epl": 0.5, "cddl": 0.5, "other": 0.5, "lgpl": 0.4, "eupl": 0.4, "cc-by-sa": 0.4, "odbl": 0.4, "gfdl": 0.3,
    "cc-by-nc": 0.2, "cc-by-nd": 0.2, "gpl": 0.2, "cc-by-nc-sa": 0.15, "cc-by-nc-nd": 0.1, "agpl": 0.1, "sspl": 0.1, "busl": 0.1, "unparsed": 0.1,
    "proprietary": 0.0,
}
# Families of the public identifier list, by label. An identifier belongs to the longest family
# that is all of it or is followed by a hyphen, once its version and what it grants are taken off.
FAMILIES = {
    "mit": ("mit", "x11", "expat"),
    "bsd": ("bsd", "0bsd", "ncsa", "postgresql"),
    "isc": ("isc",),
    "zlib": ("zlib", "libpng", "zlib-acknowledgement"),
    "boost": ("bsl", "boost"),
    "python": ("psf", "python", "cnri-python"),
    "apache": ("apache", "ecl"),
    "artistic": ("artistic", "afl"),
    "mpl": ("mpl", "ms-pl", "ms-rl"),
    "epl": ("epl", "cpl", "ipl"),
    "eupl": ("eupl", "osl"),
    "cddl": ("cddl",),
    "lgpl": ("lgpl", "lgpllr"),
    "gpl": ("gpl", "cecill"),
    "agpl": ("agpl",),
    "gfdl": ("gfdl",),
    "ofl": ("ofl",),
    "odbl": ("odbl",),
    "cc-by": ("cc-by", "odc-by"),
    "cc-by-sa": ("cc-by-sa",),
    "cc-by-nd": ("cc-by-nd",),
    "cc-by-nc": ("cc-by-nc", "polyform-noncommercial"),
    "cc-by-nc-sa": ("cc-by-nc-sa",),
    "cc-by-nc-nd": ("cc-by-nc-nd",),
    "public-domain": ("cc0", "unlicense", "pddl", "wtfpl", "mit-0", "cc-pddc"),
    "sspl": ("sspl",),
    "busl": ("busl", "elastic"),
    "proprietary": ("licenseref", "documentref", "none"),
}
LABELS = {family: label for label, families in FAMILIES.items() for family in families}
TAG = "spdx license identifier"

NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def tokens_of(text: str) -> list[str]:
    """Tokens of the expression at the start of text, as far as it reads as one."""
    out: list[str] = []
    depth, operand, at = 0, False, 0
    while m := _TOKEN.match(text, at):
        t = m[1]
        word = t.lower()
        if word in PRECEDENCE:
            if not operand:
                break
            operand = False
        elif t == "(":
            if operand:
                break
            depth += 1
        elif t == ")":
            if not operand or not depth:
                break
            depth -= 1
        else:
            if operand:
                break
            operand = True
        out.append(word if word in PRECEDENCE else t)
        at = m.end()
    return out


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard; None for an expression that does not balance."""
    out, stack, operand = [], [], False
    for t in tokens:
        if t in PRECEDENCE:
            if not operand:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = False
        elif t == "(":
            stack.append(t)
        elif t == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            out.append(t)
            operand = True
    while stack:
        if stack[-1] == "(":
            return None
        out.append(stack.pop())
    return out if operand else None


_GRANT = re.compile(r"(-only|-or-later|\+)$")
_VERSION = re.compile(r"(?:-?v|-)?(\d+(?:\.\d+)*)$")


def read_identifier(identifier: str) -> tuple[str, str, str]:
    """(label, version, grant) of an identifier: GPL-2.0+ is gpl, 2.0, or-later."""
    name = identifier.lower()
    m = _GRANT.search(name)
    grant = {"-only": "only", None: ""}.get(m and m[1], "or-later")
    name = name[: m.start()] if m else name
    version = ""
    if name not in LABELS and (m := _VERSION.search(name)) and m.start():
        name, version = name[: m.start()], m[1]
    parts = name.replace(":", "-").split("-")
    label = next((LABELS[f] for n in range(len(parts), 0, -1) if (f := "-".join(parts[:n])) in LABELS), "other")
    return label, version, grant


def label_of(identifier: str) -> str:
    return read_identifier(identifier)[0]


def evaluate(expression: str) -> tuple[set[str], float]:
    """Labels and permissiveness of an expression."""
    order = postfix(tokens_of(expression))
    if not order:
        return {"unparsed"}, FREEDOM["unparsed"]
    stack: list[tuple[set[str], float]] = []
    for t in order:
        if t not in PRECEDENCE:
            label = label_of(t)
            stack.append(({label}, FREEDOM[label]))
            continue
        if len(stack) < 2:
            return {"unparsed"}, FREEDOM["unparsed"]
        b, a = stack.pop(), stack.pop()
        if t == "and":
            stack.append((a[0] | b[0], min(a[1], b[1])))
        elif t == "with":
            stack.append((a[0] | {"exception"}, a[1]))
        else:
            stack.append((a[0] | b[0], a[1]) if a[1] == b[1] else max(a, b, key=lambda x: x[1]))
    return stack[0]


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    phrases = {**{p: ("base", label) for p, label in BASE.items()}, TAG: ("tag", "")}
    for phrase, label in NOTICES.items():
        phrases.setdefault(phrase, ("notice", label))
    for phrase, what in phrases.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, *what))
    found.make_automaton()
    return found


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, grants string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for piece in pieces(batch.column("text")):
                words = Words(piece, NOT_WORD)
                inside = ~NOT_WORD[piece.data]
                low = np.where(inside, LOWER[piece.data], 32).astype(np.uint8)
                keep = inside.copy()  # of a run of separators, the one after a word stays
                keep[1:] |= inside[:-1]
                kept = np.concatenate([[0], np.cumsum(keep)])
                squeezed = low[keep]
                for i in range(len(piece)):
                    a, b = piece.offsets[i], piece.offsets[i + 1]
                    flat = squeezed[kept[a] : kept[b]].tobytes().decode("latin-1").strip(" ")
                    line = f" {flat} "
                    places, base, labels, free, read = [], set(), set(), 1.0, []
                    seen, word, raw, noticed, grants = 0, -1, b"", -1, set()
                    for start, _, (what, label) in sorted((end - size + 1, -size, hit) for end, (size, *hit) in automaton.iter(line)):
                        if what == "notice":
                            if start == noticed:
                                continue  # the beginning of a longer one
                            noticed = start
                        word += line.count(" ", seen, start + 1)
                        seen = start + 1
                        if what == "base":
                            places.append(word)
                            base.add(label)
                        if what == "tag":
                            after = words.ends[words.first[i] + word + TAG.count(" ")]
                            raw = raw or piece.data[a:b].tobytes()
                            stop = raw.find(b"\n", after - a)
                            expression = raw[after - a : stop if stop >= 0 else None].decode("utf-8", "replace").lstrip(": \t")
                            more, value = evaluate(expression)
                            labels |= more
                            free = min(free, value)
                            tokens = tokens_of(expression)
                            read.append(" ".join(tokens))
                            grants |= {" ".join(filter(None, read_identifier(t))) for t in tokens if t not in PRECEDENCE and t not in "()"}
                        else:
                            labels.add(label)
                            free = min(free, FREEDOM[label])
                    for c, v in zip(out, (int(words.counts[i]), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), free if labels else 0.0, "; ".join(read), ",".join(sorted(grants))), strict=True):
                        c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "grants"])

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].alias("text")), run, schema)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 over documents; nulls, ties and empty tables as the module says."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
