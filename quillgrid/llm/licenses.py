"""Licence scan: Aho-Corasick over word-normalised text, shunting-yard over licence expressions.

Texts are lower-cased (A-Z only) and reduced to words ``[0-9a-z]`` and
non-ASCII characters joined by one space. One automaton holds base phrases,
notice phrases and the identifier tag. Where the tag occurs, the expressions
that follow it in the raw text are parsed with a shunting-yard parser and
evaluated: OR takes the least restrictive side, AND the most restrictive,
WITH relaxes its licence by one step. Words after the tag that name no licence
are no labels.

Null and empty texts give zero counts, null positions, empty labels and score
0; very long texts are scanned whole. Repeated rows are scanned each on their own; an empty table gives an empty
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.kernels import TO_WORDS

BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "the unlicense": "unlicense",
    "all rights reserved": "proprietary",
}
TAG_PHRASE = "spdx license identifier"
_TAG = re.compile(rb"(?i)spdx-license-identifier\s*:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")

#: 0 free, 1 attribution, 2 weak copyleft, 3 copyleft, 4 restricted use, 5 unknown or proprietary.
RESTRICTION = {
    "cc0": 0, "public-domain": 0, "unlicense": 0, "0bsd": 0,
    "mit": 1, "apache": 1, "bsd": 1, "isc": 1, "bsl": 1, "zlib": 1, "cc-by": 1,
    "lgpl": 2, "mpl": 2, "epl": 2,
    "gpl": 3, "agpl": 3, "cc-by-sa": 3,
    "cc-by-nc": 4, "cc-by-nd": 4, "cc-by-nc-sa": 4, "cc-by-nc-nd": 4,
    "wtfpl": 0, "mit-0": 0, "cc-pddc": 0, "blessing": 0, "pddl": 0,
    "afl": 1, "artistic": 1, "beerware": 1, "curl": 1, "ftl": 1, "hpnd": 1, "icu": 1, "ijg": 1, "json": 1, "libpng": 1, "ncsa": 1, "ntp": 1, "ofl": 1, "openssl": 1,
    "php": 1, "postgresql": 1, "psf": 1, "python": 1, "ruby": 1, "tcl": 1, "unicode": 1, "unicode-dfs": 1, "upl": 1, "vim": 1, "w3c": 1, "x11": 1, "zpl": 1, "ecl": 1, "ms-pl": 1, "odc-by": 1,
    "apsl": 2, "cddl": 2, "cecill-c": 2, "cpl": 2, "ipl": 2, "lppl": 2, "ms-rl": 2, "nposl": 2, "spl": 2,
    "cecill": 3, "eupl": 3, "gfdl": 3, "odbl": 3, "osl": 3, "qpl": 3, "rpl": 3, "sleepycat": 3, "cc-by-nc-sa-igo": 4,
    "busl": 5, "elastic": 5, "sspl": 5,
}
#: A document's own licences, and the two names that say there is none, which are no labels.
_OWN = re.compile(r"(?i)(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+|none|noassertion")
_NO_LICENCE = ("none", "noassertion")
_PRIORITY = {"OR": 1, "AND": 2, "WITH": 3}
#: Weight of one piece of evidence by kind; the score is 1 - prod(1 - weight).
EVIDENCE = {"tag": 0.9, "base": 0.6, "notice": 0.5}


def family(identifier: str) -> str:
    """Label of a licence identifier: its name without version and suffixes."""
    name = identifier.lower().rstrip("+").removesuffix("-only").removesuffix("-or-later")
    if name.startswith("cc-"):
        return re.sub(r"-\d.*$", "", name)
    if name in RESTRICTION:
        return name
    head = re.match(r"(agpl|lgpl|gpl|apache|bsd|mpl|epl|bsl|zlib|isc|mit)(?![a-z])", name)
    return head[1] if head else re.sub(r"-\d[\d.]*[a-z]?(-[a-z0-9-]+)?$", "", name)


def is_identifier(token: str) -> bool:
    """Whether a token names a licence: one of the known families, or a document's own (LicenseRef-)."""
    return family(token) in RESTRICTION or _OWN.fullmatch(token) is not None


def to_rpn(text: str) -> list[str]:
    """Shunting-yard: the longest valid expression at the start of ``text`` in postfix order; [] if there is none.

    Operands are licence identifiers, after WITH names of exceptions; any other word ends the expression.
    """
    tokens: list[str] = []
    depth, operand = 0, True
    best = 0
    for token in _TOKEN.findall(text):
        word = token.upper()
        if token == "(":
            if not operand:
                break
            depth += 1
        elif token == ")":
            if operand or not depth:
                break
            depth -= 1
        elif word in _PRIORITY:
            if operand:
                break
            operand = True
            tokens.append(word)
            continue
        else:
            exception = tokens[-1:] == ["WITH"]
            if not operand or not ("exception" in token.lower() if exception else is_identifier(token)):
                break
            operand = False
        tokens.append(token)
        if not depth and not operand:
            best = len(tokens)
    out: list[str] = []
    stack: list[str] = []
    for token in tokens[:best]:
        if token == "(":
            stack.append(token)
        elif token == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif token in _PRIORITY:
            while stack and stack[-1] != "(" and _PRIORITY[stack[-1]] >= _PRIORITY[token]:
                out.append(stack.pop())
            stack.append(token)
        else:
            out.append(token)
    return out + stack[::-1]


def evaluate(rpn: list[str]) -> tuple[frozenset[str], int] | None:
    """(labels named, restriction) of a postfix expression."""
    stack: list[tuple[frozenset[str], int]] = []
    for token in rpn:
        if token == "WITH":
            _, (labels, level) = stack.pop(), stack.pop()
            stack.append((labels, level - 1 if 2 <= level <= 3 else level))
        elif token in _PRIORITY:
            b, a = stack.pop(), stack.pop()
            stack.append((a[0] | b[0], (max if token == "AND" else min)(a[1], b[1])))
        else:
            label = family(token)
            stack.append((frozenset() if label in _NO_LICENCE else frozenset([label]), RESTRICTION.get(label, 5)))
    return stack[0] if stack else None


@lru_cache(maxsize=4)
def _automaton(extra: tuple[tuple[str, str], ...] = ()) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    entries = {p: ("notice", label) for p, label in (NOTICE_PHRASES | dict(extra)).items()}
    entries |= {p: ("base", label) for p, label in BASE_PHRASES.items()} | {TAG_PHRASE: ("tag", "")}
    for phrase, (kind, label) in entries.items():
        key = f" {phrase} ".encode().decode("latin-1")
        found.add_word(key, (kind, label, len(key)))
    found.make_automaton()
    return found


def scan_text(raw: bytes | None, extra: tuple[tuple[str, str], ...] = ()) -> dict:
    words = (raw or b"").translate(TO_WORDS).split()
    # One character a byte, so that offsets are cheap; non-ASCII bytes are parts of words.
    text = " " + b" ".join(words).decode("latin-1") + " "
    hits = [(end - size + 1, end, kind, label) for end, (kind, label, size) in _automaton(extra).iter(text)]
    base = [(at, label) for at, _, kind, label in hits if kind == "base"]
    tagged = any(kind == "tag" for _, _, kind, _ in hits)
    notices, reach = [], 0
    # A notice inside a longer notice says less than that one: from the left, longest first, such a notice ends within what came before.
    for at, end, label in sorted(((at, end, label) for at, end, kind, label in hits if kind == "notice"), key=lambda x: (x[0], -x[1])):
        if end > reach:
            notices.append((at, end, label))
            reach = end
    expressions = []
    if tagged:
        for m in _TAG.finditer(raw):
            rpn = to_rpn(m[1].decode("utf-8", "replace"))
            if (value := evaluate(rpn)) is not None:
                expressions.append((" ".join(rpn), *value))
    labels = {x for _, x in base} | {x[-1] for x in notices}
    for _, named, _ in expressions:
        labels |= named
    doubt = 1.0
    for kind, n in (("base", len(base)), ("notice", len(notices)), ("tag", len(expressions))):
        doubt *= (1 - EVIDENCE[kind]) ** n
    levels = [x[2] for x in expressions] + [RESTRICTION.get(x, 5) for _, x in base] + [RESTRICTION.get(x[-1], 5) for x in notices]
    places = [text.count(" ", 0, at) for at, _ in (base[0], max(base), min(base))] if base else None
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min(places) if places else None,
        "last_word": max(places) if places else None,
        "base_labels": ",".join(sorted({x for _, x in base})),
        "labels": ",".join(sorted(labels)),
        "score": 1.0 - doubt,
        "expressions": [x[0] for x in expressions],
        "restriction": max(levels) if levels else None,
    }


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, restriction int"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("restriction", pa.int32()),
])


def scan(docs: DataFrame, extra_phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text). ``extra_phrases`` adds notice phrases (words in lower case) and their labels.

    ``expressions`` holds the tag's expressions in postfix order and
    ``restriction`` the strictest level that all evidence together demands.
    """
    extra = tuple(sorted((extra_phrases or {}).items()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            rows = [scan_text(t.as_py(), extra) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[f.name] for r in rows], f.type) for f in list(_ARROW)[1:])], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, SCHEMA)
