"""Licence scan: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser reads the expressions behind tags."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from bidlens.llm.common import documents, rows_of

# Phrases whose places are counted, and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Further notices, in words, and the SPDX identifiers they stand for.
NOTICE_PHRASES = {
    "mit license": "MIT",
    "permission is hereby granted free of charge": "MIT",
    "apache license version 2 0": "Apache-2.0",
    "apache license 2 0": "Apache-2.0",
    "gnu general public license version 2": "GPL-2.0",
    "gnu general public license version 3": "GPL-3.0",
    "gnu lesser general public license": "LGPL",
    "gnu affero general public license": "AGPL-3.0",
    "mozilla public license": "MPL-2.0",
    "eclipse public license": "EPL-2.0",
    "bsd 2 clause": "BSD-2-Clause",
    "bsd 3 clause": "BSD-3-Clause",
    "redistribution and use in source and binary forms": "BSD-3-Clause",
    "isc license": "ISC",
    "boost software license": "BSL-1.0",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "cc0 1 0 universal": "CC0-1.0",
    "cc by 4 0": "CC-BY-4.0",
    "cc by sa 4 0": "CC-BY-SA-4.0",
    "cc by nc 4 0": "CC-BY-NC-4.0",
    "cc by nd 4 0": "CC-BY-ND-4.0",
    "cc by nc sa 4 0": "CC-BY-NC-SA-4.0",
    "all rights reserved": "LicenseRef-all-rights-reserved",
}

# Words of the tags that an expression follows.
TAG_PHRASES = ["spdx license identifier", "license expression"]
_TAG = re.compile(r"(?:spdx-license-identifier|license-expression)[ \t]*[:=][ \t]*", re.IGNORECASE)
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*)")

# How freely texts under a licence may be used; identifiers are compared in lower case.
PERMISSION = {
    "cc0-1.0": 1.0, "unlicense": 1.0, "mit": 1.0, "isc": 1.0, "bsd-2-clause": 1.0, "bsd-3-clause": 1.0,
    "bsl-1.0": 1.0, "apache-2.0": 1.0, "apache": 1.0, "cc-by-4.0": 0.9, "mpl-2.0": 0.6, "epl-2.0": 0.6,
    "lgpl": 0.5, "cc-by-sa-4.0": 0.5, "gpl": 0.3, "gpl-2.0": 0.3, "gpl-3.0": 0.3, "agpl-3.0": 0.2,
    "cc-by-nd-4.0": 0.1, "cc-by-nc-4.0": 0.1, "cc-by-nc-sa-4.0": 0.1, "licenseref-all-rights-reserved": 0.0,
}
UNKNOWN_PERMISSION = 0.2
WITH_EXCEPTION = 0.1
_RANK = {"OR": 1, "AND": 2, "WITH": 3}

# ASCII other than digits and letters parts words; A-Z become a-z.
_WORDS = bytes(
    32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 65 <= b <= 90 else b
    for b in range(256)
)
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, expressions array<string>"
)


def expression_tokens(text: str, at: int) -> list[str]:
    """The longest start of ``text[at:]`` that can begin an expression, up to the line's end."""
    tokens, open_, operand = [], 0, False
    while found := _TOKEN.match(text, at):
        token = found[1]
        operator = token.upper() in _RANK
        if operand and not (operator or token == ")") or not operand and (operator or token == ")") or token == ")" and not open_:
            break
        open_ += (token == "(") - (token == ")")
        operand = not operator and token != "("
        tokens.append(token.upper() if operator else token)
        at = found.end()
    while tokens and tokens[-1] in (*_RANK, "("):
        tokens.pop()
    return tokens


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: WITH binds before AND before OR; parentheses left open close at the end."""
    out, waiting = [], []
    for token in tokens:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if waiting:
                waiting.pop()
        elif token in _RANK:
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[token]:
                out.append(waiting.pop())
            waiting.append(token)
        else:
            out.append(token)
    return out + [t for t in reversed(waiting) if t != "("]


def evaluate(postfix: list[str]) -> tuple[float, set[str]]:
    """(permission, identifiers): OR lets the reader choose, AND asks for both, WITH adds an exception."""
    stack: list[tuple[float, set[str]]] = []
    for token in postfix:
        if token not in _RANK:
            stack.append((PERMISSION.get(license_name(token), UNKNOWN_PERMISSION), {license_name(token)}))
            continue
        if len(stack) < 2:
            break
        (b, names_b), (a, names_a) = stack.pop(), stack.pop()
        if token == "WITH":
            stack.append((min(1.0, a + WITH_EXCEPTION), names_a))
        else:
            # The smaller set goes into the larger one, so a long expression costs little more than its length.
            few, many = sorted((names_a, names_b), key=len)
            many |= few
            stack.append(((max if token == "OR" else min)(a, b), many))
    return min((s for s, _ in stack), default=0.0), set().union(*(names for _, names in stack))


def license_name(token: str) -> str:
    """Identifier in lower case, without "only", "or-later" and "+"."""
    return re.sub(r"(-only|-or-later|\+)$", "", token.lower())


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICE_PHRASES, *TAG_PHRASES}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan_text(text: str, phrases: ahocorasick.Automaton) -> tuple:
    words = text.encode().translate(_WORDS).split()
    joined = (b" " + b" ".join(words) + b" ").decode()
    base, labels, scores, tagged = [], set(), [], False
    # Hits come by their ends, so the words before an end are counted on from the hit before.
    n_before, counted = 0, 0
    for end, phrase in phrases.iter(joined):
        if phrase in BASE_PHRASES:
            n_before, counted = n_before + joined.count(" ", counted, end), end
            base.append((n_before - phrase.count(" ") - 1, BASE_PHRASES[phrase]))
        if phrase in NOTICE_PHRASES:
            labels.add(NOTICE_PHRASES[phrase].lower())
        tagged |= phrase in TAG_PHRASES
    expressions = []
    if tagged:
        for tag in _TAG.finditer(text):
            if tokens := expression_tokens(text, tag.end()):
                score, names = evaluate(to_postfix(tokens))
                expressions.append(" ".join(tokens))
                labels.update(names)
                scores.append(score)
    base_labels = {name for _, name in base}
    named_by_tag = {n for e in expressions for n in map(license_name, e.replace("(", " ").replace(")", " ").split())}
    scores += [PERMISSION.get(n, UNKNOWN_PERMISSION) for n in (labels | base_labels) - named_by_tag]
    starts = [k for k, _ in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)),
        ",".join(sorted(labels | base_labels)), min(scores, default=0.0), expressions,
    )


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence notices and expressions of every whole text, one row per input row.

    Words are runs of digits, a-z (A-Z lowered) and all non-ASCII characters. ``n_base``
    counts the places of the base phrases, ``first_word`` and ``last_word`` are the
    smallest and largest word number at which one starts (null without any).
    ``base_labels`` are theirs; ``labels`` adds the identifiers of further notices and of
    tagged expressions. ``expressions`` are the tagged expressions in order. ``score`` is
    how freely the text may be used: the lowest of all notices and evaluated expressions,
    0 without any. Null and empty texts have no words and no labels; repeated rows are
    read each; a broken expression counts up to where it breaks. Very long texts are read
    whole, in time that grows with their length; an empty table gives an empty one; further
    columns, whatever their names, are left behind.
    """

    def scan(batches):
        phrases = automaton()
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        for ids, texts in rows_of(batches):
            rows = [(i, *scan_text(t, phrases)) for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types[:5] + [pa.string()] * 2 + types[7:])], names=names)

    return documents(docs, id_col, text_col).mapInArrow(scan, SCHEMA)
