r"""Operator 2: licence scan.

A text's ASCII letters are lower-cased and its words (runs of other code
points than ASCII punctuation, white space and controls) joined by one space.
An Aho-Corasick automaton over space-delimited phrases finds every notice
phrase and identifier tag in one pass, overlapping ones too. Behind an
identifier tag the licence expression of the raw line is read and evaluated by
a shunting-yard parser: ``with`` binds before ``and`` before ``or``.

An expression is evaluated on its postfix form, in one pass over its tokens:
``allowed`` tells whether the ``accept``ed licences are enough for all of a
text's expressions (null without any), and ``expressions`` has them in factored
form (equal operands once, in order; ``c or b and a`` gives ``(a and b) or c``),
which is never longer than what was read. Its labels are all licences named. The
score is 1 - prod(1 - weight) over the distinct labels found,
the weights being how sure a phrase speaks of a licence.

Very long texts are scanned whole; phrases that start or end together all
count. Defined cases: an empty table gives an empty result; a null or empty text has no words, null positions, empty label
lists and score 0; an unreadable expression counts as an identifier without
licences; repeated rows give repeated results; extra columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ticketlake.llm import common as C

# The contract's phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notice phrases of the method: label and weight.
NOTICES = {
    "apache license": ("apache", 0.9), "mit license": ("mit", 0.9), "bsd license": ("bsd", 0.9),
    "mozilla public license": ("mpl", 0.9), "eclipse public license": ("epl", 0.9),
    "lesser general public license": ("lgpl", 0.95), "affero general public license": ("agpl", 0.95),
    "cc by nc": ("cc-by-nc", 0.95), "cc by sa": ("cc-by-sa", 0.95), "cc by nd": ("cc-by-nd", 0.95),
    "creative commons": ("cc", 0.7), "public domain": ("public-domain", 0.5), "cc0": ("cc0", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "licensed under": ("notice", 0.4), "copyright": ("copyright", 0.2),
}
BASE_WEIGHT = {"cc-by": 0.9, "gpl": 0.9, "reserved": 0.8}
TAG = "spdx license identifier"
TAG_LINE = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.I)
TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.+:_-]+)")
RANK = {"or": 1, "and": 2, "with": 3}
SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, expressions string, allowed boolean")
#: licences that ``allowed`` accepts by default
ACCEPT = frozenset(["mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "cc0-1.0", "cc-by-4.0"])


def parse(line: str) -> list[str] | None:
    """Postfix tokens of the expression that a line starts with, or None."""
    out, ops, pos, operand = [], [], 0, True
    while m := TOKEN.match(line, pos):
        tok, low = m[1], m[1].lower()
        if low in RANK and not operand:
            while ops and ops[-1] != "(" and RANK[ops[-1]] >= RANK[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        elif tok == "(" and operand:
            ops.append(tok)
        elif tok == ")" and not operand and "(" in ops:
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        elif operand and tok not in "()" and low not in RANK:
            out.append(low)
            operand = False
        else:
            break
        pos = m.end()
    if operand or "(" in ops:
        return None
    return out + ops[::-1]


def factored(postfix: list[str]) -> str:
    """The expression as text: operands of equal operators in one list, repeated ones
    once, in order, an inner list in parentheses. Its length is at most the
    postfix form's with its signs, however its operators are nested."""
    stack: list[tuple[str | None, set[str]]] = []

    def inner(op, items):
        return next(iter(items)) if op is None else f"({f' {op} '.join(sorted(items))})"
    for tok in postfix:
        if tok not in RANK:
            stack.append((None, {tok}))
            continue
        b, a = stack.pop(), stack.pop()
        if tok == "with":
            stack.append((None, {f"{inner(*a)} with {inner(*b)}"}))
            continue
        lists = [x[1] if x[0] in (None, tok) else {inner(*x)} for x in (a, b)]
        lists.sort(key=len)
        lists[1] |= lists[0]
        stack.append((tok if len(lists[1]) > 1 else None, lists[1]))
    op, items = stack[0]
    return next(iter(items)) if op is None else f" {op} ".join(sorted(items))


def allowed(postfix: list[str], have) -> bool:
    """Whether the licences in ``have`` are enough for the expression. What stands
    behind ``with`` only adds permissions, so the licence before it decides."""
    stack: list[bool] = []
    for tok in postfix:
        if tok not in RANK:
            stack.append(tok in have)
        else:
            b, a = stack.pop(), stack.pop()
            stack.append(a or b if tok == "or" else a and b if tok == "and" else a)
    return stack[0]


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan_text(text: str, find, accept: frozenset[str] = ACCEPT) -> dict:
    words = text.encode("utf-8").translate(C.WORD_BYTES).split()
    row = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None}
    base, weight, said, fine = set(), {}, [], True
    joined = f" {b' '.join(words).decode('utf-8')} "
    starts = []
    for end, phrase in find.iter(joined):
        if phrase in BASE:
            starts.append(end - len(phrase) - 1)
            base.add(BASE[phrase])
            weight[BASE[phrase]] = BASE_WEIGHT[BASE[phrase]]
        if phrase in NOTICES:
            label, w = NOTICES[phrase]
            weight[label] = max(weight.get(label, 0), w)
        if phrase == TAG:
            weight["spdx"] = 0.9
    if starts:
        row |= {"n_base": len(starts), "first_word": joined.count(" ", 0, min(starts)),
                "last_word": joined.count(" ", 0, max(starts))}
    if "spdx" in weight:
        for m in TAG_LINE.finditer(text):
            postfix = parse(m[1])
            if postfix:
                said.append(factored(postfix))
                fine = fine and allowed(postfix, accept)
                weight |= {f"spdx:{t}": 0.99 for t in postfix if t not in RANK}
    rest = 1.0
    for label in sorted(weight):
        rest *= 1 - weight[label]
    return row | {"base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(weight)),
                  "score": 1 - rest if weight else 0.0, "expressions": "; ".join(said),
                  "allowed": fine if said else None}


def scan(docs: DataFrame, accept: frozenset[str] = ACCEPT) -> DataFrame:
    """One row per document row (see the module's text)."""

    def run(batches):
        find = automaton()
        kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
                 "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "expressions": pa.string(),
                 "allowed": pa.bool_()}
        for b in C.slices(batches, "text"):
            rows = [scan_text(t, find, accept) for t in C.strings(b, "text")]
            yield C.record(b, ["doc_id"], **{k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()})

    return C.mapped(docs.select("doc_id", "text"), run, SCHEMA)


def op2(spark, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents"))
