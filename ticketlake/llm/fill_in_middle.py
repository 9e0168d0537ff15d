"""Operator 12: fill-in-middle transformation with a Roaring-style boundary set.

The places where a text may be cut (starts of code points, words or lines) are
byte offsets of its UTF-8 form, kept as a ``Boundaries`` set: a container per
65,536 offsets, which is a sorted array, a bitmap or a list of runs, whichever
is smallest, with the cumulative cardinalities of the containers beside them.
``select(k)`` searches the container by these and then selects inside it, so
both cut offsets come from two searches, not from decoding the text.

A text's random numbers are groups of eight hexadecimal digits of the SHA-256 of
``seed:doc_id``, so a row gives the same result on every run and executor.
Prefix-suffix-middle (``psm``) and suffix-prefix-middle (``spm``) put the parts
behind their marks; ``restored`` takes them apart again.

Defined cases: a null text counts as empty; an empty text, and one with a mark
inside, stays plain; a null doc_id takes part in the seed as nothing behind the
colon; very long texts are cut whole; equal cuts give an empty middle; repeated
rows give repeated results; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ticketlake.llm import common as C

SPAN = 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PLAIN_FROM, SPM_BELOW = 1, 90, 20
SCHEMA = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, "
          "restored_sha256 string")
TEXTS = "doc_id long, form string, output string"


class Array:
    """Sorted offsets of few members."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class Runs:
    """Stretches of members, one after another."""

    def __init__(self, start: np.ndarray, end: np.ndarray):
        self.start = start
        self.before = np.cumsum(end - start) - (end - start)

    def select(self, k: int) -> int:
        r = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.start[r]) + k - int(self.before[r])


class Bitmap:
    """A bit per offset, and the members in front of each 64-bit word."""

    def __init__(self, flags: np.ndarray):
        padded = np.zeros(-(-len(flags) // 64) * 64, bool)
        padded[:len(flags)] = flags
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.cumsum(np.bitwise_count(self.words).astype(np.int64))
        self.before = np.concatenate(([0], self.before[:-1]))

    def select(self, k: int) -> int:
        w = int(np.searchsorted(self.before, k, side="right")) - 1
        word = int(self.words[w])
        for _ in range(k - int(self.before[w])):
            word &= word - 1
        return w * 64 + (word & -word).bit_length() - 1


class Boundaries:
    """The set of offsets whose flag is set."""

    def __init__(self, flags: np.ndarray):
        self.end = len(flags)
        self.high, self.containers, self.upto = [], [], []
        total = 0
        for at in range(0, len(flags), SPAN):
            part = flags[at:at + SPAN]
            n = int(np.count_nonzero(part))
            if not n:
                continue
            total += n
            self.high.append(at)
            self.containers.append(self.container(part, n))
            self.upto.append(total)
        self.total = total

    @staticmethod
    def container(part: np.ndarray, n: int):
        if n == len(part):
            return Runs(np.zeros(1, np.int64), np.array([n], np.int64))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], part, [False])).view(np.int8)))
        size = {Runs: 2 * len(edge), Array: 2 * n, Bitmap: SPAN // 8}
        kind = min(size, key=size.get)
        if kind is Runs:
            return Runs(edge[::2], edge[1::2])
        return Array(np.flatnonzero(part)) if kind is Array else Bitmap(part)

    def __len__(self) -> int:
        return self.total

    def select(self, k: int) -> int:
        """The k-th member from 0; behind the last one the end of the text."""
        if k >= self.total:
            return self.end
        c = bisect_right(self.upto, k)
        return self.high[c] + self.containers[c].select(k - (self.upto[c - 1] if c else 0))


def starts(data: np.ndarray, unit: str) -> np.ndarray:
    """Flags of the bytes at which a unit starts. A word takes the white space
    (ASCII) behind it along, a line its line end, so the units make up the text."""
    if unit == "char":
        return (data & 0xC0) != 0x80
    blank = (data == 32) | ((data >= 9) & (data <= 13)) if unit == "word" else data == 10
    behind = np.concatenate(([True], blank))[:-1]
    flags = behind & ~blank if unit == "word" else behind
    flags[:1] = True
    return flags


def numbers(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def transformed(raw: bytes, doc_id: int | None, unit: str = "char", seed: int = SEED):
    """(units, form, prefix units, middle units, output bytes) of one text."""
    cuts = Boundaries(starts(np.frombuffer(raw, np.uint8), unit)) if raw else Boundaries(np.zeros(0, bool))
    n = len(cuts)
    h1, h2, h3, h4 = numbers(doc_id, seed)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not raw or p in raw or s in raw or m in raw or h3 % 100 >= PLAIN_FROM:
        return n, "plain", None, None, raw
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = cuts.select(first), cuts.select(last)
    if h4 % 100 < SPM_BELOW:
        return n, "spm", first, last - first, b"".join((s, raw[j:], p, raw[:i], m, raw[i:j]))
    return n, "psm", first, last - first, b"".join((p, raw[:i], s, raw[j:], m, raw[i:j]))


def restored(output: bytes, form: str) -> bytes:
    """The text from its output: marks don't occur in a text that was cut, nor across a part's end."""
    if form == "plain":
        return output
    one, two = (PREFIX.encode(), SUFFIX.encode()) if form == "psm" else (SUFFIX.encode(), PREFIX.encode())
    head, middle = output[len(one):].split(MIDDLE.encode())
    first, second = head.split(two)
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    return prefix + middle + suffix


def rows(batches, unit: str, seed: int):
    for b in C.slices(batches, "text"):
        ids = b.column(b.schema.get_field_index("doc_id")).to_pylist()
        yield b, [transformed(t.encode(), i, unit, seed) for i, t in zip(ids, C.strings(b, "text"))]


def fill_in_middle(docs: DataFrame, unit: str = "char", seed: int = SEED) -> DataFrame:
    """Per row: doc_id, form and the transformed text."""

    def run(batches):
        for b, found in rows(batches, unit, seed):
            yield C.record(b, ["doc_id"], form=pa.array([x[1] for x in found], pa.string()),
                           output=pa.array([x[4].decode() for x in found], pa.string()))

    return C.mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, TEXTS)


def digests(docs: DataFrame, unit: str = "char", seed: int = SEED) -> DataFrame:
    """Per row: doc_id, units, form, units of prefix and middle, digests of the
    transformed text and of the text rebuilt from it."""

    def run(batches):
        for b, found in rows(batches, unit, seed):
            yield C.record(b, ["doc_id"], n=pa.array([x[0] for x in found], pa.int64()),
                           form=pa.array([x[1] for x in found], pa.string()),
                           prefix_chars=pa.array([x[2] for x in found], pa.int64()),
                           middle_chars=pa.array([x[3] for x in found], pa.int64()),
                           output_sha256=[hashlib.sha256(x[4]).hexdigest() for x in found],
                           restored_sha256=[hashlib.sha256(restored(x[4], x[1])).hexdigest() for x in found])

    return C.mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, SCHEMA)


def op12(spark, sf_dir: str) -> DataFrame:
    return digests(C.table(spark, sf_dir, "documents"))


SQL = """
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n,
                  sha256('1:' || coalesce(cast(doc_id as varchar), '')) as x from documents),
h as (select *, cast('0x' || substr(x, 1, 8) as bigint) as h1, cast('0x' || substr(x, 9, 8) as bigint) as h2,
             cast('0x' || substr(x, 17, 8) as bigint) as h3, cast('0x' || substr(x, 25, 8) as bigint) as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as i, greatest(h1 % (n + 1), h2 % (n + 1)) as j,
             case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90
                  then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substr(t, 1, i) as head, substr(t, i + 1, j - i) as mid, substr(t, j + 1) as tail from c)
select doc_id, n, form,
       case when form <> 'plain' then i end as prefix_chars, case when form <> 'plain' then j - i end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || head || '<S>' || tail || '<M>' || mid
              else '<S>' || tail || '<P>' || head || '<M>' || mid end) as output_sha256,
       sha256(t) as restored_sha256
from p
"""
