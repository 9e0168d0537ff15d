"""Operator 11: cross-tokenizer alignment with minimal perfect hashing of pairs.

A byte-level vocabulary (A) and a piece vocabulary (B) cut the same bytes, a
text with a space in front, into tokens. Offsets where both end cut the tokens
into groups; every A and every B token of a group are linked. A pair of ids is
counted by the documents that hold it linked.

1. First pass: documents are aligned in Arrow batches; a task adds up the
   documents of each distinct pair and writes them by shard (hash of the A id).
2. Per shard the keys of all tasks are united in a tree, and a minimal perfect
   hash is built over them: levels of bit arrays (``GAMMA`` bits a key), a key
   that meets no other one on a level sets its bit there, the others go on to the
   next; the rank of the bit is the key's index.
3. Each bunch of ``FAN`` partial counts becomes a dense vector indexed by the
   hash; the vectors of a shard are summed in a tree of fan-in ``FAN``. With the
   counts stands the key of each index (a lookup is verified by it) and whether
   the count is its A id's highest (all pairs of an A id are in one shard).
4. Second pass: documents are aligned anew and look their pairs up.

The tables are as large as the number of distinct pairs of both vocabularies.
The second pass broadcasts at most ``BLOCK`` bytes of them at a time; larger
tables take several passes, whose sums per row are carried along in a table in
the shared folder.

A text splits into units that both vocabularies treat alone (``units.py``);
units are aligned once per worker (``MEMO`` of them are kept). Links of a group
are counted by its distinct ids, ``WIDE`` pairs at a time, so long groups aren't
expanded at once.

Defined cases: a null or empty text, or one whose tokens' bytes differ from the
text's in A or B, has zeros and an empty digest; very long texts are aligned
whole; ties for an A id's highest count all count as best; repeated rows are
documents of their own; a null doc_id stays null; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm import common as C
from ticketlake.llm.units import SPLIT, parts

SHARDS, FAN, GAMMA, LEVELS = 64, 32, 2.0, 40
MEMO, FLUSH, WIDE, SLICE = 600_000, 1_000_000, 1 << 20, 2 << 20
BLOCK = 96 << 20
TOGETHER = 1 << 15  # characters of new units that are encoded as one text
#: a space at the start of a text or behind white space
BESIDE = "(?:^|[" + "".join(f"\\x{{{i:x}}}" for i in range(0x10000) if chr(i).isspace()) + "]) "
PARTIAL = "shard int, part long, keys binary, counts binary"
KEYS = "shard int, part long, keys binary"
HASHED = "shard int, hash binary, keys binary"
DENSE = "shard int, part long, counts binary"
TABLE = "shard int, hash binary, keys binary, counts binary, best binary"
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")


# ---- minimal perfect hash -------------------------------------------------

class PerfectHash:
    """Levels of bit arrays over distinct 64-bit keys; the rank of a key's bit is
    its index in 0 .. n - 1."""

    def __init__(self, words: list[np.ndarray]):
        self.words = words
        self.ranks = []
        total = 0
        for w in words:
            ones = np.bitwise_count(w).astype(np.int64)
            self.ranks.append(total + np.cumsum(ones) - ones)
            total += int(ones.sum())
        self.n = total

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (C.mix(keys.view(np.uint64) + np.uint64((level + 1) * 0x9E6C63D0876A9A47 % 2 ** 64)) % np.uint64(size)) \
            .astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        words = []
        while len(keys):
            if len(words) > LEVELS:
                raise ValueError("keys are not distinct")
            size = -(-max(64, int(GAMMA * len(keys))) // 64) * 64
            at = cls.place(keys, len(words), size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[at]]
        return cls(words)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The keys' indices; for a key that isn't in the set -1, or another key's index."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, w in enumerate(self.words):
            at = self.place(keys[left], level, len(w) * 64)
            word, bit = w[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.ranks[level][at[hit] >> 6] + np.bitwise_count(below).astype(np.int64)
            left = left[~hit]
            if not len(left):
                break
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.words), *map(len, self.words)], np.int64)
        return b"".join([head.tobytes(), *(w.tobytes() for w in self.words)])

    @classmethod
    def load(cls, raw: bytes) -> "PerfectHash":
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        words, at = [], 8 * (n + 1)
        for size in np.frombuffer(raw, np.int64, n, 8):
            words.append(np.frombuffer(raw, np.uint64, size, at))
            at += 8 * int(size)
        return cls(words)


def verified(table: PerfectHash, own: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Indices of keys, each checked against the key that stands there."""
    at = table.index(keys)
    if (at < 0).any() or not np.array_equal(own[at], keys):
        raise ValueError("a pair isn't in the table: the documents changed between two passes")
    return at


class Spans:
    """Byte strings one after another."""

    def __init__(self, data: np.ndarray, size: np.ndarray):
        self.data, self.size = data, size
        self.start = np.cumsum(size) - size

    @classmethod
    def of(cls, parts_: list[bytes]) -> "Spans":
        return cls(np.frombuffer(b"".join(parts_), np.uint8), np.fromiter(map(len, parts_), np.int64, len(parts_)))

    def join(self, at: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.start[at], self.size[at])]

    def more(self, data: np.ndarray, size: np.ndarray) -> "Spans":
        return Spans(np.concatenate([self.data, data]), np.concatenate([self.size, size]))


def flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64)


def distinct_values(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each value's place among them."""
    order = np.argsort(x, kind="stable")
    new = np.ones(len(x), bool)
    new[1:] = x[order[1:]] != x[order[:-1]]
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return x[order[new]], which


def distinct_only(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


# ---- alignment of units ---------------------------------------------------

def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, then those of 1, 2, ..."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)


#: fixed value: how byte-level vocabularies of this kind cut a text into words
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def by_ranks(path: str, words: list[bytes]):
    """A quicker encoder of the same vocabulary: byte pairs by rank. It needs the
    ids to be in the order of the merges, one merge per id behind the 256 bytes;
    None for other vocabularies."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    vocab, merges = said["model"]["vocab"], said["model"]["merges"]
    ids = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in merges]
    before = said["pre_tokenizer"]
    if said["normalizer"] or before["type"] != "ByteLevel" or not before.get("use_regex", True) \
            or before["add_prefix_space"] or any(x >= y for x, y in zip(ids, ids[1:])) \
            or len(vocab) != 256 + len(ids) or sorted(ids + [vocab[w] for w in vocab if len(w) == 1]) != list(range(len(vocab))):
        return None
    return tiktoken.Encoding("ranks", pat_str=WORDS, special_tokens={}, mergeable_ranks={words[i]: i for i in vocab.values()})


class Pair:
    """Two vocabularies and the alignment of units."""

    def __init__(self, byte_level: str, piece_model: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        self.a_bytes = self.byte_level(self.a)
        quick = by_ranks(byte_level, self.a_bytes)
        self.a_encode = quick.encode_ordinary if quick else \
            lambda t: self.a.encode_batch_fast([t], add_special_tokens=False)[0].ids
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            p = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode())
        self.width = len(self.b_bytes)
        self.a_raw, self.b_raw = Spans.of(self.a_bytes), Spans.of(self.b_bytes)
        top = max(len(self.a_bytes), self.width)
        self.said = Spans.of([b"%d" % i + end for end in (b",", b"|", b";") for i in range(top)])
        self.top = top
        self.mark = self.b.piece_to_id("▁")
        self.clear()

    @staticmethod
    def byte_level(tokenizer) -> list[bytes]:
        """The bytes of each id: a byte-level vocabulary spells printable bytes as
        themselves and the others as the characters from U+0100 on, in order."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        out = [b""] * tokenizer.get_vocab_size()
        for word, i in tokenizer.get_vocab().items():
            out[i] = bytes(byte[c] for c in word) if all(c in byte for c in word) else word.encode()
        return out

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.sums = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links; n_a is -1 if the bytes differ
        self.text = Spans.of([])                # groups as decimal ids, each with ``;`` behind
        self.start = np.zeros(0, np.int64)      # a unit's distinct pairs, and in how many links each stands
        self.size = np.zeros(0, np.int64)
        self.pair = np.zeros(0, np.int64)       # by their places in ``keys``
        self.links = np.zeros(0, np.int64)
        self.keys = np.zeros(0, np.int64)
        self.known: tuple[np.ndarray, np.ndarray] = (self.keys, self.keys)  # keys in order, and their places

    def which(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' units one after another, and the text of each. A
        unit is written without the space in front that each of them has. Texts
        without white space in front of a space are split and their units made
        distinct by Arrow, the others one by one."""
        if len(self.at) > MEMO:
            self.clear()
        texts = pc.fill_null(texts, "")
        odd = np.asarray(pc.match_substring_regex(texts, BESIDE))
        plain = np.flatnonzero(~odd & (np.asarray(pc.binary_length(texts)) > 0))
        lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
        coded = lists.flatten().dictionary_encode()
        units = coded.dictionary.to_pylist()
        found = [[u for part, _ in parts(texts[i].as_py()) for u in SPLIT(part)] for i in np.flatnonzero(odd).tolist()]
        self.learn(set(units).union(*found).difference(self.at))
        numbers = np.fromiter(map(self.at.__getitem__, units), np.int64, len(units))[np.asarray(coded.indices)]
        doc = np.repeat(plain, np.asarray(pc.list_value_length(lists)))
        if found:
            numbers = np.concatenate([numbers, *(np.fromiter(map(self.at.__getitem__, x), np.int64, len(x)) for x in found)])
            doc = np.concatenate([doc, np.repeat(np.flatnonzero(odd), [len(x) for x in found])])
            order = np.argsort(doc, kind="stable")
            numbers, doc = numbers[order], doc[order]
        return numbers, doc

    def learn(self, units: set[str]) -> None:
        """Align new units, a bounded number of characters at a time."""
        new, size = [], 0
        for u in units:
            new.append(u)
            size += len(u)
            if size > WIDE:
                self.add(new)
                new, size = [], 0
        if new:
            self.add(new)

    def encoded(self, units: list[str]):
        """(A ids, how many each unit has, B ids, how many), for units that end in no
        white space: behind one another, each with its space, they are a text whose
        tokens end where the units end."""
        parts_ = []
        block, size = [], 0
        for u in [*units, None]:
            if block and (u is None or size > TOGETHER):
                text = " " + " ".join(block)
                raw = np.frombuffer(text.encode(), np.uint8)
                ends = np.cumsum([len(x.encode()) + 1 for x in block])
                a = np.array(self.a_encode(text), np.int64)
                b = np.array(self.b.encode(text[1:], num_threads=1), np.int64)
                counts = []
                for ids, spans in ((a, self.a_raw), (b, self.b_raw)):
                    at = np.cumsum(spans.size[ids])
                    last = np.searchsorted(at, ends)
                    if not (len(at) and at[-1] == len(raw) and np.array_equal(at[last], ends)
                            and np.array_equal(spans.join(ids), raw)):
                        return None
                    counts.append(np.diff(np.concatenate(([-1], last))))
                parts_.append((a, counts[0], b, counts[1]))
                block, size = [], 0
            if u is not None:
                block.append(u)
                size += len(u)
        return tuple(np.concatenate(x) for x in zip(*parts_)) if parts_ else (np.zeros(0, np.int64),) * 4

    def add(self, units: list[str]) -> None:
        """Align new units."""
        alone = [u for u in units if not u or u[-1].isspace() or "▁" in u]
        together = [u for u in units if u and not u[-1].isspace() and "▁" not in u]
        joint = self.encoded(together)
        if joint is None:  # some unit's bytes differ from its tokens': each by itself
            alone, together, joint = units, [], (np.zeros(0, np.int64),) * 4
        units = together + alone
        a_ids = [self.a_encode(" " + u) for u in alone]
        b_ids = self.b.encode(alone, num_threads=1) if alone else []
        for i, u in enumerate(alone):
            if not u:
                b_ids[i] = [self.mark]  # a lone space, which the library has for empty texts only
        raw = Spans.of([(" " + u).encode() for u in units])
        some = Spans(raw.data[raw.start[len(together)] if alone else len(raw.data):], raw.size[len(together):])
        good = np.concatenate([np.ones(len(together), bool),
                               self.same(some, a_ids, self.a_raw) & self.same(some, b_ids, self.b_raw)])
        base = len(self.at)
        self.at.update(zip(units, range(base, base + len(units))))
        ok = np.flatnonzero(good)
        keep = good[len(together):]
        a = np.concatenate([joint[0], flat([x for x, k in zip(a_ids, keep) if k])])
        b = np.concatenate([joint[2], flat([x for x, k in zip(b_ids, keep) if k])])
        sums = np.full((len(units), 4), -1, np.int64)
        size, text = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        keys = links = np.zeros(0, np.int64)
        said = np.zeros(0, np.uint8)
        if len(ok):
            a_end, b_end = np.cumsum(self.a_raw.size[a]), np.cumsum(self.b_raw.size[b])
            common = np.intersect1d(a_end, b_end, assume_unique=True)
            a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
            unit = np.searchsorted(np.cumsum(raw.size[ok]), common)
            na, nb = np.bincount(a_group, minlength=len(common)), np.bincount(b_group, minlength=len(common))
            groups = np.bincount(unit, minlength=len(ok))
            first = np.cumsum(groups) - groups
            sums[ok] = np.stack([np.add.reduceat(na, first), np.add.reduceat(nb, first), groups,
                                 np.add.reduceat(na * nb, first)], 1)
            said, width = self.spelled(a, na, b, nb)
            text[ok] = np.add.reduceat(width, first)
            of, keys, links = self.distinct(a, a_group, b, b_group, unit)
            size[ok] = np.bincount(of, minlength=len(ok))
        self.start = np.concatenate([self.start, len(self.pair) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pair, self.links = np.concatenate([self.pair, self.placed(keys)]), np.concatenate([self.links, links])
        self.sums = np.concatenate([self.sums, sums])
        self.text = self.text.more(said, text)

    @staticmethod
    def same(raw: "Spans", ids: list[list[int]], spans: "Spans") -> np.ndarray:
        """Whether the tokens' bytes are the unit's, per unit."""
        of = flat(ids)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        upto = np.concatenate(([0], np.cumsum(spans.size[of])))
        ends = upto[np.cumsum(count)]
        size = np.diff(np.concatenate(([0], ends)))
        own = spans.join(of)
        if len(own) == len(raw.data) and np.array_equal(size, raw.size) and np.array_equal(own, raw.data):
            return np.ones(len(ids), bool)
        return np.array([s == n and np.array_equal(own[e - s:e], raw.data[r:r + n])
                         for e, s, r, n in zip(ends, size, raw.start, raw.size)], bool)

    def spelled(self, a, na, b, nb) -> tuple[np.ndarray, np.ndarray]:
        """The groups as text, one after another, and the length of each."""
        n = na + nb
        first = np.cumsum(n) - n
        tokens = np.empty(len(a) + len(b), np.int64)
        at = np.repeat(first - (np.cumsum(na) - na), na) + np.arange(len(a))
        tokens[at] = a
        at = np.repeat(first + na - (np.cumsum(nb) - nb), nb) + np.arange(len(b))
        tokens[at] = b
        tokens[first + na - 1] += self.top
        tokens[first + n - 1] += 2 * self.top
        return self.said.join(tokens), np.add.reduceat(self.said.size[tokens], first)

    def placed(self, keys: np.ndarray) -> np.ndarray:
        """The places of pair keys in ``keys``, new ones behind the others."""
        order, places = self.known
        found, which = distinct_values(keys)
        at = np.minimum(np.searchsorted(order, found), max(0, len(order) - 1))
        old = order[at] == found if len(order) else np.zeros(len(found), bool)
        place = np.empty(len(found), np.int64)
        place[old] = places[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            place[new] = len(self.keys) + np.arange(len(new))
            self.keys = np.concatenate([self.keys, found[new]])
            places = np.argsort(self.keys, kind="stable")
            self.known = self.keys[places], places
        return place[which]

    def distinct(self, a, a_group, b, b_group, unit):
        """(unit, pair key, links) of the distinct pairs of each unit, sorted."""
        space = len(self.a_bytes) * self.width
        ag, an = summed(a_group * len(self.a_bytes) + a, np.ones(len(a), np.int64))
        bg, bn = summed(b_group * self.width + b, np.ones(len(b), np.int64))
        group, a = np.divmod(ag, len(self.a_bytes))
        b_of, b = np.divmod(bg, self.width)
        n = np.bincount(b_of, minlength=len(unit))
        b_start = (np.cumsum(n) - n)[group]
        n = n[group]
        block = np.cumsum(n) // WIDE
        parts_ = []
        for x in np.split(np.arange(len(a)), np.flatnonzero(np.diff(block)) + 1):
            at, row = ragged(b_start[x], n[x]), np.repeat(x, n[x])
            parts_.append(summed(unit[group[row]] * space + a[row] * self.width + b[at], an[row] * bn[at]))
        key, links = parts_[0] if len(parts_) == 1 else summed(*(np.concatenate(x) for x in zip(*parts_)))
        of, key = np.divmod(key, space)
        return of, key, links

    def aligned(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(units' numbers, text of each) of the texts that have tokens."""
        u, doc = self.which(texts)
        good = np.ones(len(texts), bool)
        good[doc[self.sums[u, 0] < 0]] = False
        keep = good[doc]
        return (u, doc) if keep.all() else (u[keep], doc[keep])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


@lru_cache(maxsize=1)
def pair(byte_level: str, piece_model: str) -> Pair:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Pair(byte_level, piece_model)


# ---- passes ---------------------------------------------------------------

def shard_of(keys: np.ndarray, width: int) -> np.ndarray:
    return (C.mix((keys // width).astype(np.uint64)) % np.uint64(SHARDS)).astype(np.int64)


def longs(raw) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def partial_counts(docs: DataFrame, byte_level: str, piece_model: str) -> DataFrame:
    """First pass: (shard, part, keys, counts), the documents per distinct pair of a task."""

    def rows(keys, counts, width):
        part = TaskContext.get().partitionId()
        shard = shard_of(keys, width)
        order = np.argsort(shard, kind="stable")
        keys, counts = keys[order], counts[order]
        ends = np.cumsum(np.bincount(shard, minlength=SHARDS))
        got = [(s, keys[i:j], counts[i:j]) for s, (i, j) in enumerate(zip([0, *ends], ends)) if i < j]
        return pa.RecordBatch.from_arrays([
            pa.array([s for s, _, _ in got], pa.int32()), pa.array([part] * len(got), pa.int64()),
            pa.array([k.tobytes() for _, k, _ in got], pa.binary()),
            pa.array([n.tobytes() for _, _, n in got], pa.binary())], ["shard", "part", "keys", "counts"])

    def run(batches):
        p = pair(byte_level, piece_model)
        held, size = [], 0
        for b in C.slices(batches, "text", SLICE):
            u, doc = p.aligned(b.column("text"))
            n = len(p.keys)
            pair_of = distinct_only(np.repeat(doc, p.size[u]) * n + p.pair[ragged(p.start[u], p.size[u])]) % max(1, n)
            count = np.bincount(pair_of, minlength=n)
            there = np.flatnonzero(count)
            keys = p.keys[there]
            held.append((keys, count[there]))
            size += len(keys)
            if size > 2 * FLUSH:
                held = [summed(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
                if size > FLUSH:
                    yield rows(*held[0], p.width)
                    held, size = [], 0
        if size:
            yield rows(*summed(*(np.concatenate(x) for x in zip(*held))), p.width)

    return C.mapped(docs.select("text"), run, PARTIAL)


def united(table: pa.Table) -> pa.Table:
    keys = np.unique(np.concatenate([longs(k.as_buffer()) for k in table.column("keys")]))
    return table.slice(0, 1).select(["shard", "part"]).append_column("keys", pa.array([keys.tobytes()], pa.binary()))


def hashed(table: pa.Table) -> pa.Table:
    """A shard's perfect hash and its keys in the order of their indices."""
    keys = np.unique(np.concatenate([longs(k.as_buffer()) for k in table.column("keys")]))
    table_ = PerfectHash.build(keys)
    own = np.empty(len(keys), np.int64)
    own[table_.index(keys)] = keys
    return pa.table({"shard": table.column("shard").slice(0, 1), "hash": pa.array([table_.dump()], pa.binary()),
                     "keys": pa.array([own.tobytes()], pa.binary())})


def vector(key, rows, mph):
    """A bunch of partial counts as one dense vector."""
    if not rows.num_rows:
        return pa.table({"shard": pa.array([], pa.int32()), "part": pa.array([], pa.int64()),
                         "counts": pa.array([], pa.binary())})
    table, own = PerfectHash.load(mph.column("hash")[0].as_py()), longs(mph.column("keys")[0].as_buffer())
    total = np.zeros(table.n, np.int64)
    for k, n in zip(rows.column("keys"), rows.column("counts")):
        total[verified(table, own, longs(k.as_buffer()))] += longs(n.as_buffer())
    return dense(key[0].as_py(), key[1].as_py(), total)


def dense(shard: int, part: int, total: np.ndarray) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int64()),
                     "counts": pa.array([total.tobytes()], pa.binary())})


def added(key, table):
    """The sum of dense vectors."""
    total = np.zeros(0, np.int64)
    for n in table.column("counts"):
        n = longs(n.as_buffer())
        total = total + n if len(total) else n
    return dense(key[0].as_py(), key[1].as_py(), total)


def counted(docs: DataFrame, byte_level: str, piece_model: str) -> DataFrame:
    """(shard, hash, keys, counts, best): the documents of every pair of the corpus."""
    rows = C.cut(partial_counts(docs, byte_level, piece_model))
    bunch = F.floor(F.col("part") / FAN).alias("part")
    last = rows.agg(F.max("part")).first()[0] or 0

    keys, top = rows.select("shard", "part", "keys"), last
    while top >= FAN:
        keys = keys.select("shard", bunch, "keys").groupBy("shard", "part").applyInArrow(united, KEYS)
        top //= FAN
    hashes = C.cut(keys.groupBy("shard").applyInArrow(hashed, HASHED))

    bunches = rows.select("shard", bunch, "keys", "counts")
    own = anew(bunches.select("shard", "part").distinct().join(hashes, "shard"))
    sums = bunches.groupBy("shard", "part").cogroup(own.groupBy("shard", "part")).applyInArrow(vector, DENSE)
    top = last // FAN
    while top:
        sums = sums.select("shard", bunch, "counts").groupBy("shard", "part").applyInArrow(added, DENSE)
        top //= FAN
    width = pair_width(piece_model)

    def finished(counts: pa.Table, mph: pa.Table) -> pa.Table:
        n, own = longs(counts.column("counts")[0].as_buffer()), longs(mph.column("keys")[0].as_buffer())
        _, which = np.unique(own // width, return_inverse=True)
        most = np.zeros(int(which.max()) + 1, np.int64)
        np.maximum.at(most, which, n)
        best = n == most[which]
        return pa.table({"shard": mph.column("shard"), "hash": mph.column("hash"), "keys": mph.column("keys"),
                         "counts": counts.column("counts"), "best": pa.array([best.tobytes()], pa.binary())})

    return C.cut(sums.groupBy("shard").cogroup(anew(hashes).groupBy("shard")).applyInArrow(finished, TABLE))


def anew(df: DataFrame) -> DataFrame:
    """The frame with columns of its own, for a cogroup with one that it comes from."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


@lru_cache(maxsize=2)
def pair_width(piece_model: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model).get_piece_size()


def blocks(table: DataFrame) -> list[list[int]]:
    """Shards that are broadcast together, by the bytes of their tables."""
    sizes = table.select("shard", sum(F.length(c) for c in ("hash", "keys", "counts", "best")).alias("n")) \
        .orderBy("shard").collect()  # SHARDS rows at most
    out, room = [[]], BLOCK
    for shard, n in sizes:
        if out[-1] and n > room:
            out.append([])
            room = BLOCK
        out[-1].append(shard)
        room -= n
    return out


class Found:
    """The looked-up counts of a worker's units, per unit: links whose count is the
    best of their A id, and the sum of the counts over the links."""

    def __init__(self, p: Pair, shards: dict):
        self.p, self.of = p, None
        self.shards = {s: (PerfectHash.load(h), longs(k), longs(n), np.frombuffer(b, bool))
                       for s, (h, k, n, b) in shards.items()}

    def sums(self, units: np.ndarray) -> np.ndarray:
        """The two sums of each given unit; a unit is looked up when it comes first."""
        p = self.p
        if self.of is not p.at:  # the units were cleared
            self.of, self.known = p.at, np.zeros((0, 2), np.int64)
        if len(self.known) < len(p.start):
            self.known = np.concatenate([self.known, np.full((len(p.start) - len(self.known), 2), -1, np.int64)])
        new = distinct_only(units[self.known[units, 0] < 0])
        if len(new):
            size = p.size[new]
            at = ragged(p.start[new], size)
            keys, links = p.keys[p.pair[at]], p.links[at]
            got = np.zeros((len(keys), 2), np.int64)
            shard = shard_of(keys, p.width)
            order = np.argsort(shard, kind="stable")
            ends = np.cumsum(np.bincount(shard, minlength=SHARDS))
            for s, (table, own, n, best) in self.shards.items():
                at = order[ends[s - 1] if s else 0:ends[s]]
                i = verified(table, own, keys[at])
                got[at, 0], got[at, 1] = best[i] * links[at], n[i] * links[at]
            self.known[new] = per_text(got, np.repeat(np.arange(len(new)), size), len(new))
        return self.known[units]


def per_text(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their text (ascending)."""
    total = np.concatenate((np.zeros((1, values.shape[1]), np.int64), np.cumsum(values, 0)))
    ends = np.searchsorted(doc, np.arange(n + 1))
    return total[ends[1:]] - total[ends[:-1]]


def alignment(docs: DataFrame, byte_level: str, piece_model: str) -> DataFrame:
    """Per row: doc_id, tokens of both vocabularies, groups, links, links with the best
    count of their A id, the sum of counts over links, and the groups' digest."""
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    table = counted(docs, byte_level, piece_model)
    todo = blocks(table)
    rows = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    for k, shards in enumerate(todo):
        held = spark.sparkContext.broadcast(
            {r["shard"]: tuple(map(bytes, (r["hash"], r["keys"], r["counts"], r["best"])))
             for r in table.where(F.col("shard").isin(shards)).collect()})
        last = k == len(todo) - 1

        def run(batches, held=held, last=last):
            p = pair(byte_level, piece_model)
            found = Found(p, held.value)
            for b in C.slices(batches, "text", SLICE):
                n = b.num_rows
                u, doc = p.aligned(b.column("text"))
                sums = per_text(found.sums(u), doc, n)
                sums += np.stack([np.asarray(b.column(c)) for c in ("n_best", "count_sum")], 1)
                if not last:
                    yield C.record(b, ["doc_id", "text"], n_best=sums[:, 0], count_sum=sums[:, 1])
                    continue
                own = per_text(p.sums[u], doc, n)
                ends = np.searchsorted(doc, np.arange(n + 1)).tolist()
                digests = [digest(p, u[i:j]) for i, j in zip(ends, ends[1:])]
                yield C.record(b, ["doc_id"], n_a=own[:, 0], n_b=own[:, 1], n_groups=own[:, 2], n_links=own[:, 3],
                               n_best=sums[:, 0], count_sum=sums[:, 1], groups_sha256=digests)

        rows = C.mapped(rows, run, RESULT if last else "doc_id long, text string, n_best long, count_sum long")
        if not last:
            rows = C.cut(rows)
    return rows


def digest(p: Pair, units: np.ndarray, step: int = 1 << 18) -> str:
    if not len(units):
        return ""
    out = hashlib.sha256()
    for i in range(0, len(units), step):
        said = p.text.join(units[i:i + step])
        out.update(said if i + step < len(units) else said[:-1])
    return out.hexdigest()


def op11(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                     public_tokenizers.path("piece_bpe_32k.model"))
