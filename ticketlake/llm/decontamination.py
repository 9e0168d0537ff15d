"""Operator 8: benchmark decontamination by spaced-seed hashing.

A fixed mask lays over consecutive words and hashes those at its marked
positions only, so a substituted word at a free position leaves the hash alone.
The masked windows of the benchmark are indexed by hash; the windows of every
document are looked up in the index (a hash join with the bounded benchmark
side in the tasks). Each hit fixes an alignment of an item and a document; the
words around it are compared one by one and the best stretch counts: +1 for an
equal word, -``PENALTY`` for another, so that substitutions are tolerated. A
stretch of ``MIN_WORDS`` equal words or more (items shorter than that: all of
their words) with ``MIN_SHARE`` of its words equal is an overlap. So is an
alignment in which ``MIN_SHARE`` of all the item's words are equal, however the
others are spread. Items of fewer than ``WHOLE`` words have seeds for that:
``SMALL_MASKS`` (weight 4) lie over them in every place, and a length that these
can miss with that many words changed gets more masks, so that no choice of
changed words hides an item (``small_masks``).

The index of one pass holds at most ``BLOCK_WORDS`` benchmark words, so what is
broadcast is bounded; a larger benchmark takes several passes over the
documents, in blocks of whole items.

Words are lower-cased runs of letters and digits. An item of fewer than 5 words
has no word to spare (four of five are ``MIN_SHARE``) and is looked up by all its
words; an item without words says nothing.

Defined cases: null and empty texts overlap nothing, on either side; an empty
benchmark marks nothing; repeated items and rows give repeated results; a very
long text is read whole; extra columns are kept by ``clean`` and not read by
``overlaps``.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm import common as C

MASKS = ("1101011011", "1110100111", "1011101101")  # span 10, weight 7
SPAN = 10
SMALL_MASKS = ("1111", "11011", "10111", "11101", "110011", "101011", "1110111")
MIN_WORDS, MIN_SHARE, PENALTY, WHOLE = 13, 0.8, 3, 20
BLOCK_WORDS = 1_000_000
FILTER_BITS = 22
PART = 200_000
SCHEMA = "doc_id long, item_id long, first_word long, n_words long, n_equal long"


def windows(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of each window's marked words (fewer windows than words)."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(salt + 1))
    for k, c in enumerate(mask):
        if c == "1":
            out = (out ^ h[k:k + n]) * np.uint64(0x9DDFEA08EB382D69)
            out ^= out >> np.uint64(29)
    return out


def least_equal(n: int) -> int:
    """The fewest equal words that are MIN_SHARE of n."""
    return next(k for k in range(n + 1) if k >= MIN_SHARE * n)


@lru_cache(maxsize=WHOLE)
def small_masks(n: int) -> tuple[str, ...]:
    """Masks that, laid in every place of an item of n words, see it whichever
    words MIN_SHARE allows to change."""
    spare = n - least_equal(n)
    if not spare:
        return ("1" * n,)
    laid = lambda m: [frozenset(at + k for k, c in enumerate(m) if c == "1") for at in range(n - len(m) + 1)]
    masks = [m for m in SMALL_MASKS if len(m) <= n]
    seeds = [x for m in masks for x in laid(m)]
    for changed in combinations(range(n), spare):
        if not any(x.isdisjoint(changed) for x in seeds):
            kept = [k for k in range(n) if k not in changed]  # the closest four words that stay
            at = min(range(len(kept) - 3), key=lambda i: kept[i + 3] - kept[i])
            mask = "".join("1" if k in kept[at:at + 4] else "0" for k in range(kept[at], kept[at + 3] + 1))
            masks.append(mask)
            seeds += laid(mask)
    return tuple(masks)


class Index:
    """Masked windows of a block of items."""

    def __init__(self, ids: list, texts: list[str]):
        self.words, counts = C.word_hashes(texts)
        self.ids = ids
        self.start = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        short = {int(c) for c in counts if 0 < c < WHOLE}
        self.masks = [*MASKS, *sorted({m for n in short for m in small_masks(n)})]
        keys, item, place = [], [], []
        for salt, mask in enumerate(self.masks):
            for i, n in enumerate(counts):
                if n < SPAN if salt < len(MASKS) else not 0 < n < WHOLE or mask not in small_masks(int(n)):
                    continue
                w = windows(self.words[self.start[i]:self.start[i + 1]], mask, salt)
                keys.append(w)
                item.append(np.full(len(w), i))
                place.append(np.arange(len(w)))
        self.key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(self.key, kind="stable")
        self.key = self.key[order]
        self.item = np.concatenate(item)[order] if keys else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if keys else np.zeros(0, np.int64)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.key >> np.uint64(64 - FILTER_BITS)] = True

    def overlaps(self, texts: list[str]):
        """(text, item, first word, words, equal words) of every overlap, the
        best one for a text, an item and an alignment."""
        h, counts = C.word_hashes(texts)
        ends = np.cumsum(counts)
        starts = ends - counts
        found = []
        for salt, mask in enumerate(self.masks):
            w = windows(h, mask, salt)
            at = np.flatnonzero(self.filter[w >> np.uint64(64 - FILTER_BITS)])
            if not len(at):
                continue
            low, high = (np.searchsorted(self.key, w[at], side) for side in ("left", "right"))
            many = high - low
            at = np.repeat(at, many)
            hit = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            doc = np.searchsorted(ends, at, side="right")
            ok = at + len(mask) <= ends[doc]
            rows = np.stack([doc, self.item[hit], at - self.place[hit]], 1)[ok]
            found.append(rows if salt < len(MASKS) else self.likely(h, starts, ends, rows))
        if not found:
            return
        # every alignment once; alignments of an item in a text are as many as its seeds at most
        for doc, item, shift in np.unique(np.concatenate(found), axis=0):
            best = self.best(h, starts[doc], ends[doc], self.start[item], self.start[item + 1], shift)
            if best:
                yield int(doc), int(item), int(best[0] - starts[doc]), best[1], best[2]

    def likely(self, h, starts, ends, rows):
        """The alignments of short items that have enough equal words at all."""
        kept = []
        for part in np.array_split(rows, len(rows) // PART + 1):
            doc, item, shift = part.T
            first, n = self.start[item], self.start[item + 1] - self.start[item]
            equal = np.zeros(len(part), np.int64)
            for k in range(WHOLE - 1):
                at = shift + k
                inside = (k < n) & (at >= starts[doc]) & (at < ends[doc])
                equal += inside & (h[np.where(inside, at, 0)] == self.words[np.where(inside, first + k, 0)])
            kept.append(part[(equal >= np.minimum(MIN_WORDS, n)) | (equal >= MIN_SHARE * n)])
        return np.concatenate(kept)

    def best(self, h, doc_start, doc_end, item_start, item_end, shift):
        """The best stretch of an alignment, else the whole of it: first word,
        words, equal words."""
        n = item_end - item_start
        lo, hi = max(shift, doc_start), min(shift + n, doc_end)
        same = h[lo:hi] == self.words[item_start + lo - shift:item_start + hi - shift]
        total = np.concatenate(([0], np.cumsum(np.where(same, 1, -PENALTY))))
        gain = total - np.minimum.accumulate(total)
        end = int(np.argmax(gain))
        begin = int(np.argmin(total[:end + 1])) if end else 0
        equal = int(same[begin:end].sum())
        if equal >= min(MIN_WORDS, n) and equal >= MIN_SHARE * (end - begin):
            return lo + begin, end - begin, equal
        equal = int(same.sum())
        return (lo, int(hi - lo), equal) if equal >= MIN_SHARE * n else None


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS):
    """Blocks of items of at most ``block_words`` words (a longer item is a
    block of its own), read partition by partition."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
            F.col("text").isNotNull()).toLocalIterator():
        n = len(r.text) // 2 + 1  # no text has more words
        if ids and size + n > block_words:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += n
    if ids:
        yield ids, texts


def overlaps(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document row, item and alignment that overlap."""
    spark, out = docs.sparkSession, None
    for ids, texts in item_blocks(benchmark, block_words):
        index = spark.sparkContext.broadcast(Index(ids, texts))

        def run(batches, index=index):
            ix = index.value
            for b in C.slices(batches, "text"):
                rows = list(ix.overlaps(C.strings(b, "text")))
                if rows:
                    doc, item, first, n, equal = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array(doc)), pa.array([ix.ids[i] for i in item], pa.int64()),
                         *(pa.array(x, pa.int64()) for x in (first, n, equal))],
                        ["doc_id", "item_id", "first_word", "n_words", "n_equal"])

        part = C.mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` (all columns) that overlap no item."""
    spark = docs.sparkSession
    for ids, texts in item_blocks(benchmark, block_words):
        index = spark.sparkContext.broadcast(Index(ids, texts))

        def run(batches, index=index):
            ix = index.value
            for b in C.slices(batches, "text"):
                keep = np.ones(b.num_rows, bool)
                for doc, *_ in ix.overlaps(C.strings(b, "text")):
                    keep[doc] = False
                yield b.filter(pa.array(keep))

        docs = C.mapped(docs, run, docs.schema)
    return docs


def op8(spark, sf_dir: str) -> DataFrame:
    return overlaps(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
