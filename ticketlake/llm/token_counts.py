"""Operator 13: token counts by heap-and-linked-list byte-pair merging.

A pre-token's bytes are symbols in a doubly linked list; a heap holds the
adjacent pairs that the vocabulary joins, by rank, then place. The lowest pair
is popped again and again (an entry whose symbols have changed meanwhile is
skipped), its symbols become one, and the pairs with its new neighbours enter
the heap. Each merge takes one symbol away, so the count is the number of bytes
less the number of merges: no identifier is looked up or kept. A pre-token
without white space of any length takes n log n steps.

Added tokens (``<|endoftext|>``) stand for themselves inside a text, as the
library has it by default, and count once each. Texts split into units
(``units.py``); a worker remembers the counts of up to ``MEMO`` units and words.

Defined cases: a null text counts as empty; an empty text has 0 tokens and 0
bytes; very long texts are counted whole, a stretch at a time; ties of rank go
to the leftmost pair; repeated rows give repeated results; a null doc_id stays
null; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from ticketlake.llm import common as C
from ticketlake.llm.units import SPLIT, parts

LIMIT, MEMO = 1024, 400_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def merges(word: str, rank: dict[tuple[str, str], int]) -> int:
    """How many merges the symbols of ``word`` take."""
    sym: list[str | None] = list(word)
    n = len(sym)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(rank[p], i) for i in range(n - 1) if (p := (word[i], word[i + 1])) in rank]
    heapq.heapify(heap)
    done = 0
    while heap:
        r, i = heapq.heappop(heap)
        j = right[i]
        if sym[i] is None or j >= n or rank.get((sym[i], sym[j])) != r:
            continue  # one of the two has been merged meanwhile
        sym[i] += sym[j]
        sym[j] = None
        done += 1
        after = right[i] = right[j]
        if after < n:
            left[after] = i
            if (p := (sym[i], sym[after])) in rank:
                heapq.heappush(heap, (rank[p], i))
        before = left[i]
        if before >= 0 and (p := (sym[before], sym[i])) in rank:
            heapq.heappush(heap, (rank[p], before))
    return done


class Counts(dict):
    """Unit -> tokens, filled as units come; ``lead`` stands in front of each."""

    def __init__(self, counter: "Counter", lead: str):
        super().__init__()
        self.counter, self.lead = counter, lead

    def __missing__(self, unit: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = self[unit] = self.counter.words(self.lead + unit)
        return n


class Counter:
    """Token counts for the byte-level byte-pair vocabulary of a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        if said["model"]["type"] != "BPE" or said["pre_tokenizer"]["type"] != "ByteLevel" or said["normalizer"] \
                or any(said["model"][k] for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix",
                                                  "ignore_merges")):
            raise ValueError(f"{path}: not a plain byte-level byte-pair vocabulary")
        if any(a[k] for a in said["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens that take their surroundings along are not supported")
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in said["model"]["merges"])
        self.rank = {p: i for i, p in enumerate(pairs)}
        added = sorted((a["content"] for a in said["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.first, self.rest = Counts(self, ""), Counts(self, " ")
        self.word = lru_cache(maxsize=MEMO)(lambda w: len(w) - merges(w, self.rank))

    def words(self, unit: str) -> int:
        return sum(self.word(w) for w, _ in self.split(unit))

    def plain(self, text: str) -> int:
        total = 0
        for part, inner in parts(text):
            units = SPLIT(part)
            if inner:
                total += sum(map(self.rest.__getitem__, units))
            elif part:
                total += self.first[units[0]] + sum(map(self.rest.__getitem__, units[1:]))
        return total

    def count(self, text: str) -> int:
        """The number of tokens of a text."""
        if not self.added or not self.added.search(text):
            return self.plain(text)
        found = self.added.split(text)
        return len(found) - 1 + sum(map(self.plain, found))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""

    def run(batches):
        count = counter(vocabulary).count
        for b in C.slices(batches, "text", 1 << 20):
            texts = C.strings(b, "text")
            n = list(map(count, texts))
            yield C.record(b, ["doc_id"], n_bytes=[len(t.encode()) for t in texts], n_tokens=n,
                           over_limit=[x > limit for x in n])

    return C.mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, SCHEMA)


def op13(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
