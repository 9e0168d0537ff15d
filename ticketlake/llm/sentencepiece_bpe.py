"""Operator 1: SentencePiece encoding and decoding of merge-type vocabularies.

``Pieces`` reads a ``.model`` file and encodes by a score-ordered agenda of
adjacent symbol pairs: the pair whose joined piece has the highest score (the
leftmost on ties) is joined first, its new neighbours enter the agenda, and
entries about symbols that are gone are skipped. Symbols without a piece fall
back to their UTF-8 bytes.

No piece of such a vocabulary continues a word over a following space mark, so
a text splits in front of its space marks (``chunked`` tells if the vocabulary
allows it, else the text is one chunk). A slice's distinct chunks are merged
together: in each round every chunk joins the best pair of its agenda, all in
numpy arrays. Chunks of more than ``LONG`` symbols have a heap each instead, so
a text without spaces takes n log n steps. Decoding lays the pieces' bytes one
after another.

In every Arrow batch all texts are also encoded and decoded by the
sentencepiece library, a slice per call: ``agrees`` tells if all ids and the
text were the same. (With ``check`` above 1 only the texts whose hash it divides
are compared, and ``agrees`` is null for the others.)

Defined cases: a null or empty text has the end id only and decodes to the
empty text; very long texts are encoded whole; repeated rows give repeated
results; a null doc_id stays null; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ticketlake.llm import common as C

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CHUNKS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
SCHEMA = ("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean")
#: in a slice, arrays take some 130 bytes for a byte of text at their most
LONG, CHECK, SLICE, TOKENS = 48, 1, 1 << 18, 500_000
SLOT_BITS = 20
_BASE = 0x9E3779B97F4A7C15 | 1


class Pieces:
    """A merge-type SentencePiece vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        self.end = lib.eos_id()
        self.unknown = lib.unk_id()
        self.text: list[str | None] = []      # surface of normal pieces, None for others
        self.byte: dict[int, int] = {}        # id -> byte value
        self.byte_id: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i in range(n):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte[i], self.byte_id[value] = value, i
                self.text.append(None)
            elif lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i):
                self.text.append(None)
            else:
                self.ids[piece], self.score[piece] = i, lib.get_score(i)
                self.text.append(piece)
        self.chunked = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.prefix = lib.encode("a", out_type=str)[0].startswith(SPACE)

    def marked(self, text: str) -> str:
        """The text with space marks, and one in front."""
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    def chunks(self, marked: str) -> list[str]:
        return CHUNKS.findall(marked) if self.chunked else [marked] if marked else []

    def merge(self, chunk: str) -> list[str]:
        """Symbols of a chunk after all merges, by the agenda."""
        sym = list(chunk)
        n, score = len(sym), self.score
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            s = score.get(sym[i] + sym[i + 1])
            if s is not None:
                agenda.append((-s, i, i + 1, sym[i] + sym[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, joined = heapq.heappop(agenda)
            if sym[i] is None or sym[j] is None or right[i] != j or sym[i] + sym[j] != joined:
                continue
            sym[i], sym[j] = joined, None
            after = right[i] = right[j]
            if after < n:
                left[after] = i
                s = score.get(joined + sym[after])
                if s is not None:
                    heapq.heappush(agenda, (-s, i, after, joined + sym[after]))
            before = left[i]
            if before >= 0:
                s = score.get(sym[before] + joined)
                if s is not None:
                    heapq.heappush(agenda, (-s, before, i, sym[before] + joined))
        return [s for s in sym if s is not None]

    def chunk_ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for s in self.merge(chunk):
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in s.encode("utf-8"))
            else:
                out.append(self.unknown)
        return out

    def encode(self, text: str | None, end: bool = True) -> list[int]:
        ids = [i for c in self.chunks(self.marked(text or "")) for i in self.chunk_ids(c)]
        return ids + [self.end] if end else ids

    def surface(self, ids: list[int]) -> str:
        """Decoded ids with the space in front still there."""
        out, run = [], bytearray()

        def flush():
            while run:
                for k in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:k]).decode("utf-8"))
                    except UnicodeDecodeError:
                        continue
                    del run[:k]
                    break
                else:
                    out.append("�")
                    del run[:1]

        for i in ids:
            if i in self.byte:
                run.append(self.byte[i])
                continue
            flush()
            if self.text[i] is not None:
                out.append(self.text[i].replace(SPACE, " "))
            elif i == self.unknown:
                out.append(" ⁇ ")
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.surface(ids)
        first = next((i for i in ids if i in self.byte or self.text[i] is not None or i == self.unknown), None)
        if self.prefix and first is not None and self.text[first] is not None and text.startswith(" "):
            return text[1:]
        return text


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def ragged(start: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values[start[0]:start[0] + size[0]], then those of 1, 2, ..."""
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    return values[np.repeat(start - (end - size), size) + np.arange(total)]


class Tables:
    """A vocabulary as arrays. Symbols are piece ids, and one id more for each
    character of a piece that is no piece itself."""

    def __init__(self, path: str):
        p = self.p = pieces(path)
        ids = dict(p.ids)
        for piece in p.ids:
            for c in piece:
                ids.setdefault(c, len(p.text) + len(ids))
        self.size = max(ids.values()) + 1
        self.char = np.full(0x110000, -1, np.int32)
        for t, i in ids.items():
            if len(t) == 1:
                self.char[ord(t)] = i
        pairs = sorted((ids[t[:k]] * self.size + ids[t[k:]], i, p.score[t]) for t, i in p.ids.items()
                       for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids)
        self.pair = np.array([x for x, _, _ in pairs], np.int64)
        self.joined = np.array([x for _, x, _ in pairs] + [0], np.int64)
        self.score = np.array([x for _, _, x in pairs] + [-np.inf], np.float32)
        # a pair's place by its key's hash; keys whose slot another one took are searched for
        slot = self.slot(self.pair)
        self.at = np.zeros(1 << SLOT_BITS, np.int32)
        self.at[slot] = np.arange(len(slot))
        self.shared = np.zeros(1 << SLOT_BITS, bool)
        self.shared[slot[self.at[slot] != np.arange(len(slot))]] = True
        self.byte_id = np.array([p.byte_id.get(b, p.unknown) for b in range(256)], np.int64)
        out = [bytes([p.byte[i]]) if i in p.byte else (t or "").replace(SPACE, " ").encode() for i, t in enumerate(p.text)]
        out[p.unknown] = " ⁇ ".encode()
        self.out, self.out_start, self.out_size = self.flat(out)
        self.num, self.num_start, self.num_size = self.flat([b"%d " % i for i in range(len(p.text))])

    @staticmethod
    def flat(parts: list[bytes]):
        size = np.array([len(x) for x in parts], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size

    def best(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pairs' places in the pair table (its last place: no piece)."""
        none = len(self.pair)
        if not none:
            return np.zeros(len(left), np.int64)
        key = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        slot = self.slot(key)
        at = self.at[slot].astype(np.int64)
        other = np.flatnonzero(self.shared[slot])
        at[other] = np.minimum(np.searchsorted(self.pair, key[other]), none - 1)
        return np.where(self.pair[at] == key, at, none)

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(_BASE)) >> np.uint64(64 - SLOT_BITS)

    def merged(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge chunks (symbols one after another, chunk sizes): chunk, symbol
        and first place of every symbol that is left, in order."""
        chunk, place = np.repeat(np.arange(len(size)), size), np.arange(len(sym))
        done = []
        pair = np.full(len(sym), len(self.pair))
        inner = np.flatnonzero(chunk[1:] == chunk[:-1])
        pair[inner] = self.best(sym[inner], sym[inner + 1])
        while len(sym):
            score = self.score[pair]
            first = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
            top = np.maximum.reduceat(score, first)
            count = np.diff(np.append(first, len(sym)))
            over = np.repeat(np.isneginf(top), count)
            if over.any():
                done.append((chunk[over], sym[over], place[over]))
                go = ~over
                chunk, sym, place, pair, score = chunk[go], sym[go], place[go], pair[go], score[go]
                top, count = top[~np.isneginf(top)], count[~np.isneginf(top)]
                if not len(sym):
                    break
            at = np.flatnonzero(score == np.repeat(top, count))
            at = at[np.concatenate(([True], chunk[at[1:]] != chunk[at[:-1]]))]  # the leftmost
            sym[at] = self.joined[pair[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            pair[at] = pair[at + 1]
            chunk, sym, place, pair = chunk[stay], sym[stay], place[stay], pair[stay]
            at = at - np.arange(len(at))
            for k in (at - 1, at):  # pairs with the new symbol
                k = k[k >= 0]
                k = k[k + 1 < len(sym)]
                k = k[chunk[k] == chunk[k + 1]]
                pair[k] = self.best(sym[k], sym[k + 1])
        if not done:
            return (np.zeros(0, np.int64),) * 3
        chunk, sym, place = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place, kind="stable")
        return chunk[order], sym[order], place[order]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (end ids included), and each text's number of ids."""
        p = self.p
        marked = [p.marked(t) for t in texts]
        length = np.fromiter(map(len, marked), np.int64, len(marked))
        points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(length)
        lead = points == ord(SPACE) if p.chunked else np.zeros(len(points), bool)
        begin = lead & ~np.concatenate(([False], lead[:-1])) if len(points) else lead
        begin = begin.copy()
        begin[(ends - length)[length > 0]] = True
        start = np.flatnonzero(begin)
        size = np.diff(np.append(start, len(points)))
        # equal chunks are merged once
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * C._powers(_BASE, len(points))[:len(points)], out=sums[1:])
        key = (sums[start + size] - sums[start]) * C._powers(pow(_BASE, -1, 1 << 64), len(points) + 1)[start]
        _, where, which = np.unique(C.mix(key) ^ C.mix(size.astype(np.uint64)), return_index=True, return_inverse=True)
        n = size[where]
        short = n <= LONG
        flat = ragged(start[where[short]], n[short], points)
        chunk, sym, place = self.merged(self.char[flat].astype(np.int64), n[short])
        chunk = np.flatnonzero(short)[chunk]
        own = (sym >= 0) & (sym < len(p.text))
        parts = [(chunk[own], place[own], np.zeros(int(own.sum()), np.int64), sym[own])]
        if not own.all():  # characters without a piece
            parts.append(self.bytes_of(chunk[~own], place[~own], flat[place[~own]]))
        for c in np.flatnonzero(~short):
            ids = np.array(p.chunk_ids(points[start[where[c]]:start[where[c]] + n[c]].tobytes().decode("utf-32-le")))
            parts.append((np.full(len(ids), c), np.arange(len(ids)), np.zeros(len(ids), np.int64), ids))
        chunk, place, sub, ids = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((sub, place, chunk))
        ids = ids[order]
        count = np.bincount(chunk, minlength=len(n)) if len(n) else np.zeros(0, np.int64)
        first = np.cumsum(count) - count
        each = count[which]
        tokens = ragged(first[which], each, ids)
        # per text, and an end id behind each
        total = np.concatenate(([0], np.cumsum(each)))
        text_end = total[np.searchsorted(start, ends, side="left")]
        return np.insert(tokens, text_end, p.end), np.diff(np.concatenate(([0], text_end))) + 1

    def bytes_of(self, chunk: np.ndarray, place: np.ndarray, points: np.ndarray):
        """The byte pieces (else the unknown one) of characters."""
        if not self.p.byte_id:
            return chunk, place, np.zeros(len(points), np.int64), np.full(len(points), self.p.unknown)
        raw = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)
        size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        sub = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(chunk, size), np.repeat(place, size), sub, self.byte_id[raw]

    def spelled(self, ids: np.ndarray) -> bytes:
        """Decimal ids, a space behind each."""
        return ragged(self.num_start[ids], self.num_size[ids], self.num).tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of one row's ids in UTF-8."""
        raw = ragged(self.out_start[ids], self.out_size[ids], self.out).tobytes()
        try:
            raw.decode("utf-8")
        except UnicodeDecodeError:  # byte pieces that spell no character
            return self.p.decode(ids.tolist()).encode()
        said = ids[(ids != self.p.end)][:1]
        if self.p.prefix and len(said) and raw.startswith(b" ") and self.p.text[said[0]] is not None:
            return raw[1:]
        return raw


@lru_cache(maxsize=2)
def tables(path: str) -> Tables:
    return Tables(path)


def coded(batches, model: str, check: int):
    """(slice of a batch, texts, ids, ids per text, agrees) of all slices."""
    t = tables(model)
    lib = t.p.library
    for b in C.slices(batches, "text", SLICE):
        texts = C.strings(b, "text")
        ids, count = t.encode(texts)
        ends = np.cumsum(count)
        agrees: list = [None] * len(texts)
        at = [k for k, text in enumerate(texts) if check == 1 or zlib.crc32(text.encode()) % check == 0]
        theirs = lib.encode([texts[k] for k in at], add_eos=True, num_threads=1)
        for k, their, said in zip(at, theirs, lib.decode(theirs, num_threads=1) if at else ()):
            own = ids[ends[k] - count[k]:ends[k]]
            agrees[k] = own.tolist() == their and t.decode(own).decode() == said
        yield b, t, ids, ends - count, ends, agrees


def encode_decode(docs: DataFrame, model: str, check: int = CHECK) -> DataFrame:
    """Per row: doc_id, n_tokens (end id included), digests of the ids and of
    the decoded text, and whether the library agreed."""

    def run(batches):
        for b, t, ids, start, end, agrees in coded(batches, model, check):
            ids_hash, out_hash = [], []
            for i, j in zip(start, end):
                digest = hashlib.sha256()
                for k in range(i, j, TOKENS):
                    part = t.spelled(ids[k:min(j, k + TOKENS)])
                    digest.update(part[:-1] if k + TOKENS >= j else part)
                ids_hash.append(digest.hexdigest())
                out_hash.append(hashlib.sha256(t.decode(ids[i:j])).hexdigest())
            yield C.record(b, ["doc_id"], n_tokens=end - start, ids_sha256=ids_hash, decoded_sha256=out_hash,
                           agrees=pa.array(agrees, pa.bool_()))

    return C.mapped(docs.select("doc_id", "text"), run, SCHEMA)


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """Per row: doc_id, the token ids (end id last) and the decoded text."""

    def run(batches):
        for b, t, ids, start, end, _ in coded(batches, model, CHECK):
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(ids)).astype(np.int32)),
                                             pa.array(ids.astype(np.int32)))
            yield C.record(b, ["doc_id"], ids=lists,
                           decoded=[t.decode(ids[i:j]).decode() for i, j in zip(start, end)])

    return C.mapped(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, decoded string")


def op1(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(C.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
