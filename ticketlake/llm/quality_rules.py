r"""Operator 4: quality rules.

Base statistics of the contract and further ones are taken from every whole
text; two base rules (too few words, too much repetition) reject at once. The
verdict on the rest is a gradient-boosted tree ensemble over the statistics,
learned from a bounded sample of labelled documents and flattened into numpy
node arrays, so that a batch of rows walks all trees at once. The score may
never rise with the features of ``FALLING`` (monotonic constraints: a split
that would break one isn't made, and children are bounded by the middle of a
constrained split).

Fixed parameters: at most ``SAMPLE`` labelled rows (the first by a hash of
doc_id), ``TREES`` trees of depth ``DEPTH``, a document passes at a score of
``PASS`` or more.

Defined cases: a null or empty text has no words and fails; without labels of
both kinds the verdict is that of the base rules; repeated rows give repeated
results, ties go to the left branch; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm import common as C

SAMPLE, TREES, DEPTH, BINS, RATE, LEAF, PASS = 12_000, 60, 3, 48, 0.2, 20, 0.5
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
BLANKS = b" \t\n\r\x0b\x0c"
SPACED = bytes(32 if b in BLANKS else b for b in range(256))
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "bars", "shouts",
            "distinct", "top_word", "stops", "words_a_line", "non_ascii", "echoes", "longest_word"]
FALLING = {"symbols", "dup_lines", "repeats", "upper", "bars", "shouts", "top_word", "echoes"}
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, score double")


def repeated(words: np.ndarray) -> np.ndarray:
    """Which words (64-bit hashes) stand in a 3-word window found twice or more."""
    hit = np.zeros(len(words), bool)
    if len(words) < 4:
        return hit
    code = C.mix(C.mix(C.mix(words[:-2]) + words[1:-1]) + words[2:])
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    again = np.zeros(len(code), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    for k in range(3):
        hit[k:len(hit) - 2 + k] |= again
    return hit


def stats(raw: bytes, words: np.ndarray, sizes: np.ndarray) -> tuple[list[int], list[float]]:
    """The base counts and the features of a text from its bytes and its words'
    hashes and sizes in bytes."""
    n = len(words)
    data = np.frombuffer(raw, np.uint8)
    hist = np.bincount(data, minlength=256)
    points = len(data) - int(hist[128:192].sum())  # code points: all but continuation bytes
    chars = points - int(hist[9:14].sum() + hist[32])
    symbols = int(hist[SYMBOLS].sum())
    seen, lines, dup = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip(BLANKS):
            lines += 1
            dup += line in seen
            seen.add(line)
    rep = int(repeated(words).sum())
    base = [n, chars, symbols, dup, rep]
    if not n:
        return base, [0.0] * len(FEATURES)
    c = max(chars, 1)
    ordered = np.sort(words)
    edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
    return base, [float(np.log1p(n)), chars / n, symbols / c, dup / lines, rep / n, hist[65:91].sum() / c,
                  hist[48:58].sum() / c, hist[124] / n, hist[33] / n, (len(edges) - 1) / n, np.diff(edges).max() / n,
                  (hist[46] + hist[44]) / n, n / lines, hist[128:].sum() / c,
                  float((words[1:] == words[:-1]).sum()) / n, float(sizes.max())]


def all_stats(texts: list[str]) -> list[tuple[list[int], list[float]]]:
    raws = [t.encode("utf-8") for t in texts]
    buf, at = C.joined(raws)
    words, starts, sizes = C.run_hashes(buf.translate(SPACED))
    cut = np.searchsorted(starts, at)
    return [stats(raw, words[i:j], sizes[i:j]) for raw, i, j in zip(raws, cut[:-1], cut[1:])]


@dataclass
class Forest:
    """All trees' nodes in flat arrays; a leaf's children are itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] > self.cut[at], self.right[at], self.left[at])
        return 1 / (1 + np.exp(-(self.bias + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, falling: list[bool], trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Newton boosting of the logistic loss over quantile bins."""
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(f)], 1)
    mean = y.mean()
    bias = float(np.log(mean / (1 - mean)))
    total = np.full(n, bias)
    nodes: list[list] = []  # feature, cut, left, right, value
    roots = []

    def grow(rows, g, h, level, low, high):
        me = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + 1), low, high))
        nodes.append([0, np.inf, me, me, RATE * value])
        best = (1e-6, None)
        if level < depth:
            for j in range(f):
                b = binned[rows, j]
                k = len(edges[j]) + 1
                cg = np.cumsum(np.bincount(b, g[rows], k))[:-1]
                ch = np.cumsum(np.bincount(b, h[rows], k))[:-1]
                cn = np.cumsum(np.bincount(b, minlength=k))[:-1]
                vl = np.clip(-cg / (ch + 1), low, high)
                vr = np.clip(-(gs - cg) / (hs - ch + 1), low, high)
                gain = -(cg * vl + .5 * (ch + 1) * vl ** 2) - ((gs - cg) * vr + .5 * (hs - ch + 1) * vr ** 2)
                gain += gs * value + .5 * (hs + 1) * value ** 2
                ok = (cn >= LEAF) & (len(rows) - cn >= LEAF)
                if falling[j]:
                    ok &= vl >= vr
                if ok.any():
                    i = int(np.argmax(np.where(ok, gain, -np.inf)))
                    if gain[i] > best[0]:
                        best = (gain[i], (j, i, vl[i], vr[i]))
        if best[1]:
            j, i, vl, vr = best[1]
            mid = (vl + vr) / 2
            go = binned[rows, j] > i
            bounds = ((mid, high), (low, mid)) if falling[j] else ((low, high), (low, high))
            nodes[me][:2] = [j, float(edges[j][i])]
            nodes[me][2] = grow(rows[~go], g, h, level + 1, *bounds[0])
            nodes[me][3] = grow(rows[go], g, h, level + 1, *bounds[1])
        else:
            total[rows] += RATE * value
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), 0, -4.0, 4.0))
    feature, cut, left, right, value = map(np.array, zip(*nodes))
    return Forest(feature, cut, left, right, value, np.array(roots), bias, depth)


def features(docs: DataFrame) -> DataFrame:
    """Labelled rows' features: label, features."""

    def run(batches):
        for b in C.slices(batches, "text"):
            got = [f for _, f in all_stats(C.strings(b, "text"))]
            yield C.record(b, ["label"], features=pa.array(got, pa.list_(pa.float64())))

    return C.mapped(docs.select("label", "text"), run, "label int, features array<double>")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest | None:
    """The ensemble from at most ``sample`` labelled rows; None without both labels."""
    lab = C.sampled_labels(labels, "quality", sample)
    # the sample is bounded by its parameter, hence the broadcast
    rows = features(docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id"))
    got = rows.limit(2 * sample).toPandas()  # repeated doc_ids can't make it grow
    y = got["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.stack(got["features"].to_numpy())
    order = np.lexsort((*x.T, y))  # the same trees whatever the order of arrival
    return fit(x[order], y[order], [k in FALLING for k in FEATURES])


def judge(texts: list[str], forest: Forest | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    base, feats = zip(*all_stats(texts))
    base = np.array(base, np.int64)
    failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
    score = forest.score(np.array(feats)) if forest else np.ones(len(base))
    return base, failed, ~failed & (score >= PASS), score


def assess(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """One row per document row: base counts, base_failed, kept, score."""

    def run(batches):
        for b in C.slices(batches, "text"):
            base, failed, kept, score = judge(C.strings(b, "text"), forest)
            yield C.record(b, ["doc_id"], **{k: base[:, i] for i, k in enumerate(BASE)},
                           base_failed=failed, kept=kept, score=score)

    return C.mapped(docs.select("doc_id", "text"), run, SCHEMA)


def passed(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The rows of ``docs`` (all columns) that the rules keep."""

    def run(batches):
        for b in C.slices(batches, "text"):
            yield b.filter(pa.array(judge(C.strings(b, "text"), forest)[2]))

    return C.mapped(docs, run, docs.schema)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return assess(docs, learn(docs, C.table(spark, sf_dir, "labels")))
