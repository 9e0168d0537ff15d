"""Operator 6: quality by nearest-neighbour voting.

Words are hashed into term buckets, word shapes and ranges of simple text
statistics are terms too. Document counts of all terms come from one pass over
all documents (an array of fixed length per partition, summed). A bounded
sample of labelled documents, outside the held-out fold, is weighted by tf-idf
and reduced by a truncated SVD; its latent vectors are broadcast (at most
``SAMPLE`` x ``DIMS`` floats). Every document's cosine with each of them is
computed exactly in blocks of rows, and the labels of the ``K`` nearest vote
with weight similarity**``POWER``.

Labels, lang, source and doc_id are no inputs of a score.

Defined cases: a null or empty text has statistic terms only and is scored by
them; a zero vector gets the sample's share of label 1, as does everything if
there are no labels (0.5 then); equal similarities count alike through their
weights, ties at the K-th place are cut by the partition's fixed order; repeated rows
give repeated results; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm import common as C

SAMPLE, DIMS, K, POWER, BLOCK, ROWS, CUT = 4_000, 48, 15, 4, 1024, 512, 0.3
WORDS, SHAPES, RANGES = 2048, 128, 10
STATS = 8
TERMS = WORDS + SHAPES + STATS * RANGES
#: how much a word, shape or statistic term weighs in a document's vector
WEIGHT = np.concatenate([np.full(WORDS, 0.35), np.full(SHAPES, 1.0), np.full(STATS * RANGES, 1.0)]).astype(np.float32)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_CLASS = np.array([1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b >= 128 else 3 if 48 <= b <= 57 else
                   32 if b == 32 or 9 <= b <= 13 else b for b in range(256)], np.uint8)


def terms(texts: list[str]) -> np.ndarray:
    """Counts of all terms, a row per text (call it with at most ``ROWS`` texts).

    A word is a run of letters and digits in lower case; the shape of a
    white-space token is its sequence of character classes without repeats.
    """
    raws = [t.encode("utf-8") for t in texts]
    buf, at = C.joined(raws)
    words, starts, _ = C.run_hashes(buf.translate(C.WORD_BYTES))
    cut = np.searchsorted(starts, at)
    n = np.diff(cut)
    row = np.arange(len(raws)) * TERMS
    out = np.bincount(np.repeat(row, n) + (words % np.uint64(WORDS)).astype(np.int64), minlength=len(raws) * TERMS)
    cls = _CLASS[np.frombuffer(buf, np.uint8)]
    change = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
    shapes, place, _ = C.run_hashes(cls[change].tobytes())
    tokens = np.diff(np.searchsorted(change[place], at))
    out += np.bincount(np.repeat(row, tokens) + WORDS + (shapes % np.uint64(SHAPES)).astype(np.int64),
                       minlength=len(raws) * TERMS)
    out = out.reshape(len(raws), TERMS)
    for i, raw in enumerate(raws):
        own = words[cut[i]:cut[i + 1]]
        for k, r in enumerate(ranges(raw, int(tokens[i]), own)):
            out[i, WORDS + SHAPES + RANGES * k + r] = 1
    return out


def ranges(raw: bytes, n: int, words: np.ndarray) -> list[int]:
    """Ranges (0 to RANGES - 1) of the text's statistics: words, marks, upper
    case, digits, repeated words, words that echo the one before, repeated
    lines, bars."""
    if not n:
        return [0] * STATS
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = max(1, len(raw) - int(hist[9:14].sum() + hist[32]))
    level = lambda share: min(RANGES - 1, 1 + int(8 * min(1.0, share) ** 0.5))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ordered = np.sort(words)
    distinct = min(1, len(ordered)) + int((ordered[1:] != ordered[:-1]).sum())
    echo = int((words[1:] == words[:-1]).sum())
    upper, digits = int(hist[65:91].sum()), int(hist[48:58].sum())
    marks = chars - digits - upper - int(hist[97:123].sum() + hist[128:].sum())
    return [min(RANGES - 1, 1 + int(np.log2(n) / 1.7)), level(marks / chars), level(upper / chars),
            level(digits / chars), level(1 - distinct / max(1, len(words))), level(echo / n), level(1 - len(set(lines)) / len(lines)),
            level(hist[124] / n)]


def blocks(batches, column: str = "text"):
    """Slices of at most ``ROWS`` rows."""
    for b in C.slices(batches, column):
        for start in range(0, b.num_rows, ROWS):
            yield b.slice(start, ROWS)


def document_counts(docs: DataFrame) -> np.ndarray:
    """In how many documents each term occurs, and the number of documents:
    a fixed-length row of counts per partition, summed in Spark."""

    def run(batches):
        df, n = np.zeros(TERMS + 1, np.int64), 0
        for b in blocks(batches):
            df[:TERMS] += (terms(C.strings(b, "text")) > 0).sum(0)
            df[TERMS] += b.num_rows
            n += b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(df)], ["term", "n"])

    rows = (C.mapped(docs.select("text"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")))
    out = np.zeros(TERMS + 1, np.int64)
    for r in rows.collect():  # TERMS + 1 rows
        out[r.term] = r.n
    return out


def weights(counts: np.ndarray) -> np.ndarray:
    return (WEIGHT * np.log((1 + counts[TERMS]) / (1 + counts[:TERMS]) + 0.5)).astype(np.float32)


def weighted(texts: list[str], idf: np.ndarray) -> np.ndarray:
    counts = terms(texts)
    return np.log1p(counts, dtype=np.float32) * idf


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def latent(m: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Right singular vectors of a matrix of unit rows (randomised, fixed seed)."""
    rng = np.random.default_rng(7)
    q = m @ rng.standard_normal((m.shape[1], min(dims + 16, len(m)))).astype(np.float32)
    for _ in range(3):
        q = m @ (m.T @ np.linalg.qr(q)[0])
    q = np.linalg.qr(q)[0]
    return np.ascontiguousarray(np.linalg.svd(q.T @ m, full_matrices=False)[2][:dims].T.astype(np.float32))


def vote(vectors: np.ndarray, known: np.ndarray, label: np.ndarray, k: int = K) -> np.ndarray:
    """Similarity-weighted share of label 1 among the k nearest known vectors."""
    out = np.full(len(vectors), float(label.mean()) if len(label) else 0.5)
    k = min(k, len(label))
    for s in range(0, len(vectors), BLOCK):
        sim = vectors[s:s + BLOCK] @ known.T
        if not k:
            break
        near = np.argpartition(sim, len(label) - k, axis=1)[:, len(label) - k:]
        w = np.maximum(np.take_along_axis(sim, near, 1), 0).astype(np.float64) ** POWER
        total = w.sum(1)
        ok = total > 0
        out[s:s + BLOCK][ok] = ((w * label[near]).sum(1)[ok] / total[ok])
    return np.clip(out, 0, 1)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    lab = C.sampled_labels(labels, "quality", sample, learn_only=True)
    got = (docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id")
           .select("label", F.col("text"), F.xxhash64("doc_id").alias("h")).orderBy("h", "text").limit(sample))
    counts = document_counts(docs)
    idf = weights(counts)
    rows, label, part = [np.zeros((0, TERMS), np.float32)], [], []
    for r in got.toLocalIterator():  # bounded by the sample; vectors are kept, not the texts
        label.append(r.label)
        part.append(r.text or "")
        if len(part) == 64:
            rows.append(weighted(part, idf))
            part = []
    if part:
        rows.append(weighted(part, idf))
    label = np.array(label, np.float64)
    known = unit(np.concatenate(rows))
    basis = latent(known) if len(label) > 1 else np.zeros((TERMS, 1), np.float32)
    known = unit(known @ basis)
    model = spark.sparkContext.broadcast((idf, basis, known, label))

    def run(batches):
        idf, basis, known, label = model.value
        for b in blocks(batches):
            s = vote(unit(weighted(C.strings(b, "text"), idf) @ basis), known, label)
            yield C.record(b, ["doc_id", "held_out"], score=s, predicted=pa.array((s >= CUT).astype(np.int32)))

    rows = docs.select("doc_id", C.held_out("doc_id").alias("held_out"), "text")
    return C.mapped(rows, run, SCHEMA)


def op6(spark, sf_dir: str) -> DataFrame:
    return score(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
