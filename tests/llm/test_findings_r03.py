"""Findings of round 3: the pipeline within its limits."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa

from ticketlake.llm import bagminhash, common, sentencepiece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")


class Mapped:
    """Stands for a DataFrame: keeps the function that is mapped over its batches."""

    def select(self, *_):
        return self

    def mapInArrow(self, fn, _):
        return fn


def peak_mb(texts):
    """Most memory that a worker allocates over one batch, its vocabulary and caches loaded."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    run = sentencepiece_bpe.encode_decode(Mapped(), PATH)
    list(run(iter([batch.slice(0, 1)])))
    tracemalloc.start()
    try:
        rows = [r for out in run(iter([batch])) for r in out.to_pylist()]
        return tracemalloc.get_traced_memory()[1] / 1e6, rows
    finally:
        tracemalloc.stop()


def test_a_batch_takes_little_memory():
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(5000)]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(1200)]  # 2.9 MB
    peak, rows = peak_mb(texts)
    assert len(rows) == len(texts) and all(r["agrees"] for r in rows)
    assert peak < 60


def test_characters_without_a_piece():
    texts = ["\x00\x01 \x7f", "֐߿ ࠀ龥 ￿", "\U0001f642\U0010ffff a\U0001d54f", "é́ ☃ "]
    t = sentencepiece_bpe.Tables(PATH)
    ids, count = t.encode(texts)
    assert np.split(ids, np.cumsum(count)[:-1])[0].tolist() == t.p.library.encode(texts[0], add_eos=True)
    for own, text in zip(np.split(ids, np.cumsum(count)[:-1]), texts):
        assert own.tolist() == t.p.library.encode(text, add_eos=True) == t.p.encode(text)
    # a vocabulary without byte pieces has the unknown one for each character
    without = SimpleNamespace(p=SimpleNamespace(byte_id={}, unknown=0))
    got = sentencepiece_bpe.Tables.bytes_of(without, np.array([3, 5]), np.array([1, 0]), np.array([233, 0x1F642], np.uint32))
    assert [x.tolist() for x in got] == [[3, 5], [1, 0], [0, 0], [0, 0]]


def test_few_dropped_copies_shuffle_no_texts(spark, monkeypatch):
    """Corpora of which few rows go, and of which few stay: the rows as before, the join by broadcast."""
    def texts(n, first=0):
        return [f"one{first + i} two{i} three{i} four{i} five{i} six{i} seven{i}" for i in range(n)]

    monkeypatch.setattr(common, "BROADCAST_BYTES", 48 * 2 * 30)  # 30 rows of two columns
    null = [(None, texts(1)[0]), (None, None), (None, "x"), (None, "x")]
    for rows in (list(enumerate(texts(100) + texts(3))) + null,
                 list(enumerate(texts(2) * 100)) + null + [(0, texts(1)[0])] * 2):
        docs = spark.createDataFrame([(d, t, "e") for d, t in rows], "doc_id long, text string, extra string")
        out = bagminhash.one_of_each(docs)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert out.columns == docs.columns
        expected = {}
        for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            expected.setdefault(t or "", (d, t, "e"))
        assert sorted(map(tuple, out.collect()), key=str) == sorted(expected.values(), key=str)
        assert "strategy=broadcast" in plan
