"""Operators 11 (pair alignment), 12 (fill-in-middle) and 13 (token counts) against plain versions."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import ticketlake.llm.queries as q
from tests.llm.conftest import DOC, SF, rows_of
from ticketlake.llm import fill_in_middle as fim
from ticketlake.llm import pair_alignment as pairs
from ticketlake.llm import token_counts as counts
from ticketlake.llm import units

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "b", " ", "  ", "\n", "\t", " ", "\x1c", "\x85", "ß", "日本", "🙂", "'s", "12", "٣", "<|endoftext|>", "▁",
       "​", "é", "!", "…", "\r\n", "the", " the", "　", "\x00", "é", "<P>", "<S", ">", "<0x41>", "</s>",
       "    ", "ing", "xyz" * 9]
TEXT = st.lists(st.sampled_from(ODD), max_size=25).map("".join) | st.text(st.characters(exclude_categories=["Cs"]), max_size=20)
EDGES = [None, "", " ", "  \n ", "a ", " a", "x" * 3000, "日本語" * 400, "word " * 4000, "a▁b", "<|endoftext|>", "\x00 b"]


def odd_texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choices(ODD, k=r.randint(0, 30))) for _ in range(n)]


# ---- 13 ----

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_op13_counts_as_the_library(library, text):
    assert counts.counter(BYTES).count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_op13_on_documents(spark, documents, library):
    got = {r.doc_id: r for r in q.QUERIES["op13_token_counts"](spark, SF).collect()}
    assert len(got) == len(documents)
    for i, text in documents:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 1024)


def test_op13_edges(spark, library, edges):
    texts = EDGES + odd_texts(300)
    got = counts.token_counts(spark.createDataFrame(rows_of(texts), DOC), BYTES, limit=5).collect()
    for r in got:
        n = len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit) == (n, n > 5)
    assert counts.token_counts(edges, BYTES).count() == edges.count()
    assert counts.token_counts(edges.limit(0), BYTES).count() == 0


def test_op13_long_text_in_stretches(monkeypatch, library):
    text = " ".join(odd_texts(400)).replace("<|endoftext|>", "<|endoftext|> ")
    monkeypatch.setattr(counts, "parts", lambda t: units.parts(t, 50))
    assert sum(1 for _ in units.parts(text, 50)) > 20
    assert counts.Counter(BYTES).count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_op13_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(counts, "MEMO", 10)
    c = counts.Counter(BYTES)
    assert c.count(" ".join(f"w{i}" for i in range(100))) == sum(c.count(f" w{i}" if i else "w0") for i in range(100))
    assert len(c.rest) <= 10


# ---- 12 ----

@given(st.lists(st.booleans(), max_size=300), st.integers(1, 400))
@settings(max_examples=150, deadline=None)
def test_op12_boundaries_select(flags, times):
    flags = np.tile(np.array(flags, bool), times)
    cuts = fim.Boundaries(flags)
    members = np.flatnonzero(flags)
    assert len(cuts) == len(members)
    for k in {*range(min(5, len(members))), len(members) // 2, len(members) - 1} - {-1}:
        assert cuts.select(k) == members[k] if len(members) else True
    assert cuts.select(len(members)) == len(flags)


def test_op12_containers():
    r = np.random.default_rng(1)
    dense, sparse, solid = r.random(fim.SPAN) < 0.5, r.random(fim.SPAN) < 0.01, np.ones(fim.SPAN, bool)
    cuts = fim.Boundaries(np.concatenate([dense, np.zeros(fim.SPAN, bool), sparse, solid]))
    assert [type(c) for c in cuts.containers] == [fim.Bitmap, fim.Array, fim.Runs]
    members = np.flatnonzero(np.concatenate([dense, np.zeros(fim.SPAN, bool), sparse, solid]))
    for k in r.integers(0, len(members), 500):
        assert cuts.select(int(k)) == members[k]


def plain_fim(doc_id, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", i, j - i, f"<S>{text[j:]}<P>{text[:i]}<M>{text[i:j]}"
    return n, "psm", i, j - i, f"<P>{text[:i]}<S>{text[j:]}<M>{text[i:j]}"


@given(TEXT, st.integers(-5, 10 ** 12) | st.none())
@settings(max_examples=300, deadline=None)
def test_op12_as_defined(text, doc_id):
    got = fim.transformed(text.encode(), doc_id)
    n, form, i, m, out = plain_fim(doc_id, text)
    assert got == (n, form, i, m, out.encode())
    assert fim.restored(got[4], form) == text.encode()


@pytest.mark.parametrize("unit", ["word", "line"])
def test_op12_other_units(unit):
    for i, text in enumerate(odd_texts(300)):
        n, form, first, middle, out = fim.transformed(text.encode(), i, unit)
        assert fim.restored(out, form) == text.encode()
        flags = fim.starts(np.frombuffer(text.encode(), np.uint8), unit)
        assert n == flags.sum() and (not text or flags[0])
        if form == "psm":
            prefix = out[3:out.index(b"<S>")]
            assert len(prefix) in {*np.flatnonzero(flags), len(text.encode())}


def test_op12_rows(spark, edges):
    texts = EDGES + odd_texts(200)
    df = spark.createDataFrame(rows_of(texts), DOC)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in fim.digests(df).collect():
        n, form, i, m, out = plain_fim(r.doc_id, texts[r.doc_id])
        assert tuple(r)[1:] == (n, form, i, m, sha(out), sha(texts[r.doc_id] or ""))
    assert {r.output for r in fim.fill_in_middle(df).collect()} == {plain_fim(i, t)[4] for i, t in enumerate(texts)}
    assert fim.digests(edges).count() == fim.fill_in_middle(edges).count() == edges.count()
    assert fim.digests(edges.limit(0)).count() == 0


def test_op12_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet' union all select null, null, null, null, null")
    want = con.execute(q.ORACLE_SQL["op12_fill_in_middle"]).fetchall()
    got = fim.digests(spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(rows_of([None]), DOC)
                      .selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars"), True))
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


# ---- 11 ----

class Plain:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
        self.a.encode_special_tokens = True
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 400))
        self.byte = {chr(b): b for b in own} | {chr(next(rest)): b for b in range(256) if b not in own}

    def groups(self, text):
        """Groups of (A ids, B ids), none if the text has no tokens."""
        if not text:
            return []
        raw = (" " + text).encode()
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i)))
             for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode())
             for i in self.b.encode(text) for p in [self.b.id_to_piece(i)]]
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            return []

        def ends(tokens):
            at = 0
            for i, x in tokens:
                at += len(x)
                yield i, at
        a, b = list(ends(a)), list(ends(b))
        common = sorted({e for _, e in a} & {e for _, e in b})
        out = [([], []) for _ in common]
        for side, tokens in enumerate((a, b)):
            for i, e in tokens:
                out[bisect.bisect_left(common, e)][side].append(i)
        return out


def plain_alignment(texts):
    p = Plain()
    groups = [p.groups(t) for t in texts]
    held = Counter()
    for g in groups:
        held.update({(a, b) for x, y in g for a in x for b in y})
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    for g in groups:
        links = [(a, b) for x, y in g for a in x for b in y]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        yield (sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links),
               sum(held[k] == most[k[0]] for k in links), sum(held[k] for k in links),
               hashlib.sha256(said.encode()).hexdigest() if g else "")


def test_op11_on_documents(spark, documents):
    got = {r.doc_id: tuple(r)[1:] for r in q.QUERIES["op11_pair_alignment"](spark, SF).collect()}
    want = dict(zip([i for i, _ in documents], plain_alignment([t for _, t in documents])))
    assert got == want


def test_op11_edges(spark, edges):
    texts = EDGES + odd_texts(300) + ["same text twice"] * 2
    df = spark.createDataFrame(rows_of(texts), DOC).repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in pairs.alignment(df, BYTES, PIECES).collect()}
    assert got == dict(enumerate(plain_alignment(texts)))
    assert any(x[0] == 0 for x in got.values())
    rows = pairs.alignment(edges, BYTES, PIECES)
    assert rows.count() == edges.count()
    assert {tuple(r)[1:] for r in rows.where("doc_id = 5").collect()} == \
        {tuple(r)[1:] for r in rows.where("doc_id = 6").collect()}
    assert pairs.alignment(edges.limit(0), BYTES, PIECES).count() == 0


def test_op11_trees_blocks_and_flushes(spark, monkeypatch):
    """Several tree levels, several broadcast blocks, early flushes, small expansions and memos give the same."""
    texts = odd_texts(200, 5)
    df = spark.createDataFrame(rows_of(texts), DOC).repartition(7)
    monkeypatch.setattr(pairs, "FAN", 2)
    monkeypatch.setattr(pairs, "BLOCK", 20_000)
    got = {r.doc_id: tuple(r)[1:] for r in pairs.alignment(df, BYTES, PIECES).collect()}
    assert got == dict(enumerate(plain_alignment(texts)))


def test_op11_small_bounds(monkeypatch):
    texts = odd_texts(100, 6)
    p = pairs.Pair(BYTES, PIECES)
    whole = [np.sort(p.keys[p.pair[pairs.ragged(p.start[u], p.size[u])]]) for t in texts for u, _ in [p.aligned(pa.array([t]))]]
    monkeypatch.setattr(pairs, "WIDE", 3)
    monkeypatch.setattr(pairs, "MEMO", 2)
    p = pairs.Pair(BYTES, PIECES)
    for t, w in zip(texts, whole):
        u, _ = p.aligned(pa.array([t]))
        assert np.array_equal(np.sort(p.keys[p.pair[pairs.ragged(p.start[u], p.size[u])]]), w)
    assert len(p.at) < 60


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_op11_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2 ** 62, n))
    h = pairs.PerfectHash.load(pairs.PerfectHash.build(keys).dump())
    assert np.array_equal(np.sort(h.index(keys)), np.arange(len(keys)))
    if n:
        own = np.empty(len(keys), np.int64)
        own[h.index(keys)] = keys
        assert np.array_equal(own[pairs.verified(h, own, keys)], keys)
        with pytest.raises(ValueError):
            pairs.verified(h, own, np.array([2 ** 62 + 5]))
        assert sum(w.nbytes for w in h.words) * 8 < 4 * n + 64 * 45


def test_op11_quick_encoder_equals_the_library(library):
    """All code points beside letters, digits and spaces, and vocabulary entries beside each other."""
    own = Tokenizer.from_file(BYTES)
    own.encode_special_tokens = True
    p = pairs.Pair(BYTES, PIECES)
    assert p.a_encode.__self__.__class__.__module__.startswith("tiktoken")
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f" x{c}1{c}" for c in points[i:i + 500]) for i in range(0, len(points), 500)]
    r = random.Random(4)
    plain = [b.decode() for b in p.a_bytes[:50256] if b.isascii()]
    texts += ["".join(r.choices(plain, k=200)) for _ in range(500)] + odd_texts(2000, 8)
    assert [p.a_encode(t) for t in texts] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
