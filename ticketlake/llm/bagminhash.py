"""Operator 9: near-duplicates by BagMinHash signatures.

A document is the multiset of its ``SHINGLE``-word shingles (a shorter one has
a single shingle, all its words). Its signature is unbiased for the weighted
Jaccard similarity of multisets: every shingle carries a Poisson process over
its weight, hierarchically split at the discrete levels 1, 2, 4, 8, ...: each
block between levels has a process of its own (rate: the block's width), and a
weight that ends inside a block keeps those of its points that lie below, so
two documents share the points of the smaller weight. Points come in ascending
order, each falls on one of ``SLOTS`` slots, a slot keeps its first point, and
a shingle stops once its next point lies behind the document's last slot.

Links are looked for as follows.

1. Texts that are equal are one node (by the 128 bits of the text's MD5).
2. ``BANDS`` bands of ``ROWS`` slots give each node its bucket keys; at a
   similarity of 0.8 two nodes share no bucket with probability 0.0001.
3. Rounds. Every bucket has a leader: the node with the least rank, which is
   its mass of shingles that no other node of the large buckets has (0 outside
   large ones), then its key. First every node is compared with one leader, the
   least-ranked of all its buckets, so a round has as many pairs as nodes however
   large a group of copies is, and nearly all copies fall into one class. Then
   only nodes are compared whose classes differ: a node with the leaders of its
   other buckets, and the nodes of a bucket of up to ``SMALL`` with each other.
   At last, in a larger bucket, a node that isn't linked to the leader meets the
   nodes of other classes, but for pairs whose similarity the masses of their
   unshared shingles or the triangle inequality of the Jaccard distance through
   the leader prove to be below the threshold, or of whose slots less than
   ``AGREE`` are equal, which happens to a pair of similarity 0.8 with probability
   0.00005. So no group is expanded into all pairs, and two classes stay apart
   wrongly as rarely as the bands themselves miss a pair.
4. Every candidate is verified exactly by its texts' multisets. A leader's text
   is copied per ``SHARE`` of its pairs, so no task has all pairs of one leader.
5. Classes are connected components (large-star, small-star); their tables
   stay in Spark, lineage is cut by tables in the shared folder.

Defined cases: a null text counts as empty; texts without words have no
shingles and are near-duplicates of equal texts only; a class's id is its
smallest doc_id (null if it has none); repeated rows belong to one class, and
one row of a class stays, the first by doc_id (nulls last); extra columns are
kept by ``one_of_each`` and not read by ``classes``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.llm import common as C

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
SLOTS = 2 * BANDS * ROWS  # the first half makes the bands, all tell how far two nodes agree
SMALL = 24
AGREE = 0.70
EPS = 1e-9
SHARE = 256   # pairs per copy of a leader's text
HOT = 10_000  # a node with more than this part of all rows is joined by broadcast; there are fewer than HOT such
NODE = "node binary, n long, bands array<long>, marks array<tinyint>"


def shingles(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count), sorted by text."""
    h, counts = C.word_hashes(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    doc = np.repeat(np.arange(len(texts)), counts)
    code = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        code = C.mix(code + h[k:k + len(code)])
    at = np.flatnonzero(np.arange(len(code)) + size <= ends[doc[:len(code)]]) if len(code) else np.zeros(0, np.int64)
    docs, codes = [doc[at]], [code[at]]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        whole = np.zeros(1, np.uint64)
        for x in h[starts[i]:ends[i]]:
            whole = C.mix(whole + x)
        docs.append(np.array([i]))
        codes.append(whole ^ np.uint64(counts[i]))
    doc, code = np.concatenate(docs), np.concatenate(codes)
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))) \
        if len(code) else np.zeros(0, np.int64)
    return doc[first], code[first], np.diff(np.append(first, len(code)))


def signatures(n_docs: int, doc: np.ndarray, code: np.ndarray, weight: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Per document and slot the mark of its first point (rows of documents
    without shingles stay 0)."""
    # blocks of the weight axis: [0, 1], [1, 2], [2, 4], [4, 8], ...
    parts = [(doc, C.mix(code), np.ones(len(doc)), np.ones(len(doc), np.int64), weight * 0 + 1)]
    level, low = 1, 1
    while len(big := np.flatnonzero(weight > low)):
        width = low
        parts.append((doc[big], C.mix(code[big] + np.uint64(level * 0xD6E8FEB86659FD93 % 2 ** 64)),
                      np.full(len(big), float(width)), np.full(len(big), width),
                      np.minimum(weight[big] - low, width)))
        low, level = low * 2, level + 1
    at, seed, rate, cells, keep = (np.concatenate(x) for x in zip(*parts))
    first = np.full(n_docs * slots, np.inf)
    mark = np.zeros(n_docs * slots, np.uint64)
    x = np.zeros(len(at))
    live = np.arange(len(at))
    step = 0
    while len(live):
        r = C.mix(seed[live] + np.uint64((step + 1) * 0xA0761D6478BD642F % 2 ** 64))
        x[live] -= np.log(C.uniform(r)) / rate[live]
        place = C.mix(r)
        slot = at[live] * slots + (place % np.uint64(slots)).astype(np.int64)
        inside = ((place >> np.uint64(20)) % cells[live].astype(np.uint64)).astype(np.int64) < keep[live]
        s, v, m = slot[inside], x[live][inside], r[inside]
        np.minimum.at(first, s, v)
        won = first[s] == v
        mark[s[won]] = m[won]
        step += 1
        if step % 4 == 1 or step < 8:
            last = first.reshape(n_docs, slots).max(1)
            live = live[x[live] < last[at[live]]]
    return mark.reshape(n_docs, slots)


def similarity(a: str, b: str) -> float:
    """Weighted Jaccard similarity of two texts' shingle multisets."""
    doc, code, n = shingles([a, b])
    x, y = doc == 0, doc == 1
    _, i, j = np.intersect1d(code[x], code[y], assume_unique=True, return_indices=True)
    both = int(np.minimum(n[x][i], n[y][j]).sum())
    total = int(n.sum()) - both
    return both / total if total else 0.0


def node_of(text: Column) -> Column:
    return F.unhex(F.md5(text))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with the text's node."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), node_of(text).alias("node"))


def nodes(docs: DataFrame) -> DataFrame:
    """One row per distinct text that has words: node, its mass, its bucket keys."""

    def run(batches):
        for b in C.slices(batches, "text"):
            texts = C.strings(b, "text")
            doc, code, n = shingles(texts)
            mark = signatures(len(texts), doc, code, n)
            key = np.full((len(texts), BANDS), np.uint64(7)) + np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                key = C.mix(key + mark[:, r:BANDS * ROWS:ROWS])
            mass = np.bincount(doc, n, len(texts)).astype(np.int64)
            have = pa.array(mass > 0)
            yield C.record(b, ["node"], n=mass, bands=listed(key.view(np.int64)),
                           marks=listed((mark >> np.uint64(56)).astype(np.uint8).view(np.int8))).filter(have)

    rows = C.mapped(docs.select("node", "text"), run, NODE)
    # equal texts have equal rows; of a large group one row per task is shuffled
    return rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "bands", "marks")))


def listed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.ravel()))


def texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes, one row each."""
    return C.cut(docs.select("node", "text").join(C.bounded(wanted), "node", "left_semi")
                 .groupBy("node").agg(F.first("text").alias("text")))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, sim) of distinct candidate pairs of nodes, ``a`` perhaps a leader of many."""
    pairs = C.cut(pairs.distinct())
    many = (pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > SHARE)
            .select("a", F.ceil(F.col("n") / SHARE).cast("int").alias("copies")))
    many = C.cut(many)
    pairs = (pairs.join(C.bounded(many), "a", "left")
             .withColumn("copy", F.pmod(F.hash("b"), F.coalesce("copies", F.lit(1)))).drop("copies"))
    left = (texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
            .join(pairs.select("a", "copy").distinct(), "a"))
    rows = (pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
            .join(left, ["a", "copy"]).select("a", "b", "text_a", "text_b", (
                F.octet_length("text_a") + F.octet_length("text_b")).alias("bytes")))

    def run(batches):
        for batch in batches:
            for b in by_bytes(batch, np.asarray(batch.column(batch.schema.get_field_index("bytes")), np.int64)):
                sim = [similarity(x, y) for x, y in zip(C.strings(b, "text_a"), C.strings(b, "text_b"))]
                yield C.record(b, ["a", "b"], sim=pa.array(sim, pa.float64()))

    return C.mapped(rows, run, "a binary, b binary, sim double")


def by_bytes(batch: pa.RecordBatch, size: np.ndarray):
    """Runs of rows of at most ``C.SLICE_BYTES`` in all (one row at least)."""
    total, at = np.cumsum(size), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + C.SLICE_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


def own_mass(large: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, own): the mass of a node's shingles that no other node of
    ``large`` (distinct nodes) has."""

    def run(batches):
        for b in C.slices(batches, "text"):
            doc, code, n = shingles(C.strings(b, "text"))
            yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(doc)), pa.array(code.view(np.int64)),
                                              pa.array(n.astype(np.int64))], ["node", "shingle", "n"])

    texts = texts.join(C.bounded(C.cut(large)), "node", "left_semi")
    return (C.mapped(texts, run, "node binary, shingle long, n long")
            .groupBy("shingle").agg(F.count("*").alias("nodes"), F.min("node").alias("node"), F.sum("n").alias("n"))
            .where("nodes = 1").groupBy("node").agg(F.sum("n").alias("own")))


def rooted(rows: DataFrame, root: DataFrame, key: str, out: str) -> DataFrame:
    """``rows`` with the class so far of the node in ``key`` (its own without links)."""
    return (rows.join(root.select(F.col("node").alias(key), F.col("root").alias(out)), key, "left")
            .withColumn(out, F.coalesce(out, key)))


def linked(node: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) of the nodes of classes of several nodes, by verified links."""
    band = node.select("node", "n", F.posexplode("bands").alias("band", "key")) \
        .select("node", "n", "band", F.xxhash64("band", "key").alias("bucket"))
    sizes = band.groupBy("bucket").agg(F.count("*").alias("size"), F.min("n").alias("least")).where("size > 1")
    member = C.cut(band.join(sizes, "bucket"))
    # the texts of all nodes that share a bucket, fetched once
    texts = texts_of(C.cut(member.select("node").distinct()), docs)
    crowd = member.where(F.col("size") > SMALL).select("node").distinct()
    own = own_mass(crowd, texts)
    member = C.cut(member.join(crowd.withColumn("crowd", F.lit(True)).join(own, "node", "left"), "node", "left")
                   .withColumn("own", F.coalesce("own", F.lit(0))).drop("crowd"))
    leader = member.groupBy("bucket").agg(F.min(F.struct("own", "node")).alias("lead"))
    led = C.cut(member.join(leader, "bucket").select(*member.columns, "lead"))
    follower = led.where(F.col("node") != F.col("lead.node"))

    # every node and the least-ranked leader around
    first = follower.groupBy("node").agg(F.min("lead").alias("lead"))
    found = C.cut(verified(first.select(F.col("lead.node").alias("a"), F.col("node").alias("b")), texts))
    # classes so far, as far as two steps from leader to leader tell: they only spare comparisons
    star = C.cut(found.where(F.col("sim") >= THRESHOLD).select(F.col("b").alias("node"), F.col("a").alias("root")))
    root = C.cut(star.join(star.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
                 .select("node", F.coalesce("next", "root").alias("root")))

    # where classes still differ: all leaders around, and the pairs of small buckets
    other = rooted(rooted(follower.select("node", F.col("lead.node").alias("leader")).distinct(), root, "node", "r"),
                   root, "leader", "s").where(F.col("r") != F.col("s")).select(F.col("leader").alias("a"), F.col("node").alias("b"))
    small = C.cut(rooted(member.where(F.col("size") <= SMALL).select("bucket", "node"), root, "node", "r"))
    x, y = (small.select("bucket", F.col("node").alias(k), F.col("r").alias(f"r_{k}")) for k in ("a", "b"))
    near = x.join(y, (x["bucket"] == y["bucket"]) & (F.col("a") < F.col("b")) & (F.col("r_a") != F.col("r_b"))).select("a", "b")
    second = verified(other.unionByName(near).join(found, ["a", "b"], "left_anti"), texts)
    found = C.cut(found.unionByName(second))
    root = C.cut(components(found.where(F.col("sim") >= THRESHOLD)))
    large = led.where(F.col("size") > SMALL)
    if large.isEmpty():
        return root

    # in large buckets, nodes outside the leader's class and nodes of other classes
    sim = found.select(F.col("a").alias("leader"), F.col("b").alias("node"), "sim")
    large = rooted(large.withColumn("leader", F.col("lead.node")).drop("lead").join(sim, ["leader", "node"], "left"), root, "node", "root")
    large = C.cut(rooted(large, root, "leader", "lead_root").join(node.select("node", "marks", "bands"), "node"))
    # the most that a node can share with another one of at least the bucket's least mass
    left = large.where((F.col("root") != F.col("lead_root")) & (
        (F.col("n") - F.col("own")) / (F.greatest("least", F.col("n") - F.col("own")) + F.col("own")) >= THRESHOLD - EPS)) \
        .select("bucket", *(F.col(c).alias(f"{c}_x") for c in ("node", "n", "own", "sim", "root", "marks", "bands")))
    shared = F.least(F.col("n_x") - F.col("own_x"), F.col("n") - F.col("own"))
    # a pair counts in the first bucket that it shares
    earlier = F.size(F.filter(F.zip_with(F.slice("bands_x", 1, F.col("band")), F.slice("bands", 1, F.col("band")),
                                         lambda p, q: p == q), lambda e: e))
    equal = F.size(F.filter(F.zip_with("marks_x", "marks", lambda p, q: p == q), lambda e: e))
    apart = F.coalesce(F.abs(F.col("sim_x") - F.col("sim")) > 1 - THRESHOLD + EPS, F.lit(False))
    rest = left.join(large.withColumnRenamed("bucket", "at"), (F.col("bucket") == F.col("at")) & (
        F.col("root_x") != F.col("root")) & ~apart & (shared / (F.col("n_x") + F.col("n") - shared) >= THRESHOLD - EPS)
        & (equal >= int(AGREE * SLOTS)) & (earlier == 0)) \
        .select(F.least("node_x", "node").alias("a"), F.greatest("node_x", "node").alias("b"))
    far = C.cut(verified(rest, texts).where(F.col("sim") >= THRESHOLD))
    if far.isEmpty():
        return root
    # links between classes: their roots are connected, the other nodes follow
    top = C.cut(components(rooted(rooted(far, root, "a", "x"), root, "b", "y")
                           .select(F.col("x").alias("a"), F.col("y").alias("b"))))
    moved = root.join(top.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left") \
        .select("node", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(top.join(root.select("node"), "node", "left_anti"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of ``edges`` (a, b): the smallest node of each
    connected component, by alternating large-star and small-star steps."""
    e = C.cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours go to the smallest one around
        e = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .where("u != v").distinct())
        # small star: of an edge's larger end, the smaller neighbours and itself go to the smallest
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = C.cut(e.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
            .alias("s")).select("s.*").where("u != v").distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")) \
                .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = now


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keyed documents, and per node of a class of several texts its root."""
    docs = keyed(docs)
    node = C.cut(nodes(docs))
    return docs, C.cut(linked(node, docs))


def classes(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, class_id, class_size, kept."""
    docs, root = grouped(docs)
    node = C.cut(docs.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    linked = node.join(root, "node")
    of = linked.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    # a class of many nodes is one key here: its row goes to parts of its nodes
    part = F.pmod(F.hash("node"), F.lit(64))
    of = of.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(63))))
    linked = linked.withColumn("part", part).join(of, ["root", "part"]).select("node", "class_id", "class_size")
    alone = node.join(root, "node", "left_anti").select("node", F.col("least").alias("class_id"), F.col("n").alias("class_size"))
    known = C.cut(linked.unionByName(alone).join(node.select("node", "n"), "node"))
    many = known.agg(F.sum("n")).first()[0] or 0
    hot = known.where(F.col("n") * HOT > many).drop("n")  # fewer than HOT rows
    rows = docs.select("doc_id", "node").join(F.broadcast(hot), "node", "left")
    done, rest = rows.where("class_size is not null"), rows.where("class_size is null").select("doc_id", "node")
    done = done.unionByName(rest.join(known.where(F.col("n") * HOT <= many).drop("n"), "node"))
    return done.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that are the first of their class."""
    names = docs.columns
    node, key, number = (C.free_name(names, x) for x in ("node", "key", "n"))
    keys, root = grouped(docs)
    # nulls last; a null doc_id shares the key of the largest one, which its node tells apart
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(2 ** 63 - 1))
    pair = C.cut(keys.select("node", order.alias("key")).groupBy("node", "key").agg(F.count("*").alias("n")))
    own = pair.groupBy("node").agg(F.min("key").alias("key"))
    first = C.cut(own.join(root, "node", "left")
                  .groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("key", "node")).alias("m"))
                  .select(F.col("m.key").alias(key), F.col("m.node").alias(node)))
    gone = C.cut(pair.select(F.col("key").alias(key), F.col("node").alias(node)).join(first, [node, key], "left_anti"))
    # the fewer of those that stay and those that go: whole texts are only shuffled if both are many
    keep = first.count() <= gone.count()
    rows = (docs.withColumn(node, node_of(F.coalesce(F.col("text"), F.lit("")))).withColumn(key, order)
            .join(C.bounded(first if keep else gone), [node, key], "left_semi" if keep else "left_anti"))
    if pair.where("n > 1").isEmpty():
        return rows.select(*names)
    # equal rows of a class's first document
    one = Window.partitionBy(node, key).orderBy(F.col("doc_id").asc_nulls_last())
    return rows.withColumn(number, F.row_number().over(one)).where(F.col(number) == 1).select(*names)


def op9(spark, sf_dir: str) -> DataFrame:
    return classes(C.table(spark, sf_dir, "documents"))
