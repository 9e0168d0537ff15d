r"""Operator 10: line dedup by a fixed-depth log-template tree.

Lines are parsed like log messages: the tree's first level is the number of
tokens, the next ones are the ``LEAD`` leading tokens, and a leaf holds
templates. Tokens with digits are variable fields (``<*>``), but for lines of
``LEAD`` tokens or fewer, whose template is the exact line. Behind the leading
tokens a leaf's templates are the line itself and, for lines of ``GENERAL``
tokens or more, the line with one of its ``SEGMENTS`` parts as a variable field,
so that lines which differ in one place only fall under one template. Templates
are known by 64-bit hashes; a line of fewer than ``LEAST`` tokens, that is a
blank one, has none.

A template recurs if it stands in ``DOCS`` different texts or more (equal texts
count as one). Its lines are dropped but for the first text that has it (by
smallest doc_id, then line), so nothing is lost from the corpus as a whole. All
is done with DataFrame functions. Rows that are counted are numbers only;
counting pre-aggregates per task, so a hot line costs one row per task. What
recurs is joined by broadcast below ``BOUND`` rows (counted), else by a shuffle.

Defined cases: a null text stays null, an empty one stays empty; a document
whose lines all go keeps an empty text; a null doc_id comes last; repeated rows
are equal texts; extra columns are kept by ``without_recurring`` unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.llm import common as C

LEAD, SEGMENTS, LEAST, GENERAL, DOCS, BOUND = 3, 4, 1, 12, 2, 500_000
LAST = 2 ** 63 - 1


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text."""
    return [F.xxhash64(text).alias("__t1__"), F.xxhash64(F.lit(1), text).alias("__t2__")]


def line_rows(docs: DataFrame) -> DataFrame:
    """(text key, doc_id, line number, template) of every line and template."""
    line = F.trim(F.col("line"))
    long = F.size(F.split(line, " ")) > LEAD
    free = F.regexp_replace(line, r"[^ \t]*[0-9][^ \t]*", "<*>")
    # a line of numbers alone (a row of a table) has no constant token: it stands for itself
    masked = F.when(long & line.rlike("[0-9]") & F.replace(free, F.lit("<*>"), F.lit("")).rlike(r"\S"), free).otherwise(line)
    rows = (docs.where(F.col("text").isNotNull())
            .select(*text_key(F.col("text")), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"),
                    F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .where(F.col("line").rlike(r"\S"))
            .select("__t1__", "__t2__", "doc_id", "pos", F.split(masked, " ").alias("tok"))
            .withColumn("size", F.size("tok")).where(F.col("size") >= LEAST))
    rest = F.greatest(F.col("size") - LEAD, F.lit(0))
    part = F.ceil(rest / SEGMENTS).cast("int")
    segment = [F.xxhash64(F.slice("tok", F.lit(LEAD + 1) + i * part, part)) for i in range(SEGMENTS)]
    rows = rows.select("__t1__", "__t2__", "doc_id", "pos", "size",
                       F.xxhash64("size", F.slice("tok", 1, LEAD)).alias("leaf"),
                       *(s.alias(f"s{i}") for i, s in enumerate(segment)))
    keys = [F.xxhash64("leaf", F.lit(-1), *(f"s{i}" for i in range(SEGMENTS)))]
    keys += [F.xxhash64("leaf", F.lit(i), *(f"s{j}" for j in range(SEGMENTS) if j != i)) for i in range(SEGMENTS)]
    made = F.when(F.col("size") >= GENERAL, F.array(*keys)).otherwise(F.array(keys[0]))
    return rows.select("__t1__", "__t2__", "doc_id", "pos", made.alias("keys"))


def bounded(df: DataFrame, values: Column | None = None) -> DataFrame:
    """``df`` for a join: broadcast if it has few rows, or few ``values`` in all."""
    if df.limit(BOUND + 1).count() > BOUND:
        return df
    if values is not None and (df.agg(F.sum(values)).first()[0] or 0) > 4 * BOUND:
        return df
    return F.broadcast(df)


def recurring_lines(docs: DataFrame) -> DataFrame:
    """(text key, __drop__): line numbers that go, of every text that has some."""
    lines = C.cut(line_rows(docs))
    flat = lines.select("__t1__", "__t2__", "doc_id", "pos", F.explode("keys").alias("key"))
    # in fewer than DOCS lines, or in one text only: can't recur
    often = C.cut(flat.groupBy("key").agg(F.count("*").alias("n"), F.min("__t1__").alias("lo"),
                                          F.max("__t1__").alias("hi"))
                  .where((F.col("n") >= DOCS) & (F.col("lo") != F.col("hi"))).select("key"))
    seen = C.cut(flat.join(bounded(often), "key").groupBy("key", "__t1__", "__t2__")
                 .agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.collect_set("pos").alias("all")))
    first = (seen.groupBy("key").agg(F.count("*").alias("texts"),
                                     F.min(F.struct("at", "__t1__", "__t2__")).alias("first"))
             .where(F.col("texts") >= DOCS).select("key", "first"))
    here = (F.col("first.__t1__") == F.col("__t1__")) & (F.col("first.__t2__") == F.col("__t2__"))
    gone = (seen.join(bounded(C.cut(first)), "key")
            .select("__t1__", "__t2__", F.explode("all").alias("pos"), "first", here.alias("here"))
            .where(~F.col("here") | (F.col("pos") != F.col("first.at.pos"))))
    return gone.groupBy("__t1__", "__t2__").agg(F.collect_set("pos").alias("__drop__"))


def cleaned(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and their names: the text without recurring
    lines, and how many lines went."""
    t1, t2, out, gone, drops = (C.free_name(docs.columns, x) for x in ("t1", "t2", "text", "gone", "drop"))
    drop = C.cut(recurring_lines(docs.select("doc_id", "text"))) \
        .withColumnsRenamed({"__t1__": t1, "__t2__": t2, "__drop__": drops})
    first, second = text_key(F.col("text"))
    rows = docs.withColumns({t1: first, t2: second})
    rows = rows.join(bounded(drop, F.size(drops)), [t1, t2], "left")
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drops))
    text = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return rows.select(*docs.columns, F.when(F.col(drops).isNull(), F.col("text")).otherwise(text).alias(out),
                       F.when(F.col(drops).isNull(), 0).otherwise(F.size(drops)).cast("long").alias(gone)), out, gone


def without_recurring(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns) with the recurring lines cut out of the text, and
    n_chars, if there, counted anew."""
    rows, text, gone = cleaned(docs)
    new = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(gone) == 0, F.col("n_chars")).otherwise(
            F.length(text).cast(docs.schema["n_chars"].dataType))
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def op10(spark, sf_dir: str) -> DataFrame:
    """Per row: doc_id, lines, lines dropped, digest of the remaining text."""
    rows, text, gone = cleaned(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.col(gone).alias("n_dropped"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_sha256"))
