r"""Operator 3: secret scan with a random forest against false positives.

Candidates are the runs of ``SHORTEST`` or more characters of
``[A-Za-z0-9+/_-]`` in white-space tokens that hold a digit or an assignment, or
follow a word that ends in ``:`` or ``=``. Every such run of a token is a
candidate with the name that is assigned to it and its neighbours: the runs and
marks around it in its token, else the words around the token. A random forest (Spark ML)
scores each by its length, character classes and their transitions, distinct
characters, dictionary coverage (the share of its letter trigrams that occur in
the corpus' words seen ``COMMON`` times or more), hints that its source is a
path of tests or samples, and the words around it.

The tables have no labelled findings, so findings are labelled by rules that
are certain either way (provider formats and assignments of hexadecimal or
mixed values; numbers, placeholders, plain words); at most ``SAMPLE`` labelled
findings, the first by hash, train the forest. Findings that no rule decides
get the forest's verdict alone.

Everything runs as DataFrame functions and JVM estimators. The dictionary is
bounded by the alphabet (26**3 trigrams), hence its broadcast.

Defined cases: null and empty texts have no findings; without labelled findings
of both kinds the rules decide (probability 1, 0, or 0.5); repeated rows give
repeated findings; nulls in source count as an empty path; extra columns are
not read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm import common as C

SHORTEST, COMMON, SAMPLE, TREES, DEPTH, CUT = 12, 5, 20_000, 24, 6, 0.5
NAMES = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer|private[_-]?key)"
RUN = rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?"
# a run with the name that is assigned to it: {"name":"run", name=run
NAMED = (r"(?:(?<=(?<![A-Za-z0-9_.-])([A-Za-z][A-Za-z0-9_.-]{0,99})[\"'\\]{0,3}[=:]{1,2}>?[\"'\\(\[{]{0,4}))?" + RUN)
ASSIGNED = r"^[\"'(\[{]*([A-Za-z][A-Za-z0-9_.-]*)\s*[=:]+"
FEATURES = ["length", "digits", "uppers", "lowers", "marks", "transitions", "distinct", "hex", "coverage", "sample_path",
            "named", "named_before", "assigned", "quoted", "plain_after"]


def share(value, pattern: str):
    """Share of a value's characters that a class takes out."""
    return 1 - F.length(F.regexp_replace(value, pattern, "")) / F.length(value)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, source, word (position of the token), at (of the run in it), name,
    value, and what stands around it."""
    rows = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("source"), "text") \
        .where(F.col("text").rlike(RUN))  # without a run no token is a candidate
    rows = rows.select("doc_id", "source", F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("w"))
    found = F.filter(
        F.transform("w", lambda t, i: F.struct(
            i.alias("word"), t.alias("token"), F.coalesce(F.get("w", i - 1), F.lit("")).alias("left"),
            F.coalesce(F.get("w", i - 2), F.lit("")).alias("left2"),
            F.coalesce(F.get("w", i + 1), F.lit("")).alias("right"))),
        lambda x: x["token"].rlike(RUN) & (x["token"].rlike("[0-9]") | x["token"].rlike(ASSIGNED)
                                           | x["left"].rlike(r"[=:]$")))
    rows = (rows.select("doc_id", "source", F.inline(found))
            .withColumns({"runs": F.regexp_extract_all("token", F.lit(RUN), 0),
                          "names": F.regexp_extract_all("token", F.lit(NAMED), 1), "gaps": F.split("token", RUN)})
            .select("*", F.posexplode("runs").alias("at", "value")))
    piece = lambda k: F.concat(F.get("runs", k), F.get("gaps", k + 1))  # noqa: E731 - a run and the marks behind it
    at = F.col("at")
    return rows.select(
        "doc_id", "source", "word", "at", "token", "value", F.get("names", at).alias("name"),
        F.when(at == 0, F.col("left")).otherwise(piece(at - 1)).alias("before"),
        F.when(at == 0, F.col("left2")).when(at == 1, F.col("left")).otherwise(piece(at - 2)).alias("before2"),
        F.when(at + 1 < F.size("runs"), F.concat(F.get("gaps", at + 1), F.get("runs", at + 1)))
        .otherwise(F.col("right")).alias("after"))


def dictionary(docs: DataFrame) -> DataFrame:
    """(tri): letter trigrams of the corpus' words seen COMMON times or more."""
    words = (docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w"))
             .where(F.length("w").between(3, 20)).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON))
    return words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2),
                                              lambda i: F.substring("w", i, F.lit(3)))).alias("tri")).distinct()


def featured(found: DataFrame, tri: DataFrame) -> DataFrame:
    """Findings with the forest's features and the rules' label (null: open)."""
    low = F.lower("value")
    letters = F.regexp_replace(low, "[^a-z]", "")
    cover = (found.select("value").distinct()
             .withColumn("l", letters).where(F.length("l") >= 3)
             .select("value", F.explode(F.transform(F.sequence(F.lit(1), F.length("l") - 2),
                                                    lambda i: F.substring("l", i, F.lit(3)))).alias("tri"))
             .join(F.broadcast(tri.withColumn("known", F.lit(1.0))), "tri", "left")
             .groupBy("value").agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("coverage")))
    v = F.col("value")
    classes = F.translate(v, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
                          "a" * 26 + "A" * 26 + "0" * 10)
    flag = lambda c: c.cast("double")
    around = F.concat_ws(" ", "before2", "before")
    rows = found.join(cover, "value", "left").withColumns({
        "length": F.length("value").cast("double"), "digits": share(v, "[0-9]"), "uppers": share(v, "[A-Z]"),
        "lowers": share(v, "[a-z]"), "marks": share(v, "[^A-Za-z0-9]"),
        "transitions": (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1) / F.length("value"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.length("value"),
        "hex": flag(v.rlike("^([0-9a-f]+|[0-9A-F]+)$")), "coverage": F.coalesce("coverage", F.lit(0.0)),
        "sample_path": flag(F.lower("source").rlike("test|sample|example|fixture|doc/|mock")),
        "named": flag(F.col("name").rlike(NAMES)), "named_before": flag(around.rlike(NAMES)),
        "assigned": flag((F.col("name") != "") | F.col("before").rlike("[=:]$")),
        "quoted": flag(F.col("token").rlike("[\"']")), "plain_after": flag(F.col("after").rlike("^[a-z]+[.,;]?$"))})
    placeholder = low.rlike(r"example|changeme|placeholder|your[_-]|xxxx|0000000|1234567890|dummy|redacted")
    sure = (v.rlike(r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^xox[abprs]-|^sk_live_|^AIza[0-9A-Za-z_-]{35}$")
            | (((F.col("named") == 1) | ((F.col("named_before") == 1) & (F.col("assigned") == 1)))
               & v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.col("distinct") >= 0.15)))
    never = (placeholder | v.rlike("^[0-9+/_=-]+$") | ~v.rlike("[0-9]")
             | v.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
             | ((F.col("coverage") > 0.9) & (F.col("digits") < 0.1)))
    return rows.withColumn("label", F.when(sure & ~placeholder, 1.0).when(never, 0.0))


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per finding: doc_id, word, value digest, length, rule label,
    probability, is_secret."""
    rows = C.cut(featured(C.cut(candidates(docs)), C.cut(dictionary(docs))))
    labelled = (rows.where("label is not null").orderBy(F.xxhash64("value", "before", "after"), "value", "doc_id", "word", "at")
                .limit(sample).select("label", *FEATURES))
    kinds = [r.label for r in labelled.select("label").distinct().collect()]  # two rows at most
    out = [F.col("doc_id").cast("long").alias("doc_id"), F.col("word").cast("long").alias("word"),
           F.sha2("value", 256).alias("value_sha256"), F.col("length").cast("long").alias("length"),
           F.col("label").cast("int").alias("rule")]
    if len(kinds) < 2:
        p = F.coalesce("label", F.lit(0.5))
        return rows.select(*out, p.alias("probability"), (p > CUT).alias("is_secret"))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, labelCol="label",
                                    featuresCol="features").fit(vector.transform(labelled))
    p = vector_to_array("probability")[1]
    return forest.transform(vector.transform(rows)).select(
        *out, p.alias("probability"), (p >= CUT).alias("is_secret"))


def op3(spark, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents"))
