r"""Operator 5: personal data replaced by keyed surrogates.

Entities are e-mail addresses, phone numbers, IPv4 addresses, payment cards,
national numbers (ddd-dd-dddd) and personal names behind a title, with the other
places of the text where such a name of several parts stands. The key comes from
the session's ``spark.ticketlake.pii.key``; without it every application draws one
that nobody keeps. An entity's
surrogate depends on the key and its canonical value only (addresses in lower
case, numbers by their digits), so all its mentions, in any document and
notation, get the same one: coreference is kept. Surrogates keep the type and
the format: letters stay letters of the same case, digits digits, separators
stay; addresses keep their top-level domain, phones their country code, cards
their first digit and a right check digit, IPv4 parts stay below 256. Names
keep their gender (told by the title, or the ending of a given name), script
and case.

Values with a fixed format are permuted inside it by a keyed Feistel network,
which is a bijection, so distinct values stay distinct; names are drawn by
keyed hashing. On top comes a check over all documents: a surrogate that equals
an entity that occurs or another surrogate moves on to its next attempt, until
none collides (distinct values in Spark, by grouping and joins). Only entities
that moved are joined back to their texts.

Where a format is so full that a surrogate can hardly be a value that doesn't
occur (more than 1 / ``ROOM`` of it occurs, looked at for entities that still
collide after ``TRIES`` attempts), all values of the format get the next one on a
keyed cycle through the whole format (``FULL``): distinct among themselves and
never the value itself, but possibly another value that occurs. Names have room
always: later attempts draw more syllables.

A sign, digits, one point and up to six digits are a signed decimal, not a
phone number, and no country code begins with 0.

Defined cases: null and empty texts are kept as they are, with 0 entities; a
very long text is read whole; repeated rows give repeated results; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketlake.llm import common as C

KEY_CONF = "spark.ticketlake.pii.key"
_DRAWN: dict[str, bytes] = {}
MOVES, TRIES, ROOM, FULL = 64, 6, 4, -1
EMAIL = re.compile(r"[A-Za-z0-9_.%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}")
NUMBERS = re.compile(
    r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])(?:\d{4}[ -]?){3}\d{4}(?![\w-])|(?<![\w-])3\d{14}(?![\w-]))"
    # marks may stick to the parts of a number
    r"|(?P<phone>(?<![\w+])\+(?!\d+\.\d{1,6}(?!\d|[ .-]?\(?\d))[1-9]\d{0,2}[#*$%&!|]{0,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[#*$%&!|]{0,3}[ .-]?\d{2,4}){1,4}(?!\w)"
    r"|(?<![\w(])\(\d{3}\)[#*$%&!|]{0,3} ?\d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-]))", re.A)
# Titles and their gender.
TITLES = {"Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Señor": "m", "Sr": "m", "Monsieur": "m", "Don": "m",
          "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Lady": "f", "Frau": "f", "Señora": "f", "Sra": "f",
          "Madame": "f", "Mme": "f", "Mlle": "f", "Doña": "f", "Dr": "", "Prof": "", "Господин": "m", "Госпожа": "f",
          "Κύριος": "m", "Κυρία": "f"}
NAME = re.compile(r"\b(?P<title>" + "|".join(sorted(TITLES, key=len, reverse=True))
                  + r")\.? (?P<names>[^\W\d_a-z][^\W\d_]+(?:[ -][^\W\d_a-z][^\W\d_]+)*)")
DIGIT = re.compile("[0-9]")
CALLED = tuple(t + s for t in TITLES for s in (". ", " "))
SYLLABLES = {"latin": ("bdfgklmnprstv", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδκλμνπρστ", "αεηιο")}
ENDINGS = {"latin": {"m": "o", "f": "a", "": "e"}, "cyrillic": {"m": "ей", "f": "а", "": "и"},
           "greek": {"m": "ος", "f": "α", "": "η"}}
SCHEMA = "doc_id long, text string, n_entities long"


def prf(key: bytes, *parts) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()[:16], "big")


def permuted(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed bijection of 0 .. size - 1: a balanced Feistel network over the
    next even number of bits, walked until it lands inside."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(8):
            left, right = right, left ^ (prf(key, tweak, half, r, right) & mask)
        value = left << half | right
        if value < size:
            return value


def cycled(value: int, size: int, key: bytes, tweak: str) -> int:
    """The value behind ``value`` on a keyed cycle through all of 0 .. size - 1."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    value = (permuted(value, size, key, tweak) + 1) % size
    while True:  # the network backwards
        left, right = value >> half, value & mask
        for r in reversed(range(8)):
            left, right = right ^ (prf(key, tweak, half, r, left) & mask), left
        value = left << half | right
        if value < size:
            return value


def reformat(text: str, key: bytes, tweak: str, move=permuted) -> str:
    """Letters to letters and digits to digits, by a bijection of the format."""
    radix = [10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 1 for c in text]
    number, size = 0, 1
    for c, r in zip(text, radix):
        if r > 1:
            number = number * r + (ord(c) - 48 if r == 10 else ord(c.lower()) - 97)
            size *= r
    form = "".join("9" if r == 10 else "a" if r == 26 else c for c, r in zip(text, radix))
    number, out = move(number, size, key, f"{tweak}\x1f{form.lower()}"), []
    for c, r in zip(reversed(text), reversed(radix)):
        if r == 1:
            out.append(c)
            continue
        number, d = divmod(number, r)
        out.append(chr(48 + d) if r == 10 else chr(65 + d) if c.isupper() else chr(97 + d))
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The check digit behind ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def script_of(name: str) -> str:
    c = name[:1]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def made_name(name: str, gender: str, role: str, key: bytes, attempt: int) -> str:
    script = script_of(name)
    seed = prf(key, "name", role, gender if role == "given" else "", name.lower(), attempt)
    first, vowels = SYLLABLES[script]
    out = ""
    for _ in range(4 + attempt // 8):  # later attempts have more room
        seed, a = divmod(seed, len(first))
        seed, b = divmod(seed, len(vowels))
        out += first[a] + vowels[b]
    out = out[:-1] + ENDINGS[script][gender] if role == "given" else out + first[seed % len(first)]
    return out.upper() if name.isupper() and len(name) > 1 else out.capitalize()


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical value."""
    tweak = f"{kind}\x1f{attempt}"
    move = cycled if attempt == FULL else permuted
    if kind == "email":
        name, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{reformat(name + '@' + host, key, tweak + top, move)}.{top}"
    if kind == "ip":
        n = 0
        for p in value.split("."):
            n = n * 256 + int(p)
        n = move(n, 1 << 32, key, tweak)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        if attempt != FULL and luhn(value[:-1]) == int(value[-1]):
            body = value[0] + reformat(value[1:-1], key, tweak + "L" + value[0])
            return body + str(luhn(body))
        return value[0] + reformat(value[1:], key, tweak + value[0], move)
    if kind == "phone":
        code, _, rest = value.rpartition(" ")
        return f"{code} {reformat(rest, key, tweak + code, move)}"
    if kind == "ssn":
        return reformat(value, key, tweak, move)
    _, role, gender = kind.split("/")
    return made_name(value, gender, role, key, attempt).lower()


def mentions(text: str) -> list[tuple[int, str, str]]:
    """(start, names, gender) of the names behind a title, and of all other places
    where one of these names of several parts stands. A name has one gender in a
    text: that of its first title that tells it."""
    named = [(m.start("names"), m["names"], TITLES[m["title"]]) for m in NAME.finditer(text)]
    told: dict[str, str] = {}
    for _, said, gender in named:
        if gender:
            told.setdefault(said.lower(), gender)
    full = {said for _, said, _ in named if " " in said}
    if full:
        find = ahocorasick.Automaton()
        for said in full:
            find.add_word(said, said)
        find.make_automaton()
        for end, said in find.iter(text):
            at = end + 1 - len(said)
            if not (text[at - 1:at].isalnum() or text[end + 1:end + 2].isalnum()):
                named.append((at, said, ""))
    return [(at, said, told.get(said.lower(), gender)) for at, said, gender in named]


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) of the text's entities, in order, apart."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    for m in NUMBERS.finditer(text) if DIGIT.search(text) else ():
        kind, raw = m.lastgroup, m[0]
        if kind == "phone":
            code = re.match(r"\+\d{1,3}(?=\D)", raw)
            rest = re.sub(r"\D", "", raw[code.end() if code else 0:])
            value = f"{code[0] if code else ''} {rest}"
        else:
            value = raw if kind == "ip" else re.sub(r"\D", "", raw)
            if kind == "ip":
                value = ".".join(str(int(p)) for p in raw.split("."))
        found.append((m.start(), m.end(), kind, value))
    for at, said, gender in mentions(text) if any(t in text for t in CALLED) else ():
        names = re.split(r"([ -])", said)
        for i in range(0, len(names), 2):
            # given: the first of several parts, and those with a blank behind them
            role = "given" if (i == 0 and len(names) > 2) or " " in names[i + 1:] else "surname"
            g = (gender or ("f" if names[i][-1:] in "aаα" else "m")) if role == "given" else ""
            found.append((at, at + len(names[i]), f"name/{role}/{g}", names[i].lower()))
            at += len(names[i]) + 1
    found.sort(key=lambda x: (x[0], -x[1]))
    out, end = [], 0
    for f in found:
        if f[0] >= end:
            out.append(f)
            end = f[1]
    return out


def written(raw: str, kind: str, value: str) -> str:
    """A canonical surrogate in a mention's notation."""
    if kind in ("ip",):
        return value
    if kind.startswith("name/"):
        return value.upper() if raw.isupper() and len(raw) > 1 else value.capitalize()
    if kind == "email":
        return "".join(v.upper() if c.isupper() else v for c, v in zip(raw, value))
    digits = iter(re.sub(r"\D", "", value))
    return "".join(next(digits) if c.isdigit() else c for c in raw)


def replaced(text: str, key: bytes, moved: dict[tuple[str, str], str]) -> tuple[str, int]:
    out, at, found = [], 0, entities(text)
    for start, end, kind, value in found:
        s = moved.get((kind, value)) or surrogate(kind, value, key)
        out += [text[at:start], written(text[start:end], kind, s)]
        at = end
    return "".join([*out, text[at:]]), len(found)


def entity_rows(docs: DataFrame) -> DataFrame:
    """(t1, t2, kind, value): the distinct entities of each row, with its text's key."""

    def run(batches):
        for b in C.slices(batches, "text"):
            rows = [(i, k, v) for i, t in enumerate(C.strings(b, "text"))
                    for k, v in {(k, v) for _, _, k, v in entities(t)}]
            i, k, v = zip(*rows) if rows else ((), (), ())
            at = pa.array(i, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("t1").take(at), b.column("t2").take(at),
                                              pa.array(k, pa.string()), pa.array(v, pa.string())],
                                             ["t1", "t2", "kind", "value"])

    rows = docs.select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    return C.mapped(rows, run, "t1 long, t2 long, kind string, value string")


def attempts(rows: DataFrame, key: bytes, attempt: int) -> DataFrame:
    def run(batches):
        for b in batches:
            s = [surrogate(k, v, key, attempt) for k, v in zip(C.strings(b, "kind"), C.strings(b, "value"))]
            yield C.record(b, ["kind", "value"], other=pa.array(s, pa.string()))

    return C.mapped(rows.select("kind", "value"), run, "kind string, value string, other string")


def form(kind: str, value: str) -> tuple[str, float]:
    """The format that holds a value's surrogates, and how many values it has."""
    if kind == "ip":
        return "", 2.0 ** 32
    kept = 0
    if kind == "email":
        kept = len(value) - len(value.rpartition(".")[0])
    elif kind == "phone":
        kept = -len(value.rpartition(" ")[0])
    elif kind == "card":
        kept = -1
    free, fixed = (value[-kept:], value[:-kept]) if kept < 0 else (value[:len(value) - kept], value[len(value) - kept:])
    letters, digits = (sum(map(free.count, x)) for x in ("abcdefghijklmnopqrstuvwxyz", "0123456789"))
    shape = re.sub("[0-9]", "9", re.sub("[a-z]", "a", free))
    return f"{len(fixed)}{fixed}\x1f{shape}", 26.0 ** letters * 10.0 ** digits


def formed(rows: DataFrame) -> DataFrame:
    """(kind, value, form, size) of the values with a fixed format."""

    def run(batches):
        for b in batches:
            out = [form(k, v) for k, v in zip(C.strings(b, "kind"), C.strings(b, "value"))]
            yield C.record(b, ["kind", "value"], form=pa.array([x for x, _ in out], pa.string()),
                           size=pa.array([x for _, x in out], pa.float64()))

    return C.mapped(rows.select("kind", "value").where(~F.col("kind").startswith("name/")), run,
                    "kind string, value string, form string, size double")


def moved_entities(found: DataFrame, key: bytes) -> DataFrame | None:
    """(kind, value, other) of the entities whose first surrogate collided, with
    the surrogate that doesn't; None if none did."""
    known = C.cut(found.select("kind", "value").distinct())
    taken, moved, rest, full = None, None, known, None
    kind = F.split("kind", "/")[0]
    for attempt in range(MOVES):
        now = C.cut(attempts(rest, key, attempt).withColumn("type", kind))
        one = Window.partitionBy("type", "other").orderBy("kind", "value")
        bad = now.join(known.select(kind.alias("type"), F.col("value").alias("other")).distinct(),
                       ["type", "other"], "left_semi")
        if taken is not None:
            bad = bad.unionByName(now.join(taken, ["type", "other"], "left_semi"))
        bad = bad.unionByName(now.withColumn("k", F.row_number().over(one)).where("k > 1").drop("k"))
        rest = C.cut(bad.select("kind", "value").distinct())
        good = now.join(rest, ["kind", "value"], "left_anti")
        taken = good.select("type", "other") if taken is None else taken.unionByName(good.select("type", "other"))
        if attempt:
            moved = good.drop("type") if moved is None else moved.unionByName(good.drop("type"))
        if rest.isEmpty():
            break
        if attempt == TRIES or attempt == MOVES - 1:  # what has no room, at last all that is left
            forms = C.cut(formed(rest).select("kind", "form").distinct())
            crowded = (C.cut(formed(known)).join(forms, ["kind", "form"], "left_semi"))
            least = crowded.groupBy("kind", "form").agg(F.count("*").alias("n"), F.max("size").alias("size"))
            if attempt == TRIES:
                least = least.where(F.col("n") * ROOM > F.col("size"))
            now_full = C.cut(attempts(crowded.join(least, ["kind", "form"], "left_semi"), key, FULL))
            full = now_full if full is None else full.unionByName(now_full)
            rest = C.cut(rest.join(full, ["kind", "value"], "left_anti"))
            if rest.isEmpty():
                break
    else:
        raise ValueError(f"surrogates still collide after {MOVES} attempts")
    if full is not None:
        full = C.cut(full.distinct())
        moved = full if moved is None else moved.join(full, ["kind", "value"], "left_anti").unionByName(full)
    return moved


def key_of(spark: SparkSession) -> bytes:
    """The key of ``KEY_CONF``; without one, a random key for this application."""
    said = spark.conf.get(KEY_CONF, None)
    return said.encode() if said else _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def anonymised(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """One row per document row: doc_id, the text with surrogates, n_entities."""
    key = key or key_of(docs.sparkSession)
    found = C.cut(entity_rows(docs))
    moved = moved_entities(found, key)
    rows = docs.select("doc_id", "text")
    if moved is None:
        rows = rows.withColumn("moved", F.lit(None).cast("array<struct<kind:string,value:string,other:string>>"))
    else:
        per_text = found.join(moved, ["kind", "value"]).groupBy("t1", "t2").agg(
            F.collect_set(F.struct("kind", "value", "other")).alias("moved"))  # a text's own entities
        rows = (rows.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(1), "text"))
                .join(per_text, ["t1", "t2"], "left").select("doc_id", "text", "moved"))

    def run(batches):
        for b in C.slices(batches, "text"):
            out, n = [], []
            for t, m in zip(b.column("text").to_pylist(), b.column("moved").to_pylist()):
                new, count = replaced(t, key, {(x["kind"], x["value"]): x["other"] for x in m or ()}) if t else (t, 0)
                out.append(new)
                n.append(count)
            yield C.record(b, ["doc_id"], text=pa.array(out, pa.string()), n_entities=pa.array(n, pa.int64()))

    return C.mapped(rows, run, SCHEMA)


def op5(spark, sf_dir: str) -> DataFrame:
    return anonymised(C.table(spark, sf_dir, "documents"))
