r"""Operator 7: main text of web pages by site style trees.

The DOMs of a host's pages merge into one style tree: a node is a path of
element signatures (tag and all class, id or role words, digits left out; of
more than ``SHOWN`` words the signature has the first and a hash of all). In the first
pass every page gives, for each node, a hash of its children's signatures
(presentation) and of its text (content), over all of the page's elements of
that node in page order: a node counts once per page, however many alike
elements it has there. Pages of a host with the same html count once (repeats
go by a 128-bit hash of the html, in a batch and then in Spark). A node's
importance is

    GAMMA * H(presentation) + (1 - GAMMA) * H(content),

the entropies in units of the logarithm of the node's distinct pages: 1 where
each page differs, 0 where all are alike. Nodes of less importance than ``LOW``
(inside the article ``LOW_INSIDE``), seen on ``PAGES`` or more distinct pages,
are branches to remove. In the second pass each page loses its low branches,
but for those that hold the page's article, and those whose tag, class, id or
role says that they are menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles or reader comments.

What is left inside ``article`` or ``main`` (else in the body) is the text:
character references decoded, white space runs one space, blocks joined by one
space. Nothing is cut.

Defined cases: a null or empty html has an empty text and n_chars 0; a null or
unreadable url counts as host ''; a page cut short ends where it ends; repeated
rows give repeated results; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm import common as C

GAMMA, LOW, LOW_INSIDE, PAGES, SMALL, SHOWN = 0.2, 0.35, 0.08, 20, 20_000, 8
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|textarea|select)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|[^<]+|<", re.S | re.I)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
NODE = ("path", "inside", "shape", "content")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "option": ("option",)}
HOLDS = frozenset("ul ol dl table tbody thead tfoot tr article aside body div main section nav".split())
DROP_TAGS = frozenset("head nav footer aside form button dialog menu object canvas".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice notices popup "
    "modal overlay newsletter subscribe subscription share sharing social comment comments disqus replies reply "
    "respond related recommended widget toolbar pagination pager login signup search contentinfo complementary "
    "alert".split())
MAIN = frozenset(["article", "main"])


class Page:
    """A page's elements and text pieces in page order."""

    def __init__(self, text: str):
        self.tag, self.path, self.parent, self.drop, self.inside = ["#"], [""], [-1], [False], [False]
        self.holds = [False]   # is the article or main, or has it inside
        self.pieces: list[tuple[int, str]] = []   # element, text ("" is a block's edge)
        stack = [0]
        for m in TOKEN.finditer(text):
            name = m[3]
            if name is None:
                if m[0][0] != "<" or m[0] == "<":
                    self.pieces.append((stack[-1], m[0]))
                continue
            name = name.lower()
            if name not in INLINE:
                self.pieces.append((stack[-1], ""))
            if m[2]:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name:
                        del stack[k:]
                        break
                continue
            if name in VOID:
                continue
            if name in CLOSES_P:
                self.close(stack, ("p",))
            if name in SIBLINGS:
                self.close(stack, SIBLINGS[name])
            words = self.words(m[4])
            top = stack[-1]
            inside = self.inside[top] or name in MAIN or "main" in words
            drop = (self.drop[top] or name in DROP_TAGS or (name == "header" and not self.inside[top])
                    or any(w in DROP_WORDS and not (w == "header" and self.inside[top]) for w in words))
            self.tag.append(name)
            self.path.append(f"{self.path[top]}/{self.signature(name, words)}")
            self.parent.append(top)
            self.drop.append(drop)
            self.inside.append(inside)
            self.holds.append(False)
            if inside and not drop and not self.inside[top]:
                e = len(self.tag) - 1
                while e >= 0 and not self.holds[e]:
                    self.holds[e] = True
                    e = self.parent[e]
            if not m[4].endswith("/"):
                stack.append(len(self.tag) - 1)

    def close(self, stack: list[int], tags: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in tags:
                del stack[k:]
                return
            if tag in HOLDS:
                return

    @staticmethod
    def words(attributes: str) -> list[str]:
        if "=" not in attributes:
            return []
        said = [(m[2] or m[3] or m[4] or "").lower() for m in ATTR.finditer(attributes)]
        return WORD.findall(" ".join(said))

    @staticmethod
    def signature(name: str, words: list[str]) -> str:
        """Tag and words; a long signature ends in a hash of all its words."""
        whole = ".".join([name, *words])
        if len(words) <= SHOWN:
            return whole
        return ".".join([name, *words[:SHOWN], xxhash.xxh3_128_hexdigest(whole)])

    def signatures(self):
        """(path, inside, presentation hash, content hash) of every node that
        isn't dropped by name, over all its elements on the page."""
        n = len(self.tag)
        text, child = [[] for _ in range(n)], [[] for _ in range(n)]
        for e, t in self.pieces:
            if t:
                text[e].append(t)
        nodes: dict[str, tuple[bool, list, list]] = {}
        for e in range(n - 1, 0, -1):  # children come after their parent
            p = self.parent[e]
            sig = self.path[e].rsplit("/", 1)[1]
            if not child[p] or child[p][-1] != sig:
                child[p].append(sig)
            if not self.drop[e]:
                whole = xxhash.xxh3_64_intdigest("".join(text[e]))
                node = nodes.setdefault(self.path[e], (self.inside[e], [], []))
                node[1].append(" ".join(child[e]))
                node[2].append(str(whole))
                text[p].append(f" {whole} ")  # a parent's content is its text and its children's hashes
        for path, (inside, shapes, contents) in nodes.items():
            yield (path, inside, xxhash.xxh3_64_intdigest("/".join(shapes)) >> 1,
                   xxhash.xxh3_64_intdigest(" ".join(contents)) >> 1)

    def main_text(self, low: frozenset[str]) -> str:
        gone = list(self.drop)
        for e in range(1, len(gone)):
            gone[e] = gone[e] or gone[self.parent[e]] or (self.path[e] in low and not self.holds[e])
        kept = [(e, t) for e, t in self.pieces if not gone[e]]
        if any(self.inside[e] and t and not t.isspace() for e, t in kept):
            kept = [(e, t) for e, t in kept if self.inside[e]]
        return " ".join(entities.unescape("".join(t or " " for _, t in kept)).split())


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1),
                              F.lit("")))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, inside, pages, importance) of every node of every host's tree."""

    def run(batches):
        for b in C.slices(batches, "html"):
            seen, out = set(), []
            for host, text in zip(b.column("host").to_pylist(), C.strings(b, "html")):
                raw = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
                if (host, raw) not in seen:
                    seen.add((host, raw))
                    out.append((host, raw, [dict(zip(NODE, x)) for x in Page(text).signatures()]))
            host, raw, nodes = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(host, pa.string()), pa.array(raw, pa.binary()),
                 pa.array(nodes, pa.list_(pa.struct(list(zip(NODE, (pa.string(), pa.bool_(), pa.int64(), pa.int64()))))))],
                ["host", "page", "nodes"])

    rows = C.mapped(pages.select("host", "html"), run, "host string, page binary, "
                    "nodes array<struct<path: string, inside: boolean, shape: bigint, content: bigint>>")
    rows = (rows.groupBy("host", "page").agg(F.first("nodes").alias("nodes"))  # a page's copies are alike
            .select("host", F.inline("nodes"))
            .select("host", "path", "inside", F.posexplode(F.array("shape", "content")).alias("kind", "sig")))
    sums = (rows.groupBy("host", "path", "inside", "kind", "sig").agg(F.count("*").alias("n"))
            .groupBy("host", "path", "inside", "kind")
            .agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn")))
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m")).otherwise(1.0)
    weight = F.when(F.col("kind") == 0, GAMMA).otherwise(1 - GAMMA)
    return (sums.groupBy("host", "path", "inside")
            .agg(F.max("m").alias("pages"), F.sum(entropy * weight).alias("importance")))


def low_branches(tree: DataFrame) -> DataFrame:
    """(host, low): paths whose importance is low on enough pages. (What holds a
    page's article stays there, see ``Page.main_text``.)"""
    # a host's distinct low paths are few: signatures hold no digits and no texts
    bound = F.when(F.col("inside"), LOW_INSIDE).otherwise(LOW)
    return (tree.where((F.col("pages") >= PAGES) & (F.col("importance") < bound)
                       & ~F.element_at(F.split("path", "/"), -1).rlike(r"^(html|body|article|main)\b"))
            .groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("low")))


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars."""
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    low = C.cut(low_branches(style_tree(pages)))
    few = low.limit(SMALL + 1).count() <= SMALL  # checked size: else the planner chooses the join
    rows = pages.join(F.broadcast(low) if few else low, "host", "left").select("page_id", "url", "html", "low")

    def run(batches):
        for b in C.slices(batches, "html"):
            out, known = [], {}
            for text, low in zip(C.strings(b, "html"), b.column("low").to_pylist()):
                key = tuple(low or ())
                if key not in known:
                    known[key] = frozenset(key)
                out.append(Page(text).main_text(known[key]))
            yield C.record(b, ["page_id", "url"], text=pa.array(out, pa.string()),
                           n_chars=pa.array(list(map(len, out)), pa.int64()))

    return C.mapped(rows, run, "page_id long, url string, text string, n_chars long")


def op7(spark, sf_dir: str) -> DataFrame:
    return main_text(C.table(spark, sf_dir, "pages"))
