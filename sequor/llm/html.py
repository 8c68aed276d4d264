"""Main text of web pages: a template deduced from the pages of a host, then its remaining slots.

A page is a sequence of tokens: tags and text blocks, each with its path. Tokens of a host that occur equally
often in the same pages form an equivalence class; a class of two or more tokens found in nearly all of
four or more pages is valid. The class of tokens that stand once in a page makes the template's order; classes of tokens
that repeat in a page nest inside its slots. A page is aligned with its host's template, and what stands in
the slots is the result: texts of the template at the edges of a slot, and those of nested classes, go.

Tags and class names are only an aid that picks the slots: menus, forms, adverts and the like fill slots as well.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sequor.llm.common import cut, prepare
from sequor.llm.urls import url_parts

SKIP = frozenset(
    "head nav footer aside form script style noscript template button select textarea iframe svg dialog menu object canvas audio video".split()
)
RAW = frozenset("script style textarea title noscript template iframe svg".split())
MAIN = frozenset(("article", "main"))
VOID = frozenset("br img hr input meta link area base col embed source track wbr".split())
LEAF = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("a b i em strong span u small sub sup code".split())
BLOCK = LEAF | SKIP | MAIN | frozenset(
    "html body header div ul ol dl table thead tbody tfoot caption blockquote pre section figure figcaption address details summary hr fieldset".split()
)
#: Words in a class, id or role that mark what surrounds the text.
MARKS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr"
    " header menu modal nav navbar navigation newsletter notice notices popup promo promotion related replies reply share sharing sidebar social"
    " sponsor sponsored subscribe toolbar widget contentinfo complementary search".split()
)
#: Inside the article, a class name of several words marks only if it says comment, advert or notice, and nothing beyond these words of layout.
INSIDE = frozenset("ad ads advert advertisement adverts advertising comment comments consent cookie cookies notice notices sponsor sponsored".split())
LAYOUT = frozenset("area banner block body box container content group holder inner item list outer panel place reader readers section slot thread unit user wrap wrapper".split())
START = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])")
NAME = re.compile(r"[^\s/>]*")
#: The end of a tag, or a value in quotes, which may hold one.
STOP = re.compile(r">|=\s*[\"']")
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
SPACES = re.compile(r"\s+")
PIECES = re.compile(r"[^A-Za-z]+")
#: Pages of a host, at least, and the share of them that a template's token stands in.
PAGES, SHARE = 4, 0.9
#: Bytes of templates that are broadcast, at most; beyond it pages and templates are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


class Block(NamedTuple):
    text: str
    inside: bool  # in the article
    bad: bool  # in what surrounds the text
    linked: bool  # a list item that is a link as a whole


class Page(NamedTuple):
    blocks: list[Block]
    tokens: list[tuple[int, int]]  # hash, number of the text block or -1 for a tag


class Scanner:
    """The tags of a page from left to right, each character looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.none_from = {'"': len(page), "'": len(page)}  # no such quote stands at or after this place

    def tag_end(self, at: int) -> int:
        """The place after the > that ends the tag; -1 without one. A quote that is never closed is a character."""
        page = self.page
        while True:
            m = STOP.search(page, at)
            if m is None:
                return -1
            if m[0] == ">":
                return m.end()
            quote, at = m[0][-1], m.end()
            if at < self.none_from[quote]:
                close = page.find(quote, at)
                if close < 0:
                    self.none_from[quote] = at
                else:
                    at = close + 1

    def skip_raw(self, name: str) -> None:
        close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(self.page, self.at)
        self.at = close.end() if close else len(self.page)

    def __iter__(self) -> Iterator[tuple[str, bool, str, str]]:
        """(name, is an end tag, attributes, text before it); the last one has an empty name. A cut-off tag is dropped."""
        page, begin, look = self.page, 0, 0
        while True:
            m = START.search(page, look)
            if m is None:
                yield "", False, "", page[begin:]
                return
            if m[0] == "<!--":
                end = page.find("-->", m.end())
                end = end + 3 if end >= 0 else -1
            elif m[0] in ("<!", "<?"):
                end = page.find(">", m.end()) + 1 or -1
            else:
                end = self.tag_end(m.end())
            before = page[begin : m.start()]
            if end < 0:
                yield "", False, "", before
                return
            self.at = end
            if m[0][-1].isalpha():
                name = NAME.match(page, m.end() - 1)
                yield name[0].lower(), m[0][1] == "/", page[name.end() : end - 1], before
            else:
                yield "!", False, "", before
            begin = look = self.at


def marked(attributes: dict[str, str], in_article: bool) -> bool:
    """Whether a class, id or role says that an element surrounds the text; inside the article only by whole names."""
    if not in_article:
        return any(not MARKS.isdisjoint(PIECES.split(v.lower())) for v in attributes.values())
    names = [set(filter(None, PIECES.split(x))) for v in attributes.values() for x in v.lower().strip("\"'").split()]
    return any((len(n) == 1 and n <= MARKS - {"header", "search"}) or (n & INSIDE and n <= INSIDE | LAYOUT) for n in names)


def below(path: int, name: str) -> int:
    return xxhash.xxh64_intdigest(name, seed=path)


def read_page(page: str) -> Page:
    """The text blocks of a page in order, and its tokens.

    References are decoded, white space becomes one space, ends are trimmed, empty blocks are left
    out. End tags that are missing are implied: a leaf element ends at the next one; at the end
    tag of an outer element the inner ones end.

    Inside the article a class name marks comments, adverts and notices if it is nothing but their name; words like related in
    related-work don't. Elsewhere, an element marked by a word of its class name surrounds the text, unless it holds the page's first unmarked article or heading;
    a marked article in an article, or in what surrounds it, is a comment or a teaser.
    """
    blocks: list[Block] = []
    tokens: list[tuple[int, int]] = []
    stack: list[list] = [["", 0, 0]]  # name, whether it surrounds the text (1: by its tag, 2: by its class), path
    held: list[str] = []
    open_ = Counter()
    skip = soft = article = links = 0
    in_link = chars = 0  # characters of the block in links, and all
    seen_main = seen_h1 = False
    scan = Scanner(page)

    def put(text: str) -> None:
        nonlocal in_link, chars
        if text:
            held.append(text)
            n = len(text) - text.count(" ")
            chars += n
            if links:
                in_link += n

    def flush() -> None:
        nonlocal in_link, chars
        if held:
            text = SPACES.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text:
                tokens.append((xxhash.xxh64_intdigest(text, seed=stack[-1][2]) >> 1, len(blocks)))
                blocks.append(Block(text, article > 0, skip > 0, open_["li"] > 0 and in_link == chars))
        in_link = chars = 0

    def close() -> str:
        nonlocal skip, soft, article
        name, bad, _ = stack.pop()
        open_[name] -= 1
        skip -= bad > 0
        soft -= bad == 2
        article -= name in MAIN
        return name

    def lift() -> None:
        nonlocal skip, soft
        if soft:
            for s in stack:
                if s[1] == 2:
                    s[1] = 0
            skip, soft = skip - soft, 0

    for name, ends, rest, before in scan:
        put(before)
        if not name or name == "!":
            continue
        if name not in BLOCK:
            if name in RAW and not ends:
                scan.skip_raw(name)
            elif name == "br":
                put(" ")
            elif name == "a":
                links = max(0, links - 1) if ends else links + 1
            elif name not in VOID and not ends and name not in INLINE:
                tokens.append((below(stack[-1][2], name) >> 1, -1))
            continue
        flush()
        if ends:
            if open_[name]:
                while close() != name:
                    pass
                if name not in LEAF:
                    tokens.append((below(stack[-1][2], "/" + name) >> 1, -1))
            continue
        path = stack[-1][2]
        attributes = {k.lower(): v for k, v in NAMED.findall(rest)} if "=" in rest else {}
        if name not in VOID:
            if (name in LEAF and stack[-1][0] == name) or (name != "p" and stack[-1][0] == "p"):
                close()
                path = stack[-1][2]
            if name in RAW:
                scan.skip_raw(name)
                continue
            surrounds = name not in ("html", "body") and (name not in MAIN or article or skip) and marked(attributes, article > 0)
            if name == "h1" and not seen_h1 or name in MAIN and not surrounds and not seen_main:
                lift()
            seen_h1 |= name == "h1"
            seen_main |= name in MAIN and not surrounds
            if article and surrounds and name in ("header", "h1", "h2", "h3"):
                surrounds = False
            bad = 1 if name in SKIP or (name == "header" and not article) else 2 if surrounds else 0
            path = below(path, name)
            stack.append([name, bad, path])
            open_[name] += 1
            skip += bad > 0
            soft += bad == 2
            article += name in MAIN
        tokens.append((below(path, attributes.get("class", "")) >> 1, -1))
    flush()
    return Page(blocks, tokens)


def host_tokens(pages: DataFrame) -> DataFrame:
    """Sums for each token of a host and Arrow batch: (host, token, is_text, pages, total, at, v0, v1).

    v0 and v1 sum hashes of the pages and the token's count in each, so that equal sums are equal occurrence vectors; at sums its
    first places. Token 0 counts the pages, and in total their texts. Texts in what surrounds the text are no tokens.
    """
    names = ["host", "token", "is_text", "pages", "total", "at", "v0", "v1"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[str, int], list[int]] = {}
            for host, key, page in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                count: dict[int, int] = {0: 1}
                first: dict[int, tuple[int, bool]] = {0: (0, False)}
                p = read_page(page)
                for at, (t, block) in enumerate(p.tokens):
                    if block >= 0 and p.blocks[block].bad:
                        continue
                    count[t] = count.get(t, 0) + 1
                    first.setdefault(t, (at, block >= 0))
                texts = sum(of_text for _, of_text in first.values())
                for t, n in count.items():
                    s = seen.setdefault((host, t), [first[t][1], 0, 0, 0, 0, 0])
                    h = xxhash.xxh64_intdigest(f"{key} {n}")
                    for k, x in enumerate((1, n if t else texts, first[t][0], h >> 33, h & 0x7FFFFFFF), 1):
                        s[k] += x
            if seen:
                cols = list(zip(*seen.values(), strict=True))
                of = [pa.array([h for h, _ in seen]), pa.array([t for _, t in seen], pa.int64()), pa.array(cols[0], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*of, *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)

    kinds = "host string, token long, is_text boolean, pages long, total long, at long, v0 long, v1 long"
    return pages.select("host", F.xxhash64("page_id", "html").alias("key"), "html").mapInArrow(gather, kinds)


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): the tokens of the valid classes of a host, as (class, once, token, is_text) in their mean order.

    Every token stands in nearly all pages of the host, so a template is no longer than a page. Hosts whose classes
    hold no text are left out: their slots hold all there is. So are those whose pages are copies of a few texts:
    where most of the texts beside the template's stand in several pages.
    """
    sums = [F.sum(c).alias(c) for c in ("pages", "total", "at", "v0", "v1")]
    t = cut(host_tokens(pages).groupBy("host", "token").agg(F.max("is_text").alias("is_text"), *sums).where("pages >= 2 or token = 0"))
    hosts = t.where((F.col("token") == 0) & (F.col("pages") >= PAGES)).select("host", F.col("pages").alias("n"), F.col("total").alias("texts"))
    size = hosts.agg(F.sum(F.octet_length("host") + 60)).first()[0] or 0
    several = t.where("token <> 0").join(F.broadcast(hosts) if size <= BROADCAST_BYTES else hosts, "host")
    enough = F.col("pages") >= F.col("n") * SHARE
    times = lambda of: F.coalesce(F.sum(F.when(F.col("is_text") & of, F.col("pages"))), F.lit(0))
    in_some = several.groupBy("host", "texts").agg(times(~enough).alias("some"), times(enough).alias("all"))
    differ = in_some.where("texts - some - all > some").select("host")
    often = several.where(enough).join(differ, "host", "left_semi")
    member = F.struct((F.col("at") / F.col("pages")).alias("place"), "token", "is_text")
    classes = often.groupBy("host", "pages", "total", "v0", "v1").agg(F.collect_list(member).alias("members"), F.max("is_text").alias("texts"))
    classes = classes.where((F.size("members") >= 2) & F.col("texts"))
    of = F.xxhash64("pages", "total", "v0", "v1")
    once = F.col("total") == F.col("pages")
    rows = classes.select("host", of.alias("of"), once.alias("once"), F.explode("members").alias("m"))
    item = F.struct("m.place", "of", "once", "m.token", "m.is_text")
    return rows.groupBy("host").agg(F.sort_array(F.collect_list(item)).alias("template"))


def rising(places: list[int]) -> list[int]:
    """The positions in the list of a longest strictly rising subsequence."""
    tops: list[int] = []
    ends: list[int] = []
    back = []
    for k, x in enumerate(places):
        at = bisect_left(tops, x)
        back.append(ends[at - 1] if at else -1)
        tops[at : at + 1] = [x]
        ends[at : at + 1] = [k]
    out = []
    k = ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


class Template:
    """The ordered root class of a host, and the classes nested in its slots."""

    def __init__(self, items: list[dict]):
        self.place = {x["token"]: k for k, x in enumerate(items) if x["once"]}
        nested = defaultdict(list)
        for x in items:
            if not x["once"]:
                nested[x["of"]].append(x["token"])
        self.nested = list(nested.values())
        self.class_of = {t: k for k, tokens in enumerate(self.nested) for t in tokens}

    def texts(self, page: Page, take: list[bool]) -> set[int]:
        """The numbers of the page's blocks that belong to the template; take: those that may be part of the result."""
        found = [(at, self.place[t], block) for at, (t, block) in enumerate(page.tokens) if t in self.place]
        fixed = {found[k][0]: found[k][2] for k in rising([x[1] for x in found])}
        out: set[int] = set()
        # slots lie between the template's tags; its texts are taken from both ends of a slot
        slot: list[tuple[int, bool]] = []

        def end_slot() -> None:
            for side in (slot, reversed(slot)):
                for block, of_template in side:
                    if not of_template:
                        break
                    out.add(block)
            slot.clear()

        for at, (_, block) in enumerate(page.tokens):
            if block < 0 and at in fixed:
                end_slot()
            elif block >= 0 and take[block]:
                slot.append((block, at in fixed))
        end_slot()
        # a nested class is valid if its tokens take turns in one order
        turns: list[list[int]] = [[] for _ in self.nested]
        texts: list[list[int]] = [[] for _ in self.nested]
        for t, block in page.tokens:
            k = self.class_of.get(t)
            if k is not None:
                turns[k].append(t)
                if block >= 0 and take[block]:
                    texts[k].append(block)
        for tokens, turn, found_texts in zip(self.nested, turns, texts, strict=True):
            n = len(tokens)
            if len(turn) % n == 0 and len(set(turn[:n])) == n and turn == turn[:n] * (len(turn) // n):
                out.update(found_texts)
        return out


def main_text(page: str, template: Template | None = None) -> str:
    """The blocks of the slots, joined by two line ends.

    Blocks that tags or class names mark as surroundings are left out, as are those beside the article where there is one, else
    list items that are links as a whole. If the template's texts are over four fifths of the rest, the pages of
    the host are copies of one text and keep it.
    """
    p = read_page(page)
    take = [b.inside and not b.bad for b in p.blocks]
    if not any(take):
        take = [not b.bad and not b.linked for b in p.blocks]
    gone = template.texts(p, take) if template else set()
    if gone and 5 * sum(len(p.blocks[k].text) for k in gone) > 4 * sum(len(b.text) for b, t in zip(p.blocks, take, strict=True) if t):
        gone = set()
    return "\n\n".join(b.text for k, b in enumerate(p.blocks) if take[k] and k not in gone)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row. Null html is empty, as is a page without main text.

    Null or odd URLs share the empty host. Repeated rows each give a row. A broken tag at the end of a
    page is dropped; a quote that is never closed is a character; unknown tags are inline.
    """
    prepare(pages.sparkSession)
    host = url_parts(F.col(url_col))["host"]
    d = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    found = cut(templates(d))
    size = found.agg(F.sum(F.size("template") * 34 + 40)).first()[0] or 0
    d = d.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[str, Template | None] = {}
            hosts = b.column(2).to_pylist()
            for k, h in enumerate(hosts):
                if h not in known:
                    items = b.column(4)[k].as_py()
                    known[h] = Template(items) if items else None
            texts = [main_text(p, known[h]) for h, p in zip(hosts, b.column(3).to_pylist(), strict=True)]
            cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    kinds = T.StructType([
        T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("url", T.StringType()),
        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
    ])
    return d.select("page_id", "url", "host", "html", "template").mapInArrow(read, kinds)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
