"""Main text of web pages by deduction of their sites' templates.

Equivalence classes (after Arasu and Garcia-Molina, 2003). A page is a sequence of
tokens: element starts, qualified by their path of names and classes, and text
blocks, qualified likewise. Tokens of one host that occur equally often on every page
(equal occurrence vectors) form a class; classes with enough support are the site's
fixed parts, all else is data. The vectors are never written out: a token's vector is
represented by the sum of its counts times a hash of the page, so that partial sums
combine before the shuffle and a host with a third of all pages costs one row per
token and batch.

A page is then read against its host's template. A class holds on a page if its
tokens stand there equally often and in the same order in each round (ordered) and its
rounds and those of each larger class that holds lie in one gap of each other (nested);
the classes that hold are the page's template, and the text between template tokens are
its slots. Of the elements that stand once on every page of the host, the smallest
whose slots hold ``MAIN`` of the host's text outside links, and the page's main heading where
each page has one, is the host's main element.

A slot is left out if it lies under an element that names itself navigation, header,
footer, advert, notice, form, comments or the like; a block that is itself a template
token is fixed text and is left out too, also in the article, unless an article has more
fixed text than other: then it is a text that the host has repeatedly and stays whole. Of
the slots that remain, those in article and main elements are the text; without such an
element, those in the host's main element; without a template, all of them. With
``names=False`` the names of elements and classes decide nothing, and the template alone
does.

Markup is read in one pass, in time linear in the page. A tag whose quotes don't close
before the page ends closes at its first ``>``, and from there on quotes mean nothing.

Defined results: null html is empty and its text too; a page whose url is null or
unreadable belongs to the host ""; a host with fewer than ``support`` pages
has no template and its pages are read by the elements alone; repeated ids are extracted
each; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryloom.llm._common import checkpoint, strings

SUPPORT, SHARE, MAIN = 3, 0.5, 0.7
#: Templates up to this many bytes are broadcast; beyond it pages and templates are joined by salted host.
BROADCAST_BYTES, SALT = 32 << 20, 32

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
RAW = frozenset("script style template noscript svg iframe object textarea select title math".split())
RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}
NAMES = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT_ELEMENTS = frozenset("head nav aside footer form dialog menu button fieldset input audio video canvas".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words that say what a part of a page is, and words that say nothing; a class or id is read as a whole.
OUT_WORDS = re.compile(r"ads?|adverts?|advertis\w*|adsense|adbox|sponsor\w*|promo\w*|nav\w*|menus?|breadcrumbs?|sidebars?|aside|rail|footer|masthead|topbar|cookies?|consent|gdpr|notices?|alerts?|banners?|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|replies|respond|disqus|discussion|widgets?|search|pagination|pager|toolbar|toc|skip|legal|copyright|disclaimer")
PLAIN_WORDS = frozenset("area areas bar block blocks bottom box boxes btn button buttons col column container content frame global group head header holder icons inner item items left link links list lists main media module outer page panel panels post posts primary region right row section sections secondary sheet site slot slots tab tabs thread top unit units wrap wrapper zone".split())
HEADERS = frozenset("site-header page-header main-header global-header top-header".split())
TEXT_ELEMENTS = frozenset("h1 h2 h3 h4 h5 h6 p li td th tr pre blockquote dd dt figcaption caption".split())


def names_other(attributes: dict[str, str]) -> bool:
    """Whether a class or id says that an element is no part of the article: only words that do, or say nothing."""
    for key in ("class", "id"):
        for name in attributes.get(key, "").lower().split():
            words = [w for w in re.split(r"[_-]+", name) if w]
            hits = [OUT_WORDS.fullmatch(w) is not None for w in words]
            if (any(hits) and all(h or w in PLAIN_WORDS or w.isdigit() for h, w in zip(hits, words))) or "-".join(words) in HEADERS:
                return True
    return False


ITEMS = {
    **{x: ({x}, {"ul", "ol", "dl", "table", "tbody"}) for x in ("li", "tr", "td", "th", "option")},
    **{x: ({"dd", "dt"}, {"ul", "ol", "dl", "table", "tbody"}) for x in ("dd", "dt")},
}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


@dataclass(slots=True)
class Block:
    text: str
    out: bool  # under an element that names itself something else than the article
    article: int  # number of the article or main element it lies in, 0 for none
    main: bool  # in the host's main element
    token: int


def token_id(kind: str, path: int, text: str = "") -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}{path}\0{text}") & (2**63 - 1)


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name, whether it closes, and attributes of each tag; of what has no name (comments and the like) an empty name.

    Elements whose content is no markup count as one tag without a name.
    """
    at, last, quotes = page.find("<"), page.rfind(">"), True
    while 0 <= at < len(page):
        if m := TAG.match(page, at):
            if at > last:
                return
            end = ATTRIBUTES.match(page, m.end()) if quotes else None
            if end is None:
                quotes = False
            stop = end.end() if end else page.index(">", m.end()) + 1
            name = m[2].lower()
            if name in RAW and not m[1]:
                close = RAW_END[name].search(page, stop)
                stop = close.end() if close else len(page)
                yield at, stop, "", False, ""
            else:
                yield at, stop, name, bool(m[1]), page[m.end() : stop - 1]
        elif page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            stop = len(page) if stop < 0 else stop + 3
            yield at, stop, "", False, ""
        elif page.startswith(("<!", "<?"), at) and at < last:
            stop = page.index(">", at) + 1
            yield at, stop, "", False, ""
        else:
            stop = at + 1
        at = page.find("<", stop)


class _Open:
    """An open element."""

    __slots__ = ("name", "path", "out", "article", "main", "token", "text", "heads")

    def __init__(self, name: str, path: int, out: bool, article: int, main: bool, token: int, text: int, heads: int) -> None:
        self.name, self.path, self.out, self.article, self.main, self.token, self.text, self.heads = name, path, out, article, main, token, text, heads


@dataclass(slots=True)
class Page:
    blocks: list[Block]
    sequence: list[int]  # tokens: elements and blocks in order
    weights: dict[int, list[int]]  # of each element: characters outside links and main headings in it; 0: of the page


def parse(page: str, main: int = 0) -> Page:
    blocks: list[Block] = []
    sequence: list[int] = []
    weights: dict[int, list[int]] = {}
    stack = [_Open("", 0, False, 0, False, 0, 0, 0)]
    opened: dict[str, int] = defaultdict(int)  # how often each name is open
    held: list[str] = []
    articles = text = heads = links = 0

    def close_block() -> None:
        if held:
            found = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if found:
                top = stack[-1]
                token = token_id("x", top.path, found)
                blocks.append(Block(found, top.out, top.article, top.main, token))
                sequence.append(token)

    def close(k: int) -> None:
        """Close all elements from place k on."""
        while len(stack) > k:
            e = stack.pop()
            opened[e.name] -= 1
            w = weights.setdefault(e.token, [0, 0])
            w[0] += text - e.text
            w[1] += heads - e.heads

    at = 0
    for start, stop, name, closes, attributes in tags(page):
        if start > at:
            part = page[at:start]
            held.append(part)
            if not links:
                text += len(part) - part.count(" ")
        at = stop
        if not name:
            continue
        if closes:
            if name in INLINE:
                links -= name == "a" and links > 0
                continue
            close_block()
            if opened[name]:
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                close(k)
            links = 0
            continue
        if name in INLINE:
            if name == "br":
                held.append(" ")
            links += name == "a"
            continue
        close_block()
        links = 0
        if name in CLOSES_P and stack[-1].name == "p":
            close(len(stack) - 1)
        if name in ITEMS and any(opened[x] for x in ITEMS[name][0]):
            ends, within = ITEMS[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in ends:
                    close(k)
                    break
                if stack[k].name in within:
                    break
        top = stack[-1]
        label, found = name, {}
        if attributes:
            for key, a, b, c in NAMES.findall(attributes):
                found[key.lower()] = a or b or c
            if classes := found.get("class", "").split():
                label += "." + classes[0].lower()
        path = xxhash.xxh3_64_intdigest(f"{top.path}/{label}")
        article = top.article
        if name in ("article", "main") and not article:
            articles += 1
            article = articles
        out = (
            top.out
            or name in OUT_ELEMENTS
            or (name == "header" and not article)
            or found.get("role", "").lower() in OUT_ROLES
            or "hidden" in found
            or found.get("aria-hidden") == "true"
            or bool(found and name not in ("html", "body", "article", "main") and name not in TEXT_ELEMENTS and names_other(found))
        )
        token = token_id("t", path)
        sequence.append(token)
        heads += name == "h1"
        if name in VOID or attributes.rstrip().endswith("/"):
            weights.setdefault(token, [0, 0])
        else:
            stack.append(_Open(name, path, out, article, top.main or token == main, token, text, heads - (name == "h1")))
            opened[name] += 1
    rest = page[at:]
    held.append(rest)
    text += len(rest) - rest.count(" ")
    close_block()
    close(1)
    weights[0] = [text, heads]
    return Page(blocks, sequence, weights)


def host_of(url: str) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", url or "")
    return m[1].lower() if m else ""


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """url, html to host, token, pages, vector, text, heads: partial sums over each batch. Token 0 stands for the page itself."""
    for batch in batches:
        sums: dict[tuple[str, int], list[int]] = {}
        for url, html in zip(strings(batch.column(0)), strings(batch.column(1))):
            host, page = host_of(url), parse(html)
            key = xxhash.xxh3_64_intdigest("\0".join(b.text for b in page.blocks if not b.out)) | 1
            counts: dict[int, int] = defaultdict(int)
            for t in page.sequence:
                counts[t] += 1
            counts[0] = 1
            for t, n in counts.items():
                s = sums.setdefault((host, t), [0, 0, 0, 0])
                s[0] += 1
                s[1] = (s[1] + n * key) & (2**64 - 1)
                if w := page.weights.get(t):
                    s[2] += w[0]
                    s[3] += w[1]
        columns = list(zip(*sums.values())) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()), pa.array(columns[0], pa.int64()), pa.array(np.array(columns[1], np.uint64).view(np.int64)), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
            ["host", "token", "pages", "vector", "text", "heads"],
        )


def templates(pages: DataFrame, support: int = SUPPORT, share: float = SHARE, main: float = MAIN) -> DataFrame:
    """host, main, classes: the main element's token, and (token, class) of the classes with enough support.

    A token is kept that is on ``share`` of the host's pages, so there are at most
    1 / share times as many as tokens on a page.
    """
    seen = pages.select("url", "html").mapInArrow(occurrences, "host string, token long, pages long, vector long, text long, heads long")
    # The vectors' sums wrap around on purpose; a decimal sum brought back to 64 bits does so without overflow errors.
    wrap = F.expr("cast(pmod(sum(cast(vector as decimal(38,0))), 18446744073709551616BD) as decimal(20,0))")
    tokens = checkpoint(seen.groupBy("host", "token").agg(F.sum("pages").alias("pages"), wrap.alias("vector"), F.sum("text").alias("text"), F.sum("heads").alias("heads")).where(F.col("pages") >= support))
    hosts = tokens.where("token = 0").select("host", F.col("pages").alias("host_pages"), F.col("vector").alias("once"), F.col("text").alias("all"), F.col("heads").alias("all_heads"))
    kept = tokens.where("token != 0").join(hosts, "host").where(F.col("pages") >= share * F.col("host_pages"))
    holds = (F.col("vector") == F.col("once")) & (F.col("text") > 0) & (F.col("text") >= F.lit(main) * F.col("all")) & ((F.col("all_heads") != F.col("host_pages")) | (F.col("heads") == F.col("host_pages")))
    smallest = F.min(F.when(holds, F.struct("text", "token")))["token"]
    return kept.groupBy("host").agg(F.coalesce(smallest, F.lit(0).cast("long")).alias("main"), F.collect_list(F.struct("token", F.xxhash64("vector").alias("class"))).alias("classes"))


def nested(a: list[list[int]], b: list[list[int]]) -> bool:
    """Whether the rounds (places of the tokens) of one class lie each in one gap of the other."""

    def within(rounds: list[list[int]], other: list[list[int]]) -> bool:
        places = [p for r in other for p in r]
        return all(bisect_left(places, r[0]) == bisect_left(places, r[-1]) for r in rounds)

    return within(a, b) or within(b, a)


def holding(sequence: list[int], classes: dict[int, int]) -> set[int]:
    """Template tokens of the classes that hold on this page: equally often, in one order, and nested."""
    by_class: dict[int, list[int]] = defaultdict(list)
    places: dict[int, list[int]] = defaultdict(list)
    for at, t in enumerate(sequence):
        if (c := classes.get(t)) is not None:
            by_class[c].append(t)
            places[c].append(at)
    members: dict[int, set[int]] = defaultdict(set)
    for t, c in classes.items():
        members[c].add(t)
    held: set[int] = set()
    spans: list[list[list[int]]] = []
    for c, tokens in sorted(by_class.items(), key=lambda x: (-len(members[x[0]]), places[x[0]][0])):
        n = len(members[c])
        first = tokens[:n]
        if set(first) == members[c] and tokens == first * (len(tokens) // n):
            rounds = [places[c][k : k + n] for k in range(0, len(tokens), n)]
            if n > 1:
                if not all(nested(rounds, other) for other in spans):
                    continue
                spans.append(rounds)
            held |= members[c]
    return held


def main_text(page: str, classes: dict[int, int], main: int = 0, names: bool = True) -> str:
    """The text of a page, given its host's template."""
    found = parse(page, main)
    blocks = found.blocks
    fixed = holding(found.sequence, classes) if classes else set()
    out = (lambda b: b.out) if names else (lambda b: False)
    # Fixed and other text of each article.
    size: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for b in blocks:
        if names and not b.out:
            size[b.article][b.token not in fixed] += len(b.text)
    repeated = {a for a, (same, other) in size.items() if a and same > other}
    slots = [b for b in blocks if not out(b) and (b.token not in fixed or (names and b.article in repeated))]
    chosen = [b for b in slots if names and b.article] or [b for b in slots if b.main]
    return "\n".join(b.text for b in chosen or slots)


Template = tuple[int, dict[int, int]]


def _extract(batches: Iterator[pa.RecordBatch], known: dict[str, Template] | None, names: bool) -> Iterator[pa.RecordBatch]:
    none: Template = (0, {})
    kept: dict[str, Template] = {}
    for batch in batches:
        hosts, pages = [host_of(u) for u in strings(batch.column(1))], strings(batch.column(2))
        if known is None:
            main, classes = (batch.column(batch.schema.get_field_index(c)) for c in ("main", "classes"))
            if len(kept) > 2_000:
                kept.clear()
            for i, h in enumerate(hosts):
                if h not in kept:
                    kept[h] = (main[i].as_py() or 0, {r["token"]: r["class"] for r in classes[i].as_py() or []})
        texts = []
        for h, page in zip(hosts, pages):
            main_token, of = (kept if known is None else known).get(h, none)
            texts.append(main_text(page, of, main_token, names))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


OUT = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, support: int = SUPPORT, share: float = SHARE, broadcast_bytes: int = BROADCAST_BYTES, names: bool = True) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    known = checkpoint(templates(source, support, share))
    size = known.agg(F.sum(F.size("classes") * 16 + F.length("host") + 24)).first()[0] or 0
    if size <= broadcast_bytes:
        # The size has just been checked; the pages need not move.
        rows = {r["host"]: (r["main"], {c["token"]: c["class"] for c in r["classes"]}) for r in known.toLocalIterator()}
        shared = pages.sparkSession.sparkContext.broadcast(rows)
        return source.mapInArrow(lambda it: _extract(it, shared.value, names), OUT)
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    salted = source.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)))
    copies = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return salted.join(copies, ["host", "salt"], "left").select("page_id", "url", "html", "main", "classes").mapInArrow(lambda it: _extract(it, None, names), OUT)
