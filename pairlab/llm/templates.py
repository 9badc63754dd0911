"""Main text of web pages by equivalence-class template deduction.

A token is an element with its path (the names, classes and ids of the elements around it), or a block of
text with the path of its element. Tokens of a layout that occur equally often on every page have equal
occurrence vectors and form a class. A text in the class of the page itself, or in the class of its
own element where that is on every page, is template if the pages differ otherwise; all text between is
slots. A host's pages are of one layout if the same container holds most of their text; each layout has a
template of its own. Occurrence vectors are kept as hashes that Spark can merge, so a host's pages never come together.

Names in class and id only choose between slots: what they call no article is left out unless it holds
most of the page's text. Single words are no tokens: a label in a block that differs from page to page
belongs to its block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import batches_of, settle

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*|[^>]*)>""", re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_NAMES = re.compile(r"[a-z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_MARKS = re.compile(r"[>@~!]")
_words = lambda s: frozenset(s.split())

# Elements by the way HTML treats them.
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style textarea title iframe noembed noframes xmp")
INLINE = _words(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img"
)
CLOSES = {
    "li": (_words("li"), _words("ul ol menu")), "dt": (_words("dt dd"), _words("dl")), "dd": (_words("dt dd"), _words("dl")),
    "tr": (_words("tr td th"), _words("table")), "td": (_words("td th"), _words("tr table")),
    "th": (_words("td th"), _words("tr table")), "option": (_words("option"), _words("select")),
    "body": (_words("head"), _words("html")),
}
# Elements that never hold an article, whatever text they have.
NEVER = _words(
    "head nav footer button select option input textarea script style noscript template title iframe object embed svg canvas "
    "audio video map"
)
# What speaks against a slot.
NOISE = _words("aside label legend dialog menu")
WRAPS = _words("form fieldset")
NOISE_ROLES = _words("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar")
NOISE_NAMES = _words(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall sidebar sidenav rail "
    "menu nav navbar navigation breadcrumb breadcrumbs pager pagination toc footer footnav masthead topbar share sharing "
    "social related recommended recommendations comment comments respond reply replies discussion disqus login signup "
    "search widget toolbar skip copyright disclaimer"
)
HOLDERS = _words("html body article main")
# Elements of running text; what is around them is the container.
RUNNING = _words(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption address hr"
)
_ARTICLE = re.compile(r">(?:article(?=[.#@~!>]|$)|[^>]*@)")
_ELEMENT = re.compile(r"[^.#@~!]*")
_MAIN = re.compile(r">main(?=[.#@~!>]|$)")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text.strip(" \t\r\n/") else {}


def _against(name: str, attributes: dict[str, str], inside_article: bool) -> str:
    """What speaks against a slot: "~!" if element, role, style or all names do, "!" if some names do."""
    if name in NOISE or name == "header" and not inside_article:
        return "~!"
    if name in HOLDERS and name != "article":
        return ""
    if attributes.get("role", "").lower() in NOISE_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return "~!"
    if re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return "~!"
    named = set(_NAMES.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()))
    if name in WRAPS or named & NOISE_NAMES:
        return "~!" if named and named <= NOISE_NAMES else "!"
    return ""


def _hints(path: str) -> Iterator[str]:
    """The elements of a path that something speaks against, each with its own path."""
    at = path.find("!")
    while at >= 0:
        yield path[: at + 1]
        at = path.find("!", at + 1)


def slots(chars: dict[str, int]) -> set[str]:
    """The paths that hold the article, from path -> characters.

    An element that something speaks against is left out, unless it holds most of the text or nothing
    else is left; if all speaks against it and another has text in an article or main element, it is left
    out anyway. Of the rest, articles or else main elements are enough if they hold half of it.
    """
    total, under = sum(chars.values()), {}
    for path, n in chars.items():
        for hint in _hints(path):
            under[hint] = under.get(hint, 0) + n
    marked = any("!" not in p and (_ARTICLE.search(p) or _MAIN.search(p)) for p in chars)
    off = {hint for hint, n in under.items() if 2 * n <= total or marked and hint.endswith("~!")}
    rest = {p for p in chars if not any(hint in off for hint in _hints(p))}
    left = sum(chars[p] for p in rest)
    if not left:
        rest, left = set(chars), total
    for kind in (_ARTICLE, _MAIN):
        inside = {p for p in rest if kind.search(p)}
        if inside and 2 * sum(chars[p] for p in inside) >= left:
            return inside
    return rest


class Page:
    """A page's elements, how often each occurs, and its blocks of text.

    `blocks` are [path, text] in page order; a block after a block boundary begins with a space.
    A path's element ends with @ if it is marked as main, and with what speaks against it.
    """

    def __init__(self, html: str) -> None:
        self.blocks: list[list[str]] = []
        self.counts: dict[str, int] = {"": 1}
        # open elements: name, path, whether never text, path of the nearest block
        stack = [("", "", False, "")]
        at, space = 0, True

        def text(part: str) -> None:
            nonlocal space
            _, _, never, block = stack[-1]
            if part and not never:
                part = unescape(part)
                if self.blocks and not space and self.blocks[-1][0] == block:
                    self.blocks[-1][1] += part
                else:
                    self.blocks.append([block, " " + part if space else part])
                space = False

        while at < len(html):
            found = _MARKUP.search(html, at)
            if not found:
                text(html[at:])
                break
            text(html[at : found.start()])
            at = found.end()
            if found[2] is None:
                if found[0].startswith("<![CDATA["):
                    text(found[0][9:].removesuffix("]]>"))
                continue
            name = found[2].lower()
            if name not in INLINE:
                space = True
            if found[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                continue
            if name in VOID:
                continue
            if name in CLOSES:
                ends, within = CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        del stack[k:]
                    elif stack[k][0] in within:
                        break
            elif name not in INLINE and any(s[0] == "p" for s in stack):
                # A block ends the open paragraph, with all that it left open.
                k = max(i for i, s in enumerate(stack) if s[0] == "p")
                del stack[k:]
            attributes = _attributes(found[3])
            _, path, never, block = stack[-1]
            never = never or name in NEVER
            against = _against(name, attributes, "article" in path)
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = close.end() if close else len(html)
                continue
            own = ""
            if name not in INLINE:
                own = name + "".join("." + c for c in sorted(attributes.get("class", "").split()))
                if attributes.get("id"):
                    own += "#" + attributes["id"]
                # Numbers tell pages apart, not layouts.
                own = _DIGITS.sub("0", _MARKS.sub("_", own))
                if attributes.get("role", "").lower() == "main" or attributes.get("itemprop", "").lower() == "articlebody":
                    own += "@"
            elif against:
                own = name
            if not own:
                stack.append((name, path, never, block))
                continue
            path = f"{path}>{own}{against}"
            stack.append((name, path, never, path))
            if not never:
                self.counts[path] = self.counts.get(path, 0) + 1

    def tokens(self) -> list[int]:
        """Of each block, a hash of its path and text; 0 if it is blank."""
        return [_hash(f"{p}\0{plain}") if (plain := " ".join(t.split())) else 0 for p, t in self.blocks]


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) or 1


def sizes(blocks: list, but: frozenset[int] = frozenset()) -> dict[str, int]:
    """Characters of text directly in each path, without the blocks of these numbers."""
    out: dict[str, int] = {}
    for k, (path, part) in enumerate(blocks):
        n = 0 if k in but else len(part.strip())
        if n:
            out[path] = out.get(path, 0) + n
    return out


def layout(blocks: list, inside: set[str]) -> str:
    """The container of most of the text in the slots, with its path: pages of one layout share it."""
    held: dict[str, int] = {}
    for path, n in sizes(blocks).items():
        if path in inside:
            while path and _ELEMENT.match(path.rpartition(">")[2])[0] in RUNNING:
                path = path.rpartition(">")[0]
            held[path] = held.get(path, 0) + n
    return min(held, key=lambda p: (-held[p], p), default="")


def main_text(blocks: list, tokens: list[int], template: frozenset[int]) -> str:
    """The text in the slots. A page of nothing but template is read as if it were alone on its host."""
    fixed = frozenset(k for k, t in enumerate(tokens) if t in template)
    chars = sizes(blocks, fixed)
    if not chars:
        fixed, chars = frozenset(), sizes(blocks)
    found = slots(chars)
    return " ".join("".join(t if k not in fixed else " " for k, (p, t) in enumerate(blocks) if p in found).split())


def host(url: Column) -> Column:
    """The host of a url in lower case; empty if there is none."""
    found = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def templates(pages: DataFrame, support: int = 4, flush: int = 200_000) -> DataFrame:
    """host, layout, template: the tokens of each layout's template texts. `pages` has host and html.

    A task sends each token once, with its pages, the xor of hashes of (page, occurrences) and the
    characters; sums finish in a shuffle. Only texts on all of a layout's pages are kept then, so a
    list is no longer than a page however many pages there are. A layout needs `support`
    different pages; copies count once. Texts that outweigh the slots are no template: they are copies.
    """

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        sums: dict[tuple[str, int, int, int], list[int]] = {}
        known: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in sums.items()]
            sums.clear()
            known.clear()
            kinds = [pa.string()] + [pa.int64()] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                names=["host", "layout", "path", "token", "n", "vector", "chars"],
            )

        def name(path: str) -> int:
            if path not in known:
                known[path] = _hash(path)
            return known[path]

        for batch in source:
            for where, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                number += 1
                page = Page(html or "")
                chars = sizes(page.blocks)
                inside = slots(chars)
                kind, tokens = name(layout(page.blocks, inside)), page.tokens()
                whole = _hash(" ".join("".join(t for p, t in page.blocks if p in inside).split()))
                found = {(0, 0): [1, sum(chars[p] for p in inside)], (0, whole): [1, 0]}
                for path in chars:
                    found[name(path), 0] = [page.counts[path], 0]
                for (path, text), token in zip(page.blocks, tokens):
                    if token:
                        own = found.setdefault((name(path), token), [0, 0])
                        own[0] += 1
                        own[1] += len(text.strip()) if path in inside else 0
                seen: dict[int, int] = {}
                for key, (times, n) in found.items():
                    if times not in seen:
                        vector = blake2b(b"%d %d %d" % (part, number, times), digest_size=8).digest()
                        seen[times] = int.from_bytes(vector, "little", signed=True)
                    own = sums.setdefault((where, kind, *key), [0, 0, 0])
                    own[0] += 1
                    own[1] ^= seen[times]
                    own[2] += n
                if len(sums) >= flush:
                    yield out()
        if sums:
            yield out()

    seen = settle(pages.select("host", "html").mapInArrow(
        count, "host string, layout long, path long, token long, n long, vector long, chars long"
    ).groupBy("host", "layout", "path", "token").agg(
        F.sum("n").alias("n"), F.bit_xor("vector").alias("vector"), F.sum("chars").alias("chars")
    ).filter((F.col("path") == 0) | (F.col("n") >= support)), "tokens")
    by = ["host", "layout"]
    different = seen.filter("path = 0 and token <> 0").groupBy(*by).count().filter(F.col("count") >= support)
    total = seen.filter("path = 0 and token = 0").select(
        *by, F.col("n").alias("pages"), F.col("vector").alias("every"), F.col("chars").alias("total")
    ).join(different, by)
    elements = seen.filter("path <> 0 and token = 0").select(*by, "path", F.col("vector").alias("own"))
    fixed = seen.filter("path <> 0 and token <> 0").join(total, by).filter("n = pages").join(elements, [*by, "path"])
    return fixed.filter("vector = every or vector = own").groupBy(*by).agg(
        F.collect_list("token").alias("template"), F.sum("chars").alias("chars"), F.max("total").alias("total")
    ).filter("2 * chars <= total").select(*by, "template")


def extract(
    df: DataFrame, key: str, url: str, html: str, few_hosts: int = 100_000, salts: int = 64
) -> DataFrame:
    """key, url and the main text of every page (empty if it has none).

    Character references are decoded, white space within and between blocks becomes one space.
    A page of a layout without template has all its text in slots. Null html is an empty page, a null
    or odd url belongs to the host without name; keys may be null or repeat; no rows give no rows;
    other columns are not read.

    Templates, one short row per layout, are broadcast up to `few_hosts`; beyond, they are joined with
    each layout's pages dealt to `salts` parts.
    """
    pages = df.select(
        F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"),
        host(F.col(url).cast("string")).alias("host"),
    )
    found = settle(templates(pages), "templates")
    schema = T.StructType([
        T.StructField("key", pages.schema["key"].dataType), T.StructField("url", T.StringType()), T.StructField("host", T.StringType()),
        T.StructField("layout", T.LongType()), T.StructField("paths", T.ArrayType(T.StringType())),
        T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("texts", T.ArrayType(T.StringType())),
        T.StructField("tokens", T.ArrayType(T.LongType())),
    ])

    def parse(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)))
            for part in batches_of(rows, 2, 1 << 22, 1024):
                out = []
                for name, link, body, where in part:
                    page = Page(body or "")
                    kind = layout(page.blocks, slots(sizes(page.blocks)))
                    paths = {p: i for i, p in enumerate(dict.fromkeys(p for p, _ in page.blocks))}
                    out.append((
                        name, link, where, _hash(kind), list(paths), [paths[p] for p, _ in page.blocks],
                        [t for _, t in page.blocks], page.tokens(),
                    ))
                kinds = [
                    batch.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()),
                    pa.list_(pa.string()), pa.list_(pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=schema.names)

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 7)))
            texts = [
                main_text([(paths[i], t) for i, t in zip(at, parts)], tokens, frozenset(template or ()))
                for paths, at, parts, tokens, template in rows
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["key", "url", "text"]
            )

    parsed = pages.select("key", "url", "html", "host").mapInArrow(parse, schema)
    if found.limit(few_hosts + 1).count() <= few_hosts:
        joined = parsed.join(F.broadcast(found), ["host", "layout"], "left")
    else:
        dealt = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = parsed.withColumn("salt", F.pmod(F.xxhash64("key", "tokens"), F.lit(salts)).cast("int"))
        joined = salted.join(dealt, ["host", "layout", "salt"], "left")
    done = T.StructType([schema["key"], schema["url"], T.StructField("text", T.StringType())])
    return joined.select("key", "url", "paths", "at", "texts", "tokens", "template").mapInArrow(read, done).withColumnRenamed("key", key)
