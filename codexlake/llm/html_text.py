"""Main text of web pages through wrappers, union-free regular expressions inferred for each host.

A page's tag stream becomes a tree of elements (name and first class word; inline markup is dropped), in which equal neighbours fold into a repeated group
and texts are leaves. Pages of one host are aligned with its wrapper one after the other: children that match merge, those without a counterpart become optional,
runs become repeated groups; a leaf whose text is the same on all pages so far is constant (template text), any other is a slot. Hosts can hold a third of all
pages, so pages of one shape are merged where they are read, what comes from one of PARTS groups of tasks is aligned, then the groups' wrappers with each other.

Main text are the slots in no element that is furniture, by its tag (FURNITURE) or a class or id (FURNITURE_WORDS), and constant leaves of fewer than TEMPLATE_PAGES
pages, about which the host tells nothing; where a wrapper has no slot at all (copies of one page), constants stay too. A page's text that equals the constant at its place is
the template's. Every page is matched with its host's wrapper, and of what it matches the leaves in an article are the result, those in a main element where it has
none, else all of them, as pages of one host can have several templates: character references decoded, white space inside a block one space, blocks in page order, one a line.

Null or empty html gives empty text; pages without a host share one wrapper; broken markup closes where HTML would close it; repeated pages each get their
row; a page nested deeper than DEPTH keeps its deeper text in the element at that depth; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.llm.common import shared_dir, small_side, table, written

PARTS, DEPTH, TEMPLATE_PAGES = 64, 200, 3
#: Shapes that a task holds before it hands them on.
HELD = 20_000
FURNITURE = frozenset("head nav footer aside form script style noscript template iframe button select option textarea svg math dialog menu object canvas audio video title".split())
FURNITURE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager comment comments reply replies discussion disqus respond share sharing social related recommended widget subscribe subscription newsletter signup login footer masthead toolbar skip".split())
#: Inline elements of these classes are adverts.
ADVERT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion".split())
#: A class or id with one of these words says that the other isn't there, or means something else.
UNLESS = frozenset("no not non without off free less has with disabled closed work works".split())
MAIN = frozenset(["article", "main"])
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes an open element of these, up to the limit beside them.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
P_ENDERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?<=/)>|<(?P<raw>script|style|textarea|noscript|iframe|template|svg|math)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*+>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


def marks(attributes: str) -> list[str]:
    """The words of classes, ids and roles that have none of UNLESS beside them."""
    out = []
    for _, a, b, c in ATTRIBUTE.findall(attributes):
        for token in (a or b or c).lower().split():
            words = [w for w in re.split(r"[^a-z]+", token) if w]
            out += words[:1] if UNLESS.intersection(words) and not FURNITURE_WORDS.intersection(words[:1]) else [] if UNLESS.intersection(words) else words
    return out


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str | None]]:
    """(path, text) of each run of text between block tags, text decoded; (path, None) where an element opens."""
    stack: list[str] = []
    held: list[str] = []

    def flush() -> Iterator[tuple[tuple[str, ...], str | None]]:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            yield tuple(stack), text

    def closed(names: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> int:
        """The depth to which an opening tag closes, the present one if to none."""
        to = len(stack)
        for k in range(len(stack) - 1, -1, -1):
            name = stack[k].partition(".")[0]
            if name in until:
                break
            if name in names:
                to = k
        return to

    at, advert, depth = 0, "", 0  # the inline advert that is open, and how deep
    for m in TOKEN.finditer(page):
        if not advert:
            held.append(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name == advert:
                depth += -1 if m["close"] else 1
                advert = advert if depth else ""
            elif advert:
                continue
            elif name == "br":
                held.append(" ")
            elif not m["close"] and name not in VOID and ADVERT_WORDS.intersection(marks(m["attrs"])):
                advert, depth = name, 1
            continue
        advert = ""
        yield from flush()
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].partition(".")[0] == name:
                    del stack[k:]
                    break
            continue
        if name in P_ENDERS:
            del stack[closed({"p"}, {"div", "article", "section", "td", "li", "body", "main", "aside", "footer", "nav"}) :]
        if name in CLOSES:
            del stack[closed(*CLOSES[name]) :]
        if name in VOID or m["attrs"].endswith("/"):
            continue
        words = marks(m["attrs"])
        mark = next((w for w in words if w in FURNITURE_WORDS), words[0] if words else "")
        if len(stack) < DEPTH:
            stack.append(f"{name}.{mark}" if mark else name)
            yield tuple(stack), None
    if not advert:
        held.append(page[at:])
    yield from flush()


def digest(text: str) -> int:
    """A hash of a leaf's text, never 0; under 2**53, as JSON readers hold numbers."""
    import xxhash

    return (xxhash.xxh3_64_intdigest(text) >> 11) or 1


#: A node of a skeleton or wrapper: [name, quantifier ("", "?", "+", "*"), children]; a leaf's name is "#", and its text's digest (0 for a slot) and up to
#: TEMPLATE_PAGES digests of the bodies of pages that have it follow: copies of a page, or pages that differ in their furniture alone, count once.
def skeleton(page: str) -> list:
    """The page's tree, equal neighbours folded."""
    root: list = ["", "", []]
    opened = [root]
    body: list[str] = []
    mark: list[int] = []
    for path, text in blocks(page):
        if text is not None and not any(map(furniture, path)):
            body.append(text)
        depth = len(path)
        del opened[depth + (text is not None) :]
        while len(opened) < depth:  # can't be, but for text in an element that has just opened
            opened.append(opened[-1][2][-1])
        if text is None:
            node = [path[-1], "", []]
            opened[-1][2].append(node)
            opened.append(node)
        elif not opened[-1][2] or opened[-1][2][-1][0] != "#":
            opened[-1][2].append(["#", "", [], digest(text), mark])
        else:
            opened[-1][2][-1][3] = 0
    mark.append(digest("\n".join(body)))
    return fold(root)


def many(q: str) -> str:
    return {"": "+", "?": "*"}.get(q, q)


def maybe(q: str) -> str:
    return {"": "?", "+": "*"}.get(q, q)


def fold(node: list) -> list:
    """Neighbours of one name become one repeated node; so do repeated pairs of names."""
    if node[0] == "#":
        return node
    name, q, children = node
    out: list = []
    for c in map(fold, children):
        if out and out[-1][0] == c[0] and c[0] != "#":
            out[-1] = repeated(merge(out[-1], c))
        elif len(out) > 2 and out[-2][0] == c[0] and out[-3][0] == out[-1][0]:  # a b a + b: the pair repeats
            out[-3:] = [repeated(merge(out[-3], out[-1])), repeated(merge(out[-2], c))]
        else:
            out.append(c)
    return [name, q, out]


def repeated(node: list) -> list:
    return [node[0], many(node[1]), *node[2:]]


def merge(a: list, b: list) -> list:
    """The wrapper of two nodes of one name."""
    q = a[1] if a[1] == b[1] else "*" if "*" in (a[1], b[1]) or {a[1], b[1]} == {"?", "+"} else "".join((a[1], b[1]))
    if a[0] == "#":
        return ["#", q, [], a[3] if a[3] == b[3] else 0, a[4] if a[4] == b[4] else sorted({*a[4], *b[4]})[:TEMPLATE_PAGES]]
    return [a[0], q, align(a[2], b[2])]


def align(a: list, b: list) -> list:
    """Children in one order: a longest common subsequence of names merges, the rest is optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [merge(x, y) for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], maybe(a[i][1]), *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], maybe(b[j][1]), *b[j][2:]])
            j += 1
    tidy: list = []
    for c in out:  # an optional node beside one of its name is a repetition
        if tidy and tidy[-1][0] == c[0]:
            merged = merge(tidy[-1], c)
            tidy[-1] = repeated(merged) if c[0] != "#" else merged
        else:
            tidy.append(c)
    return tidy


def shape(node: list) -> list:
    """A skeleton or wrapper without its texts."""
    return [node[0], node[1], [shape(c) for c in node[2]]]


def same_shape(a: list, b: list) -> list:
    """The wrapper of two of one shape."""
    if a[0] == "#":
        return merge(a, b)
    return [a[0], a[1], [same_shape(x, y) for x, y in zip(a[2], b[2], strict=True)]]


def aligned(wrappers: Iterable[list]) -> list:
    """The wrapper of several: those of one shape merge leaf by leaf, then shape after shape."""
    by_shape: dict[str, list] = {}
    for w in wrappers:
        key = json.dumps(shape(w))
        by_shape[key] = same_shape(by_shape[key], w) if key in by_shape else w
    out: list | None = None
    for key in sorted(by_shape):
        out = merge(out, by_shape[key]) if out else by_shape[key]
    return out or ["", "", []]


def expression(node: list) -> str:
    """A wrapper as text, for reading."""
    inner = " ".join(map(expression, node[2]))
    body = ("#" if not node[3] else "=") if node[0] == "#" else f"<{node[0]}>{inner}</>" if inner else f"<{node[0]}/>"
    return f"({body}){node[1]}" if node[1] else body


def furniture(name: str) -> bool:
    tag, _, mark = name.partition(".")
    return tag in FURNITURE or mark in FURNITURE_WORDS and tag not in ("html", "body", *MAIN)


def leaves(wrapper: list) -> list[tuple[tuple[str, ...], int, int]]:
    """Path, digest (0 for a slot) and pages (up to TEMPLATE_PAGES) of a wrapper's leaves that are no furniture."""
    out: list[tuple[tuple[str, ...], int, int]] = []

    def walk(node: list, path: tuple[str, ...]) -> None:
        for c in node[2]:
            if c[0] == "#":
                out.append((path, c[3], len(c[4])))
            elif not furniture(c[0]) and not (c[0].partition(".")[0] == "header" and not any(x.partition(".")[0] in MAIN for x in path)):
                walk(c, (*path, c[0]))

    walk(wrapper, ())
    return out


@lru_cache(maxsize=512)
def _read(wrapper: str) -> tuple[dict[tuple[str, ...], int], frozenset[tuple[tuple[str, ...], int]]]:
    """The levels of its body paths: 0 in an article, 1 in a main element, 2 elsewhere; and its template texts, path and digest."""
    found = leaves(json.loads(wrapper))
    names = lambda path: {x.partition(".")[0] for x in path}
    levels = {p: 0 if "article" in (of := names(p)) else 1 if "main" in of else 2 for p, _, _ in found}
    tells = any(not h for _, h, _ in found)
    return levels, frozenset((p, h) for p, h, n in found if tells and h and n >= TEMPLATE_PAGES)


def extract(page: str, wrapper: str) -> str:
    """The text of the leaves that the page matches, without template text: those in an article if there are any, else in a main element, else all."""
    levels, template = _read(wrapper)
    found = [(levels[path], text) for path, text in blocks(page) if text is not None and path in levels and not (template and (path, digest(text)) in template)]
    least = min((level for level, _ in found), default=0)
    return "\n".join(text for level, text in found if level == least)


def host(url: str = "url") -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def wrappers(pages: DataFrame, where: str) -> DataFrame:
    """host, wrapper (JSON) from pages (host, html)."""
    from pyspark import TaskContext

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % PARTS
        held: dict[tuple[str, str], list] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"host": [h for h, _ in held], "part": pa.array([part] * len(held), pa.int32()), "wrapper": [json.dumps(w) for w in held.values()]})

        for b in batches:
            for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = skeleton(page)
                key = h, json.dumps(shape(w))
                held[key] = same_shape(held[key], w) if key in held else w
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(aligned(map(json.loads, pdf["wrapper"])))]})

    schema = "host string, wrapper string"
    shapes = pages.select("host", "html").mapInArrow(merged, "host string, part int, wrapper string")
    parts = written(shapes.groupBy("host", "part").applyInPandas(together, schema), where, "parts")
    return written(parts.groupBy("host").applyInPandas(together, schema), where, "wrappers")


def extracted(pages: DataFrame, where: str) -> DataFrame:
    """page_id, url, text, n_chars of pages (page_id, url, html)."""
    named = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host().alias("host"))
    found = small_side(wrappers(named, where), ("host", "wrapper"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x, w) for x, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return named.join(found, "host").select(F.col("page_id").cast("long"), "url", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of pages."""
    return extracted(table(spark, sf_dir, "pages", "page_id", "url", "html"), shared_dir(spark))
