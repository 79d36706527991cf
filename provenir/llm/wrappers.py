"""Main text of web pages by wrappers: union-free regular expressions over the token streams of a host.

A page is a stream of tokens: each block of text under its path of elements. A text that stands under
one path on nearly all pages of a host is a token of the template's own (a literal); all other texts
are slots. The streams of a host are folded into one expression: neighbouring repeats become repeated
groups, and tokens that some streams lack become optional. Equal pages count once, equal streams are
folded once, in small batches, level by level, so that a host with a third of all pages is no larger
a task than another. Each page is then matched against its host's expression, and the slots that make
up the article are read from it.

Variation alone cannot tell an article from an advert or a reader's comment, which vary too: slots
are told apart by the role that HTML gives their elements, by the names that pages give them, by
their links, and by where most of the text is.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Streams that are folded in one step.
FAN = 64
#: Wrappers up to this many bytes go to all tasks; beyond it they are joined by host.
BROADCAST = 16 << 20
SALTS = 64
#: A literal stands on so many pages of a host at least, and on this part of them. Pages whose longest
#: text is the same count as one, so that copies of an article do not make its text a literal.
PAGES, SHARE = 8, 0.9
#: Between the path of a literal and the digest of its text.
IS = "\x1f"

# Elements of HTML by their role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object xmp noframes noembed".split())
OUTSIDE = frozenset("head nav footer aside form button select dialog menu fieldset search script style noscript template title svg math iframe object canvas audio video textarea".split())
CLOSED_BY_SAME = frozenset("p li dt dd tr td th option".split())
# Words in classes and ids of what is no article.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs "
    "header masthead topbar footer sidebar aside widget widgets related recommended share sharing social newsletter subscribe subscription signup login search comment comments commentlist disqus reply replies respond discussion toolbar pager pagination skip".split()
)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAME = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def _label(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """An element's name in paths, whether it is furniture, whether it is the main part."""
    words, main = [], tag in ("article", "main")
    for kind, a, b, c in _NAME.findall(attributes):
        value = (a or b or c).lower()
        if kind.lower() == "role":
            main |= value in ("main", "article")
            words += ["navigation" if value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert") else ""]
        else:
            words += re.split(r"[\s_-]+", value)
    words = [re.sub(r"\d+", "#", w) for w in words if w]
    out = tag in OUTSIDE or tag not in ("html", "body", "article", "main") and not FURNITURE.isdisjoint(words)
    return ".".join([tag, *dict.fromkeys(words[:4])]), out, main


def blocks(page: str | None) -> list[tuple[str, str, int]]:
    """(path, text, characters in links) of each block with text, in page order.

    A path is marked with ``!`` at its first element of furniture and with ``*`` at its main part.
    """
    source, out = page or "", []
    stack: list[tuple[str, str]] = []  # element, path
    text: list[str] = []
    linked, links, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        words = " ".join(html.unescape("".join(text)).split()) if text else ""
        if words:
            out.append((stack[-1][1] if stack else "", words, linked))
        text.clear()
        linked = 0

    while True:
        found = _TAG.search(source, at)
        piece = source[at : found.start() if found else len(source)]
        if piece:
            text.append(piece)
            linked += len(piece) if links else 0
        if not found:
            break
        at = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if closing else 1
        if tag in INLINE:
            continue
        flush()
        if closing:
            if any(e == tag for e, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in CLOSED_BY_SAME and stack and stack[-1][0] == tag:
            stack.pop()
        name, furniture, main = _label(tag, attributes)
        above = stack[-1][1] if stack else ""
        if main and "*" not in above:  # whatever was left open before it
            above, name = above.replace("!", ""), name + "*"
        if furniture and not (tag == "header" and "*" in above) and "!" not in above:
            name += "!"
        if tag == "header" and "*" not in above and "!" not in above + name:
            name += "!"
        stack.append((tag, f"{above}>{name}" if above else name))
    flush()
    return out


def folded(stream: list[list]) -> list[list]:
    """Neighbouring repeats of up to four blocks become one repeated group (entries: path, optional, repeated, ...)."""
    out = stream
    for period in (1, 2, 3, 4):
        kept: list[list] = []
        for x in out:
            kept.append(x)
            if len(kept) >= 2 * period and [e[0] for e in kept[-period:]] == [e[0] for e in kept[-2 * period : -period]]:
                for a, b in zip(kept[-2 * period : -period], kept[-period:]):
                    _join(a, b)
                    a[2] = True
                del kept[-period:]
        out = kept
    return out


def _join(a: list, b: list) -> None:
    """Fold an entry into another: [token, optional, repeated, characters, characters in links]."""
    a[1], a[2], a[3], a[4] = a[1] or b[1], a[2] or b[2], a[3] + b[3], a[4] + b[4]


def aligned(a: list[list], b: list[list]) -> list[list]:
    """One expression for two: common blocks in order stay, what only one has becomes optional."""
    x, y = [e[0] for e in a], [e[0] for e in b]
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    n, m = len(x) - head - tail, len(y) - head - tail
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[head + i] == y[head + j] else max(best[i + 1][j], best[i][j + 1])
    out: list[list] = []

    def both(p: list, q: list) -> None:
        _join(p, q)
        out.append(p)

    for k in range(head):
        both(a[k], b[k])
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and x[head + i] == y[head + j]:
            both(a[head + i], b[head + j])
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[head + i][0], True, *a[head + i][2:]])
            i += 1
        else:
            out.append([b[head + j][0], True, *b[head + j][2:]])
            j += 1
    for k in range(tail, 0, -1):
        both(a[-k], b[-k])
    return folded(out)


def reading(wrapper: list[list]) -> list[bool]:
    """Which entries of an expression the article is read from: never literals, nor what lies in furniture.

    Of a main part all slots are. Without one: the slots that are not mostly links, below the smallest
    element that holds four fifths of their text, and the headings of the first order before it.
    """
    slot = [IS not in e[0] and "!" not in e[0] for e in wrapper]
    free = [e for e, own in zip(wrapper, slot) if own and "*" not in e[0] and 2 * e[4] < max(e[3], 1)]
    mass: dict[str, int] = {}
    for e in free:
        parts = e[0].split(">")
        for k in range(1, len(parts) + 1):
            above = ">".join(parts[:k])
            mass[above] = mass.get(above, 0) + e[3]
    whole = sum(e[3] for e in free)
    root = max((p for p, v in mass.items() if 5 * v >= 4 * whole), key=lambda p: p.count(">"), default="")
    below = {e[0] for e in free if e[0] == root or e[0].startswith(root + ">") or not root or e[0].rpartition(">")[2].split(".")[0] == "h1"}
    return [own and ("*" in e[0] or e[0] in below and 2 * e[4] < max(e[3], 1)) for e, own in zip(wrapper, slot)]


class Expression:
    """The expression of a host, ready to be matched (without one, every block outside furniture is read)."""

    def __init__(self, wrapper: list[list]):
        self.read = reading(wrapper)
        self.literals = {e[0] for e in wrapper if IS in e[0]}
        self.places: dict[str, list[int]] = {}
        for k, e in enumerate(wrapper):
            self.places.setdefault(e[0], []).append(k)

    def matched(self, tokens: list[str]) -> list[int | None]:
        """The entry that each token of a page stands for: the next one of its name, or in a repeated group one that came before."""
        out, at = [], 0
        for t in tokens:
            known = self.places.get(t)
            if known is None:
                out.append(None)
                continue
            k = bisect_left(known, at)
            at = known[k] if k < len(known) else known[-1]
            out.append(at)
        return out


def text_digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def article(found: list[tuple[str, str, int]], expression: Expression) -> str:
    """The text that the host's expression reads from a page; a page with a main part is read there only.

    Where it reads nothing from a page without a main part, all slots outside furniture are read.
    """
    tokens = [p for p, _, _ in found]
    if expression.literals:
        tokens = [name if (name := f"{p}{IS}{text_digest(t)}") in expression.literals else p for p, t, _ in found]
    main = any("*" in p and "!" not in p for p, _, _ in found)
    inside = [(k, IS in name, t) for name, k, (p, t, _) in zip(tokens, expression.matched(tokens), found) if "!" not in p and (not main or "*" in p)]
    out = [t for k, literal, t in inside if not literal and (k is None or expression.read[k])]
    return " ".join(out if out or main else [t for _, literal, t in inside if not literal])


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


_TOKENS = "host string, page long, body long, paths array<string>, texts array<long>, chars array<int>, links array<int>"
_STREAM = "host string, stream long, pos int, path string, repeated boolean, chars long, links long"
_WRAPPER = "host string, no long, wrapper string"


def tokens(pages: DataFrame) -> DataFrame:
    """A row for each different page of a host: the paths, digests and lengths of its blocks, and which its longest text is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for url, page in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    found = blocks(page)
                    paths, texts, chars = [p for p, _, _ in found], [text_digest(t) for _, t, _ in found], [len(t) for _, t, _ in found]
                    body = texts[chars.index(max(chars))] if found else 0
                    rows.append((host_of(url), text_digest("\n".join([*paths, *map(str, texts)])), body, paths, texts, chars, [n for _, _, n in found]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in _TOKENS.split(", ")])

    own = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, _TOKENS)
    return stored(own.dropDuplicates(["host", "page"]), "page-tokens")


def literals(found: DataFrame) -> DataFrame:
    """(host, literals): the tokens of the template's own, at most a page's blocks for each host."""
    each = found.select("host", "body", F.explode(F.arrays_zip("paths", "texts")).alias("x")).select("host", "body", "x.*").distinct()
    bodies = found.select("host", "body").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") >= PAGES)
    counted = each.groupBy("host", "paths", "texts").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PAGES)
    own = counted.join(bodies, "host").where(F.col("n") >= SHARE * F.col("all"))
    return stored(own.groupBy("host").agg(F.collect_list(F.concat("paths", F.lit(IS), F.col("texts").cast("string"))).alias("literals")), "literals")


def streams(found: DataFrame, own: DataFrame) -> DataFrame:
    """A row for each token of each different page's folded stream; ``stream`` numbers equal ones alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("host", pa.string()), ("stream", pa.int64()), ("pos", pa.int32()), ("path", pa.string()), ("repeated", pa.bool_()), ("chars", pa.int64()), ("links", pa.int64())])
        for batch in batches:
            rows = []
            for host, paths, texts, chars, links, known in zip(*(c.to_pylist() for c in batch.columns)):
                held = set(known or ())
                stream = folded([[name if (name := f"{p}{IS}{t}") in held else p, False, False, c, n] for p, t, c, n in zip(paths, texts, chars, links)])
                number = text_digest("\n".join(f"{e[0]}{e[2]}" for e in stream))
                rows += [(host, number, k, e[0], e[2], e[3], e[4]) for k, e in enumerate(stream)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    return found.join(own, "host", "left").select("host", "paths", "texts", "chars", "links", "literals").mapInArrow(run, _STREAM)


def wrappers(pages: DataFrame, fan: int = FAN) -> DataFrame:
    """(host, wrapper): the expression of each host, as JSON."""
    found = tokens(pages)
    own = streams(found, literals(found))
    equal = stored(own.groupBy("host", "stream", "pos", "path", "repeated").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links")), "streams")
    most = equal.select("host", "stream").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    levels = 1
    while fan**levels < most:
        levels += 1

    def first(frame: pd.DataFrame) -> pd.DataFrame:
        done: list[list] | None = None
        for _, one in frame.sort_values(["stream", "pos"]).groupby("stream", sort=True):
            stream = [[p, False, bool(r), int(c), int(n)] for p, r, c, n in one[["path", "repeated", "chars", "links"]].itertuples(index=False)]
            done = stream if done is None else aligned(done, stream)
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "no": [int(frame["no"].iloc[0])], "wrapper": [json.dumps(done)]})

    def again(frame: pd.DataFrame) -> pd.DataFrame:
        done: list[list] | None = None
        for text in frame.sort_values("from")["wrapper"]:
            done = json.loads(text) if done is None else aligned(done, json.loads(text))
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "no": [int(frame["no"].iloc[0])], "wrapper": [json.dumps(done)]})

    made = equal.withColumn("no", F.pmod("stream", F.lit(fan ** (levels - 1)))).groupBy("host", "no").applyInPandas(first, _WRAPPER)
    for level in range(levels - 2, -1, -1):
        made = made.select("host", F.col("no").alias("from"), F.pmod("no", F.lit(fan**level)).alias("no"), "wrapper").groupBy("host", "no").applyInPandas(again, _WRAPPER)
    return stored(made.select("host", "wrapper"), "wrappers")


_NONE = Expression([])


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    Null and empty pages have an empty text. Pages without a host (or with a malformed URL) share
    one expression. Repeated rows are read each, and equal pages count once for the expression; other
    columns, whatever their names, are not carried; an empty table gives no rows.
    """
    spark = pages.sparkSession
    found = wrappers(pages)
    size = found.agg(F.sum(F.length("host") + F.length("wrapper")).alias("n")).first()["n"] or 0
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def texts(batch: pa.RecordBatch, own: list[Expression]) -> pa.RecordBatch:
        text = [article(blocks(h.as_py()), e) for h, e in zip(batch.column(2), own)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if size <= BROADCAST:
        known = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in found.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: dict[str, Expression] = {}
            for batch in batches:
                hosts = [host_of(u.as_py()) for u in batch.column(1)]
                for h in set(hosts).difference(made):
                    made[h] = Expression(json.loads(known.value[h])) if h in known.value else _NONE
                yield texts(batch, [made[h] for h in hosts])

        return rows.mapInArrow(run, out)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {w: Expression(json.loads(w)) for w in set(batch.column(3).to_pylist()) if w is not None}
            yield texts(batch, [made.get(w, _NONE) for w in batch.column(3).to_pylist()])

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host_of(u.as_py()) for u in batch.column(1)], pa.string())], [*batch.schema.names, "host"])

    placed = rows.mapInArrow(hosts, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, html string, host string")
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)))
    each = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(each, ["host", "salt"], "left").select("page_id", "url", "html", "wrapper").mapInArrow(joined, out)


def op4_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages``; see ``main_texts``."""
    return main_texts(table(spark, sf_dir, "pages"))
