"""HTML extraction by consensus host paths.

A page is read into elements and blocks of text. Every element has a generalised path: tags from the root down, each with its classes up to their first
digit, so that numbered classes of one template agree. A page's containers are scored by the text below them that is neither links nor within an element
whose tag, role, class or id says menu, header, footer, sidebar, notice, advert, form or comment. From the root down the page
follows the path that holds most of what its parent holds, to an article or as far as one does, and votes for it. Spark sums the votes by host and
path (map-side first, so a host with most of the pages is one row a path and task), and a host's winning paths are those with a tenth of its votes
at least. Each page is then extracted again: the elements of the first winning path that it has, in page order, or of its own path if it has none.

Winning paths are broadcast up to ``MOST`` bytes; beyond that they meet the pages in a join by host and one of ``SALTS`` parts of it.

Null pages are empty; a page without text gives an empty text; pages without a host, null urls included, follow their own path. Every row of the
input gives one row, repeated rows too; all columns of the input, whatever their names, are kept; an empty table gives an empty
result. Unclosed, misnested and cut markup is read as far as it goes.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.words import column, groups
from factloom.shared import cut, drop, fresh

#: Share of its parent's text that a path must hold to be followed, share of a host's votes that a winning path has.
HOLDS, WINS = 0.6, 0.1
#: Bytes of winning paths that are broadcast at most; parts of a host in the join beyond that.
MOST, SALTS = 8 << 20, 32

# Kinds of HTML elements.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Opening one of the keys closes an open one of the values, as far as the nearest boundary.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
BOUNDARY = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}}
HOLDERS = frozenset("html body div section article main center table tbody tr td form fieldset blockquote dd dl li ul ol span".split())
# Tags, roles and words of classes and ids of what is not the article.
ASIDE_TAGS = frozenset("nav footer aside menu dialog search form button select noscript template svg canvas object audio video head map datalist".split())
ASIDE_ROLES = frozenset("navigation contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
ASIDE_WORDS = frozenset(
    "nav navi navbar navigation menu menus menubar breadcrumb breadcrumbs toolbar topbar pager pagination skip footer foot colophon copyright sidebar sidebars side aside rail widget widgets "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor "
    "sponsored promo promos promotion promotions comment comments commentlist disqus reply replies respond reactions discussion responses related recommended recommendations share sharing social "
    "subscribe subscription newsletter signup login search form trending".split()
)
HEADER_WORDS = frozenset("header masthead banner".split())
ASIDE, HEADER = 1, 2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _step(tag: str, given: dict) -> str:
    names = {re.split(r"\d", c, maxsplit=1)[0].strip("-_") for c in given.get("class", "").split()}
    return ".".join([tag, *sorted(n for n in names if n)]).replace("/", "-")


def _reason(tag: str, given: dict) -> int:
    """Why an element's text is not the article's, by its own marks."""
    if tag in ("html", "body"):
        return 0
    if tag in ASIDE_TAGS or given.get("role", "").lower() in ASIDE_ROLES or "hidden" in given or given.get("aria-hidden") == "true" or _HIDDEN.search(given.get("style", "")):
        return ASIDE
    words = {w.lower() for k in ("class", "id") if k in given for w in _WORD.findall(given[k])}
    if words & ASIDE_WORDS:
        return ASIDE
    return HEADER if tag == "header" or given.get("role") == "banner" or words & HEADER_WORDS else 0


class Page:
    """The elements of a page (parent, tag, path, reason) and its blocks of text (element, text, characters of it in links)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.own = [-1], [""], [0], [0]
        self.steps: dict[tuple[int, str], int] = {}
        self.names: list[tuple[int, str]] = [(-1, "")]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source or "")
        self._weigh()

    def _read(self, source: str) -> None:
        stack, pieces, linked, owner = [0], [], 0, 0
        parent, tags, blocks, open_tags, muted = self.parent, self.tag, self.blocks, Counter(), 0

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    blocks.append((owner, text, min(linked, len(text))))
                pieces.clear()
                linked = 0

        def close(depth: int) -> None:
            nonlocal owner, muted
            gone = stack[depth:]
            if any(tags[e] in BLOCK for e in gone):
                flush()
            del stack[depth:]
            for e in gone:
                open_tags[tags[e]] -= 1
                muted -= tags[e] not in BLOCK and self.own[e] == ASIDE
            if owner > stack[-1]:
                owner = next((e for e in reversed(stack) if tags[e] in BLOCK), 0)

        def nearest(names, stop=frozenset()) -> int:
            """Depth of the innermost open element of ``names``, 0 if ``stop`` comes before it."""
            if any(open_tags[x] for x in names):
                for depth in range(len(stack) - 1, 0, -1):
                    if tags[stack[depth]] in names:
                        return depth
                    if tags[stack[depth]] in stop:
                        break
            return 0

        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.match(source, at)
            at = m.end()
            closing, name, rest, text = m.groups()
            if text is not None:
                if not muted:
                    text = html.unescape(text) if "&" in text else text
                    pieces.append(text)
                    linked += len(text.strip()) if open_tags["a"] else 0
                continue
            if name is None:
                continue
            tag = name.lower()
            if closing:
                if tag in ("p", "br"):
                    flush() if tag == "p" else pieces.append(" ")
                depth = nearest({tag}, frozenset() if tag in BLOCK else BLOCK)
                if depth and tag not in ("html", "body"):
                    close(depth)
                continue
            if tag == "br":
                pieces.append(" ")
                continue
            top = tags[stack[-1]]
            if top == "head" and tag not in IN_HEAD:
                close(len(stack) - 1)
            if tag in ("html", "body") and nearest({tag}):
                continue
            if tag in BLOCK:
                depth = nearest({"p"}, {"td", "th", "button", "object", "table"})
                if depth:
                    close(depth)
            if tag in CLOSES:
                depth = nearest(CLOSES[tag], BOUNDARY[tag])
                while depth:
                    close(depth)
                    depth = nearest(CLOSES[tag], BOUNDARY[tag])
            if tag in HEADINGS and tags[stack[-1]] in HEADINGS and tags[stack[-1]] != "hgroup":
                close(len(stack) - 1)
            if tag in BLOCK:
                flush()
            if tag in VOID:
                continue
            if tag in RAW:
                found = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
                at = found.end() if found else end
                continue
            given = {}
            if not rest.isspace() and rest:
                for k, *v in _ATTRIBUTE.findall(rest):
                    given.setdefault(k.lower(), html.unescape("".join(v)))
            over = self.path[stack[-1]]
            key = (over, _step(tag, given))
            if key not in self.steps:
                self.steps[key] = len(self.names)
                self.names.append(key)
            parent.append(stack[-1])
            tags.append(tag)
            self.path.append(self.steps[key])
            self.own.append(_reason(tag, given))
            stack.append(len(tags) - 1)
            open_tags[tag] += 1
            if tag in BLOCK:
                owner = stack[-1]
            else:
                muted += self.own[-1] == ASIDE
        flush()

    def _weigh(self) -> None:
        """``reason`` of every element, from its own marks and those above it, and ``good`` text by path."""
        n = len(self.tag)
        every, main, links, count = [0] * n, [False] * n, [0] * n, [0] * n
        for e, text, linked in self.blocks:
            every[e] += len(text)
            links[e] += linked
            count[e] += 1
        for e in range(n - 1, 0, -1):
            p = self.parent[e]
            every[p] += every[e]
            links[p] += links[e]
            count[p] += count[e]
            main[p] |= main[e] or (self.tag[e] in ("article", "main") and not self.own[e])
        self.reason = [0] * n
        for e in range(1, n):
            own = self.own[e]
            if own and main[e] and 2 * every[e] > every[0]:  # a layout around the article, named after another part of it
                own = 0
            if self.tag[e] in ("ul", "ol", "dl") and count[e] > 1 and 10 * links[e] > 9 * every[e]:  # a list of links
                own = ASIDE
            self.reason[e] = self.reason[self.parent[e]] | own
        self.good = [0] * len(self.names)
        for e, text, linked in self.blocks:
            if not self.reason[e] and 2 * linked < len(text):
                self.good[self.path[e]] += len(text)
        for p in range(len(self.names) - 1, 0, -1):
            self.good[self.names[p][0]] += self.good[p]

    def chosen(self) -> int:
        """The path that holds most of the page's text; 0, the root, where there is none."""
        below: dict[int, list[int]] = {}
        for p in range(1, len(self.names)):
            below.setdefault(self.names[p][0], []).append(p)
        now = 0
        while True:
            tag = self.names[now][1].split(".")[0]
            if tag == "article":
                return now
            then = max((p for p in below.get(now, ()) if self.names[p][1].split(".")[0] in HOLDERS), key=lambda p: (self.good[p], -p), default=None)
            if then is None or self.good[then] < HOLDS * self.good[now]:
                return now
            if tag not in ("", "html", "body") and self._titled(now, then):
                return now
            now = then

    def _titled(self, outer: int, inner: int) -> bool:
        """Whether a first-level heading of ``outer`` lies outside ``inner``, with little else."""
        if 5 * self.good[outer] > 6 * self.good[inner]:
            return False
        within, deeper = self._below(outer), self._below(inner)
        return any(self.tag[e] == "h1" and not self.reason[e] & ASIDE and within[self.path[e]] and not deeper[self.path[e]] for e, _, _ in self.blocks)

    def _below(self, top: int) -> list[bool]:
        """By path, whether it is ``top`` or begins with it."""
        below = [False] * len(self.names)
        below[top] = True
        for p in range(top + 1, len(self.names)):
            below[p] = below[self.names[p][0]]
        return below

    def told(self, path: int) -> str:
        """A path as text."""
        steps = []
        while path > 0:
            path, step = self.names[path]
            steps.append(step)
        return "/".join(reversed(steps))

    def known(self, path: str) -> int:
        """The page's number of a path, -1 if it has none."""
        now = 0
        for step in path.split("/") if path else ():
            now = self.steps.get((now, step), -1)
            if now < 0:
                return -1
        return now

    def text(self, path: int) -> str:
        """The article's blocks below the elements of a path."""
        titled = self.names[path][1].split(".")[0] not in ("", "html", "body")
        lines, below = [], self._below(path)
        for e, text, _ in self.blocks:
            reason = self.reason[e]
            if reason == HEADER and titled and self.tag[e] in HEADINGS:
                reason = 0
            if not reason and below[self.path[e]]:
                lines.append(text)
        return "\n".join(lines)


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    yield from groups(column(batch.column(1))[1])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes, chars = Counter(), Counter()
        for i, j in _batches(batch):
            for host, source in zip(batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_pylist()):
                page = Page(source)
                path = page.chosen()
                if page.good[path]:
                    votes[host, page.told(path)] += 1
                    chars[host, page.told(path)] += page.good[path]
        keys = list(votes)
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.string()), pa.array([votes[k] for k in keys], pa.int64()), pa.array([chars[k] for k in keys], pa.int64())], ["host", "path", "votes", "chars"])


def host_of(url: str) -> F.Column:
    """The host of a url, in lower case; empty where it has none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def votes(pages: DataFrame, text: str = "html", url: str = "url") -> DataFrame:
    """(host, path, votes, chars): pages that chose a path, by host, and their text below it."""
    rows = pages.select(host_of(url).alias("host"), F.col(text).cast("string").alias("html")).where("host <> ''")
    cast = rows.mapInArrow(_vote, "host string, path string, votes long, chars long")
    return cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("chars").alias("chars"))


def winners(cast: DataFrame) -> DataFrame:
    """(host, paths): the paths with ``WINS`` of a host's votes at least, ten at most by that, best first."""
    total = cast.groupBy("host").agg(F.sum("votes").alias("all"))
    best = cast.join(total, "host").where(F.col("votes") >= WINS * F.col("all"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("chars")).alias("c"), "path")))
    return best.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def _extract(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in _batches(batch):
                part, texts, paths = batch.slice(i, j - i), [], []
                for wins, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    page = Page(source)
                    # a winning path without text on this page does not count
                    path = next((p for p in map(page.known, wins or ()) if p >= 0 and page.good[p]), None)
                    path = page.chosen() if path is None else path
                    texts.append(page.text(path))
                    paths.append(page.told(path))
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(paths, pa.string()), *part.columns[2:]], names)

    return run


def extract(pages: DataFrame, text: str = "html", url: str = "url", out: str = "text", where: str = "path") -> DataFrame:
    """``pages`` with ``out``, the article's text, and ``where``, the path it was found at; columns of these names are replaced."""
    cast = cut(votes(pages, text, url), "votes")
    best = cut(winners(cast), "paths")
    size = best.agg(F.coalesce(F.sum(F.length("host") + F.length(F.array_join("paths", ","))), F.lit(0))).first()[0]
    drop(cast)
    put = pages.drop(out, where)
    paths, host, source, salt = (fresh(pages, c) for c in ("_paths", "_host", "_html", "_salt"))
    rows = pages.withColumns({host: host_of(url), source: F.col(text).cast("string")})
    best = best.select(F.col("host").alias(host), F.col("paths").alias(paths))
    if size <= MOST:
        rows = rows.join(F.broadcast(best), host, "left")
    else:
        parts = best.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn(salt, F.pmod(F.xxhash64(source), F.lit(SALTS)).cast("int")).join(parts, [host, salt], "left")
    own = [fresh(pages, "_text"), fresh(pages, "_path")]
    schema = ", ".join([*(f"{c} string" for c in own), *(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in put.schema.fields)])
    made = rows.select(paths, source, *put.columns).mapInArrow(_extract([*own, *put.columns]), schema)
    return made.withColumnsRenamed(dict(zip(own, (out, where)))).select(*put.columns, out, where)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")
