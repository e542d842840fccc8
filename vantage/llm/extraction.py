"""Main-text extraction with a site style tree.

The DOMs of all pages of a host are merged into one style tree whose nodes are
paths of tags and classes.  A node's content importance falls as the same texts
recur on the host's pages (one minus the mean of ``ln pages-with-the-text / ln
pages``); its presentation importance is the entropy of the child sequences seen at
it.  A branch all of whose texts sit at nodes of low composite importance is removed
from every page, provided the page keeps something more important.  Branches that
the markup itself declares as menus, headers, footers, sidebars, notices, adverts,
forms, comments, scripts or styles are removed at any importance.  A single text is
unimportant, too, if it recurs at its node on half of the node's pages or more and
its own composite importance is low: the subscribe line among the paragraphs of an
article.  If a page has an article or main element, its text is taken from there;
unimportant paragraphs, lists and tables are pruned in it like containers, lists and
tables as a whole (no single items, rows or cells), headings only with a container.

Statistics are sums per (host, node, feature), pre-aggregated in every task, so a
hot host is spread over all tasks.  What is sent back to the pages is the list of
unimportant nodes and texts per host: those of the site's templates.

Defined results: null or empty html gives empty text; a null or relative url has the
empty host; repeated pages are extracted row by row and count as pages of their
host; an empty table gives no rows; columns other than page_id, url and html are not
read.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.llm.common import stash

MIN_PAGES = 8
LOW_IMPORTANCE = 0.25
CONTENT_SHARE = 0.9
TEXT_SHARE = 0.5  # of a node's pages, from which on a text can be the template's

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
# Inside an article: what goes as a whole only, and what never goes alone.
WHOLE = frozenset("ul ol dl table figure".split())
PARTS = frozenset("h1 h2 h3 h4 h5 h6 li dt dd caption tbody thead tfoot tr td th figcaption".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li option tbody td tfoot th thead tr".split())
SAME_CLOSES = {
    "li": ("li", ("ul", "ol", "menu", "dir")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select", "datalist")),
}
BOILERPLATE_TAGS = RAW | frozenset(
    "head nav footer aside form template svg canvas object embed button select input label fieldset dialog menu "
    "datalist audio video map".split()
)
BOILERPLATE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion cookie "
    "cookies consent gdpr notice notices sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer share "
    "sharing social related recommended newsletter subscribe subscription signup popup modal overlay widget toolbar "
    "login search pagination pager copyright".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist reply replies disqus respond".split())
HEADER_NAMES = frozenset("header masthead".split())  # of the site, not of an article
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME = re.compile(r"[a-z]+")


class Page:
    """Elements in page order (parents first) and the text pieces between them."""

    def __init__(self, html: str) -> None:
        self.tag = ["#root"]
        self.parent = [-1]
        self.css = [""]
        self.own = [0]  # 0 stays, 1 goes by its name, 2 by tag, role or comments, 3 as a site's header
        self.dropped: list[bool] = []
        self.pieces: list[tuple[int, str | None]] = []  # (element, text), None: a block begins or ends
        self._parse(html)
        self._settle()

    def _settle(self) -> None:
        """Whether each element goes with its branch.  A wrapper whose name only sounds
        like boilerplate stays if an article or main element is inside it."""
        own, parent = self.own, self.parent
        for e, tag in enumerate(self.tag):
            if tag in ("article", "main") and not own[e]:
                up = parent[e]
                while up >= 0:
                    own[up] = 0 if own[up] == 1 else own[up]
                    up = parent[up]
        self.dropped = [False] * len(own)
        inside = [False] * len(own)
        for e in range(1, len(own)):
            tag = self.tag[e]
            inside[e] = inside[parent[e]] or tag in ("article", "main")
            self.dropped[e] = self.dropped[parent[e]] or own[e] in (1, 2) or own[e] == 3 and not inside[e]

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        css, own = "", 2 if tag in BOILERPLATE_TAGS else 3 if tag == "header" else 0
        if not own and attributes and ("=" in attributes or "hidden" in attributes):
            found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
            css = " ".join(sorted(found.get("class", "").lower().split()))
            names = NAME.findall(f"{css} {found.get('id', '').lower()}")
            if (
                "hidden" in found
                or found.get("aria-hidden", "").lower() == "true"
                or "display:none" in found.get("style", "").replace(" ", "")
                or found.get("role", "").lower() in BOILERPLATE_ROLES
                or tag not in ("html", "body", "main")
                and not COMMENT_NAMES.isdisjoint(names)
            ):
                own = 2
            elif tag not in ("html", "body", "article", "main"):
                own = 1 if not BOILERPLATE_NAMES.isdisjoint(names) else 3 if not HEADER_NAMES.isdisjoint(names) else 0
        self.tag.append(tag)
        self.parent.append(parent)
        self.css.append(css)
        self.own.append(own)
        return len(self.tag) - 1

    def _parse(self, html: str) -> None:
        stack = [0]
        tags = self.tag
        pieces = self.pieces
        at, n = 0, len(html)

        def pop_to(depth: int) -> None:
            for e in stack[depth:]:
                if tags[e] in BLOCK:
                    pieces.append((e, None))
                    break
            del stack[depth:]

        while at < n:
            m = TAG.search(html, at)
            if m is None:
                text = html[at:]
                cut = re.search(r"<[a-zA-Z/!?]", text)  # a tag cut off by the end of the page
                text = text[: cut.start()] if cut else text
                if text:
                    pieces.append((stack[-1], text))
                break
            if m.start() > at:
                pieces.append((stack[-1], html[at : m.start()]))
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                for depth in range(len(stack) - 1, 0, -1):
                    if tags[stack[depth]] == tag:
                        pop_to(depth)
                        break
                    if tag == "p" and tags[stack[depth]] in BLOCK or tags[stack[depth]] in ("article", "main") and tag not in ("body", "html"):
                        break
                continue
            if tag in CLOSES_P:
                for depth in range(len(stack) - 1, 0, -1):
                    if tags[stack[depth]] == "p":
                        pop_to(depth)
                        break
                    if tags[stack[depth]] in BLOCK:
                        break
            elif tag in SAME_CLOSES:
                own, limits = SAME_CLOSES[tag]
                for depth in range(len(stack) - 1, 0, -1):
                    if tags[stack[depth]] in limits:
                        break
                    if tags[stack[depth]] in own.split():
                        pop_to(depth)
                        break
            if tag == "br":
                pieces.append((stack[-1], " "))
                continue
            element = self._open(tag, m[3] or m[6] or "", stack[-1])
            if tag in BLOCK:
                pieces.append((element, None))
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\b", re.I).search(html, at)
                at = close.start() if close else n
                if close:
                    stack.append(element)
                continue
            if tag not in VOID and not (m[3] or "").endswith("/"):
                stack.append(element)

    def paths(self) -> list[int]:
        """The style-tree node of each element: a hash of its path of tags and classes."""
        import xxhash

        out = [0]
        for e in range(1, len(self.tag)):
            key = f"{out[self.parent[e]]}>{self.tag[e]}.{self.css[e]}"
            out.append(xxhash.xxh64_intdigest(key) >> 1)
        return out

    def own_texts(self) -> dict[int, int]:
        """Element -> hash of its own text."""
        import xxhash

        texts: dict[int, list[str]] = {}
        for e, text in self.pieces:
            if text and not text.isspace():
                texts.setdefault(e, []).append(text)
        return {e: xxhash.xxh64_intdigest(" ".join(" ".join(x).split())) >> 1 for e, x in texts.items()}

    def features(self) -> tuple[dict[int, set[int]], dict[int, set[int]]]:
        """(path -> hashes of own texts, path -> hashes of child sequences with runs of
        one tag collapsed)."""
        import xxhash

        paths = self.paths()
        children: dict[int, list[str]] = {}
        for e in range(1, len(self.tag)):
            own = children.setdefault(self.parent[e], [])
            if not own or own[-1] != self.tag[e]:
                own.append(self.tag[e])
        content: dict[int, set[int]] = {}
        shape: dict[int, set[int]] = {}
        for e, x in self.own_texts().items():
            if not self.dropped[e]:
                content.setdefault(paths[e], set()).add(x)
        for e, x in children.items():
            if not self.dropped[e]:
                shape.setdefault(paths[e], set()).add(xxhash.xxh64_intdigest(" ".join(x)) >> 1)
        return content, shape

    def main_text(self, low: frozenset[int], low_texts: frozenset[str] = frozenset()) -> tuple[str, int]:
        """(blocks of the main text, removed branches); ``low``: unimportant nodes,
        ``low_texts``: unimportant texts as path:hash."""
        n = len(self.tag)
        dropped, parent, tag = self.dropped, self.parent, self.tag
        inside = [False] * n
        for e in range(1, n):
            inside[e] = inside[parent[e]] or tag[e] in ("article", "main") and not dropped[e]
        whole = not any(inside)
        taken = [(whole or inside[e]) and not dropped[e] for e in range(n)]
        texts = [(e, t) for e, t in self.pieces if t is not None and taken[e] and not t.isspace()]
        removed = 0
        if (low or low_texts) and texts:
            paths, own = self.paths(), self.own_texts() if low_texts else {}
            filled, important = [False] * n, [False] * n  # branches with a text, with an important text
            for e, _ in texts:
                mark = (filled,) if paths[e] in low or low_texts and f"{paths[e]}:{own[e]}" in low_texts else (filled, important)
                for flags in mark:
                    x = e
                    while x >= 0 and not flags[x]:
                        flags[x] = True
                        x = parent[x]
            if important[0]:
                cut, held = [False] * n, [False] * n
                for e in range(1, n):
                    cut[e] = cut[parent[e]]
                    held[e] = not whole and (held[parent[e]] or tag[parent[e]] in WHOLE)
                    if not cut[e] and taken[e] and filled[e] and not important[e] and tag[e] in BLOCK:
                        cut[e] = whole or not held[e] and tag[e] not in PARTS
                        removed += cut[e]
                taken = [t and not c for t, c in zip(taken, cut, strict=True)]
        blocks, buffer = [], []

        def flush() -> None:
            line = " ".join(unescape("".join(buffer)).split())
            if line:
                blocks.append(line)
            buffer.clear()

        for e, t in self.pieces:
            if t is None:
                flush()
            elif taken[e]:
                buffer.append(t)
        flush()
        return "\n".join(blocks), removed


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _features(pages: DataFrame) -> DataFrame:
    """host, path, kind, feature and the number n of the host's pages with it."""
    schema = "host string, path long, kind string, feature long, n long"

    def run(batches):
        for batch in batches:
            counts: dict[tuple, int] = {}
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                content, shape = Page(html or "").features()
                for p in content.keys() | shape.keys():
                    counts[host, p, "page", 0] = counts.get((host, p, "page", 0), 0) + 1
                for kind, found in (("text", content), ("shape", shape)):
                    for p, xs in found.items():
                        for x in xs:
                            counts[host, p, kind, x] = counts.get((host, p, kind, x), 0) + 1
            columns = list(zip(*counts, strict=True)) if counts else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.string()),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.string()),
                    pa.array(columns[3], pa.int64()),
                    pa.array(counts.values(), pa.int64()),
                ],
                names=["host", "path", "kind", "feature", "n"],
            )

    return pages.mapInArrow(run, schema).groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, pages, content, presentation and composite importance of each node."""
    return _nodes(_features(pages))


def _nodes(seen: DataFrame) -> DataFrame:
    is_text, is_shape = F.col("kind") == "text", F.col("kind") == "shape"
    log = F.log(F.col("n").cast("double"))
    node = seen.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == "page", F.col("n"))).alias("pages"),
        F.sum(F.when(is_text, log)).alias("_tlog"),
        F.sum(F.when(is_text, F.lit(1))).alias("_texts"),
        F.sum(F.when(is_shape, F.col("n") * log)).alias("_slog"),
        F.sum(F.when(is_shape, F.col("n"))).alias("_shapes"),
    )
    m = F.log(F.col("pages").cast("double"))
    content = F.when(F.col("pages") < 2, 1.0).otherwise(1 - F.col("_tlog") / F.col("_texts") / m)
    shape = F.when(F.col("pages") < 2, 1.0).otherwise((F.log(F.col("_shapes").cast("double")) - F.col("_slog") / F.col("_shapes")) / m)
    return node.select(
        "host",
        "path",
        "pages",
        content.alias("content"),
        F.coalesce(shape, F.lit(0.0)).alias("presentation"),
        F.coalesce(CONTENT_SHARE * content + (1 - CONTENT_SHARE) * F.coalesce(shape, content), shape).alias("composite"),
    )


def _low_texts(seen: DataFrame, tree: DataFrame, min_pages: int, low: float) -> DataFrame:
    """host and text (path:hash) of the unimportant texts."""
    common = seen.where((F.col("kind") == "text") & (F.col("n") >= TEXT_SHARE * min_pages)).select("host", "path", "feature", "n")
    nodes = tree.where(F.col("content").isNotNull() & (F.col("pages") >= min_pages)).select("host", "path", "pages", "presentation")
    own = 1 - F.log(F.col("n").cast("double")) / F.log(F.col("pages").cast("double"))
    composite = CONTENT_SHARE * own + (1 - CONTENT_SHARE) * F.col("presentation")
    found = common.join(nodes, ["host", "path"]).where((F.col("n") >= TEXT_SHARE * F.col("pages")) & (composite < low))
    return found.select("host", F.concat_ws(":", "path", "feature").alias("text"))


def extract_main_text(pages: DataFrame, min_pages: int = MIN_PAGES, low: float = LOW_IMPORTANCE) -> DataFrame:
    """page_id, url, text, n_chars and n_branches (removed as unimportant) per page."""
    pages = pages.select("page_id", "url", "html").withColumn("host", _host(F.col("url")))
    seen = stash(_features(pages.select("host", "html")))
    tree = stash(_nodes(seen))
    unimportant = tree.where(F.col("content").isNotNull() & (F.col("pages") >= min_pages) & (F.col("composite") < low))
    both = unimportant.select("host", "path", F.lit(None).cast("string").alias("text")).unionByName(
        _low_texts(seen, tree, min_pages, low).select("host", F.lit(None).cast("long").alias("path"), "text")
    )
    sets = [F.sort_array(F.collect_set(c)).alias(k) for c, k in (("path", "low"), ("text", "low_texts"))]
    per_host = stash(both.groupBy("host").agg(*sets))
    joined = pages.join(per_host, "host", "left").select("page_id", "url", "html", "low", "low_texts")
    kept = [joined.schema[c] for c in ("page_id", "url")]

    def run(batches):
        for batch in batches:
            texts, removed = [], []
            for html, paths, lines in zip(*(batch.column(c) for c in ("html", "low", "low_texts")), strict=True):
                html, paths, lines = html.as_py(), paths.as_py(), lines.as_py()
                text, k = "", 0
                if html:
                    text, k = Page(html).main_text(frozenset(paths or ()), frozenset(lines or ()))
                texts.append(text)
                removed.append(k)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(f.name) for f in kept),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(removed, pa.int64()),
                ],
                names=[*(f.name for f in kept), "text", "n_chars", "n_branches"],
            )

    schema = T.StructType([*kept, *T.StructType.fromDDL("text string, n_chars long, n_branches long").fields])
    return joined.mapInArrow(run, schema)
