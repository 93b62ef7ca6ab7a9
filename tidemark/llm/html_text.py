"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its opening and closing tags, each with the path of open elements (names and classes),
and its text nodes, each with path and text. Over the pages of a host, tokens with the same occurrence vector
(how often on which page) form an equivalence class. Vectors are compared by order-free hashes that add up
page by page, so no host's pages are gathered. Classes of several tokens that are on most pages of the host
are valid; the mean place of a token is its place in its class.

On a page the valid classes nest into the template: their tokens must come in the classes' order, again and
again, and an instance of one class must lie within one slot (the gap between two neighbouring tokens) of
another's. A class that breaks this on a page is left out there. What stands in the slots is the page's data.

The host's template also has a tree of the elements that each of its pages has once. From the root it is
followed to the element that holds over half of the data of the one above, as far as there is one; the
template's own texts do not count. That element holds the main text: the data of the slots in it are
extracted. Names of elements and classes only settle what slots cannot: menus, headers, footers, sidebars,
notices, adverts, forms and comments do not count as data, ``article`` and ``main`` are not split further, and
a text in those that most pages share is a copied article, not the template's. Hosts with too few pages for a
template, and pages that lack its main element, fall back to these names.

Defined cases: null html counts as empty and gives an empty text; a null or odd URL belongs to a host of
its own name; repeated rows each give their row; unclosed tags end with an enclosing element or the page; a
tag of over 400 quoted or plain pieces is text. Columns besides id, url and html are not read.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels, shared

#: Bytes of templates in one file; a page's task reads the file of its host.
FILE_BYTES = 4 << 20
#: Pages with a token, and tokens in a class, for the class to be valid.
LEAST_PAGES = 3
LEAST_TOKENS = 3
_HELD_TOKENS = 200_000
_SIGNED = 1 << 63
_MASK = (1 << 64) - 1
_TAG, _TEXT = 0, 1

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|object|canvas|math)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    # of a tag at most 400 pieces are read, so that quotes that never close cost a bounded time at each place
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'){0,400}+)>|<[!?/][^>]*>",
    re.S | re.I,
)
#: One attribute: its name, and its value in double, single or no quotes.
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
#: Elements without content.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not break a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn del em font i img ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements beside the main text.
_BESIDE = frozenset("head title nav footer aside form button dialog menu label fieldset datalist".split())
_MAIN = frozenset(("article", "main"))
#: Words in class, id or role that mark an element as beside the main text.
_BESIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice popup promo promotion related reply replies share sharing sidebar site-header social sponsor sponsored subscribe subscription toolbar widget contentinfo complementary search".split()
)
#: Elements that are not judged by single words of their ids within the main element.
_HEADED = frozenset("h1 h2 h3 h4 h5 h6 section".split())
_SPLIT_NAME = re.compile(r"[\s_-]+")


class _Node:
    """An open element; the path is a hash of the names and classes down to it."""

    __slots__ = ("name", "path", "up", "beside", "main", "volume", "inside")

    def __init__(self, name: str, path: int, up: _Node | None, beside: bool, main: bool):
        self.name, self.path, self.up, self.beside, self.main = name, path, up, beside, main
        self.volume, self.inside = 0, False


def _is_beside(name: str, attributes: str, inside_main: bool) -> bool:
    if name in _BESIDE or (name == "header" and not inside_main):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    seen = set()
    for match in _ATTRIBUTE.finditer(attributes):
        key, value = match[1].lower(), (match[2] or match[3] or match[4] or "").lower()
        if key in seen:  # of an attribute given twice the first counts
            continue
        seen.add(key)
        if key == "hidden" and value != "false" or key == "aria-hidden" and value == "true" or key == "style" and _NO_DISPLAY.search(value):
            return True
        if key not in ("class", "id", "role") or not value:
            continue
        made = inside_main and key == "id" and name in _HEADED  # an id made of the words of a heading
        if made and name != "section":
            continue
        if any(w in _BESIDE_WORDS for w in value.split()):
            return True
        if not made and not _BESIDE_WORDS.isdisjoint(_SPLIT_NAME.split(value)):
            return True
    return False


_CLASS = re.compile(r"(?:^|\s)class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_DIGITS = re.compile(r"[0-9]+")


@lru_cache(100_000)
def _step(path: int, name: str) -> int:
    return xxhash.xxh64_intdigest(name, path)


def _named(name: str, attributes: str) -> str:
    """The element's name with its classes, without digits."""
    found = _CLASS.search(attributes) if attributes else None
    return f"{name}.{_DIGITS.sub('', (found[1] or found[2] or found[3] or '').lower())}" if found else name


def parse(html: str) -> tuple[list[tuple[int, str | None, _Node, bool]], list[_Node]]:
    """(token, text, element, breaks) of tags (text None) and text nodes in page order, and all elements in order.

    White space alone is text without a token (0)."""
    root = _Node("", 1, None, False, False)
    stack, nodes, out, opened = [root], [root], [], Counter()
    at = 0

    def text(piece: str) -> None:
        top, bare = stack[-1], piece.strip()
        out.append((xxhash.xxh64_intdigest(bare, top.path) if bare else 0, piece, top, False))
        if not top.beside:
            top.volume += len(bare)

    for match in _MARKUP.finditer(html):
        if match.start() > at:
            text(html[at : match.start()])
        at = match.end()
        name = (match[3] or "").lower()
        if not name:
            continue
        breaks = name not in _INLINE
        if match[2]:
            if name in _VOID:
                continue
            if opened[name]:
                while True:
                    ended = stack.pop().name
                    opened[ended] -= 1
                    if ended == name:
                        break
            out.append((_step(stack[-1].path, "-" + name), None, stack[-1], breaks))
            continue
        if name in ("p", "li") and stack[-1].name == name:  # their end tags may be left out
            stack.pop()
            opened[name] -= 1
        top = stack[-1]
        path = _step(top.path, _named(name, match[4]))
        out.append((path, " " if name == "br" else None, top, breaks))
        if name in _VOID or match[4].endswith("/"):
            continue
        main = name in _MAIN
        if main and top.beside and not top.main:  # an unclosed menu ends where the article begins
            top = root
        node = _Node(name, path, stack[-1], top.beside or _is_beside(name, match[4], top.main or main), top.main or main)
        stack.append(node)
        nodes.append(node)
        opened[name] += 1
    if at < len(html):
        text(html[at:])
    for node in reversed(nodes):
        if node.up is not None:
            node.up.volume += node.volume
    return out, nodes


def _blocks(events: list, keep) -> str:
    """The kept texts, blocks joined by newlines."""
    parts: list[list[str]] = [[]]
    for event in events:
        if event[3]:
            parts.append([])
        if event[1] is not None and keep(event):
            parts[-1].append(event[1])
    lines = (" ".join(unescape("".join(p)).split()) for p in parts if p)
    return "\n".join(line for line in lines if line)


def by_names(events: list, nodes: list[_Node]) -> str:
    """Main text by names of elements and classes alone: what is in an article or main, or else anywhere but beside."""
    any_main = any(e[2].main and not e[2].beside and e[1] is not None and e[1].strip() for e in events)
    return _blocks(events, lambda e: not e[2].beside and (e[2].main or not any_main))


class Template:
    """A host's template, from rows (token, kind, class, place, once, up, main, volume, support)."""

    def __init__(self, rows: list[tuple[int, int, int, float, int, int, int, int, int]]):
        order: dict[int, list[int]] = {}
        for token, _, own, *_ in sorted(rows, key=lambda r: (r[3], r[0])):
            order.setdefault(own, []).append(token)
        self.rank = {t: (own, k) for own, tokens in order.items() for k, t in enumerate(tokens)}
        self.last = {own: len(tokens) - 1 for own, tokens in order.items()}
        self.texts = {r[0] for r in rows if r[1] == _TEXT}
        self.main_element = self._main_element(rows)

    @staticmethod
    def _main_element(rows: list) -> int | None:
        """Path of the element that holds the main text; None if the template has no text's element."""
        single = {r[0]: r for r in rows if r[1] == _TAG and r[4]}
        volume = {t: r[7] for t, r in single.items()}
        for _, kind, _, _, _, up, _, size, _ in rows:  # the template's own texts are no data
            while kind == _TEXT and up in single:
                volume[up] -= size
                up = single[up][5]
        below: dict[int, list[int]] = {}
        for t, r in single.items():
            below.setdefault(r[5], []).append(t)
        at, size = None, None
        while True:
            best = max(below.get(at if at is not None else 1, ()), key=lambda t: (volume[t], t), default=None)
            if best is None or volume[best] <= (0 if size is None else size / 2):
                return at
            at, size = best, volume[best]
            if single[at][6]:
                return at

    def left_out(self, events: list) -> set[int]:
        """The classes whose tokens do not nest on a page."""
        known = [self.rank[e[0]] for e in events if e[0] in self.rank]
        out: set[int] = set()
        while True:
            broken, stack = None, []
            for own, k in known:
                if own in out:
                    continue
                if k == 0:
                    stack.append([own, 0])
                elif stack and stack[-1] == [own, k - 1]:
                    stack[-1][1] = k
                    if k == self.last[own]:
                        stack.pop()
                else:
                    broken = min({own, *(s[0] for s in stack[-1:])}, key=lambda c: (self.last[c], c != own, c))
                    break
            if broken is None and stack:
                broken = min((s[0] for s in stack), key=lambda c: (self.last[c], c))
            if broken is None:
                return out
            out.add(broken)


def main_text(html: str, template: Template | None = None) -> str:
    """Main text of a page: blocks joined by newlines."""
    events, nodes = parse(html)
    if template is None or template.main_element is None:
        return by_names(events, nodes)
    for node in nodes:
        node.inside = node.path == template.main_element or (node.up is not None and node.up.inside)
    if not any(n.inside for n in nodes):
        return by_names(events, nodes)
    out = template.left_out(events)

    def is_data(event: tuple) -> bool:
        token, _, node, _ = event
        if node.beside or not node.inside:
            return False
        return node.main or token not in template.texts or template.rank[token][0] in out

    return _blocks(events, is_data)


def host_of(url: Column) -> Column:
    """The host that a URL names, in lower case, without user and port; '' if there is none."""
    place = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(place)


_TOKENS = "host string, token long, kind long, up long, main long, once long, support long, vector1 long, vector2 long, place long, volume long"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= _SIGNED else x


def _occurrences(pages: DataFrame) -> DataFrame:
    """Parts of the numbers of each token of each host, to be added up; token 1 stands for the page itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}

        def flush() -> pa.RecordBatch:
            names = [c.split()[0] for c in _TOKENS.split(", ")]
            keys, numbers = list(held), list(held.values())
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([_signed(k[1]) for k in keys], pa.int64())]
            columns += [pa.array([_signed(n[c]) for n in numbers], pa.int64()) for c in range(9)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for host, page, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                events, nodes = parse(html or "")
                seen: dict[int, list] = {1: [1, _TAG, 0, 0, 0, 0]}  # count, kind, up, main, place, volume
                for k, (token, text, node, _) in enumerate(events):
                    if token in seen:
                        seen[token][0] += 1
                        seen[token][5] += len(text.strip()) if text else 0
                    elif token:
                        is_text = text is not None and text.strip() != ""
                        seen[token] = [1, _TEXT if is_text else _TAG, node.path, 0, k, len(text.strip()) if is_text else 0]
                for node in nodes[1:]:
                    own = seen[node.path]
                    own[3], own[5] = int(node.name in _MAIN), own[5] + node.volume
                for token, (n, kind, up, main, place, volume) in seen.items():
                    own = xxhash.xxh64_intdigest(f"{page} {n}")
                    numbers = held.get((host, token))
                    if numbers is None:
                        held[host, token] = [kind, up, main, int(n == 1), 1, own, own & 0x7FFFFFFF, place, volume]
                    else:
                        numbers[3] &= int(n == 1)
                        numbers[4] += 1
                        numbers[5] ^= own
                        numbers[6] += own & 0x7FFFFFFF
                        numbers[7] += place
                        numbers[8] += volume
                if len(held) > _HELD_TOKENS:
                    yield flush()
        if held:
            yield flush()

    return pages.mapInArrow(kernels.freed(run), _TOKENS)


def template_tokens(pages: DataFrame, *, least_pages: int = LEAST_PAGES, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """host, token, kind, class, place, once, up, main, volume, support of the tokens of valid classes.

    ``pages``: host, id, html. A token's support is the number of pages with it."""
    added = [F.sum(c).alias(c) for c in ("support", "vector2", "place", "volume")]
    tokens = _occurrences(pages).groupBy("host", "token").agg(F.max("kind").alias("kind"), F.max("up").alias("up"), F.max("main").alias("main"), F.min("once").alias("once"), F.bit_xor("vector1").alias("vector1"), *added)
    tokens = shared.written(tokens, "tokens")  # read three times; pages are parsed once for it
    vector = ["host", "support", "vector1", "vector2"]
    # what is on one or two pages can be in no valid class, and is nearly all there is
    classes = tokens.where((F.col("support") >= least_pages) & (F.col("token") != 1)).groupBy(*vector).agg(F.count(F.lit(1)).alias("size"))
    hosts = tokens.where("token = 1").select("host", F.col("support").alias("pages"))
    valid = classes.where(F.col("size") >= least_tokens).join(hosts, "host").where(2 * F.col("support") > F.col("pages")).select(*vector)
    rows = tokens.where((F.col("support") >= least_pages) & (F.col("token") != 1)).join(valid, vector)
    own = F.xxhash64("support", "vector1", "vector2").alias("class")
    return rows.select("host", "token", "kind", own, (F.col("place") / F.col("support")).alias("place"), "once", "up", "main", "volume", "support")


def write_templates(tokens: DataFrame) -> tuple[str, int]:
    """Files of the hosts' templates in the shared folder, and their number; a host's file is chosen by its hash."""
    spark = tokens.sparkSession
    kept = shared.written(tokens, "templates")
    number = max(1, -(-80 * kept.count() // FILE_BYTES))
    folder = shared.fresh_path(spark, "hosts")
    # a class is on most pages of its host, so a host has few: twice the tokens of a page on average
    fields = F.array("token", "kind", "class", F.round(F.col("place") * 1000).cast("long"), "once", "up", "main", "volume", "support")
    by_host = kept.groupBy("host").agg(F.collect_list(fields).alias("rows")).withColumn("file", F.pmod(F.xxhash64("host"), F.lit(number)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[str, list]] = {}
        for batch in batches:
            for host, rows, file in zip(*(batch.column(k).to_pylist() for k in range(3))):
                held.setdefault(file, {})[host] = rows
        for file, hosts in held.items():
            shared.put_file(f"{folder}/{file}.json", json.dumps(hosts, sort_keys=True).encode())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64())], names=["file"])

    by_host.repartition("file").mapInArrow(kernels.freed(run), "file long").count()
    shared.drop(kept)
    return folder, number


def _reader(folder: str):
    """A function from a host and its file to the host's template, or None; it keeps the last files and templates."""

    @lru_cache(4)
    def hosts(file: int) -> dict[str, list]:
        data = shared.get_file(f"{folder}/{file}.json")
        return json.loads(data) if data else {}

    @lru_cache(256)
    def template(host: str, file: int) -> Template | None:
        rows = hosts(file).get(host)
        return Template([(r[0] & _MASK, r[1], r[2], r[3] / 1000, r[4], r[5] & _MASK, *r[6:]) for r in rows]) if rows else None

    return template


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **how) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of(F.col("url")))
    folder, number = write_templates(template_tokens(rows.select("host", "page_id", "html"), **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = _reader(folder)
        for batch in batches:
            texts = [main_text(html or "", template(host, file)) for html, host, file in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return rows.withColumn("file", F.pmod(F.xxhash64("host"), F.lit(number))).mapInArrow(kernels.freed(run), f"page_id {kind}, url string, text string, n_chars long")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of the main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
