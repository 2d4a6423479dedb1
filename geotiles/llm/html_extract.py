"""HTML extraction with site template removal.

1. Every page is read into a light element tree, in time linear in its length.
   Elements that hold text are hashed with their whole subtree (tags, text, order).
2. Spark counts, per host, the distinct pages that hold each hash; pages with the same
   main element count as one, so mirrored copies of an article are no template.  A subtree found
   on ``min_pages`` distinct pages is template, however many pages the host has.  On
   hosts of fewer than 2 * ``min_pages`` pages more than half of them suffice, but
   three at least.
3. Each page meets its list of template hashes, is read again, loses those
   subtrees and everything that is never main text (menus, headers, footers, side
   bars, notices, adverts, forms, scripts, styles, reader comments), and what the
   main element holds becomes text: references decoded, white space inside a block
   one space, blocks joined by an empty line.

A class or id marks an element as never text only if the element is a container
(``CONTAINERS``) and a whole class name or the whole id is in ``MARKS``, or is put together of such
a topic and of words for a place (``comment-section``, ``ad-top``); so does the attribute ``hidden``.  Headings,
paragraphs and inline elements are never dropped for their names.

The main element is the article, else main, else the body.  Articles outside a main that holds text are
no main element, nor are those inside it that hold less than half of its text; articles in a marked container are
none either (reader comments and teasers are often articles), but for one case: a mark of mere layout (``LAYOUT``) that
holds more text than all the rest of the page is lifted.  Paragraphs, headings and
the like inside an article are its text and are kept even where they repeat;
subtrees that may go there are containers.  Without an article any repeated block may go.

Defined results: null or empty html gives an empty text; broken markup is read as
browsers do in the common cases (implied end tags, unclosed elements, stray end tags,
cut-off pages); from the first attribute whose quote never closes on, tags end at the first ``>``; a
very long page costs time and memory in proportion to its length; a null or odd url is a host of its
own; repeated rows give equal rows, and ties cannot occur (no order decides); an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_key, written

# Names of HTML elements and of the parts of a page that are not its text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section "
                  "summary table tbody tfoot thead tr ul".split())
NEVER = frozenset("nav footer aside form script style noscript template svg button iframe textarea "
                  "head title menu dialog canvas audio video".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote figure figcaption tr tbody thead table".split())
CONTAINERS = frozenset("div section article header ul ol dl table center fieldset details".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising ad-banner ad-box ad-container ad-slot banner promo "
                  "sponsor sponsored sidebar side-bar sidebars menu main-menu nav navbar navigation site-nav breadcrumb "
                  "breadcrumbs cookie cookies cookie-banner cookie-consent cookie-notice consent notice notices popup "
                  "modal newsletter comment comments comment-list comments-list comments-area user-comments "
                  "reader-comments disqus disqus_thread share share-box share-buttons sharing social social-share "
                  "related footer site-footer page-footer site-header page-header masthead".split())
#: Names that are put together of these topics and places mark a container as well.
TOPICS = frozenset("ad ads advert adverts adsense adsbygoogle advertisement sponsor sponsored promo cookie cookies gdpr consent "
                   "comment comments disqus share sharing social related newsletter popup modal sidebar breadcrumb breadcrumbs".split())
PLACES = frozenset("bar banner box top bottom left right slot unit wrap wrapper container section area list notice block panel form "
                   "thread overlay inline leaderboard header footer post posts article articles entry page user reader site links "
                   "buttons icons items widget message policy".split())
#: Marks that some pages put on what holds their article too.
LAYOUT = frozenset("banner sidebar side-bar sidebars menu main-menu nav navbar navigation site-nav masthead site-header page-header "
                   "footer site-footer page-footer notice notices complementary contentinfo".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu".split())
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody")}
#: Where the search for an element to close ends: for an implied end of p, of list items and cells, and for stray end tags.
P_SCOPE = frozenset("table td th article section div main body html ul ol dl button template".split())
LISTS = frozenset("table ul ol dl select".split())
CELLS = frozenset("table td th template".split())
TABLE = frozenset("table tbody thead tfoot tr td th caption".split())

# possessive throughout: a tag is matched or refused in one forward scan
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["']))|["'])*+)>""")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_KINDS = (P_SCOPE, LISTS, CELLS, BLOCK)
_KINDS_OF = {tag: tuple(kind for kind in _KINDS if tag in kind) for tag in frozenset().union(*_KINDS)}
#: Tasks that share the rows of one template.
SALTS = 16
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in RAW}


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    never: bool
    kids: list  # child node numbers, or texts
    marked: int = 0  # never by an attribute, not by its tag: 1 a mark of layout, 2 another one


def _names_mark(name: str) -> bool:
    if name in MARKS:
        return True
    parts = [x for x in re.split("[-_]+", name) if x and not x.isdigit()]
    return not TOPICS.isdisjoint(parts) and all(x in TOPICS or x in PLACES for x in parts)


def _marked(attrs: str) -> int:
    """0: no mark, 1: marks of layout only, 2: others."""
    found: set[str] = set()
    for name, *values in _ATTR.findall(attrs):
        name = name.lower()
        value = next((v for v in values if v), "").lower()
        if name == "hidden" and value != "until-found" or name == "style" and re.search(r"display\s*+:\s*+none", value):
            return 2
        if name in ("class", "id", "role"):
            said = value.split()
            if name == "role":
                found |= ROLES.intersection(said)
            elif name == "class" or len(said) == 1:
                found |= {x for x in said if _names_mark(x)}
    return 2 if found - LAYOUT else 1 if found else 0


class _Open:
    """The open elements, with the stack positions of each name and of each kind of barrier."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.stack, self.at = nodes, [0], {}
        self.barriers = {kind: [0] for kind in _KINDS}

    def push(self, number: int) -> None:
        tag, place = self.nodes[number].tag, len(self.stack)
        self.stack.append(number)
        self.at.setdefault(tag, []).append(place)
        for kind in _KINDS_OF.get(tag, ()):
            self.barriers[kind].append(place)

    def close(self, names: tuple[str, ...], kind: frozenset[str] | None = None) -> None:
        """Ends the innermost element of these names, with all inside it, if no barrier of the kind is further in."""
        place = max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)
        # an element of the kind is no barrier to itself
        if place < 0 or kind is not None and place < self.barriers[kind][-1]:
            return
        while len(self.stack) > place:
            tag = self.nodes[self.stack.pop()].tag
            self.at[tag].pop()
            for mine in _KINDS_OF.get(tag, ()):
                self.barriers[mine].pop()


def read_tree(page: str) -> list[Node]:
    """Nodes in page order; node 0 is the root."""
    nodes = [Node("", -1, False, [])]
    held = _Open(nodes)
    at, end, last, quotes = 0, len(page), page.rfind(">"), True

    def add(tag: str, never: bool = False, marked: int = 0) -> int:
        nodes.append(Node(tag, held.stack[-1], never, [], marked))
        nodes[held.stack[-1]].kids.append(len(nodes) - 1)
        return len(nodes) - 1

    while at < end:
        found = page.find("<", at)
        if found < 0:
            nodes[held.stack[-1]].kids.append(page[at:])
            break
        if found > at:
            nodes[held.stack[-1]].kids.append(page[at:found])
        nxt = page[found + 1:found + 2]
        if nxt in ("!", "?") or nxt == "/" and not page[found + 2:found + 3].isalpha():
            if page.startswith("<!--", found):
                empty = page.startswith((">", "->"), found + 4)
                stop = page.find(">" if empty else "-->", found + 4)
                at = end if stop < 0 else stop + (1 if empty else 3)
            else:
                at = end if found > last else page.find(">", found) + 1
            continue
        if not (nxt == "/" or "a" <= nxt.lower() <= "z"):
            nodes[held.stack[-1]].kids.append("<")
            at = found + 1
            continue
        m = None
        if found < last:
            m = _TAG.match(page, found) if quotes else None
            if m is None:
                quotes = False
                m = _LOOSE.match(page, found)
        if m is None:  # a tag cut off by the end of the page
            rest = page.find("<", found + 1)
            at = end if rest < 0 else rest
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                add(tag)
            else:
                held.close((tag,), P_SCOPE if tag == "p" else LISTS if tag == "li" else None if tag in TABLE
                           else CELLS if tag in BLOCK else BLOCK)
            continue
        if tag in BLOCK and tag != "html" and tag != "body":
            held.close(("p",), P_SCOPE)
        if tag in CLOSES:
            held.close(CLOSES[tag], LISTS)
        attrs = m[3]
        marked = _marked(attrs) if tag not in NEVER and tag in CONTAINERS and attrs.strip("/ ") else 0
        number = add(tag, bool(marked) or tag in NEVER, marked)
        if tag in VOID:
            continue
        if tag in RAW:
            m_end = _RAW_END[tag].search(page, at)
            nodes[number].kids.append(page[at:m_end.start() if m_end else end])
            at = m_end.end() if m_end else end
            continue
        if not attrs.endswith("/"):
            held.push(number)
    _unmark(nodes)
    return nodes


def _amounts(nodes: list[Node], seen: list[bool]) -> list[int]:
    """Characters of text in every subtree, those of the elements in ``seen`` only."""
    out = [sum(len(" ".join(x.split())) for x in n.kids if isinstance(x, str)) if s and n.tag not in RAW else 0 for n, s in zip(nodes, seen)]
    for k in range(len(nodes) - 1, 0, -1):
        out[nodes[k].parent] += out[k]
    return out


def _unmark(nodes: list[Node]) -> None:
    """Marks of layout go from what holds the article (or else the main), if that is most of the page and no other one is free."""
    for n in nodes:
        if n.tag in ("html", "body"):
            n.never, n.marked = False, 0
    above: list[tuple[int, bool]] = []  # marks, and whether anything above is never text for another reason
    for n in nodes:
        marks, shut = above[n.parent] if n.parent >= 0 else (0, False)
        above.append((marks + bool(n.marked), shut or n.never and n.marked != 1))
    held = [k for k, n in enumerate(nodes) if n.tag in ("article", "main") and not above[k][1]]
    if not held or not any(above[k][0] for k in held):
        return
    every = _amounts(nodes, [not shut for _, shut in above])
    free = _amounts(nodes, [not shut and not marks for marks, shut in above])
    if any(not above[k][0] and free[k] for k in held):
        return
    for tag in ("article", "main"):
        got = [k for k in held if nodes[k].tag == tag and every[k]]
        if got:
            least = min(above[k][0] for k in got)
            chosen = [k for k in got if above[k][0] == least]
            if max(every[k] for k in chosen) <= free[0]:
                return
            freed: set[int] = set()
            for k in chosen:
                while k > 0 and k not in freed:
                    freed.add(k)
                    if nodes[k].marked:
                        nodes[k].never, nodes[k].marked = False, 0
                    k = nodes[k].parent
            return


def _main(nodes: list[Node]) -> tuple[list[int], bool]:
    """(main elements, whether they are an article or main)."""
    shut = [False] * len(nodes)
    found: dict[str, list[int]] = {"article": [], "main": []}
    inside: list[tuple[bool, bool]] = []  # an article, a main above
    for k, n in enumerate(nodes):
        shut[k] = n.never or n.parent >= 0 and shut[n.parent]
        article, main = inside[n.parent] if n.parent >= 0 else (False, False)
        inside.append((article or n.tag == "article", main or n.tag == "main"))
        # nested ones belong to the outer one
        if n.tag in found and not shut[k] and not (article if n.tag == "article" else main):
            found[n.tag].append(k)
    if found["article"] and found["main"]:
        amount = _amounts(nodes, [not s for s in shut])
        within = [k for k in found["article"] if inside[nodes[k].parent][1]]
        whole = sum(amount[k] for k in found["main"])
        if whole and any(inside[k][0] for k in found["main"]):  # a main inside an article
            return found["article"], True
        if whole:
            return (within if 2 * sum(amount[k] for k in within) >= whole else found["main"]), True
    for tag in ("article", "main"):
        if found[tag]:
            return found[tag], True
    body = [k for k, n in enumerate(nodes) if n.tag == "body"]
    return body[:1] or [0], False


def subtree_hashes(nodes: list[Node]) -> list[int | None]:
    """64-bit hash of every element that holds text, over tags, texts and order."""
    marks: list[int | None] = [None] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        n = nodes[k]
        if n.tag in RAW:
            continue
        parts, some = [n.tag], False
        for kid in n.kids:
            if isinstance(kid, str):
                if said := " ".join(kid.split()):
                    parts.append("t" + said)
                    some = True
            else:
                parts.append(f"e{marks[kid]}")
                some = some or marks[kid] is not None
        if some:
            marks[k] = xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "replace")) - (1 << 63)
    return marks


def _removable(nodes: list[Node]) -> list[bool]:
    """Which elements may be template: not those that hold the main element, nor text blocks inside an article."""
    main, article = _main(nodes)
    keep = {0}
    for k in main:
        while k not in keep:
            keep.add(k)
            k = nodes[k].parent
    inside = [False] * len(nodes)
    out = [False] * len(nodes)
    mains = set(main)
    for k, n in enumerate(nodes):
        inside[k] = k in mains or n.parent >= 0 and inside[n.parent]
        text_only = article and inside[k] and n.tag in TEXT_BLOCKS
        out[k] = k not in keep and n.tag in BLOCK and not text_only
    return out


def main_text(nodes: list[Node], drop: set[int]) -> str:
    """Text of the main element without unwanted and template subtrees."""
    marks = subtree_hashes(nodes) if drop else None
    may = _removable(nodes) if drop else None
    main, article = _main(nodes)
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if said := " ".join("".join(run).split()):
            blocks.append(said)
        run.clear()

    for root in main:
        flush()
        todo: list = [root]
        while todo:
            item = todo.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                run.append(_html.unescape(item))
            else:
                n = nodes[item]
                if n.tag == "br" or n.tag in ("td", "th"):
                    run.append(" ")
                gone = item != root and (n.never or n.tag == "header" and not article
                                         or marks is not None and may[item] and marks[item] in drop)
                block = n.tag in BLOCK
                if block:
                    flush()
                if gone or n.tag in RAW:
                    continue
                if block:
                    todo.append(None)
                todo.extend(reversed(n.kids))
        flush()
    return "\n\n".join(blocks)


def host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def page_subtrees(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, page_key, main, hash): one row per distinct removable subtree of a page; ``main`` is the hash of its main elements."""
    slim = pages.select(host(F.col(f"`{url}`")).alias("host"), row_key(url, page).alias("page_key"),
                        F.col(f"`{page}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, keys, mains, found = [], [], [], []
            for h, k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                nodes = read_tree(text.as_py() or "")
                marks = subtree_hashes(nodes)
                main = xxhash.xxh64_intdigest(repr([marks[k] for k in _main(nodes)[0]])) - (1 << 63)
                mine = {m for m, may in zip(marks, _removable(nodes)) if may and m is not None}
                hosts += [h] * len(mine)
                keys += [k] * len(mine)
                mains += [main] * len(mine)
                found += mine
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(mains, pa.int64()),
                                              pa.array(found, pa.int64())], ["host", "page_key", "main", "hash"])

    return slim.mapInArrow(run, "host string, page_key long, main long, hash long")


def site_templates(subtrees: DataFrame, min_pages: int = 10) -> DataFrame:
    """(host, hash) of subtrees that recur across many pages of their host; pages of one main element are one."""
    sizes = subtrees.select("host", "main").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    seen = (subtrees.select("host", "hash", "main").distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
            .where("n >= 3"))
    enough = F.least(F.lit(min_pages), F.floor(F.col("pages") / 2) + 1)
    return seen.join(sizes, "host").where(F.col("n") >= enough).select("host", "hash")


def extract(pages: DataFrame, url: str = "url", page: str = "html", keep: tuple[str, ...] = ("page_id", "url"),
            min_pages: int = 10) -> DataFrame:
    """(*keep, text, n_chars): one row per page."""
    subtrees = written(page_subtrees(pages, url, page), "subtrees")
    # a template of a large host stands on all its pages: its rows are dealt over SALTS tasks
    templates = written(site_templates(subtrees, min_pages), "templates").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = subtrees.withColumn("salt", F.pmod("page_key", F.lit(SALTS)).cast("int"))
    # merged by hint: the planner takes both lists for as small as the files they come from
    drops = (salted.join(templates.hint("merge"), ["host", "hash", "salt"], "left_semi").groupBy("page_key")
             .agg(F.collect_set("hash").alias("_drop")))
    slim = pages.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)],
                        F.col(f"`{page}`").alias("_html"), row_key(url, page).alias("page_key"))
    met = slim.join(drops.hint("merge"), "page_key", "left").drop("page_key")
    fields = [T.StructField(c, pages.schema[c].dataType) for c in keep]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keep)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                texts = [main_text(read_tree(h.as_py() or ""), set(d.as_py() or ()))
                         for h, d in zip(b.column(n), b.column(n + 1))]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:n], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema.names)

    return met.mapInArrow(run, schema)
