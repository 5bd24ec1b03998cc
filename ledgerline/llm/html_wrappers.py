"""HTML extraction (9): union-free wrappers inferred from the pages of a host.

A page's token stream is folded into a shape: nested block elements, in which equal neighbours become a repeated group
and text becomes a slot. Shapes of one host are aligned one after the other: elements that both have are merged,
elements that one lacks become optional, runs become repeated groups, and texts that differ stay slots. The result is
the host's wrapper, a regular expression without unions. The wrapper's slots are then told apart: slots in menus,
headers, footers, sidebars, notices, adverts, forms and comments are template, as are slots outside an article whose
text is the same on all pages, unless the pages are copies whose equal text outweighs what differs. Which slots are main
depends on the optional groups that a page fills: on a page with an article the slots inside it, or those of the main
element if it holds more text than the articles do; on others those of the element with most prose. A page's main text
is what its tokens put into main slots.

Aligning is a fold with a small state, so no group of pages is gathered: each task first merges the shapes of its own
pages of a host, then salted shares of a host are merged, then the host. Wrappers are joined back to the pages by host.

Defined results: null html is empty (empty text); a page with a null or odd address is a host of its own;
repeated rows give repeated results; unclosed, crossed and surplus tags are tolerated at any depth (elements nested
deeper than ``DEEPEST`` count as one); texts of any length are taken whole; other columns are left out; an empty table
gives an empty table.
"""

from __future__ import annotations

import html as references
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.storage import settle, ship
from ledgerline.llm.url_filter import host_of

#: Shares that the pages of one host are dealt into before their wrappers meet.
SHARES = 64
#: A wrapper table of up to so many hosts (a few kB each) is broadcast; a larger one is joined by shuffle.
BROADCAST_HOSTS = 2_000
#: Elements nested deeper than this are taken together as one, as browsers do.
DEEPEST = 128
#: Lists of children whose product is larger than this are aligned by rows of bits.
TABLE_CELLS = 250_000
#: Different pages that must agree before a text outside an article counts as template.
LEAST_PAGES = 5

# Fixed values of HTML.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe"}
#: Those that go on to the end of the page if they have no closing tag.
ENDLESS = {"script", "style", "textarea", "title"}
BLOCK = set("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption "
            "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table "
            "tbody td tfoot th thead tr ul caption button label option svg foreignobject select".split())
VOID = {"hr", "br", "img", "input", "link", "meta", "wbr", "source", "area", "base", "col", "embed", "param", "track"}
#: A new element of the first kind ends an open one of these kinds.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
        "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
PARAGRAPH_ENDS = BLOCK - {"button", "label", "option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "html",
                          "head", "body", "li", "dt", "dd", "summary", "svg", "foreignobject", "select"}
#: Elements that a new block element ends, unless it is one of these.
BROKEN_BY_BLOCKS = {"svg": {"svg", "foreignobject"}, "select": {"option"}}
#: An end tag does not look past these for its element.
SCOPES = {"table", "td", "th", "html"}
TEMPLATE_TAGS = {"nav", "aside", "footer", "form", "dialog", "menu", "button", "label", "option", "head", "svg", "select"}
TEMPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu",
                  "menubar", "form", "toolbar"}
TEMPLATE_WORDS = re.compile(
    r"(?:nav(?:bar|igation)?|menu|sidebar|footer|ads?|advert(?:s|isements?|ising)?|sponsor(?:ed)?|promo(?:tion)?|"
    r"banner|cookies?|consent|notices?|breadcrumbs?|comments?|commentlist|repl(?:y|ies)|discussion|disqus|share|"
    r"sharing|social|related|newsletter|subscribe|subscription|popup|modal|widget|masthead|toolbar|pagination|pager|"
    r"login|signup|skip)$")
COMMENT_WORDS = re.compile(r"(?:comments?|commentlist|disqus|repl(?:y|ies))$")
#: Words that leave a name's meaning as it is: comments-area, ad-slot, related-posts.
NEUTRAL_WORDS = set("area areas box boxes section sections list lists slot slots user users site reader readers wrapper "
                    "wrap container block blocks panel unit units holder item items thread posts links box1 box2 top "
                    "bottom left right inner outer global page".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Elements that are template by their names inside an article too; names of its sections and paragraphs are anchors.
GROUPS = {"div~", "ul~", "ol~", "dl~", "li~", "figure~", "table~"}
ARTICLE_WORDS = re.compile(r"(?:article|post|entry|story)(?:[-_]?(?:body|content|text))$|^(?:articlebody|main-content)$")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def label_of(name: str, attributes: str) -> str:
    """The element's kind: its tag, and one of ``-`` (template), ``~`` (template by a name), ``+`` (article) or nothing."""
    if name in ("html", "body"):
        return name
    found = {k.lower(): (a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    role = found.get("role", "").lower()
    names = found.get("class", "").lower().split()
    words = [*names, *found.get("id", "").lower().split()]
    hidden = ("hidden" in found or found.get("aria-hidden", "").lower() == "true"
              or "display:none" in found.get("style", "").lower().replace(" ", ""))
    comments = any(map(COMMENT_WORDS.match, names))
    if name in ("article", "main") or role in ("main", "article") or any(
            ARTICLE_WORDS.search(word) for word in [*words, found.get("itemprop", "").lower()]):
        return name + "+" if not hidden and (name == "main" or not comments) else name + "-"
    if name in TEMPLATE_TAGS or hidden or role in TEMPLATE_ROLES or name == "section" and comments:
        return name + "-"
    if name not in HEADINGS and any(map(is_template_name, words)):
        return name + "~"
    return name


def is_template_name(name: str) -> bool:
    """Made of template words, and words that say nothing beside them: cookie-notice, comments-area and ad-slot, but not
    no-sidebar, sidebar-open or related-work."""
    parts = [part for part in re.split(r"[-_]+", name) if part]
    known = [bool(TEMPLATE_WORDS.match(part)) for part in parts]
    return any(known) and all(match or part in NEUTRAL_WORDS for match, part in zip(known, parts))


class Open:
    """The open elements of a page. Beyond ``DEEPEST`` they count as one element, whose kind follows from theirs."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.labels: list[str] = []
        self.deep: dict[str, int] = {}

    def push(self, name: str, label: str) -> None:
        if len(self.names) >= DEEPEST:
            self.deep[label] = self.deep.get(label, 0) + 1
        self.names.append(name)
        self.labels.append(label)

    def cut(self, size: int) -> None:
        """Close all elements from place ``size`` on."""
        while len(self.names) > size:
            self.names.pop()
            label = self.labels.pop()
            if len(self.names) >= DEEPEST:
                self.deep[label] -= 1

    def path(self) -> tuple[str, ...]:
        if len(self.labels) <= DEEPEST:
            return tuple(self.labels)
        held = [label for label, n in self.deep.items() if n]
        for kinds in ([x for x in held if x.endswith("-")], [x for x in held if x in GROUPS],
                      [x for x in held if x == "article+"], [x for x in held if x.endswith("+")]):
            if kinds:
                return (*self.labels[:DEEPEST], min(kinds))
        return (*self.labels[:DEEPEST], self.labels[-1])


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str]]:
    """(path of labels, text) of each run of text that no block boundary parts, in page order."""
    open_ = Open()
    names = open_.names
    held: list[str] = []
    endings: set[str] = set()  # kinds of RAW that no closing tag follows any more
    at, size = 0, len(page)

    def flush() -> Iterator[tuple[tuple[str, ...], str]]:
        text = " ".join(references.unescape("".join(held)).split())
        held.clear()
        if text:
            yield open_.path(), text

    while at < size:
        found = _TOKEN.match(page, at)
        if found is None:  # a tag that never ends
            break
        at = found.end()
        if found["text"] is not None:
            held.append(found["text"])
            continue
        if found["name"] is None:
            continue
        name = found["name"].lower()
        if found["end"]:
            if name == "br" or name not in BLOCK:
                if name in ("br", "p", "object"):
                    held.append(" ")
                continue
            yield from flush()
            for i in range(len(names) - 1, -1, -1):
                if names[i] == name:
                    open_.cut(i)
                    break
                if names[i] in SCOPES and name not in SCOPES and name not in ("tbody", "thead", "tfoot", "tr", "body"):
                    break
            continue
        closed = found["attrs"].endswith("/")
        if name == "svg" and closed or closed and "svg" in names[-1:]:
            held.append(" ")
            continue
        if name in RAW:
            closing = None if name in endings else _RAW_END[name].search(page, at)
            if closing:
                at = closing.end()
            elif name in ENDLESS:
                at = size
            else:
                endings.add(name)
            if name not in ("script", "style", "noscript", "template"):
                held.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                yield from flush()
            elif name == "br":
                held.append(" ")
            continue
        if name == "object":
            held.append(" ")
        if name not in BLOCK:
            continue
        yield from flush()
        if names[-2:] == ["select", "option"] and name != "option":
            open_.cut(len(names) - 1)
        while names and name not in BROKEN_BY_BLOCKS.get(names[-1], {name}):
            open_.cut(len(names) - 1)
        closes = ENDS.get(name, set()) | ({"p"} if name in PARAGRAPH_ENDS else set())
        while names and names[-1] in closes:
            open_.cut(len(names) - 1)
        open_.push(name, label_of(name, found["attrs"]))
    yield from flush()


# -- shapes and wrappers -----------------------------------------------------------------------------------------
# A shape is [label, optional, repeated, children, slot]. A slot is None, or what is known of the texts in it:
# [pages, characters, digest of the text if it is the same on all pages, else 0].


def shape_of(page: str) -> list:
    """The folded shape of one page."""
    root: list = ["", False, False, [], None]
    open_: list[list] = [root]
    labels: tuple[str, ...] = ()
    for path, text in blocks(page):
        same = 0
        while same < min(len(labels), len(path)) and labels[same] == path[same]:
            same += 1
        # A text right after another under the same element is a new element of that kind, if it has one.
        if path and same == len(path) == len(labels):
            same -= 1
        del open_[same + 1:]
        for label in path[same:]:
            child: list = [label, False, False, [], None]
            open_[-1][3].append(child)
            open_.append(child)
        labels = path
        mark = xxhash.xxh3_64_intdigest(text) >> 1 or 1
        slot = open_[-1][4]
        open_[-1][4] = [1, len(text), mark] if slot is None else [1, slot[1] + len(text), slot[2] * 31 + mark & 2**62 - 1]
    return fold(root)


def fold(shape: list) -> list:
    """Equal neighbours become one repeated group."""
    children: list[list] = []
    for child in map(fold, shape[3]):
        if children and children[-1][0] == child[0]:
            children[-1] = align(children[-1], child, new_page=False)
            children[-1][2] = True
        else:
            children.append(child)
    return [shape[0], shape[1], shape[2], children, shape[4]]


def align(a: list, b: list, new_page: bool = True) -> list:
    """The least general shape that both match; both have the same label."""
    slot = a[4] or b[4]
    if a[4] and b[4]:
        pages = a[4][0] + b[4][0] if new_page else a[4][0]
        same = a[4][2] if a[4][2] == b[4][2] else 0
        slot = [pages, a[4][1] + b[4][1], same if new_page else a[4][2] * 31 + b[4][2] & 2**62 - 1]
    left, right = a[3], b[3]
    if [x[0] for x in left] == [x[0] for x in right]:
        children = [align(x, y, new_page) for x, y in zip(left, right)]
    else:
        children = _merge(left, right, new_page)
    return [a[0], a[1] or b[1], a[2] or b[2], children, slot]


def _merge(left: list, right: list, new_page: bool) -> list:
    """Children along a longest common sequence of labels; the others are optional."""
    out: list[list] = []

    def put(child: list, optional: bool) -> None:
        child = [child[0], child[1] or optional, child[2], child[3], child[4]]
        if out and out[-1][0] == child[0]:  # neighbours of one kind are one group that repeats
            child = align(out[-1], child, new_page)
            child[2] = True
            out[-1] = child
        else:
            out.append(child)

    i = j = 0
    for x, y in [*common([child[0] for child in left], [child[0] for child in right]), (len(left), len(right))]:
        for child in left[i:x]:
            put(child, True)
        for child in right[j:y]:
            put(child, True)
        if x < len(left):
            put(align(left[x], right[y], new_page), False)
        i, j = x + 1, y + 1
    return out


def common(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common sequence of two lists, in order."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(left), 0, len(right))]
    while todo:
        i, n, j, m = todo.pop()
        if (n - i) * (m - j) <= TABLE_CELLS:
            found += _common_by_table(left, right, i, n, j, m)
            continue
        while i < n and j < m and left[i] == right[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and left[n - 1] == right[m - 1]:
            n, m = n - 1, m - 1
            found.append((n, m))
        if i == n or j == m:
            continue
        if n - i == 1:
            found += [(i, k) for k in range(j, m) if right[k] == left[i]][:1]
            continue
        # Halve one list where the best sequences of both halves meet in the other: no table, only rows of bits.
        half = (i + n) // 2
        ahead = _lengths(left[i:half], right[j:m])
        behind = _lengths(left[half:n][::-1], right[j:m][::-1])[::-1]
        meet = j + int((ahead + behind).argmax())
        todo += [(i, half, j, meet), (half, n, meet, m)]
    return sorted(found)


def _lengths(left: list[str], right: list[str]) -> np.ndarray:
    """Length of the longest common sequence of ``left`` and each beginning of ``right``, a row of bits at a time."""
    places: dict[str, int] = {}
    for label in set(right):
        bits = np.fromiter((x == label for x in right), bool, len(right))
        places[label] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    every = (1 << len(right)) - 1
    row = every
    for label in left:
        kept = row & places.get(label, 0)
        row = (row + kept | row - kept) & every
    data = np.frombuffer(row.to_bytes(len(right) // 8 + 1, "little"), np.uint8)
    unset = 1 - np.unpackbits(data, bitorder="little")[:len(right)].astype(np.int64)
    return np.concatenate([[0], np.cumsum(unset)])


def _common_by_table(left: list[str], right: list[str], i: int, n: int, j: int, m: int) -> list[tuple[int, int]]:
    best = [[0] * (m - j + 1) for _ in range(n - i + 1)]
    for a in range(n - i - 1, -1, -1):
        for b in range(m - j - 1, -1, -1):
            best[a][b] = (best[a + 1][b + 1] + 1 if left[i + a] == right[j + b]
                          else max(best[a + 1][b], best[a][b + 1]))
    found, a, b = [], 0, 0
    while a < n - i and b < m - j:
        if left[i + a] == right[j + b]:
            found.append((i + a, j + b))
            a, b = a + 1, b + 1
        elif best[a + 1][b] >= best[a][b + 1]:
            a += 1
        else:
            b += 1
    return found


def expression(wrapper: list) -> str:
    """The wrapper as a regular expression over tags, for people to read."""
    inside = ("#" if wrapper[4] else "") + " ".join(map(expression, wrapper[3]))
    body = f"<{wrapper[0]}>{inside}</{wrapper[0]}>"
    return (f"({body})" if wrapper[1] or wrapper[2] else body) + ("*" if wrapper[1] and wrapper[2] else
                                                                   "+" if wrapper[2] else "?" if wrapper[1] else "")


def is_template(path: tuple[str, ...], named: bool = True) -> bool:
    """Inside a menu, notice and the like; a header is template unless an article holds it.

    Unless ``named``, the names of elements that hold an article, or other elements where there is none, do not count.
    """
    article = next((i for i, label in enumerate(path) if label.endswith("+")), None)
    for i, label in enumerate(path):
        inside = article is not None and i > article
        if label.endswith("-") or label.rstrip("~") == "header" and not inside:
            return True
        if label.endswith("~") and (label in GROUPS if inside else named or i == len(path) - 1):
            return True
    return False


Path = tuple[str, ...]


def slots_of(wrapper: list) -> dict[Path, list[list]]:
    """What is known of the texts of each slot."""
    slots: dict[Path, list[list]] = {}

    def walk(shape: list, path: Path) -> None:
        if shape[4]:
            slots.setdefault(path, []).append(shape[4])
        for child in shape[3]:
            walk(child, (*path, child[0]))

    walk(wrapper, ())
    return slots


def main_slots(wrapper: list, own: dict[Path, int] | None = None) -> set[Path]:
    """Paths of the slots that hold main text."""
    return choose(slots_of(wrapper), own)


def choose(slots: dict[Path, list[list]], own: dict[Path, int] | None = None) -> set[Path]:
    """Paths of the main slots for a page that puts so many characters (``own``) into each path that it fills.

    Without a page, all that the host fills counts.
    """
    if own is None:
        own = {path: sum(chars for _, chars, _ in found) for path, found in slots.items()}
    usable = [path for path in own if not is_template(path)]
    article = {path for path in usable if "article+" in path}
    rest = {path for path in usable if path not in article and any(label.endswith("+") for label in path)}
    if article or rest:
        if sum(map(own.get, article)) >= sum(map(own.get, rest)):
            return article
        # The articles are cards: main text too where the main element holds them.
        return rest | {path for path in article if next(x for x in path if x.endswith("+")) != "article+"}
    # Articles that only elements with a template's name hold, unless other elements have more text.
    main = _prose(slots, own, usable)
    others = [path for path in own if not is_template(path, named=False)]
    held = {path for path in others if any(label.endswith("+") for label in path)}
    if held and sum(map(own.get, held)) > sum(map(own.get, main)):
        return held
    return main or _prose(slots, own, others)


def _prose(slots: dict[Path, list[list]], own: dict[Path, int], usable: list[Path]) -> set[Path]:
    """Paths in the elements with most prose, of a page without an article."""
    fixed = [path for path in usable if all(pages >= LEAST_PAGES and same for pages, _, same in slots[path])]
    varied = [path for path in usable if path not in fixed]

    def heaviest(paths: list[Path], chars: dict[Path, float]) -> tuple[Path, float]:
        weight: dict[Path, float] = {}
        for path in paths:
            prose = path[:-1] if path and path[-1] in ("p", "li", "h1", "h2", "h3", "h4", "blockquote", "pre") else path
            weight[prose] = weight.get(prose, 0) + chars[path]
        found = max(weight, key=lambda path: (weight[path], path))
        return found, weight[found]

    def within(paths: list[Path], element: Path) -> set[Path]:
        return {path for path in paths if path[:len(element)] == element}

    if not usable:
        return set()
    if not varied:
        varied, fixed = usable, []
    # The element with most prose on the host; slots of other elements are main text too if they lie inside it.
    main = within(varied, heaviest(varied, {path: sum(chars for _, chars, _ in slots[path]) for path in varied})[0])
    # A slot may weigh much by pages of another layout: the page's own element counts too if it is far larger.
    element, chars = heaviest(varied, own)
    if chars > 2 * sum(map(own.get, main)):
        main |= within(varied, element)
    # If what is equal outweighs what differs, the pages are copies, and equal text is no sign of template.
    if fixed:
        each = {path: sum(chars / pages for pages, chars, _ in slots[path]) for path in usable}
        element, chars = heaviest(fixed, each)
        if chars > sum(map(each.get, varied)):
            main |= within(usable, element)
    return main


def _wrap(batches: Iterator[pa.RecordBatch], read) -> Iterator[tuple[str, list]]:
    """One wrapper per run of equal hosts (first column); ``read`` makes a shape of the second column."""
    host, wrapper = None, None
    for batch in batches:
        for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            shape = read(value)
            if name == host and wrapper is not None:
                wrapper = align(wrapper, shape)
            else:
                if wrapper is not None:
                    yield host, wrapper
                host, wrapper = name, shape
    if wrapper is not None:
        yield host, wrapper


def _rows(found: list[tuple[str, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([host for host, _ in found], pa.string()),
                                       pa.array([json.dumps(shape) for _, shape in found], pa.string())],
                                      names=["host", "wrapper"])


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of pages (host, html)."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A wrapper for each host among the pages of a batch."""
        for batch in batches:
            held: dict[str, list] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shape = shape_of(page or "")
                held[host] = align(held[host], shape) if host in held else shape
            yield _rows(list(held.items()))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in _wrap(batches, json.loads):
            yield _rows([pair])

    parts = pages.select("host", "html").mapInArrow(of_task, "host string, wrapper string")
    # Shares of a host first, so that a host in every task meets in no single place at once.
    shared = (parts.withColumn("share", F.pmod(F.xxhash64("wrapper"), F.lit(SHARES)))
              .repartition("host", "share").sortWithinPartitions("host").select("host", "wrapper")
              .mapInArrow(merged, "host string, wrapper string"))
    return (shared.repartition("host").sortWithinPartitions("host", "wrapper")
            .mapInArrow(merged, "host string, wrapper string"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ship(pages.sparkSession)
    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    wrappers = settle(infer_wrappers(hosted.where("host != ''")), "wrappers").withColumnRenamed("host", "of_host")
    few = wrappers.count() <= BROADCAST_HOSTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if wrapper is not None and wrapper not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[wrapper] = slots_of(json.loads(wrapper))
                found, own = list(blocks(page or "")), {}
                for path, text in found:
                    own[path] = own.get(path, 0) + len(text)
                main = choose(slots_of(shape_of(page or "")) if wrapper is None else known[wrapper], own)
                texts.append(" ".join(text for path, text in found if path in main))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return (hosted.join(F.broadcast(wrappers) if few else wrappers, F.col("host") == F.col("of_host"), "left")
            .select("page_id", "url", "html", "wrapper")
            .mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint"))
