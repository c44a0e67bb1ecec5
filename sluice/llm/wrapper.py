"""Main text of web pages by wrapper induction.

Pages of one host are parsed into trees, and the trees aligned by simple tree
matching, repeated siblings standing for one node.  Nodes whose text is the same
on all aligned pages are the host's template; nodes whose text varies are slots.
The slots below the node that holds the article, other than menus, notices,
adverts and the like, are the content.  A page without others of its host is
its own wrapper.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import saved, whole_text

#: Pages of a host that are aligned with one another; a larger host has several such groups, each with a wrapper.
GROUP = 128
#: Characters of pages in a group from which it is cut.
GROUP_CHARS = 16 << 20
#: Pages that must have a node, all with the same text, for it to be template.
ALIKE = 3
#: Varying words of a page, below which they do not tell whether it differs as a whole.
FEW = 8
#: Nesting that is followed; deeper elements count as their ancestor's.
DEEP = 200
#: A region that holds this share of a node's varying text takes its place.
MOST_OF_TEXT = 0.8
#: Share of a slot's text within links from which it is a menu.
LINKED = 0.6

#: How HTML elements nest and what they hold.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("head script style noscript template title textarea select option button form iframe object svg math canvas audio video dialog map fieldset input".split())
ASIDE = frozenset("nav footer aside menu".split())
RAW = frozenset("script style textarea title iframe noframes xmp".split())
MAIN = ("article", "main")
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd td th tr tbody thead tfoot".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
WALLS = {"li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"])}
#: Elements that hold text rather than other blocks.
TEXTUAL = frozenset("p li td blockquote pre h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role attributes that mark what is not the article, and what may be it.
OTHER = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended recommendations "
    "comment comments reply replies disqus pagination pager copyright contentinfo complementary toolbar skip hidden tags byline".split()
)
LIKELY = frozenset("article content main post entry story body text".split())
#: Elements that hold the article whatever their names say, and forms, which may hold a whole page.
WHOLE = frozenset("root html body main".split())
FORMS = frozenset("form fieldset".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|[\"'][^>]*(?:>|\Z)|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.I)
WORDS = re.compile(r"[A-Za-z]+")


class Node:
    """An element: its label, its children (elements and strings), and the attribute words that tell its role."""

    __slots__ = ("tag", "label", "words", "children", "gone")

    def __init__(self, tag: str, words: frozenset[str] = frozenset(), gone: bool = False):
        self.tag, self.words, self.gone, self.children = tag, words, gone, []
        self.label = f"{tag}.{'.'.join(sorted(words))}" if words else tag


def attributes(text: str) -> tuple[frozenset[str], bool]:
    """The words of class, id and role, in lower case, and whether the element is hidden."""
    words, gone = set(), False
    for name, *values in ATTRIBUTE.findall(text):
        value = next((v for v in values if v), "").lower()
        if name.lower() == "hidden":
            gone = True
        elif name.lower() == "style":
            gone |= "display:none" in value.replace(" ", "")
        else:
            words.update(WORDS.findall(value))
    return frozenset(words), gone


def parsed(html: str) -> Node:
    """The tree of a page, whatever its faults: unclosed elements end where HTML ends them, stray end tags are ignored."""
    root = Node("root")
    stack = [root]
    at, find, size = 0, TOKEN.search, len(html)
    while at < size:
        m = find(html, at)
        if m is None:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at, tag = m.end(), m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if tag in INLINE and any(x.tag not in INLINE for x in stack[k + 1 :]):
                        break  # an inline end tag does not end the blocks inside
                    del stack[k:]
                    break
            continue
        if tag not in INLINE:
            for k in range(len(stack) - 1, 0, -1):
                if tag in CLOSED_BY.get(stack[k].tag, ()):
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE and (stack[k].tag not in CLOSED_BY or tag in WALLS.get(stack[k].tag, ())):
                    break
        node = Node(tag, *attributes(m[3])) if "=" in m[3] or "hidden" in m[3] else Node(tag)
        if len(stack) > DEEP and tag not in SILENT:
            continue
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(html, at)
            at = end.start() if end else size
            if end and (close := html.find(">", at)) >= 0:
                at = close + 1
            elif end:
                at = size
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


@dataclass
class Slot:
    """A node of a wrapper: where it hangs, and what the aligned pages have there."""

    label: str
    tag: str
    words: frozenset[str]
    repeated: bool = False
    children: list[Slot] = field(default_factory=list)
    pages: int = 0
    same: bool = True
    text: int | None = None
    chars: int = 0
    linked: int = 0
    most: bool = False


def opened(root: Node) -> Node:
    """The tree, in which a form that holds most of the page's text without links is a block like any other."""
    sizes: dict[int, int] = {}

    def size(node: Node) -> int:
        total = 0
        for c in node.children:
            if isinstance(c, str):
                total += len("".join(c.split()))
            elif not c.gone and c.tag != "a" and (c.tag in FORMS or c.tag not in SILENT):
                total += size(c)
        sizes[id(node)] = total
        return total

    def open_below(node: Node, whole: int) -> None:
        for c in node.children:
            if isinstance(c, str) or 2 * sizes.get(id(c), 0) <= whole:
                continue
            if c.tag in FORMS:
                c.tag, c.label = "div", ".".join(["div", *sorted(c.words)])
            open_below(c, whole)

    open_below(root, size(root))
    return root


def shape(node: Node) -> tuple:
    """A tree of labels in which equal siblings in a row stand once: (label, repeated, children, nodes).  Inline elements are left out."""
    out: list[list] = []

    def gather(x: Node) -> None:
        for c in x.children:
            if isinstance(c, str) or c.tag in SILENT or c.gone:
                continue
            if c.tag in INLINE and not c.words & OTHER:
                gather(c)
            elif out and out[-1][0] == c.label:
                out[-1][1].append(c)
            else:
                out.append([c.label, [c]])

    gather(node)
    return out


def skeleton(nodes: list[Node]) -> list[tuple[str, list[Node], list]]:
    """For a run of equal siblings, the runs of their children, siblings taken together."""
    runs: list[tuple[str, list[Node]]] = []
    for node in nodes:
        own = shape(node)
        if not runs:
            runs = [(label, list(x)) for label, x in own]
        elif own:
            pairs = aligned([(label, None) for label, _ in runs], [(label, None) for label, _ in own], lambda a, b: 1)
            taken = {j: i for i, j in pairs}
            for j, (label, x) in enumerate(own):
                if j in taken:
                    runs[taken[j]][1].extend(x)
                else:
                    same = next((r for r in runs if r[0] == label), None)
                    if same is not None:
                        same[1].extend(x)
                    else:
                        runs.append((label, list(x)))
    return [(label, x, skeleton(x)) for label, x in runs]


def matched(left: list, right: list, weight) -> tuple[int, list[tuple[int, int]]]:
    """A maximum-weight order-preserving matching of nodes with equal labels (first items): its weight, and its pairs of positions.

    Each weight is asked for once.
    """
    labels = [x[0] for x in left]
    if labels == [x[0] for x in right] and len(set(labels)) == len(labels):
        return sum(map(weight, left, right)), [(k, k) for k in range(len(left))]
    m, n = len(left), len(right)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    gain = [[weight(a, b) if a[0] == b[0] else 0 for b in right] for a in left]
    for i in range(m):
        for j in range(n):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + gain[i][j])
    out, i, j = [], m, n
    while i and j:
        if gain[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + gain[i - 1][j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m][n], out[::-1]


def aligned(left: list, right: list, weight) -> list[tuple[int, int]]:
    """The pairs of positions of a maximum-weight matching."""
    return matched(left, right, weight)[1]


def matching(left: tuple, right: tuple) -> int:
    """Simple tree matching: the nodes of a maximum matching of two trees (label, ..., children) with equal roots."""
    return 1 + matched(left[-1], right[-1], matching)[0]


def outline(slot: Slot) -> tuple:
    return (slot.label, slot, [outline(c) for c in slot.children])


def text_of(node: Node, out: list[str], within: bool = False, links: list[int] | None = None) -> None:
    """Adds the text of a node's own inline content to out, and the characters within links to links."""
    for c in node.children:
        if isinstance(c, str):
            out.append(c)
            if within and links is not None:
                links[0] += len(c)
        elif c.tag in SILENT or c.gone or (c.words & OTHER and c.tag in INLINE):
            continue
        elif c.tag in INLINE:
            text_of(c, out, within or c.tag == "a", links)
        else:
            out.append(" ")


def merge(slot: Slot, run: tuple[str, list[Node], list], assigned: dict[int, Slot]) -> None:
    """Aligns one page's run of nodes with a slot of the wrapper and adds what it does not have yet."""
    _, nodes, below = run
    slot.pages += 1
    slot.repeated |= len(nodes) > 1
    parts, links = [], [0]
    for node in nodes:
        assigned[id(node)] = slot
        text_of(node, parts, False, links)
        parts.append(" ")
    whole = " ".join("".join(parts).split())
    mark = zlib.crc32(whole.encode("utf-8", "surrogatepass"))
    slot.same &= slot.text is None or slot.text == mark
    slot.text = mark
    slot.chars += len(whole)
    slot.linked += links[0]
    pairs = {j: i for i, j in aligned([outline(c) for c in slot.children], below, matching)}
    kept, at = list(slot.children), 0
    for j, child in enumerate(below):
        if j in pairs:
            own = slot.children[pairs[j]]
            at = kept.index(own) + 1
        else:
            first = child[1][0]
            own = Slot(child[0], first.tag, first.words)
            kept.insert(at, own)
            at += 1
        merge(own, child, assigned)
    slot.children = kept


def other(slot: Slot, inside: bool) -> bool:
    """Whether a slot is a menu, notice, advert or the like by its element, its names or its links."""
    if slot.tag in ASIDE or (slot.tag == "header" and not inside):
        return True
    return bool(slot.words & OTHER) and slot.tag not in WHOLE and not slot.most and not (slot.words & LIKELY and slot.tag in MAIN)


def mark_most(root: Slot) -> None:
    """Marks the slots that hold most of the varying text without links, counted before any is excluded by name; of pages that do not vary, most of all text."""
    sizes: dict[int, int] = {}

    def size(slot: Slot, varying: bool) -> int:
        own = 0 if varying and slot.same and slot.pages >= ALIKE else max(0, slot.chars - slot.linked)
        sizes[id(slot)] = own + sum(size(c, varying) for c in slot.children)
        return sizes[id(slot)]

    def mark(slot: Slot) -> None:
        for c in slot.children:
            if 2 * sizes[id(c)] > whole:
                c.most = True
                mark(c)

    whole = size(root, True) or size(root, False)
    mark(root)


def mass(slot: Slot, inside: bool = False) -> int:
    """Characters of varying text below a slot that no link holds and nothing marks as other than the article."""
    if other(slot, inside):
        return 0
    own = 0 if slot.same and slot.pages >= ALIKE else max(0, slot.chars - slot.linked)
    return own + sum(mass(c, inside or slot.tag in MAIN) for c in slot.children)


def region(root: Slot) -> list[Slot]:
    """The slots that hold the article.

    What varies leads: from the root down, the slot that holds most of the
    varying text takes its parent's place.  Elements and names only tell how far
    up or down of there the article reaches.
    """
    total, path = mass(root), [root]
    while path[-1].children:
        heavy = max(path[-1].children, key=mass)
        if not total or mass(heavy) < MOST_OF_TEXT * mass(path[-1]) or heavy.tag in TEXTUAL:
            break
        path.append(heavy)
    if whole := [s for s in path if s.tag == "article"]:
        return whole[:1]
    articles: list[Slot] = []

    def look(slot: Slot) -> None:
        if other(slot, False):
            return
        if slot.tag == "article":
            articles.append(slot)
        else:
            for c in slot.children:
                look(c)

    look(path[-1])
    if articles and sum(map(mass, articles)) >= 0.3 * total:
        return articles
    named = [s for s in path if s.words & LIKELY and s.tag not in ("html", "body") and mass(s) >= 0.5 * total]
    return named[-1:] or path[-1:]


def marked(root: Slot, different: int) -> dict[int, bool]:
    """For each slot, by identity, whether its own text is content.  different: pages of the group that differ as a whole."""
    content: dict[int, bool] = {}
    chosen = {id(s) for s in region(root)}

    def walk(slot: Slot, inside: bool) -> None:
        if other(slot, inside):
            return
        inside = inside or id(slot) in chosen
        template = slot.same and not slot.repeated and slot.pages >= ALIKE and different >= ALIKE and 2 * different >= slot.pages
        menu = slot.tag == "li" and slot.chars and slot.linked >= LINKED * slot.chars
        content[id(slot)] = inside and not template and not menu
        for c in slot.children:
            walk(c, inside)

    walk(root, id(root) in chosen)
    return content


def written(node: Node, assigned: dict[int, Slot], content: dict[int, bool], out: list[str], keep: bool) -> None:
    """Adds a node's text to out, blocks apart from one another, leaving out what is no content."""
    slot = assigned.get(id(node))
    if slot is not None:
        if id(slot) not in content:
            return
        keep = content[id(slot)]
    for c in node.children:
        if isinstance(c, str):
            if keep:
                out.append(c)
        elif c.tag == "br":
            out.append("\n")
        elif c.tag in SILENT or c.gone:
            continue
        elif c.tag in INLINE:
            if not c.words & OTHER:
                written(c, assigned, content, out, keep)
        else:
            out.append("\n")
            written(c, assigned, content, out, keep)
            out.append("\n")


def own_words(node: Node, assigned: dict[int, Slot], whole: bool = False) -> list[str]:
    """The words of a page's nodes whose text varies between the pages, or of all its nodes."""
    slot, out = assigned.get(id(node)), []
    if slot is not None and (whole or not slot.same or slot.pages < ALIKE):
        parts: list[str] = []
        text_of(node, parts)
        out = "".join(parts).split()

    def below(x: Node) -> None:
        for c in x.children:
            if isinstance(c, str) or c.tag in SILENT or c.gone:
                continue
            if id(c) in assigned:
                out.extend(own_words(c, assigned, whole))
            else:
                below(c)

    below(node)
    return out


def fresh(pages: list[list[str]]) -> int:
    """How many of the pages, by their words, differ as a whole: near copies share the run of three words of least hash in most places and count once."""
    seen = set()
    for words in pages:
        runs = {" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))}
        seen.add(min(zlib.crc32(r.encode("utf-8", "surrogatepass")) for r in runs))
    return len(seen)


def differing(trees: list[Node], assigned: list[dict[int, Slot]]) -> int:
    """How many pages differ as a whole, by what varies; where that is but a few words, such as a date, by all words."""
    own = [own_words(t, a) for t, a in zip(trees, assigned, strict=True)]
    if sorted(map(len, own))[len(own) // 2] < FEW:
        own = [own_words(t, a, True) for t, a in zip(trees, assigned, strict=True)]
    return fresh(own)


def extracted(pages: list[str]) -> list[str]:
    """The main texts of pages of one host, by the wrapper that all of them make."""
    trees = [opened(parsed(p)) for p in pages]
    root = Slot("root", "root", frozenset())
    assigned: list[dict[int, Slot]] = []
    for tree in trees:
        own: dict[int, Slot] = {}
        merge(root, ("root", [tree], skeleton([tree])), own)
        assigned.append(own)
    mark_most(root)
    content = marked(root, differing(trees, assigned) if any_alike(root) else len(pages))
    texts = []
    for tree, own in zip(trees, assigned, strict=True):
        out: list[str] = []
        written(tree, own, content, out, False)
        texts.append(" ".join(unescape("".join(out)).split()))
    return texts


def any_alike(slot: Slot) -> bool:
    return (slot.same and slot.chars > 0 and slot.pages >= ALIKE) or any(map(any_alike, slot.children))


def main_text(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", name: str = "text", group: int = GROUP) -> DataFrame:
    """A row for each row of pages: its id and url, and the main text of its whole html (empty if there is none).

    Null html counts as empty.  The pages of each host are counted and dealt by
    hashed id into balanced groups of about `group` pages at most, so a large
    host is spread over many tasks; groups are the same for any partitioning.
    A group of many bytes is cut into parts of ALIKE pages at least.  Null and odd urls make a host of their own.  Equal rows are
    aligned like any others and get equal texts.  Further columns of pages are
    not read.  Ids may repeat or be null.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url).cast("string").alias("url"), whole_text(html).alias("html"), host.alias("host"))
    rows = rows.withColumn("h", F.xxhash64("page_id", "url"))
    # At most one row for every `group` pages: only hosts of several groups.
    groups = saved(rows.groupBy("host").agg(F.ceil(F.count("*") / group).alias("groups")).where("groups > 1"))
    part = F.pmod(F.xxhash64("h", F.lit("group")), F.coalesce("groups", F.lit(1).cast("long")))
    rows = rows.join(F.broadcast(groups), "host", "left").withColumn("part", part).drop("groups")
    dealt = rows.repartition("host", "part").sortWithinPartitions("host", "part", "h", "page_id", F.xxhash64("html"))
    kind = pages.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(parts: list[pd.DataFrame]) -> pd.DataFrame:
            rows = pd.concat(parts, ignore_index=True)
            return pd.DataFrame({"page_id": rows["page_id"], "url": rows["url"], name: extracted(rows["html"].tolist())})

        before: list[pd.DataFrame] = []  # a full part of the same group, which a rest of too few pages joins
        parts: list[pd.DataFrame] = []
        current, count, chars = None, 0, 0
        for frame in batches:
            keys = list(zip(frame["host"].tolist(), frame["part"].tolist(), strict=True))
            lo = 0
            for k, (key, n) in enumerate(zip(keys, frame["html"].str.len().tolist(), strict=True)):
                if key != current or (chars >= GROUP_CHARS and count >= ALIKE):
                    if k > lo:
                        parts.append(frame.iloc[lo:k])
                    if before and count < ALIKE:
                        parts, before = before + parts, []
                    if before:
                        yield done(before)
                    before = parts
                    if key != current and before:
                        yield done(before)
                        before = []
                    parts, lo, current, count, chars = [], k, key, 0, 0
                count, chars = count + 1, chars + n
            if len(frame) > lo:
                parts.append(frame.iloc[lo:])
        if before and count < ALIKE:
            parts, before = before + parts, []
        for rest in (before, parts):
            if rest:
                yield done(rest)

    return dealt.mapInPandas(run, f"page_id {kind}, url string, {name} string")
