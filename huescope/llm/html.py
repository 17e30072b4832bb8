"""Main text of web pages by a minimum cut over their blocks.

A page's markup becomes blocks: texts between tags that start or end a block, with the containers they stand in.
A small linear classifier (length, sentence marks, share of linked text, telling tags and names of containers; its weights are fixed, as no labelled pages are at hand) gives
each block log odds as its cost for either label; the costs are the capacities to the two terminals. Neighbours in page order are joined by
an edge whose capacity falls with their distance in the page's tree, and so are blocks that follow each other in one container. The
minimum cut, by augmenting paths, separates content from boilerplate. Names deceive: those that speak both ways say nothing, and
where nothing would be left those of the containers that hold most of the page are passed over. Before the cut, blocks whose own cost outweighs all their
edges take their label (no minimum cut has another) and pass their edges' weight on to their neighbours; few are left.

A null or empty page, or one without content, gives an empty text. Character references are decoded, also those without a
semicolon; unfinished tags at the end are markup. Raw text (scripts, styles, titles, form fields) is never content, nor is what stands in silent elements
(buttons, drawings, players); these end with their parent at the latest, and one that has no end tag of its own is left out as a tag only. Formulas are text. Repeated rows
are judged alike, on a tie of both costs a block is boilerplate, very long pages are read whole, null urls and ids are carried as they are, other columns are left; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose text is no text of the page.
RAW = ("script", "style", "title", "textarea", "noscript", "iframe")
#: Elements with markup in them whose text is no text of the page.
SILENT = ("template", "object", "select", "svg", "button", "canvas", "audio", "video", "annotation", "annotation-xml")
#: Elements that start and end a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and words of names that tell, with their weights.
ELEMENTS = {"nav": -8.0, "footer": -8.0, "aside": -8.0, "form": -8.0, "menu": -8.0, "dialog": -8.0, "search": -8.0, "fieldset": -8.0, "head": -20.0, "header": -4.0, "article": 5.0, "main": 4.0, "h1": 1.0, "p": 1.0, "blockquote": 0.5, "pre": 0.5, "li": -0.5}
AGAINST = frozenset(
    "ad ads adv advert advertisement advertising advertorial banner banners breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup privacy promo promoted promotion recommended related replies reply respond search share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription tags toc toolbar topbar widget widgets"
    " anzeige anzeigen fusszeile kommentare kopfzeile seitenleiste werbung commentaires entete partager pied publicite anuncio anuncios cabecera comentarios compartir publicidad commenti condividi pubblicita".split()
)
IN_FAVOUR = frozenset("article articlebody body content entry main maincontent post story text".split())
ADJACENT, SIBLING, BOUND = 1.5, 1.0, 2.0
ENDS = ".!?:\"'”»…"
PROOF = 400  # characters of sentences outside links that a container must hold before its name is doubted

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def hint(tag: str, attributes: str, doubted: bool = False) -> float:
    """What an element says of the blocks in it.

    Its names count against it once, however many do; names that speak both ways say nothing, and against main and article names alone don't
    outweigh the element. doubted: its names, but not whether it is hidden, are passed over.
    """
    weight, names = ELEMENTS.get(tag, 0.0), 0.0
    if not attributes or tag in ("html", "body"):
        return weight
    for name, a, b, c in _NAMED.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("hidden", "aria-hidden"):
            if name == "hidden" or value.lower() == "true":
                weight -= 8.0
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                weight -= 8.0
        elif not doubted:
            parts = {p.lower() for p in _PART.findall(value)}
            against, favour = bool(parts & AGAINST), bool(parts & IN_FAVOUR) or value.lower() == "main"
            if against != favour:
                names += -8.0 if against else 3.0
    return weight + (max(names, -3.0) if tag in ("main", "article") else names)


def _parts(page: str) -> list[tuple[str, str, str, str]]:
    """(text before it, "/" or nothing, name, attributes) of each tag of a page; the last one is empty. Raw elements are left out with their text."""
    out, at, raw = [], 0, None
    while at < len(page):
        if raw:
            end = raw.search(page, at)
            if not end:
                break
            at, raw = end.end(), None
        found = _TAG.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if not found:
            out.append((text, "", "", ""))
            break
        at = found.end()
        shut, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        tag = (tag or "").lower()
        if tag in RAW:
            if not shut and not attributes.endswith("/"):
                raw = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I)
            tag = ""
        out.append((text, shut or "", tag, attributes or ""))
    return out


def _silent(parts: list[tuple[str, str, str, str]]) -> set[int]:
    """The places of start tags of silent elements that have an end tag."""
    opened: dict[str, list[int]] = {tag: [] for tag in SILENT}
    found = set()
    for i, (_, shut, tag, attributes) in enumerate(parts):
        if tag in opened:
            if shut:
                if opened[tag]:
                    found.add(opened[tag].pop())
            elif not attributes.endswith("/"):
                opened[tag].append(i)
    return found


def blocks(page: str, doubted: frozenset[int] | set[int] = frozenset()) -> tuple[list[tuple[str, int, float, int]], list[int], list[int]]:
    """((text, linked characters, hints' sum, container) of each block of a page that has text, each container's parent, its depth). doubted: containers whose names don't count."""
    out: list[tuple[str, int, float, int]] = []
    stack: list[tuple[str, float, int]] = [("", 0.0, 0)]
    parent, depth = [0], [0]
    held: list[tuple[str, bool]] = []
    link, quiet = 0, 0  # quiet: the outermost silent element's place on the stack

    def close() -> None:
        if held:
            text = " ".join(unescape("".join(x for x, _ in held)).split())
            if text:
                out.append((text, sum(len(x) for x, linked in held if linked), stack[-1][1], stack[-1][2]))
            held.clear()

    def cut(i: int) -> None:
        nonlocal quiet
        if quiet and i < quiet:
            del stack[quiet:]
            quiet = 0
            close()
        del stack[i:]

    def pop(tags, stop) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                cut(i)
                return
            if stack[i][0] in stop:
                return

    parts = _parts(page)
    silent = _silent(parts)
    for i, (text, shut, tag, attributes) in enumerate(parts):
        if text and not quiet:
            held.append((text, link > 0))
        if not tag:
            continue
        if tag == "a":
            link = 0 if shut else 1
        elif tag == "br" and not quiet:
            held.append((" ", False))
        elif tag in SILENT:
            if i in silent:
                stack.append((tag, *stack[-1][1:]))
                quiet = quiet or len(stack) - 1
            elif shut and quiet:
                last = next((j for j in range(len(stack) - 1, quiet - 1, -1) if stack[j][0] == tag), 0)
                if last:
                    del stack[last:]
                    quiet = quiet if last > quiet else 0
        elif tag in BLOCK:
            if not quiet:
                close()
                link = 0
            if shut:
                pop((tag,), ())
                continue
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                pop((tag,), ("ul", "ol", "dl", "table", "menu", "select"))
            elif tag in ("article", "main", "body", "footer"):
                pop(("nav", "p", "head"), ("article", "main", "div", "section"))
            if stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                cut(len(stack) - 1)
            if tag not in VOID:
                _, weight, inside = stack[-1]
                parent.append(inside)
                depth.append(depth[inside] + 1)
                own = hint(tag, attributes, len(parent) - 1 in doubted)
                if tag == "header" and weight > 0:  # of an article
                    own = max(own, 0.0)
                stack.append((tag, weight + own if tag != "head" else -20.0, len(parent) - 1))
        elif attributes and not shut and not quiet and re.search(r"hidden|display\s*:\s*none", attributes):
            held.append((" ", False))
    close()
    return out, parent, depth


def score(text: str, linked: int, hints: float) -> float:
    """The classifier's log odds of content; negative: of boilerplate. What the text itself says is BOUND at most, so that neighbours can outvote it;
    what names and elements say is not."""
    n = len(text)
    value = -0.5 + min(n, 400) / 100 + (0.5 if text[-1] in ENDS else 0.0) - 5.0 * min(1.0, linked / n)
    return max(-BOUND, min(BOUND, value)) + hints


def _edges(found: list, parent: list[int], depth: list[int]) -> list[tuple[int, int, float]]:
    edges, last = [], {}
    for i, (_, _, _, own) in enumerate(found):
        if i:
            x, y = found[i - 1][3], own
            far = depth[x] + depth[y] - 2
            while x != y:  # up to the container that holds both
                x, y = (parent[x], y) if depth[x] > depth[y] else (x, parent[y])
            edges.append((i - 1, i, ADJACENT / (1 + max(0, far - 2 * depth[x])) ** 2))
        around = parent[own]
        if around in last and last[around] != i - 1:
            edges.append((last[around], i, SIBLING))
        last[around] = i
    return edges


def minimum_cut(own: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labels (true: content) of a minimum cut: own[i] > 0 is the cost of labelling i false, -own[i] that of true."""
    n = len(own)
    own = list(own)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(own[i]) >= sum(near[i].values()):
            label[i] = own[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                if label[j] is None:
                    own[j] += w if label[i] else -w
                    queue.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if not left:
        return [bool(x) for x in label]
    source, sink = n, n + 1
    flow: dict[int, dict[int, float]] = {i: dict(near[i]) for i in left} | {source: {}, sink: {}}
    for i in left:
        if own[i] > 0:
            flow[source][i], flow[i][source] = own[i], 0.0
        elif own[i] < 0:
            flow[i][sink], flow[sink][i] = -own[i], 0.0
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            i = queue.popleft()
            for j, w in flow[i].items():
                if w > 1e-12 and j not in came:
                    came[j] = i
                    queue.append(j)
        if sink not in came:
            return [i in came if x is None else x for i, x in enumerate(label)]
        path, j = [], sink
        while j != source:
            path.append((came[j], j))
            j = came[j]
        push = min(flow[a][b] for a, b in path)
        for a, b in path:
            flow[a][b] -= push
            flow[b][a] = flow[b].get(a, 0.0) + push


def _holders(found: list, parent: list[int]) -> set[int]:
    """The containers, each within the next, that hold more than half of a page's text outside links, if that is PROOF characters of sentences at least."""
    free = [len(text) - linked for text, linked, _, _ in found]
    inside, proof = [0] * len(parent), [0] * len(parent)
    for (text, _, _, own), n in zip(found, free, strict=True):
        inside[own] += n
        proof[own] += n if text[-1] in ENDS else 0
    for i in range(len(parent) - 1, 0, -1):  # a container comes after the one that it is in
        inside[parent[i]] += inside[i]
        proof[parent[i]] += proof[i]
    return {i for i in range(len(parent)) if 2 * inside[i] > sum(free) and proof[i] >= PROOF}


def labelled(page: str) -> tuple[list, list[bool]]:
    """A page's blocks and which of them are content. Where the cut would leave nothing of it, names of the containers that hold most of the page aren't believed and it is cut once more."""
    doubted: set[int] = set()
    while True:
        found, parent, depth = blocks(page, doubted)
        content = minimum_cut([score(t, linked, h) for t, linked, h, _ in found], _edges(found, parent, depth))
        if any(content) or doubted:
            return found, content
        doubted = _holders(found, parent)
        if not doubted:
            return found, content


def main_text(page: str | None) -> str:
    """The content blocks of a page, a line each."""
    found, content = labelled(page or "")
    return "\n".join(t for (t, *_), kept in zip(found, content, strict=True) if kept)


def _extract(batches):
    for batch in batches:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of pages; each page stands alone, nothing is shuffled."""
    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kind['page_id']}, url string, text string, n_chars long")
