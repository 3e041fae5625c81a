"""Main text of web pages by wrappers inferred per host.

The pages of a host are token streams of tags and text.  Aligning them one after
another yields a union-free expression: a sequence of tags, literals and text slots in
which a part that some stream lacks is optional and a part that repeats is a repeated
group, never an alternative.  Streams are nested by their tags first, so that an
alignment is one of sibling lists: equal labels are matched in their longest common
order and aligned inside, the rest becomes optional, and equal neighbours fold into one
repeated group.  A text is a literal until it is aligned with another one, then a slot.

A page's text is read along its host's wrapper.  What fills a slot is text, wherever it
lies.  The region of the article is the smallest node of the wrapper that holds two
thirds of the words of all slots.  Literals outside it are template and fall out; they
count only where they were aligned on ``DISTINCT`` different pages and on half of the
host's.  What lies in the region, in an article or in a main element stays, also if it
is equal on all pages.

Menus, headers, footers, sidebars, notices, adverts, forms and comments are known
beforehand, by tags, roles, hidden parts and class names, and hold neither region nor
text; but class names do not hide an article or main element, a page's only text, or a
part whose slots have more words than all others of the host on ``DISTINCT`` of its
pages, and a form around the only article or text of a page is no form.  Of an article's
own header the headings and paragraphs are kept.

Simplified: labels are tag, role and one of 251 signatures of class names; wrappers are
aligned in the order in which they come, pairwise; lists of more than ``MOST_SIBLINGS``
different neighbours lose their order; a page with nothing but literals keeps them.

Every page takes part.  Tasks merge the pages they read into one wrapper per
host, and only those travel, so a host with a third of all pages is as many
small rows as tasks.  The size of a wrapper has a bound that does not grow with the
pages; of a host's wrapper, extraction needs the literals outside the region alone.

Cases: null and empty html give empty text; a page without a host shares the
wrapper of the empty host; unclosed and stray tags are tolerated; nesting beyond
``DEPTH`` is laid flat, its text is kept and its end tags match; a quote opens a value
only after "="; svg, math and object are elements, and an HTML block ends an open
drawing; repeated rows each get their result; pages of any length are read whole.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from deskgauge.llm import common

DEPTH = 48
MOST_SIBLINGS = 64
DISTINCT = 3
MOST_HELD = 1000  # hosts a task merges before it hands their wrappers on
BROADCAST_BYTES = 16_000_000

# Elements and words that mark a part of a page.
RAW = frozenset("script style noscript template iframe textarea title".split())
FOREIGN = frozenset("svg math object".split())
DRAWN = frozenset("text desc metadata".split())  # parts of a drawing, inside svg alone
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby "
    "rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()) | FOREIGN
KNOWN = INLINE | VOID | frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog div dl "
    "dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend "
    "li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th "
    "thead tr ul video audio".split())
CHROME = frozenset(
    "nav header footer aside form head button select canvas dialog menu video audio fieldset".split())
CHROME_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar "
    "form toolbar status".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav "
    "navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar sidebars aside "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup login paywall share sharing social related recommended "
    "recommendations trending widget widgets toolbar pagination pager comment comments reply "
    "replies respond disqus discussion copyright legal disclaimer hidden skip".split())
BESIDE_WORDS = frozenset(
    "area bar block bottom box button buttons container fixed global header inner item items left "
    "link links list page primary right row secondary section site thread title top wrap wrapper"
    .split())
MAIN_WORDS = frozenset("article main content post entry story maincontent articlebody".split())
CLOSES = {
    "p": frozenset(("p",)), "li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")),
    "dd": frozenset(("dt", "dd", "p")), "tr": frozenset(("tr", "td", "th", "p")),
    "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")),
    "option": frozenset(("option",)),
}
BLOCKS_CLOSE_P = KNOWN - INLINE - VOID - frozenset(CLOSES)
SCOPES = frozenset("article section main div body html ul ol dl table tr td th form nav header "
                   "footer aside blockquote".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)"
    r"(?P<attrs>(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>"
    r"|<(?P<loose>/?[a-zA-Z][^\s/>]*)[^>]*>", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _named(names: set[str]) -> str:
    """"~" if class names say that a part is no article, "+" that it is, else "".

    A name says so if all its words do, or stand for a place or a box: not
    "comments-open", "with-sidebar" or "related-work".  Beside another name that
    is one for an article, as in "content hidden", it does not count.
    """
    chrome = main = False
    for name in names:
        words = {w.lower() for w in _WORD.findall(name)}
        if words & CHROME_WORDS:
            chrome |= words <= CHROME_WORDS | BESIDE_WORDS | MAIN_WORDS
        else:
            main |= bool(words & MAIN_WORDS)
    return "+" if main else "~" if chrome else ""


def _role(tag: str, attrs: str) -> str:
    """"-" for a part that is not the article, "~" for one that is not by its class
    names alone, "+" for the article, else ""."""
    if tag in ("html", "body"):
        return ""
    names, roles, hidden = set(), set(), False
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style":
            hidden |= "display:none" in value.lower().replace(" ", "")
        elif name == "role":
            roles.update(value.lower().split())
        elif name in ("class", "id", "itemprop"):
            names.update(value.split())
    if hidden:
        return "-"
    if tag in ("article", "main") or "main" in roles:
        return "+"
    if tag in CHROME or roles & CHROME_ROLES:
        return "-"
    return _named(names)


_CLASS = re.compile(r"\b(?:class|id)\s*=\s*[\"']?([^\"'>]*)", re.I)


def _signature(attrs: str) -> str:
    """Class names without their numbers, as one of 251 marks."""
    names = sorted({re.sub(r"\d+", "", n) for v in _CLASS.findall(attrs) for n in v.split()})
    return f".{zlib.crc32(' '.join(names).encode()) % 251}" if names else ""


class Node:
    """An element: label, children and text pieces in order."""

    __slots__ = ("label", "sign", "kids")

    def __init__(self, label: str, sign: str = ""):
        self.label = label
        self.sign = sign
        self.kids: list = []


def parse(source: str) -> Node:
    """The element tree of a page; text pieces are strings among the children."""
    root = Node("")
    stack, tags = [root], [""]
    opened: Counter = Counter()
    at, end = 0, len(source)

    def text(piece: str) -> None:
        if piece:
            stack[-1].kids.append(entities.unescape(piece) if "&" in piece else piece)

    def close_to(depth: int) -> None:
        opened.subtract(tags[depth:])
        if len(stack) > DEPTH:
            stack[depth - 1].kids.append(Node("br"))
        del stack[depth:], tags[depth:]

    while at < end:
        token = _TOKEN.search(source, at)
        if token is None:
            text(source[at:])
            break
        text(source[at:token.start()])
        at = token.end()
        tag = token["open"]
        attrs = token["attrs"] or ""
        closing = token["close"]
        if token["loose"]:
            closing, tag = ((token["loose"][1:], None) if token["loose"][0] == "/"
                            else (None, token["loose"]))
        if closing:
            closing = closing.lower()
            if opened[closing] > 0:
                for depth in range(len(tags) - 1, 0, -1):
                    if tags[depth] == closing:
                        close_to(depth)
                        break
                    if tags[depth] in SCOPES and closing in INLINE:
                        break
            elif closing in ("p", "br"):
                stack[-1].kids.append(Node("br"))
        elif tag:
            tag = tag.lower()
            if opened["svg"] > 0 or opened["math"] > 0:
                if tag in KNOWN - FOREIGN - {"a"}:  # HTML ends a drawing or formula
                    close_to(next(d for d, t in enumerate(tags) if t in ("svg", "math")))
            drawing = opened["svg"] > 0
            if tag in RAW:
                if drawing and attrs.endswith("/"):
                    continue
                found = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(source, at)
                at = found.end() if found else end
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    stack[-1].kids.append(Node("br"))
                continue
            ends = CLOSES.get(tag) or (CLOSES["p"] if tag in BLOCKS_CLOSE_P else None)
            if ends and any(opened[e] > 0 for e in ends):
                for depth in range(len(tags) - 1, 0, -1):
                    if tags[depth] in ends:
                        close_to(depth)
                        if tag not in ("tr", "td", "th", "li", "dt", "dd"):
                            break
                    elif tags[depth] in SCOPES and tags[depth] not in ends:
                        break
            if attrs.endswith("/") and (tag not in KNOWN or tag in FOREIGN):
                continue
            role = "-" if drawing and tag in DRAWN else _role(tag, attrs)
            sign = _signature(attrs) if attrs and tag not in INLINE else ""
            node = Node((tag if tag in KNOWN else "x") + role, sign)
            if len(stack) >= DEPTH:  # laid flat; only what is no article is kept apart
                if tag in INLINE and role != "-":
                    continue
                if role != "-" or stack[-1].label.endswith("-"):
                    stack[-1].kids.append(Node("br"))
                    node = stack[-1]
            if node is not stack[-1]:
                stack[-1].kids.append(node)
            stack.append(node)
            tags.append(tag)
            opened[tag] += 1
    _open_forms(root)
    _settle(root)
    return root


_FORMS = ("form-", "fieldset-")


def _open_forms(root: Node) -> None:
    """A form around an article, or around all text of a page, is part of the page."""
    def has_article(node: Node) -> bool:
        return any(
            isinstance(kid, Node) and (
                kid.label.endswith("+") or not kid.label.endswith("-") and has_article(kid))
            for kid in node.kids)

    def has_text(node: Node) -> bool:
        return any(
            not kid.isspace() if isinstance(kid, str)
            else not kid.label.endswith(("-", "~")) and has_text(kid) for kid in node.kids)

    def forms(node: Node, found: list[Node]) -> list[Node]:
        for kid in node.kids:
            if isinstance(kid, Node) and (kid.label in _FORMS or not kid.label.endswith("-")):
                forms(kid, found)
                if kid.label in _FORMS:
                    found.append(kid)
        return found

    known = forms(root, [])
    if known:
        alone = not has_text(root)
        for node in known:
            if has_article(node) or alone:
                node.label = node.label[:-1]


def _settle(root: Node) -> None:
    """Class names do not hide the main element, a page's only articles, or all its text."""
    below: list[tuple[Node, ...]] = []
    found = {"main": False, "article": False, "text": False}

    def look(node: Node, named: tuple[Node, ...]) -> None:
        for kid in node.kids:
            if isinstance(kid, str):
                found["text"] |= not named and not kid.isspace()
            elif not kid.label.endswith("-"):
                above = (*named, kid) if kid.label.endswith("~") else named
                if kid.label.startswith(("article", "main")):
                    found["article"] |= not above
                if above:
                    below.append((kid, *above))
                look(kid, above)

    look(root, ())
    for kid, *above in below:
        lifted = (not found["text"] or kid.label.startswith("main")
                  or kid.label.startswith("article") and not found["article"])
        if lifted:
            for node in above:
                node.label = node.label.rstrip("~")


# ------------------------------------------------------------------------ wrappers
#
# A wrapper node is a list: label, optional, repeated, pages, words, children.  The
# label "#" is text: a literal while it has its hash, and with hashes of the least
# ``DISTINCT`` pages that have it in place of children.

LABEL, OPTIONAL, REPEATED, PAGES, WORDS, KIDS, LITERAL = range(7)


def _hash(text: str) -> str:
    return f"{xxhash.xxh64_intdigest(text):x}"


def _folded(kids: list) -> list:
    """Equal neighbours become one repeated group; very long lists one per label."""
    out: list = []
    for kid in kids:
        if out and out[-1][LABEL] == kid[LABEL]:
            out[-1] = _aligned(out[-1], kid, one_page=True)
            out[-1][REPEATED] = True
        else:
            out.append(kid)
    if len(out) > MOST_SIBLINGS:
        first: dict[str, list] = {}
        for kid in out:
            if kid[LABEL] in first:
                first[kid[LABEL]] = _aligned(first[kid[LABEL]], kid, one_page=True)
                first[kid[LABEL]][REPEATED] = True
            else:
                first[kid[LABEL]] = kid
        out = list(first.values())
    return out


def page_wrapper(node: Node, page: str | None = None) -> list:
    """The wrapper of one page alone."""
    if page is None:
        page = _hash("\n".join(words for _, words in runs(node)))
    kids = []
    for kid in node.kids:
        if isinstance(kid, str):
            words = kid.split()
            if words:
                kids.append(["#", False, False, 1, len(words), [page], _hash(" ".join(words))])
        elif kid.label != "br":
            kids.append(page_wrapper(kid, page))
    kids = _folded(kids)
    words = 0 if node.label.endswith(("-", "~")) else sum(k[WORDS] for k in kids)
    return [node.label + node.sign, False, False, 1, words, kids]


def _aligned(a: list, b: list, one_page: bool = False) -> list:
    """Union-free generalisation of two wrappers with one label."""
    left, right = a[KIDS], b[KIDS]
    pages = max(a[PAGES], b[PAGES]) if one_page else a[PAGES] + b[PAGES]
    whole = [a[LABEL], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], pages,
             a[WORDS] + b[WORDS]]
    if a[LABEL] == "#":  # texts that differ are a slot
        same = a[LITERAL] if a[LITERAL] == b[LITERAL] and not one_page else None
        return [*whole, sorted({*left, *right})[:DISTINCT], same]
    if [k[LABEL] for k in left] == [k[LABEL] for k in right]:
        return [*whole, [_aligned(x, y, one_page) for x, y in zip(left, right)]]
    return [*whole, _folded(_common_order(left, right, one_page))]


def _common_order(left: list, right: list, one_page: bool) -> list:
    """Matches of the longest common order; what only one side has is optional."""
    n, m = len(left), len(right)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = (below[j + 1] + 1 if left[i][LABEL] == right[j][LABEL]
                      else max(below[j], row[j + 1]))
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and left[i][LABEL] == right[j][LABEL]:
            out.append(_aligned(left[i], right[j], one_page))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([left[i][0], True, *left[i][2:]])
            i += 1
        else:
            out.append([right[j][0], True, *right[j][2:]])
            j += 1
    return out


def expression(wrapper: list) -> str:
    """The wrapper as a union-free regular expression."""
    label = wrapper[LABEL]
    inner = "" if label == "#" else "".join(expression(k) for k in wrapper[KIDS])
    body = "#" if label == "#" else f"<{label}>{inner}</{label}>" if label else inner
    mark = ("*" if wrapper[REPEATED] else "?") if wrapper[OPTIONAL] else "+" if wrapper[REPEATED] else ""
    return f"({body}){mark}" if mark else body


def _is_literal(text: list, pages: int) -> bool:
    """Whether a text of a host with so many pages is template."""
    return (text[LITERAL] is not None and len(text[KIDS]) >= DISTINCT
            and 2 * text[PAGES] >= pages)


def _plain(label: str) -> str:
    return label.partition(".")[0]


def slot_words(node: list, pages: int) -> int:
    """Words of the slots below a node, but of parts that are no article."""
    if node[LABEL] == "#":
        return 0 if _is_literal(node, pages) else node[WORDS]
    if _plain(node[LABEL]).endswith(("-", "~")):
        return 0
    return sum(slot_words(kid, pages) for kid in node[KIDS])


def main_path(wrapper: list) -> list[str]:
    """Labels from the root to the smallest node with two thirds of all slots' words."""
    node, path = wrapper, []
    least = 2 * slot_words(wrapper, wrapper[PAGES])
    while True:
        inner = [k for k in node[KIDS] if 3 * slot_words(k, wrapper[PAGES]) >= max(least, 1)]
        if len(inner) != 1 or inner[0][LABEL] == "#" or inner[0][REPEATED]:
            return path
        node = inner[0]
        path.append(node[LABEL])


def _kept_parts(wrapper: list) -> list[str]:
    """Parts that are no article by their class names, but whose slots have more words
    than all others, on ``DISTINCT`` pages."""
    words: Counter = Counter()
    names: dict[str, set] = {}

    def look(node: list, path: str, part: str) -> None:
        for kid in node[KIDS]:
            if kid[LABEL] == "#":
                if not _is_literal(kid, wrapper[PAGES]):
                    words[part] += kid[WORDS]
                names.setdefault(part, set()).update(kid[KIDS])
            elif not _plain(kid[LABEL]).endswith("-"):
                below = _path_below(path, _plain(kid[LABEL]))
                look(kid, below, part or (below if below.endswith("~") else ""))

    look(wrapper, "", "")
    return sorted(p for p, n in words.items()
                  if p and n > words[""] and len(names[p]) >= DISTINCT)


def _path_below(path: str, label: str) -> str:
    return path if label.rstrip("+") in INLINE else f"{path}/{label}"


def _template(node: list, region: list[str] | None, pages: int) -> list | None:
    """[label, kids, text hash, whether the region] of a node with literals outside the
    region below it; of other nodes the label, for their place among their siblings."""
    if node[LABEL] == "#":
        return ["#", [], node[LITERAL] if _is_literal(node, pages) else None, False]
    if _plain(node[LABEL]).endswith("-"):
        return [node[LABEL], [], None, False]
    if region == []:
        return [node[LABEL], [], None, True]
    inner = max((k for k in node[KIDS] if region and k[LABEL] == region[0]),
                key=lambda k: slot_words(k, pages), default=None)
    kids = [_template(kid, region[1:] if kid is inner else None, pages) for kid in node[KIDS]]
    told = any(k[1] or k[2] or k[3] for k in kids)
    return [node[LABEL], kids if told else [], None, False]


def host_final(wrapper: list) -> str:
    """What extraction needs of a host's wrapper, as JSON."""
    region = main_path(wrapper)
    return json.dumps({"keep": _kept_parts(wrapper),
                       "template": _template(wrapper, region, wrapper[PAGES])})


# ---------------------------------------------------------------------- extraction

class _Reader:
    """Follows a template along a page: which of its nodes stands where."""

    def __init__(self, template: list | None):
        self.kids = template[1] if template else []
        self.region = bool(template and template[3])
        self.at = 0

    def next(self, label: str) -> list | None:
        """The template's node for the next child of this label, in order if possible."""
        for at in (*range(self.at, len(self.kids)), *range(self.at)):
            if self.kids[at][0] == label:
                self.at = at
                return self.kids[at]
        return None


def runs(root: Node, template: list | None = None) -> list[tuple[str, str]]:
    """Path of labels and text of each block of a page, but of "-" parts and of the
    template's literals outside its region and outside articles."""
    out: list[tuple[str, str]] = []
    held: list[str] = []

    def flush(path: str) -> None:
        words = " ".join("".join(held).split())
        held.clear()
        if words:
            out.append((path, words))

    def block(node: Node, path: str, above: str, place: list | None, inside: bool) -> None:
        flush(above)
        walk(node, path, place, inside)
        flush(path)

    def walk(node: Node, path: str, place: list | None, inside: bool) -> None:
        reader = _Reader(place)
        inside = inside or reader.region or node.label.startswith(("article", "main"))
        for kid in node.kids:
            if isinstance(kid, str):
                if reader.kids and not inside and not kid.isspace():
                    text = reader.next("#")
                    if text and text[2] and text[2] == _hash(" ".join(kid.split())):
                        held.append(" ")
                        continue
                held.append(kid)
                continue
            label = kid.label
            below = reader.next(label + kid.sign) if reader.kids and label != "br" else None
            if label == "header-" and node.label.startswith(("article", "main")):
                for part in kid.kids:  # the title and the lead of the article itself
                    if isinstance(part, Node) and re.fullmatch(r"h[1-6]|p|hgroup", part.label):
                        block(part, f"{path}/{label}/{part.label}", path, None, True)
            elif label == "br" or label.endswith("-"):
                held.append(" ")
            elif label.endswith("~"):
                block(kid, f"{path}/{label}", path, below, inside)
            elif label.rstrip("+") in INLINE:
                walk(kid, path, below, inside)
            else:
                block(kid, f"{path}/{label}", path, below, inside)

    block(root, "", "", template, False)
    return out


def _named_part(path: str) -> str:
    """The path as far as the outermost part that is no article by its class names."""
    at = f"{path}/".find("~/")
    return path[:at + 1] if at >= 0 else ""


@lru_cache(256)
def _host(raw: str) -> tuple[frozenset, list | None]:
    host = json.loads(raw)
    return frozenset(host["keep"]), host["template"]


def extract(source: str, host: str | None = None) -> str:
    """Main text of a page: its blocks but the parts that are not the article and
    the literals of its host, unless it has nothing else."""
    keep, template = _host(host) if host else (frozenset(), None)
    page = parse(source)

    def words(template: list | None) -> list[str]:
        return [words for path, words in runs(page, template)
                if not (part := _named_part(path)) or part in keep]

    return " ".join(words(template) or words(None))


def host_of(url: str | None) -> str:
    found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def wrappers(pages: DataFrame) -> DataFrame:
    """``host``, its ``wrapper`` (as JSON), ``expression``, ``main`` path and ``parts``."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for batch in batches:
            for url, source in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                host, own = host_of(url), page_wrapper(parse(source or ""))
                at = found.get(host)
                found[host] = own if at is None else _aligned(at, own)
                if len(found) > MOST_HELD:  # hand on and start again
                    yield _rows(found)
                    found = {}
        yield _rows(found)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            for host, raw in zip(*(c.to_pylist() for c in batch.columns)):
                own = json.loads(raw)
                if host != at:
                    if held is not None:
                        yield _final(at, held)
                    at, held = host, own
                else:
                    held = _aligned(held, own)
        if held is not None:
            yield _final(at, held)

    return (
        pages.select(F.col("url").cast("string"), F.col("html").cast("string"))
        .mapInArrow(partial, "host string, wrapper string")
        .repartition("host").sortWithinPartitions("host", "wrapper")
        .mapInArrow(whole, "host string, wrapper string, expression string, main string, "
                           "parts string")
    )


def _rows(found: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.string()),
         pa.array([json.dumps(v) for v in found.values()], pa.string())], ["host", "wrapper"])


def _final(host: str, wrapper: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([v], pa.string()) for v in
         (host, json.dumps(wrapper), expression(wrapper), "/".join(main_path(wrapper)),
          host_final(wrapper))],
        ["host", "wrapper", "expression", "main", "parts"])


RESULT = "page_id bigint, url string, text string, n_chars bigint"


def main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``page_id``, ``url``, main ``text`` and its length of every page.

    What is known of the hosts is broadcast if it is smaller than ``broadcast_bytes``;
    beyond that the pages are joined with it by host, which adaptive execution splits
    where a host is large.
    """
    folder = common.scratch(pages.sparkSession)
    hosts = common.stored(wrappers(pages).select("host", "parts"), folder, "wrappers")
    size = hosts.agg(F.coalesce(F.sum(F.length("host") + F.length("parts")), F.lit(0))).first()[0]
    rows = pages.select(
        F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"),
        F.lower(F.regexp_extract(
            F.coalesce(F.col("url").cast("string"), F.lit("")),
            r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"))
    if size < broadcast_bytes:
        hosts = F.broadcast(hosts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h or "", m) for h, m in
                     zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return (rows.join(hosts, "host", "left").select("page_id", "url", "html", "parts")
            .mapInArrow(run, RESULT))
