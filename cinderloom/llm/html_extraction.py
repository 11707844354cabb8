"""Main text of web pages by wrappers inferred from pages of one host.

A page's body is read as a stream of start tags, end tags and texts. A wrapper is a union-free regular
expression over such streams, kept as a tree: an element or a text slot, once, optional (?), repeated (+) or both (*), and what is
in it. Adjacent elements of one kind are folded into a repeated one as the page is read; a list of over 64 different neighbours
becomes a repeated group of optional elements. The wrappers of a host's pages are then aligned one after the other: what
matches stays, what only one side has becomes optional, what one side repeats becomes repeated, and texts that differ
become slots: a slot remembers the texts that all its pages have, which are the template's own.

The wrapper decides what is main text:

- texts that all pages with a slot have there belong to the template and go, if ``SUPPORT`` pages at least of the host differ
  and half of all have the slot (unless nothing were left, or less than half of an article, as on a host of near copies);
- a page's article elements hold its main text, else its main elements; else the region does: from the body down, the container that
  holds at least ``MOST`` of the characters in slots that vary and are no links. A page without that region gives all its text;
- elements that repeat and hold links alone are menus, outside articles;
- menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go by
  element, role or plain class words (``WORDS``). Doubtful class words (``DOUBTFUL``) only break ties: the element stays if its
  slots vary over the host and are no links for the most part, and goes otherwise.

Blocks are joined by one space, white space in them is one space, character references are decoded.

Null or empty html gives an empty text; so do pages without any text of that kind. Broken markup is read as far as it
goes, in time that grows with its length and without recursion: unclosed elements end with their parents, a tag without
an end is text. A null url is a host of its own. Repeated rows give repeated results, an empty table an empty result;
other columns are ignored.

Wrappers are made where the pages are read, one for each task and host, and joined in steps of at most ``FAN``, so a host
with a third of all pages is aligned in many tasks. A wrapper of over ``NODES`` elements and slots is handed on as rows, one for each of
them: nothing of it goes. Rows of a host are joined where they have the same place, the how manieth of its kind in the same parent, and decided as
trees are, for any number of them. The html itself is only moved if all hosts' decisions together have over ``SENT`` bytes; of a large
wrapper a page then gets what is decided of its own elements.
"""

from __future__ import annotations

import functools
import functools
import json
import re
from bisect import bisect_left
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Tables, cut, map_rows, table

SUPPORT, MOST, LONG, NODES, FAN, SENT = 5, 0.8, 64, 4096, 64, 32 << 20
#: Hosts and nodes that a task holds before it hands its wrappers on; nodes that it hands on together.
HELD_HOSTS, HELD_NODES, HELD_ROWS = 500, 200_000, 512
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|/|$)")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never part of an article.
ASIDE = frozenset("nav header footer aside form script style noscript template svg math iframe object button select option textarea dialog menu title head figure-controls audio video canvas map label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Class or id words of the same, and such as may also name content.
_WORD = r"(?:^|[\s_-])(?:%s)(?:$|[\s_-])"
WORDS = re.compile(_WORD % r"nav(?:bar|igation)?|menu|header|masthead|banner|footer|side(?:bar|bars)?|aside|ad|ads|adv|advert\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|popup|modal|overlay|newsletter|subscri\w*|comment\w*|disqus|replies|breadcrumb\w*|pagination|pager|login|signup|skip(?:link)?", re.I)
DOUBTFUL = re.compile(_WORD % r"alert\w*|responses|discussion|share|sharing|social|related|recommend\w*|toolbar|search\w*|widget\w*|toc|copyright|legal|tags|byline-links", re.I)
BLOCKS = frozenset("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that a region may be.
CONTAINERS = frozenset("html body div section center table tbody tr td main article".split())
#: Start tags that end an open element of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SPACE = re.compile(r"\s+")
SECTIONS = frozenset("table ul ol dl div article section main body".split())
_CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}

#: What holds for all that is in an element.
OUT, DOUBT, ARTICLE, MAIN, LINK, REGION, MENU = 1, 2, 4, 8, 16, 32, 64


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.strip().encode("utf-8", "surrogatepass"))


def path_hash(parent: int, kind: str) -> int:
    return xxhash.xxh64_intdigest(kind.encode("utf-8", "surrogatepass"), parent)


def attributes(text: str) -> dict[str, str]:
    found = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


def kind_of(name: str, attributes_text: str, flags: int) -> tuple[str, int]:
    """An element's kind: name, first class, role main, and ! or ~ if it is none of an article, or may be none; and its flags."""
    given = attributes(attributes_text) if "=" in attributes_text else {}
    if "hidden" in attributes_text and HIDDEN.search(ATTRIBUTE.sub(" ", attributes_text)):
        given["hidden"] = ""
    own = {"article": ARTICLE, "main": MAIN, "a": LINK}.get(name, 0)
    kind = name + "".join("." + x for x in given.get("class", "").split()[:1])
    if given.get("role") == "main":
        kind, own = kind + "@main", own | MAIN
    if name not in ("article", "main", "body", "html"):
        named = given.get("class", "") + " " + given.get("id", "")
        unseen = given and (given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", ""))
        if unseen or name in ASIDE and not (name == "header" and flags & ARTICLE) or named != " " and WORDS.search(named):
            kind, own = kind + "!", own | OUT
        elif named != " " and DOUBTFUL.search(named):
            kind, own = kind + "~", own | DOUBT
    return kind, own


def tokens(html: str):
    """(text, None, None) for texts, (name, attributes, False) for start tags, (name, None, True) for end tags."""
    at, n, plain = 0, len(html), False
    ahead = {">": -1, '"': -1, "'": -1}

    def next_of(char: str, start: int) -> int:
        """Its next place, ``n`` for none; looks through nothing twice."""
        if ahead[char] < start:
            found = html.find(char, start)
            ahead[char] = found if found >= 0 else n
        return ahead[char]

    while at < n:
        lo = html.find("<", at)
        while lo >= 0 and lo + 1 < n and not (html[lo + 1] in "!?" or NAME.match(html, lo + 1 + (html[lo + 1] == "/"))):
            lo = html.find("<", lo + 1)
        if lo < 0 or lo + 1 >= n:
            yield html[at:], None, None
            return
        if html[lo + 1] in "!?":
            if lo > at:
                yield html[at:lo], None, None
            end = "-->" if html.startswith("<!--", lo) else "]]>" if html.startswith("<![CDATA[", lo) else ">"
            hi = html.find(end, lo + 2)
            at = hi + len(end) if hi >= 0 else n
            continue
        closing = html[lo + 1] == "/"
        name = NAME.match(html, lo + 1 + closing)
        hi = name.end()
        while not plain:  # the end of the tag, outside quoted values
            stop = next_of(">", hi)
            quote = min(next_of('"', hi), next_of("'", hi))
            if quote >= stop:
                hi = stop
                break
            hi = quote + 1
            if html[max(name.end(), quote - 16) : quote].rstrip()[-1:] == "=":
                hi = next_of(html[quote], hi) + 1
                plain = hi > n
        if plain or hi >= n:
            plain = True  # from here on quotes mean nothing: what was looked through is not looked through again
            hi = html.find(">", name.end())
        if hi < 0:
            yield html[at:], None, None
            return
        if lo > at:
            yield html[at:lo], None, None
        at = hi + 1
        kind = name[0].lower()
        yield kind, None if closing else html[name.end() : hi], closing
        if not closing and kind in RAW:
            m = _CLOSING[kind].search(html, at)
            at = m.end() if m else n
            yield kind, None, True


# --- wrappers: a node is [kind, "" or "?" or "+" or "*", pages, children] or, for a text slot, [#, mark, pages, None, characters, whether texts vary, texts of all pages] ---

KIND, MARK, PAGES, INNER, CHARS, VARIES, TEXTS = range(7)


def either(a: str, b: str) -> str:
    repeated, optional = a in ("+", "*") or b in ("+", "*"), a in ("?", "*") or b in ("?", "*")
    return ("*" if optional else "+") if repeated else "?" if optional else ""


def as_group(nodes: list, todo: list) -> list:
    """A repeated group of optional elements: each kind once, by its first place."""
    first: dict = {}
    for node in nodes:
        if node[KIND] in first:
            join(first[node[KIND]], node, False, todo)
        else:
            first[node[KIND]] = node
        first[node[KIND]][MARK] = "*"
    return list(first.values())


def join(a: list, b: list, across: bool, todo: list) -> None:
    """Node b into node a of the same kind, but for their children, which are put on the list of what is to be aligned.

    ``across``: they are of different pages; else of one page, or of one wrapper.
    """
    a[MARK] = either(a[MARK], b[MARK])
    if a[KIND] != "#":
        a[PAGES] = a[PAGES] + b[PAGES] if across else max(a[PAGES], b[PAGES])
        todo.append((a, b, across))
        return
    a[CHARS] += b[CHARS]
    a[VARIES] = a[VARIES] or b[VARIES] or across and a[TEXTS] != b[TEXTS]
    if across:
        a[PAGES], a[TEXTS] = a[PAGES] + b[PAGES], a[TEXTS] & b[TEXTS]
    elif a[PAGES] == b[PAGES]:
        a[TEXTS] |= b[TEXTS]
    else:  # what only some pages have is not the template's
        a[PAGES], a[TEXTS] = max((a[PAGES], a[TEXTS]), (b[PAGES], b[TEXTS]), key=lambda x: x[0])


def matches(x: list, y: list) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists of kinds, as pairs of places."""
    if x == y:
        return [(i, i) for i in range(len(x))]
    n, m = len(x), len(y)
    if len(set(x)) == n and len(set(y)) == m:  # a longest rising sequence of places
        place = {k: j for j, k in enumerate(y)}
        tops, at, before = [], [], {}
        for i, j in ((i, place[k]) for i, k in enumerate(x) if k in place):
            k = bisect_left(tops, j)
            before[i, j] = at[k - 1] if k else None
            tops[k : k + 1], at[k : k + 1] = [j], [(i, j)]
        out, pair = [], at[-1] if at else None
        while pair:
            out.append(pair)
            pair = before[pair]
        return out[::-1]
    score = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            score[i][j] = score[i + 1][j + 1] + 1 if x[i] == y[j] else max(score[i + 1][j], score[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif score[i][j] == score[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def align(a: list, b: list, across: bool = True) -> list:
    """One wrapper, in place of a, for what either matches; b is used up. ``across``: they are of different pages."""
    top = ["", "", 0, a]
    todo = [(top, ["", "", 0, b], across)]
    while todo:
        into, other, across = todo.pop()
        a, b = into[INNER], other[INNER]
        if max(len(a), len(b)) > LONG:
            a, b = as_group(a, todo), as_group(b, todo)
        out: list = []
        i = j = 0

        def put(node: list) -> None:
            if out and out[-1][KIND] == node[KIND]:  # met only now: a repeated element
                if node[KIND] != "#":
                    out[-1][MARK] = either(out[-1][MARK], "+")
                join(out[-1], node, False, todo)
            else:
                out.append(node)

        for x, y in [*matches([k[KIND] for k in a], [k[KIND] for k in b]), (len(a), len(b))]:
            for node in (*a[i:x], *b[j:y]):
                node[MARK] = either(node[MARK], "?")
                put(node)
            if x < len(a):
                join(a[x], b[y], across, todo)
                put(a[x])
            i, j = x + 1, y + 1
        into[INNER] = out
    return top[INNER]


def flat(tree: list) -> list:
    """Nodes in order with their depth instead of their children."""
    out, stack = [], [(0, node) for node in reversed(tree)]
    while stack:
        depth, node = stack.pop()
        if node[KIND] == "#":
            out.append([depth, *node[:INNER], *node[CHARS:TEXTS], sorted(node[TEXTS])])
        else:
            out.append([depth, *node[:INNER]])
            stack += [(depth + 1, x) for x in reversed(node[INNER])]
    return out


def tree_of(nodes: list) -> list:
    top: list = []
    open_ = [top]
    for depth, kind, mark, pages, *slot in nodes:
        del open_[depth + 1 :]
        node = [kind, mark, pages, None, *slot[:2], set(slot[2])] if kind == "#" else [kind, mark, pages, []]
        open_[depth].append(node)
        if kind != "#":
            open_.append(node[INNER])
    return top


def name_of(kind: str) -> str:
    return re.split(r"[.@!~]", kind, maxsplit=1)[0]


def flags_of(kind: str) -> int:
    return {"article": ARTICLE, "main": MAIN, "a": LINK}.get(name_of(kind), 0) | (MAIN if "@main" in kind else 0) | (OUT if kind[-1] == "!" else DOUBT if kind[-1] == "~" else 0)


#: A node of a wrapper as a row, by its place; how many text slots and characters are in it (plain: no links; linked: in links); of a slot the characters that may be main text, and the texts.
NODE = T.StructType([T.StructField(name, kind) for kind, names in ((T.StringType(), "_host"), (T.LongType(), "_node _parent _path _depth"), (T.StringType(), "_kind"), (T.LongType(), "_flags"), (T.BooleanType(), "_repeated"), (T.LongType(), "_pages _texts _plain _chars _linked _own"), (T.BooleanType(), "_varies"), (T.ArrayType(T.StringType()), "_same")) for name in names.split()])


def signed(path: int) -> int:
    return path - (1 << 64) if path >> 63 else path


def by_node(tree: list, pages: int) -> list[list]:
    """The wrapper as rows of ``NODE`` without the host, parents first: 0 is the page, a place is that of the parent with the kind and the how manieth of it."""
    out, parents = [[0, None, 0, 0, "", 0, False, pages, 0, 0, 0, 0, 0, False, None]], [-1]
    stack = [(0, 0, 0, tree)]
    while stack:
        at, place, path, nodes = stack.pop()
        depth, flags = out[at][3] + 1, out[at][5]
        met: dict[str, int] = {}
        for node in nodes:
            kind = node[KIND]
            met[kind] = met.get(kind, 0) + 1
            own = path_hash(place, f"{kind} {met[kind]}")
            parents.append(at)
            if kind == "#":
                link, chars = bool(flags & LINK), node[CHARS]
                out.append([signed(own), signed(place), signed(path), depth, kind, flags, False, node[PAGES], 1, int(not link), chars, chars * link, chars * (not link and not flags & OUT), node[VARIES], [str(x) for x in sorted(node[TEXTS])]])
            else:
                inner = path_hash(path, kind)
                stack.append((len(out), own, inner, node[INNER]))
                out.append([signed(own), signed(place), signed(inner), depth, kind, flags | flags_of(kind), node[MARK] in ("+", "*"), node[PAGES], 0, 0, 0, 0, 0, False, None])
    for i in range(len(out) - 1, 0, -1):
        for k in range(8, 12):
            out[parents[i]][k] += out[i][k]
    return out


def expression(tree: list) -> str:
    """The wrapper as a regular expression over tags and slots."""
    out, stack = [], list(reversed(tree))
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
        elif node[KIND] == "#":
            out.append("#" + node[MARK])
        else:
            out.append(f"(<{node[KIND]}>")
            stack += [f"</{node[KIND]}>){node[MARK]}", *reversed(node[INNER])]
    return " ".join(out)


class Page:
    """The pieces of a page, (path, flags, block number, text) in order; and with ``shape`` its wrapper."""

    def __init__(self, html: str | None, shape: bool = False, decision: dict | None = None):
        self.pieces: list[tuple[int, int, int, str]] = []
        self.tree: list = []
        decided = decision or NOTHING
        region, menus, content = decided["region"], decided["menus"], decided["content"]
        stack: list[tuple[str, int, int, list]] = []  # name, path, flags, the list that it stands in
        count: dict[str, int] = {}
        path, flags, children, block = 0, 0, self.tree, 0

        def close(k: int):
            nonlocal path, flags, children
            while len(stack) > k:
                name, path, flags, children = stack.pop()
                count[name] -= 1
                if shape and len(children) > 1 and children[-1][KIND] == children[-2][KIND]:
                    last = children.pop()
                    children[-1][MARK] = "+"
                    children[-1][INNER] = align(children[-1][INNER], last[INNER], False)

        for name, given, closing in tokens(html or ""):
            if closing is None:
                self.pieces.append((path, flags, block, name))
                if shape and not name.isspace():
                    if not (children and children[-1][KIND] == "#"):
                        children.append(["#", "", 1, None, 0, False, set()])
                    children[-1][CHARS] += len(name)
                    children[-1][TEXTS].add(text_hash(name))
                continue
            block += name in BLOCKS
            if closing:
                if count.get(name):
                    close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
                continue
            closes = CLOSES.get(name, ())
            for k in range(len(stack) - 1, max(-1, len(stack) - 8), -1):
                other = stack[k][0]
                if other in closes or other == "p" and name in BLOCKS and name not in ("br", "hr"):
                    close(k)
                    break
                if other in SECTIONS:
                    break
            if name in VOID or given[-1:] == "/" and name in ("svg", "path"):
                continue
            stack.append((name, path, flags, children))
            count[name] = count.get(name, 0) + 1
            kind, own = kind_of(name, given, flags)
            path = path_hash(path, kind)
            if own & DOUBT and path in content:
                own ^= DOUBT
            flags |= own | (REGION if path == region else 0) | (MENU if path in menus else 0)
            if shape:
                children.append([kind, "", 1, []])
                children = children[-1][INNER]
        close(0)

    def digest(self) -> int:
        """Of the texts that may be main ones."""
        h = xxhash.xxh64()
        for _, flags, _, text in self.pieces:
            if not flags & OUT and not text.isspace():
                h.update(text.strip().encode("utf-8", "surrogatepass"))
        return h.intdigest()


NOTHING = {"region": -1, "menus": frozenset(), "content": frozenset(), "constants": {}}


def decide(tree: list, pages: int, distinct: int) -> dict:
    """What a wrapper says of its host's pages; distinct: how many of them have different texts (``SUPPORT`` is enough)."""
    known = distinct >= SUPPORT
    nodes: list[tuple] = []  # path, parent's place, node, flags; parents first
    stack = [(0, -1, 0, x) for x in reversed(tree)]
    while stack:
        path, parent, flags, node = stack.pop()
        if node[KIND] != "#":
            flags |= flags_of(node[KIND])
            path = path_hash(path, node[KIND])
            stack += [(path, len(nodes), flags, x) for x in reversed(node[INNER])]
        nodes.append((path, parent, node, flags))
    n = len(nodes)
    chars, linked, varying, plain, texts = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n  # of all in an element; varying: no links, outside asides
    constants: dict[int, list[int]] = {}
    for i in range(n - 1, -1, -1):
        path, parent, node, flags = nodes[i]
        if node[KIND] == "#":
            link = bool(flags & LINK)
            varies = not known or node[VARIES] or node[PAGES] < SUPPORT
            chars[i], linked[i], texts[i], plain[i] = node[CHARS], node[CHARS] * link, 1, not link
            varying[i] = node[CHARS] if varies and not link and not flags & OUT else 0
            if known and 2 * node[PAGES] >= pages and node[TEXTS] and not flags & OUT:
                constants.setdefault(path, []).extend(sorted(node[TEXTS]))
        if parent >= 0:
            for x in (chars, linked, varying, plain, texts):
                x[parent] += x[i]
    menus, content = [], []
    for i, (path, _, node, flags) in enumerate(nodes):
        if node[KIND] == "#":
            continue
        if node[MARK] in ("+", "*") and texts[i] and not plain[i] and not flags & ARTICLE:
            menus.append(path)
        if node[KIND][-1] == "~" and known and node[PAGES] >= SUPPORT and varying[i] and 2 * linked[i] < chars[i]:
            content.append(path)
    inner: dict[int, list[int]] = {}
    for i, (_, parent, node, flags) in enumerate(nodes):
        if node[KIND] != "#" and not flags & (OUT | DOUBT) and name_of(node[KIND]) in CONTAINERS:
            inner.setdefault(parent, []).append(i)
    at, region = -1, -1
    total = sum(varying[i] for i, x in enumerate(nodes) if x[1] < 0)
    while total and (best := max(inner.get(at, ()), key=lambda i: varying[i], default=None)) is not None and varying[best] >= MOST * (varying[at] if at >= 0 else total):
        at, region = best, nodes[best][0]
    return {"region": region, "menus": menus, "content": content, "constants": sorted(constants.items())}


def read_decision(text: str) -> dict:
    d = json.loads(text)
    return {"region": d["region"], "menus": frozenset(d["menus"]), "content": frozenset(d["content"]), "constants": {p: frozenset(x) for p, x in d["constants"]}}


def main_text(html: str | None, decision: dict | None = None) -> str:
    """The main text of a page, by what its host's wrapper has decided."""
    decided = decision or NOTHING
    constants = decided["constants"]
    pieces = [x for x in Page(html, decision=decision).pieces if not x[1] & (OUT | DOUBT)]
    for wanted in (ARTICLE, MAIN, REGION, 0):
        if found := [x for x in pieces if (x[1] & wanted) == wanted and (wanted == ARTICLE or not x[1] & MENU)]:
            if not wanted or not all(x[3].isspace() for x in found):
                break
    fixed = [bool(constants) and x[0] in constants and text_hash(x[3]) in constants[x[0]] for x in found]
    own, whole = (sum(len(x[3]) for x, f in zip(found, fixed, strict=True) if not (f and only) and not x[3].isspace()) for only in (True, False))
    if not own or wanted in (ARTICLE, MAIN) and 2 * own < whole:
        fixed = [False] * len(found)
    out, was = [], None
    for (_, _, block, text), f in zip(found, fixed, strict=True):
        if f:
            continue
        if block == was:
            out[-1].append(text)
        else:
            out.append([text])
            was = block
    return " ".join(x for x in (SPACE.sub(" ", unescape("".join(x))).strip() for x in out) if x)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


WRAPPER = T.StructType([T.StructField("_host", T.StringType()), T.StructField("_tree", T.StringType()), T.StructField("_pages", T.LongType()), T.StructField("_digests", T.ArrayType(T.StringType()))])


class Wrappers:
    """The wrappers of some hosts; of over ``most`` nodes they are handed on as rows."""

    def __init__(self, most: int = NODES):
        self.most = most
        self.of: dict[str, list] = {}  # tree, pages, digests, nodes at most
        self.nodes = 0
        self.ready: list[tuple] = []

    def add(self, host: str, tree: list, nodes: int, pages: int, digests: set) -> None:
        known = self.of.get(host)
        if known is None:
            known = self.of[host] = [tree, pages, set(digests), 0]
        else:
            known[0] = align(known[0], tree)
            known[1] += pages
            known[2] = set(sorted(known[2] | digests)[:SUPPORT])
        known[3] += nodes
        self.nodes += nodes
        if known[3] > 4 * self.most:
            known[3] = len(flat(known[0]))
            if known[3] > self.most:
                self.hand_on(host)

    def hand_on(self, host: str) -> None:
        """A row for the host; and, of no pages, those of a large wrapper's nodes, of which an empty tree is left."""
        tree, pages, digests, _ = self.of.pop(host)
        nodes = flat(tree)
        if len(nodes) > self.most:
            rows, nodes = by_node(tree, pages), []
            self.ready += [(host, json.dumps(rows[lo : lo + HELD_ROWS], separators=(",", ":")), 0, []) for lo in range(0, len(rows), HELD_ROWS)]
        self.ready.append((host, json.dumps(nodes, separators=(",", ":")), pages, [str(x) for x in sorted(digests)]))

    def rows(self) -> list[tuple]:
        for host in list(self.of):
            self.hand_on(host)
        out = self.ready
        self.__init__(self.most)
        return out

    def settle(self) -> bool:
        """Counts the nodes anew; whether they are many all the same."""
        for known in self.of.values():
            known[3] = len(flat(known[0]))
        self.nodes = sum(known[3] for known in self.of.values())
        return 2 * self.nodes > HELD_NODES


def wrappers(pages: DataFrame, tables: Tables, most: int = NODES) -> tuple[DataFrame, DataFrame | None]:
    """(_host, _tree as json, _pages, _digests) of (_host, _html): one for each host; and the rows of ``NODE`` of what is too large, if any."""
    arrow = to_arrow_schema(WRAPPER)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    def read(batches):
        made = Wrappers(most)
        for b in batches:
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = Page(html, True)
                made.add(host, page.tree, 2 * len(page.pieces) + 1, 1, {page.digest()} if page.tree else set())
                if len(made.ready) > FAN:
                    yield batch(made.ready)
                    made.ready = []
                if len(made.of) > HELD_HOSTS or made.nodes > HELD_NODES and made.settle():
                    yield batch(made.rows())
        yield batch(made.rows())

    def merge(p):
        import pandas as pd

        made = Wrappers(most)
        for host, tree, n, digests in sorted(zip(p["_host"], p["_tree"], p["_pages"], p["_digests"], strict=True), key=lambda x: x[1]):
            nodes = json.loads(tree)
            made.add(host, tree_of(nodes), len(nodes), int(n), {int(x) for x in digests})
        return pd.DataFrame(made.rows(), columns=WRAPPER.names)

    put, large = tables.put(pages.select("_host", "_html").mapInArrow(read, WRAPPER)), []
    while True:
        found = put.where("_pages > 0")
        counts = found.groupBy("_host").agg(F.count("*").alias("_n"))
        n, parts = put.groupBy("_host").agg(F.sum((F.col("_pages") > 0).cast("int")).alias("_n"), F.sum((F.col("_pages") == 0).cast("int")).alias("_l")).agg(F.max("_n"), F.sum("_l")).first()
        large += [put.where("_pages = 0")] if parts else []
        if (n or 0) <= 1:
            break
        part = F.pmod(F.xxhash64("_tree", "_pages", "_digests"), F.ceil(F.col("_n") / FAN)).cast("int")
        was, put = put, tables.put(found.join(counts, "_host").withColumn("_part", part).select(*WRAPPER.names, "_part").groupBy("_host", "_part").applyInPandas(merge, WRAPPER))
        if not parts:
            tables.drop(was)
    if not large:
        return found, None
    spread = functools.reduce(DataFrame.union, large)
    hosts = spread.select("_host").distinct()
    read_nodes = lambda host, nodes: [(host, *x) for x in json.loads(nodes)]
    rest = lambda host, tree, n: [(host, *x) for x in by_node(tree_of(json.loads(tree)), n)]
    nodes = map_rows(spread.select("_host", "_tree"), lambda: read_nodes, NODE, many=True)
    return found, nodes.union(map_rows(found.join(hosts, "_host", "left_semi").select("_host", "_tree", "_pages"), lambda: rest, NODE, many=True))


def summed(nodes: DataFrame, tables: Tables) -> DataFrame:
    """(_host, _node, _v), each with the sum over all that is in it, of (_host, _node, _parent, _v): in each round from twice as far."""
    key = ["_host", "_node"]
    sums, up = nodes.select(*key, "_v"), nodes.where("_parent is not null").select(*key, F.col("_parent").alias("_up"))
    while up.head(1):
        more = sums.join(up, key).groupBy("_host", F.col("_up").alias("_node")).agg(F.sum("_v").alias("_more"))
        sums = tables.put(sums.join(more, key, "left").select(*key, (F.col("_v") + F.coalesce("_more", F.lit(0))).alias("_v")))
        up = tables.put(up.join(up.select("_host", F.col("_node").alias("_up"), F.col("_up").alias("_top")), ["_host", "_up"]).select(*key, F.col("_top").alias("_up")))
    return sums


def unbroken(nodes: DataFrame, tables: Tables) -> DataFrame:
    """(_host, _node) of those whose parents are all there, up to 0, of (_host, _node, _parent)."""
    up = tables.put(nodes.select("_host", "_node", F.coalesce("_parent", F.lit(0)).alias("_up")))
    while up.where("_up != 0").head(1):
        up = tables.put(up.join(up.select("_host", F.col("_node").alias("_up"), F.col("_up").alias("_top")), ["_host", "_up"]).select("_host", "_node", F.col("_top").alias("_up")))
    return up.select("_host", "_node")


def decide_by_node(rows: DataFrame, found: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """What ``decide`` says, for wrappers as rows: (_host, _region, _all) and, of paths that matter, (_host, _path, _menu, _content, _constants)."""
    key, place = ["_host", "_path"], ["_host", "_node"]
    has = lambda flag: F.col("_flags").bitwiseAND(F.lit(flag)) != 0
    rows = tables.put(rows)
    hosts = found.select("_host", F.col("_pages").alias("_all"), (F.size("_digests") >= SUPPORT).alias("_known"))
    once = [F.min(c).alias(c) for c in ("_parent", "_path", "_depth", "_kind", "_flags")]
    total = [F.sum(c).alias(c) for c in ("_pages", "_texts", "_plain", "_chars", "_linked", "_own")]
    differ = F.max("_varies") | F.coalesce(F.min("_same") != F.max("_same"), F.lit(False))
    nodes = rows.groupBy(*place).agg(*once, *total, F.max("_repeated").alias("_repeated"), differ.alias("_varies"), F.count("*").alias("_rows")).join(hosts, "_host")
    nodes = tables.put(nodes.withColumn("_v", F.when(~F.col("_known") | F.col("_varies") | (F.col("_pages") < SUPPORT), F.col("_own")).otherwise(0)))
    nodes = tables.put(nodes.drop("_v").join(summed(nodes, tables), place))
    around = nodes.select("_host", F.col("_node").alias("_parent"), F.col("_v").alias("_around"))
    may_be = F.regexp_extract("_kind", r"^[^.@!~]*", 0).isin(*sorted(CONTAINERS)) & ~has(OUT | DOUBT) & (F.col("_v") > 0) & (F.col("_v") >= MOST * F.col("_around"))
    chain = nodes.join(around, ["_host", "_parent"], "left").where((F.col("_depth") == 0) & (F.col("_v") > 0) | may_be)
    region = unbroken(chain, tables).join(nodes.select(*place, "_path", "_depth"), place).where("_depth > 0").groupBy("_host").agg(F.max_by("_path", "_depth").alias("_region"))
    frequent = nodes.where(F.col("_known") & (F.col("_kind") == "#") & (2 * F.col("_pages") >= F.col("_all")) & ~has(OUT)).select(*place, "_rows")
    texts = rows.join(frequent, place).select(*key, "_node", "_rows", F.explode("_same").alias("_text")).groupBy(*key, "_node", "_rows", "_text").count().where("count = _rows").groupBy(*key).agg(F.collect_set("_text").alias("_constants"))
    menu = F.col("_repeated") & (F.col("_texts") > 0) & (F.col("_plain") == 0) & ~has(ARTICLE) & ~has(OUT)
    content = F.col("_kind").endswith("~") & F.col("_known") & (F.col("_pages") >= SUPPORT) & (F.col("_v") > 0) & (2 * F.col("_linked") < F.col("_chars"))
    marks = nodes.groupBy(*key).agg(F.max(menu).alias("_menu"), F.max(content).alias("_content")).join(texts, key, "left").where("_menu or _content or _constants is not null")
    return tables.put(hosts.join(rows.select("_host").distinct(), "_host").join(region, "_host", "left").select("_host", "_region", "_all")), tables.put(marks)


def written(region: int | None, marks: list | None) -> str:
    """A decision of marks (_path, _menu, _content, _constants)."""
    whole = [(x["_path"] % (1 << 64), x["_menu"], x["_content"], [int(t) for t in x["_constants"] or ()]) for x in marks or ()]
    return json.dumps({"region": -1 if region is None else region % (1 << 64), "menus": sorted(p for p, menu, _, _ in whole if menu), "content": sorted(p for p, _, content, _ in whole if content), "constants": sorted((p, sorted(texts)) for p, _, _, texts in whole if texts)}, separators=(",", ":"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sent: int = SENT, nodes: int = NODES) -> DataFrame:
    """(id, url, text, n_chars, n_host_pages) of every row."""
    tables = Tables(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host_of(F.col(url_col)).alias("_host"), F.col(html_col).alias("_html"))
    kind = T.StructType([T.StructField("_host", T.StringType()), T.StructField("_decision", T.StringType()), T.StructField("_pages", T.LongType())])
    decided = lambda host, tree, n, digests: (host, json.dumps(decide(tree_of(json.loads(tree)), n, len(digests)), separators=(",", ":")), n)
    found, large_nodes = wrappers(rows, tables, nodes)
    known, by_page = map_rows(found, lambda: decided, kind), None
    if large_nodes is not None:
        large, marks = decide_by_node(large_nodes, found, tables)
        of_marks = lambda host, region, marks, n: (host, written(region, marks), n)
        mark = F.collect_list(F.struct("_path", "_menu", "_content", "_constants")).alias("_marks")
        known = map_rows(found.join(large, "_host", "left_anti"), lambda: decided, kind)
        if (marks.agg(F.sum(F.coalesce(F.size("_constants"), F.lit(0)) * 24 + 48)).first()[0] or 0) <= sent:
            known = known.union(map_rows(large.join(marks.groupBy("_host").agg(mark), "_host", "left").select("_host", "_region", "_marks", "_all"), lambda: of_marks, kind))
        else:
            keyed = rows.withColumn("_key", F.xxhash64("_html")).join(large, "_host")
            own = lambda host, key, html: [(host, key, x) for x in {x[2] for x in by_node(Page(html, True).tree, 1)}]
            place = T.StructType([T.StructField("_host", T.StringType()), T.StructField("_key", T.LongType()), T.StructField("_path", T.LongType())])
            places = map_rows(keyed.select("_host", "_key", "_html"), lambda: own, place, many=True).distinct()
            marked = places.join(marks, ["_host", "_path"]).groupBy("_host", "_key").agg(mark)
            by_page = (cut(large), cut(marked))
    known = cut(known)
    tables.drop()
    size = known.agg(F.sum(F.length("_decision") + F.length("_host") + 64)).first()[0] or 0
    if size <= sent:
        known = F.broadcast(known)
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_host_pages", T.LongType())])

    def make():
        seen: dict[str, dict] = {}

        def row(key, url, host, html, decision, n):
            if host not in seen:
                if len(seen) > HELD_HOSTS:
                    seen.clear()
                seen[host] = read_decision(decision)
            text = main_text(html, seen[host])
            return key, url, text, len(text), n

        return row

    out = map_rows(rows.join(known, "_host").select("_id", "_url", "_host", "_html", "_decision", "_pages"), make, schema)
    if by_page is None:
        return out

    def by_own(key, url, html, region, marks, n):
        text = main_text(html, read_decision(written(region, marks)))
        return key, url, text, len(text), n

    large, marked = by_page
    own_rows = rows.withColumn("_key", F.xxhash64("_html")).join(large, "_host").join(marked, ["_host", "_key"], "left")
    return out.union(map_rows(own_rows.select("_id", "_url", "_html", "_region", "_marks", "_all"), lambda: by_own, schema))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
