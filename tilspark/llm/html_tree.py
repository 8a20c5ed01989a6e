"""A small tolerant HTML reader: containers, blocks of text and the paths between them.

Some elements never hold an article (``DROP``).  Words in a class, id or role only raise a suspicion,
which the page confirms or not once it is read: see ``judge``.
"""

from __future__ import annotations

import re
from hashlib import blake2b

#: markup, in one pass: comments, raw declarations, end and start tags
TAG = re.compile(r"""<(?:!--(?:[^-]|-(?!->))*(?:-->|\Z)|[!?][^>]*>?|/\s*([a-zA-Z][^\s>/]*)[^>]*>?|([a-zA-Z][^\s>/]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(>|\Z))""", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
RAW = ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements that end a block of text
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body center div main section td blockquote dd li html".split())
#: elements whose text is never part of an article
DROP = frozenset(
    "head script style noscript template nav footer header aside menu button select textarea input iframe object embed svg math canvas audio "
    "video dialog title noembed noframes applet datalist".split()
)
#: elements that are suspect whatever their class: some sites put the whole page into one
SUSPECT = frozenset(("form", "fieldset"))
#: words in class, id or role that mark what surrounds an article
BOILER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle banner banners sponsor sponsored promo promotion promos nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar sidebars aside footer foot masthead topbar toolbar header cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations widget widgets pagination pager paywall search contentinfo complementary".split()
)
#: words that mark what readers wrote
READERS = frozenset("comment comments commentlist respond responses disqus replies discussion reviews feedback reactions".split())
#: beside one of the above in one class name: the class speaks of a page that has such a thing, or of how it is laid out
WEAKENS = frozenset("has have with without no none not is page layout wrap wrapper container content contents article post story entry main body text free single template grid row col column columns area inner outer".split())
#: a start tag of the key closes an open element of the values
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
#: these bound what CLOSES may close
SCOPE = frozenset("ul ol dl table select article section div body td th menu".split())
_WORDS = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")
#: structure that no element name or class closes before its own end
KEEP_OPEN = frozenset(("html", "body"))


#: how sure a class is
STRONG, WEAK, OF_READERS = 3, 1, 2
#: longer paths are known by a digest
PATH_CHARS = 400


class Node:
    __slots__ = ("tag", "label", "parent", "dropped", "score", "linked", "link", "depth", "suspect", "chars", "articles")

    def __init__(self, tag, label, parent, dropped, suspect=0):
        self.tag, self.label, self.parent, self.dropped, self.suspect = tag, label, parent, dropped, suspect
        self.score, self.linked, self.link = 0.0, 0.0, False
        self.chars, self.articles = 0, 0
        self.depth = parent.depth + 1 if parent else 0

    def path(self) -> str:
        """Generalised path from the root: tags with their classes, digits as #."""
        out, node = [], self
        while node.parent is not None:
            if node.tag not in ("html", "body"):
                out.append(node.label)
            node = node.parent
        path = ">".join(reversed(out)) or "body"
        return path if len(path) <= PATH_CHARS else "#" + blake2b(path.encode(errors="surrogatepass"), digest_size=16).hexdigest()


def _suspicion(name: str) -> int:
    """How much one class, id or role says that its element surrounds an article."""
    words = set(_WORDS.findall(_CAMEL.sub(" ", name).lower()))
    found = OF_READERS if words & READERS else STRONG if words & BOILER else 0
    return WEAK if found and words & WEAKENS else found


def _label(tag: str, attrs: str) -> tuple[str, int, bool]:
    """The element's name in paths, how suspect its class, id and role make it, and whether it is hidden."""
    suspect, label, hidden = STRONG if tag in SUSPECT else 0, tag, False
    if not attrs:
        return label, suspect, hidden
    low = attrs.lower()
    if not any(x in low for x in ("class", "id", "role", "style")):
        return label, suspect, hidden
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            if tag not in ("body", "html", "main"):
                suspect = max([suspect, *map(_suspicion, value.split())])
            if name == "class":
                label += "".join("." + _DIGITS.sub("#", c) for c in value.split())
        elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            hidden = True
    return label, suspect, hidden


def judge(blocks: list[tuple[Node, list[tuple[Node, str]]]]) -> set[int]:
    """The suspect elements that do surround the article (by ``id``).

    One is cleared if the page's article or main elements are all inside suspects and it holds one; or
    if next to nothing of the page's text without links is outside.  A weak one is cleared also if it
    holds a fair share of that text, and more of it than linked text.  What readers wrote is cleared
    only as the holder of a single article that is most of the page.
    """
    total, free = 0, False
    suspects: dict[int, Node] = {}
    linked: dict[int, int] = {}
    counted: set[int] = set()
    for _, pieces in blocks:
        for node, text in pieces:
            n = len(text.strip())
            if not n:
                continue
            total += 0 if node.link else n
            chain, article = [], None
            x = node
            while x.parent is not None:
                if x.suspect:
                    chain.append(x)
                if x.tag in ("article", "main") and not x.suspect:
                    article = x  # the outermost
                x = x.parent
            for c in chain:
                suspects[id(c)] = c
                if node.link:
                    linked[id(c)] = linked.get(id(c), 0) + n
                else:
                    c.chars += n
            if article is not None and id(article) not in counted:
                counted.add(id(article))
                above = [c for c in chain if c.depth < article.depth]
                for c in above:
                    c.articles += 1
                free |= not above
    gone = set()
    for key, c in suspects.items():
        holds = c.articles > 0 and not free
        if c.suspect == OF_READERS:
            clear = holds and c.articles == 1 and 2 * c.chars > total
        else:
            clear = holds or (not free and 10 * c.chars > 9 * total)
            if c.suspect == WEAK:
                clear |= 5 * c.chars > total and c.chars > linked.get(key, 0)
        if not clear:
            gone.add(key)
    return gone


def _without(blocks: list[tuple[Node, list[tuple[Node, str]]]], gone: set[int]) -> list[tuple[Node, list[str]]]:
    """The blocks with the text that isn't in any of the elements; each block's first remaining holder."""
    known: dict[int, bool] = {}

    def lost(node):
        trail = []
        while node is not None and id(node) not in known:
            trail.append(node)
            if id(node) in gone:
                break
            node = node.parent
        found = node is not None and (id(node) in gone or known.get(id(node), False))
        for x in trail:
            known[id(x)] = found
        return found

    out = []
    for holder, pieces in blocks:
        kept = [(node, text) for node, text in pieces if not lost(node)] if gone else pieces
        if kept:
            out.append((holder if not gone or not lost(holder) else kept[0][0], [text for _, text in kept]))
    return out


def parse(html: str) -> list[tuple[Node, list[str]]]:
    """The blocks of text in page order, without what surrounds the article: the element that holds
    each, and its raw pieces."""
    root = Node("#root", "", None, False)
    node, blocks, pieces = root, [], []
    at, n = 0, len(html)
    holder = root

    def flush():
        nonlocal pieces
        if pieces:
            blocks.append((holder, pieces))
            pieces = []

    def up_to(target):
        nonlocal node
        node = target.parent

    while at < n:
        m = TAG.search(html, at)
        begin = m.start() if m else n
        if begin > at and not node.dropped:
            if not pieces:
                holder = node
            pieces.append((node, html[at:begin]))
        if not m:
            break
        at = m.end()
        end, tag = m[1], m[2]
        if end:
            end = end.lower()
            found = node
            while found.parent is not None and found.tag != end:
                if end not in BLOCK and found.tag in BLOCK:
                    break  # a stray inline end tag closes no block
                found = found.parent
            if found.parent is not None and found.tag == end:
                if end in BLOCK or end in DROP:
                    flush()
                if end not in KEEP_OPEN:
                    node = found.parent
            elif end in BLOCK:
                flush()
            continue
        if not tag:
            continue
        tag = tag.lower()
        block = tag in BLOCK
        if block:
            flush()
            # an open paragraph ends at any block
            p = node
            while p.parent is not None and p.tag not in SCOPE and p.tag != "p":
                p = p.parent
            if p.tag == "p":
                node = p.parent
            if tag in CLOSES:
                p = node
                while p.parent is not None and p.tag not in SCOPE - CLOSES[tag]:
                    if p.tag in CLOSES[tag]:
                        node = p.parent
                    p = p.parent
        if tag == "br" or (tag in VOID and not block):
            if pieces:
                pieces.append((node, " " if tag == "br" else ""))
            continue
        if tag in VOID:
            continue
        if tag in ("html", "body"):
            p = node
            while p.parent is not None and p.tag != tag:
                p = p.parent
            if p.parent is not None:
                continue
            if tag == "body":
                while node.parent is not None and node.tag != "html":
                    node = node.parent
        elif tag == "head" or node.tag != "head":
            pass
        if node.tag == "head" and tag not in ("script", "style", "title", "noscript", "template", "meta", "link", "base"):
            node = node.parent  # an unclosed head ends at the first element that can't be in it
        label, suspect, hidden = _label(tag, m[3])
        dropped = node.dropped or hidden or tag in DROP
        if tag in RAW:
            e = RAW_END[tag].search(html, at)
            if tag == "noscript" or tag in DROP:
                at = e.start() if e else n
                k = html.find(">", at)
                at = k + 1 if e and k >= 0 else n
                continue
        if dropped and not node.dropped and block:
            flush()
        if m[3].rstrip().endswith("/") and tag in ("svg", "math", "template"):
            continue
        child = Node(tag, label, node, dropped, suspect)
        child.link = node.link or tag == "a"
        node = child
    flush()
    return _without(blocks, judge(blocks))


def clean(pieces: list[str]) -> str:
    from html import unescape

    text = "".join(pieces)
    return " ".join((unescape(text) if "&" in text else text).split())


def container(node: Node) -> Node:
    while node.parent is not None and node.tag not in CONTAINER:
        node = node.parent
    return node


def score(blocks: list[tuple[Node, list[str]]]) -> tuple[Node | None, float]:
    """The container that reads most like an article: text that isn't linked counts for the nearest
    container in full and for each one further out by half as much; long blocks count for more, and
    containers of many links for less."""
    seen: dict[int, Node] = {}
    for node, pieces in blocks:
        size = sum(map(len, map(str.strip, pieces)))
        if not size:
            continue
        if node.link:
            container(node).linked += size
            continue
        weight = size * (1.0 if size >= 40 else 0.5)
        if node.tag in ("li", "td", "dd"):
            weight *= 0.5
        c = container(node)  # the root, if nothing else
        while True:
            c.score += weight
            seen[id(c)] = c
            weight *= 0.5
            if c.parent is None:
                break
            c = container(c.parent)
    if not seen:
        return None, 0.0
    best = max(seen.values(), key=lambda c: (c.score * c.score / (c.score + c.linked or 1.0), -c.depth))
    # an article around it brings its headings along; several small parts share a parent
    top, found = best, None
    while top.parent is not None:
        if top.tag == "article" or (top.tag == "main" and found is None):
            found = top
        top = top.parent
    if found is None:
        found = best
        while found.parent is not None and found.tag in ("li", "td", "dd", "blockquote") and container(found.parent).parent is not None:
            found = container(found.parent)
    return found, best.score


def extract(blocks: list[tuple[Node, list[str]]], paths: list[str], fallback: bool = True) -> tuple[str, str]:
    """The text under the first of the paths that the page has (else under its own best container),
    one line for each block, and the path that was used."""
    known: dict[int, str] = {}
    ancestors: dict[str, list[Node]] = {}
    if paths:
        for node, _ in blocks:
            c = container(node)
            while id(c) not in known:
                known[id(c)] = p = c.path()
                ancestors.setdefault(p, []).append(c)
                if c.parent is None:
                    break
                c = container(c.parent)
    chosen: list[Node] = []
    path = ""
    for p in paths:
        if p in ancestors:
            text = _text(blocks, ancestors[p])
            if text:
                return text, p
    if fallback:
        best, _ = score(blocks)
        if best is not None:
            chosen, path = [best], best.path()
    return (_text(blocks, chosen), path) if chosen else ("", "")


def _text(blocks, roots) -> str:
    want = {id(r) for r in roots}
    inside: dict[int, bool] = {}

    def under(node):
        trail = []
        while node is not None and id(node) not in inside:
            if id(node) in want:
                inside[id(node)] = True
                break
            trail.append(node)
            node = node.parent
        found = node is not None and inside[id(node)]
        for x in trail:
            inside[id(x)] = found
        return found

    lines = (clean(pieces) for node, pieces in blocks if under(node))
    return "\n".join(line for line in lines if line)
