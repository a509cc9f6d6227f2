"""Main text of web pages, with site templates removed.

Each page becomes a light element tree. The hashes of its element subtrees are counted per host in
Spark, over pages of different texts; subtrees that recur across many pages of their host are deleted
there. A subtree has a hash of all that it holds; one that is mostly links (a menu, a list of related
pages) also one of its shape alone, as its links may differ from page to page. What is left of the
article, less elements that are no article by their kind or name, is the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrove.llm.store import keyed, named, stored

#: A subtree is template if at least so many of its host's pages of different texts, and this share of
#: them, have it: variants of a template count each. A shape needs the larger share.
PAGES, SHARE, SHAPE_SHARE = 5, 0.1, 0.3

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption html legend tbody td tfoot th thead tr".split())
PROSE = frozenset("b blockquote br cite code dd dl dt em figcaption h1 h2 h3 h4 h5 h6 i li ol p pre span strong sub sup td th tr u ul a".split())
SIBLINGS = {
    "li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("table", "tr")), "th": ("td th", ("table", "tr")),
    "tbody": ("tbody thead tfoot tr td th", ("table",)), "tfoot": ("tbody thead tfoot tr td th", ("table",)), "thead": ("tbody thead tfoot tr td th", ("table",)), "option": ("option", ("select",)),
}
#: Elements that are never article text.
NO_TEXT = frozenset("aside button canvas dialog footer form frameset head iframe input map menu nav noframes noscript object select svg script style template textarea title video audio".split())
#: Words of an element's class or id that say the same of it.
NO_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising advertorial alert author-box banner banners breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies copyright "
    "disclaimer disqus footer gdpr legal login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager paginate pagination paywall popup promo promoted promotion "
    "recommendations recommended related replies reply respond search share sharing sidebar sidebars signup skip skip-link social sponsor sponsored subscribe subscription toolbar tooltip widget widgets".split()
)
#: What may follow such a word and a hyphen in a name, which then says the same.
SUFFIXES = frozenset("area aside banner bar block bottom box button buttons container content form footer group header holder inner item items left link links list main menu modal nav notice outer panel popup right section slot text thread title top unit wrap wrapper widget zone".split())
NO_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s"'>]+))?""")
NAME = re.compile(r"[\s_]+")
PART = re.compile(r"[-:]+")
DIGITS = re.compile(r"\d*$")


class Element:
    __slots__ = ("attrs", "children", "digest", "length", "links", "parent", "shape", "tag")

    def __init__(self, tag: str, attrs: str, parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.digest, self.shape, self.length, self.links = 0, 0, 0, 0

    def attributes(self) -> dict[str, str]:
        found: dict[str, str] = {}
        for name, value in ATTRIBUTE.findall(self.attrs):
            found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
        return found

    def listed(self) -> bool:
        """Whether it is mostly links."""
        return 0 < self.length <= 2 * self.links

    def dropped(self) -> bool:
        """Whether it is no article text by its kind, name, role or being hidden."""
        if self.tag in NO_TEXT:
            return True
        if not self.attrs.strip(" /") or self.tag in ("html", "body", "main"):
            return False
        own = self.attributes()
        if own.get("role", "").lower() in NO_ROLES or "hidden" in own or own.get("aria-hidden", "").lower() == "true":
            return True
        if "display:none" in own.get("style", "").replace(" ", "").lower():
            return True
        names = NAME.split(f"{own.get('class', '')} {own.get('id', '')}".lower())
        if self.tag == "article":  # a comment may be one; other names say nothing of it
            return not {"comment", "comments", "reply"}.isdisjoint(names)
        for name in names:
            first, *rest = PART.split(name)
            if name in NO_NAMES or DIGITS.sub("", first) in NO_NAMES and all(DIGITS.sub("", x) in SUFFIXES or not DIGITS.sub("", x) for x in rest):
                return True
        return False


def parse(page: str) -> Element:
    """The page's element tree; a child is an Element or a string with references decoded."""
    root = Element("", "", None)
    now, at, n = root, 0, len(page)
    while at < n:
        found = TOKEN.match(page, at)
        at = found.end()
        tag = found.group(2)
        if tag is None:
            text = found.group()
            if text[:2] not in ("<!", "<?") or text == "<":
                now.children.append(html.unescape(text) if "&" in text else text)
            continue
        tag = tag.lower()
        if found.group(1):
            up = now
            while up is not root and up.tag != tag:
                if up.tag in ("td", "th", "table", "article", "body", "html") and tag not in BLOCK:
                    up = root
                    break
                up = up.parent
            if up is not root:
                now = up.parent
            continue
        if tag in CLOSES_P:
            up = now
            while up is not root and up.tag != "p" and (up.tag not in BLOCK):
                up = up.parent
            if up.tag == "p":
                now = up.parent
        if tag in SIBLINGS:
            closes, until = SIBLINGS[tag]
            up, closes, last = now, closes.split(), None
            while up is not root and up.tag not in until:
                if up.tag in closes:
                    last = up
                up = up.parent
            if last is not None:
                now = last.parent
        element = Element(tag, found.group(3), now)
        now.children.append(element)
        if tag in RAW and not found.group(3).endswith("/"):
            end = re.compile(f"</{tag}\\s*/?>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not (found.group(3).endswith("/") and tag not in BLOCK and tag in ("svg", "path", "use")):
            now = element
    return root


def walk(root: Element) -> Iterator[Element]:
    """All elements, parents first, without recursion."""
    stack = [root]
    while stack:
        now = stack.pop()
        yield now
        stack += [c for c in reversed(now.children) if not isinstance(c, str)]


def _hash(parts: list[str]) -> int:
    return int.from_bytes(blake2b("\x00".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def digest(root: Element) -> None:
    """Sets each element's hash (of kind, attributes, texts and children), lengths of text and link text, and for what is mostly links the hash of its shape: kinds, names and the kinds of children, however many."""
    for e in reversed(list(walk(root))):
        parts, shapes = [e.tag, " ".join(e.attrs.split())], set()
        e.length = e.links = 0
        for c in e.children:
            if isinstance(c, str):
                words = " ".join(c.split())
                parts.append(words)
                e.length += len(words)
            else:
                parts.append(f"\x01{c.digest}")
                shapes.add(c.shape)
                e.length += c.length
                e.links += c.links
        if e.tag == "a":
            e.links = e.length
        e.digest = _hash(parts)
        e.shape = _hash(["shape", e.tag, "" if e.tag == "a" else parts[1], *map(str, sorted(shapes))]) if e.listed() or e.tag == "a" else 0


def counted(root: Element) -> tuple[set[int], set[int]]:
    """Hashes of the subtrees that are counted: blocks with text, and shapes of blocks that are mostly links."""
    blocks = [e for e in walk(root) if e.tag in BLOCK and e.length and e.tag not in ("html", "body", "article", "main")]
    return {e.digest for e in blocks}, {e.shape for e in blocks if e.shape}


def prune(root: Element, template: frozenset[int]) -> None:
    """Deletes template subtrees, and what is no article text. In an article only lists of links are template: articles are copied, too."""
    stack = [(root, False)]
    while stack:
        now, inside = stack.pop()
        inside = inside or now.tag in ("article", "main")
        kept: list = []
        for c in now.children:
            if not isinstance(c, str):
                known = c.tag in BLOCK and c.tag not in ("html", "body", "article", "main") and (c.digest in template or c.shape in template)
                if c.dropped() or (known and (c.listed() or not inside)):
                    kept.append(" ")
                    continue
                if c.tag in ("header", "hgroup"):
                    if not (inside and any(x.tag in ("h1", "h2") for x in walk(c))):
                        kept.append(" ")
                        continue
                stack.append((c, inside))
            kept.append(c)
        now.children = kept


def outermost(root: Element, wanted: Callable[[Element], bool]) -> list[Element]:
    """The wanted elements that lie in no other wanted one."""
    found, stack = [], [root]
    while stack:
        now = stack.pop()
        if wanted(now):
            found.append(now)
        else:
            stack += [c for c in reversed(now.children) if not isinstance(c, str)]
    return found


def common(root: Element, found: list[Element]) -> Element:
    """The lowest element that holds all of them."""
    held = {id(e): 1 for e in found}
    for e in reversed(list(walk(root))):
        n = held.get(id(e), 0)
        if n == len(found) or e is root:
            return e
        if n:
            held[id(e.parent)] = held.get(id(e.parent), 0) + n
    return root


def article(root: Element) -> list[Element]:
    """The elements that hold the article, in page order.

    One is the common ancestor of all outermost articles, else of article bodies, else of mains, else of
    all texts that are no links. The others are main headings (h1) outside of it.
    """
    for wanted in (lambda e: e.tag == "article", lambda e: "articlebody" in e.attrs.lower(), lambda e: e.tag == "main" or 'role="main"' in e.attrs.lower()):
        if found := [e for e in outermost(root, wanted) if e.length]:
            top = common(root, found)
            heads = outermost(root, lambda e: e is top or e.tag == "h1")
            return heads if any(e is top for e in heads) else [top]
    found = outermost(root, lambda e: e.tag == "a" or any(isinstance(c, str) and c.strip() for c in e.children))
    found = [e for e in found if e.tag != "a"]
    return [common(root, found) if found else root]


def text_of(top: Element) -> str:
    """Blocks' texts in page order, white space in them made one space, joined by empty lines."""
    blocks: list[str] = []
    held: list[str] = []

    def end() -> None:
        if words := "".join(held).split():
            blocks.append(" ".join(words))
        held.clear()

    stack: list = [top]
    while stack:
        now = stack.pop()
        if now is None:
            end()
        elif isinstance(now, str):
            held.append(now)
        elif now.tag == "br":
            held.append(" ")
        else:
            if now.tag in BLOCK:
                end()
                stack.append(None)
            stack += reversed(now.children)
    end()
    return "\n\n".join(blocks)


def main_text(page: str | None, template: frozenset[int] = frozenset()) -> str:
    if not page:
        return ""
    root = parse(page)
    digest(root)
    prune(root, template)
    digest(root)
    return "\n\n".join(filter(None, map(text_of, article(root))))


def host(url) -> F.Column:
    """The host of a URL in lower case, '' if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame, least: int = PAGES, share: float = SHARE, shape_share: float = SHAPE_SHARE) -> DataFrame:
    """(host, template): hashes of the subtrees that recur across many pages of a host.

    Copies of a page count once. Of each host only counts are kept; as a page has only so many
    subtrees, those on a given share of a host's pages are few whatever its size.
    """
    sites = pages.select(host(F.col("url")).alias("host"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, found, of, kinds = [], [], [], []
            for site, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                if page.is_valid and site:
                    root = parse(page.as_py())
                    digest(root)
                    blocks, shapes = counted(root)
                    own = [0, *blocks, *shapes]  # 0 counts the page
                    hosts += [site] * len(own)
                    found += own
                    of += [root.digest] * len(own)
                    kinds += [x in shapes for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.int64()), pa.array(of, pa.int64()), pa.array(kinds, pa.bool_())], names=["host", "subtree", "page", "shape"])

    counts = sites.mapInArrow(run, "host string, subtree long, page long, shape boolean").distinct().groupBy("host", "subtree", "shape").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.where(F.col("n") >= least), "subtrees")
    whole = counts.where("subtree = 0").select("host", F.col("n").alias("pages"))
    needed = F.when(F.col("shape"), F.lit(shape_share)).otherwise(F.lit(share)) * F.col("pages")
    often = counts.where("subtree <> 0").join(whole, "host").where(F.col("n") >= needed)
    return stored(often.groupBy("host").agg(F.sort_array(F.collect_set("subtree")).alias("template")), "templates")


def extract(pages: DataFrame) -> DataFrame:
    """Main text of pages(page_id, url, html): page_id, url, text, n_chars.

    Null, empty and text-less html give ''. A page of a null URL, or one without host, has no site;
    nothing of it is template. Repeated rows get a row each and count as pages of their own. An empty
    table gives no rows; other columns are not looked at.
    """
    rows = keyed(pages.select("page_id", "url", "html"), "page_id").withColumn("host", host(F.col("url")))
    met = rows.join(templates(pages), "host", "left").select("page_id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, frozenset] = {}
        for batch in batches:
            texts = []
            for page, listed in zip(batch.column("html"), batch.column("template").to_pylist(), strict=True):
                key = tuple(listed or ())
                if key not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[key] = frozenset(key)
                texts.append(main_text(page.as_py(), known[key]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return named(met.mapInArrow(run, "page_id long, url string, text string, n_chars long"), "page_id")
