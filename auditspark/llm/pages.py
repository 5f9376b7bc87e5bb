"""Operator 7: main text of web pages by site template removal.

Every page is cut into its elements; block elements are hashed with all they
hold.  Spark counts, per host, in how many different pages each hash occurs (pages
that share their whole article count once, so copies make no template).  Hashes
that occur in many pages of a host are its template: such subtrees are deleted,
next to the elements that are furniture by their tag, role or class.  What is left
of the article (``article`` or ``main``, else the body) is the text.

Text blocks inside an article are never taken for a template, nor is a subtree
that holds most of the page's main block.  Inside an article a class or id tells
furniture only if it is, as a whole, a name of adverts or of a list of comments; names
that merely hold such a word there make a subtree one that goes if it recurs on the
host, so an article may write of promotions and of comments.
"""

from __future__ import annotations

import html as htmllib
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.common import BROADCAST_BYTES, few_rows, ship, table, written

#: A subtree is template from this many different pages of its host.
MIN_PAGES = 5
#: Into how many parts the pages of one host are dealt where templates are joined.
PARTS = 16

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)|</\Z", re.S)
_ATTRIBUTE = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)")
_RAW = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)", re.I) for x in ("script", "style", "textarea", "title", "noscript", "xmp", "iframe")}
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"

# Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_FURNITURE = frozenset("head script style noscript template nav footer aside form button select option input textarea iframe object svg canvas dialog menu title".split())
_SILENT = frozenset("script style template noscript".split())  # they do not part the words around them
_TEXT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr figcaption".split())
_ENDS_BEFORE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_FENCE = frozenset("article aside body div footer form header main nav section table td th ul ol dl html".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promotions comment comments commentlist respond".split())
#: Inside an article: whole classes or ids of adverts and of what readers say.
_IN_ARTICLE = frozenset("ad ads adv advert adverts advertisement advertising sponsored comments commentlist comment-list comments-area comments-list comments-section comment-section reader-comments user-comments".split())
_NAMES = frozenset(
    "banner breadcrumb breadcrumbs consent cookie cookies disclaimer footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices overlay "
    "pagination popup related share sharing sidebar signup skip social subscribe subscription toolbar topbar widget widgets".split()
)


class Element:
    __slots__ = ("tag", "parent", "furniture", "named", "article", "parts", "size", "net", "digest")

    def __init__(self, tag, parent, furniture, named, article):
        self.tag, self.parent, self.furniture, self.named, self.article = tag, parent, furniture, named, article
        self.parts, self.size, self.net, self.digest = [tag], 0, 0, 0


def _marked(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Furniture by tag, role, class or id; and whether a class or id tells that a
    part of an article may be furniture."""
    named = False
    if tag in _FURNITURE or tag == "header" and not in_article:
        return True, False
    if attributes and tag not in ("html", "body", "article", "main"):
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            name = name.lower()
            if name == "role" and value in _ROLES or name == "aria-hidden" and value == "true":
                return True, False
            if name in ("class", "id"):
                words = set(re.split(r"[\s_-]+", value))
                named = named or not _NAMES.isdisjoint(words) or not _ADVERTS.isdisjoint(words)
                if named and not in_article or in_article and not _IN_ARTICLE.isdisjoint(value.replace("_", "-").split()):
                    return True, False
    return bool(attributes and _HIDDEN.search(_QUOTED.sub("", attributes))), named


def parse(text: str) -> tuple[Element, list[Element], list[tuple[Element, str]]]:
    """The root, the elements in page order, and the text runs with the element they
    stand in.  Unclosed and misnested tags are mended the way browsers do for
    these cases.  Where an open element is looked for, the stack is not walked:
    the places of open elements are kept by tag, so time is linear in the page."""
    root = Element("#", None, False, False, None)
    elements, runs, stack = [], [], [root]
    places: dict[str, list[int]] = {}  # of open elements, by tag
    fences = [0]
    at = 0

    def put(s: str) -> None:
        if s:
            top = stack[-1]
            runs.append((top, s))
            words = " ".join(s.split())
            top.parts.append(words)
            top.size += len(words)
            top.net += 0 if top.furniture else len(words)

    def close(i: int) -> None:
        while len(stack) > i:
            e = stack.pop()
            places[e.tag].pop()
            if e.tag in _FENCE:
                fences.pop()
            e.digest = xxhash.xxh64_intdigest("\x1f".join(e.parts)) - (1 << 63)
            e.parent.parts.append(str(e.digest))
            e.parent.size += e.size
            e.parent.net += e.net
            e.parts = None
            if e.tag not in _INLINE and e.tag not in _SILENT:
                runs.append((e.parent, " "))

    def close_last(tags, least: int) -> None:
        """Close the innermost open element of these tags, if it stands at ``least`` or further in."""
        i = max((places[t][-1] for t in tags if places.get(t)), default=0)
        if i and i >= least:
            close(i)

    n = len(text)
    while at < n:
        m = _TOKEN.search(text, at)
        if not m:
            put(text[at:])
            break
        put(text[at : m.start()])
        at = m.end()
        ending, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if ending:
            close_last((tag,), 0 if tag in _FENCE else fences[-1])
            if tag == "br" or tag == "p":
                runs.append((stack[-1], " "))
            continue
        if tag in _ENDS_P or tag in _ENDS_BEFORE:
            close_last(_ENDS_BEFORE.get(tag, ("p",)), fences[-1])
        if tag in ("body", "article", "main", "nav", "div", "header") and len(stack) > 1 and stack[-1].tag == "head":
            close(len(stack) - 1)
        parent = stack[-1]
        furniture, named = _marked(tag, attributes, parent.article is not None)
        e = Element(tag, parent, parent.furniture or furniture, named, None)
        e.article = parent.article or (e if tag in ("article", "main") else None)
        e.parts.append(" ".join(attributes.split()) if attributes else "")
        elements.append(e)
        if tag in _VOID:
            e.digest = xxhash.xxh64_intdigest("\x1f".join(e.parts)) - (1 << 63)
            parent.parts.append(str(e.digest))
            runs.append((parent, " ")) if tag in ("br", "hr") else None
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag in _FENCE:
            fences.append(len(stack))
        stack.append(e)
        if tag not in _INLINE and tag not in _SILENT:
            runs.append((parent, " "))
        if tag in _RAW:
            end = _RAW[tag].search(text, at)
            stop = end.start() if end else n
            put(text[at:stop])
            at = stop
    close(1)
    root.digest = xxhash.xxh64_intdigest("\x1f".join(root.parts)) - (1 << 63)
    return root, elements, runs


def _main(root: Element, elements: list[Element]) -> Element:
    """The article that holds most, or the whole page if there is none."""
    return max((e for e in elements if e.article is e and not e.furniture), key=lambda e: e.net, default=root)


def _countable(e: Element) -> bool:
    """Elements that may be template: blocks with text, but not the text blocks of
    an article unless their class or id tells."""
    if not e.size or e.tag in _INLINE or e.tag in ("html", "body", "article", "main", "head", "script", "style", "title"):
        return False
    return e.article is None or e.furniture or e.named or e.tag not in _TEXT_BLOCK


def subtree_hashes(text: str | None) -> tuple[list[int], int]:
    """Hashes of the subtrees that may be template, and the hash of the main block."""
    if not text:
        return [], 0
    root, elements, _ = parse(text)
    return sorted({e.digest for e in elements if _countable(e)}), _main(root, elements).digest


def main_text(text: str | None, template=frozenset()) -> str:
    """Text of the page's article without furniture and template subtrees."""
    if not text:
        return ""
    root, elements, runs = parse(text)
    whole = _main(root, elements).net
    gone = set()
    for e in elements:  # page order: parents first
        if e.furniture or e.parent in gone or e.digest in template and _countable(e) and not 2 * e.net > whole:
            gone.add(e)
    has_article = any(e.article is e and e not in gone for e in elements)
    out = [htmllib.unescape(s) if "&" in s else s for e, s in runs if e not in gone and (not has_article or e.article is not None and e.article not in gone)]
    return " ".join("".join(out).split())


def _pages(pages: DataFrame) -> DataFrame:
    host = host_of(F.col("url"))
    return pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64(host, "html").alias("page"))


def subtrees(pages: DataFrame) -> DataFrame:
    """host, page (hash of host and html), digest, main of every subtree that may be template."""
    ship(pages.sparkSession)

    def hashes(batches):
        for b in few_rows(batches):
            host, page, digest, main = [], [], [], []
            for h, p, t in zip(*(b.column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
                found, whole = subtree_hashes(t)
                host += [h] * len(found)
                page += [p] * len(found)
                digest += found
                main += [whole] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), *(pa.array(x, pa.int64()) for x in (page, digest, main))], ["host", "page", "digest", "main"])

    return _pages(pages).where("host <> ''").select("host", "page", "html").mapInArrow(hashes, "host string, page long, digest long, main long")


def host_templates(found: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host``, ``digest`` of the subtrees that recur: a row each, so a host of any size has room."""
    different = found.select("host", "digest", "main").distinct()
    return different.groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("host", "digest")


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def extract_main_text(pages: DataFrame, min_pages: int = MIN_PAGES, most_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Templates of up to ``most_broadcast`` bytes go to every task; beyond that each
    page's own template hashes are joined to it by the hash of the page, which no
    host can make hot.  The result is the same.

    Null and empty html gives the empty text, an empty table an empty result.
    Pages without a host have no template.  Repeated rows each get a row; they,
    and all pages with one article, count once for a template.  Of two articles
    with equal text lengths the first is the main one.  Pages of any length and
    depth are read whole in linear time; a task holds one at a time besides its
    batch.  Other columns of ``pages`` are not used.
    """
    found = written(subtrees(pages), "subtrees")
    templates = written(host_templates(found, min_pages), "templates")
    rows = _pages(pages)
    if templates.count() * 96 <= most_broadcast:  # counted before it is broadcast
        joined = rows.join(F.broadcast(templates.groupBy("host").agg(F.collect_list("digest").alias("template"))), "host", "left")
    else:
        part = F.pmod("page", F.lit(PARTS))
        dealt = templates.select("host", "digest", F.explode(F.expr(f"sequence(0L, {PARTS - 1}L)")).alias("part"))
        own = found.select("host", "digest", "page").distinct().withColumn("part", part).join(dealt, ["host", "digest", "part"])
        joined = rows.join(own.groupBy("page").agg(F.collect_list("digest").alias("template")), "page", "left")  # at most the subtrees of a page

    def extract(batches):
        for b in few_rows(batches):
            text = [main_text(t, frozenset(k or ())) for t, k in zip(b.column("html").to_pylist(), b.column("template").to_pylist(), strict=True)]
            columns = [b.column("page_id").cast(pa.int64()), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "template").mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))
