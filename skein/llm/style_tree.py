"""Operator 2: main text of web pages by a site style tree.

Pages of a host are merged by their presentation paths (tags with every class, id and role, and what these tell of a
branch's part, from the root down; whole paths, hashed; numbers of three or more digits in names count as equal). A node's
importance is the entropy of its contents over the host's distinct pages; branches of low importance are removed from
each page. Within an article a prior speaks for a branch, which entropy overrides where about ten pages or more agree
almost wholly: its root is taken, so passages that many but not nearly all pages share stay. Elsewhere entropy decides
alone, and a branch seen once stays. Only branches that their presentation declares to be page furniture go whatever their
entropy: menus, advertisements and footers often differ on every page, so entropy cannot tell them from content.

A class, id or role declares furniture only as a whole name (site-header, cookie-banner), not by some part of it
(entry-header, has-sidebar, search-algorithms); inline elements may, too; a main element is the page's main part whatever
the names about it.

Defined results: a null or empty html gives an empty text; a page of any length is read whole, in time linear in it; a null url counts as a host of its own name ''; repeated
rows give a row each; an empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import arrow_map, small_batches, staged

#: A branch below this importance is removed.
THRESHOLD = 0.3
#: Pages that the prior of a branch within an article counts as.
PRIOR_PAGES = 4
#: Rows of the table of unimportant branches up to which it is broadcast (about 100 bytes each); beyond, a join by host.
BROADCAST_ROWS = 50_000
#: Numbers in names, as in post-1234, that tell one page from another.
SERIAL = re.compile(r"[0-9]{3,}")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements by their part in a page.
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp", "svg", "math", "object", "canvas", "audio", "video"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"))
FURNITURE = frozenset(("nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset", "option", "datalist", "head"))
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
CLOSES_P = frozenset(("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"))
ARTICLE = frozenset(("article", "main"))
NOISE_WORDS = frozenset((
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent",
    "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination",
    "popup", "promo", "promotion", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
))
#: Words that may stand beside those in a name without changing what it says, that leave no doubt at its end,
#: and that at its beginning tell of the page about it.
PLAIN_WORDS = frozenset((
    "area", "bar", "block", "bottom", "box", "btn", "button", "buttons", "col", "column", "container", "content", "desktop", "form", "global", "icon", "icons", "inner", "item", "items", "left", "link",
    "links", "list", "main", "mobile", "module", "outer", "page", "panel", "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "sticky", "text", "top", "unit", "wrap", "wrapper",
))
CERTAIN_WORDS = frozenset(("advert", "adverts", "advertisement", "breadcrumb", "breadcrumbs", "comments", "navbar", "newsletter", "pagination", "replies", "sidebar"))
ABOUT_WORDS = frozenset(("has", "with", "without", "no", "is", "show", "hide"))
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
#: What can still begin where no > follows.
UNENDED = re.compile(r"<!--|<!\[CDATA\[")
_CLOSE = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*>", re.I) for t in RAW}


@functools.lru_cache(50_000)
def is_noise(name: str) -> bool:
    """Whether a class, id or role declares furniture: as a whole, not because of any part of a longer name."""
    words = [w.lower() for w in SPLIT.split(name) if w]
    if not words or words[0] in ABOUT_WORDS:
        return False
    return words[-1] in CERTAIN_WORDS or any(w in NOISE_WORDS for w in words) and all(w in NOISE_WORDS or w in PLAIN_WORDS or w.isdigit() for w in words)


def _declared(attributes: str, inside: bool) -> tuple[list, bool]:
    """The names in a tag's attributes, and whether one of them declares furniture; a header within an article is none."""
    named = NAMED.findall(attributes) if attributes else []
    return named, any(is_noise(x) and not (inside and "header" in x.lower()) for _, a, b, c in named for x in (a or b or c).split())


@functools.lru_cache(50_000)
def _key(parent: str, tag: str, names: tuple[tuple[str, str], ...], role: int) -> str:
    """The key of a branch by that of its parent: as long for any depth, and never shared by branches of different role."""
    own = repr((parent, tag, [(k, SERIAL.sub("0", x)) for k, x in sorted(names)], role))
    return hashlib.blake2b(own.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def blocks(page: str) -> list[tuple[str, int, str]]:
    """(key of the presentation path, role, text) in page order. Role: 0 within an article, 1 neutral, 2 page furniture."""
    out: list[tuple[str, int, str]] = []
    stack: list[tuple[str, str, int, bool]] = []  # tag, path, role, within an article
    buffer: list[str] = []
    at, n, last = 0, len(page), page.rfind(">")

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                path, role = (stack[-1][1], stack[-1][2]) if stack else ("", 1)
                out.append((path, role, text))

    def pop(tags: tuple[str, ...] | str, floor: frozenset = ARTICLE | {"table", "ul", "ol", "div", "section", "body"}) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tags if isinstance(tags, str) else stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in floor:
                return

    while at < n:
        m = TOKEN.search(page, at) if at <= last else None
        if not m:
            rest = UNENDED.search(page, at)
            buffer.append(page[at : rest.start()] if rest else page[at:])
            if rest and rest[0] != "<!--":
                buffer.append(entities.escape(page[rest.end() :]))
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA["):
                buffer.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = _CLOSE[tag].search(page, at) if at <= last else None
                at = end.end() if end else n
            continue
        named, noise = _declared(attributes, bool(stack) and stack[-1][3])
        if tag in INLINE and (tag in VOID or not noise and not any(x[0] == tag for x in stack[-4:])):
            continue  # inline elements matter where they are furniture, or stand in one of their own name that is
        flush()
        if tag in VOID:
            continue
        if closing:
            if tag in ("body", "html"):
                stack.clear()
            else:
                pop(tag, frozenset(("article", "main", "body")) - {tag} if tag not in ("p", "li", "td", "th", "tr", "dt", "dd") else ARTICLE | {"table", "ul", "ol", "div", "section", "body"})
            continue
        if tag in CLOSES_P:
            pop(("p",))
        elif tag in CLOSED_BY:
            pop(CLOSED_BY[tag])
        _, path, role, inside = stack[-1] if stack else ("", "", 1, False)
        inside = inside or tag in ARTICLE
        if tag == "main" and not any(x[0] in FURNITURE for x in stack):
            role = 0  # whatever the names about it say, this is the page's main part
        elif role == 2 or tag in FURNITURE or tag == "header" and not inside or noise:
            role = 2 if tag not in ("body", "html") else role
        elif inside:
            role = 0
        if not attributes.endswith("/"):
            stack.append((tag, _key(path, tag, tuple((k.lower(), " ".join((a or b or c).split())) for k, a, b, c in named), role), role, inside))
    flush()
    return out


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


NODE = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("role", T.IntegerType()), T.StructField("content", T.LongType()), T.StructField("page", T.LongType())])


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def importance(pages: DataFrame) -> DataFrame:
    """host, path, importance: the merged style tree of every host, without declared furniture.

    A page that stands in several rows of a host counts once. Rows of (host, path, content, page) are made one where they
    arise, then counts are summed, so a host with a third of all pages is many keys.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in NODE}
            for host, page in zip(b["host"], b["html"], strict=True):
                own = _hash(page)
                joined: dict[tuple[str, int], list[str]] = {}
                for path, role, text in blocks(page):
                    if role == 2:
                        continue
                    joined.setdefault((path, role), []).append(text)
                for (path, role), texts in joined.items():
                    out["host"].append(host)
                    out["path"].append(path)
                    out["role"].append(role)
                    out["content"].append(_hash(" ".join(texts)))
                    out["page"].append(own)
            yield out

    styles = arrow_map(pages.select("host", "html"), rows, NODE).distinct().groupBy("host", "path", "content").agg(F.count("*").alias("c"), F.max("role").alias("role"))
    merged = styles.groupBy("host", "path").agg(F.max("role").alias("role"), F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m"))
    within = (PRIOR_PAGES + F.col("m") * F.sqrt(F.greatest(entropy, F.lit(0.0)))) / (PRIOR_PAGES + F.col("m"))
    weighed = F.when(F.col("role") == 0, F.coalesce(within, F.lit(1.0))).otherwise(F.coalesce(entropy, F.lit(0.5)))
    return merged.select("host", "path", weighed.alias("importance"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: each page without its branches of low importance."""
    small_batches(pages.sparkSession, 500)
    base = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html"), host_of(pages["url"]).alias("host"))
    low = staged(importance(base).where(F.col("importance") < THRESHOLD).groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("low")), "style")
    # the size is checked: a host's paths are few, hosts may be many
    few = (low.agg(F.sum(F.size("low")).alias("n")).first()["n"] or 0) <= BROADCAST_ROWS
    joined = base.join(F.broadcast(low) if few else low, "host", "left")
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            texts = []
            for page, cut in zip(b["html"], b["low"], strict=True):
                gone = set(cut or ())
                texts.append(" ".join(t for path, role, t in blocks(page) if role != 2 and path not in gone))
            yield {"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return arrow_map(joined.select("page_id", "url", "html", "low"), rows, schema)
