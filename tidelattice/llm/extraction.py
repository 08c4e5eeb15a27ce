"""Main text of web pages by equivalence classes of tokens over the pages of a host.

Tokens are tags and pieces of text with their path.  Tokens whose occurrence vectors over a
host's pages are equal form a class; large classes that most of the host's pages
have make its template.  On a page a class counts if its tokens stand in the
template's order and its span nests with those of the other classes; the text between template
tokens is in slots.  The template's element that stands once on a page and holds the most text in the least of it is the article's, whatever its name:
what is extracted are all slots in it, but for navigation, notices and the like inside.  On hosts with too few pages, and on pages that
lack the element, names of elements and classes decide, and text of the template goes where nothing says that it is an article's.
"""

from __future__ import annotations

import html as html_
import re
from collections import Counter
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?\]\]>"
    r"|<(?P<raw>script|style|textarea|noscript|template|iframe|svg|xmp|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[a-zA-Z/!?](?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r"|[^<]+|<",
    re.S | re.I,
)
NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"(?:\s)(class|id|role|itemprop|aria-label|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never an article's, and words of class, id and role that say the same.
ASIDE = frozenset("nav footer aside form head button select option menu dialog".split())
WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer ad ads advert adverts advertisement advertising banner sponsor sponsored promo"
    " cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup login share sharing social related recommended comments comment"
    " disqus pagination pager toolbar widget contentinfo complementary search alert".split()
)
#: Articles that are not the page's.
OTHERS = frozenset("comment comments reply ad ads advert advertisement sponsored promo related recommended teaser".split())
SPLIT = re.compile(r"[^a-z0-9]+")
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"br", "html", "body", "head", "title", "option", "select", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}


#: Lots of a host's pages where templates are too large for a broadcast.
LOTS = 16


class Block:
    """A run of text in one block.

    aside: the depth of the innermost element that is no article, 0 for none; header: in a header that is not an article's;
    main: in an article or main element; linked: characters in links.
    """

    __slots__ = ("path", "parts", "aside", "header", "main", "linked", "size")

    def __init__(self, path: str, aside: int, header: bool, main: bool):
        self.path, self.parts, self.aside, self.header, self.main, self.linked, self.size = path, [], aside, header, main, 0, 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _close(stack: list, names, stops) -> None:
    """Ends the nearest open element of these names, unless one of the stops is nearer."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in names:
            del stack[i:]
            return
        if stack[i][0] in stops:
            return


def parse(page: str) -> list:
    """The page's tokens in order: strings for tags of blocks (with their path), Block objects for text."""
    stack: list[tuple] = [("", "", 0, False, False)]  # name, path, aside, header, main
    tokens: list = []
    now = None
    for m in TOKEN.finditer(page):
        t = m.group()
        if t[0] != "<" or len(t) == 1:
            _, path, aside, header, main = stack[-1]
            if now is None:
                if not t.strip():
                    continue
                now = Block(path, aside, header, main)
                tokens.append(now)
            elif bool(now.aside) != bool(aside):  # an inline element that isn't shown or isn't text
                if aside:
                    continue
            now.parts.append(html_.unescape(t))
            now.size += len(t)
            if any(x[0] == "a" for x in stack[-4:]):
                now.linked += len(t)
            continue
        if m.group("raw") or t[1] in "!?":
            continue
        name = NAME.match(t)
        if not name:
            continue
        name = name.group(1).lower()
        if name == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        if name in BLOCK:
            now = None
        if t[1] == "/":
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), None)
            if at is None:
                continue
            if name in BLOCK:
                tokens.append(f"{stack[at][1]}/")
                del stack[at:]
            elif any(x[0] in BLOCK for x in stack[at + 1 :]):  # left open across blocks: it ends, they go on
                del stack[at]
            else:
                del stack[at:]
            continue
        if name in ENDS_P:
            _close(stack, {"p"}, BLOCK)
        if name in CLOSES:
            _close(stack, CLOSES[name], {"ul", "ol", "dl", "table", "select", "menu"})
        _, path, aside, header, main = stack[-1]
        label, depth = name, path.count(">") + 1
        for kind, *values in ATTRIBUTE.findall(t) if len(t) > len(name) + 3 else ():
            kind, value = kind.lower(), next((v for v in values if v), "").lower()
            if kind == "hidden" or kind == "style" and "display:none" in value.replace(" ", ""):
                aside = depth
            elif kind == "role" and value == "main" or kind == "itemprop" and value == "articlebody":
                main = True
            elif kind in ("class", "id", "role", "aria-label"):
                label += "." + value.replace(">", " ")
                if name == "article":  # one in which others speak says so with its first word
                    if any(SPLIT.split(x)[0] in OTHERS for x in value.split()):
                        aside = depth
                elif name not in ("html", "body", "main") and WORDS & set(SPLIT.split(value)):
                    aside = depth
        if name in ASIDE:
            aside = depth
        header = header or name == "header" and not main
        main = main or name in ("article", "main")
        here = f"{path}>{label}"
        if name in BLOCK:
            tokens.append(here)
        if name not in VOID and not t.endswith("/>"):
            stack.append((name, here, aside, header, main))
    return tokens


def _bits(value: str) -> int:
    return int.from_bytes(blake2b(value.encode("utf-8", "replace"), digest_size=8).digest(), "little") >> 1


_tag_bits = lru_cache(1 << 14)(_bits)  # a host's pages have few different ones


def key_of(token) -> int:
    """63 bits that are the same in every process."""
    return _tag_bits(token) if isinstance(token, str) else _bits(f"{token.path}#{token.text()}")


def text_sizes(tokens: list) -> dict[str, int]:
    """Characters outside of links below each path."""
    own: dict[str, int] = {}
    for x in tokens:
        if not isinstance(x, str):
            own[x.path] = own.get(x.path, 0) + x.size - x.linked
    out: dict[str, int] = {}
    for path, size in own.items():
        at = len(path)
        while at > 0:
            out[path[:at]] = out.get(path[:at], 0) + size
            at = path.rfind(">", 0, at)
    return out


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, part, times, place, chars): a row for each different token of a page; part stands for the page and how often it has the token, chars is the text below it."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                host, page = batch.column("host")[k].as_py(), batch.column("html")[k].as_py()
                tokens = parse(page)
                if not tokens:
                    continue
                keys, sizes = [key_of(x) for x in tokens], text_sizes(tokens)
                counts, first = Counter(keys), {}
                for i, x in enumerate(keys):
                    first.setdefault(x, i)
                number = batch.column("number")[k].as_py()
                parts = {n: int.from_bytes(blake2b(f"{number}:{n}".encode(), digest_size=8).digest(), "little", signed=True) for n in set(counts.values())}
                own = [parts[n] for n in counts.values()]
                chars = [sizes.get(tokens[i], 0) if isinstance(tokens[i], str) else 0 for i in first.values()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([host] * len(counts)), pa.array(list(counts), pa.int64()), pa.array(own, pa.int64()), *[pa.array(list(x), pa.int64()) for x in (counts.values(), first.values(), chars)]],
                    ["host", "token", "part", "times", "place", "chars"],
                )

    return pages.mapInArrow(run, "host string, token long, part long, times long, place long, chars long")


def templates(pages: DataFrame, share: float, least_pages: int, least_tokens: int) -> DataFrame:
    """(host, classes, region): equivalence classes of a host's template, each its tokens in order of their mean place, and the token of the element that holds the article (or null).

    A vector is two sums of 32 bits for each page and number of occurrences, so that pages that repeat count as often as they do.
    """
    halves = [F.sum(x.bitwiseAND(F.lit(0xFFFFFFFF))).alias(c) for c, x in (("low", F.col("part")), ("high", F.shiftrightunsigned("part", 32)))]
    vectors = occurrences(pages).groupBy("host", "token").agg(*halves, F.count("*").alias("n"), F.max("times").alias("times"), F.sum("place").alias("place"), F.sum("chars").alias("chars"))
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    frequent = vectors.join(hosts, "host").where(F.col("n") >= share * F.col("pages"))
    one = F.sort_array(F.collect_list(F.struct((F.col("place") / F.col("n")).alias("at"), "token", "times", "chars")))
    classes = frequent.groupBy("host", "low", "high", "n").agg(one.alias("c")).where(F.size("c") >= least_tokens)
    known = classes.groupBy("host").agg(F.sort_array(F.collect_list(F.col("c.token"))).alias("classes"), F.flatten(F.collect_list("c")).alias("all"))
    # the least of the elements that stand once and hold half of the text or more; of equal ones the innermost
    most = F.array_max(F.col("all.chars"))
    held = F.filter("all", lambda x: (x["times"] == 1) & (x["chars"] > 0) & (2 * x["chars"] >= most))
    best = F.array_min(F.transform(held, lambda x: F.struct(x["chars"].alias("chars"), (-x["at"]).alias("at"), x["token"].alias("token"))))
    return known.select("host", "classes", best["token"].alias("region"))


def template_tokens(keys: list[int], classes: list[list[int]]) -> set[int]:
    """Tokens of the classes that are valid on this page: ordered, and nested with the larger ones."""
    first: dict[int, int] = {}
    for i, x in enumerate(keys):
        first.setdefault(x, i)
    spans: list[tuple[int, int]] = []
    out: set[int] = set()
    for c in sorted(classes, key=lambda c: (-len(c), c)):
        at = [first[x] for x in c if x in first]
        if len(at) < len(c) or at != sorted(at):
            continue
        a, b = at[0], at[-1]
        if any(x < a < y < b or a < x < b < y for x, y in spans):
            continue
        spans.append((a, b))
        out.update(c)
    return out


def main_text(page: str, classes: list[list[int]], region: int | None = None) -> str:
    tokens = parse(page)
    keys = [key_of(x) for x in tokens] if classes else []
    fixed = template_tokens(keys, classes) if classes else set()
    path = tokens[keys.index(region)] if region in fixed else ""
    if path.count(">") > 2:  # an element of the body; html and body themselves tell nothing
        depth = path.count(">")
        slots = [x for x in tokens if not isinstance(x, str) and (x.path == path or x.path.startswith(path + ">")) and x.aside <= depth]
    else:
        blocks = [(x, k) for x, k in zip(tokens, keys or [0] * len(tokens), strict=True) if not isinstance(x, str) and not x.aside and not x.header]
        if any(x.main for x, _ in blocks):
            slots = [x for x, _ in blocks if x.main]
        else:
            blocks = [(x, k) for x, k in blocks if 2 * x.linked < x.size]
            slots = [x for x, k in blocks if k not in fixed] or [x for x, _ in blocks]
    return " ".join(x for x in (b.text() for b in slots) if x)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(
    pages: DataFrame, share: float = 0.8, least_pages: int = 5, least_tokens: int = 3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = common.BROADCAST_BYTES
) -> DataFrame:
    """page_id, url, text for every row of pages.

    Templates go to all tasks if their measured size is at most broadcast_bytes, so that no page is shuffled; larger
    ones meet the pages in a join by host and lot, with the same result.

    Blocks are in page order, joined by one space, white space inside one made a
    space and character references decoded.  A null html is an empty page; a page with a null
    url, or one without a host, shares the host ''; a null id and repeated rows are rows like any other (repeats count as pages
    of their own).  An empty table gives no rows.  Hosts with fewer than least_pages pages
    have no template; there the elements alone decide.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    ).withColumn("host", host_of(F.col("url")))
    rows = rows.withColumn("number", F.xxhash64("page_id", "url", "html"))
    # stored, so that its size is known and a hot host's pages are not bound to the partitioning of the templates
    known = common.stored(templates(rows, share, least_pages, least_tokens).withColumnRenamed("host", "_host"))
    size = F.octet_length("_host") + 72 + F.aggregate("classes", F.lit(0), lambda n, c: n + 8 * F.size(c) + 32)
    small = common.is_small(known, size, broadcast_bytes)
    if small:
        known = F.broadcast(known)
    else:  # each host's pages in as many lots
        rows = rows.withColumn("_lot", F.pmod("number", F.lit(LOTS)).cast("int"))
        known = known.withColumn("_known_lot", F.explode(F.sequence(F.lit(0), F.lit(LOTS - 1))))

    def run(batches):
        for batch in batches:
            known_ = zip(batch.column("classes").to_pylist(), batch.column("region").to_pylist(), strict=True)
            out = [main_text(page.as_py(), c or [], r) for page, (c, r) in zip(batch.column("html"), known_, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    same = F.col("host") == F.col("_host")
    joined = rows.join(known, same if small else same & (F.col("_lot") == F.col("_known_lot")), "left").select("page_id", "url", "html", "classes", "region")
    return joined.mapInArrow(run, "page_id long, url string, text string")


def op4_template_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(common.table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
