"""Main text of web pages by line-block distribution.

A small helper strips a page's markup and what it marks as no text and cuts the
rest into blocks ("lines"). What follows is Spark: the lengths of lines, those
of links aside, are summed over windows of three; the text surges where a
window's sum reaches a threshold and dives where it falls below. The region with
the most text between surge and dive points is the article, whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import bound_batches

# Fixed values of HTML.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "title")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose text is read as prose.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
BOILERPLATE = frozenset("nav header footer aside form menu head dialog button select fieldset".split())
#: Words of a class, id or role that name something other than the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|complementary|contentinfo|cookies?|disqus|footer|header|masthead|menu|modal|"
    r"nav|navbar|navigation|newsletter|notices?|pagination|popup|promo|related|replies|search|share|sharing|sidebar|social|sponsored|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.IGNORECASE,
)
PARTS = re.compile(r"<!--.*?(?:-->|$)|<(" + "|".join(RAW) + r")\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*>|[^<]+|<", re.DOTALL | re.IGNORECASE)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)


def is_boilerplate(tag: str, attributes: str) -> bool:
    if tag in BOILERPLATE:
        return True
    if not attributes.strip() or tag in ("html", "body", "main", "article"):
        return False
    return bool(HIDDEN.search(attributes)) or any(MARKS.search("".join(m)) for m in NAMES.findall(attributes))


def blocks(page: str | None) -> list[tuple[str, int, int, bool]]:
    """The text blocks ("lines") outside boilerplate elements, in page order.

    Of each: its text, its length without links, the number of the outermost
    article or main element that it is in (0: none), and whether it is a
    heading or paragraph.
    """
    out: list[tuple[str, int, int, bool]] = []
    text: list[str] = []
    plain: list[str] = []  # what of the text is outside links
    in_link = False
    boxes, made = [0], 0  # open articles
    skipped: list[str] = []  # open elements from the boilerplate element on
    kind = ""

    def squeeze(pieces: list[str]) -> str:
        return " ".join(html.unescape("".join(pieces)).split())

    def end() -> None:
        if text:
            line = squeeze(text)
            if line:
                out.append((line, len(squeeze(plain)), boxes[1] if len(boxes) > 1 else 0, kind in PROSE))
        text.clear()
        plain.clear()

    def enter() -> None:
        nonlocal made
        made += 1
        boxes.append(made)

    def leave() -> None:
        if len(boxes) > 1:
            boxes.pop()

    for m in PARTS.finditer(page or ""):
        tag = (m[3] or "").lower()
        if not tag:
            piece = m[0]
            if not skipped and (piece[0] != "<" or piece == "<"):
                text.append(piece)
                plain.append(" " if in_link else piece)
            continue
        closing = bool(m[2])
        if skipped:
            if closing and tag in skipped:
                while skipped.pop() != tag:
                    pass
            elif closing and tag in ("body", "html", "article", "main"):
                skipped.clear()
                if tag in ("article", "main"):
                    leave()
            elif not closing and tag in BLOCK and tag not in VOID and not m[4].endswith("/"):
                if tag in ("article", "main") and not is_boilerplate("div", m[4]):  # what was to be left out has not been closed
                    skipped.clear()
                    end()
                    enter()
                elif tag not in ("p", "li", "dd", "dt", "td", "th", "tr", "option"):
                    skipped.append(tag)
            continue
        if tag in BLOCK:
            end()
            kind = "" if closing else tag
        elif tag == "br":
            text.append(" ")
            plain.append(" ")
        if not closing and tag not in VOID and not m[4].endswith("/"):
            # The header of an article itself holds its headline; a comment may be marked up as an article.
            nested = "div" if tag in ("article", "main") and len(boxes) > 1 else tag
            if not (tag == "header" and len(boxes) > 1) and is_boilerplate(nested, m[4]):
                end()
                skipped.append(tag)
                continue
        if tag in ("article", "main"):
            leave() if closing else enter()
        elif tag == "a":
            in_link = not closing
        if tag in BLOCK:
            in_link = False
    end()
    return out


LINE = "array<struct<text:string,weight:long,box:int,prose:boolean>>"


def blocks_udf():
    kind = pa.list_(pa.struct([("text", pa.string()), ("weight", pa.int64()), ("box", pa.int32()), ("prose", pa.bool_())]))

    @F.arrow_udf(LINE)
    def cut(pages: pa.Array) -> pa.Array:
        return pa.array([[{"text": t, "weight": w, "box": b, "prose": p} for t, w, b, p in blocks(x.as_py())] for x in pages], kind)

    return cut


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` reads it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def passing(lines: Column, window: int, threshold: int) -> Column:
    """Of each line its weight if it is between a surge and a dive point, else -1.

    The distribution is the sum of weights over the ``window`` lines from each
    line on; it surges where a sum reaches the threshold and dives where one
    falls below it. A line is in between if a window that it is in reaches it.
    """
    added = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, b: a + b["weight"])
    sums = F.transform(lines, lambda b, i: added(F.slice(lines, i + 1, F.lit(window))))
    near = lambda s, i: F.array_max(F.slice(s, F.greatest(i - window + 2, F.lit(1)), F.least(i + 1, F.lit(window))))
    return _let(sums, lambda s: F.transform(lines, lambda b, i: F.when(near(s, i) >= threshold, b["weight"]).otherwise(F.lit(-1).cast("long"))))


def heaviest_box(lines: Column, passed: Column) -> Column:
    """The box with the most text between surge and dive points; the first in a tie."""
    kind = "struct<box:int,mass:long,best:int,most:long>"
    rows = F.array_sort(F.zip_with(lines, passed, lambda b, w: F.struct(b["box"].alias("box"), F.greatest(w, F.lit(0)).alias("w"))))
    start = F.struct(F.lit(-1).alias("box"), F.lit(0).cast("long").alias("mass"), F.lit(0).alias("best"), F.lit(-1).cast("long").alias("most")).cast(kind)

    def add(acc: Column, row: Column) -> Column:
        mass = F.when(row["box"] == acc["box"], acc["mass"]).otherwise(0) + row["w"]
        more = mass > acc["most"]
        return F.struct(row["box"].alias("box"), mass.alias("mass"), F.when(more, row["box"]).otherwise(acc["best"]).alias("best"), F.greatest(mass, acc["most"]).alias("most")).cast(kind)

    return F.aggregate(rows, start, add, lambda acc: acc["best"])


def between_surge_and_dive(lines: Column, window: int, threshold: int) -> Column:
    """The lines of the text: from the first surge to the last dive point of the region with the most text.

    Where that is (mostly) in a marked article, the region reaches to the
    article's ends; else the headings and paragraphs right before and after
    belong to it too. Nothing in between is left out. A page without a surge keeps all lines that are not links alone.
    """
    last_true = lambda flags: F.size(flags) - F.array_position(F.reverse(flags), True) + 1
    span = lambda first, last: F.slice(lines, first.cast("int"), (last - first + 1).cast("int"))

    def marked(box: Column) -> Column:
        return _let(F.transform(lines, lambda b: b["box"] == box), lambda f: span(F.array_position(f, True), last_true(f)))

    def reach(first: Column, last: Column) -> Column:
        prose = F.transform(lines, lambda b: b["prose"] & (b["weight"] > 0) & (b["box"] == 0))
        before = _let(F.reverse(F.slice(prose, F.lit(1), (first - 1).cast("int"))), lambda p: F.when(F.array_position(p, False) == 0, F.size(p)).otherwise(F.array_position(p, False) - 1))
        after = _let(F.slice(prose, (last + 1).cast("int"), F.size(lines)), lambda p: F.when(F.array_position(p, False) == 0, F.size(p)).otherwise(F.array_position(p, False) - 1))
        return span(first - before, last + after)

    def unmarked(passed: Column) -> Column:
        flags = F.transform(passed, lambda w: w > 0)  # links at its ends are no part of it
        return _let(flags, lambda f: reach(F.array_position(f, True), last_true(f)))

    def chosen(passed: Column) -> Column:
        region = _let(heaviest_box(lines, passed), lambda box: F.when(box > 0, marked(box)).otherwise(unmarked(passed)))
        return F.when(F.array_max(passed) >= 0, region).otherwise(F.filter(lines, lambda b: b["weight"] > 0))

    return _let(passing(lines, window, threshold), chosen)


def extract(pages: DataFrame, *, html_col: str = "html", window: int = 3, threshold: int = 40) -> DataFrame:
    """Add ``text`` (the article) and ``n_chars`` (its code points) to all columns of ``pages``, replacing columns of these names.

    Elements that their names, classes, ids or roles mark as something other
    than text are stripped first. What is left is cut where the line-block
    distribution says (``between_surge_and_dive``).

    A null or empty page, or one of markup alone, gives an empty text. A page
    none of whose windows reaches the threshold keeps all its blocks with text
    outside links. Broken markup is read as far as it goes; text stays whole
    at any length. Repeated rows give the same text.
    """
    bound_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row") if keep else F.lit(None).alias("row")
    cut = pages.select(row, blocks_udf()(F.col(html_col)).alias("lines"))
    body = between_surge_and_dive(F.col("lines"), window, threshold)
    text = F.coalesce(F.array_join(F.transform(body, lambda b: b["text"]), "\n\n"), F.lit(""))
    made = cut.select("row", text.alias("text"))
    return made.select(*[F.col("row")[c].alias(c) for c in keep], "text", F.length("text").cast("long").alias("n_chars"))
