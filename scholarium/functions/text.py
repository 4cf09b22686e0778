"""Column expressions over strings. All are built-in functions; none sees more than its own row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space at either end, as text processing outside SQL strips it.
_ENDS = r"(?U)^\s+|\s+$"
#: A word boundary whose word characters are letters, digits and _ of every script, superscripts apart.
_W = r"[\p{L}\p{N}_]"
BOUNDARY = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, also where f uses it inside a lambda, which would compute it for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _ENDS, "")


def title_key(title: Column) -> Column:
    """Lower case, letters a-z and digits only: what titles are compared by. Null gives an empty key."""
    return F.regexp_replace(F.lower(text_or_empty(title)), "[^a-z0-9]", "")


def dedupe_key(title: Column) -> Column:
    return F.substring(title_key(title), 1, 120)


def year(value: Column) -> Column:
    """A year from any text or number, truncated toward zero; null for what is no finite number."""
    s = strip(value.cast("string"))
    plain = F.regexp_replace(s, "(?<=[0-9])_(?=[0-9])", "")
    number = F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))
    return number.try_cast("int")


def citations(value: Column) -> Column:
    return F.coalesce(year(value), F.lit(0))


def truth(value: Column) -> Column:
    """True for the boolean or the word, in any case."""
    return F.coalesce(F.lower(value.cast("string")) == "true", F.lit(False))


def clean_title(title: Column) -> Column:
    return strip(F.replace(text_or_empty(title), F.lit("\\n"), F.lit(" ")))


def doi_display(doi: Column) -> Column:
    """Without the resolver's address; letters keep their case."""
    return F.replace(text_or_empty(doi), F.lit("https://doi.org/"), F.lit(""))


def doi_key(doi: Column) -> Column:
    """What DOIs are matched by: lower case, stripped; an address before it stays."""
    return strip(F.lower(text_or_empty(doi)))


def id_tail(identifier: Column) -> Column:
    return F.element_at(F.split(text_or_empty(identifier), "/"), -1)


def unique_id(doi: Column) -> Column:
    return F.when(doi != "", F.concat(F.lit("paper:"), doi)).otherwise("")


def first_names(authors: Column, most: int = 6) -> Column:
    return F.slice(F.transform(authors, lambda a: a["name"]), 1, most)


def restore_abstract(index: Column, most: int = 1500) -> Column:
    """Text from a map of words to their positions; of several words at one position the last entry's stays."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))
    ordered = F.array_sort(F.coalesce(places, F.array().cast("array<struct<p:int,i:int,w:string>>")))
    last = let(ordered, lambda o: F.filter(o, lambda x, n: (n == F.size(o) - 1) | (F.get(o, n + 1)["p"] != x["p"])))
    return F.substring(F.array_join(F.transform(last, lambda x: x["w"]), " "), 1, most)


# The patterns of what goes.
def clean_chunk(text: Column) -> Column:
    t = F.regexp_replace(text_or_empty(text), r"!\[\]\([^)]*\)", "")
    t = F.regexp_replace(t, "[ \t]*\n[ \t]*", "\n")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def looks_chinese(text: Column) -> Column:
    return text_or_empty(text).rlike(r"[一-鿿]")


def vector_text(title: Column, abstract: Column) -> Column:
    return strip(F.concat(text_or_empty(title), F.lit(". "), F.substring(text_or_empty(abstract), 1, 1500)))


# Fixed value: the pattern of an image's mark.
def drop_image_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"!\[\]\(images/[^)]+\)", "")


def drop_thoughts(text: Column) -> Column:
    return strip(F.regexp_replace(text_or_empty(text), "(?s)<think>.*?</think>", ""))


# Fixed value: what names of supplements have in common.
SUPPLEMENT = r"(?i)suppmat|supp\b|supporting|supplement|-si-|_si_|\bsi\.pdf|appendix|moesm|_esm\b|electronic.?supplementary"


def is_supplement_name(name: Column) -> Column:
    return text_or_empty(name).rlike(SUPPLEMENT)


def is_supplement_title(title: Column) -> Column:
    t = strip(text_or_empty(title))
    return is_supplement_name(t) | (F.upper(t) == "SI")


def is_full_text_title(title: Column) -> Column:
    return F.lower(strip(text_or_empty(title))) == "full text pdf"


# What goes of a page, in this order.
def html_body(page: Column) -> Column:
    """Page without images, styles, scripts and tags, in this order; references stay as they are."""
    drops = ((r"<img[^>]*>", ""), (r"(?s)<style.*?</style>", ""), (r"(?s)<script.*?</script>", ""), (r"<[^>]+>", " "))
    return reduce(lambda t, d: F.regexp_replace(t, d[0], d[1]), drops, text_or_empty(page))


# Units of measured numbers, and the parts that a report should have.
UNITS = "%|nm|μm|um|mm|cm|kPa|MPa|GPa|Pa·s|°C|℃|K|g/mol|kJ|mol|wt%|s⁻¹|Hz|min|h"
SECTIONS = ["导读", "引言", "结果", "讨论", "机理", "总结", "文献信息"]


def report_metrics(page: Column) -> dict[str, Column]:
    """Characters apart from white space, figures, measured numbers and parts of a report page."""
    body = html_body(page)
    return {
        "chars": F.length(F.regexp_replace(body, r"(?U)\s+", "")),
        "figures": F.regexp_count(text_or_empty(page), F.lit("<img")),
        "numbers": F.regexp_count(body, F.lit(rf"(?U)\d+(?:\.\d+)?\s*(?:{UNITS})(?-U:{BOUNDARY})")),
        "sections": reduce(lambda a, b: a + b, [F.contains(body, F.lit(s)).cast("int") for s in SECTIONS]),
    }


def four_grams(c: Column) -> Column:
    pieces = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 3), lambda i: F.substring(t, i, F.lit(4))))
    return let(c, lambda t: F.when(F.length(t) >= 4, pieces(t)).otherwise(F.array().cast("array<string>")))


def overlap(a: Column, b: Column) -> Column:
    """Share of the smaller set of four-letter pieces that the other has too; 0 for shorter texts."""
    x, y = four_grams(a), four_grams(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.least(F.size(x), F.size(y)), F.lit(0)), F.lit(0.0))


def json_text(text: Column) -> Column:
    """The JSON in a model's answer, as text: without code fences, or else from its first to its last brace; null if neither
    is JSON."""
    t = strip(F.regexp_replace(strip(text_or_empty(text)), "(?dm)^```(?:json)?|```$", ""))
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(t).isNotNull(), t).when(F.try_parse_json(inner).isNotNull(), inner)


def lenient_json(text: Column) -> Column:
    """Variant from a model's answer: code fences go, and if the rest is no JSON its outermost braces are tried; else null."""
    t = strip(F.regexp_replace(strip(text_or_empty(text)), "(?dm)^```(?:json)?|```$", ""))
    return F.coalesce(F.try_parse_json(t), F.try_parse_json(F.regexp_extract(t, r"(?s)\{.*\}", 0)))


# Fixed value: the pattern of the phrase.
def instrument_name(paragraph: Column) -> Column:
    """The leading phrase before a colon or bracket, if it is 3 to 59 characters long; else empty."""
    name = strip(F.regexp_extract(paragraph, r"^\s*([A-Za-z][^:：(]{2,60}?)\s*[:：(]", 1))
    return F.when((F.length(name) > 2) & (F.length(name) < 60), name).otherwise("")


def query_line(line: Column) -> Column:
    """Without list marks at its head (a leading digit goes too) and without quotes anywhere."""
    return strip(F.translate(F.regexp_replace(strip(text_or_empty(line)), r"(?U)^[-*\d.)\s]+", ""), '"“”', ""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
