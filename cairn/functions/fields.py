"""Scalar rules for names, keys, headers, chunks and replies. Null in, null out unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.text import strip

# Header names and the name each is kept under.
HEADER_NAMES = {
    "建筑面积": "area",
    "地上建筑面积": "area",
    "面积": "area",
    "层数": "floors",
    "檐高": "floors",
    "处理深度": "depth",
    "挖槽深度": "depth",
    "桩深": "depth",
    "桩径": "diameter",
    "工程量": "quantity",
    "计量单位": "unit",
    "单位": "unit",
    "项目名称": "item_name",
    "项目特征描述": "feature_desc",
    "特征描述": "feature_desc",
}
# Patterns of stage names, page prefixes and table rules in chunk texts.
STAGE_NAME = r"工程名称[:\s：]+([^\s，。；标]+(?:工程)?)"
STAGE_PREFIX = r"^【[^】]+】[ \t\n\r]*"
PAGE_PREFIX = r"^第[0-9]+页表格[ \t\n\r]*"
RULE_ROW = r"^\|[ \t]*:?-{3,}[ \t]*(\|[ \t]*:?-{3,}[ \t]*)+\|?$"
#: The same without going back: Java goes one call deeper for every cell otherwise, and rows may have any number of cells.
RULE_ROW_AT_ONCE = RULE_ROW.replace(")+", ")++")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_id(prefix: str, *parts: Column | str) -> Column:
    """A key made of what it stands for: the prefix and 16 hex digits of the md5 of the parts joined by a bar."""
    joined = F.concat(*[x for p in parts for x in (F.lit("|"), _col(p))][1:])
    return F.concat(F.lit(prefix), F.substring(F.md5(joined), 1, 16))


def ellipsized(c: Column | str, most: int) -> Column:
    """At most ``most`` characters, the last three of them dots if anything was cut."""
    return F.when(F.length(_col(c)) > most, F.concat(F.substring(_col(c), 1, most - 3), F.lit("..."))).otherwise(_col(c))


def clean_attribute(c: Column | str) -> Column:
    """Without outer white space, then double, then single quotes."""
    return F.btrim(F.btrim(strip(c), F.lit('"')), F.lit("'"))


def split_markers(c: Column | str, markers: Sequence[str]) -> Column:
    """The non-blank parts between any of the markers, stripped."""
    quoted = "|".join("\\Q" + m + "\\E" for m in markers)
    return F.filter(F.transform(F.split(_col(c), quoted), strip), lambda x: F.length(x) > 0)


def in_parentheses(c: Column | str) -> Column:
    """What stands between the first opening and the last closing parenthesis of a line; empty if there is none."""
    return F.regexp_extract(_col(c), r"\((.*)\)", 1)


def canonical(c: Column | str) -> Column:
    """Without white space and the punctuation that spellings of one name differ in."""
    return F.regexp_replace(strip(c), r"[ \t\n\r\x0B\f\x{00A0}\x{3000}:：、,，。;；()（）\-]+", "")


def normal_header(c: Column | str) -> Column:
    """A header in its kept form: white space folded, full-width punctuation narrowed, lower case, known names unified."""
    folded = F.regexp_replace(strip(c), r"[ \t\n\r\x0B\f\x{00A0}\x{3000}]+", " ")
    s = F.lower(F.translate(folded, "：（）", ":()"))
    names = F.create_map(*[F.lit(x) for kv in HEADER_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, s), s)


def stage_of(text: Column | str) -> Column:
    """The stage named in the first 1000 characters; empty if none is."""
    found = F.regexp_extract(F.substring(_col(text), 1, 1000), STAGE_NAME, 1)
    return F.regexp_replace(found, r"[，。；：:]+$", "")


def without_prefix(text: Column | str) -> Column:
    """A chunk text without its leading stage mark and page mark."""
    return strip(F.regexp_replace(F.regexp_replace(_col(text), STAGE_PREFIX, ""), PAGE_PREFIX, ""))


def without_headings(markdown: Column | str) -> Column:
    """Markdown without its lines that start with two or more number signs."""
    return strip(F.array_join(F.filter(F.split(_col(markdown), "\n"), lambda x: ~strip(x).startswith("##")), "\n"))


def first_rule_only(markdown: Column | str) -> Column:
    """A table in markdown with all rule rows after the first left out."""
    lines = F.split(_col(markdown), "\n")
    first = F.array_position(F.transform(lines, lambda x: strip(x).rlike(RULE_ROW_AT_ONCE)), True)
    kept = F.filter(lines, lambda x, i: ~strip(x).rlike(RULE_ROW_AT_ONCE) | (i + 1 == first))
    return F.array_join(kept, "\n")


def clean_table(markdown: Column | str) -> Column:
    """A table in markdown without blank lines and rows of empty cells; rule rows and other lines stay."""

    def empty(row: Column) -> Column:
        cells = F.split(F.btrim(strip(row), F.lit("|")), r"\|")
        bare = F.transform(cells, lambda p: strip(F.btrim(F.btrim(strip(F.regexp_replace(p, r"(?i)<br[ \t]*/?>", "")), F.lit("-")), F.lit("|"))))
        return F.forall(bare, lambda p: F.length(p) == 0)

    def keep(row: Column) -> Column:
        s = strip(row)
        return (F.length(s) > 0) & (~s.startswith("|") | s.rlike(RULE_ROW_AT_ONCE) | ~empty(row))

    return F.array_join(F.filter(F.split(_col(markdown), "\n"), keep), "\n")


def keyword_list(c: Column | str) -> Column:
    """The distinct non-blank keywords of a comma-separated list, sorted."""
    parts = F.transform(F.split(F.coalesce(_col(c), F.lit("")), ","), strip)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: F.length(x) > 0)))


def chunk_key(c: Column | str) -> Column:
    """A chunk id ``document-page-index`` taken apart; the document may hold hyphens itself. Nulls where it has another form."""
    form = r"^(.*)-(-?[0-9]+)-([0-9]+)$"
    part = lambda n: F.nullif(F.regexp_extract(_col(c), form, n), F.lit(""))
    return F.struct(part(1).alias("document_id"), part(2).cast("bigint").alias("page_idx"), part(3).cast("bigint").alias("chunk_index"))


def word_count(c: Column | str) -> Column:
    """How many parts white space divides a text into; 0 for a blank or null one."""
    s = strip(c)
    return F.when(F.coalesce(F.length(s), F.lit(0)) == 0, 0).otherwise(F.size(F.split(s, r"[ \t\n\r\x0B\f\x{00A0}\x{3000}]+"))).cast("bigint")


def preview(c: Column | str, most: int = 400) -> Column:
    """The first characters, followed by dots if there are more."""
    return F.when(F.length(_col(c)) > most, F.concat(F.substring(_col(c), 1, most), F.lit("..."))).otherwise(_col(c))


def time_bound(question: Column | str) -> Column:
    """Whether a question asks for what is current."""
    return _col(question).rlike("今天|最新|现在|today|latest|now")


def label_of(reply: Column | str) -> Column:
    """positive or negative as a reply names it, else null."""
    low = F.lower(_col(reply))
    return F.when(low.contains("positive"), "positive").when(low.contains("negative"), "negative")


def number_after(c: Column | str, word: str) -> Column:
    """The first number that follows a word within six other characters, as double; null if there is none."""
    return F.nullif(F.regexp_extract(_col(c), word + r"[^0-9]{0,6}([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")


def moment(c: Column | str) -> Column:
    """A time kept as text, day first by year, with dashes or slashes, with or without a time of day; null where it is none."""
    return F.translate(_col(c), "/T", "- ").try_cast("timestamp_ntz")


def average_of(c: Column | str, words: Sequence[str]) -> Column:
    """The mean of the numbers that follow the words in a reply; words without one don't count, null if there is none."""
    found = F.filter(F.array(*[number_after(c, w) for w in words]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda s, x: s + x) / F.size(found))


def first_label(reply: Column | str, labels: Sequence[str], noise: str) -> Column:
    """The first of the labels that a reply holds once ``noise`` is taken out of both; null if it holds none."""
    said = F.replace(_col(reply), F.lit(noise), F.lit(""))
    return F.coalesce(*[F.when(said.contains(x.replace(noise, "")), x) for x in labels])


def data_url(c: Column | str, mime: str = "text/plain") -> Column:
    """A text as a data URL."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.translate(F.base64(F.encode(_col(c), "UTF-8")), "\r\n", ""))


def repaired_json(reply: Column | str) -> Column:
    """The object in a reply as parsable JSON: what is around it, comments, escaped quotes and trailing commas removed."""
    s = F.regexp_extract(_col(reply), r"(?s)(\{.*\})", 1)
    s = F.regexp_replace(F.regexp_replace(s, r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    s = F.regexp_replace(s, r"\\([\"'])", "$1")
    return F.regexp_replace(s, r",[ \t\n\r]*([}\]])", "$1")
