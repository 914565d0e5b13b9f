"""Tables on pages: merging those that run over pages, and leaving out empty ones."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.fields import RULE_ROW_AT_ONCE, clean_table, first_rule_only, normal_header, without_headings, without_prefix
from cairn.functions.text import squeeze, strip
from cairn.operators.ranking import top_per_group

# Words that make a cell a header or a total.
HEADER_WORDS = ["序号", "项目编码", "项目名称", "项目特征描述", "特征描述", "计量单位", "工程量", "金额", "综合单价", "合价", "col8", "col7"]
TOTAL_WORDS = ["合计", "本页小计", "小计"]
# Words that make a text beside a table worth more.
NOTE_WORDS = ["说明", "注", "适用范围", "定义", "条件", "备注"]
# The lines that head a table merged from several pages.
PAGES_LINE, PAGES_HEADING, STAGE_HEADING = "第{0}页表格（跨页合并）", "## 第{0}页表格（跨页合并）\n", "## 【{1} - 第{0}页】（跨页合并）\n"


def islands(pages: DataFrame, by: Sequence[str], page: str, order: Sequence[str], gap: int = 1) -> DataFrame:
    """The rows with the number of the run of consecutive pages they belong to within their group: island (from 1).

    A row goes on with the run if its page is 1 to ``gap`` after the row before; the same page again begins a new run.
    """
    w = Window.partitionBy(*by).orderBy(page, *order)
    step = F.col(page) - F.lag(page).over(w)
    new = F.when((step > 0) & (step <= gap), 0).otherwise(1)
    return pages.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def merged_tables(pages: DataFrame, by: Sequence[str], page: str, order: Sequence[str], text: Column, gap: int = 1) -> DataFrame:
    """One row per run of pages: the group, first_page, last_page, n_pages, pages (joined by commas), body (texts by line).

    A run is a table of a document, so what is gathered is bounded by the document's pages.
    """
    rows = islands(pages, by, page, order, gap).withColumn("t", text)
    one = F.array_sort(F.collect_list(F.struct(page, *order, F.col("t"))))
    g = rows.groupBy(*by, "island").agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count("*").alias("n_pages"), one.alias("rows"))
    pages_ = F.array_join(F.transform("rows", lambda r: r[page].cast("string")), ",")
    body = F.array_join(F.filter(F.transform("rows", lambda r: r["t"]), lambda t: F.length(t) > 0), "\n")
    return g.select(*by, "first_page", "last_page", "n_pages", pages_.alias("pages"), body.alias("body"))


def table_lines(content: Column) -> Column:
    """The lines of a text that are rows of a table in markdown."""
    return F.array_join(F.filter(F.split(content, "\n"), lambda x: strip(x).startswith("|")), "\n")


def table_chunks(pages: DataFrame) -> DataFrame:
    """What is stored of each table on a page: all columns, markdown (cleaned), chunk_text, chunk_content, group_id, n_rows.

    pages: page_idx (from 0), stage, headers, content. The text is made to be searched, the content to be shown; both
    begin with the stage, if there is one, and the page. Tables with equal headers and stage have one group_id.
    """
    stage, page = F.nullif("stage", F.lit("")), (F.col("page_idx") + 1).cast("string")
    md = clean_table(table_lines(F.col("content")))
    rows = pages.withColumn("markdown", md)
    text = F.concat_ws("\n", F.concat(F.lit("【"), stage, F.lit("】")), F.concat(F.lit("第"), page, F.lit("页表格")), "markdown")
    head = F.coalesce(F.concat(F.lit("## 【"), stage, F.lit(" - 第"), page, F.lit("页】\n")), F.concat(F.lit("## 第"), page, F.lit("页表格\n")))
    seed = F.concat(F.coalesce("headers", F.lit("")), F.lit("|"), F.coalesce("stage", F.lit("")))
    group_id = F.substring(F.md5(seed), 1, 12)
    return rows.withColumns({"chunk_text": text, "chunk_content": F.concat_ws("\n", head, "markdown"), "group_id": group_id, "n_rows": F.size(cells(F.col("markdown"))).cast("bigint")})


def nearby_texts(pages: DataFrame, key: str, most: int = 1200, best: int = 5, least: int = 50) -> DataFrame:
    """The text around the table of each page: key, description.

    pages: key, content. Lines above the first row of the table and below the last one are taken from the table
    outwards as long as they have at most ``most`` characters together, on either side; of these the ``best`` with a
    note word, then the nearer ones, the upper side first. Descriptions under ``least`` characters are left out, as
    are pages without a table.
    """
    line = pages.select(key, F.split("content", "\n").alias("lines")).withColumn("row", F.transform("lines", lambda x: strip(x).startswith("|")))
    line = line.filter(F.array_contains("row", True))
    first, last = F.array_position("row", True), F.size("row") - F.array_position(F.reverse("row"), True) + 1
    each = line.select(key, first.alias("first"), last.alias("last"), F.posexplode("lines").alias("i", "t")).withColumn("i", F.col("i") + 1)
    each = each.withColumn("t", strip("t")).filter((F.length("t") > 0) & ((F.col("i") < F.col("first")) | (F.col("i") > F.col("last"))))
    each = each.withColumn("side", F.when(F.col("i") < F.col("first"), 0).otherwise(1)).withColumn("far", F.when(F.col("side") == 0, F.col("first") - F.col("i")).otherwise(F.col("i") - F.col("last")))
    near = within_length(each, [key, "side"], ["far"], F.length("t"), most)
    note = F.lit(False)
    for w in NOTE_WORDS:
        note = note | F.col("t").contains(w)
    near = top_per_group(near.withColumn("note", note.cast("int")), [key, "side"], [F.col("note").desc(), F.col("far")], best)
    parts = F.array_sort(F.collect_list(F.struct("side", "rank", "t")))
    out = near.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("description"))
    return out.filter(F.length("description") >= least)


def merged_pages(chunks: DataFrame, gap: int = 1) -> DataFrame:
    """Table chunks that run over pages made one: one row per run, with everything of the first chunk that isn't merged.

    chunks: document_id, group_id, page_idx, chunk_id, stage, text, content, markdown, n_rows, bbox (array of four).
    Chunks of one document and group on consecutive pages (at most ``gap`` apart; the same page again begins a new run)
    are merged: text under a line with the stage and the pages, without the chunks' own marks; content under one
    heading, without the chunks' own; markdown with one rule row per page; n_rows summed; pages, n_pages; bbox the box
    around the first and the last. A blank group is never merged. Runs of one chunk stay as they are. What is
    gathered is bounded by the pages that one table covers.
    """
    by = ["document_id", "group_id"]
    lone = F.when(F.length(strip("group_id")) > 0, F.lit("")).otherwise(F.coalesce("chunk_id", F.lit("")))
    rows = islands(chunks.withColumn("lone", F.coalesce(lone, F.col("chunk_id"))), [*by, "lone"], "page_idx", ["chunk_id"], gap)
    kept = ["page_idx", "chunk_id", "stage", "text", "content", "markdown", "n_rows", "bbox"]
    g = rows.groupBy(*by, "lone", "island").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("c"))
    first, last = F.col("c")[0], F.element_at("c", -1)
    many, stage = F.size("c") > 1, F.nullif(first["stage"], F.lit(""))
    span = F.concat((first["page_idx"] + 1).cast("string"), F.lit("-"), (last["page_idx"] + 1).cast("string"))
    some = lambda f, clean: F.transform(F.filter("c", lambda x: F.length(x[f]) > 0), lambda x: clean(x[f]))
    line = lambda form: F.concat(*[{"{0}": span, "{1}": stage}.get(x, F.lit(x)) for x in re.split(r"(\{\d\})", form)])
    text = F.concat_ws("\n", F.concat(F.lit("【"), stage, F.lit("】")), line(PAGES_LINE), some("text", without_prefix))
    head = F.coalesce(line(STAGE_HEADING), line(PAGES_HEADING))
    content = F.concat_ws("\n\n", head, some("content", without_headings))
    markdown = F.concat_ws("\n\n", some("markdown", first_rule_only))
    box = F.array(*[(F.least if i < 2 else F.greatest)(first["bbox"][i], last["bbox"][i]) for i in range(4)])
    either = lambda merged, f: F.when(many, merged).otherwise(first[f])
    return g.select(
        *by, first["chunk_id"].alias("chunk_id"), first["page_idx"].alias("page_idx"), first["stage"].alias("stage"),
        either(text, "text").alias("text"), either(content, "content").alias("content"),
        either(F.coalesce(F.nullif(markdown, F.lit("")), first["markdown"]), "markdown").alias("markdown"),
        F.aggregate("c", F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x["n_rows"], F.lit(0))).alias("n_rows"),
        F.transform("c", lambda x: x["page_idx"]).alias("pages"), F.size("c").cast("bigint").alias("n_pages"),
        F.when(many & first["bbox"].isNotNull() & last["bbox"].isNotNull(), box).otherwise(first["bbox"]).alias("bbox"),
    )


def renumbered(chunks: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The chunks with their place in the document: chunk_index from 0, references to chunks of the same document kept in step by old_index."""
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def cells(markdown: Column) -> Column:
    """The cells of a table in markdown, row by row, rule rows left out."""
    rows = F.filter(F.transform(F.split(markdown, "\n"), strip), lambda r: r.startswith("|") & ~r.rlike(RULE_ROW_AT_ONCE))
    return F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(r, r"^\||\|$", ""), r"\|"), strip))


def effective(cell: Column) -> Column:
    """Whether a cell says something: not blank, dashes and dots, a header or a total."""
    t = strip(F.btrim(F.btrim(strip(cell), F.lit("|")), F.lit("-")))
    return (F.length(t) > 0) & ~t.rlike(r"^[-—·. ]+$") & ~t.isin(*HEADER_WORDS, *TOTAL_WORDS) & ~F.lower(F.replace(t, F.lit(" "), F.lit(""))).isin("col7", "col8")


def is_placeholder(table: Column) -> Column:
    """Whether a table (rows of cells, the first the header) holds no data.

    True without a body or cells, with less than 5 % of the cells filled, without an effective row, and without an
    effective cell in the feature column if there is one. Rows that share three or more and 60 % of the header's words
    (cells without white space) repeat it and, like rows with a total, hold no data; columns are counted on the whole
    header. A null table is a placeholder.
    """
    header, body = F.try_element_at(table, F.lit(1)), F.filter(table, lambda _, i: i > 0)
    word = lambda r: F.array_distinct(F.filter(F.transform(r, squeeze), lambda c: F.length(c) > 0))
    words = word(header)
    least = F.greatest(F.lit(3), F.floor(F.size(words) * 0.6))
    repeats = lambda r: (F.size(words) > 0) & (F.size(F.array_intersect(word(r), words)) >= least)
    totals = lambda r: F.arrays_overlap(r, F.array(*map(F.lit, TOTAL_WORDS)))
    data = F.filter(body, lambda r: ~repeats(r) & ~totals(r))
    at = F.filter(F.transform(header, lambda c, i: F.when(normal_header(c) == "feature_desc", i)), lambda i: i.isNotNull())
    filled = F.aggregate(body, F.lit(0), lambda s, r: s + F.size(F.filter(r, lambda c: F.length(c) > 0)))
    all_ = F.aggregate(body, F.lit(0), lambda s, r: s + F.size(r))
    no_row = ~F.exists(data, lambda r: F.exists(r, effective))
    no_feature = (F.size(at) > 0) & ~F.exists(data, lambda r: F.exists(at, lambda i: F.coalesce(effective(F.get(r, i)), F.lit(False))))
    return F.coalesce((F.size(body) == 0) | (all_ == 0) | (filled < all_ * 0.05) | no_row | no_feature, F.lit(True))


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Overlap of two boxes (x0, y0, x1, y1) by their union; a union of 0 or less counts as 1."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])
    union = area(a) + area(b) - w * h
    return w * h / F.when(union > 0, union).otherwise(1.0)


def within_length(rows: DataFrame, by: Sequence[str], order: Sequence[str], length: Column, most: int) -> DataFrame:
    """The first rows of each group whose lengths add up to at most ``most``, up to the first that goes beyond."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("total", F.sum(length).over(w)).filter(F.col("total") <= most)
