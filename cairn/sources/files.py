"""Reading files of several kinds, and writing results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Encodings in the order they are tried; the last one always succeeds.
ENCODINGS = ("utf-8", "gbk", "gb2312", "latin-1")


def files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """Files under a path as path, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive)).load(path).select("path", "content")


def suffix(path: Column) -> Column:
    """The lower-case ending of a path without its dot; empty if it has none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for raw in b.column("content").to_pylist():
            text = None
            for enc in ENCODINGS if raw is not None else ():
                try:
                    text = raw.decode(enc)
                    break
                except UnicodeDecodeError:
                    continue
            out.append(text)
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.string())], names=["path", "text"])


def texts(contents: DataFrame) -> DataFrame:
    """Contents (path, content) decoded by the first encoding that fits: path, text."""
    return contents.select("path", "content").mapInArrow(_decode, "path string, text string")


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, enc in zip(b.column("text").to_pylist(), b.column("encoding").to_pylist()):
            try:
                out.append(text.encode(enc) if text is not None else None)
            except (UnicodeEncodeError, LookupError, TypeError):
                out.append(text.encode())
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.binary())], names=["path", "content"])


def encoded(rows: DataFrame) -> DataFrame:
    """Rows (path, text, encoding) as contents: path, content. Where the encoding is unknown or lacks a character, UTF-8 is used."""
    return rows.select("path", "text", "encoding").mapInArrow(_encode, "path string, content binary")


def html_text(html: Column) -> Column:
    """What an HTML page says: scripts, styles and tags removed, entities of the markup itself resolved."""
    s = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return s


def key_value(line: Column, key: str) -> Column:
    """The value of a key in a line ``key: value, key: value``; null if it isn't there or is nan."""
    return F.nullif(F.nullif(F.regexp_extract(line, rf"(?:^|, ){key}: ([^,]*)", 1), F.lit("")), F.lit("nan"))


def tsv(spark: SparkSession, path: str, schema: str, null: str = "（NULL）") -> DataFrame:
    """A tab-separated table with a header; the null token and empty fields are null."""
    return spark.read.csv(path, schema=schema, sep="\t", header=True, nullValue=null)


def first_per_folder(paths: DataFrame, root: str, allowed: DataFrame | None = None) -> DataFrame:
    """The first path of each folder under ``root`` that is named by a number: folder, path. ``allowed`` (folder) keeps some of them only."""
    rows = paths.select(F.regexp_extract("path", rf"(?:^|/){root}/([0-9]+)/", 1).alias("folder"), "path").filter("folder <> ''")
    if allowed is not None:
        rows = rows.join(allowed.select("folder").distinct(), "folder", "left_semi")
    return rows.groupBy("folder").agg(F.min("path").alias("path"))


def chunk_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Chunk files (one JSON object per line with an array ``chunks``) with a row per chunk: the chunk's fields and document_id."""
    one = spark.read.json(path, schema=f"document_id string, chunks array<struct<{schema}>>")
    return one.select("document_id", F.explode("chunks").alias("c")).select("document_id", "c.*")


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The nodes (node) and edges (source, target) of a GraphML file."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "").schema(schema).load(path)
    return read("node", "id string").select(F.col("id").alias("node")), read("edge", "source string, target string")


def write_graphml(path: str, nodes: DataFrame, edges: DataFrame) -> None:
    """Nodes (node) and edges (source, target) as GraphML: files with a node or an edge per element under path/nodes and path/edges."""
    save = lambda df, tag, at: df.write.format("xml").option("rowTag", tag).option("rootTag", "graphml").option("attributePrefix", "_").save(f"{path}/{at}")
    save(nodes.select(F.col("node").alias("_id")), "node", "nodes")
    save(edges.select(F.col("source").alias("_source"), F.col("target").alias("_target")), "edge", "edges")


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV files with a header in which quotes are doubled and texts may hold line ends; with ``bom`` each begins with the mark that spreadsheets look for."""
    first, *rest = df.columns
    rows = df.select(F.col(first).alias("\ufeff" + first), *rest) if bom else df
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_csv wrote; a mark at the beginning is no part of the first value."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', enforceSchema=True)


def write_csv_per_group(df: DataFrame, path: str, by: str, optional: tuple[str, ...] = ()) -> list[str]:
    """One folder of CSV files per value of ``by``, rows without one left out; optional columns only if any row has a value.

    One aggregate decides about the optional columns before the write. Returns the columns written.
    """
    rows = df.filter(F.col(by).isNotNull())
    some = rows.agg(*[F.count_if(F.length(F.trim(F.col(c))) > 0).alias(c) for c in optional] or [F.lit(0).alias("none")]).first()
    cols = [c for c in df.columns if c not in optional or some[c]]
    rows.select(cols).write.mode("overwrite").partitionBy(by).option("header", True).option("escape", '"').csv(path)
    return cols
