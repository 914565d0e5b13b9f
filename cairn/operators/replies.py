"""Reading what models answer: event streams, extraction records and prompts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.fields import clean_attribute, in_parentheses
from cairn.functions.text import strip

# The marks of the extraction format.
FIELD, RECORD, COMPLETE = "<|>", "##", "<|COMPLETE|>"


def answers(lines: DataFrame, by: Sequence[str], order: str = "n", line: str = "line") -> DataFrame:
    """The answer of each stream: the ``answer`` fields of its data lines put together in order.

    Lines that aren't data, the end mark and data that isn't JSON add nothing; a stream with nothing else gives no row.
    """
    data = lines.filter(F.col(line).startswith("data: ") & (F.col(line) != "data: [DONE]"))
    piece = F.get_json_object(F.regexp_replace(F.col(line), "^data: ", ""), "$.answer")
    parts = data.select(*by, F.col(order).alias("o"), piece.alias("p")).filter("p is not null")
    joined = F.array_sort(F.collect_list(F.struct("o", "p")))
    return parts.groupBy(*by).agg(F.array_join(F.transform(joined, lambda x: x["p"]), "").alias("answer"))


def records(replies: DataFrame, key: str, reply: str = "reply") -> DataFrame:
    """Entities and relations that replies list: key, kind, first, second, third, fourth, weight.

    A reply is split at the record and end marks, the text in parentheses of each record at the field mark. A record
    counts as an entity with a name and three or more further parts, as a relation with two different ends and five
    or more parts; a weight that isn't a number is 1. Everything else is left out.
    """
    marks = "|".join("\\Q" + m + "\\E" for m in (RECORD, COMPLETE))
    one = replies.select(key, F.explode(F.split(reply, marks)).alias("r")).select(key, in_parentheses("r").alias("r")).filter("r <> ''")
    f = F.transform(F.split("r", "\\Q" + FIELD + "\\E"), clean_attribute)
    one = one.select(key, f.alias("f")).withColumn("kind", F.lower(F.element_at("f", 1)))
    at = lambda n: F.try_element_at("f", F.lit(n))
    entity = (F.col("kind") == "entity") & (F.size("f") >= 4) & (at(2) != "")
    relation = (F.col("kind") == "relationship") & (F.size("f") >= 5) & (at(2) != "") & (at(3) != "") & (at(2) != at(3))
    weight = F.when(F.col("kind") == "relationship", F.coalesce(F.expr("try_cast(try_element_at(f, 6) as double)"), F.lit(1.0)))
    return one.filter(entity | relation).select(key, "kind", at(2).alias("first"), at(3).alias("second"), at(4).alias("third"), at(5).alias("fourth"), weight.alias("weight"))


def prompt(template: str) -> Column:
    """A template with {column} places filled from the row; null if one of them is null."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.col(p) if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def keywords_of(reply: Column | str, field: str) -> Column:
    """A list of non-blank strings from a JSON reply; empty where it isn't one."""
    parsed = F.from_json(F.get_json_object(reply, "$." + field), "array<string>")
    return F.filter(F.coalesce(parsed, F.array().cast("array<string>")), lambda x: F.length(strip(x)) > 0)


def score_in(reply: Column | str, name: str, flags: Sequence[str]) -> Column:
    """The score a judge's JSON reply gives: ``<name>_score``, else ``<name>``, else 1 or 0 of the first flag that it has; null if it has none."""
    number = lambda key: F.get_json_object(reply, f"$.{key}").try_cast("double")
    flag = lambda key: F.get_json_object(reply, f"$.{key}").try_cast("boolean").cast("int").cast("double")
    return F.coalesce(number(f"{name}_score"), number(name), *map(flag, flags))
