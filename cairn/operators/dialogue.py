"""Conversation memory and routing of questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.fields import time_bound
from cairn.operators.evaluation import overlap
from cairn.operators.lexical import terms
from cairn.operators.ranking import top_per_group


def last_turns(turns: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The last n turns of each conversation; turn_back counts from 1, the latest."""
    return top_per_group(turns, by, order, n, "turn_back")


def history(turns: DataFrame, by: Sequence[str], order: Sequence[str], text: str, n: int, part: Column) -> DataFrame:
    """Each turn with the n turns before it joined by `` | ``, oldest first; empty for the first turn.

    part is a value that never falls along the order (the day, say). Each part of a conversation is looked at alone,
    after the last n turns before it, which are gathered per part first: a conversation that holds a third of all
    turns is spread over as many tasks as it has parts. Null texts are left out of the history.
    """
    rows = turns.withColumn("_part", part).withColumn("_turn", F.lit(True))
    last = top_per_group(rows, [*by, "_part"], [F.col(c).desc() for c in order], n, "_back")
    last = last.groupBy(*by, "_part").agg(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_text")))).alias("_last"))
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(-n, -1)
    before = last.withColumn("_rows", F.slice(F.sort_array(F.flatten(F.collect_list("_last").over(w)), asc=False), 1, n))
    before = before.withColumn("_row", F.explode("_rows"))
    before = before.select(*by, "_part", *[F.col(f"_row.{c}").alias(c) for c in order], F.col("_row._text").alias(text), F.lit(False).alias("_turn"))
    both = rows.unionByName(before, allowMissingColumns=True)
    here = Window.partitionBy(*by, "_part").orderBy(*order)
    lags = [F.lag(text, k).over(here) for k in range(n, 0, -1)]
    return both.withColumn("history", F.concat_ws(" | ", *lags)).filter("_turn").drop("_part", "_turn")


#: Turns of one part of a conversation.
PART_TURNS = 64


def _parted(turns: DataFrame, by: Sequence[str], order: Sequence[str], span: Column) -> DataFrame:
    """The turns with their number in the conversation (_n, from 0) and part (_n div PART_TURNS).

    span is a value that never falls along the order (the day, say). Turns are counted per span and the counts summed
    up, so only a span's turns are sorted in one task.
    """
    rows = turns.withColumn("_span", span)
    key = [F.col(c).alias(f"_{i}") for i, c in enumerate([*by, "_span"])]
    n = rows.groupBy(*key).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*[f"_{i}" for i in range(len(by))]).orderBy(f"_{len(by)}").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate([*by, "_span"])]
    here = Window.partitionBy(*by, "_span").orderBy(*order)
    rows = rows.withColumn("_at", F.row_number().over(here) - 1).join(n, same).withColumn("_n", F.col("_before") + F.col("_at"))
    return rows.withColumn("part", F.floor(F.col("_n") / PART_TURNS).cast("bigint")).drop("_span", "_at", "_before", *[f"_{i}" for i in range(len(by) + 1)])


def history_parts(turns: DataFrame, by: Sequence[str], order: Sequence[str], text: str, span: Column) -> DataFrame:
    """Conversations in parts of PART_TURNS turns: by, part (from 0), history (texts joined by `` | ``, oldest first, nulls left out)."""
    p = _parted(turns, by, order, span).groupBy(*by, "part").agg(F.array_sort(F.collect_list(F.struct("_n", F.col(text).alias("t")))).alias("c"))
    return p.select(*by, "part", F.concat_ws(" | ", F.transform("c", lambda x: x["t"])).alias("history"))


def whole_history(turns: DataFrame, by: Sequence[str], order: Sequence[str], text: str, span: Column) -> DataFrame:
    """Each turn with everything said before it: its columns, part, history.

    history are the turns before it in its own part; all of history_parts with a smaller part number of the same
    conversation come before that. Parts are written once and referred to by number, so that nothing grows with the
    square of a conversation. Joined by `` | `` (blank ones left out) they are the whole history.
    """
    w = Window.partitionBy(*by, "part").orderBy("_n").rowsBetween(-PART_TURNS, -1)
    return _parted(turns, by, order, span).withColumn("history", F.concat_ws(" | ", F.collect_list(text).over(w))).drop("_n")


def route(question: Column) -> Column:
    """Where a question goes: web if it asks for what is current, keyword if it holds a code, graph if it asks how things relate, else vector."""
    return (
        F.when(time_bound(question), "web")
        .when(question.rlike("[A-Z]+[0-9]{4,}"), "keyword")
        .when(question.rlike("关系|影响|相连|relat|between"), "graph")
        .otherwise("vector")
    )


def depth(question: Column) -> Column:
    """How much is retrieved for a question: simple (3 results), medium (5 and 5, reranked) or complex (two hops), by its number of terms."""
    n = F.size(terms(question))
    return F.when(n <= 6, "simple").when(n <= 12, "medium").otherwise("complex")


def answered(questions: DataFrame, retrieved: DataFrame, least: float = 0.1, rounds: int = 2) -> DataFrame:
    """The adaptive loop over all questions at once: question, state, rounds_used, n_documents.

    questions: question. retrieved: question, round (from 0), text: what a retrieval gives for the question, and for
    its rewritings in later rounds. Each round grades the texts by the share of the question's terms they hold;
    with a relevant one the question is answered, else it is rewritten and tried again, up to ``rounds`` times, after
    which it is given up. Web questions are answered without retrieval. The state is a column; one join serves all rounds.
    """
    graded = retrieved.withColumn("ok", overlap("question", "text") >= least).groupBy("question", "round").agg(F.count_if("ok").alias("n"))
    first = graded.filter((F.col("n") > 0) & (F.col("round") <= rounds)).groupBy("question").agg(F.min(F.struct("round", "n")).alias("f"))
    q = questions.join(first, "question", "left")
    web = route(F.col("question")) == "web"
    state = F.when(web, "web").when(F.col("f").isNotNull(), "answered").otherwise("given up")
    used = F.when(web, 0).otherwise(F.coalesce(F.col("f.round"), F.lit(rounds)))
    return q.select("question", state.alias("state"), used.cast("int").alias("rounds_used"), F.when(web, 0).otherwise(F.coalesce("f.n", F.lit(0))).cast("bigint").alias("n_documents"))


def steps(loop: DataFrame) -> DataFrame:
    """The adaptive loop step by step, of what ``answered`` gives: question, step (from 1), node.

    Every question is routed; what isn't for the web is retrieved and graded, rewritten and tried again as often as it
    took, and generated from or given up.
    """
    nodes = lambda *n: F.array(*map(F.lit, n))
    again = F.flatten(F.array_repeat(nodes("retrieve", "grade", "rewrite"), F.col("rounds_used")))
    last = F.when(F.col("state") == "answered", "generate").otherwise("give_up")
    tried = F.concat(nodes("route"), again, nodes("retrieve", "grade"), F.array(last))
    path = F.when(F.col("state") == "web", nodes("route", "web_search", "generate")).otherwise(tried)
    return loop.select("question", F.posexplode(path).alias("step", "node")).select("question", (F.col("step") + 1).cast("bigint").alias("step"), "node")
