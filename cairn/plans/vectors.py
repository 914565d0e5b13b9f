"""Queries of vector search (survey: T01, T04, P01, P02, P06, V01-V11, X03-X06, B05-B07) over embeddings.

The queries are every row whose vec_id is divisible by 20, searched for among all rows.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from cairn.functions.shared import checkpoint_dir
from cairn.operators import index as I
from cairn.operators import vectors as V
from cairn.plans.registry import registry
from cairn.sources.tables import table

QUERIES, SQL, query = registry()
#: Lists that a query probes, of ten. These vectors point in all directions alike, so nearly all lists hold some of the nearest.
PROBES = 9

_E = "e as (select vec_id as id, label, cast(embedding as double[]) as v from embeddings), q as (select * from e where id % 20 = 0)"
_TOP = "qualify row_number() over (partition by query_id order by score desc, id) <= {k}"
_RANKED = "select query_id, id, score, cast(row_number() over (partition by query_id order by score desc, id) as integer) as rank from"


def _rows(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("bigint").alias("grp"))
    return e.filter("id % 20 = 0"), e


def _sql(score: str, k: int, where: str = "true") -> str:
    return f"with {_E}, s as (select q.id as query_id, e.id, round({score}, 6) + 0.0 as score from q, e), f as (select s.* from s join e on e.id = s.id join q on q.id = s.query_id where {where}) {_RANKED} f {_TOP.format(k=k)}"


@query("T01_V01_top_ip", _sql("list_dot_product(q.v, e.v)", 10))
def _(spark, d):
    return V.nearest(*_rows(spark, d), 10)


@query("T01_V05_top_cosine", _sql("list_cosine_similarity(q.v, e.v)", 10))
def _(spark, d):
    return V.nearest(*_rows(spark, d), 10, "cosine")


@query("T01_V02_top_l2", _sql("-(list_distance(q.v, e.v) ** 2)", 10))
def _(spark, d):
    return V.nearest(*_rows(spark, d), 10, "l2")


@query("P06_P07_threshold", _sql("list_dot_product(q.v, e.v)", 25, "score >= 0.05"))
def _(spark, d):
    return V.nearest(*_rows(spark, d), 25, least=0.05)


@query("P02_P03_filtered_top", _sql("list_dot_product(q.v, e.v)", 10, "e.label = q.label"))
def _(spark, d):
    return V.nearest(*_rows(spark, d), 10, same_group=True)


@query("V04_normalized", "select vec_id, round(list_sum(list_transform(cast(embedding as double[]), lambda x: x * x)), 6) as squared, round(list_extract(cast(embedding as double[]), 1) / sqrt(list_sum(list_transform(cast(embedding as double[]), lambda x: x * x))), 6) as first from embeddings")
def _(spark, d):
    e = table(spark, d, "embeddings")
    v = F.col("embedding")
    return e.select("vec_id", F.round(V.dot(v, v), 6).alias("squared"), F.round(F.element_at(V.normalized(v), 1), 6).alias("first"))


_MULTI = f"""with {_E}, parts as (select id, v[1:32] as a, v[33:48] as b, v[49:64] as c from e),
    s as (select x.id as query_id, y.id, round(list_dot_product(x.a, y.a), 6) + 0.0 as sa, round(list_dot_product(x.b, y.b), 6) + 0.0 as sb, round(list_dot_product(x.c, y.c), 6) + 0.0 as sc from parts x, parts y where x.id % 20 = 0),
    r as (select *, row_number() over (partition by query_id order by sa desc, id) as ra, row_number() over (partition by query_id order by sb desc, id) as rb, row_number() over (partition by query_id order by sc desc, id) as rc from s),
    f as (select query_id, id, round(case when ra <= 50 then 0.5 * sa else 0 end + case when rb <= 50 then 0.3 * sb else 0 end + case when rc <= 50 then 0.2 * sc else 0 end, 7) as score from r where ra <= 50 or rb <= 50 or rc <= 50)
    {_RANKED} f {_TOP.format(k=10)}"""


@query("X05_V09_multi_vector", _MULTI)
def _(spark, d):
    q, e = _rows(spark, d)
    cut = lambda df, a, n: df.withColumn("vec", F.slice("vec", a, n))
    parts = [(V.nearest(cut(q, a, n), cut(e, a, n), 50), w) for a, n, w in ((1, 32, 0.5), (33, 16, 0.3), (49, 16, 0.2))]
    return V.fused(parts, 10)


@query("X03_T04_rerank", f"""with {_E}, s as (select q.id as query_id, e.id, round(list_dot_product(q.v[1:32], e.v[1:32]), 6) + 0.0 as s1, round(list_dot_product(q.v, e.v), 6) + 0.0 as score from q, e),
    f as (select * from s qualify row_number() over (partition by query_id order by s1 desc, id) <= 25) {_RANKED} f {_TOP.format(k=10)}""")
def _(spark, d):
    q, e = _rows(spark, d)
    first = V.nearest(q.withColumn("vec", F.slice("vec", 1, 32)), e.withColumn("vec", F.slice("vec", 1, 32)), 25)
    both = first.join(e.select("id", "vec"), "id").join(q.select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")), "query_id")
    return V.rerank(both, V.dot(F.col("qvec"), F.col("vec")), 10).select("query_id", "id", "score", "rank")


_LISTS = """m as (select label as list, i, round(avg(x), 9) as x from (select label, unnest(v) as x, generate_subscripts(v, 1) as i from e) group by 1, 2), c as (select list, list(x order by i) as cv from m group by 1)"""


@query("X04_probed_lists", f"""with {_E}, {_LISTS}, p as (select q.id as query_id, q.v, list from q, c qualify row_number() over (partition by q.id order by round(list_dot_product(q.v, cv), 6) desc, list) <= {PROBES}),
    f as (select query_id, e.id, round(list_dot_product(p.v, e.v), 6) + 0.0 as score from p join e on e.label = p.list) {_RANKED} f {_TOP.format(k=10)}""")
def _(spark, d):
    q, e = _rows(spark, d)
    return V.probed(q, e, V.centroids(e), PROBES, 10)


@query("X04_probed_recall")
def _(spark, d):
    q, e = _rows(spark, d)
    return V.recall_of(V.probed(q, e, V.centroids(e), PROBES, 10), V.nearest(q, e, 10))


#: Parts and centers of the product codes, candidates that are scored exactly; share of the trained lists that is probed.
CODE_PARTS, CODE_CENTERS, CANDIDATES, PROBED = 8, 256, 200, 0.65


def _coded(spark, d):
    q, e = _rows(spark, d)
    at = f"{checkpoint_dir(spark)}/codes-{uuid.uuid4().hex}"
    books = I.fit(e, CODE_PARTS, CODE_CENTERS)
    # the index is saved and loaded as it would be for later searches
    I.product_codes(e, books).write.parquet(at)
    return I.search_codes(q, spark.read.parquet(at), e, books, 10, CANDIDATES)


@query("X04_V08_K18_product_codes")
def _(spark, d):
    return _coded(spark, d)


@query("X04_V08_codes_recall")
def _(spark, d):
    q, e = _rows(spark, d)
    return V.recall_of(_coded(spark, d), V.nearest(q, e, 10))


def _trained(spark, d):
    q, e = _rows(spark, d)
    n = max(1, min(4096, math.isqrt(4 * e.count())))
    return I.search_lists(q, e, I.fit(e, 1, n)[0], math.ceil(n * PROBED), 10, 40)


@query("X04_trained_lists")
def _(spark, d):
    return _trained(spark, d)


@query("X04_trained_recall")
def _(spark, d):
    q, e = _rows(spark, d)
    return V.recall_of(_trained(spark, d), V.nearest(q, e, 10))


@query("V11_zero_shot", f"with {_E}, {_LISTS}, s as (select id, list, round(list_dot_product(v, cv), 6) as score from e, c) select id as vec_id, list as label, score from s qualify row_number() over (partition by id order by score desc, list) = 1")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("grp"))
    # the labels are few, and one list of scores per row holds them all: no row meets another
    c = V.centroids(e).agg(F.array_sort(F.collect_list(F.struct("grp", "vec"))).alias("c"))
    s = F.transform("c", lambda x: F.struct(F.round(V.dot(F.col("vec"), x["vec"]), 6).alias("score"), (-x["grp"]).alias("neg")))
    best = e.join(F.broadcast(c)).withColumn("best", F.array_max(s))
    return best.select(F.col("id").alias("vec_id"), (-F.col("best.neg")).alias("label"), F.col("best.score").alias("score"))
