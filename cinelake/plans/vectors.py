"""Similarity, quantisation and taste over the embeddings table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.operators import vectors as v
from cinelake.plans._base import Tables, query

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


@query("SELECT CAST(i - 1 AS INTEGER) AS dim, min(embedding[i]) AS lo, max(embedding[i]) AS hi FROM embeddings, range(1, 65) r(i) GROUP BY i")
def a16_scale(t: Tables) -> DataFrame:
    return v.scale(t.embeddings, "embedding")


@query(
    f"""
WITH u AS (SELECT vec_id, embedding AS e, sqrt({_DOT.format(a='embedding', b='embedding')}) AS n FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / n)), 5) AS total FROM u"""
)
def v1_unit(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(F.aggregate(v.unit(F.col("embedding")), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(
    f"""
SELECT a.vec_id, round({_DOT.format(a='a.embedding', b='q.embedding')}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 3) q
WHERE a.vec_id <> 3 ORDER BY {_DOT.format(a='a.embedding', b='q.embedding')} DESC, a.vec_id LIMIT 20"""
)
def v2_cosine_topk(t: Tables) -> DataFrame:
    return v.similar(t.embeddings, "vec_id", "embedding", 3, 20).select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT label, count(*) AS n, count(*) FILTER (vec_id % 2 = 0) AS kept FROM embeddings GROUP BY label")
def v3_collection(t: Tables) -> DataFrame:
    e = t.embeddings
    kept, _ = v.collection(e, "vec_id", e.where("vec_id % 2 = 0").select("vec_id"))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(kept.groupBy("label").agg(F.count(F.lit(1)).alias("kept")), "label", "left").select("label", "n", F.coalesce("kept", F.lit(0)).alias("kept"))


@query(
    """
WITH x AS (SELECT vec_id, i AS dim, CAST(embedding[i] AS FLOAT) AS x FROM embeddings, range(1, 65) r(i)),
s AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM x GROUP BY dim),
q AS (SELECT vec_id, CAST(round(least(greatest(CAST(CAST(CAST(x - lo AS FLOAT) / CAST(hi - lo AS FLOAT) AS FLOAT) * CAST(255 AS FLOAT) AS FLOAT), 0), 255)) AS BIGINT) AS level FROM x JOIN s USING (dim))
SELECT vec_id, CAST(sum(level) AS BIGINT) AS total, min(level) AS lo, max(level) AS hi FROM q GROUP BY vec_id"""
)
def v4_quantise(t: Tables) -> DataFrame:
    lo, hi = v.scale_arrays(v.scale(t.embeddings, "embedding"))
    q = t.embeddings.select("vec_id", v.quantise(F.col("embedding"), lo, hi).alias("q"))
    return q.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_min("q").cast("long").alias("lo"), F.array_max("q").cast("long").alias("hi"))


@query(
    """
WITH x AS (SELECT i AS dim, CASE WHEN vec_id IN (1, 2, 3) THEN 1.0 WHEN vec_id IN (6, 7) THEN -0.60 ELSE -0.15 END * CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i) WHERE vec_id IN (1, 2, 3, 4, 5, 6, 7)),
m AS (SELECT dim, sum(x) AS x FROM x GROUP BY dim), n AS (SELECT sqrt(sum(x * x)) AS n FROM m)
SELECT CAST(dim - 1 AS INTEGER) AS dim, round(x / n, 6) AS x FROM m, n"""
)
def v12_taste(t: Tables) -> DataFrame:
    x = v.taste(t.embeddings, "vec_id", "embedding", [1, 2, 3], [4, 5], [6, 7])
    return t.spark.createDataFrame([(i, float(round(a, 6))) for i, a in enumerate(x)], "dim int, x double")


@query(
    """
WITH f AS (SELECT e.vec_id, e.label <= 4 AS h, e.label > 4 AS t, unnest(list_distinct([p_type, p_brand])) AS label FROM embeddings e JOIN part ON p_partkey = vec_id),
n AS (SELECT sum(CASE WHEN label <= 4 THEN 1.0 ELSE 0 END) AS a, sum(CASE WHEN label > 4 THEN 1.0 ELSE 0 END) AS b FROM embeddings JOIN part ON p_partkey = vec_id),
c AS (SELECT label, sum(CASE WHEN h THEN 1 ELSE 0 END) AS x, sum(CASE WHEN t THEN 1 ELSE 0 END) AS y FROM f GROUP BY label)
SELECT label, round(x / a, 6) AS share_here, round(y / b, 6) AS share_there FROM c, n WHERE x >= 2 AND x / a - y / b >= 0.001 ORDER BY x / a - y / b DESC, label LIMIT 3"""
)
def v14_ends(t: Tables) -> DataFrame:
    rows = t.embeddings.join(t.part, F.col("p_partkey") == F.col("vec_id"))
    out = v.contrast(rows, "vec_id", F.array("p_type", "p_brand"), F.col("label") <= 4, F.col("label") > 4, gap=0.001)
    return out.select("label", F.round("share_here", 6).alias("share_here"), F.round("share_there", 6).alias("share_there"))


@query()
def v7_explore(t: Tables) -> DataFrame:
    """A look around, a step, and another look."""
    walk = v.Explorer.at(t.embeddings.select("vec_id", "embedding"), "vec_id", "embedding", 5)
    seen = walk.view(35)
    after = walk.move("right", 35)
    rows = [("start", i, float(s), x, y) for i, s, x, y in seen.cells] + [("right", i, float(s), x, y) for i, s, x, y in after.cells]
    return t.spark.createDataFrame(rows, "view string, vec_id long, score double, x double, y double")


@query()
def v13_poles(t: Tables) -> DataFrame:
    near = v.similar(t.embeddings, "vec_id", "embedding", 5, 3000)
    found = near.join(t.embeddings, "vec_id").orderBy(F.desc("score"), "vec_id").select("vec_id", "embedding").collect()
    places = v.poles(np.array([r.embedding for r in found]), 6)
    return t.spark.createDataFrame([(i, found[p].vec_id) for i, p in enumerate(places)], "pole int, vec_id long")


@query()
def v6_compose(t: Tables) -> DataFrame:
    rows = t.embeddings.join(t.part, F.col("p_partkey") == F.col("vec_id"))
    genres = [r[0] for r in t.part.select("p_type").distinct().orderBy("p_type").collect()]
    out = v.compose(rows, "vec_id", "embedding", F.array("p_type"), F.lit("1990s"), genres, ["1980s", "1990s"])
    return out.select("vec_id", F.size("vector").alias("dims"), F.round(v.dot(F.col("vector"), F.col("vector")), 6).alias("norm"))


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda x: CAST(x AS FLOAT) < CAST(-0.1 AS FLOAT) OR CAST(x AS FLOAT) > CAST(0.15 AS FLOAT))) AS INTEGER) AS n_clamped FROM embeddings")
def v4_clamped(t: Tables) -> DataFrame:
    """Values of each vector beyond frozen bounds."""
    n = t.embeddings.select(F.size("embedding")).first()[0]
    return t.embeddings.select("vec_id", v.clamped(F.col("embedding"), [-0.1] * n, [0.15] * n).alias("n_clamped"))
