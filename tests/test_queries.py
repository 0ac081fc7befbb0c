"""Each registered query against its SQL, on the smallest tables."""

import glob

import duckdb
import pytest

import __spark_entry__ as entry
from cinelake import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {f.rpartition('/')[2][:-8]} AS SELECT * FROM '{f}'")
    return c


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    rows = sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=key)
    if name not in plans.ORACLES:
        assert rows
        return
    found = duck.execute(plans.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert rows == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_stay_in_the_jvm(spark):
    """Filters reach the scan, and no Python runs in these plans."""
    import re

    for name in ("q1_fuzzy_part", "j7_semi_union", "a9_filmography", "f19_clean_html", "r1_table_digest", "v2_cosine_topk"):
        plan = plans.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name
    plan = plans.QUERIES["j18_orphans"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "CartesianProduct" not in plan
    plan = plans.QUERIES["ext_pricing_summary"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(l_shipdate" in plan


def test_navigation_sees_the_surveys_neighbourhoods(spark):
    """V13 takes the nearest 3000 (here: all 499 others), V7 the nearest min(150, n / 3)."""
    import numpy as np

    from cinelake.operators import vectors as v

    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding")
    near = v.similar(rows, "vec_id", "embedding", 5, 10_000).collect()
    assert len(near) == 499
    vectors = dict(map(tuple, rows.collect()))
    places = v.poles(np.array([vectors[r.vec_id] for r in near]), 6)
    assert [r.vec_id for r in plans.QUERIES["v13_poles"](spark, FOLDER).orderBy("pole").collect()] == [near[p].vec_id for p in places]
    view = v.Explorer.at(rows, "vec_id", "embedding", 5, neighbourhood=150).view(35)
    found = plans.QUERIES["v7_explore"](spark, FOLDER).where("view = 'start'").collect()
    assert {(r.vec_id, r.x, r.y) for r in found} == {(i, float(x), float(y)) for i, _, x, y in view.cells}
