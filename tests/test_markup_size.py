"""Markup queries over tables with more keys than SQL leaves between kinds, and over tables that lie in one file."""

import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from cinelake import plans
from cinelake.functions import wikitext as w
from cinelake.plans import markup
from cinelake.plans._base import Tables
from test_queries import FOLDER, key


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """Parts with keys that are pages of persons, series, seasons, franchises, or whose graph ids would be, if kinds were a million apart."""
    folder = tmp_path_factory.mktemp("far")
    c = duckdb.connect()
    for t in ("supplier", "customer", "nation", "region"):
        shutil.copy(f"{FOLDER}/{t}.parquet", folder)
    keys = [k for m in range(8) for k in range(m * markup.MANY, m * markup.MANY + 12)]
    c.execute(f"COPY (SELECT k AS p_partkey, p.* EXCLUDE p_partkey FROM (SELECT unnest({keys}) AS k) JOIN '{FOLDER}/part.parquet' p ON p_partkey = k % 97) TO '{folder}/part.parquet' (FORMAT parquet)")
    for t in ("part", "supplier", "customer", "nation", "region"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), c


@pytest.mark.parametrize("name", ["j10_identifiers", "j8_members", "b8_episodes", "x6_people"])
def test_kinds_keep_apart(spark, far, name):
    folder, duck = far
    df = plans.QUERIES[name](spark, folder)
    found = duck.execute(plans.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=key) == sorted(found.fetchall(), key=key)


def tasks(df):
    return df.select(F.spark_partition_id().alias("task")).distinct().count()


@pytest.mark.parametrize("name", ["f16_templates", "f22_people", "f23_items", "f24_links", "f25_trim", "f27_tables", "f28_dates", "f30_life_dates", "f31_air_dates", "f32_production_codes", "f43_merged_people", "f44_file_names"])
def test_scanners_read_one_file_in_many_tasks(spark, name):
    assert tasks(plans.QUERIES[name](spark, FOLDER)) >= 8


def test_articles_of_one_file_are_recognised_in_many_tasks(spark):
    """And their texts are made there: what is dealt out are the tables' rows."""
    found = markup._claims(Tables(spark, FOLDER))
    assert tasks(found.where("kind = 'movie'")) >= 8
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Scan parquet" in line or "Exchange" in line or "Filter" in line or "Project" in line]
    below = [line for a, line in zip(dealt, dealt[1:]) if "Exchange" in a]
    assert below and not any("Infobox" in line for line in below)


def test_entries_that_are_remembered_stay_as_they_are():
    for read in (w.people, w.links):
        first = read("[[Ann|A]] (note)")
        first[0]["name"] = "changed"
        assert read("[[Ann|A]] (note)")[0]["name"] in ("A", "A (note)")
        assert read("") == []


def test_parameters_between_tables():
    assert w.parameters("a|{|b|c|}|d") == ["a", "{|b|c|}", "d"]
    assert w.parameters("a|{{b|c|}}|d|}e") == ["a", "{{b|c|}}", "d", "}e"]
