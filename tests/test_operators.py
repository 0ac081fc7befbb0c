"""Operators: diffs, routes, guards, releases, vectors, navigation, searches and views."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cinelake.operators import relational, release, search, serving, store, vectors
from cinelake.sources import records


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=str)


def table(spark, data):
    return spark.createDataFrame(data, "k long, a string, b double")


OLD = [(1, "x", 1.0), (2, None, None), (3, "z", 3.0), (4, None, None)]
NEW = [(1, "x", 2.0), (2, "now", None), (4, None, None), (5, None, None)]


def test_diff_and_apply(spark):
    a, b = table(spark, OLD), table(spark, NEW)
    d = relational.diff(a, b, ["k"])
    assert rows(d, "k", "op", "changed") == [(1, 1, ["b"]), (2, 1, ["a"]), (3, 2, None), (5, 3, None)]
    assert rows(relational.apply_diff(a, d, ["k"])) == rows(b)
    assert release.verify_patch(a, d, b, ["k"]) and not release.verify_patch(a, d.where("op = 1"), b, ["k"])
    assert rows(release.apply_chain(a, [d, relational.diff(b, a, ["k"])], ["k"])) == rows(a)


def test_digests(spark):
    a = table(spark, OLD)
    digest = lambda df: release.table_digest(df, df.columns).first()
    assert digest(a) == digest(a.orderBy(F.desc("k")).repartition(5))
    assert digest(a).digest != digest(table(spark, NEW)).digest and digest(a).rows == 4
    assert digest(a.unionByName(a)).digest != digest(a).digest
    kinds = [spark.createDataFrame([(v,)], t) for v, t in ((1, "v long"), ("1", "v string"), (None, "v long"), (1.0, "v double"))]
    assert len({digest(k).digest for k in kinds}) == 4
    assert digest(a.limit(0)).rows == 0
    assert release.ordered_digest(a, a.columns) == release.ordered_digest(a.repartition(3), a.columns)
    with pytest.raises(KeyError):
        release.digests({"new_table": a}, {})


@settings(max_examples=200, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_float_text_reads_back(v):
    assert float(release.short_float(v)) == v


B, E = release.Build, release.Edge


def test_routes():
    builds = [B("f1", "full", "01", size=100), B("d2", "daily", "02", parent="f1", edges=[E("f1", "p", 5)]), B("d3", "daily", "03", parent="d2", edges=[E("d2", "p", 5), E("f1", "r", 7)]), B("f4", "full", "04", bridge_from="d3", size=120, edges=[E("d3", "b", 50)]), B("e1", "full", "05", epoch=1, size=10)]
    assert release.cheapest(builds, "d2", "d3") == ("", [("d3", "p")], 5)
    assert release.cheapest(builds, "", "d3") == ("f1", [("d3", "r")], 107)
    assert release.cheapest(builds, "d3", "f4") == ("", [("f4", "b")], 50) and release.cheapest(builds, "", "f4")[0] == "f4"
    assert release.cheapest(builds, "f4", "e1") == ("e1", [], 10) and release.cheapest(builds, "", "none") is None
    assert release.cheapest([B("d", "daily", "1", parent="lost")], "", "d") is None
    assert release.why_no_chain(builds, "", "d3").startswith("nothing") and "unbroken" in release.why_no_chain(builds, "f1", "d3")
    assert "no entry" in release.why_no_chain([B("d", "daily", parent="lost")], "x", "d")
    assert [b.id for b in release.ordered(builds[::-1])][:2] == ["f1", "d2"] and release.newer(builds[1], builds[0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(1, 20)), max_size=14), st.integers(0, 6))
def test_route_is_cheapest(edges, held):
    builds = [B(f"b{i}", "full" if i % 3 == 0 else "daily", f"{i:02d}", size=30 if i % 3 == 0 else 0) for i in range(7)]
    for n, (source, cost) in enumerate(edges):
        if source < n % 7:
            builds[n % 7].edges.append(E(f"b{source}", str(n), cost))

    def best(i):
        ways = [0] if i == held else []
        ways += [30] if i % 3 == 0 else []
        ways += [w + e.size for e in builds[i].edges if (w := best(int(e.source[1:]))) is not None]
        return min(ways, default=None)

    got = release.cheapest(builds, f"b{held}", "b6")
    assert (got[2] if got else None) == best(6)


def test_guards(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    release.guard_removals(ids(1, 2), ids(1, 3, 4), ids(1, 3), "id")
    with pytest.raises(ValueError):
        release.guard_removals(ids(1, 2), ids(1), ids(1, 2), "id")
    with pytest.raises(ValueError):
        release.guard_through("2025", "2026")


def test_releases(spark, tmp_path):
    specs = {"movies": ["id", "title"], "credits": ["person_id", "work_id", "work_type", "role"]}
    movies = lambda *t: spark.createDataFrame([(i, x) for i, x in t], "id long, title string")
    credits = lambda *p: spark.createDataFrame([(x, 1, "movie", "Cast") for x in p], "person_id long, work_id long, work_type string, role string")
    r = store.Releases(spark, str(tmp_path / "pub"), specs)
    r.publish_full("f1", "2026-01-01", {"movies": movies((1, "A"), (2, "B")), "credits": credits(7)})
    mine = str(tmp_path / "mine")
    assert r.update(mine) == "f1" and r.update(mine) == "f1"
    r.publish_daily("d2", "2026-01-02", {"movies": movies((1, "A2"), (2, "B")), "credits": credits(7, 8)})
    r.publish_daily("d3", "2026-01-03", {"movies": movies((1, "A2"), (3, "C")), "credits": credits(8)}, rollups=["f1"])
    assert r.update(mine) == "d3"
    assert rows(spark.read.parquet(f"{mine}/d3/movies.parquet")) == [(1, "A2"), (3, "C")] and rows(spark.read.parquet(f"{mine}/d3/credits.parquet"), "person_id") == [(8,)]
    assert rows(r.tables_of("d2")["movies"]) == [(1, "A2"), (2, "B")]
    alive = spark.createDataFrame([(3,)], "id long")
    with pytest.raises(ValueError):
        r.publish_full("f4", "2026-01-04", {"movies": movies((1, "A2")), "credits": credits(8)}, alive=alive)
    with pytest.raises(ValueError):
        r.publish_daily("d0", "2025-01-01", {"movies": movies((1, "A2"))})


def test_vectors(spark):
    df = spark.createDataFrame([(10, [1.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0]), (30, [0.9, 0.1, 0.0])], "id long, v array<float>")
    assert [r.id for r in vectors.similar(df, "id", "v", 10, 5).collect()] == [30, 20]
    assert [r.id for r in vectors.nearest(df, "id", "v", [0.0, 1.0, 0.0], 2, skip=[20]).collect()] == [30, 10]
    kept, lost = vectors.collection(df, "id", spark.createDataFrame([(10,), (10,), (99,)], "id long"))
    assert rows(kept, "id") == [(10,)] and rows(lost) == [(99,)]
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    big = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    lo, hi = vectors.scale_arrays(vectors.scale(big, "v"))
    lo32, hi32 = np.float32(lo), np.float32(hi)
    want = np.floor(np.clip((x - lo32) / (hi32 - lo32) * np.float32(255), 0, 255) + 0.5).astype(int)
    got = np.array([r.q for r in big.select("id", vectors.quantise(F.col("v"), lo, hi).alias("q")).orderBy("id").collect()])
    assert (got == want).mean() > 0.999 and np.abs(got - want).max() <= 1
    back = np.array([r.u for r in big.select("id", vectors.dequantise(vectors.quantise(F.col("v"), lo, hi), lo, hi).alias("u")).orderBy("id").collect()])
    true = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert (back * true).sum(axis=1).min() > 0.999
    assert len(vectors.scale_id(lo, hi)) == 16
    assert vectors.taste(big, "id", "v", [1], [], []) == pytest.approx(true[1].tolist(), abs=1e-6)


def test_walk_finds_planted_axes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.02, (400, 24))
    x[:, 0] += rng.normal(0, 1, 400)
    x[:, 1] += rng.normal(0, 0.5, 400)
    x[:, 2] += 3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").cache()
    walk = vectors.Explorer.at(df, "id", "v", int(np.abs(x[:, 0]).argmin()))
    seen = walk.view()
    assert abs(seen.axes[0][0]) > 0.9 and seen.share[0] > seen.share[1] > 0 and len(seen.cells) == 133
    grid = seen.grid(7, 5)
    placed = [c for r in grid for c in r]
    assert len(set(placed)) == 35 and None not in placed
    before = walk.position @ seen.axes[0]
    after = walk.move("right")
    assert walk.position @ seen.axes[0] > before and walk.trail == [after.center]
    toward, away = walk.drift(5)
    assert toward.first().score > away.first().score
    assert vectors.poles(x[:50], 4)[0] == 0 and len(set(vectors.poles(x[:50], 4))) == 4


def test_vector_files(spark, tmp_path):
    levels = np.random.default_rng(0).integers(0, 256, (5, 3))
    data = records.vector_file([1, 2, 3, 4, 9], levels, np.array([-1, 0, 0]), np.array([1, 1, 2]))
    (tmp_path / "v.bin").write_bytes(data)
    got = {r.id: r.embedding for r in records.read_vectors(spark, str(tmp_path / "v.bin")).collect()}
    assert set(got) == {1, 2, 3, 4, 9} and np.linalg.norm(got[9]) == pytest.approx(1, abs=1e-5)
    for bad in (data[:-1], b"x" + data[1:], b""):
        with pytest.raises(ValueError):
            records.parse_vectors(bad)


def test_record_files(spark, tmp_path):
    df = spark.createDataFrame([(255, "a"), (-31, "b"), (0, "none")], "page_id long, title string")
    records.write_records(df, str(tmp_path / "r"))
    assert {p.name for p in (tmp_path / "r").glob("shard=*")} == {"shard=ff", "shard=1f", "shard=00"}
    assert rows(records.read_records(spark, str(tmp_path / "r"), "page_id long, title string")) == [(-31, "b"), (255, "a")]


@pytest.fixture(scope="module")
def library(spark):
    c = lambda data, ddl: spark.createDataFrame(data, ddl)
    image = "cover_image_file string, cover_image_url string, wikipedia_url string"
    return serving.Library(
        {
            "movies": c([(1, "The Godfather", 1972, "Brando", "Coppola", "", "", ""), (2, "Long Arm of the Godfather", 1972, "Adolfo", "Bianchi", "", "", ""), (3, "Adventures of the Gummi Bears", 1985, "", "", "", "", "")], "id long, title string, year long, starring string, director string, " + image),
            "movie_text": c([(1, "A family.")], "id long, overview string"),
            "television_series": c([(5, "Gummi Days", 1990, "Brando", "Ann", "ABC", "", "", "")], "id long, title string, year long, starring string, creator string, network string, " + image),
            "television_text": c([(5, "Days.")], "id long, overview string"),
            "television_seasons": c([(50, 5, 1, 2, "1990", "", "", "", 0, 0.0, 0.0)], "id long, series_id long, season long, num_episodes long, first_aired string, last_aired string, network string, starring string, rank long, rating double, viewers double"),
            "television_episodes": c([(500, 5, 1, 2, 2, "Godfather night", "", 0.0, ""), (501, 5, 1, 1, 1, "Pilot", "", 0.0, ""), (502, 5, 2, 1, 3, "Orphan", "", 0.0, "")], "id long, series_id long, season long, number_in_season long, number_overall long, title string, air_date string, viewers double, prod_code string"),
            "episode_text": c([(501, 5, "It begins.")], "id long, series_id long, summary string"),
            "people": c([(7, 7, 0, "Mario Brando", "Mario Brando", ""), (8, 8, 0, "Ann", "Ann (writer)", ""), (9, 9, 0, "Ann", "Ann", "")], "id long, page_id long, qid long, name string, wiki string, image_url string"),
            "person_alias": c([("Mario", 7)], "wiki string, person_id long"),
            "credits": c([(7, 1, "movie", "Cast"), (7, 2, "movie", "Director"), (7, 5, "television", "Cast"), (7, 77, "event", "Host")], "person_id long, work_id long, work_type string, role string"),
            "events": c([(20, "7th Godfather Awards", "award_ceremony", "Godfather Awards", 1999, "Ann · Tom")], "id long, title string, kind string, award string, year long, hosts string"),
        }
    )


def test_searches(library, spark, tmp_path):
    assert [r.title for r in library.search_movies("the godfather").collect()][:2] == ["The Godfather", "Long Arm of the Godfather"]
    assert library.search_movies("gummy bears").first().title == "Adventures of the Gummi Bears"
    assert library.search_movies("coppola", field="director").first().id == 1
    assert library.search_movies("xy").count() == 0 and library.search_movies("qqqq").count() == 0
    assert library.search_television("gummi").first().network == "ABC"
    assert library.search_episodes("godfather").first().series == "Gummi Days"
    assert tuple(library.search_people("brando").select("id", "credits").first()) == (7, 4)
    assert library.search_events("godfather awards").first().subtitle == "Godfather Awards · hosted by Ann · Tom"
    found = library.search_all("godfather")
    assert [r["type"] for r in found][0] == "movie" and {r["type"] for r in found} == {"movie", "event", "episode"}
    library.rebuild_indexes(str(tmp_path))
    indexed = serving.Library(library.tables, {"movies": spark.read.parquet(f"{tmp_path}/movies_fts")})
    assert rows(indexed.search_movies("the godfather")) == rows(library.search_movies("the godfather"))


def test_lookups_and_views(library):
    assert [r.id for r in library.film_info([3, 99, 1, 3]).collect()] == [3, 1]
    assert [r.title for r in library.episodes(5).collect()] == ["Pilot", "Godfather night", "Orphan"] and library.episodes(6).count() == 0
    assert (library.person_id(7), library.person_id(0, "Mario"), library.person_id(name="Ann"), library.person_id(name="x")) == (7, 7, 8, 0)
    assert library.person_by_id(7).name == "Mario Brando" and library.person_by_id(1) is None
    works = [(r.role, [w.title for w in r.works]) for r in library.filmography(7).collect()]
    assert works == [("Director", ["Long Arm of the Godfather"]), ("Cast", ["Gummi Days", "The Godfather"])]
    view = library.television_view(5).first()
    assert [(s.season, [e.title for e in s.episodes]) for s in view.seasons] == [(1, ["Pilot", "Godfather night"]), (2, ["Orphan"])]
    assert view.seasons[0].episodes[0].summary == "It begins." and view.overview == "Days."
    assert library.movie_view(1).first().overview == "A family." and library.movie_view(2).first().overview == ""
    assert library.event_view(20).first().hosts == ["Ann", "Tom"]
    assert dict((n, c) for n, c, _ in library.describe())["movies"] == 3


def test_tolerant_order():
    row = lambda t, s: {"type": t, "score": s}
    out = search.tolerant_order([row("episode", 0.91), row("tv", 0.90), row("movie", 0.5), row("movie", 0.95)])
    assert [(r["type"], r["score"]) for r in out] == [("movie", 0.95), ("tv", 0.90), ("episode", 0.91), ("movie", 0.5)]


def test_schedules(spark):
    grid = spark.createDataFrame([(1, "Mon", "A", "20:00", "21:00", ""), (2, "Mon", "B", "20:30", "21:00", ""), (3, "Mon", "B", "21:00", "22:00", ""), (4, "Mon", "A", "23:30", "00:30", ""), (5, "Mon", "B", "23:00", "23:59", "")], "id long, day string, network string, start string, end string, part string")
    assert [r.id for r in serving.slots(grid, "Mon", "B").collect()] == [2, 3, 5]
    assert rows(serving.opposite(grid, 1), "id") == [(2,)]
    assert rows(serving.opposite(grid, 4), "id") == [] and rows(serving.opposite(grid, 4, wrap=True), "id") == [(5,)]


def test_fill_first_and_owner(spark):
    df = spark.createDataFrame([("k", 2, "", 5), ("k", 1, "a", 0), ("k", 3, "b", 7)], "k string, src int, name string, n long")
    assert rows(relational.fill_first(df, ["k"], ["name", "n"], ["src"], {"name": "", "n": 0})) == [("k", "a", 5)]
    one = lambda *x: spark.createDataFrame(list(x), "k long, o long")
    out = relational.owner_by_precedence(spark.createDataFrame([(1,), (2,), (3,)], "k long"), "k", [one((1, 10)), one((1, 20), (2, 20), (3, 99))], spark.createDataFrame([(10,), (20,)], "o long"), "o")
    assert rows(out, "k", "o") == [(1, 10), (2, 20)]


def test_deep_digest(spark):
    """A deeper tree has its own digest, which order and repetition of the input don't change."""
    from cinelake.operators import release

    df = spark.range(3000).selectExpr("id", "CAST(id % 7 AS STRING) AS x")
    shallow = release.table_digest(df, ["id", "x"]).first()
    deep = release.table_digest(df, ["id", "x"], leaf=1).first()
    again = release.table_digest(df.repartition(5, "x"), ["id", "x"], leaf=1).first()
    assert deep == again and deep.rows == shallow.rows == 3000 and deep.digest != shallow.digest
    assert release.table_digest(df.where("id > 0"), ["id", "x"], leaf=1).first().digest != deep.digest


def test_grams_of_a_long_text(spark):
    """A text of a megabyte is indexed in linear time, with characters beyond the basic plane whole."""
    import time

    from cinelake.operators import search

    text = ("lorem ipsum 😀 dolor " * 60_000)[:1_000_000]
    df = spark.createDataFrame([(1, text), (2, "ab"), (3, None), (4, "a😀b")], "id long, t string")
    began = time.time()
    found = {(r.id, r.gram): r.tf for r in search.index(df, "id", ["t"]).collect()}
    assert time.time() - began < 30
    want = {}
    for i in range(len(text) - 2):
        want[1, text[i : i + 3]] = want.get((1, text[i : i + 3]), 0) + 1
    assert found == want | {(4, "a😀b"): 1}


def test_checksums_and_verified_copies(spark, tmp_path):
    import hashlib

    from cinelake.sources import files

    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.bin").write_bytes(b"content")
    good = hashlib.sha256(b"content").hexdigest()
    assert [(r.bytes, r.sha256) for r in files.checksums(spark, str(tmp_path / "a")).collect()] == [(7, good)]
    files.copy_verified(spark, str(tmp_path / "a/x.bin"), str(tmp_path / "y.bin"), good)
    assert (tmp_path / "y.bin").read_bytes() == b"content"
    with pytest.raises(ValueError):
        files.copy_verified(spark, str(tmp_path / "a/x.bin"), str(tmp_path / "z.bin"), "0")
    assert not (tmp_path / "z.bin").exists() and not (tmp_path / "z.bin.partial").exists()


def test_scales_and_places_in_the_catalog(spark, tmp_path):
    from cinelake.operators import release, vectors

    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [2.0, 1.0])], "id long, v array<float>")
    name = vectors.write_scale(vectors.scale(df, "v"), str(tmp_path / "scale"))
    lo, hi = vectors.scale_arrays(vectors.read_scale(spark, str(tmp_path / "scale")))
    assert (lo, hi) == ([0.0, 1.0], [2.0, 1.0]) and name == vectors.scale_id(lo, hi)
    beyond = spark.createDataFrame([(1, [3.0, 9.0]), (2, [1.0, 1.0]), (3, [-1.0, 1.0])], "id long, v array<float>")
    assert [r[0] for r in beyond.orderBy("id").select(vectors.clamped(F.col("v"), lo, hi)).collect()] == [1, 0, 1]
    builds = [release.Build(f"b{i}", "daily", f"2026010{i}") for i in (3, 1, 2)]
    assert [release.nth_back(builds, n) for n in range(4)] == ["b3", "b2", "b1", ""]


def test_overlaps_within_spans(spark):
    """Spans of time change no pair: each overlap is told once, also where slots reach over several spans or repeat."""
    rng = np.random.default_rng(6)
    slots = [(int(i), int(rng.integers(0, 3)), int(rng.integers(0, 4)), int(s := rng.integers(0, 300)), int(s + rng.integers(1, 60))) for i in range(200)]
    df = spark.createDataFrame(slots, "slot long, day long, network long, start long, end long")
    want = sorted((a[1], a[0], b[0]) for a in slots for b in slots if a[1] == b[1] and a[2] != b[2] and a[3] < b[4] and a[4] > b[3] and a[0] < b[0])
    for buckets in (None, lambda s, e: F.sequence(F.floor(s / 25), F.floor(e / 25))):
        found = relational.overlapping(df, ["day"], "network", "start", "end", "slot", buckets)
        assert sorted(tuple(r) for r in found.collect()) == want and found.columns == ["day", "left", "right"]
