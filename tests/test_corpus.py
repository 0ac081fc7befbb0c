"""A small encyclopaedia from dump to tables."""

import bz2
import gzip
import json
import shutil
from pathlib import Path

import pytest

from cinelake.operators import publish, recognise, release
from cinelake.session import ship
from cinelake.sources import dumps
from cinelake.streaming import reconcile

FILM = """{{Infobox film
| name = Star Road
| director = [[Jane Doe]]<ref name="x"/> & [[Ann Lee|A. Lee]]
| writer = {{plainlist|
* [[Jane Doe]]
* Unlinked Person
}}
| starring = {{ubl|[[Tom Fox (actor)|Tom Fox]] (5)|[[Old Name]]|[[Star Road 2]]}}
| released = {{Film date|1999|3|1}}
| country = [[United States]]<br>[[France]] (minor)
| image = [[File:Star road.jpg|thumb]]
| budget = $5 million<ref>no</ref>
}}
'''Star Road''' is a [[science fiction film|film]].
== Plot ==
A road. It is long.
== Cast ==
[[Category:1990s American science fiction comedy films]]
"""
SEQUEL = "{{Infobox film|name=Star Road 2|director=[[Jane Doe]]|released=2001-05-06}}\nLater.\n[[Category:War films]]"
PERSON = "{{Infobox person|name=Jane Doe|birth_date={{birth date and age|1960|2|3}}|occupation=Director<br>Writer|image=Jane.jpg}}\nJane is a director."
ACTOR = "{{Infobox person|birth_place=Oslo}}\nAn actor."
SERIES = """{{Infobox television
| creator = [[Jane Doe]]
| network = [[ABC]]
| genre = Drama
| first_aired = {{Start date|2001|1|2}}
| list_episodes = List of Long Days episodes
}}
lead
{{Series overview|infoA=Nielsen ratings rank|infoB=Viewers (millions)|episodes1=2|start1={{Start date|2001|1|2}}|infoA1=5|infoB1=12.5|episodes2A=3|episodes2B=4}}
== Season 1 ==
{{Episode list|EpisodeNumber=1|EpisodeNumber2=1|Title=Inline pilot}}
"""
SEASON = """{{Infobox television season|num_episodes=2|starring=[[Ann Lee]]|first_aired={{Start date|2001|1|3}}}}
{{Episode list|EpisodeNumber=1|EpisodeNumber2=1|Title=Pilot|DirectedBy=[[Jane Doe]]|OriginalAirDate={{Start date|2001|1|2}}|Viewers=10.2<ref>x</ref>|ProdCode=1A01|ShortSummary=It begins.}}
{{#invoke:Episode list|sublist|EpisodeNumber=2|EpisodeNumber2=2|Title=Second}}
"""
LIST = "== Series 2 ==\n{{Episode list|NumParts=2|EpisodeNumber_1=3|EpisodeNumber_2=4|EpisodeNumber2_1=1|EpisodeNumber2_2=2|Title=Double}}"
EVENT = "{{Infobox film awards|number=7|award=[[Road Awards]]|host=[[Tom Fox (actor)|Tom]]<br>[[Ann Lee]]|date=March 3, 1999|network=Broadcast: [[ABC]]|best_film=''[[Star Road]]''}}\nAn award."
GRID = """==Monday==
{| class="wikitable"
! Network !! !! 8:00 pm !! 8:30 p.m.
|-
! rowspan="2" | [[ABC]] !! Fall
| colspan="2" | [[Long Days]] {{small|(12/15.1)}}
|-
! Winter
| [[Other]] || ''Plain'' {{small|(R)}}
|}
"""
PAGES = [
    (1, "Star Road (1999 film)", FILM),
    (2, "Star Road 2", SEQUEL),
    (3, "Jane Doe", PERSON),
    (4, "Tom Fox (actor)", ACTOR),
    (5, "Long Days (TV series)", SERIES),
    (6, "Long Days season 1", SEASON),
    (7, "List of Long Days episodes", LIST),
    (8, "7th Road Awards", EVENT),
    (9, "1999–2000 United States network television schedule", GRID),
    (10, "Plain article", "Nothing of interest."),
    (12, "Ann Lee", "No infobox."),
    (13, "List of Unknown episodes", "{{Episode list|Title=Lost}}"),
]
QIDS = [(1, 101), (2, 102), (3, 103), (4, 104), (5, 105), (6, 106), (7, 107), (12, 112), (20, 120)]
TITLES = {i: t for i, t, _ in PAGES} | {20: "Star Road (franchise)"}


def xml(pages):
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    page = lambda i, ns, t, x: f"<page><title>{esc(t)}</title><ns>{ns}</ns><id>{i}</id><revision><id>1</id><text>old</text></revision><revision><id>2</id><text>{esc(x)}</text></revision></page>\n"
    return [page(i, 0, t, x) for i, t, x in pages] + [page(99, 1, "Talk:Star Road", FILM)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    ship(spark)
    d = tmp_path_factory.mktemp("dump")
    # Several compressed streams, one behind the other.
    parts = xml(PAGES)
    (d / "wiki-pages-articles-multistream.xml.bz2").write_bytes(b"".join(bz2.compress(p.encode()) for p in ["<mediawiki>\n", "".join(parts[:5]), "".join(parts[5:]), "</mediawiki>"]))
    lines = [f"{600 + i}:{i}:{t}" for i, t in sorted(TITLES.items())] + ["700:55:A: title: with colons", "900:77:Jane Doe"]
    (d / "wiki-pages-articles-multistream-index.txt.bz2").write_bytes(bz2.compress("\n".join(lines).encode()))
    rows = ",".join(f"({i},'wikibase_item','Q{q}',NULL),({i},'page_image','x.jpg',NULL)" for i, q in [*QIDS, (77, 999)])
    (d / "wiki-page_props.sql.gz").write_bytes(gzip.compress(f"INSERT INTO `page_props` VALUES {rows};\n".encode()))
    (d / "wiki-image.sql.gz").write_bytes(gzip.compress(rb"INSERT INTO `image` VALUES ('Star_road.jpg',1,2),('It\'s.png',3,4);" + b"\n"))
    value = lambda n: {"numeric-id": n}
    claim = lambda v, rank="normal", snak="value": {"rank": rank, "mainsnak": {"snaktype": snak, "datavalue": {"value": v}}}
    entities = [
        {"id": "Q106", "claims": {"P179": [claim(value(105)), claim(value(104), rank="deprecated")]}},
        {"id": "Q101", "claims": {"P156": [claim(value(102))], "P345": [claim("tt1")], "P179": [claim(value(120))]}},
        {"id": "Q102", "claims": {"P155": [claim(value(101))], "P345": [claim("tt2", snak="novalue")]}},
        {"id": "Q103", "claims": {"P345": [claim(" nm3 ")]}},
        {"id": "Q500", "claims": {"P31": [claim(value(1))]}},
    ]
    (d / "entities.json").write_text("[\n" + ",\n".join(map(json.dumps, entities)) + "\n]\n")
    return str(d)


@pytest.fixture(scope="module")
def database(spark, corpus):
    pages = dumps.pages(spark, f"{corpus}/wiki-pages-articles-multistream.xml.bz2")
    claims = recognise.claims(pages).cache()
    qids = dumps.page_qids(spark, f"{corpus}/wiki-page_props.sql.gz", f"{corpus}/wiki-pages-articles-multistream-index.txt.bz2").cache()
    e = dumps.edges(dumps.entities(spark, f"{corpus}/entities.json"))
    return publish.Database(claims, qids, e["part_of"], e["sequel_of"], e["identifiers"], dumps.image_names(spark, f"{corpus}/wiki-image.sql.gz"))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_dump_and_maps(spark, corpus, database):
    from cinelake.sources.files import find_dumps

    assert set(find_dumps(spark, corpus)) == {"articles", "index", "page_props", "images"}
    pages = dumps.pages(spark, f"{corpus}/wiki-pages-articles-multistream.xml.bz2")
    assert pages.count() == len(PAGES) + 1
    assert {r.id: r.text.strip() for r in pages.where("ns = 0").collect()} == {i: x.strip() for i, _, x in PAGES}
    assert ("Jane Doe", 103, 3) in rows(database.qids, "title", "qid", "page_id")
    assert rows(dumps.image_names(spark, f"{corpus}/wiki-image.sql.gz"), "name") == [("It's.png",), ("Star_road.jpg",)]
    assert dumps.index(spark, f"{corpus}/wiki-pages-articles-multistream-index.txt.bz2").where("title = 'A: title: with colons'").count() == 1


def test_streams_are_dealt_out(spark, tmp_path):
    """A dump of many streams is read by many tasks, with the rows that the XML reader gives; only pages of indexed streams count."""
    pages = [(i, f"A & B {i}", "x < y &amp; é\n" * (i % 7)) for i in range(40)]
    parts, data, lines = xml(pages)[:-1], bz2.compress(b"<mediawiki>\n"), []
    for i in range(0, 40, 5):
        lines += [f"{len(data)}:{p[0]}:{p[1]}" for p in pages[i : i + 5]]
        data += bz2.compress("".join(parts[i : i + 5]).encode())
    path = tmp_path / "wiki-pages-articles-multistream.xml.bz2"
    path.write_bytes(data + bz2.compress(b"</mediawiki>"))
    (tmp_path / "index.txt").write_text("\n".join(lines))
    found = dumps.multistream(spark, str(path), dumps.offsets(spark, str(tmp_path / "index.txt")), 2)
    assert found.rdd.getNumPartitions() == 4
    whole = dumps.pages(spark, str(path))
    assert rows(found, "id", "ns", "title", "text") == rows(whole, "id", "ns", "title", "text") == sorted(((i, 0, t, x) for i, t, x in pages), key=str)
    assert rows(dumps.pages(spark, f"file://{path}", str(tmp_path / "index.txt")), "id") == sorted(((i,) for i in range(40)), key=str)


def test_quotes_cut_no_tuple(spark, tmp_path):
    (tmp_path / "image.sql").write_text(r"INSERT INTO `image` VALUES ('A),(B.png',1,'x)'),('It\'s (1).jpg',2,'('),('C\\',3,'\'),(\'no.png\',');" + "\n" + "INSERT INTO `image` VALUES ('D.png',1,'" + "z" * 200_000 + "');\n")
    assert {r.name for r in dumps.image_names(spark, str(tmp_path / "image.sql")).collect()} == {"A),(B.png", "C\\", "D.png", "It's (1).jpg"}


def test_articles_are_recognised_once(spark, database, tmp_path):
    """Tables are made of written claims: none of their plans recognises articles anew."""
    fresh = recognise.claims(spark.createDataFrame([(i, 0, t, x) for i, t, x in PAGES], "id long, ns int, title string, text string"))
    settled = publish.Database(fresh, database.qids, database.part_of, database.sequel_of, database.identifiers, database.local_images).settled(str(tmp_path))
    plans = {n: df._jdf.queryExecution().toString() for n, df in settled.tables().items()}
    assert "MapInArrow" in fresh._jdf.queryExecution().toString() and not any("MapInArrow" in p for p in plans.values())
    assert rows(settled.credits, "person_id", "work_id", "role") == rows(database.credits, "person_id", "work_id", "role")


def test_films(database):
    film = {r.id: r for r in database.movies.collect()}
    assert set(film) == {1, 2}
    f = film[1]
    assert (f.title, f.year, f.release_date, f.wiki_title) == ("Star Road", 1999, "1999-03-01", "Star Road (1999 film)")
    assert (f.director, f.writer, f.starring) == ("Jane Doe · A. Lee", "Jane Doe · Unlinked Person", "Tom Fox · Old Name · Star Road 2")
    assert (f.country, f.genre, f.budget, f.cover_image_file) == ("United States · France", "Science fiction · Comedy", "$5 million", "Star road.jpg")
    assert f.cover_image_url.startswith("https://upload.wikimedia.org/wikipedia/en/") and f.cover_image_url.endswith("/Star_road.jpg")
    assert rows(database.movie_text, "id", "overview")[0] == (1, "Star Road is a film.")


def test_people_and_credits(database):
    people = {r.wiki: r for r in database.people.collect()}
    assert (people["Jane Doe"].id, people["Jane Doe"].qid, people["Jane Doe"].image_url[:47]) == (3, 103, "https://upload.wikimedia.org/wikipedia/commons/")
    assert people["Tom Fox (actor)"].name == "Tom Fox" and people["Ann Lee"].id == 12
    lost = people["Old Name"]
    assert lost.page_id == 0 and lost.id & (1 << 31)
    # A work that is credited as a person is no known person: only its credit row is made.
    assert people["Star Road 2"].page_id == 0
    credits = set(rows(database.credits, "person_id", "work_id", "work_type", "role"))
    assert {(3, 1, "movie", "Director"), (3, 1, "movie", "Writer"), (12, 1, "movie", "Director"), (4, 1, "movie", "Cast"), (lost.id, 1, "movie", "Cast"), (3, 5, "television", "Creator"), (3, 5, "television", "Director"), (12, 5, "television", "Cast"), (4, 8, "event", "Host"), (12, 8, "event", "Host")} <= credits
    assert rows(database.people_bio, "id", "birth_date", "occupation")[0] == (3, "1960-02-03", "Director · Writer")


def test_television(database):
    series = database.television_series.first()
    assert (series.id, series.title, series.year, series.network, series.seasons_count, series.episodes_count) == (5, "Long Days", 2001, "ABC", 2, 4)
    assert rows(database.television_seasons, "season", "page_id", "num_episodes", "first_aired", "rank", "viewers", "starring") == [(1, 6, 2, "2001-01-02", 5, 12.5, "Ann Lee"), (2, 0, 2, "", 0, 0.0, "")]
    assert rows(database.television_episodes, "season", "number_in_season", "number_overall", "title", "air_date", "viewers", "prod_code") == [
        (1, 1, 1, "Pilot", "2001-01-02", 10.2, "1A01"), (1, 2, 2, "Second", "", 0.0, ""), (2, 1, 3, "Double", "", 0.0, ""), (2, 2, 4, "Double", "", 0.0, "")]
    assert rows(database.episode_text, "summary") == [("It begins.",)]
    assert rows(database.unresolved_sources, "title") == [("List of Unknown episodes",)]


def test_events_and_schedules(database):
    e = database.events.first()
    assert (e.kind, e.edition, e.year, e.hosts, e.network, e.best_film) == ("award_ceremony", 7, 1999, "Tom, Ann Lee", "ABC", "Star Road")
    slots = rows(database.schedule_slots, "day", "network", "part", "start", "end", "title", "show_id", "rerun", "rank", "rating")
    assert ("Monday", "ABC", "Fall", "20:00", "21:00", "Long Days", 0, 0, 12, 15.1) in slots
    assert ("Monday", "ABC", "Winter", "20:30", "21:00", "Plain", 0, 1, 0, 0.0) in slots and len(slots) == 3
    assert rows(database.schedules, "season", "daypart") == [("1999–2000", "prime time")]


def test_graph(database):
    assert rows(database.franchises, "id", "qid", "title") == [(20, 120, "Star Road (franchise)")]
    assert rows(database.franchise_members, "franchise_id", "id", "kind") == [(20, 1, "movies")]
    assert rows(database.sequels, "id", "kind", "next_id") == [(1, "movies", 2)]
    assert rows(database.external_ids, "id", "kind", "source", "value") == [(1, "movies", "imdb", "tt1"), (3, "people", "imdb", "nm3")]


def test_write_digest_and_sql(spark, database, tmp_path):
    from cinelake import schemas
    from cinelake.sources.catalog import Database

    database.write(str(tmp_path))
    with Database.open(spark, str(tmp_path)) as db:
        found = db.sql("SELECT p.name, m.title FROM {main}.credits c JOIN {main}.people p ON c.person_id = p.id JOIN {main}.movies m ON c.work_id = m.id WHERE c.role = :role ORDER BY 1, 2", role="Director").collect()
        assert [tuple(r) for r in found] == [("Ann Lee", "Star Road"), ("Jane Doe", "Star Road"), ("Jane Doe", "Star Road 2")]
        tables = db.tables["main"]
        whole, by_table = release.digests(tables, schemas.TABLES)
        assert len(by_table) == len(schemas.TABLES) - 1
        assert release.digests({t: d.repartition(3) for t, d in tables.items()}, schemas.TABLES)[0] == whole
        assert release.digests(tables | {"sequels": tables["sequels"].limit(0)}, schemas.TABLES)[0] != whole
        found = publish.lint(tables, database.claims).collect()
        assert found == []


def test_lint(spark):
    series = spark.createDataFrame([(1, "A", 1900, "2001-05-01", "2001-04-01")], "id long, wiki_title string, year long, first_aired string, last_aired string")
    seasons = spark.createDataFrame([(1, "2003", "2001-01-01")], "series_id long, first_aired string, last_aired string")
    films = spark.createDataFrame([(2, "B", 1850)], "id long, wiki_title string, year long")
    claims = spark.createDataFrame([("television", "C", {"list_episodes": "<!-- none -->"}, []), ("movie", "D", {}, [("starring", "D"), ("distributor", "D")])], "kind string, title string, infobox map<string,string>, links array<struct<field:string,target:string>>")
    found = publish.lint({"television_series": series, "television_seasons": seasons, "movies": films}, claims).collect()
    assert [(r.kind, r.title) for r in found] == [("a work credited as a person", "D"), ("ends before it begins", "A"), ("season ends before it begins", "A"), ("unfilled template placeholder", "C"), ("year outside the medium", "A"), ("year outside the medium", "B")]


def recognised(pages):
    c = recognise.claims(pages)
    return c, c.selectExpr("page_id AS from_id", "explode(links) AS l").selectExpr("from_id", "l.field", "l.target")


def test_days(spark, database, tmp_path):
    """A day replaces what its pages claimed; order and idempotence are guarded."""
    store = reconcile.Store(spark, str(tmp_path / "store"))
    claims = database.claims
    store.commit({"claims": claims, "links": claims.selectExpr("page_id AS from_id", "explode(links) AS l").selectExpr("from_id", "l.field", "l.target")}, "full")
    before = store.read("claims").count()
    day = lambda pages: spark.createDataFrame([(i, 0, t, x) for i, t, x in pages], "id long, ns int, title string, text string")
    changed = day([(2, "Star Road 2", "Now a plain article."), (10, "Plain article", SEQUEL), (11, "Never held", "Nothing.")])
    assert reconcile.apply_day(store, "20260102", changed, recognised)
    assert {r.page_id for r in store.read("claims").where("kind = 'movie'").collect()} == {1, 10}
    assert store.read("claims").count() == before and store.read("links").where("from_id = 2").count() == 0
    assert not reconcile.apply_day(store, "20260102", changed, recognised)
    with pytest.raises(ValueError):
        reconcile.apply_day(store, "20260101", changed, recognised)
    with pytest.raises(ValueError, match="20260103 is missing: apply it first"):
        reconcile.apply_day(store, "20260104", changed, recognised)
    with pytest.raises(ValueError, match="import a full dump"):
        reconcile.apply_day(store, "20260601", changed, recognised)
    assert len(store._states()) == 2 and store.state() == {"incr_through": "20260102", "version": "20260102"}
    assert reconcile.apply_day(store, "20260103", changed, recognised)
    assert len(store._states()) == 2 and not (tmp_path / "store/claims/v=full").exists() and (tmp_path / "store/claims/v=20260102").exists()


def test_feed(spark, database, tmp_path):
    import os

    store = reconcile.Store(spark, str(tmp_path / "store"))
    claims = database.claims
    store.commit({"claims": claims, "links": claims.selectExpr("page_id AS from_id", "explode(links) AS l").selectExpr("from_id", "l.field", "l.target")}, "full")
    feed = tmp_path / "feed"
    feed.mkdir()
    for n, (name, pages) in enumerate({"incr-20260103.xml": [(2, "Star Road 2", "gone")], "incr-20260104.xml": [(30, "New", SEQUEL)]}.items()):
        (feed / name).write_text("<mediawiki>" + "".join(xml(pages)) + "</mediawiki>")
        os.utime(feed / name, (1_700_000_000 + n, 1_700_000_000 + n))
    q = reconcile.follow(spark, store, str(feed), dumps.PAGE, lambda df: recognised(dumps.newest(df)), str(tmp_path / "checkpoint"))
    q.awaitTermination(120)
    assert store.state()["incr_through"] == "20260104"
    assert {r.page_id for r in store.read("claims").where("kind = 'movie'").collect()} == {1, 30}
    assert Path(str(tmp_path / "store")).exists()


def test_commands_and_requests(spark, corpus, tmp_path, capsys):
    """The commands build, search and lint; requests return plain values."""
    from cinelake import __main__ as command
    from cinelake.operators import handlers

    # The same dump, with an index that tells where its streams begin.
    source, out = tmp_path / "dumps", str(tmp_path / "db")
    shutil.copytree(corpus, source)
    (source / "entities.json").rename(source / "all.json")
    parts, data, lines = xml(PAGES), bz2.compress(b"<mediawiki>\n"), []
    for chunk in (range(5), range(5, len(parts))):
        lines += [f"{len(data)}:{PAGES[i][0]}:{PAGES[i][1]}" for i in chunk if i < len(PAGES)]
        data += bz2.compress("".join(parts[i] for i in chunk).encode())
    (source / "wiki-pages-articles-multistream.xml.bz2").write_bytes(data + bz2.compress(b"</mediawiki>"))
    (source / "wiki-pages-articles-multistream-index.txt.bz2").write_bytes(bz2.compress("\n".join(lines).encode()))
    assert command.build(spark, str(source), out) == ["database", "indexes"] and command.build(spark, str(source), out) == []
    command.main(["search", out, "star road", "--limit", "2"])
    assert "Star Road (1999)" in capsys.readouterr().out
    db = command.library(spark, out)
    ask = lambda path, **params: handlers.handle(db, path, params)
    assert ask("/api/search", q="star road")[0]["title"] == "Star Road" and ask("/api/television", q="long days")[0]["title"] == "Long Days"
    assert {r["type"] for r in ask("/api/all", q="road")} >= {"movie"} and ask("/api/events", q="road awards") and ask("/api/people", q="jane doe")[0]["name"] == "Jane Doe"
    assert ask("/movie", id="1")["id"] == 1 and ask("/television", id="5")["seasons"] and ask("/event", id="8")["id"] == 8
    who = ask("/person", name="Jane Doe")
    assert who["bio"] is not None and who["works"]
    for path, params in (("/movie", {"id": "999"}), ("/person", {"name": "No One"}), ("/person", {"id": "x"}), ("/nowhere", {})):
        with pytest.raises(handlers.NotFound):
            ask(path, **params)
    command.main(["lint", out, "--form", "tsv"])


def test_reports(spark):
    found = spark.createDataFrame([("k", "A", "x", "u/A"), ("k", "B", "y", "u/B"), ("l", "C", "z", "u/C")], "kind string, title string, detail string, url string")
    assert publish.report(found, "tsv") == "k\tA\tx\tu/A\nk\tB\ty\tu/B\nl\tC\tz\tu/C\n"
    assert "== k (2) ==\n* [[A]] — x\n\n== l (1) ==" in publish.report(found, "wiki", 1)
    assert publish.report(found, cap=1).endswith("3 findings of 2 kinds\n") and "[[" not in publish.report(found)
    with pytest.raises(ValueError):
        publish.report(found, "html")
