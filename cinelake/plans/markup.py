"""Queries over the markup scanner, recognition and publishing: articles are written out of the tables' columns, so SQL knows what they say.

The expressions in V are read by Spark and by DuckDB alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.functions import wikitext as w
from cinelake.operators import publish, recognise
from cinelake.plans._base import Tables, query
from cinelake.session import settled

MANY = 1_000_000  # pages of a kind have ids of their own
#: The ids of a kind in the database. They stand further apart than those that SQL tells, so that a table with more than MANY keys reaches into no other kind's.
SPAN = 1_000_000_000_000
TASKS = 4  # tasks for each core


def _shown(x: Column | str) -> Column:
    """An id of the database as SQL tells it."""
    c = F.col(x) if isinstance(x, str) else x
    return (F.floor(c / SPAN) * MANY + c % SPAN).cast("long")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by their key while they are slim; a table in one file would else make its articles, and read them, in one task."""
    return df.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism, key)


def _two(x: str) -> str:
    return f"lpad(CAST({x} AS VARCHAR(9)), 2, '0')"


#: What articles of films (over part), series (over supplier) and award events (over nation) say.
V = {
    "film": "p_name || ' ' || p_partkey",
    "year": "(1950 + p_size)",
    "month": "(1 + p_partkey % 12)",
    "day": "(1 + p_partkey % 28)",
    "director": "'Director ' || (p_partkey % 97)",
    "actor": "'Actor ' || (p_partkey % 53)",
    "star": "'Actor ' || (100 + p_partkey % 31)",
    "shown": "'Star ' || (p_partkey % 31)",
    "studio": "'Studio ' || (p_partkey % 11)",
    "country": "'Country ' || (p_partkey % 9)",
    "genre": "CASE WHEN p_partkey % 3 = 0 THEN 'Drama' WHEN p_partkey % 3 = 1 THEN 'Science fiction' ELSE 'Western' END",
    "category": "CASE WHEN p_partkey % 3 = 0 THEN 'drama' WHEN p_partkey % 3 = 1 THEN 'science fiction' ELSE 'western' END",
    "show": "'Show ' || s_suppkey",
    "creator": "'Director ' || (s_suppkey % 97)",
    "network": "'Net ' || (s_suppkey % 7)",
    "begun": "(1960 + s_suppkey % 50)",
    "ended": "(1962 + s_suppkey % 50)",
    "award": "n_name || ' Prize'",
    "host": "'Actor ' || (n_nationkey % 53)",
}
V["date"] = f"{V['year']} || '-' || {_two(V['month'])} || '-' || {_two(V['day'])}"


def _filled(template: str) -> str:
    """SQL that puts values into a text: names of V, or columns, stand between two at signs."""
    parts = template.split("@@")
    return " || ".join(f"({V.get(p, p)})" if i % 2 else "'" + p.replace("'", "\\'") + "'" for i, p in enumerate(parts) if p)


FILM = """{{Infobox film
| name = @@film@@
| director = [[@@director@@]]
| starring = {{plainlist|
* [[@@actor@@]]
* [[@@star@@|@@shown@@]]
}}
| distributor = [[@@studio@@]] (worldwide)
| country = [[@@country@@]]
| runtime = @@p_size@@ minutes<ref>A source.</ref>
| released = {{Film date|@@year@@|@@month@@|@@day@@|Town|1999|1|1}}
}}
@@film@@ is a film by [[Maker @@p_size@@|Maker]].<!-- not shown --><ref name="a"/>
== Plot ==
It is about {{nowrap|@@p_type@@}}.
== Cast ==
Nobody.
[[Category:@@year@@ @@category@@ films]]"""
SHOW = """{{Infobox television
| creator = [[@@creator@@]]
| starring = [[@@creator@@]]<br />[[@@show@@ (TV series)]]
| network = {{ubl|[[@@network@@]]}}
| num_seasons = 3
| first_aired = {{Start date|@@begun@@|1|5}}
| last_aired = {{End date|@@ended@@|2|6}}
}}
A show.
{{Series overview
| infoA = Viewers (millions)
| infoB = Rank
| episodes1 = 2 | start1 = {{Start date|@@begun@@|1|5}} | end1 = {{End date|@@begun@@|2|5}} | infoA1 = 5.5 | infoB1 = 7
| episodes2A = 3 | start2A = {{Start date|@@ended@@|1|6}} | end2A = {{End date|@@ended@@|1|20}}
| episodes2B = 4 | start2B = {{Start date|@@ended@@|2|1}} | end2B = {{End date|@@ended@@|2|6}}
}}
=== Season 1 ===
{{Episode list|EpisodeNumber=1|EpisodeNumber2=1|Title=Pilot @@s_suppkey@@|DirectedBy=[[@@creator@@]]|OriginalAirDate={{Start date|@@begun@@|1|5}}|ProdCode=1A<br/>1B|Viewers=3.25<ref>x</ref>|ShortSummary=It begins.}}
{{Episode list|EpisodeNumber=2|EpisodeNumber2=2|Title="Second"|OriginalAirDate={{Start date|@@begun@@|2|5}} (DVD) {{Start date|@@begun@@|2|12}}|Viewers=none}}
=== Season 3 ===
{{Episode list|EpisodeNumber=9|EpisodeNumber2=1|Title=Late|OriginalAirDate=March 4, @@ended@@}}"""
SEASON = """{{Infobox television season|network=[[@@network@@]]|num_episodes=5|first_aired={{Start date|@@ended@@|1|6}}}}
{{Episode list|EpisodeNumber=3|EpisodeNumber2=1|Title=Return|OriginalAirDate={{Start date|@@ended@@|1|6}}|Viewers=1.5}}"""
EVENT = """{{Infobox film awards|number=@@n_nationkey@@|award=[[@@award@@]]|date=March 1, @@(1980 + n_nationkey)@@|site=Hall|host=[[@@host@@]]|network=[[Net 1]]|best_film=@@n_name@@|most_wins=[[X|Y]] (3)}}"""
GRID = """== Monday ==
{|
! Network !! Season !! 8:00 p.m. !! 8:30 p.m. !! 9:00 p.m.
|-
! rowspan=2 | Net @@r_regionkey@@
! Fall
| [[Show 1 (TV series)|First]] {{small|(R)}} || colspan="2" | [[Unknown show]] {{small|(@@(1 + r_regionkey)@@/15.5)}}
|-
! Winter
| ''Plain'' || || [[Show 2 (TV series)]]
|}"""


def _articles(t: Tables) -> DataFrame:
    """Pages over all tables. A text is made where its row was dealt to: what asks for the task's number moves no further down."""

    def of(df: DataFrame, page_id: str, title: str, text: str) -> DataFrame:
        return df.selectExpr(f"CAST({page_id} AS BIGINT) AS id", "0 AS ns", f"{_filled(title)} AS title", f"IF(spark_partition_id() >= 0, {_filled(text)}, NULL) AS text")

    part, supplier, customer = _spread(t.part, "p_partkey"), _spread(t.supplier, "s_suppkey"), _spread(t.customer, "c_custkey")
    films = of(part, "p_partkey", "@@film@@ (film)", FILM)
    shows = of(supplier, f"{3 * SPAN} + s_suppkey", "@@show@@ (TV series)", SHOW)
    seasons = of(supplier, f"{4 * SPAN} + s_suppkey", "@@show@@ season 2", SEASON)
    events = of(t.nation, f"{5 * SPAN} + n_nationkey", "@@n_nationkey@@th @@n_name@@ Prize", EVENT)
    grids = of(t.region, f"{6 * SPAN} + r_regionkey", "@@(1990 + r_regionkey)@@–@@(91 + r_regionkey)@@ United States network television schedule", GRID)
    plain = of(customer, f"{8 * SPAN} + c_custkey", "@@c_name@@", "Nothing of interest.")
    return films.unionByName(shows).unionByName(seasons).unionByName(events).unionByName(grids).unionByName(plain)


def _claims(t: Tables) -> DataFrame:
    return recognise.claims(_articles(t))


def _database(t: Tables) -> publish.Database:
    """The published database of these articles; every second person has an article, films of a size are a franchise's parts, every fifth has a sequel."""
    films = t.part.selectExpr(f"{_filled('@@film@@ (film)')} AS title", f"CAST({10 * SPAN} + p_partkey AS BIGINT) AS qid", "CAST(p_partkey AS BIGINT) AS page_id")
    shows = t.supplier.selectExpr(f"{_filled('@@show@@ (TV series)')} AS title", f"CAST({13 * SPAN} + s_suppkey AS BIGINT) AS qid", f"CAST({3 * SPAN} + s_suppkey AS BIGINT) AS page_id")
    seasons = t.supplier.selectExpr(f"{_filled('@@show@@ season 2')} AS title", f"CAST({14 * SPAN} + s_suppkey AS BIGINT) AS qid", f"CAST({4 * SPAN} + s_suppkey AS BIGINT) AS page_id")
    people = t.spark.range(0, 200, 2).selectExpr("'Actor ' || id AS title", f"{11 * SPAN} + id AS qid", f"{SPAN} + id AS page_id").unionByName(t.spark.range(0, 100, 2).selectExpr("'Director ' || id AS title", f"{12 * SPAN} + id AS qid", f"{2 * SPAN} + id AS page_id"))
    wholes = t.spark.range(5).selectExpr("'Franchise ' || id AS title", f"{17 * SPAN} + id AS qid", f"{7 * SPAN} + id AS page_id")
    qids = films.unionByName(shows).unionByName(seasons).unionByName(people).unionByName(wholes)
    part_of = t.part.selectExpr(f"CAST({10 * SPAN} + p_partkey AS BIGINT) AS item_qid", f"CAST({17 * SPAN} + p_size % 7 AS BIGINT) AS series_qid").unionByName(t.supplier.selectExpr(f"CAST({14 * SPAN} + s_suppkey AS BIGINT) AS item_qid", f"CAST({13 * SPAN} + s_suppkey AS BIGINT) AS series_qid"))
    sequel_of = t.part.where("p_partkey % 5 = 0").selectExpr(f"CAST({10 * SPAN} + p_partkey AS BIGINT) AS item_qid", f"CAST({10 * SPAN} + p_partkey + 1 AS BIGINT) AS next_qid")
    identifiers = t.part.selectExpr(f"CAST({10 * SPAN} + p_partkey AS BIGINT) AS item_qid", "'imdb' AS source", "'tt' || p_partkey AS value").unionByName(people.selectExpr("qid AS item_qid", "'imdb' AS source", f"'nm' || (qid DIV {SPAN} * {MANY} + qid % {SPAN}) AS value"))
    return publish.Database(settled(_claims(t)), qids, part_of, sequel_of, identifiers)


@query(
    f"""
SELECT kind, CAST(count(*) AS BIGINT) AS pages, CAST(sum(id) AS BIGINT) AS ids FROM (
  SELECT 'movie' AS kind, p_partkey AS id FROM part UNION ALL SELECT 'television', {3 * MANY} + s_suppkey FROM supplier UNION ALL SELECT 'season', {4 * MANY} + s_suppkey FROM supplier
  UNION ALL SELECT 'event', {5 * MANY} + n_nationkey FROM nation UNION ALL SELECT 'schedule', {6 * MANY} + r_regionkey FROM region) GROUP BY kind"""
)
def b1_recognise(t: Tables) -> DataFrame:
    return _claims(t).groupBy("kind").agg(F.count(F.lit(1)).alias("pages"), F.sum(_shown("page_id")).alias("ids"))


@query(
    f"""
SELECT p_partkey AS id, {V["film"]} AS title, {V["year"]} AS year, {V["date"]} AS release_date, {V["director"]} AS director, {V["actor"]} || ' · ' || {V["shown"]} AS starring,
  {V["studio"]} AS distributor, {V["country"]} AS country, {V["genre"]} AS genre, p_size || ' minutes' AS runtime, {V["film"]} || ' (film)' AS wiki_title FROM part"""
)
def b2_movies(t: Tables) -> DataFrame:
    return _database(t).movies.select(_shown("id").alias("id"), "title", "year", "release_date", "director", "starring", "distributor", "country", "genre", "runtime", "wiki_title")


@query(f"SELECT p_partkey AS id, {V['film']} || ' is a film by Maker.' AS lead, 'It is about ' || p_type || '.' AS plot FROM part")
def f25_lead_and_plot(t: Tables) -> DataFrame:
    return _claims(t).where("kind = 'movie'").select(_shown("page_id").alias("id"), "lead", "plot")


@query(f"SELECT p_partkey AS id, {V['film']} || ' is a film by Maker.' AS overview FROM part")
def x2_movie_text(t: Tables) -> DataFrame:
    return _database(t).movie_text.select(_shown("id").alias("id"), "overview")


_CREDITS = f"""
SELECT DISTINCT wiki, work_id, work_type, role, shown FROM (
  SELECT {V["director"]} AS wiki, p_partkey AS work_id, 'movie' AS work_type, 'Director' AS role, {V["director"]} AS shown FROM part
  UNION ALL SELECT {V["actor"]}, p_partkey, 'movie', 'Cast', {V["actor"]} FROM part UNION ALL SELECT {V["star"]}, p_partkey, 'movie', 'Cast', {V["shown"]} FROM part
  UNION ALL SELECT {V["creator"]}, {3 * MANY} + s_suppkey, 'television', 'Creator', {V["creator"]} FROM supplier
  UNION ALL SELECT {V["creator"]}, {3 * MANY} + s_suppkey, 'television', 'Cast', {V["creator"]} FROM supplier
  UNION ALL SELECT {V["show"]} || ' (TV series)', {3 * MANY} + s_suppkey, 'television', 'Cast', {V["show"]} || ' (TV series)' FROM supplier
  UNION ALL SELECT {V["creator"]}, {3 * MANY} + s_suppkey, 'television', 'Director', {V["creator"]} FROM supplier
  UNION ALL SELECT {V["host"]}, {5 * MANY} + n_nationkey, 'event', 'Host', {V["host"]} FROM nation)"""
_NUMBER = "CAST(regexp_extract(wiki, '[0-9]+') AS BIGINT)"
_KNOWN = f"{_NUMBER} % 2 = 0 AND wiki NOT LIKE 'Show%'"


@query(f"SELECT wiki, work_id, work_type, role FROM ({_CREDITS})")
def x14_credits(t: Tables) -> DataFrame:
    """Published credits by the link target of their person, with and without an article."""
    db = _database(t)
    return db.credits.join(db.person_alias, "person_id").select("wiki", _shown("work_id").alias("work_id"), "work_type", "role")


@query(
    f"""
SELECT wiki, CASE WHEN {_KNOWN} THEN wiki ELSE min(shown) END AS name,
  CASE WHEN {_KNOWN} THEN {_NUMBER} + CASE WHEN wiki LIKE 'Actor%' THEN {MANY} ELSE {2 * MANY} END ELSE 0 END AS page_id,
  CASE WHEN {_KNOWN} THEN {_NUMBER} + CASE WHEN wiki LIKE 'Actor%' THEN {11 * MANY} ELSE {12 * MANY} END ELSE 0 END AS qid
FROM ({_CREDITS}) GROUP BY wiki"""
)
def x6_people(t: Tables) -> DataFrame:
    return _database(t).people.select("wiki", "name", _shown("page_id").alias("page_id"), _shown("qid").alias("qid"))


@query(
    f"""
SELECT {3 * MANY} + s_suppkey AS id, {V["show"]} AS title, {V["begun"]} AS year, {V["begun"]} || '-01-05' AS first_aired, {V["ended"]} || '-02-06' AS last_aired, {V["creator"]} AS creator,
  {V["network"]} AS network, '3' AS num_seasons, CAST(3 AS BIGINT) AS seasons_count, CAST(4 AS BIGINT) AS episodes_count FROM supplier"""
)
def x3_series(t: Tables) -> DataFrame:
    return _database(t).television_series.select(_shown("id").alias("id"), "title", "year", "first_aired", "last_aired", "creator", "network", "num_seasons", "seasons_count", "episodes_count")


@query(
    f"""
SELECT {3 * MANY} + s_suppkey AS series_id, season, num_episodes, first_aired, last_aired, network, viewers, rank FROM supplier, LATERAL (VALUES
  (1, 2, {V["begun"]} || '-01-05', {V["begun"]} || '-02-05', '', 5.5e0, 7),
  (2, 1, {V["ended"]} || '-01-06', {V["ended"]} || '-02-06', {V["network"]}, 0e0, 0),
  (3, 1, '', '', '', 0e0, 0)) v(season, num_episodes, first_aired, last_aired, network, viewers, rank)"""
)
def b10_seasons(t: Tables) -> DataFrame:
    """Seasons out of overviews, season articles and episodes."""
    return _database(t).television_seasons.select(_shown("series_id").alias("series_id"), F.col("season").cast("int").alias("season"), F.col("num_episodes").cast("int").alias("num_episodes"), "first_aired", "last_aired", "network", "viewers", F.col("rank").cast("int").alias("rank"))


@query(
    f"""
SELECT {3 * MANY} + s_suppkey AS series_id, season, number_in_season, number_overall, title, air_date, viewers, prod_code FROM supplier, LATERAL (VALUES
  (1, 1, 1, 'Pilot ' || s_suppkey, {V["begun"]} || '-01-05', 3.25e0, '1A / 1B'),
  (1, 2, 2, '"Second"', {V["begun"]} || '-02-12', 0e0, ''),
  (2, 1, 3, 'Return', {V["ended"]} || '-01-06', 1.5e0, ''),
  (3, 1, 9, 'Late', {V["ended"]} || '-03-04', 0e0, '')) v(season, number_in_season, number_overall, title, air_date, viewers, prod_code)"""
)
def b8_episodes(t: Tables) -> DataFrame:
    return _database(t).television_episodes.select(*(F.col(c).cast("int").alias(c) for c in ("season", "number_in_season", "number_overall")), _shown("series_id").alias("series_id"), "title", "air_date", "viewers", "prod_code")


@query(f"SELECT {3 * MANY} + s_suppkey AS series_id, 'It begins.' AS summary FROM supplier")
def x3_episode_text(t: Tables) -> DataFrame:
    return _database(t).episode_text.select(_shown("series_id").alias("series_id"), "summary")


@query(
    f"""
SELECT {5 * MANY} + n_nationkey AS id, n_nationkey || 'th ' || n_name || ' Prize' AS title, 'award_ceremony' AS kind, {V["award"]} AS award, n_nationkey AS edition,
  'March 1, ' || (1980 + n_nationkey) AS date, 1980 + n_nationkey AS year, {V["host"]} AS hosts, 'Hall' AS venue, 'Net 1' AS network, n_name AS best_film, 'Y' AS most_wins FROM nation"""
)
def x4_events(t: Tables) -> DataFrame:
    return _database(t).events.select(_shown("id").alias("id"), "title", "kind", "award", "edition", "date", "year", "hosts", "venue", "network", "best_film", "most_wins")


@query(
    f"""
SELECT {6 * MANY} + r_regionkey AS schedule_id, 'Monday' AS day, 'Net ' || r_regionkey AS network, part, start, "end", title, show_id, rerun, rank, rating FROM region, LATERAL (VALUES
  ('Fall', '20:00', '20:30', 'First', {3 * MANY + 1}, 1, 0, 0e0),
  ('Fall', '20:30', '21:30', 'Unknown show', 0, 0, 1 + r_regionkey, 15.5e0),
  ('Winter', '20:00', '20:30', 'Plain', 0, 0, 0, 0e0),
  ('Winter', '21:00', '21:30', 'Show 2 (TV series)', {3 * MANY + 2}, 0, 0, 0e0)) v(part, start, "end", title, show_id, rerun, rank, rating)"""
)
def x5_schedule_slots(t: Tables) -> DataFrame:
    return _database(t).schedule_slots.select(_shown("schedule_id").alias("schedule_id"), "day", "network", "part", "start", "end", "title", _shown("show_id").alias("show_id"), "rerun", "rank", "rating")


@query(f"SELECT {6 * MANY} + r_regionkey AS id, 'prime time' AS daypart, (1990 + r_regionkey) || '–' || (91 + r_regionkey) AS season FROM region")
def b5_schedules(t: Tables) -> DataFrame:
    return _database(t).schedules.select(_shown("id").alias("id"), "daypart", "season")


@query(f"SELECT DISTINCT {7 * MANY} + p_size % 7 AS id, {17 * MANY} + p_size % 7 AS qid, 'Franchise ' || (p_size % 7) AS title FROM part WHERE p_size % 7 < 5")
def j7_franchises(t: Tables) -> DataFrame:
    return _database(t).franchises.select(_shown("id").alias("id"), _shown("qid").alias("qid"), "title")


@query(f"SELECT {7 * MANY} + p_size % 7 AS franchise_id, p_partkey AS id, 'movies' AS kind FROM part WHERE p_size % 7 < 5")
def j8_members(t: Tables) -> DataFrame:
    return _database(t).franchise_members.select(_shown("franchise_id").alias("franchise_id"), _shown("id").alias("id"), "kind")


@query("SELECT p_partkey AS id, 'movies' AS kind, p_partkey + 1 AS next_id FROM part WHERE p_partkey % 5 = 0 AND p_partkey + 1 IN (SELECT p_partkey FROM part)")
def j9_sequels(t: Tables) -> DataFrame:
    return _database(t).sequels.select(_shown("id").alias("id"), "kind", _shown("next_id").alias("next_id"))


@query(
    f"""
SELECT p_partkey AS id, 'movies' AS kind, 'imdb' AS source, 'tt' || p_partkey AS value FROM part
UNION ALL SELECT DISTINCT {_NUMBER} + CASE WHEN wiki LIKE 'Actor%' THEN {MANY} ELSE {2 * MANY} END, 'people', 'imdb',
  'nm' || ({_NUMBER} + CASE WHEN wiki LIKE 'Actor%' THEN {11 * MANY} ELSE {12 * MANY} END) FROM ({_CREDITS}) WHERE {_KNOWN}"""
)
def j10_identifiers(t: Tables) -> DataFrame:
    return _database(t).external_ids.select(_shown("id").alias("id"), "kind", "source", "value")


@query(
    f"""
SELECT page_id, field, target FROM (
  SELECT p_partkey AS page_id, 'director' AS field, {V["director"]} AS target FROM part UNION ALL SELECT p_partkey, 'starring', {V["actor"]} FROM part UNION ALL SELECT p_partkey, 'starring', {V["star"]} FROM part
  UNION ALL SELECT p_partkey, 'distributor', {V["studio"]} FROM part UNION ALL SELECT p_partkey, 'country', {V["country"]} FROM part
  UNION ALL SELECT {3 * MANY} + s_suppkey, 'creator', {V["creator"]} FROM supplier UNION ALL SELECT {3 * MANY} + s_suppkey, 'starring', {V["creator"]} FROM supplier
  UNION ALL SELECT {3 * MANY} + s_suppkey, 'starring', {V["show"]} || ' (TV series)' FROM supplier UNION ALL SELECT {3 * MANY} + s_suppkey, 'network', {V["network"]} FROM supplier
  UNION ALL SELECT {4 * MANY} + s_suppkey, 'network', {V["network"]} FROM supplier)"""
)
def b14_links(t: Tables) -> DataFrame:
    return _claims(t).select("page_id", F.explode("links").alias("l")).select(_shown("page_id").alias("page_id"), "l.field", "l.target")


@query(f"SELECT 'a work credited as a person' AS kind, {V['show']} || ' (TV series)' AS title, 'starring lists the article itself' AS detail FROM supplier")
def b17_lint_published(t: Tables) -> DataFrame:
    db = _database(t)
    return publish.lint(db.tables(), db.claims).select("kind", "title", "detail")


# The scanner's functions, one by one.


def _parts(t: Tables) -> DataFrame:
    return _spread(t.part, "p_partkey")


def _through(f: Callable[[str], object], kind: str):
    return F.udf(f, kind, useArrow=True)


def _pairs(persons: list[dict]) -> list[str]:
    return [f"{p['name']}>{p['wiki']}" for p in persons]


@query("SELECT p_partkey, k, v FROM part, LATERAL (VALUES ('a', '{{b|' || p_size || '}}'), ('c', '[[' || p_brand || '|x]]'), ('long name', p_type)) x(k, v)")
def f16_templates(t: Tables) -> DataFrame:
    """A template among others, its named parameters; inner bars cut none, and of equal names the last counts."""
    text = F.concat(F.lit("{{Infobox filmmaker|a=1}} {{infobox Film | A = 0|a={{b|"), "p_size", F.lit("}}|c=[["), "p_brand", F.lit("|x]]| Long name ="), "p_type", F.lit("|no value|=none}} tail {{Infobox film|a=2}}"))
    read = _through(lambda s: w.infobox(w.template(s, "Infobox film") or ""), "map<string,string>")
    return _parts(t).select("p_partkey", F.explode(read(text)).alias("k", "v"))


@query("SELECT p_partkey, name, wiki FROM part, LATERAL (VALUES ('Ann ' || p_size, 'Ann ' || p_size), ('Shown', 'Bob ' || p_size), ('Cy Roe', ''), ('Di Fox', 'Di Fox'), ('Ed', '')) x(name, wiki)")
def f22_people(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Story: [[Ann "), "p_size", F.lit("]] & [[Bob "), "p_size", F.lit("|Shown]] and Cy Roe<ref>x</ref><br/>* {{sortname|Di|Fox}}{{nowrap|}}\n* [[Di Fox]]\n* {{ill|Ed|de|Ed}}\n* [[Ann "), "p_size", F.lit("]]"))
    # Di Fox occurs unlinked and linked: two entries; the first one is dropped here to keep names unique.
    read = _through(lambda s: _pairs(w.people(s)), "array<string>")
    each = _parts(t).select("p_partkey", F.explode(read(text)).alias("x")).select("p_partkey", F.split("x", ">")[0].alias("name"), F.split("x", ">")[1].alias("wiki"))
    return each.where("NOT (name = 'Di Fox' AND wiki = '')")


@query("SELECT p_partkey, p_type || '|Second|' || p_size AS items FROM part")
def f23_items(t: Tables) -> DataFrame:
    text = F.concat(F.lit("{{flatlist|\n* "), "p_type", F.lit("\n* [[X|Second]],\n}}<br>• "), "p_size", F.lit("<br />Second"))
    return _parts(t).select("p_partkey", F.array_join(_through(w.items, "array<string>")(text), "|").alias("items"))


@query("SELECT p_partkey, 'Studio ' || p_size || '>Company ' || p_size || '>worldwide|Plain>>' AS links FROM part")
def f24_links(t: Tables) -> DataFrame:
    text = F.concat(F.lit("[[company_"), "p_size", F.lit("#part|Studio "), "p_size", F.lit("]] (worldwide)<br>Plain<br>Plain"))
    read = _through(lambda s: [f"{x['name']}>{x['wiki']}>{x['note']}" for x in w.links(s)], "array<string>")
    return _parts(t).select("p_partkey", F.array_join(read(text), "|").alias("links"))


@query(
    """
SELECT p_partkey, r, c, rows, cols, head, body FROM part, LATERAL (VALUES (0, 0, 1, 1, true, 'h'), (0, 1, 1, 2, true, p_brand), (1, 0, 2, 1, false, '[[a|b]]'), (1, 1, 1, 1, false, CAST(p_size AS VARCHAR)),
  (1, 2, 1, 1, false, 'x'), (2, 1, 1, 2, false, p_type)) v(r, c, rows, cols, head, body)"""
)
def f27_tables(t: Tables) -> DataFrame:
    text = F.concat(F.lit('{| class="wikitable"\n|+ caption\n! h !! colspan=2 | '), "p_brand", F.lit("\n|-\n| rowspan=2 | [[a|b]] || "), "p_size", F.lit(' || x\nmore\n|-\n| style="a" colspan="2" | '), "p_type", F.lit("\n|}"))
    read = _through(lambda s: [(c.row, c.column, c.rows, c.columns, c.header, c.text) for x in w.tables(s) for c in x.cells], "array<struct<r:int,c:int,rows:int,cols:int,head:boolean,body:string>>")
    return _parts(t).select("p_partkey", F.inline(read(text)))


@query(
    f"""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN {V["date"]} || ',2001' WHEN 1 THEN {V["date"]} || ',1999-12-31' WHEN 2 THEN '2003-03-0' || (1 + p_size % 9) || ',2004-11-20' WHEN 3 THEN CAST({V["year"]} AS VARCHAR) ELSE '' END AS dates FROM part"""
)
def f28_dates(t: Tables) -> DataFrame:
    """Dates of templates, film before start; ISO dates; dates in words; a year; none."""
    cases = [
        _filled("{{Start date|2001|df=y}} {{film date|@@year@@| @@month@@ |@@day@@|Town}} {{Start date|2001}}"),
        _filled("1999-12-31 {{End date|@@year@@|@@month@@|@@day@@}} 1999-12-31"),
        _filled("March @@(1 + p_size % 9)@@, 2003<br>November 20, 2004 (Smarch 1, 2000)"),
        _filled("in @@year@@ or 2031"),
        _filled("unknown @@p_type@@"),
    ]
    text = F.expr("CASE p_partkey % 5 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END")
    return _parts(t).select("p_partkey", F.array_join(_through(w.dates, "array<string>")(text), ",").alias("dates"))


@query(f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN {V['date']} WHEN 1 THEN CAST({V['year']} AS VARCHAR) WHEN 2 THEN {V['date']} ELSE '' END AS life FROM part")
def f30_life_dates(t: Tables) -> DataFrame:
    cases = [_filled("{{birth date and age|df=yes|@@year@@|@@month@@|@@day@@}}"), _filled("{{bda|@@year@@}}"), _filled("{{Death-date|@@year@@|@@month@@|@@day@@|1900|1|1}}"), _filled("born @@year@@")]
    text = F.expr("CASE p_partkey % 4 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END")
    return _parts(t).select("p_partkey", _through(w.life_date, "string")(text).alias("life"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '2010-05-06' ELSE {V['date']} END AS aired FROM part")
def f31_air_dates(t: Tables) -> DataFrame:
    first = _filled("{{Start date|@@year@@|@@month@@|@@day@@}}")
    text = F.expr(f"{first} || CASE WHEN p_partkey % 2 = 0 THEN ' (DVD) ' ELSE ' (cinema) ' END || '{{{{Start date|2010|5|6}}}}'")
    return _parts(t).select("p_partkey", _through(w.air_date, "string")(text).alias("aired"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_size || 'A / ' || p_brand END AS code FROM part")
def f32_production_codes(t: Tables) -> DataFrame:
    text = F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'x --> ' || p_brand ELSE p_size || 'A<!-- no --><br />  ' || p_brand || '<ref>source' END")
    return _parts(t).select("p_partkey", _through(w.production_code, "string")(text).alias("code"))


@query("SELECT p_partkey, '[[A]]' || p_size || '|' || 'B' AS names FROM part")
def f43_merged_people(t: Tables) -> DataFrame:
    """Of several fields each person once, by target, or by name where there is none."""
    text = F.concat(F.lit("[[Ann|A]]"), "p_size")
    merged = F.udf(lambda s: "|".join(f"[[{p['name'][0]}]]{s.rpartition(']')[2]}" if p["wiki"] else p["name"] for p in w.merged_people(s, "B", "[[Ann|Other]]<br>B")), "string", useArrow=True)
    return _parts(t).select("p_partkey", merged(text).alias("names"))


@query("SELECT p_partkey, 'Picture ' || p_size || '.jpg' AS file FROM part")
def f44_file_names(t: Tables) -> DataFrame:
    text = F.concat(F.lit("<!-- a -->[[Picture "), "p_size", F.lit(".jpg|thumb]]"))
    return _parts(t).select("p_partkey", _through(w.file_of, "string")(text).alias("file"))


_CUT = "substr(p_name, 1, 11)"
_BLANK = f"(11 - strpos(reverse({_CUT}), ' '))"


@query(
    f"""
SELECT p_partkey, CASE WHEN length(p_name) <= 11 THEN p_name ELSE trim(CASE WHEN strpos({_CUT}, ' ') > 0 AND {_BLANK} > 5 THEN substr(p_name, 1, {_BLANK}) ELSE {_CUT} END) || '…' END AS cut FROM part"""
)
def f25_trim(t: Tables) -> DataFrame:
    """A cut falls back to a blank in the second half."""
    return _parts(t).select("p_partkey", _through(lambda s: w.trim(s, 11), "string")("p_name").alias("cut"))


@query(
    """
SELECT 'part' AS "table", 'p_name' AS "column", count(*) AS rows FROM part WHERE p_partkey % 10 = 0 OR p_partkey % 15 = 0
UNION ALL SELECT 'supplier', 's_name', count(*) FROM supplier WHERE s_suppkey % 7 = 0"""
)
def p7_leaks(t: Tables) -> DataFrame:
    """Names that hold markup, by table and column."""
    part = t.part.select(F.expr("CASE WHEN p_partkey % 10 = 0 THEN p_name || '<br />' WHEN p_partkey % 15 = 0 THEN '[[' || p_name ELSE p_name END").alias("p_name"), "p_type")
    supplier = t.supplier.select(F.expr("CASE WHEN s_suppkey % 7 = 0 THEN '[[x]]' ELSE s_name END").alias("s_name"))
    return publish.leaks({"part": part, "supplier": supplier, "nation": t.nation}, {"part": ["p_name", "p_type"], "supplier": ["s_name"]})
