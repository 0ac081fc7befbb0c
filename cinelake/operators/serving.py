"""What a reader of the published database asks for: searches, cards, filmographies, and detail views.

Everything is a DataFrame over the published tables; nothing is collected but what a function says it returns as a value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cinelake import schemas
from cinelake.functions import expr
from cinelake.operators import relational, search

# Weights of the indexed columns, and how many candidates are ranked anew.
FILM_FIELDS = {"title": 10.0, "starring": 2.0, "director": 2.0}
SERIES_FIELDS = {"title": 10.0, "starring": 2.0, "creator": 2.0}
EVENT_FIELDS = {"title": 10.0, "award": 3.0, "hosts": 2.0}
CAPS = {"movie": 500, "tv": 500, "episode": 800, "person": 500, "event": 400}


class Library:
    """The published tables, and indexes over them where they have been written."""

    def __init__(self, tables: Mapping[str, DataFrame], indexes: Mapping[str, DataFrame] | None = None):
        self.tables, self.indexes = tables, indexes or {}

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.tables[name]
        except KeyError:
            raise AttributeError(name) from None

    def rebuild_indexes(self, folder: str, buckets: int = 64) -> None:
        """Writes the five trigram indexes, rows of equal grams together, so that a query reads the files of its grams."""
        for table, fields in (("movies", FILM_FIELDS), ("television_series", SERIES_FIELDS), ("television_episodes", {"title": 1.0}), ("people", {"name": 1.0}), ("events", EVENT_FIELDS)):
            index = search.index(self.tables[table], "id", list(fields))
            index.repartitionByRange(buckets, "gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{folder}/{table}_fts")
            search.statistics(self.tables[table], fields).write.mode("overwrite").parquet(f"{folder}/{table}_fts_stats")

    def with_indexes(self, folder: str) -> Library:
        """This library with the indexes that a folder holds."""
        spark, tables = self.movies.sparkSession, ("movies", "television_series", "television_episodes", "people", "events")
        return Library(self.tables, {f"{t}{part}": spark.read.parquet(f"{folder}/{t}_fts{part}") for t in tables for part in ("", "_stats")})

    # Searches

    def _search(self, table: str, fields: Mapping[str, float], field: str, query: str, limit: int, cap: int) -> DataFrame:
        return search.search(self.tables[table], "id", fields, field, query, limit, cap, self.indexes.get(table), self.indexes.get(f"{table}_stats"))

    def search_movies(self, query: str, field: str = "title", limit: int = 20) -> DataFrame:
        return self._search("movies", FILM_FIELDS, field, query, limit, CAPS["movie"]).select("id", "title", "year", "starring", "director", "cover_image_url", "score")

    def search_television(self, query: str, field: str = "title", limit: int = 20) -> DataFrame:
        return self._search("television_series", SERIES_FIELDS, field, query, limit, CAPS["tv"]).select("id", "title", "year", "starring", "creator", "network", "cover_image_url", "score")

    def search_episodes(self, query: str, limit: int = 20) -> DataFrame:
        hits = self._search("television_episodes", {"title": 1.0}, "title", query, limit, CAPS["episode"])
        named = self.television_series.select(F.col("id").alias("series_id"), F.col("title").alias("series"))
        return hits.join(named, "series_id").select("id", "series_id", "series", "season", "number_in_season", "title", "air_date", "score", "bm25").orderBy(F.desc("score"), F.desc("bm25"), "id").drop("bm25")

    def search_people(self, query: str, limit: int = 20) -> DataFrame:
        hits = self._search("people", {"name": 1.0}, "name", query, limit, CAPS["person"]).select("id", "name", "wiki", "image_url", "score")
        return search.with_counts(hits, "id", self.credits, "person_id", "credits").orderBy(F.desc("score"), "id")

    def search_events(self, query: str, limit: int = 20) -> DataFrame:
        hits = self._search("events", EVENT_FIELDS, "title", query, limit, CAPS["event"])
        hosted = F.when(F.col("hosts") != "", F.concat(F.lit("hosted by "), "hosts"))
        return hits.select("id", "title", "kind", "year", F.concat_ws(" · ", F.nullif("award", F.lit("")), hosted).alias("subtitle"), "score")

    def search_all(self, query: str, limit: int = 25) -> list[dict]:
        """The best of all kinds in one list of at most limit rows, where close scores are ordered by kind."""
        hits = lambda df, title="title": df.select("id", F.col(title).alias("title"), "score")
        n = search.TYPE_LIMITS
        parts = {
            "movie": hits(self.search_movies(query, limit=n["movie"])),
            "tv": hits(self.search_television(query, limit=n["tv"])),
            "person": hits(self.search_people(query, n["person"]), "name"),
            "event": hits(self.search_events(query, n["event"])),
            "episode": hits(self.search_episodes(query, n["episode"])),
        }
        rows = [r.asDict() for r in search.unified(parts, sum(n.values())).collect()]
        return search.tolerant_order(rows)[:limit]

    # Lookups

    def film_info(self, ids: Sequence[int]) -> DataFrame:
        return relational.lookup(self.movies.select("id", "title", "year", "cover_image_file", "cover_image_url", "wikipedia_url"), "id", ids)

    def series_info(self, ids: Sequence[int]) -> DataFrame:
        return relational.lookup(self.television_series.select("id", "title", "year", "cover_image_file", "cover_image_url", "wikipedia_url"), "id", ids)

    def episodes(self, series_id: int) -> DataFrame:
        """Episodes of a series in order; an unknown series has none."""
        return self.television_episodes.where(F.col("series_id") == series_id).orderBy("season", "number_in_season", "number_overall", "id")

    def person_by_id(self, id_: int) -> Row | None:
        return self.people.where(F.col("id") == id_).first()

    def person_id(self, id_: int = 0, wiki: str = "", name: str = "") -> int:
        """A person's id by id, else link target, else exact name; 0 if there is none."""
        found = None
        if id_:
            found = self.people.where(F.col("id") == id_).select("id").first()
        if found is None and wiki:
            found = self.person_alias.where(F.col("wiki") == wiki).select("person_id").first()
        if found is None and name:
            found = self.people.where(F.col("name") == name).agg(F.min("id")).first()
        return found[0] if found and found[0] is not None else 0

    def filmography(self, person_id: int) -> DataFrame:
        """Works of a person by role: (role, works), newest first."""
        own = self.credits.where(F.col("person_id") == person_id)
        titled = lambda t: self.tables[t].select("id", "title", "year")
        rows = relational.by_kind(own, {"movie": titled("movies"), "television": titled("television_series")}, "work_type", "work_id")
        return relational.filmography(rows, "person_id", "role", "title", "year", "work_type", "work_id", schemas.ROLE_RANK, expr.clean_title)

    # Detail views

    def movie_view(self, id_: int) -> DataFrame:
        one = self.movies.where(F.col("id") == id_).join(self.movie_text, "id", "left")
        return one.withColumn("overview", F.coalesce("overview", F.lit("")))

    def event_view(self, id_: int) -> DataFrame:
        return self.events.where(F.col("id") == id_).withColumn("hosts", expr.split_joined("hosts"))

    def television_view(self, id_: int) -> DataFrame:
        """A series with its seasons and their episodes and summaries, nested; seasons that only episodes name are there too."""
        of = lambda t: self.tables[t].where(F.col("series_id") == id_)
        told = of("television_episodes").join(of("episode_text").select("id", "summary"), "id", "left")
        episode = F.struct("number_in_season", "number_overall", "id", "title", "air_date", "viewers", "prod_code", F.coalesce("summary", F.lit("")).alias("summary"))
        lists = told.groupBy("season").agg(F.sort_array(F.collect_list(episode)).alias("episodes"))
        seasons = of("television_seasons").drop("id", "series_id").join(lists, "season", "full_outer")
        whole = F.struct("season", "num_episodes", "first_aired", "last_aired", "network", "starring", "rank", "rating", "viewers", "episodes")
        nested = seasons.agg(F.sort_array(F.collect_list(whole)).alias("seasons"))
        return self.television_series.where(F.col("id") == id_).join(self.television_text, "id", "left").crossJoin(F.broadcast(nested))

    def describe(self) -> list[tuple[str, int, list[tuple[str, str]]]]:
        """(table, rows, columns with types) of every table."""
        return [(n, d.count(), d.dtypes) for n, d in sorted(self.tables.items())]


# Television schedules


def slots(grid: DataFrame, day: str, network: str) -> DataFrame:
    return grid.where((F.col("day") == day) & (F.col("network") == network)).orderBy("start", "id")


def opposite(grid: DataFrame, slot_id: int, wrap: bool = False) -> DataFrame:
    """What other networks show while a slot is on, on its day and in its part of the season.

    Times are compared as they are written, so a slot past midnight overlaps nothing; wrap adds a day to its end."""
    end = lambda s, e: F.when(F.col(e) <= F.col(s), F.concat((F.substring(e, 1, 2).cast("int") + 24).cast("string"), F.substring(e, 3, 3))).otherwise(F.col(e)) if wrap else F.col(e)
    timed = grid.withColumn("_end", end("start", "end"))
    one = timed.where(F.col("id") == slot_id).select(F.col("day").alias("d"), F.col("part").alias("p"), F.col("network").alias("n"), F.col("start").alias("s"), F.col("_end").alias("e"))
    cond = (F.col("day") == F.col("d")) & (F.col("part") == F.col("p")) & (F.col("network") != F.col("n")) & (F.col("start") < F.col("e")) & (F.col("_end") > F.col("s"))
    return timed.join(F.broadcast(one), cond).select(*grid.columns).distinct()
