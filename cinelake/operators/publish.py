"""From claims to the relational media database: every step a DataFrame plan over claims, edges and the identity map.

Inputs: claims (recognise.claims), qids(title, qid, page_id), and the edge tables of sources.dumps. Identity is the page id; a credit
is joined by its link target, and an unlinked name is no entity."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake import schemas
from cinelake.functions import expr
from cinelake.operators import relational

_EMPTY = {"page_id": 0, "first_aired": "", "last_aired": "", "network": "", "image": "", "num_episodes": 0, "rank": 0, "rating": 0.0, "viewers": 0.0}


def _names(c: Column) -> Column:
    return expr.joined(F.transform(c, lambda x: x["name"]))


def _texts(df: DataFrame) -> DataFrame:
    return df.where("lead <> '' OR plot <> ''").select("id", F.col("lead").alias("overview"))


@dataclass
class Database:
    """The published tables, made when they are asked for."""

    claims: DataFrame
    qids: DataFrame
    part_of: DataFrame | None = None  # (item_qid, series_qid)
    sequel_of: DataFrame | None = None  # (item_qid, next_qid)
    identifiers: DataFrame | None = None  # (item_qid, source, value)
    local_images: DataFrame | None = None  # (name)

    def _parsed(self, kind: str, schema: str) -> DataFrame:
        rows = self.claims.where(F.col("kind") == kind)
        return rows.select(F.col("page_id").alias("id"), "title", "lead", "plot", F.from_json("record", f"struct<{schema}>").alias("r"))

    def _images(self, df: DataFrame, file: Column) -> DataFrame:
        """image_url of a file: of the wiki's own images by their list, of shared ones else; by redirect where there is no list."""
        if self.local_images is None:
            return df.withColumn("image_url", expr.file_path_url(file))
        canon = expr.upper_first(F.replace(expr.file_name(file), F.lit(" "), F.lit("_")))
        local = self.local_images.select(F.col("name").alias("_name"), F.lit(True).alias("_local")).distinct()
        return df.withColumn("_canon", canon).join(local, F.col("_canon") == F.col("_name"), "left").withColumn("image_url", expr.cdn_image_url(file, F.coalesce("_local", F.lit(False)))).drop("_canon", "_name", "_local")

    # Works

    @cached_property
    def films(self) -> DataFrame:
        return self._parsed("movie", schemas.FILM)

    @property
    def movies(self) -> DataFrame:
        r = lambda f: F.col(f"r.{f}")
        released = F.coalesce(F.try_element_at(r("release_dates"), F.lit(1)), F.lit(""))
        people = [_names(r(f)).alias(f) for f in ("director", "producer", "writer", "starring", "music")]
        linked = [_names(r(f)).alias(f) for f in ("distributor", "country", "language")]
        return self._images(self.films, r("image")).select(
            "id", expr.clean_title("title").alias("title"), expr.year_of(released).alias("year"), released.alias("release_date"), *people, *linked, expr.joined(r("genre")).alias("genre"), r("runtime"), r("budget"), r("gross"),
            r("url").alias("wikipedia_url"), F.col("image_url").alias("cover_image_url"), expr.file_name(r("image")).alias("cover_image_file"), expr.title_from_url(r("url")).alias("wiki_title"),
        )

    @property
    def movie_text(self) -> DataFrame:
        return _texts(self.films)

    @cached_property
    def award_events(self) -> DataFrame:
        return self._parsed("event", schemas.EVENT)

    @property
    def events(self) -> DataFrame:
        r = lambda f: F.col(f"r.{f}")
        linked = [_names(r(f)).alias(f) for f in ("network", "best_film", "most_wins", "opening_film", "closing_film")]
        return self.award_events.select("id", "title", r("kind"), r("award"), r("edition"), r("date"), r("year"), F.array_join(F.transform(r("hosts"), lambda p: p["name"]), ", ").alias("hosts"), r("organizer"), r("venue"), r("location"), *linked, r("image").alias("cover_image_file"), r("url").alias("wikipedia_url"))

    @cached_property
    def _grids(self) -> DataFrame:
        return self._parsed("schedule", schemas.SCHEDULE)

    @property
    def schedules(self) -> DataFrame:
        return self._grids.select("id", "title", "r.season", "r.daypart", F.col("r.url").alias("wikipedia_url"))

    @property
    def schedule_slots(self) -> DataFrame:
        slots = self._grids.select(F.col("id").alias("schedule_id"), F.posexplode("r.entries").alias("pos", "e"))
        shows = self.qids.groupBy("title").agg(F.min("page_id").alias("show"))
        joined = slots.withColumn("_title", expr.canon_title("e.target")).join(shows.withColumnRenamed("title", "_title"), "_title", "left")
        rest = [F.col(f"e.{f}").alias(f) for f in ("day", "network", "start", "end", "part", "title")]
        return joined.select(expr.stable_id(F.lit("slot"), F.col("schedule_id"), F.col("pos")).alias("id"), "schedule_id", *rest, F.when(F.col("_title") != "", F.coalesce("show", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("show_id"), F.col("e.rerun").cast("long").alias("rerun"), "e.rank", "e.rating")

    # Television

    @cached_property
    def _television(self) -> DataFrame:
        rows = self.claims.where(F.col("kind").isin("television", "season", "episode_list"))
        return rows.select(F.col("page_id").alias("source"), "title", "lead", "plot", F.from_json("record", f"struct<{schemas.TELEVISION}>").alias("r"))

    @cached_property
    def shows(self) -> DataFrame:
        """Series by id; of two claims the one with the larger infobox."""
        rows = self._television.where("r.series IS NOT NULL").select(F.col("source").alias("id"), "title", "lead", "plot", F.col("r.series").alias("r"))
        best = Window.partitionBy("id").orderBy(F.desc(F.size("r.raw")), "title")
        return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")

    @cached_property
    def _owners(self) -> DataFrame:
        """(source, series_id): the article itself, the knowledge graph's part-of edge, or the list that a series names."""
        sources = self._television.select("source").distinct()
        own = self._television.where("r.owner IS NOT NULL").select("source", F.col("r.owner").alias("series_id"))
        by_qid = self.qids.select("qid", "page_id")
        ways = [own]
        if self.part_of is not None:
            item, whole = by_qid.select(F.col("qid").alias("item_qid"), F.col("page_id").alias("source")), by_qid.select(F.col("qid").alias("series_qid"), F.col("page_id").alias("series_id"))
            ways.append(self.part_of.join(item, "item_qid").join(whole, "series_qid").groupBy("source").agg(F.max("series_id").alias("series_id")))
        lists = self.shows.select(F.col("id").alias("series_id"), expr.canon_title("r.list_episodes").alias("title"), F.contains("r.list_episodes", F.lit("#")).alias("part")).where("title <> ''")
        claims = lists.join(self.qids.select("title", F.col("page_id").alias("source")), "title")
        ways.append(relational.best_claim(claims, "source", "series_id", [F.col("part"), F.col("series_id")]))
        return relational.owner_by_precedence(sources, "source", ways, self.shows.select(F.col("id").alias("series_id")), "series_id").select("source", "series_id")

    @property
    def unresolved_sources(self) -> DataFrame:
        """Articles with episodes that no series owns; they are counted, never guessed."""
        return self._television.where("r.series IS NULL").join(self._owners, "source", "left_anti").select("source", "title")

    @cached_property
    def _rows(self) -> DataFrame:
        """Episodes by series and season: those of season articles replace inline ones, equal (number, title) come once."""
        each = self._television.join(self._owners, "source").select("series_id", "source", F.col("r.authority").alias("authority"), F.posexplode("r.episodes").alias("pos", "e")).select("series_id", "source", "authority", "pos", "e.*")
        decided = each.groupBy("series_id", "season").agg(F.max("authority").alias("best"))
        kept = each.join(decided, ["series_id", "season"]).where("authority = best")
        return relational.first_per_key(kept, ["series_id", "season", "number_in_season", "title"], ["source", "pos"])

    @cached_property
    def television_episodes(self) -> DataFrame:
        id_ = expr.stable_id(F.lit("episode"), *(F.col(c) for c in ("series_id", "season", "number_overall", "number_in_season", "title")))
        return self._rows.select(id_.alias("id"), "series_id", "season", "number_in_season", "number_overall", "title", "air_date", "viewers", "prod_code")

    @property
    def episode_text(self) -> DataFrame:
        id_ = expr.stable_id(F.lit("episode"), *(F.col(c) for c in ("series_id", "season", "number_overall", "number_in_season", "title")))
        return self._rows.where("summary <> ''").select(id_.alias("id"), "series_id", "summary")

    @cached_property
    def _seasons(self) -> DataFrame:
        """Seasons that any source names; each field from the first source that has it, counts from the episodes where there are any."""
        meta = self._television.join(self._owners, "source").select("series_id", "source", F.posexplode("r.seasons").alias("pos", "s")).select("series_id", "source", "pos", "s.*")
        filled = relational.fill_first(meta, ["series_id", "season"], list(_EMPTY), ["source", "pos"], _EMPTY)
        cast = meta.where(F.size("starring") > 0).groupBy("series_id", "season").agg(F.min_by("starring", F.struct("source", "pos")).alias("starring"))
        counts = self._rows.groupBy("series_id", "season").agg(F.count(F.lit(1)).alias("n"))
        joined = counts.join(filled, ["series_id", "season"], "full_outer").join(cast, ["series_id", "season"], "left")
        plain = [F.coalesce(c, F.lit(e)).alias(c) for c, e in _EMPTY.items() if c != "num_episodes"]
        return joined.select("series_id", "season", F.coalesce("n", "num_episodes", F.lit(0)).alias("num_episodes"), F.coalesce("n", F.lit(0)).alias("n"), *plain, F.coalesce("starring", F.array().cast(schemas.PEOPLE)).alias("starring"))

    @property
    def television_seasons(self) -> DataFrame:
        return self._seasons.select(expr.stable_id(F.lit("season"), F.col("series_id"), F.col("season")).alias("id"), "series_id", "season", "page_id", "num_episodes", "first_aired", "last_aired", "network", _names(F.col("starring")).alias("starring"), "image", "rank", "rating", "viewers")

    @property
    def television_series(self) -> DataFrame:
        r = lambda f: F.col(f"r.{f}")
        counts = self._seasons.groupBy(F.col("series_id").alias("id")).agg(F.count(F.lit(1)).alias("seasons_count"), F.sum("n").alias("episodes_count"))
        return self._images(self.shows, r("image")).join(counts, "id", "left").select(
            "id", expr.clean_series_title("title").alias("title"), expr.year_of(r("first_aired")).alias("year"), r("first_aired"), r("last_aired"), expr.joined(r("genre")).alias("genre"), _names(r("creator")).alias("creator"), _names(r("starring")).alias("starring"), _names(r("network")).alias("network"),
            r("num_seasons"), r("num_episodes"), F.coalesce("seasons_count", F.lit(0)).alias("seasons_count"), F.coalesce("episodes_count", F.lit(0)).alias("episodes_count"), expr.file_name(r("image")).alias("cover_image_file"), F.col("image_url").alias("cover_image_url"), r("url").alias("wikipedia_url"), expr.title_from_url(r("url")).alias("wiki_title"),
        )

    @property
    def television_text(self) -> DataFrame:
        return _texts(self.shows)

    # People

    @cached_property
    def staged_credits(self) -> DataFrame:
        """(work_id, work_type, role, wiki, name) of linked persons; noted: whether the field makes its persons known."""

        def of(df: DataFrame, kind: str, roles: dict[str, Column], noted: bool = True) -> DataFrame:
            groups = F.array(*(F.struct(F.lit(r).alias("role"), c.alias("people")) for r, c in roles.items()))
            each = df.select("id", F.explode(groups).alias("g")).select("id", "g.role", F.explode("g.people").alias("p"))
            return each.where("p.wiki <> ''").select(F.col("id").alias("work_id"), F.lit(kind).alias("work_type"), "role", "p.wiki", "p.name", F.lit(noted).alias("noted"))

        parts = [
            of(self.films, "movie", {r: F.col(f"r.{f}") for r, f in schemas.FILM_ROLES.items()}),
            of(self.shows, "television", {r: F.col(f"r.{f}") for r, f in schemas.SERIES_ROLES.items()}),
            of(self._seasons.withColumnRenamed("series_id", "id"), "television", {"Cast": F.col("starring")}, noted=False),
            of(self._rows.withColumnRenamed("series_id", "id"), "television", {"Director": F.col("directed_by"), "Writer": F.col("written_by")}),
            of(self.award_events, "event", {"Host": F.col("r.hosts")}),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @cached_property
    def _known(self) -> DataFrame:
        """Link targets with an article, and the person that each one is: (wiki, page_id, qid, bio, first)."""
        bios = self._parsed("person", schemas.PERSON).select(expr.canon_title("title").alias("key"), F.col("id").alias("bio_page"), F.col("r").alias("bio"))
        bios = relational.first_per_key(bios, ["key"], [F.desc("bio_page")])
        works = self.claims.where(F.col("kind").isin("movie", "event", "television")).select(expr.canon_title("title").alias("key")).distinct()
        mapped = self.qids.groupBy("title").agg(F.min(F.struct("page_id", "qid")).alias("m")).select(F.col("title").alias("wiki"), F.col("m.page_id").alias("map_page"), F.col("m.qid").alias("qid"))
        targets = self.staged_credits.where("noted").select("wiki").distinct().withColumn("key", expr.canon_title("wiki"))
        persons = targets.join(works.join(bios, "key", "left_anti"), "key", "left_anti")
        joined = persons.join(bios, "key", "left").join(mapped, "wiki", "left")
        page = F.coalesce(F.nullif("bio_page", F.lit(0).cast("long")), F.nullif("map_page", F.lit(0).cast("long")))
        return joined.withColumn("page_id", page).where("page_id IS NOT NULL").select("wiki", "page_id", F.coalesce("qid", F.lit(0)).alias("qid"), "bio")

    @cached_property
    def _persons(self) -> DataFrame:
        """One row for each page: of its targets the one with a biography, else the smallest; the others are aliases."""
        order = F.struct(F.col("bio").isNull().alias("without"), F.col("wiki"))
        best = self._known.groupBy("page_id").agg(F.min(order)["wiki"].alias("wiki"), F.min_by("bio", order).alias("bio"), F.coalesce(F.min_by(F.when(F.col("qid") > 0, F.col("qid")), F.when(F.col("qid") > 0, order)), F.lit(0)).alias("qid"))
        return best

    @cached_property
    def person_alias(self) -> DataFrame:
        known = self._known.select("wiki", F.col("page_id").alias("person_id"))
        only = self._credit_only.select("wiki", F.col("id").alias("person_id"))
        return known.unionByName(only)

    @cached_property
    def _credit_only(self) -> DataFrame:
        """Targets of credits without an article: a derived id, marked by bit 31."""
        lost = relational.unresolved(self.staged_credits, self._known, "wiki", "name")
        return lost.select(expr.stable_id(F.lit("person"), F.col("wiki")).bitwiseOR(F.lit(1 << 31)).alias("id"), "wiki", "name")

    @cached_property
    def people(self) -> DataFrame:
        whole = self._images(self._persons, F.coalesce("bio.image", F.lit("")))
        real = whole.select(F.col("page_id").alias("id"), "page_id", "qid", expr.clean_person_name("wiki").alias("name"), "wiki", "image_url")
        only = self._credit_only.select("id", F.lit(0).cast("long").alias("page_id"), F.lit(0).cast("long").alias("qid"), "name", "wiki", F.lit("").alias("image_url"))
        return real.unionByName(only)

    @property
    def people_bio(self) -> DataFrame:
        some = self._persons.where("bio IS NOT NULL")
        plain = [F.col(f"bio.{c}").alias(c) for c in ("birth_name", "birth_date", "birth_place", "death_date", "death_place")]
        return some.select(F.col("page_id").alias("id"), *plain, expr.joined("bio.occupation").alias("occupation"), "bio.nationality", "bio.years_active", "bio.overview")

    @cached_property
    def credits(self) -> DataFrame:
        return relational.resolved_credits(self.staged_credits.select("wiki", "work_id", "work_type", "role"), self.person_alias).select("person_id", "work_id", "work_type", "role")

    # Knowledge graph

    def _works(self) -> DataFrame:
        films = self.films.select("id", F.lit("movies").alias("kind"))
        return films.unionByName(self.shows.select("id", F.lit("television").alias("kind"))).join(self.qids.select(F.col("page_id").alias("id"), "qid"), "id")

    @property
    def franchises(self) -> DataFrame:
        """Wholes that have an article and a work of ours as a part."""
        parts = self.part_of.join(self._works().select(F.col("qid").alias("item_qid")), "item_qid", "left_semi")
        named = self.qids.select(F.col("qid").alias("series_qid"), F.col("page_id").alias("id"), "title")
        return parts.select("series_qid").distinct().join(named, "series_qid").groupBy("id").agg(F.min(F.struct(F.col("series_qid").alias("qid"), "title")).alias("f")).select("id", "f.qid", "f.title")

    @property
    def franchise_members(self) -> DataFrame:
        edges = self.part_of.select(F.col("item_qid").alias("qid"), "series_qid")
        whole = self.franchises.select(F.col("qid").alias("series_qid"), F.col("id").alias("franchise_id"))
        return self._works().join(edges, "qid").join(whole, "series_qid").select("franchise_id", "id", "kind").distinct()

    @property
    def sequels(self) -> DataFrame:
        works = self._works()
        after = works.select(F.col("qid").alias("next_qid"), F.col("id").alias("next_id"), F.col("kind").alias("next_kind"))
        edges = self.sequel_of.select(F.col("item_qid").alias("qid"), "next_qid")
        return works.join(edges, "qid").join(after, "next_qid").where("kind = next_kind").select("id", "kind", "next_id").distinct()

    @property
    def external_ids(self) -> DataFrame:
        people = self.people.where("qid > 0 AND page_id > 0").select(F.col("page_id").alias("id"), F.lit("people").alias("kind"), "qid")
        subjects = self._works().unionByName(people)
        return subjects.join(self.identifiers.withColumnRenamed("item_qid", "qid"), "qid").select("id", "kind", "source", "value").distinct()

    # The whole

    def tables(self) -> dict[str, DataFrame]:
        names = [t for t in schemas.TABLES if not (t in ("franchises", "franchise_members") and self.part_of is None or t == "sequels" and self.sequel_of is None or t == "external_ids" and self.identifiers is None)]
        return {t: getattr(self, t).select(*schemas.TABLES[t]) for t in names}

    def settled(self, folder: str) -> Database:
        """This database over claims that are written by kind: articles are recognised once, however many tables follow."""
        path = f"{folder.rstrip('/')}/claims"
        self.claims.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(path)
        held = self.claims.sparkSession.read.schema(self.claims.schema).parquet(path)
        return replace(self, claims=held)

    def write(self, folder: str) -> None:
        """Every table as compressed parquet under a folder, beside the claims that they are made of."""
        for name, df in self.settled(folder).tables().items():
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder.rstrip('/')}/{name}.parquet")


def lint(db: dict[str, DataFrame], claims: DataFrame | None = None, cap: int = 0) -> DataFrame:
    """Data-quality findings (kind, title, detail, url) of published tables and claims, each once; at most cap of a kind if that isn't 0."""
    series, seasons, films = db["television_series"], db["television_seasons"], db["movies"]
    start = lambda c: F.substring(c, 1, 4).try_cast("int")
    made = lambda df, kind, title, detail: df.select(F.lit(kind).alias("kind"), F.col(title).alias("title"), detail.alias("detail"))
    wrong = lambda df: df.where((F.length("first_aired") >= 4) & (F.length("last_aired") >= 4) & (start("first_aired") > start("last_aired")) | (F.length("first_aired") == 10) & (F.length("last_aired") == 10) & (F.col("first_aired") > F.col("last_aired")))
    ended = lambda what: F.concat(F.lit(f"{what} "), "first_aired", F.lit(" but ended "), "last_aired")
    named = series.where("wiki_title <> ''")
    parts = seasons.join(named.select(F.col("id").alias("series_id"), "wiki_title"), "series_id")
    parts = parts.where((F.length("first_aired") >= 4) & (F.length("last_aired") >= 4) & (start("first_aired") > start("last_aired")))
    out = made(wrong(named), "ends before it begins", "wiki_title", ended("began")).unionByName(made(parts, "season ends before it begins", "wiki_title", ended("a season began")))
    for df, least, what in ((films, 1878, "film"), (series, 1928, "series")):
        early = df.where((F.col("wiki_title") != "") & (F.col("year") > 0) & (F.col("year") < least))
        out = out.unionByName(made(early, "year outside the medium", "wiki_title", F.concat(F.lit("dated "), F.col("year").cast("string"), F.lit(f", before the {what} medium existed"))))
    if claims is not None:
        listed = claims.where("kind = 'television'").withColumn("_list", F.trim(F.element_at("infobox", "list_episodes")))
        empty = listed.where(F.contains("_list", F.lit("<!--")) & (F.trim(F.regexp_replace("_list", r"(?s)<!--.*?-->", "")) == ""))
        out = out.unionByName(made(empty, "unfilled template placeholder", "title", F.lit("list_episodes holds only the template's own comment")))
        fields = ["starring", "director", "producer", "writer", "creator", "composer", "narrator", "presenter", "music"]
        own = claims.select("title", F.explode("links").alias("l")).where((F.col("l.target") == F.col("title")) & F.col("l.field").isin(fields))
        out = out.unionByName(made(own, "a work credited as a person", "title", F.concat(F.col("l.field"), F.lit(" lists the article itself"))))
    out = out.dropDuplicates(["kind", "title", "detail"]).withColumn("url", expr.article_url("title"))
    return (relational.capped(out, "kind", ["title", "detail"], cap) if cap else out).orderBy("kind", "title", "detail")


# Marks that are left where markup leaks into a name.
LEAKS = ("[[", "<br")


def leaks(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """(table, column, rows) of names that hold markup; nothing where all is well. Each table is scanned once."""
    columns = columns or {"people": ["name"]}
    out = None
    for name, df in tables.items():
        for_each = [F.struct(F.lit(c).alias("column"), F.sum(F.when(sum((F.contains(c, F.lit(m)).cast("int") for m in LEAKS), F.lit(0)) > 0, 1).otherwise(0)).alias("rows")) for c in columns.get(name, [])]
        if for_each:
            one = df.agg(F.array(*for_each).alias("x")).select(F.lit(name).alias("table"), F.inline("x")).where("rows > 0")
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("none of the tables has columns to look at")
    return out


def report(found: DataFrame, form: str = "text", cap: int = 0) -> str:
    """Findings as text, as tab-separated rows, or as a wiki page; at most cap of each kind, with the counts of all."""
    counts = {r.kind: r.n for r in found.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy("kind").collect()}
    shown = (relational.capped(found, "kind", ["title", "detail"], cap) if cap else found).orderBy("kind", "title", "detail").collect()
    if form == "tsv":
        return "".join("\t".join((r.kind, r.title, r.detail, r.url)) + "\n" for r in shown)
    if form not in ("text", "wiki"):
        raise ValueError(f"no report has the form {form}")
    parts = []
    for kind, n in counts.items():
        rows = [r for r in shown if r.kind == kind]
        if form == "wiki":
            parts += [f"== {kind} ({n}) ==", *(f"* [[{r.title}]] — {r.detail}" for r in rows), ""]
        else:
            parts += [f"{kind} ({n})", *(f"  {r.title}: {r.detail}\n    {r.url}" for r in rows), ""]
    return "\n".join([*parts, f"{sum(counts.values())} findings of {len(counts)} kinds", ""])
