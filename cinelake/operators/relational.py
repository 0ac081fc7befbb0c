"""Joins, aggregations, windows and orders of the media database, over any tables of the right shape."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.functions.expr import SEPARATOR


def lookup(df: DataFrame, key: str, ids: Sequence[int]) -> DataFrame:
    """Rows of some ids in the order asked for; an id asked for twice comes once, misses are absent."""
    asked = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(dict.fromkeys(ids))], f"pos long, {key} long")
    return df.join(asked, key).orderBy("pos")


def by_kind(facts: DataFrame, dimensions: dict[str, DataFrame], kind: str, key: str) -> DataFrame:
    """Facts with the row of the dimension that their kind names: one left join for each kind, the guard inside the condition.

    dimensions: kind -> (id, title, year). Facts of other kinds keep nulls."""
    out = facts.alias("f")
    for name, d in dimensions.items():
        out = out.join(d.alias(name), (F.col(f"f.{kind}") == name) & (F.col(f"f.{key}") == F.col(f"{name}.id")), "left")
    pick = lambda c: F.coalesce(*(F.when(F.col(f"f.{kind}") == n, F.col(f"{n}.{c}")) for n in dimensions))
    return out.select("f.*", pick("title").alias("title"), pick("year").alias("year"))


def resolved_credits(staged: DataFrame, aliases: DataFrame) -> DataFrame:
    """Credits by person: staged(wiki, ...) by alias(wiki, person_id), each once."""
    return staged.join(aliases, "wiki").drop("wiki").distinct()


def unresolved(staged: DataFrame, known: DataFrame, key: str, name: str) -> DataFrame:
    """Keys of staged rows that nothing resolves, with the smallest name given for each."""
    return staged.join(known.select(key), key, "left_anti").groupBy(key).agg(F.min(name).alias(name))


def best_claim(claims: DataFrame, item: str, owner: str, order: Sequence[Column]) -> DataFrame:
    """One owner of each item: the least by the order."""
    return claims.groupBy(item).agg(F.min(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col(owner).alias("owner")))["owner"].alias(owner))


def owner_by_precedence(items: DataFrame, key: str, sources: Sequence[DataFrame], known: DataFrame, owner: str) -> DataFrame:
    """The first source (key, owner) that names an owner decides; owners must be known."""
    out, names = items, []
    for i, s in enumerate(sources):
        names.append(f"_o{i}")
        out = out.join(s.select(key, F.col(owner).alias(names[-1])), key, "left")
    return out.withColumn(owner, F.coalesce(*names)).drop(*names).join(known.select(owner), owner, "left_semi")


def overlapping(slots: DataFrame, keys: Sequence[str], apart: str, start: str, end: str, name: str, buckets: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Pairs of slots that share their keys, differ in apart, and overlap in time; each pair once, the smaller name first.

    An equi-join on the keys and on a span of time, with the overlap as a residual condition. buckets: start, end -> the numbers, in a row, of the
    spans that a slot reaches into; so slots that are far apart never meet, however many share their keys. A pair is told in the first span that both reach."""
    reach = buckets(F.col(start), F.col(end)) if buckets else F.array(F.lit(0))
    spread = slots.withColumn("_reach", reach).withColumn("_first", F.col("_reach")[0]).withColumn("_span", F.explode("_reach")).drop("_reach")
    a, b = spread.alias("a"), spread.alias("b")
    cond = (F.col("a._span") == F.col("b._span")) & (F.col("a._span") == F.greatest("a._first", "b._first"))
    for k in keys:
        cond = (F.col(f"a.{k}") == F.col(f"b.{k}")) & cond
    cond = cond & (F.col(f"a.{apart}") != F.col(f"b.{apart}")) & (F.col(f"a.{start}") < F.col(f"b.{end}")) & (F.col(f"a.{end}") > F.col(f"b.{start}")) & (F.col(f"a.{name}") < F.col(f"b.{name}"))
    return a.join(b, cond).select(*(F.col(f"a.{k}") for k in keys), F.col(f"a.{name}").alias("left"), F.col(f"b.{name}").alias("right"))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def lost_but_alive(tip: DataFrame, new: DataFrame, alive: DataFrame, key: str) -> DataFrame:
    """Ids that a new build drops although their page still exists."""
    return tip.select(key).join(new.select(key), key, "left_anti").join(alive.select(key), key, "left_semi")


def diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Record differences: op (1 changed, 2 deleted, 3 inserted), the key, the names of changed columns, both rows.

    One full join on the key. Presence is told by a mark, not by values, and values are compared null-safe."""
    values = [c for c in before.columns if c not in keys]
    a = before.select(*keys, F.struct(*values, F.lit(True).alias("_in")).alias("a"))
    b = after.select(*keys, F.struct(*values, F.lit(True).alias("_in")).alias("b"))
    there = lambda s: F.coalesce(F.col(f"{s}._in"), F.lit(False))
    changed = F.filter(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in values)) if values else F.array().cast("array<string>"), lambda x: x.isNotNull())
    op = F.when(there("a") & there("b") & (F.size(changed) > 0), 1).when(there("a") & ~there("b"), 2).when(~there("a") & there("b"), 3)
    joined = a.join(b, list(keys), "full_outer")
    out = joined.select(*keys, op.alias("op"), F.when(op == 1, changed).alias("changed"), *(F.col(f"a.{c}").alias(f"old_{c}") for c in values), *(F.col(f"b.{c}").alias(f"new_{c}") for c in values))
    return out.where("op IS NOT NULL")


def apply_diff(before: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table after the changes of diff()."""
    values = [c for c in before.columns if c not in keys]
    kept = before.join(changes.select(*keys), list(keys), "left_anti")
    new = changes.where("op <> 2").select(*keys, *(F.col(f"new_{c}").alias(c) for c in values))
    return kept.unionByName(new).select(*before.columns)


def filmography(rows: DataFrame, person: str, role: str, title: str, year: str, kind: str, work: str, ranks: dict[str, int], clean=lambda c: c) -> DataFrame:
    """Works of a person by role, newest first, as one list for each role.

    Rows without a title go; of equal (role, kind, title) the smallest work stays; titles are cleaned afterwards. Roles
    come in the order of their ranks, unlisted ones as rank 0."""
    once = rows.where(F.coalesce(F.col(title), F.lit("")) != "").groupBy(person, role, kind, title).agg(F.min(F.struct(F.col(work).alias("work"), F.col(year).alias("year"))).alias("w"))
    entry = F.struct((-F.coalesce(F.col("w.year"), F.lit(0))).alias("order"), F.col("w.work").alias("work"), clean(F.col(title)).alias("title"), F.col("w.year").alias("year"))
    rank = F.coalesce(*(F.when(F.col(role) == r, F.lit(n)) for r, n in ranks.items()), F.lit(0))
    lists = once.groupBy(person, role).agg(F.sort_array(F.collect_list(entry)).alias("works"))
    return lists.select(person, rank.alias("role_rank"), role, F.transform("works", lambda w: F.struct(w["work"], w["title"], w["year"])).alias("works")).orderBy(person, "role_rank", role)


def fill_first(rows: DataFrame, key: Sequence[str], columns: Sequence[str], order: Sequence[str], empty: dict[str, object]) -> DataFrame:
    """Of rows about the same thing, each column from the first row in which it isn't empty."""
    place = F.struct(*order)

    def first(c: str) -> Column:
        value = F.col(c)
        some = value.isNotNull() & (value != F.lit(empty[c]))
        return F.coalesce(F.min_by(F.when(some, value), F.when(some, place)), F.lit(empty[c])).alias(c)

    return rows.groupBy(*key).agg(*(first(c) for c in columns))


def facets(rows: DataFrame, key: str, labels: Column) -> DataFrame:
    """How many rows have each label; a label counts once in a row."""
    return rows.select(key, F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def first_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key, whole."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def preceding(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], value: Column, name: str) -> DataFrame:
    """Each row with the last value before it that isn't null."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def capped(rows: DataFrame, kind: str, order: Sequence[Column | str], cap: int) -> DataFrame:
    """At most so many rows of each kind: a report's cap."""
    w = Window.partitionBy(kind).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def totals_or_parts(rows: DataFrame, key: Sequence[str], total: str, part: str, name: str) -> DataFrame:
    """The stated total of a key, or where it is 0 the sum of its parts."""
    return rows.groupBy(*key).agg(F.coalesce(F.nullif(F.max(total), F.lit(0).cast("long")), F.sum(part)).alias(name))


def merged_numbers(inline: DataFrame, authority: DataFrame, overview: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """All keys of three sources; the authority's value beats the inline one, which beats the overview's."""
    a, b, c = (d.select(*key, F.col(value).alias(n)) for d, n in ((inline, "_i"), (authority, "_a"), (overview, "_o")))
    out = a.join(b, list(key), "full_outer").join(c, list(key), "full_outer")
    return out.select(*key, F.coalesce("_a", "_i", "_o").alias(value))


def named(people: Column) -> Column:
    """Names of a list of people in one string."""
    return F.array_join(F.transform(people, lambda p: p["name"]), SEPARATOR)
