"""python -m cinelake build DUMPS OUT | search OUT QUERY [--field F] [--limit N] | lint OUT [--form text|tsv|wiki] [--cap N]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from cinelake.operators import publish, recognise
from cinelake.operators.serving import Library
from cinelake.session import session, ship
from cinelake.sources import dumps, files


def library(spark: SparkSession, folder: str) -> Library:
    """The published tables of a folder, and the indexes where they have been written."""
    db = Library({n: spark.read.parquet(p) for n, p in files.list_tables(spark, folder).items()})
    return db.with_indexes(f"{folder}/indexes") if files.exists(spark, f"{folder}/indexes") else db


def build(spark: SparkSession, source: str, folder: str) -> list[str]:
    """All steps from a folder of dumps to a database with indexes; a step whose result is there is left out. Returns the steps done."""
    done = []
    found = files.find_dumps(spark, source)
    if not files.exists(spark, f"{folder}/movies.parquet"):
        claims = recognise.claims(dumps.pages(spark, found["articles"], found["index"]))
        qids = dumps.page_qids(spark, found["page_props"], found["index"])
        graph = next((p for p, _, is_dir in files.listing(spark, source) if not is_dir and "all.json" in p), None)
        edges = dumps.edges(dumps.entities(spark, graph)) if graph else {}
        publish.Database(claims, qids, edges.get("part_of"), edges.get("sequel_of"), edges.get("identifiers"), dumps.image_names(spark, found["images"])).write(folder)
        done.append("database")
    if not files.exists(spark, f"{folder}/indexes"):
        library(spark, folder).rebuild_indexes(f"{folder}/indexes")
        done.append("indexes")
    return done


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cinelake", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("build")
    one.add_argument("dumps")
    one.add_argument("out")
    one = commands.add_parser("search")
    one.add_argument("out")
    one.add_argument("query")
    one.add_argument("--field", default="title")
    one.add_argument("--limit", type=int, default=20)
    one = commands.add_parser("lint")
    one.add_argument("out")
    one.add_argument("--form", default="text")
    one.add_argument("--cap", type=int, default=0)
    given = parser.parse_args(arguments)
    spark = session()
    ship(spark)
    if given.command == "build":
        print("done:", ", ".join(build(spark, given.dumps, given.out)) or "nothing was left to do")
    elif given.command == "search":
        for r in library(spark, given.out).search_movies(given.query, given.field, given.limit).collect():
            print(f"{r.score:.3f}  {r.title} ({r.year or '?'})  {r.director}")
    else:
        tables = library(spark, given.out).tables
        claims = spark.read.parquet(f"{given.out}/claims") if files.exists(spark, f"{given.out}/claims") else None
        print(publish.report(publish.lint(tables, claims), given.form, given.cap))


if __name__ == "__main__":
    main()
