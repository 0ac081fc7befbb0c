"""What the requests of a reader's browser return, as plain values: a caller puts them behind any server.

Each function takes a Library and the request's parameters, all strings as a query string has them."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from cinelake.operators.serving import Library

HITS = 25


class NotFound(LookupError):
    """No row has the id that was asked for."""


def _rows(df: DataFrame) -> list[dict]:
    """Hits are few: at most HITS rows."""
    return [r.asDict(recursive=True) for r in df.limit(HITS).collect()]


def _one(df: DataFrame, what: str) -> dict:
    row = df.first()
    if row is None:
        raise NotFound(what)
    return row.asDict(recursive=True)


def _number(params: Mapping[str, str], name: str = "id") -> int:
    raw = params.get(name, "")
    return int(raw) if raw.removeprefix("-").isdigit() else 0


def movies(db: Library, params: Mapping[str, str]) -> list[dict]:
    return _rows(db.search_movies(params.get("q", ""), params.get("field") or "title", HITS))


def television(db: Library, params: Mapping[str, str]) -> list[dict]:
    return _rows(db.search_television(params.get("q", ""), params.get("field") or "title", HITS))


def episodes(db: Library, params: Mapping[str, str]) -> list[dict]:
    return _rows(db.search_episodes(params.get("q", ""), HITS))


def people(db: Library, params: Mapping[str, str]) -> list[dict]:
    return _rows(db.search_people(params.get("q", ""), HITS))


def events(db: Library, params: Mapping[str, str]) -> list[dict]:
    return _rows(db.search_events(params.get("q", ""), HITS))


def everything(db: Library, params: Mapping[str, str]) -> list[dict]:
    return db.search_all(params.get("q", ""), HITS)


def movie(db: Library, params: Mapping[str, str]) -> dict:
    return _one(db.movie_view(_number(params)), f"film {params.get('id', '')}")


def show(db: Library, params: Mapping[str, str]) -> dict:
    return _one(db.television_view(_number(params)), f"series {params.get('id', '')}")


def event(db: Library, params: Mapping[str, str]) -> dict:
    return _one(db.event_view(_number(params)), f"event {params.get('id', '')}")


def person(db: Library, params: Mapping[str, str]) -> dict:
    """A person by id, else by link target, else by exact name, with what they are known for."""
    found = db.person_id(_number(params), params.get("wiki", ""), params.get("name", ""))
    if not found:
        raise NotFound("person")
    bio = db.people_bio.where(f"id = {found}").first()
    works = [r.asDict(recursive=True) for r in db.filmography(found).collect()]
    return db.person_by_id(found).asDict() | {"bio": bio.asDict(recursive=True) if bio else None, "works": works}


ROUTES: dict[str, Callable[[Library, Mapping[str, str]], object]] = {
    "/api/search": movies,
    "/api/television": television,
    "/api/episodes": episodes,
    "/api/people": people,
    "/api/events": events,
    "/api/all": everything,
    "/movie": movie,
    "/television": show,
    "/event": event,
    "/person": person,
}


def handle(db: Library, path: str, params: Mapping[str, str]) -> object:
    if path not in ROUTES:
        raise NotFound(path)
    return ROUTES[path](db, params)
