"""Schemas of records and of the published tables, as DDL."""

PEOPLE = "array<struct<name:string,wiki:string>>"
LINKS = "array<struct<name:string,wiki:string,note:string>>"

_FILM_PEOPLE = "director producer writer starring music narrator cinematography editing".split()
_FILM_LINKS = "production_companies distributor based_on country language".split()
_SERIES_PEOPLE = "creator starring composer director producer executive_producer writer editor cinematography presenter narrator".split()
_SERIES_LINKS = "network country production_companies based_on related".split()


def _fields(names, kind: str) -> str:
    return ", ".join(f"{n}: {kind}" for n in names)


FILM = f"{_fields(_FILM_PEOPLE, PEOPLE)}, {_fields(_FILM_LINKS, LINKS)}, {_fields('runtime budget gross image url'.split(), 'string')}, release_dates: array<string>, genre: array<string>, raw: map<string,string>"
EVENT = f"hosts: {PEOPLE}, {_fields('network previous next best_film most_wins most_nominations opening_film closing_film main_competition'.split(), LINKS)}, {_fields('kind award date venue location founded image organizer url'.split(), 'string')}, edition: bigint, year: bigint"
PERSON = f"{_fields('birth_name birth_place death_place years_active nationality image birth_date death_date overview'.split(), 'string')}, occupation: array<string>"
SCHEDULE = "entries: array<struct<rerun:boolean,rank:bigint,rating:double,title:string,target:string,day:string,network:string,part:string,start:string,end:string>>, daypart: string, season: string, url: string"
SERIES = f"{_fields(_SERIES_PEOPLE, PEOPLE)}, {_fields(_SERIES_LINKS, LINKS)}, {_fields('num_seasons num_episodes runtime list_episodes first_aired last_aired image url'.split(), 'string')}, genre: array<string>, raw: map<string,string>"
SEASON = f"season:bigint,page_id:bigint,first_aired:string,last_aired:string,starring:{PEOPLE},network:string,image:string,num_episodes:bigint,rank:bigint,rating:double,viewers:double"
EPISODE = f"season:bigint,title:string,directed_by:{PEOPLE},written_by:{PEOPLE},number_overall:bigint,number_in_season:bigint,air_date:string,prod_code:string,summary:string,viewers:double"
TELEVISION = f"form: string, authority: boolean, owner: bigint, series: struct<{SERIES.replace(': ', ':')}>, seasons: array<struct<{SEASON}>>, episodes: array<struct<{EPISODE}>>"

#: Roles of credits, in the order of display, and the field of a record that each comes from.
FILM_ROLES = {"Director": "director", "Writer": "writer", "Producer": "producer", "Cast": "starring", "Composer": "music", "Cinematographer": "cinematography", "Editor": "editing", "Narrator": "narrator"}
SERIES_ROLES = {"Creator": "creator", "Cast": "starring", "Composer": "composer", "Director": "director", "Producer": "producer", "Executive Producer": "executive_producer", "Writer": "writer", "Editor": "editor", "Cinematographer": "cinematography", "Presenter": "presenter", "Narrator": "narrator"}
ROLE_RANK = {r: i for i, r in enumerate("Director,Writer,Creator,Producer,Executive Producer,Cast,Presenter,Narrator,Composer,Cinematographer,Editor,Host".split(","))}

#: Columns of the published tables, in the order in which they are hashed.
TABLES = {
    "movies": "id title year release_date director producer writer starring music distributor country language genre runtime budget gross wikipedia_url cover_image_url cover_image_file wiki_title",
    "people": "id page_id qid name wiki image_url",
    "people_bio": "id birth_name birth_date birth_place death_date death_place occupation nationality years_active overview",
    "credits": "person_id work_id work_type role",
    "person_alias": "wiki person_id",
    "television_series": "id title year first_aired last_aired genre creator starring network num_seasons num_episodes seasons_count episodes_count cover_image_file cover_image_url wikipedia_url wiki_title",
    "television_seasons": "id series_id season page_id num_episodes first_aired last_aired network starring image rank rating viewers",
    "television_episodes": "id series_id season number_in_season number_overall title air_date viewers prod_code",
    "events": "id title kind award edition date year hosts organizer venue location network best_film most_wins opening_film closing_film cover_image_file wikipedia_url",
    "schedules": "id title season daypart wikipedia_url",
    "schedule_slots": "id schedule_id day network start end part title show_id rerun rank rating",
    "movie_text": "id overview",
    "television_text": "id overview",
    "episode_text": "id series_id summary",
    "franchises": "id qid title",
    "franchise_members": "franchise_id id kind",
    "sequels": "id kind next_id",
    "external_ids": "id kind source value",
}
TABLES = {t: c.split() for t, c in TABLES.items()}
