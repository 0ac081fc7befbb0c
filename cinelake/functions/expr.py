"""Scalar text functions as Catalyst expressions: no Python runs in the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " · "
PREFIX = "https://en.wikipedia.org/wiki/"

# The words that make a trailing parenthetical a disambiguator of films and of series.
FILM_WORDS = "films?|film series|short films?|telefilms?|serials?|franchise|miniseries"
SERIES_WORDS = "TV series|TV programme|TV program|TV serial|miniseries|anime|web series|franchise"

#: Word borders of ASCII words; Java's own look at Unicode.
_OPEN, _CLOSE = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

_YEARS = r"\d{4}(?:[–-]\d{2,4})?s?"
_FILM = rf"(?i)\s*\((?:{_YEARS}(?:[ -][\p{{L}}.]+)*(?: (?:{FILM_WORDS}))?|(?:[\p{{L}}.-]+ )*(?:{FILM_WORDS}))\)\s*$"
_SERIES = rf"(?i)\s*\([^()]*{_OPEN}(?:{SERIES_WORDS}){_CLOSE}[^()]*\)\s*$"

# Genres in the order of display, and the pattern that finds each in the name of a category.
GENRES = (
    ("Science fiction", "science[ -]fiction|sci-?fi"),
    ("Fantasy", "fantasy"),
    ("Superhero", "superhero"),
    ("Action", "action"),
    ("Adventure", "adventure"),
    ("Animation", "animated|animation|anime"),
    ("Comedy", "comedy|comedies"),
    ("Romance", "romance|romantic"),
    ("Drama", "drama|melodrama"),
    ("Horror", "horror"),
    ("Slasher", "slasher"),
    ("Thriller", "thriller"),
    ("Mystery", "mystery"),
    ("Crime", "crime"),
    ("Film noir", "film noir|neo-noir"),
    ("War", "war"),
    ("Western", "western"),
    ("Musical", "musical"),
    ("Documentary", "documentary"),
    ("Biography", "biographical|biopic"),
    ("Historical", "historical|period"),
    ("Disaster", "disaster"),
    ("Spy", "spy"),
    ("Sports", "sports?"),
    ("Martial arts", "martial arts"),
    ("Coming-of-age", "coming[ -]of[ -]age"),
    ("Teen", "teen"),
    ("Zombie", "zombie"),
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(s: Column | str) -> Column:
    """Lower case, letters and digits of ASCII, single spaces for blanks, hyphens, underscores and colons."""
    kept = F.regexp_replace(F.lower(_c(s)), r"[^a-z0-9 \t\-_:]", "")
    return F.trim(F.regexp_replace(kept, r"[ \t\-_:]+", " "))


def runs_of_three(s: Column | str) -> Column:
    """All runs of three characters in a row, in one pass over the text: each match steps on by one character and looks two ahead."""
    return F.regexp_extract_all(_c(s), F.lit("(?s)(?=(...))."), F.lit(1))


def trigrams(s: Column | str) -> Column:
    """Distinct runs of three characters."""
    return F.array_distinct(runs_of_three(s))


def dice(a: Column, b: Column) -> Column:
    """Of two sets, twice the common part over the sum of sizes; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def _words(s: Column) -> Column:
    return F.filter(F.split(s, " "), lambda w: w != "")


def token_score(query: Column, target: Column) -> Column:
    """Each word of the query by its best word of the target (1 if equal, trigram overlap from three letters on), weighted by length."""
    words, others = _words(query), _words(target)

    def best(q: Column) -> Column:
        close = lambda t: F.when(q == t, F.lit(1.0)).when((F.length(q) >= 3) & (F.length(t) >= 3), dice(trigrams(q), trigrams(t))).otherwise(F.lit(0.0))
        return F.coalesce(F.array_max(F.transform(others, close)), F.lit(0.0))

    total = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    gained = F.aggregate(words, F.lit(0.0), lambda a, w: a + F.length(w) * best(w))
    return F.when((F.size(words) > 0) & (F.size(others) > 0), gained / total).otherwise(F.lit(0.0))


def fuzzy_score(query: Column, target: Column) -> Column:
    """Half trigram overlap of the whole, half word by word; both sides normalized already."""
    return 0.5 * dice(trigrams(query), trigrams(target)) + 0.5 * token_score(query, target)


def truncate(s: Column | str, n: int) -> Column:
    s = _c(s)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)


def clean_title(s: Column | str) -> Column:
    return F.regexp_replace(_c(s), _FILM, "")


def clean_series_title(s: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(s), _SERIES, ""))


def clean_person_name(s: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.trim(_c(s)), r"\s*\([^()]*\)\s*$", ""))


def title_from_url(s: Column | str) -> Column:
    """The article's title, or '' for another site or a broken escape."""
    s = _c(s)
    rest = F.replace(F.substring(s, len(PREFIX) + 1, 1 << 20), F.lit("+"), F.lit("%2B"))
    return F.when(F.startswith(s, F.lit(PREFIX)), F.coalesce(F.replace(F.try_url_decode(rest), F.lit("_"), F.lit(" ")), F.lit(""))).otherwise(F.lit(""))


def path_escape(s: Column | str) -> Column:
    """Percent-encoding of a path segment, from form encoding by what differs."""
    out = F.replace(F.url_encode(_c(s)), F.lit("+"), F.lit("%20"))
    for code, mark in (("%7E", "~"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3A", ":"), ("%3D", "="), ("%40", "@")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return F.replace(out, F.lit("*"), F.lit("%2A"))


def article_url(title: Column | str) -> Column:
    return F.concat(F.lit(PREFIX), F.replace(path_escape(title), F.lit("%20"), F.lit("_")))


def file_name(s: Column | str) -> Column:
    """A file's name without its prefix."""
    out = F.trim(_c(s))
    for p in ("File:", "file:", "Image:", "image:"):
        out = F.when(F.startswith(out, F.lit(p)), F.substring(out, len(p) + 1, 1 << 20)).otherwise(out)
    return F.trim(out)


def file_path_url(s: Column | str, width: int = 0) -> Column:
    name = file_name(s)
    url = F.concat(F.lit(PREFIX + "Special:FilePath/"), path_escape(F.replace(name, F.lit(" "), F.lit("_"))), F.lit(f"?width={width}" if width > 0 else ""))
    return F.when(name == "", F.lit("")).otherwise(url)


def upper_first(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 20))


def cdn_image_url(s: Column | str, local: Column) -> Column:
    """Address of a file by the digest of its name; local: whether the wiki holds it itself."""
    name = file_name(s)
    canon = upper_first(F.replace(name, F.lit(" "), F.lit("_")))
    h = F.md5(canon.cast("binary"))
    url = F.concat(F.lit("https://upload.wikimedia.org/wikipedia/"), F.when(local, "en").otherwise("commons"), F.lit("/"), F.substring(h, 1, 1), F.lit("/"), F.substring(h, 1, 2), F.lit("/"), path_escape(canon))
    return F.when(name == "", F.lit("")).otherwise(url)


def canon_title(s: Column | str) -> Column:
    """A link's target as the title of an article; '' for sections and other namespaces."""
    t = F.trim(F.replace(F.substring_index(F.trim(_c(s)), "#", 1), F.lit("_"), F.lit(" ")))
    other = F.lit(False)
    for p in ("File:", "Image:", "Category:", ":"):
        other = other | F.startswith(t, F.lit(p))
    return F.when((t == "") | other, F.lit("")).otherwise(upper_first(t))


_MASK32 = 0xFFFFFFFF


def fnv1a(data: Column) -> Column:
    """64-bit FNV-1a of bytes given as a string, in two halves so that no product overflows."""

    def step(h: Column, byte: Column) -> Column:
        x = h.bitwiseXOR(byte)
        low = x.bitwiseAND(F.lit(_MASK32))
        product = low * F.lit(0x1B3)
        high = F.shiftrightunsigned(x, 32) * F.lit(0x1B3) + F.shiftrightunsigned(product, 32) + F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.shiftleft(high.bitwiseAND(F.lit(_MASK32)), 32).bitwiseOR(product.bitwiseAND(F.lit(_MASK32)))

    codes = F.hex(data.cast("binary"))
    n = (F.length(codes) / 2).cast("int")
    each = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.conv(F.substring(codes, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(each, F.lit(-3750763034362895579).cast("long"), step)


def stable_id(*parts: Column) -> Column:
    """A positive 62-bit id of parts, each ended by a unit separator; never 0."""
    data = F.concat(*(x for p in parts for x in (p.cast("string"), F.lit("\x1f"))))
    h = fnv1a(data).bitwiseAND(F.lit(2**62 - 1))
    return F.when(h == 0, F.lit(1).cast("long")).otherwise(h)


def strip_refs(s: Column | str) -> Column:
    """Without citations; self-closing ones go first, else they would open a pair."""
    return F.regexp_replace(F.regexp_replace(_c(s), r"(?is)<ref[^>]*/>", ""), r"(?is)<ref[^>]*>.*?</ref>", "")


def clean_html(s: Column | str) -> Column:
    """Plain text of markup that has no templates: comments, citations, links, tags, entities, bold marks, blanks."""
    out = strip_refs(F.regexp_replace(_c(s), r"(?s)<!--.*?-->", ""))
    out = F.regexp_replace(out, r"\[\[(?:[^\]]*\|)?([^\]|]*)\]\]", "$1")
    for pattern, to in ((r"(?is)<[^>]+>", " "), ("&nbsp;", " "), ("'''?", ""), ("&amp;", "&"), ("&quot;", '"'), (r"[ \t]+", " ")):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(F.regexp_replace(out, r"^\s+|\s+$", ""))


def genres(text: Column | str) -> Column:
    """Genres found in the names of film categories, first met first."""
    names = F.regexp_extract_all(_c(text), F.lit(r"\[\[Category:([^\]|]+)"), F.lit(1))
    films = F.filter(names, lambda c: c.rlike(rf"(?i){_OPEN}films?{_CLOSE}"))
    of = lambda c: F.filter(F.array(*(F.when(c.rlike(rf"(?i){_OPEN}(?:{p}){_CLOSE}"), F.lit(g)) for g, p in GENRES)), lambda g: g.isNotNull())
    return F.array_distinct(F.flatten(F.transform(films, of)))


def year_of(s: Column | str) -> Column:
    """The year that a date begins with, or 0."""
    return F.when(_c(s).rlike(r"^\d{4}"), F.substring(_c(s), 1, 4).cast("long")).otherwise(F.lit(0).cast("long"))


def decade(year: Column) -> Column:
    return F.when(year > 1870, F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))).otherwise(F.lit(""))


def first_number(s: Column | str) -> Column:
    """The number that a value begins with, commas dropped; 0 if none."""
    return F.coalesce(F.regexp_extract(F.replace(_c(s), F.lit(","), F.lit("")), r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))


def viewers(s: Column | str) -> Column:
    """Millions of viewers: the leading number if it is over 0 and at most 1000, else 0."""
    n = F.coalesce(F.regexp_extract(_c(s), r"^\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))
    return F.when((n > 0) & (n <= 1000), n).otherwise(F.lit(0.0))


def season_of_title(title: Column | str) -> Column:
    """(series, season) of a season's article, or nulls."""
    pattern = r"(?i)^(.*?)\s+(?:\(\s*)?(?:season|series)\s+(\d+)\s*\)?$"
    return F.struct(F.nullif(F.regexp_extract(_c(title), pattern, 1), F.lit("")).alias("series"), F.regexp_extract(_c(title), pattern, 2).try_cast("long").alias("season"))


def overview_role(heading: Column | str) -> Column:
    """What a column of a season overview holds: rank comes before viewers, viewers before ratings."""
    h = F.lower(_c(heading))
    return F.when(h.contains("rank"), "rank").when(h.contains("viewer") | h.contains("audience"), "viewers").when(h.contains("rating") | h.contains("share"), "rating")


def joined(items: Column | str) -> Column:
    return F.array_join(_c(items), SEPARATOR)


def split_joined(s: Column | str) -> Column:
    return F.when(_c(s) == "", F.array().cast("array<string>")).otherwise(F.split(_c(s), SEPARATOR))


def record_shard(id_: Column | str) -> Column:
    """Two hex digits that name a record's folder."""
    return F.lower(F.lpad(F.hex(F.abs(_c(id_) % 256)), 2, "0"))


def qid(s: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(_c(s), r"^Q(\d+)$", 1).try_cast("long"), F.lit(0).cast("long"))
