"""Markup scanning: templates, parameters, links, lists, people, tables. Plain Python on one text, run inside Arrow UDFs.

Patterns are ASCII where the markup's own rules are; lengths that cap a text count UTF-8 bytes."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, wraps

from cinelake.functions.expr import GENRES

BREAK = re.compile(r"<br\s*/?>", re.I)
BULLET = re.compile(r"^\s*\*+", re.M)
COMMENT = re.compile(r"<!--.*?-->", re.S)
_REF_ALONE = re.compile(r"<ref[^>]*/>", re.I | re.S)
_REF = re.compile(r"<ref[^>]*>.*?</ref>", re.I | re.S)
_TAG = re.compile(r"<[^>]+>", re.S)
_LINK = re.compile(r"\[\[([^\]]+)\]\]")
_SIMPLE_LINK = re.compile(r"\[\[([^\[\]|]*)\|([^\[\]]*)\]\]")
_BRACES = re.compile(r"\{\{|\}\}")
_PLAIN_PARTS = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")
_NUMBER = re.compile(r"\s*[0-9]+\s*")
_IN_NAME = re.compile(r"[ _\t\n]")
_SPREAD = re.compile(r"\[\[[^\[\]|]*\|[^\[\]]*\]\]")
_AND = re.compile(r"\[\[|\]\]| & | and ")
_BOLD = re.compile("'''?")
_BLANKS = re.compile(r"[ \t]+")
#: A text without these is clean but for its ends.
_MARKS = re.compile(r"[<\[{&'\t]|  ")
_PARTS = re.compile(r"\{\{|\}\}|\[\[|\]\]|\{\||\|\}|\|")
# Templates whose parameters are the items of a list, and those that show a person's name.
LISTS = {
    "plainlist",
    "flatlist",
    "hlist",
    "horizontallist",
    "ubl",
    "ublist",
    "ulist",
    "unbulletedlist",
    "bulletedlist",
    "blist",
    "collapsiblelist",
    "pl",
}
FOREIGN = {"ill", "illm", "interlanguagelink", "interlanguagelinkmulti"}

# Names of months, and of date templates in the order in which their dates are taken.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DATE_TEMPLATES = ("film", "start", "end")

# Patterns of the markup that results depend on.
DATE_TEMPLATE = re.compile(r"\{\{([Ff]ilm|[Ss]tart|[Ee]nd) date\|")
LIFE_TEMPLATE = re.compile(r"\{\{\s*(?:birth[ _-]?date(?:[ _-]and[ _-]age)?|death[ _-]?date(?:[ _-]and[ _-]age)?|bda|dda)\s*\|([^}]*)\}\}", re.I)
HOME_VIDEO = re.compile(r"\b(?:DVD|Blu-?ray|BD|VHS|LaserDisc|home\s+(?:video|media)|direct-to-video)\b", re.I | re.A)
PLOT_HEADING = re.compile(r"^=+\s*(?:plot(?:\s+summary)?|synopsis|plot\s+synopsis|premise|storyline)\s*=+\s*$", re.I | re.M)
NOTE_AT_END = re.compile(r"\s*\(([^()]{1,60})\)\s*$")

OVERVIEW_BYTES, PLOT_BYTES, TEXT_BYTES, SHORT_BYTES = 2000, 6000, 120_000, 1500


def closing(text: str, start: int) -> int:
    """Where the template that opens at a place ends, or -1."""
    depth = 0
    for m in _BRACES.finditer(text, start):
        depth += 1 if m[0] == "{{" else -1
        if not depth:
            return m.end()
    return -1


@lru_cache(256)
def _opening(names: str | tuple[str, ...], before: str, after: str) -> re.Pattern:
    """Where a template of one of some names opens; its body begins at the end of the group."""
    named = "|".join(map(re.escape, (names,) if isinstance(names, str) else names))
    return re.compile(r"(\{\{" + before + f"(?:{named}))" + after, re.I | re.A)


_EXACT, _BORDER = r"(?=[ \t\n\r]*[|}])", r"(?=[ \n\t|}<]|\Z)"


def opens(text: str, names: tuple[str, ...]) -> bool:
    """Whether a template of any of the names opens somewhere; where not, template() finds none of them."""
    return _opening(names, "", _EXACT).search(text) is not None


def template(text: str, name: str, exact: bool = True) -> str | None:
    """The body of the first template of a name.

    exact: the name is followed by a bar or the end, blanks aside; else any border will do."""
    m = _opening(name, "", _EXACT if exact else _BORDER).search(text)
    if m is None:
        return None
    end = closing(text, m.start())
    return text[m.end(1) : end - 2] if end >= 0 else None


def templates(text: str, name: str, modules: bool = True) -> list[tuple[int, str]]:
    """(place, body) of all templates whose name begins so, or that invoke a module of that name; none inside another.

    A body keeps what stands after as many characters as the plain opening has, so an invoked one begins amid its name."""
    size, out, at = 2 + len(name), [], 0
    opening = _opening(name, "(?:#invoke:)?" if modules else "", "")
    while m := opening.search(text, at):
        end = closing(text, m.start())
        if end < 0:
            break
        out.append((m.start(), text[m.start() + size : end - 2]))
        at = end
    return out


def _marks(body: str):
    """Braces, brackets and bars of a body; of a table's marks and bars only those bars are told that may part parameters."""
    if "{|" not in body:
        yield from _PLAIN_PARTS.finditer(body)
        return
    at = deep = 0
    while m := _PARTS.search(body, at):
        mark, at = m[0], m.end()
        if mark == "{|":
            deep += 1
        elif mark == "|}" and deep:
            deep -= 1
        elif mark in ("|", "|}"):
            at = m.start() + 1
            if not deep:
                yield _PLAIN_PARTS.match(body, m.start())
        else:
            yield m


def parameters(body: str) -> list[str]:
    """Parts of a template's body between bars that stand in no inner template, link or table."""
    out, last, braces, brackets = [], 0, 0, 0
    for m in _marks(body):
        mark = m[0]
        if mark == "{{":
            braces += 1
        elif mark == "[[":
            brackets += 1
        elif mark == "}}":
            braces = braces - 1 if braces else 0
        elif mark == "]]":
            brackets = brackets - 1 if brackets else 0
        elif not (braces or brackets):
            out.append(body[last : m.start()])
            last = m.start() + 1
    return [*out, body[last:]]


def infobox(body: str) -> dict[str, str]:
    """Named parameters, keys in lower case; the last of equal keys counts."""
    pairs = (p.partition("=") for p in parameters(body))
    return {k.strip().lower(): v.strip() for k, eq, v in pairs if eq and k.strip()}


def strip_refs(text: str) -> str:
    return _REF.sub("", _REF_ALONE.sub("", text)) if "<" in text else text


def _uncommented(text: str) -> str:
    return COMMENT.sub("", text) if "<!--" in text else text


def _lines(text: str) -> str:
    """Breaks and bullets as ends of lines."""
    text = BREAK.sub("\n", text) if "<" in text else text
    return BULLET.sub("\n", text) if "*" in text else text


def _shows(name: str) -> bool:
    return name in LISTS or name in FOREIGN or name.startswith(("sortname", "nowrap", "nobr"))


def _payload(inner: str) -> str:
    """What a template shows: items of lists, names, unbroken text; nothing for others."""
    head = inner.partition("|")[0]
    if "{" not in head and "[" not in head and not _shows(_IN_NAME.sub("", head.strip().lower())):
        return ""  # whatever its parameters are
    first, *rest = parameters(inner)
    name = _IN_NAME.sub("", first.strip().lower())
    if name in LISTS:
        items = []
        for p in map(str.strip, rest):
            key, eq, _ = p.partition("=")
            if not eq or "*" in key:
                items += filter(None, map(str.strip, p.split("*")))
        return "\n".join(items)
    if name in FOREIGN:
        shown = next((p.strip()[3:] for p in rest if p.strip().startswith("lt=")), None)
        return (shown if shown is not None else rest[0] if rest else "").strip()
    if name.startswith("sortname"):
        return " ".join(map(str.strip, rest[:2]))
    return rest[0] if rest and name.startswith(("nowrap", "nobr")) else ""


def unwrap(text: str) -> str:
    """The text with each template replaced by what it shows, outer ones first; stops at one that never ends."""
    while (start := text.find("{{")) >= 0:
        end = closing(text, start)
        if end < 0:
            break
        text = text[:start] + _payload(text[start + 2 : end - 2]) + text[end:]
    return text


def clean(text: str) -> str:
    """Readable text of a piece of markup."""
    if _MARKS.search(text) is None:
        return text.strip()
    text = strip_refs(_uncommented(text))
    text = unwrap(_LINK.sub(lambda m: m[1].rpartition("|")[2], text) if "[[" in text else text)
    text = (_TAG.sub(" ", text) if "<" in text else text).replace("&nbsp;", " ")
    text = (_BOLD.sub("", text) if "''" in text else text).replace("&amp;", "&").replace("&quot;", '"')
    return _BLANKS.sub(" ", text).strip()


def trim(text: str, size: int) -> str:
    """At most so many bytes, cut at a blank if one stands in the second half, with an ellipsis."""
    text = text.strip()
    raw = text.encode()
    if len(raw) <= size:
        return text
    cut = raw[:size]
    blank = cut.rfind(b" ")
    return (cut[:blank] if blank > size // 2 else cut).decode("utf-8", "ignore").strip() + "…"


def canon(target: str) -> str:
    """A link's target as a title; '' for sections and other namespaces."""
    t = target.strip().partition("#")[0].replace("_", " ").strip()
    return "" if not t or t.startswith(("File:", "Image:", "Category:", ":")) else t[0].upper() + t[1:]


def spread_links(text: str) -> str:
    """A link that shows several names, one under the other, becomes a link for each."""

    def each(m: re.Match) -> str:
        target, shown = m[0][2:-2].split("|", 1)
        names = [n.strip() for n in BREAK.split(shown)] if BREAK.search(shown) else []
        return "\n".join(f"[[{target}|{n}]]" for n in names if n) or m[0]

    return _SPREAD.sub(each, text) if "<" in text else text


def _and(line: str) -> list[str]:
    """Parts of a line between ampersands or the word and, outside links."""
    if " & " not in line and " and " not in line:
        return [line]
    out, last, depth = [], 0, 0
    for m in _AND.finditer(line):
        if m[0] in ("[[", "]]"):
            depth = max(0, depth + (1 if m[0] == "[[" else -1))
        elif not depth and m.start() >= last:
            out.append(line[last : m.start()])
            last = m.end()
    return [*out, line[last:]]


def _person(piece: str) -> dict[str, str]:
    name = wiki = ""
    if m := _LINK.search(piece):
        target, bar, shown = m[1].partition("|")
        wiki, name = canon(target), clean(shown if bar else target).strip(",;").strip()
    return {"name": name or clean(piece.strip()).strip(",;").strip() or wiki, "wiki": wiki}


def _remembered(read):
    """A reader of fields that remembers the short ones it met last, for many articles name the same; each call gets entries of its own."""
    known = lru_cache(8192)(read)

    @wraps(read)
    def of(raw: str) -> list[dict[str, str]]:
        return [dict(x) for x in (known if len(raw) <= 200 else read)(raw)] if raw else []

    return of


@_remembered
def people(raw: str) -> list[dict[str, str]]:
    """Persons of a field: the name shown and the link's target, each pair once."""
    text = _lines(spread_links(unwrap(strip_refs(_uncommented(raw)))))
    out: dict[tuple[str, str], dict[str, str]] = {}
    for line in filter(None, map(str.strip, text.split("\n"))):
        label, colon, rest = line.partition(":")
        for piece in _and(rest.strip() if colon and "[[" not in label else line):
            p = _person(piece)
            if p["name"] and len(p["name"].encode()) <= 80:
                out.setdefault((p["wiki"], p["name"]), p)
    return list(out.values())


def items(raw: str) -> list[str]:
    """Distinct entries of a list, cleaned."""
    lines = clean(_lines(raw)).split("\n")
    return list(dict.fromkeys(filter(None, (x.strip("•,;").strip() for x in lines))))


@_remembered
def links(raw: str) -> list[dict[str, str]]:
    """Entries of a list with their first link's target and a note in brackets at the end."""
    text = _uncommented(unwrap(spread_links(_lines(raw))))
    out: dict[str, dict[str, str]] = {}
    for line in filter(None, map(str.strip, text.split("\n"))):
        shown, note, target = clean(line), "", ""
        if ")" in shown and (m := NOTE_AT_END.search(shown)):
            note, shown = m[1].strip(), shown[: m.start()].strip()
        if m := _LINK.search(line):
            target, bar, display = m[1].partition("|")
            shown = clean((display if bar else target).strip() or target.strip()) or shown
        shown = shown.strip("•,;").strip()
        if shown:
            out.setdefault(shown, {"name": shown, "wiki": canon(target), "note": note})
    return list(out.values())


def merged(kind, values, by) -> list:
    """Entries of several fields, the first of each identity."""
    out: dict = {}
    for v in values:
        for x in kind(v):
            out.setdefault(by(x), x)
    return list(out.values())


def merged_people(*values: str) -> list[dict[str, str]]:
    return merged(people, values, lambda p: p["wiki"] or p["name"])


def merged_links(*values: str) -> list[dict[str, str]]:
    return merged(links, values, lambda x: x["wiki"] or x["name"])


_HEADING, _SECTION = re.compile(r"^==", re.M), re.compile(r"^==[^=]", re.M)


def lead_and_plot(text: str) -> tuple[str, str]:
    """What stands before the first heading, and the section on the plot."""
    heading = _HEADING.search(text)
    lead = trim(clean(text[: heading.start()] if heading else text), OVERVIEW_BYTES)
    plot = PLOT_HEADING.search(text)
    if not plot:
        return lead, ""
    rest = text[plot.end() :]
    after = _SECTION.search(rest)
    return lead, trim(clean(rest[: after.start()] if after else rest), PLOT_BYTES)


def plain(text: str) -> str:
    return trim(clean(text), TEXT_BYTES)


_FILM_WORD = re.compile(r"\bfilms?\b", re.I | re.A)
_GENRE = [(g, re.compile(rf"\b(?:{p})\b", re.I | re.A)) for g, p in GENRES]
_CATEGORY = re.compile(r"\[\[Category:([^\]|]+)")


@lru_cache(4096)
def _genres_of(category: str) -> tuple[str, ...]:
    """Genres that the name of a category of films has; many articles share one."""
    return tuple(g for g, p in _GENRE if p.search(category)) if _FILM_WORD.search(category) else ()


def genres(text: str) -> list[str]:
    return list(dict.fromkeys(g for c in _CATEGORY.findall(text) for g in _genres_of(c)))


_ISO = re.compile(r"\b\d{4}-\d{2}-\d{2}\b", re.A)
_IN_WORDS = re.compile(r"([A-Za-z]+)\s+(\d{1,2}),\s*(\d{4})", re.A)
_YEAR = re.compile(r"\b(?:1[89]\d{2}|20\d{2})\b", re.A)


def _template_date(body: str) -> str:
    """The date that a date template's numbers give: a day, or a year where month or day is missing."""
    numbers = [p.strip() for p in body.split("|") if _NUMBER.fullmatch(p)]
    if not numbers or len(numbers[0]) != 4:
        return ""
    year, *rest = numbers
    return f"{year}-{rest[0]:0>2}-{rest[1]:0>2}" if len(rest) >= 2 else year


def dates(raw: str) -> list[str]:
    """Distinct dates of a field: those of date templates, film before start before end, then plain ISO ones; else in words; else a year."""
    if not raw:
        return []
    bodies = [(DATE_TEMPLATES.index(m[1].lower()), raw[m.end() : end]) for m in DATE_TEMPLATE.finditer(raw) if (end := raw.find("}", m.end())) >= 0 and raw.startswith("}}", end)]
    found = [d for _, body in sorted(bodies, key=lambda b: b[0]) if (d := _template_date(body))] + _ISO.findall(raw)
    if not found:
        shown = clean(raw)
        named = ((month.lower(), day, year) for month, day, year in _IN_WORDS.findall(shown))
        found = [f"{year}-{MONTHS.index(month) + 1:02d}-{day:0>2}" for month, day, year in named if month in MONTHS] or _YEAR.findall(shown)[:1]
    return list(dict.fromkeys(found))


def first_date(raw: str) -> str:
    return next(iter(dates(raw)), "")


def life_date(raw: str) -> str:
    """The date of a birth or death template: its leading numbers, if they begin with a year."""
    m = LIFE_TEMPLATE.search(raw)
    numbers: list[int] = []
    for part in map(str.strip, m[1].split("|")) if m else ():
        if not part or "=" in part:
            continue
        if not re.fullmatch(r"[+-]?[0-9]+", part) or len(numbers) == 3:
            break
        numbers.append(int(part))
    if not numbers or numbers[0] <= 1000:
        return ""
    return f"{numbers[0]:04d}-{numbers[1]:02d}-{numbers[2]:02d}" if len(numbers) >= 3 else f"{numbers[0]:04d}"


def leading_int(text: str) -> int:
    m = re.match(r"[0-9]+", (text or "").strip())
    return int(m[0]) if m else 0


def number(text: str) -> float:
    """The first number of a cell, without commas and notes."""
    m = re.search(r"\d+(?:\.\d+)?", clean(text or "").replace(",", ""), re.A)
    return float(m[0]) if m else 0.0


def viewers(text: str) -> float:
    m = re.match(r"\s*([0-9]+(?:\.[0-9]+)?)", (text or "").strip())
    value = float(m[1]) if m else 0.0
    return value if 0 < value <= 1000 else 0.0


def air_date(raw: str) -> str:
    """The first date that isn't one of home video, else the first."""
    starts = [m.start() for m in DATE_TEMPLATE.finditer(raw)]
    if len(starts) < 2:
        return first_date(raw)
    dated = [(HOME_VIDEO.search(part) is not None, d) for a, b in zip(starts, [*starts[1:], len(raw)]) if (d := first_date(part := raw[a:b]))]
    return min(dated, key=lambda x: x[0], default=(False, ""))[1]


def production_code(raw: str) -> str:
    """A production code as it is shown; codes on several lines are joined."""
    text = COMMENT.sub("", raw)
    if "-->" in text:
        return ""
    text = strip_refs(text.partition("<!--")[0])
    text = text[: m.start()] if (m := re.search(r"<ref", text, re.I)) else text
    text = text[: m.start()] if (m := re.search(r"\[(?:[a-z]+:)?//", text)) else text
    codes = (" ".join(c.split()) for c in clean(BREAK.sub("\0", text)).split("\0"))
    return " / ".join(filter(None, codes))


def file_of(value: str) -> str:
    """A bare file name out of an image field."""
    value = COMMENT.sub("", value).strip()
    return value[2:].removesuffix("]]").partition("|")[0].strip() if value.startswith("[[") else value


# Tables


@dataclass(frozen=True)
class Cell:
    row: int
    column: int
    rows: int
    columns: int
    header: bool
    text: str


@dataclass
class Table:
    cells: list[Cell]
    rows: int
    columns: int

    def at(self, row: int, column: int) -> Cell | None:
        """The cell that covers a place."""
        return next((c for c in self.cells if c.row <= row < c.row + c.rows and c.column <= column < c.column + c.columns), None)


def _outside(text: str, mark: str):
    """Places of a mark outside links and templates."""
    depth, at = 0, 0
    for m in re.finditer(r"\[\[|\{\{|\]\]|\}\}|" + re.escape(mark), text):
        if m.start() < at:
            continue
        if m[0] in ("[[", "{{"):
            depth += 1
        elif m[0] in ("]]", "}}"):
            depth = max(0, depth - 1)
        elif not depth:
            yield m.start()
        at = m.end()


def _cells(line: str, mark: str) -> list[str]:
    out, last = [], 0
    for at in _outside(line, mark):
        out.append(line[last:at])
        last = at + len(mark)
    return [*out, line[last:]]


def _attributes(cell: str) -> tuple[str, str]:
    at = next(_outside(cell, "|"), None)
    return ("", cell) if at is None or cell[at : at + 2] == "||" else (cell[:at], cell[at + 1 :])


def _span(attributes: str, name: str) -> int:
    m = re.search(name + r"=\s*[\"']*([0-9]+)", attributes, re.I)
    return max(1, int(m[1])) if m else 1


def tables(text: str) -> list[Table]:
    """All tables, as grids: a cell stands in the first column that no cell above reaches into."""
    out, at = [], 0
    while (start := text.find("{|", at)) >= 0:
        depth = end = 0
        for m in re.finditer(r"\{\||\|\}", text[start:]):
            depth += 1 if m[0] == "{|" else -1
            if not depth:
                end = start + m.end()
                break
        if not end:
            break
        if table := _table(text[start:end]):
            out.append(table)
        at = end
    return out


def _table(source: str) -> Table | None:
    cells: list[Cell] = []
    taken: set[tuple[int, int]] = set()
    row, column = -1, 0
    for line in map(str.strip, source.split("\n")):
        if line.startswith(("{|", "|}", "|+")):
            continue
        if line.startswith("|-"):
            row, column = row + 1, 0
            continue
        if not line.startswith(("!", "|")):
            continue  # more lines of a cell are text only
        row = max(row, 0)
        header = line[0] == "!"
        for raw in _cells(line[1:], "!!" if header else "||"):
            attributes, body = _attributes(raw)
            rows, columns = _span(attributes, "rowspan"), _span(attributes, "colspan")
            while (row, column) in taken:
                column += 1
            cells.append(Cell(row, column, rows, columns, header, body.strip()))
            taken |= {(r, c) for r in range(row, row + rows) for c in range(column, column + columns)}
            column += columns
    return Table(cells, max(c.row + c.rows for c in cells), max(c.column + c.columns for c in cells)) if cells else None
