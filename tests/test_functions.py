"""Catalyst functions against plain Python, and the markup scanner."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cinelake.functions import expr, register
from cinelake.functions import wikitext as w


def values(spark, column, inputs, names=("s",), types="string"):
    df = spark.createDataFrame([(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)], "i int, " + ", ".join(f"{n} {types}" for n in names))
    return [r[0] for r in df.orderBy("i").select(column).collect()]


TITLES = ["a & b", "", "M*A*S*H", "Léon: The  Professional", "x - y_z", "\tTab", "The Godfather", "ab", "Star—Wars"]


def normalize(s):
    out, space = "", False
    for c in s.lower():
        if c in "abcdefghijklmnopqrstuvwxyz0123456789":
            out, space = out + c, False
        elif c in " \t-_:":
            out, space = out + " " * (not space), True
    return out.strip()


def grams(s):
    return {s[i : i + 3] for i in range(len(s) - 2)}


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def fuzzy(q, t):
    qs, ts = q.split(), t.split()
    best = lambda x: max((1.0 if x == y else dice(grams(x), grams(y)) for y in ts), default=0.0)
    tokens = sum(len(x) * best(x) for x in qs) / sum(map(len, qs)) if qs and ts else 0.0
    return 0.5 * dice(grams(q), grams(t)) + 0.5 * tokens


def test_normalize_and_scores(spark):
    assert values(spark, expr.normalize("s"), TITLES) == [normalize(t) for t in TITLES]
    pairs = [(normalize(a), normalize(b)) for a in TITLES for b in TITLES]
    got = values(spark, expr.fuzzy_score(F.col("q"), F.col("t")), pairs, ("q", "t"))
    assert got == pytest.approx([fuzzy(a, b) for a, b in pairs])


def fnv(*parts):
    h = 0xCBF29CE484222325
    for b in "".join(f"{p}\x1f" for p in parts).encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h & (2**62 - 1) or 1


def test_stable_ids(spark):
    inputs = [("a", "1"), ("", ""), ("é漢", "x" * 300), ("season", "42")]
    assert values(spark, expr.stable_id(F.lit("kind"), F.col("s"), F.col("t")), inputs, ("s", "t")) == [fnv("kind", *i) for i in inputs]


def test_titles(spark):
    cases = {"Foo (film)": "Foo", "Foo (1985 film)": "Foo", "Foo (1966–67 Indian film)": "Foo", "Foo (1975)": "Foo", "Foo (Yellow)": "Foo (Yellow)", "(500) Days of Summer": "(500) Days of Summer", "19(1)(a)": "19(1)(a)", "Foo (2005 François Rotger film)": "Foo", "Foo (Éclair film series)": "Foo", "Foo (filmmaker)": "Foo (filmmaker)", "Foo (1940s animated film series)": "Foo"}
    assert values(spark, expr.clean_title("s"), list(cases)) == list(cases.values())
    cases = {"Foo (2001 TV series)": "Foo", "Foo (Canadian TV programme) ": "Foo", "Foo (xTV series)": "Foo (xTV series)", "Foo (band)": "Foo (band)"}
    assert values(spark, expr.clean_series_title("s"), list(cases)) == list(cases.values())
    assert values(spark, expr.clean_person_name("s"), [" Tom (actor) ", "Tom"]) == ["Tom", "Tom"]


def test_urls(spark):
    p = expr.PREFIX
    cases = {p + "A_b%20c": "A b c", p + "A+b%2B": "A+b+", "https://x.org/A": "", p + "%zz": "", p + "%C3%A9": "é"}
    assert values(spark, expr.title_from_url("s"), list(cases)) == list(cases.values())
    titles = ["A b", "C++ (x)", "é/ü?*!'", "a~b.c-d_e", "50% & more: x=y@z$"]
    from cinelake.operators.recognise import url

    assert values(spark, expr.article_url("s"), titles) == [url(t) for t in titles]
    assert values(spark, expr.file_path_url("s", 220), ["File: a b.jpg", "", "image:x.png"]) == [p + "Special:FilePath/a_b.jpg?width=220", "", p + "Special:FilePath/x.png?width=220"]
    assert values(spark, expr.canon_title("s"), [" foo_bar#x", "File:x", ":en:x", "#x", "étoile"]) == ["Foo bar", "", "", "", "Étoile"]
    assert values(spark, expr.cdn_image_url("s", F.lit(False)), ["star road.jpg"])[0].endswith("/Star_road.jpg")


def test_small_ones(spark):
    assert values(spark, expr.truncate("s", 3), ["abcd", "abc", "é漢字x"]) == ["abc…", "abc", "é漢字…"]
    assert values(spark, expr.viewers("s"), ["23.8<ref/>", "x", "1001", "0", " 9.10&nbsp;m"]) == [23.8, 0.0, 0.0, 0.0, 9.1]
    assert [tuple(r) for r in values(spark, expr.season_of_title("s"), ["Foo season 3", "Foo (season 3)", "Foo (series 2)", "Foo"])] == [("Foo", 3), ("Foo", 3), ("Foo", 2), (None, None)]
    assert values(spark, expr.overview_role("s"), ["Nielsen ratings rank", "Viewers", "Rating share", "x"]) == ["rank", "viewers", "rating", None]
    assert values(spark, expr.record_shard(F.col("s").cast("long")), ["255", "-31", "256"]) == ["ff", "1f", "00"]
    assert values(spark, expr.qid("s"), ["Q12", "P3", "Qx"]) == [12, 0, 0]
    assert values(spark, expr.year_of("s"), ["1999-01-02", "2001", "x"]) == [1999, 2001, 0]
    text = "[[Category:1990s science fiction films|x]] [[Category:Award-winning war books]] [[Category:Sci-fi war films]] [[Category:éwar films]]"
    assert values(spark, expr.genres("s"), [text])[0] == ["Science fiction", "War"] == w.genres(text)[:2]


REF = 'a<ref name="x"/>b<ref>c</ref>d<REF group=y>\n</REF >e'


def test_refs(spark):
    assert values(spark, expr.strip_refs("s"), [REF]) == [w.strip_refs(REF)]
    assert w.clean("'''A''' [[B|C]] {{nowrap|d e}} <br/> f&nbsp;g &amp; <!-- x -->h") == "A C d e f g & h"


def test_templates():
    text = "{{Infobox filmmaker|x=1}} {{infobox Film |a={{b|c}}|d=[[e|f]]|A=2|g}} tail"
    body = w.template(text, "Infobox film")
    assert w.infobox(body) == {"a": "2", "d": "[[e|f]]"}
    assert w.template(text, "Infobox fil") is None and w.template("{{Infobox film|x", "Infobox film") is None
    assert w.template("{{Infobox television season|x}}", "Infobox television") is None
    assert w.template("{{Infobox television season|x}}", "Infobox television", exact=False) == " season|x"
    assert w.parameters("a|{{b|c}}|[[d|e]]|{|f|g|}|h") == ["a", "{{b|c}}", "[[d|e]]", "{|f|g|}", "h"]
    assert [len(b) > 0 for _, b in w.templates("{{Episode list|a}}{{#invoke:Episode list|b}}", "Episode list")] == [True, True]


def test_people():
    names = lambda s: [(p["name"], p["wiki"]) for p in w.people(s)]
    assert names("[[A B]] & [[C|D]] and E") == [("A B", "A B"), ("D", "C"), ("E", "")]
    assert names("[[A and B|X<br />Y]]") == [("X", "A and B"), ("Y", "A and B")]
    assert names("Story & Screenplay: [[A]] (5)") == [("A", "A")]
    assert names("* [[A]]\n* [[A]]\n* {{ill|B|de|b}}\n* {{sortname|C|D}}") == [("A", "A"), ("B", ""), ("C D", "")]
    assert names("x" * 81) == [] and names("{{ubl|[[A]]|class=x|B}}") == [("A", "A"), ("B", "")]
    assert w.links("[[Warner|W]] (worldwide)<br>Other") == [{"name": "W", "wiki": "Warner", "note": "worldwide"}, {"name": "Other", "wiki": "", "note": ""}]
    assert w.items("a<br>* b\n* b") == ["a", "b"]


def test_dates():
    assert w.dates("{{Film date|1999|3|1|Cannes|2000|df=y}}") == ["1999-03-01"]
    assert w.dates("{{Start date|2001}} 2002-01-02") == ["2001", "2002-01-02"]
    assert w.dates("March 5, 1999 and June 1, 2000") == ["1999-03-05", "2000-06-01"] and w.dates("in 1987 and 1988") == ["1987"] and w.dates("") == []
    assert w.life_date("{{birth date and age|df=yes|1960|2|3}}") == "1960-02-03" and w.life_date("{{bda|1960}}") == "1960" and w.life_date("1960") == ""
    assert w.air_date("{{Start date|2001|1|1}} (DVD) {{Start date|2002|2|2}}") == "2002-02-02"
    assert w.production_code("1A<br/>2B<ref>x") == "1A / 2B"
    assert w.trim("é" * 10, 7) == "ééé…" and w.trim("one two three", 9) == "one two…"


def test_tables():
    t = w.tables('{|\n! h !! i\n|-\n| rowspan=2 | a || colspan="2" style=x | [[b|c]]\nmore\n|-\n| d || e\n|}')[0]
    assert [(c.row, c.column, c.rows, c.columns, c.header, c.text) for c in t.cells] == [(0, 0, 1, 1, True, "h"), (0, 1, 1, 1, True, "i"), (1, 0, 2, 1, False, "a"), (1, 1, 1, 2, False, "[[b|c]]"), (2, 1, 1, 1, False, "d"), (2, 2, 1, 1, False, "e")]
    assert t.at(2, 0).text == "a" and t.at(5, 5) is None and w.tables("{| x") == []


def test_lead_and_plot():
    assert w.lead_and_plot("Lead.\n== Plot ==\nA.\n=== Part ===\nB.\n== Cast ==\nC.") == ("Lead.", "A.\n=== Part ===\nB.")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab|=[]{}<>!-*'\n &;é,")), max_size=60))
def test_scanner_never_fails(text):
    from cinelake.operators import recognise

    for f in (w.clean, w.people, w.links, w.items, w.dates, w.tables, w.parameters, w.infobox, w.production_code):
        f(text)
    recognise.recognise(1, "X season 2", "{{Infobox film" + text + "}}{{episode list|" + text + "}}{{Series overview|" + text)


def test_registered_functions(spark):
    register.scalar(spark, "twice", lambda x: x * 2, "long")

    class Longest:
        best = ""

        def step(self, v):
            self.best = max(self.best, v, key=len)

        def done(self):
            return self.best

    register.aggregate(spark, "longest", Longest, "string")
    register.table(spark, "upto", lambda n: ((i,) for i in range(n)), "i: int")
    assert spark.sql("SELECT twice(id) FROM range(3)").collect()[2][0] == 4
    assert spark.sql("SELECT longest(x) FROM VALUES ('a'), ('ccc'), ('bb') AS t(x)").first()[0] == "ccc"
    assert spark.sql("SELECT * FROM upto(3)").count() == 3
    assert spark.range(1).select(register.collated(F.lit("A")) == register.collated(F.lit("a"))).first()[0]
    assert len(register.password_digest("ssha256", "p", "s")) == 32
