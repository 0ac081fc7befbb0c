"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Each text is searched for assigned, access and hexadecimal secrets and for keyword-free tokens that mix letters and
digits. A candidate's value is hashed, and its hash is counted over the whole corpus by distinct owners (source) and
repositories (documents). A value of at most max_owners owners and max_repositories repositories is live-looking; a more widely copied one is an
example. Live-looking keyword-free tokens outside other spans are added to the spans as kind "owned".

Texts are searched in one narrow pass, whose slim result is written to the shared folder. Counting is three
aggregations with map-side combination, each key narrower than the last, so a secret that a third of all documents
hold costs each task one row.

Defined results: null text is empty and has no spans; a null source is an owner of its own; null ids count as one
repository; repeated rows are answered each and count as one repository; a very long text is scanned whole, in time near linear in its matches; matches of one
kind never overlap, and where spans of different kinds begin together the order is that of KINDS; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import DOC_COLUMNS, materialise, text_or_empty

# The patterns, the group that holds the value, and its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
TOKEN = r"[A-Za-z0-9_-]{28,}"
MIXED = ("[0-9]", "[A-Za-z]")  # what an owned token has, wherever
KINDS = {"assign": (ASSIGN, 2, 12), "access": (ACCESS, 0, 18), "hex": (HEX, 0, 16), "owned": (TOKEN, 0, 28)}
BASE = ("assign", "access", "hex")
BLOCK = 200  # matches whose places are summed one by one
SENT = 200_000  # of some 100 bytes each

#: Equal to KINDS where every match that is too short can be skipped at once: a run of the class is one match either way.
SEARCHED = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}


def _spans(kind: str, found: Column, values: Column, text: Column) -> Column:
    """array<struct<start, rank, end, kind, hash>> of a kind's matches; starts are sums of what lies between matches."""
    pattern, _, least = KINDS[kind]
    between = F.split(text, SEARCHED.get(kind, pattern), -1)
    parts = F.zip_with(F.slice(between, 1, F.size(found)), F.arrays_zip(found.alias("m"), values.alias("v")), lambda g, x: F.struct(F.length(g).alias("gap"), F.length(x["m"]).alias("size"), x["v"].alias("value")))
    empty = F.expr("CAST(array() AS array<struct<start:int,rank:int,end:int,kind:string,value:string>>)")
    rank = list(KINDS).index(kind)

    def add(acc, x):
        start = acc["at"] + x["gap"]
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["size"]).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct((start + x["size"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    # Starts are running sums. In blocks, so that no array grows match by match: the work is near linear in the matches.
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda i: F.slice(parts, i * BLOCK + 1, BLOCK))
    lengths = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + x["size"]))
    none_yet = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("out"))
    offsets = F.aggregate(lengths, none_yet, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    all_of = F.flatten(F.zip_with(blocks, offsets, lambda block, at: F.aggregate(block, F.struct(at.alias("at"), empty.alias("out")), add, lambda acc: acc["out"])))
    kept = F.filter(all_of, lambda s: F.length(s["value"]) >= least)
    if kind == "owned":
        kept = F.filter(kept, lambda s: s["value"].rlike(MIXED[0]) & s["value"].rlike(MIXED[1]))
    hashed = F.transform(kept, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"], F.sha2(s["value"], 256).alias("hash")))
    none = F.expr("CAST(array() AS array<struct<start:int,rank:int,end:int,kind:string,hash:string>>)")
    return F.when(F.size(found) > 0, hashed).otherwise(none)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, mark (of the text), owner, spans of all kinds."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("owner"), text_or_empty().alias("text"))
    for kind, (pattern, group, _) in KINDS.items():
        df = df.withColumn(f"m_{kind}", F.regexp_extract_all("text", F.lit(SEARCHED.get(kind, pattern)), F.lit(0)))
        if group:
            df = df.withColumn(f"v_{kind}", F.when(F.size(f"m_{kind}") > 0, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).otherwise(F.col(f"m_{kind}")))
    parts = [_spans(k, F.col(f"m_{k}"), F.col(f"v_{k}" if KINDS[k][1] else f"m_{k}"), F.col("text")) for k in KINDS]
    return df.select("doc_id", F.xxhash64("text").alias("mark"), "owner", F.array_sort(F.concat(*parts)).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """Of each hash: distinct owners and repositories over the corpus."""
    each = found.select("owner", "doc_id", F.explode("spans").alias("s")).select(F.col("s.hash").alias("hash"), "owner", "doc_id")
    by_repository = each.groupBy("hash", "owner", "doc_id").agg(F.lit(1).alias("one"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("one").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))


def scan(docs: DataFrame, max_owners: int = 1, max_repositories: int = 3) -> DataFrame:
    """For each row of docs(doc_id, text, source): doc_id, mark, base and all (arrays of spans; those of all say whether they are live)."""
    found = materialise(candidates(docs), "secrets")
    some = found.where(F.size("spans") > 0)
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    judged = (
        some.select("doc_id", "mark", F.explode("spans").alias("s"))
        .distinct()
        .withColumn("hash", F.col("s.hash"))
        .join(ownership(some).withColumn("live", live).select("hash", "live"), "hash")
        .groupBy("doc_id", "mark")
        .agg(F.array_sort(F.collect_list(F.struct("s.start", "s.rank", "s.end", "s.kind", "live"))).alias("judged"))
    )
    out = found.alias("f").join(judged.alias("j"), F.col("f.doc_id").eqNullSafe(F.col("j.doc_id")) & (F.col("f.mark") == F.col("j.mark")), "left")
    none = F.expr("CAST(array() AS array<struct<start:int,rank:int,end:int,kind:string,live:boolean>>)")
    out = out.select("f.doc_id", "f.mark", F.coalesce("j.judged", none).alias("judged"))
    out = out.withColumn("base", F.filter("judged", lambda s: s["kind"] != "owned"))
    base = F.col("base")
    added = F.filter("judged", lambda s: (s["kind"] == "owned") & s["live"] & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    return out.select("doc_id", "mark", "base", F.array_sort(F.concat("base", added)).alias("all"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    count = lambda c, test: F.size(F.filter(c, test)).cast("long")
    of = lambda kind: lambda s: s["kind"] == kind
    return scanned.select(
        "doc_id",
        *(count("base", of(k)).alias(f"n_{k}") for k in BASE),
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("all").alias("spans"),
        count("all", lambda s: s["live"]).alias("n_live"),
        count("all", lambda s: ~s["live"]).alias("n_example"),
    )


def redact(docs: DataFrame, max_owners: int = 1, max_repositories: int = 3) -> DataFrame:
    """Documents with live-looking secrets replaced by their kind in brackets; examples stay."""
    docs = docs.select(*(F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in DOC_COLUMNS))
    marks = scan(docs, max_owners, max_repositories).select("doc_id", "mark", F.filter("all", lambda s: s["live"]).alias("live")).where(F.size("live") > 0).dropDuplicates(["doc_id", "mark"])
    # Few texts change. Up to SENT of them go to all tasks with their spans, and texts stay where they are; a longer list is joined by id.
    marks = materialise(marks, "live", share=8)
    if marks.count() <= SENT and marks.agg(F.coalesce(F.sum(F.size("live")), F.lit(0))).first()[0] <= 4 * SENT:
        marks = F.broadcast(marks)
    joined = docs.alias("d").join(marks.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.xxhash64(text_or_empty("d.text")) == F.col("m.mark")), "left")
    text = F.col("d.text")

    def put(acc, s):
        inside = s["start"] < acc["at"]  # a span that another has covered already
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.when(inside, "").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]"))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), piece.alias("out"))

    cut = F.aggregate("m.live", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    new = F.when(F.col("m.live").isNotNull(), cut).otherwise(text)
    return joined.select("d.doc_id", new.alias("text"), "d.lang", "d.source", F.when(F.col("m.live").isNotNull(), F.length(new).cast("long")).otherwise(F.col("d.n_chars")).alias("n_chars"))
