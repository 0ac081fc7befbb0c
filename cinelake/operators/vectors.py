"""Quantised embeddings, exact similarity, and local navigation."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = 255


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector divided by its length; a zero vector stays. The length is a field of a one-element array, so it is computed once."""
    both = F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("n"))
    scaled = lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(x.cast("double")))
    return F.element_at(F.transform(F.array(both), scaled), 1)


def scale(df: DataFrame, vector: str) -> DataFrame:
    """Least and greatest value of each dimension: (dim, lo, hi)."""
    return df.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def scale_id(lo: list[float], hi: list[float]) -> str:
    """A name for a frozen scale: the first 8 bytes of the digest of its bounds, in hex."""
    both = np.stack((np.asarray(lo, "<f4"), np.asarray(hi, "<f4")), axis=1)
    return hashlib.sha256(both.tobytes()).hexdigest()[:16]


def scale_arrays(bounds: DataFrame) -> tuple[list[float], list[float]]:
    """The bounds on the driver; as many as there are dimensions."""
    rows = sorted(bounds.collect(), key=lambda r: r.dim)
    return [r.lo for r in rows], [r.hi for r in rows]


def write_scale(bounds: DataFrame, path: str) -> str:
    """Freezes a scale under a path, and names it."""
    bounds.select("dim", F.col("lo").cast("float"), F.col("hi").cast("float")).coalesce(1).write.mode("overwrite").parquet(path)
    return scale_id(*scale_arrays(read_scale(bounds.sparkSession, path)))


def read_scale(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("dim int, lo float, hi float").parquet(path)


def clamped(vector: Column, lo: list[float], hi: list[float]) -> Column:
    """How many of a vector's values lie beyond the frozen bounds, where quantise clamps them."""
    bounds = F.array(*(F.struct(F.lit(a).cast("float").alias("lo"), F.lit(b).cast("float").alias("hi")) for a, b in zip(lo, hi)))
    beyond = F.zip_with(vector, bounds, lambda x, b: F.when((b["hi"] > b["lo"]) & ((x.cast("float") < b["lo"]) | (x.cast("float") > b["hi"])), 1).otherwise(0))
    return F.aggregate(beyond, F.lit(0), lambda n, x: n + x)


def quantise(vector: Column, lo: list[float], hi: list[float]) -> Column:
    """Levels 0 to 255 of a vector's dimensions, in single precision; values beyond the frozen bounds are clamped."""
    bounds = F.array(*(F.struct(F.lit(a).cast("float").alias("lo"), F.lit(b).cast("float").alias("hi")) for a, b in zip(lo, hi)))

    def level(x: Column, b: Column) -> Column:
        span = (b["hi"] - b["lo"]).cast("float")
        share = ((x - b["lo"]).cast("float") / span).cast("float")
        return F.when(span <= 0, F.lit(0)).otherwise(F.round(F.least(F.greatest(share * F.lit(float(LEVELS)).cast("float"), F.lit(0.0)), F.lit(float(LEVELS)))).cast("int"))

    return F.zip_with(vector, bounds, level)


def dequantise(levels: Column, lo: list[float], hi: list[float]) -> Column:
    """The unit vector of levels."""
    bounds = F.array(*(F.struct(F.lit(float(a)).alias("lo"), F.lit((float(b) - float(a)) / LEVELS).alias("step")) for a, b in zip(lo, hi)))
    return unit(F.zip_with(levels, bounds, lambda q, b: b["lo"] + q * b["step"]))


def nearest(df: DataFrame, key: str, vector: str, query: list[float] | Column, n: int, skip: list[int] | None = None, within: DataFrame | None = None) -> DataFrame:
    """The n rows with the greatest inner product; ties to the smaller key. One pass, top n by task."""
    q = F.array(*(F.lit(float(x)) for x in query)) if isinstance(query, list) else query
    rows = df if within is None else df.join(within.select(key), key, "left_semi")
    rows = rows.where(~F.col(key).isin(skip)) if skip else rows
    return rows.select(key, dot(F.col(vector), q).alias("score")).orderBy(F.desc("score"), key).limit(n)


def similar(df: DataFrame, key: str, vector: str, to: int, n: int) -> DataFrame:
    """Neighbours of a row, itself left out; the one query row is joined, not collected."""
    query = df.where(F.col(key) == to).select(F.col(vector).alias("_q")).limit(1)
    return df.where(F.col(key) != to).crossJoin(F.broadcast(query)).select(key, dot(F.col(vector), F.col("_q")).alias("score")).orderBy(F.desc("score"), key).limit(n)


def collection(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the asked ids, each once, and the asked ids that have none."""
    asked = ids.select(key).distinct()
    return df.join(asked, key, "left_semi"), asked.join(df.select(key), key, "left_anti")


# Weights of the blocks of a composed vector, and of a walk's signals.
TEXT, GENRE, DECADE = 1.0, 0.35, 0.05
PASSED, AVOID = -0.15, -0.60


def compose(df: DataFrame, key: str, text: str, genres: Column, decade: Column, genre_names: list[str], decade_names: list[str]) -> DataFrame:
    """Text, genre and decade blocks side by side; each block and then the row are made unit vectors."""

    def block(names: list[str], has) -> Column:
        return F.array(*(F.when(has(n), F.lit(1.0)).otherwise(F.lit(0.0)) for n in names)) if names else F.array().cast("array<double>")

    weigh = lambda v, w: F.transform(unit(v), lambda x: x * w)
    whole = F.concat(weigh(F.col(text), TEXT), weigh(block(genre_names, lambda n: F.array_contains(genres, n)), GENRE), weigh(block(decade_names, lambda n: decade == n), DECADE))
    return df.select(key, whole.alias("whole")).select(key, unit(F.col("whole")).alias("vector"))


def mean_vector(df: DataFrame, vector: str, weight: Column) -> DataFrame:
    """Weighted sum by dimension, (dim, x): partial sums on the map side, one row for each dimension in the end."""
    return df.select(weight.cast("double").alias("w"), F.posexplode(vector).alias("dim", "v")).groupBy("dim").agg(F.sum(F.col("w") * F.col("v")).alias("x"))


def taste(df: DataFrame, key: str, vector: str, picks: list[int], passed: list[int], avoid: list[int]) -> list[float]:
    """Where a walk stands: picks, less of what was passed by and of what is avoided; the last pick if that is nothing."""
    k = F.col(key)
    weight = F.when(k.isin(picks), 1.0).when(k.isin(avoid), AVOID).when(k.isin(passed), PASSED) if picks or passed or avoid else F.lit(0.0)
    rows = mean_vector(df.where(k.isin([*picks, *passed, *avoid])), vector, weight).collect()
    x = np.array([r.x for r in sorted(rows, key=lambda r: r.dim)])
    n = np.linalg.norm(x) if len(x) else 0.0
    if not n and picks:
        last = df.where(k == picks[-1]).select(vector).first()
        return [float(v) for v in last[0]] if last else []
    return (x / n).tolist() if n else []


# Navigation. What follows works on the few hundred rows nearest to a place, on the driver.

NEIGHBOURHOOD, STEP = 150, 6.0


def principal(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two leading directions of centred rows, and the variance along each."""
    values, vectors = np.linalg.eigh(rows.T @ rows)
    top = np.argsort(values)[::-1][:2]
    return vectors[:, top].T.copy(), np.maximum(values[top], 0)


def align(axis: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """Keeps an axis's direction from view to view; at first the coordinate that is largest in size is positive."""
    turned = axis[np.abs(axis).argmax()] < 0 if before is None else axis @ before < 0
    return -axis if turned else axis


@dataclass
class View:
    center: int
    cells: list[tuple[int, float, float, float]]  # id, score, x, y
    axes: np.ndarray
    share: tuple[float, float]
    sigma: tuple[float, float]

    def grid(self, columns: int, rows: int) -> list[list[int | None]]:
        """Greedy placement from the middle outwards: each place takes the closest cell that is left."""
        out: list[list[int | None]] = [[None] * columns for _ in range(rows)]
        at = lambda i, n, sign: sign * (-1 + 2 * i / (n - 1)) if n > 1 else 0.0
        places = sorted(((at(c, columns, 1) ** 2 + at(r, rows, -1) ** 2, r, c) for r in range(rows) for c in range(columns)), key=lambda p: p[0])
        left = list(self.cells)
        for _, r, c in places:
            if not left:
                break
            x, y = at(c, columns, 1), at(r, rows, -1)
            best = min(range(len(left)), key=lambda i: (left[i][2] - x) ** 2 + (left[i][3] - y) ** 2)
            out[r][c] = left.pop(best)[0]
        return out


@dataclass
class Explorer:
    """A walk through a collection: look around, take a step along a local axis, look again."""

    df: DataFrame
    key: str
    vector: str
    start: np.ndarray
    step: float = STEP
    neighbourhood: int = NEIGHBOURHOOD
    position: np.ndarray = field(init=False)
    trail: list[int] = field(default_factory=list)
    _axes: np.ndarray | None = None

    def __post_init__(self):
        self.start = np.asarray(self.start, np.float64) / np.linalg.norm(self.start)
        self.position = self.start.copy()

    @classmethod
    def at(cls, df: DataFrame, key: str, vector: str, id_: int, **options) -> Explorer:
        row = df.where(F.col(key) == id_).select(vector).first()
        if row is None:
            raise KeyError(id_)
        return cls(df, key, vector, np.array(row[0]), **options)

    def view(self, n: int = 0) -> View:
        total = self.df.count()
        k = min(self.neighbourhood, max(total // 3, 8))
        near = nearest(self.df, self.key, self.vector, self.position.tolist(), k)
        found = near.join(self.df.select(self.key, self.vector), self.key).orderBy(F.desc("score"), self.key).collect()
        if not found:
            raise LookupError("nothing to explore")
        rows = np.array([r[self.vector] for r in found], np.float64)
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)
        rows -= rows.mean(axis=0)
        axes, variance = principal(rows)
        axes = np.stack([align(a, None if self._axes is None else self._axes[i]) for i, a in enumerate(axes)])
        self._axes = axes
        whole = float((rows**2).sum())
        xy = rows @ axes.T
        reach = np.abs(xy).max(axis=0)
        xy = xy / np.where(reach > 0, reach, 1)
        cells = [(r[self.key], r["score"], float(x), float(y)) for r, (x, y) in zip(found, xy)]
        share = tuple((variance / whole).tolist()) if whole > 0 else (0.0, 0.0)
        return View(found[0][self.key], cells[:n] if n > 0 else cells, axes, share, tuple(np.sqrt(variance / len(rows)).tolist()))

    def move(self, direction: str, n: int = 0) -> View:
        axis, sign = {"left": (0, -1), "right": (0, 1), "down": (1, -1), "up": (1, 1)}[direction]
        seen = self.view()
        self.position = self.position + sign * self.step * seen.sigma[axis] * seen.axes[axis]
        self.position /= np.linalg.norm(self.position)
        after = self.view(n)
        self.trail.append(after.center)
        return after

    def drift(self, n: int) -> tuple[DataFrame, DataFrame] | None:
        """What lies furthest toward, and furthest away from, where the walk has gone; nothing before the first step."""
        way = self.position - self.start
        size = np.linalg.norm(way)
        if not size:
            return None
        scored = self.df.select(self.key, dot(F.col(self.vector), F.array(*(F.lit(float(x)) for x in way / size))).alias("score"))
        return scored.orderBy(F.desc("score"), self.key).limit(n), scored.orderBy("score", F.desc(self.key)).limit(n)


def poles(rows: np.ndarray, n: int) -> list[int]:
    """Places of rows far from each other: from the nearest (the first) on, always the one furthest from all taken."""
    offsets = rows - rows[0]
    taken, gap = [0], (offsets**2).sum(axis=1)
    while len(taken) < min(n, len(rows)):
        best = int(gap.argmax())
        if gap[best] <= 0:
            break
        taken.append(best)
        gap = np.minimum(gap, ((offsets - offsets[best]) ** 2).sum(axis=1))
    return taken


def contrast(rows: DataFrame, key: str, labels: Column, here: Column, there: Column, least: int = 2, gap: float = 0.08, limit: int = 3) -> DataFrame:
    """Labels that one end of an axis has more often than the other, greatest difference first: (label, share_here, share_there, diff)."""
    sized = rows.agg(F.sum(here.cast("double")).alias("a"), F.sum(there.cast("double")).alias("b"))
    each = rows.select(here.alias("h"), there.alias("t"), F.explode(F.array_distinct(labels)).alias("label"))
    counts = each.groupBy("label").agg(F.sum(F.col("h").cast("long")).alias("n_here"), F.sum(F.col("t").cast("long")).alias("n_there")).where(F.col("n_here") >= least)
    share = counts.crossJoin(F.broadcast(sized)).select("label", (F.col("n_here") / F.col("a")).alias("share_here"), F.coalesce(F.col("n_there") / F.nullif(F.col("b"), F.lit(0.0)), F.lit(0.0)).alias("share_there"))
    return share.withColumn("diff", F.col("share_here") - F.col("share_there")).where(F.col("diff") >= gap).orderBy(F.desc("diff"), "label").limit(limit)
