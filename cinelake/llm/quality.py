"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each text. The votes of all documents are counted by
pattern, and expectation-maximisation on these counts estimates how often each labeller is right in either class, and
with that the posterior label of each pattern. The posterior labels train a linear scorer over hashed word shapes and
binned signals, fitted on a bounded sample (train_rows documents, those whose ids hash lowest). The scorer judges whole texts.

Counting patterns is one aggregation over at most 3 ** labellers keys; scoring is a narrow pass. Nothing but pattern
counts and the sample reaches the driver.

Defined results: null and blank texts are rejected with score 0; repeated documents get equal scores; null ids are
scored, and do not train; an empty table gives an empty table; without any vote in the corpus all documents that have a word are kept
with score 0.5; very long texts are judged whole; documents whose ids hash alike train in the order of ids, then of text hashes; a score of just 0.5
is kept; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import DOC_COLUMNS, column, slices, trimmed

TRAIN_ROWS = 4000
SHAPES = 2048
SLICE = 4 << 20
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
#: Marks that prose has, as fixed values: white space, sentence marks, quotes, brackets, apostrophe, hyphen.
_PROSE = b" \t\n\r.,;:?'\"()-" + _UPPER + _LOWER + _DIGIT + bytes(range(128, 256))
_FOLD = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_REPEAT = re.compile(rb"(.)\1+")

#: Signal, votes bad at or beyond, votes good at or within; between the two a labeller says nothing.
LABELLERS = (
    ("marks", 0.04, 0.01),  # share of bytes that prose doesn't have
    ("capitals", 0.40, 0.15),  # share of capitals among ASCII letters
    ("repeats", 0.20, 0.03),  # share of words equal to the word before
    ("sameness", 0.75, 0.45),  # one less the share of distinct words among up to the first 100 of each 100
    ("bars", 0.08, 0.01),  # share of words that are bars or bullets
    ("shouts", 0.20, 0.02),  # share of words that end in an exclamation mark
    ("tails", 0.20, 0.02),  # share of words that end in a mark which doesn't end a word of prose
    ("length", 14.0, 9.0),  # mean bytes of a word
)
SIGNALS = len(LABELLERS)
BINS = 8
DIMENSIONS = SHAPES + SIGNALS * BINS + 1


def signals(text: str | None) -> tuple[np.ndarray, list[bytes]]:
    """Of a text: the labellers' signals, and its words."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(SIGNALS), words
    capitals = len(raw) - len(raw.translate(None, _UPPER))
    letters = capitals + len(raw) - len(raw.translate(None, _LOWER))
    distinct = sum(len(set(words[i : i + 100])) for i in range(0, n, 100))
    tails = [w[-1] for w in words]
    return np.array(
        [
            len(raw.translate(None, _PROSE)) / len(raw),
            capitals / max(letters, 1),
            sum(map(bytes.__eq__, words[1:], words)) / n,
            1 - distinct / n,
            sum(words.count(b) for b in (b"|", b"*", b"-", b"\xe2\x80\xa2")) / n,
            tails.count(33) / n,
            sum(tails.count(b) for b in b"#$%&*+=<>@^_`{|}~/\\") / n,
            sum(map(len, words)) / n,
        ]
    ), words


def votes(found: np.ndarray, n_words: int) -> np.ndarray:
    """1 good, 0 bad, 2 nothing."""
    bad, good = np.array([b for _, b, _ in LABELLERS]), np.array([g for _, _, g in LABELLERS])
    return np.full(SIGNALS, 2) if not n_words else np.where(found >= bad, 0, np.where(found <= good, 1, 2))


def pattern_of(v: np.ndarray) -> int:
    return int((v * 3 ** np.arange(SIGNALS)).sum())


class LabelModel:
    """Class share and, for each labeller and class, the chances of its votes; fitted by expectation-maximisation."""

    def __init__(self, counts: dict[int, int], rounds: int = 200):
        patterns = np.array(sorted(counts), np.int64)
        weight = np.array([counts[p] for p in patterns.tolist()], np.float64)
        self.seen = bool(len(patterns))
        v = patterns[:, None] // 3 ** np.arange(SIGNALS) % 3
        hot = np.eye(3)[v]
        # Start: any bad vote outweighs the good ones, as what is wrong with a text shows in few labellers.
        q = np.where((v == 0).any(axis=1), 0.2, 0.8)
        self.share, self.chances = 0.5, np.full((2, SIGNALS, 3), 1 / 3)
        for _ in range(rounds if self.seen else 0):
            for c, part in enumerate((1 - q, q)):
                mass = np.einsum("p,pjv->jv", weight * part, hot) + 0.5
                self.chances[c] = mass / mass.sum(axis=1, keepdims=True)
            self.share = (weight @ q + 1) / (weight.sum() + 2)
            after = self.posterior(v)
            if np.abs(after - q).max() < 1e-9:
                break
            q = after

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Chance that a text of these votes is good."""
        at = np.arange(SIGNALS)
        odds = np.log(self.share / (1 - self.share)) + np.log(self.chances[1, at, v] / self.chances[0, at, v]).sum(axis=-1)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def accuracy(self) -> np.ndarray:
        """How often each labeller, where it votes, is right."""
        good, bad = self.chances[1], self.chances[0]
        right = self.share * good[:, 1] + (1 - self.share) * bad[:, 0]
        return right / (right + self.share * good[:, 0] + (1 - self.share) * bad[:, 1])


_shapes: dict[bytes, int] = {}


def _shape(word: bytes) -> int:
    """Hash of a word's shape: letters and digits folded, runs cut."""
    if len(_shapes) > 150_000:
        _shapes.clear()
    found = _shapes.get(word)
    if found is None:
        found = zlib.crc32(_REPEAT.sub(rb"\1\1", word.translate(_FOLD))) % SHAPES
        if len(word) <= 64:
            _shapes[word] = found
    return found


def features(found: np.ndarray, words: list[bytes]) -> np.ndarray:
    out = np.zeros(DIMENSIONS, np.float32)
    out[-1] = 1
    if words:
        counts = np.bincount(np.fromiter(map(_shape, words), np.int64, len(words)), minlength=SHAPES)
        out[:SHAPES] = np.sqrt(counts / len(words))
        bad, good = np.array([b for _, b, _ in LABELLERS]), np.array([g for _, _, g in LABELLERS])
        place = np.clip((found - good) / (bad - good), 0, 1) * (BINS - 1)
        out[SHAPES + np.arange(SIGNALS) * BINS + np.round(place).astype(int)] = 1
    return out


def _forgetting(scan):
    """A task's function that leaves no words behind in its worker."""

    def run(batches):
        yield from scan(batches)
        _shapes.clear()

    return trimmed(run)


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels, by accelerated gradient steps scaled for each dimension."""
    w, past, scale = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for i in range(rounds if len(x) else 0):
        slope = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y).astype(np.float32) / len(x) + decay * w
        past = 0.9 * past + 0.1 * slope
        scale = 0.99 * scale + 0.01 * slope**2
        w = w - rate * (past / (1 - 0.9 ** (i + 1))) / (np.sqrt(scale / (1 - 0.99 ** (i + 1))) + 1e-3) * 0.1
    return w


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[LabelModel, np.ndarray]:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def patterns(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                out: dict[int, int] = {}
                for t in column(part, "text"):
                    found, words = signals(t)
                    if words:
                        p = pattern_of(votes(found, len(words)))
                        out[p] = out.get(p, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.int64())], names=["pattern", "n"])

    counts = {r.pattern: r.n for r in base.mapInArrow(_forgetting(patterns), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    model = LabelModel(counts)
    # The documents with the lowest hashes: a threshold keeps about four times as many, then the least are taken.
    total = sum(counts.values())
    border = min(2**62 - 1, 4 * train_rows * 2**62 // max(total, 1))
    place = F.xxhash64("doc_id").bitwiseAND(F.lit(2**62 - 1))
    chosen = base.where("doc_id IS NOT NULL").where(place <= border).orderBy(place, "doc_id", F.xxhash64("text")).limit(train_rows)

    def rows(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                made = [signals(t) for t in column(part, "text")]
                made = [(f, w) for f, w in made if w]
                yield pa.RecordBatch.from_arrays([pa.array([pattern_of(votes(f, len(w))) for f, w in made], pa.int64()), pa.array([features(f, w).astype(np.float16).tobytes() for f, w in made], pa.binary())], names=["pattern", "features"])

    sample = chosen.mapInArrow(_forgetting(rows), "pattern long, features binary").toArrow()
    if not sample.num_rows:
        return model, np.zeros(DIMENSIONS, np.float32)
    x = np.frombuffer(b"".join(sample["features"].to_pylist()), np.float16).reshape(-1, DIMENSIONS).astype(np.float32)
    v = sample["pattern"].to_numpy()[:, None] // 3 ** np.arange(SIGNALS) % 3
    return model, train(x, model.posterior(v))


def _judge(texts: list, model: LabelModel, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    made = [signals(t) for t in texts]
    full = np.array([bool(w) for _, w in made], bool)
    v = np.stack([votes(f, len(w)) for f, w in made]) if made else np.zeros((0, SIGNALS), int)
    raw = np.array([float(features(f, w) @ weights) for f, w in made])
    return np.where(full, 1 / (1 + np.exp(-np.clip(raw, -500, 500))), 0.0), np.where(full, model.posterior(v), 0.0), v


def score(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """For each row of docs(doc_id, text): score, posterior of its votes, votes, kept."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, train_rows))

    def scan(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                scores, posteriors, v = _judge(column(part, "text"), *sent.value)
                marks = ["".join("-+ "[x] for x in row) for row in v.tolist()]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(scores), pa.array(posteriors), pa.array(marks, pa.string()), pa.array(scores >= 0.5)], names=["doc_id", "score", "posterior", "votes", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_forgetting(scan), "doc_id long, score double, posterior double, votes string, kept boolean")


def keep(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that the classifier does not reject."""
    docs = docs.select(*(F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in DOC_COLUMNS))
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, train_rows))

    def scan(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield part.filter(pa.array(_judge(column(part, "text"), *sent.value)[0] >= 0.5))

    return docs.mapInArrow(_forgetting(scan), "doc_id long, text string, lang string, source string, n_chars long")
