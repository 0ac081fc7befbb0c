"""Language identification by a linear-chain conditional random field.

The chain's labels are languages, one for each word of a line. A word's features are hashed affixes, byte n-grams, the
word itself, and membership in lexicons learned from the training rows. Weights and transitions are trained by stochastic gradient on a
bounded sample (train_docs documents of each language, segments from all over their texts); part of the segments are
spliced from two languages, so that the transitions learn to switch. Whole texts are then labelled by
forward-backward, and a document's language is the one with the most posterior mass over its words.

Training looks at text and lang of the rows given for it; a prediction sees the text alone. Prediction is a narrow
pass; the model has a fixed number of weights.

Defined results: null texts and texts without a letter are "und" with score 0; so is everything if no row can be learned from; ties go to the
language that sorts first; null ids are predicted like others and never trained on; repeated rows are answered each; further columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import column, slices, trimmed

TRAIN_DOCS = 600
SEGMENTS, SEGMENT_WORDS = 4, 24
LEXICON_PLACES = 64  # or one for each language, where there are more
BUCKETS = 1 << 15
PIECE = 40  # bytes of a long token that are labelled as one
LONG = 26  # a token of fewer bytes stays below PIECE in lower case
CUT = b"\xff"  # occurs in no text
LEXICON_WORDS = 20_000
LINE_WORDS = 64
SLICE = 4 << 20
TABLE_WORDS = 250_000
_STRIP = bytes(range(0, 65)) + bytes(range(91, 97)) + bytes(range(123, 128))


def normal(token: bytes) -> bytes:
    """A token without what surrounds its letters, in lower case."""
    core = token.strip(_STRIP)
    return core.lower() if core.isascii() else core.decode().lower().encode()


def has_letter(word: bytes) -> bool:
    return any(c.isalpha() for c in word.decode()) if not word.isascii() else not word.isdigit() and any(65 <= c <= 90 or 97 <= c <= 122 for c in word)


def pieces(token: bytes) -> list[bytes]:
    """A token in lower case, or a long one's parts in a row, each two bytes into the next; CUT stands where a part was cut."""
    word = normal(token)
    if len(word) <= PIECE:
        return [token]
    if not has_letter(word):
        return []
    starts = range(0, len(word) - 2, PIECE - 2)
    return [CUT * (i > 0) + word[i : i + PIECE] + CUT * (i + PIECE < len(word)) for i in starts]


def features(word: bytes, lexicon: dict[bytes, list[int]], places: int = LEXICON_PLACES) -> list[int]:
    """Places of a word's weights; the first ones are the lexicons'. Affixes are those of the whole token."""
    edged = (b"" if word.startswith(CUT) else b"<") + word.strip(CUT) + (b"" if word.endswith(CUT) else b">")
    keys = [b"w" + word]
    if not word.startswith(CUT):
        keys += [b"p" + edged[:n] for n in (2, 3, 4, 5) if n < len(edged)]
    if not word.endswith(CUT):
        keys += [b"s" + edged[-n:] for n in (2, 3, 4, 5) if n < len(edged)]
    keys += [edged[i : i + 3] for i in range(len(edged) - 2)]
    return [1 + places + zlib.crc32(k) % (BUCKETS - places - 1) for k in keys] + [1 + x for x in lexicon.get(word, ())[:3]]


class Model:
    """Weights of the chain; place 0 is the empty feature."""

    def __init__(self, languages: list[str], lexicon: dict[bytes, list[int]]):
        self.languages, self.lexicon = languages, lexicon
        n = len(languages)
        self.places = max(LEXICON_PLACES, n)
        self.weights = np.zeros((BUCKETS, n), np.float32)
        self.steps = np.zeros((n, n), np.float32)
        self.start = np.zeros(n, np.float32)

    def rows(self, words: list[bytes]) -> np.ndarray:
        found = [features(w, self.lexicon, self.places) for w in words]
        out = np.zeros((len(words), max(map(len, found), default=0)), np.int32)
        for i, f in enumerate(found):
            out[i, : len(f)] = f
        return out

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        return self.weights[rows].sum(axis=1)


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, start: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of labels, and summed posteriors of transitions, for lines (line, word, label) of falling length."""
    s, t, n = emissions.shape
    heat = np.exp(emissions - emissions.max(axis=2, keepdims=True))
    move = np.exp(steps)
    ahead, scale = np.zeros((s, t, n), np.float32), np.ones((s, t, 1), np.float32)
    active = [int(np.searchsorted(-lengths, -i, side="left")) for i in range(t)]  # lines that are longer than i
    for i in range(t):
        a = active[i]
        x = (np.exp(start) if i == 0 else ahead[:a, i - 1] @ move) * heat[:a, i]
        scale[:a, i] = x.sum(axis=1, keepdims=True)
        ahead[:a, i] = x / scale[:a, i]
    back = np.ones((s, t, n), np.float32)
    moves = np.zeros((n, n), np.float64)
    for i in reversed(range(t - 1)):
        a = active[i + 1]
        x = heat[:a, i + 1] * back[:a, i + 1] / scale[:a, i + 1]
        back[:a, i] = x @ move.T
        moves += move * (ahead[:a, i].T @ x)
    both = ahead * back
    return both / np.maximum(both.sum(axis=2, keepdims=True), 1e-30), moves


def train(languages: list[str], segments: list[tuple[int, list[bytes]]], rounds: int = 6, batch: int = 96, rate: float = 0.15, decay: float = 1e-5, seed: int = 7) -> Model:
    counts: dict[bytes, np.ndarray] = {}
    for label, words in segments:
        for w in words:
            counts.setdefault(w, np.zeros(len(languages), np.int32))[label] += 1
    known = sorted((w for w, c in counts.items() if c.sum() >= 3), key=lambda w: (-int(counts[w].sum()), w))[:LEXICON_WORDS]
    lexicon = {w: [int(i) for i in np.argsort(-counts[w], kind="stable") if counts[w][i] >= 0.3 * counts[w].sum()] for w in known}
    model = Model(languages, lexicon)
    rng = np.random.default_rng(seed)
    names = sorted(counts)
    number = {w: i for i, w in enumerate(names)}
    rows = model.rows(names)
    lines = [(np.array([number[w] for w in words]), np.full(len(words), label)) for label, words in segments if words]
    n = len(languages)
    grads, moves_grads = np.full((BUCKETS, n), 1e-4, np.float32), np.full((n, n), 1e-4)
    for _ in range(rounds if lines else 0):
        order = rng.permutation(len(lines))
        made = []
        for i in order:
            words, labels = lines[i]
            if rng.random() < 0.3:  # a line that switches language
                other, others = lines[rng.integers(len(lines))]
                a, b = rng.integers(1, len(words) + 1), rng.integers(0, len(other))
                words, labels = np.concatenate((words[:a], other[b:])), np.concatenate((labels[:a], others[b:]))
            made.append((words[:LINE_WORDS], labels[:LINE_WORDS]))
        for at in range(0, len(made), batch):
            part = sorted(made[at : at + batch], key=lambda x: -len(x[0]))
            lengths = np.array([len(w) for w, _ in part])
            t = int(lengths[0])
            inside = np.arange(t) < lengths[:, None]
            f = np.zeros((len(part), t, rows.shape[1]), np.int32)
            y = np.zeros((len(part), t), np.int64)
            f[inside] = rows[np.concatenate([w for w, _ in part])]
            y[inside] = np.concatenate([v for _, v in part])
            p, moves = forward_backward(model.weights[f].sum(axis=2), lengths, model.start, model.steps)
            gap = (np.eye(n, dtype=np.float32)[y] - p) * inside[:, :, None]
            flat = f[inside].ravel()
            slope = np.stack([np.bincount(flat, np.repeat(gap[inside][:, j], rows.shape[1]), minlength=BUCKETS) for j in range(n)], axis=1)
            slope[0] = 0
            seen = np.zeros((n, n))
            np.add.at(seen, (y[:, :-1][inside[:, 1:]], y[:, 1:][inside[:, 1:]]), 1)
            slope = slope.astype(np.float32) / len(part)
            grads += slope**2
            model.weights += rate * slope / np.sqrt(grads) - rate * decay * model.weights
            step = (seen - moves) / len(part)
            moves_grads += step**2
            model.steps += (rate * step / np.sqrt(moves_grads)).astype(np.float32)
    return model


def _lines(raw: bytes) -> list[list[bytes]]:
    """The tokens of each line, long lines cut."""
    out = []
    for line in raw.split(b"\n"):
        tokens = [p for t in line.split() for p in (pieces(t) if len(t) > LONG else (t,))]
        out += [tokens[i : i + LINE_WORDS] for i in range(0, len(tokens), LINE_WORDS)]
    return out


class Labeller:
    """Labels texts; keeps the emissions of tokens that it has seen in a bounded table."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self):
        self.number: dict[bytes, int] = {}
        self.table = np.zeros((0, len(self.model.languages)), np.float32)

    def _numbers(self, tokens: list[bytes]) -> np.ndarray:
        """Places in the table; -1 for tokens without a letter."""
        if len(self.number) > TABLE_WORDS:
            self.clear()
        get = self.number.get
        out = np.fromiter((get(t, -2) for t in tokens), np.int64, len(tokens))
        if (out == -2).any():
            new = list(dict.fromkeys(t for t, n in zip(tokens, out.tolist()) if n == -2))
            words = [t if CUT in t else normal(t) for t in new]
            full = [i for i, w in enumerate(words) if w and (CUT in w or has_letter(w))]
            distinct = sorted(dict.fromkeys(words[i] for i in full), key=len)  # words of one batch get as many places as its longest needs
            place = {w: i for i, w in enumerate(distinct)}
            made = np.concatenate([self.model.emissions(self.model.rows(distinct[i : i + 4096])) for i in range(0, len(distinct), 4096)]) if distinct else self.table[:0]
            base = len(self.table)
            self.number |= dict.fromkeys(new, -1) | {new[i]: base + place[words[i]] for i in full}
            self.table = np.concatenate([self.table, made])
            get = self.number.__getitem__
            out = np.fromiter(map(get, tokens), np.int64, len(tokens))
        return out

    def mass(self, texts: list[str | None]) -> np.ndarray:
        """For each text the summed posteriors of the labels of its words."""
        lines, owners = [], []
        for i, t in enumerate(texts):
            for tokens in _lines((t or "").encode("utf-8", "replace")):
                lines.append(tokens)
                owners.append(i)
        n = len(self.model.languages)
        out = np.zeros((len(texts), n))
        if not lines or not n:
            return out
        numbers = self._numbers([t for line in lines for t in line])
        line_of = np.repeat(np.arange(len(lines)), [len(x) for x in lines])[numbers >= 0]
        numbers = numbers[numbers >= 0]
        lengths = np.bincount(line_of, minlength=len(lines))
        firsts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        owners = np.array(owners)
        for at in range(0, len(order), 2048):
            part = order[at : at + 2048]
            size = lengths[part]
            inside = np.arange(int(size[0])) < size[:, None]
            emissions = np.zeros((len(part), int(size[0]), n), np.float32)
            places = np.concatenate([np.arange(a, a + b) for a, b in zip(firsts[part].tolist(), size.tolist())])
            emissions[inside] = self.table[numbers[places]]
            p, _ = forward_backward(emissions, size, self.model.start, self.model.steps)
            np.add.at(out, owners[part], (p * inside[:, :, None]).sum(axis=1))
        return out


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Learns from docs(doc_id, text, lang); rows without lang, text or id teach nothing."""
    base = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = base.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = sorted(r.lang for r in counts)
    if not languages:
        return train([], [])
    place = F.xxhash64("doc_id").bitwiseAND(F.lit(2**62 - 1))
    borders = F.create_map(*(x for r in counts for x in (F.lit(r.lang), F.lit(min(2**62 - 1, train_docs * 2**62 // r["count"])))))

    def segments(batches):
        for batch in batches:
            langs, rows = [], []
            for lang, text in zip(column(batch, "lang"), column(batch, "text")):
                parts = [p for t in text.encode("utf-8", "replace").split() for p in (pieces(t) if len(t) > LONG else (t,))]
                words = [w for t in parts if (w := t if CUT in t else normal(t)) and (CUT in w or has_letter(w))]
                step = max(SEGMENT_WORDS, len(words) // SEGMENTS)
                for i in list(range(0, len(words), step))[:SEGMENTS]:
                    langs.append(lang)
                    rows.append(words[i : i + SEGMENT_WORDS])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.list_(pa.binary()))], names=["lang", "words"])

    sample = base.where(place <= F.element_at(borders, F.col("lang"))).mapInArrow(trimmed(segments), "lang string, words array<binary>").toArrow()
    number = {x: i for i, x in enumerate(languages)}
    found = sorted(((number[x], w) for x, w in zip(sample["lang"].to_pylist(), sample["words"].to_pylist())), key=lambda r: (r[0], r[1]))
    return train(languages, found)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """For each row of docs(doc_id, text): lang_pred, score, words labelled, and share of the second language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        labeller = Labeller(sent.value)
        names = sent.value.languages
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                mass = labeller.mass(column(part, "text"))
                total = mass.sum(axis=1)
                share = mass / np.maximum(total, 1e-30)[:, None]
                best = share.argmax(axis=1) if names else np.zeros(len(mass), int)
                some = total > 0
                score = np.where(some, np.clip(share.max(axis=1), 0, 1), 0.0) if names else np.zeros(len(mass))
                second = np.where(some, np.sort(share, axis=1)[:, -2], 0.0) if len(names) > 1 else np.zeros(len(mass))
                langs = [names[b] if s else "und" for b, s in zip(best.tolist(), some.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")), pa.array(langs, pa.string()), pa.array(score), pa.array(np.round(total).astype(np.int64)), pa.array(second)], names=["doc_id", "lang_pred", "score", "n_words", "second_share"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(scan), "doc_id long, lang_pred string, score double, n_words long, second_share double")


def remainder(mod: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def identify(docs: DataFrame, mod: int = 4, held: int = 2, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Learns from the rows whose crc32(doc_id) modulo mod is not held, predicts all."""
    model = fit(docs.where(remainder(mod) != held), train_docs)
    found = predict(docs, model)
    return found.select("doc_id", F.coalesce(remainder(mod) == held, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_words", "second_share")
