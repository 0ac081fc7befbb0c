import numpy as np
import pytest

from cinelake.llm import quality as q


def test_against_labels(shipped):
    docs = shipped.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = shipped.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = q.score(docs).join(labels, "doc_id").collect()
    kept = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in kept) / len(kept) >= 0.99
    assert sum(not r.kept for r in bad) / len(bad) >= 0.9


def test_edges(make):
    docs = [(i, f"This is a plain sentence with number {i}, and it ends here.") for i in range(40)]
    docs += [(100, None), (101, ""), (102, " \n"), (None, "A fine text, as texts go."), (103, "WOW!! " * 9000), (104, "WOW!! " * 9000), (104, "WOW!! " * 9000)]
    rows = q.score(make(docs)).collect()
    assert len(rows) == len(docs)
    of = {r.doc_id: r for r in rows}
    assert all(of[i].score == 0 and not of[i].kept for i in (100, 101, 102))
    assert of[103].score == of[104].score
    kept = [r.doc_id for r in q.keep(make(docs)).collect()]
    assert set(range(40)) <= set(kept) and not {100, 101, 102} & set(kept)
    assert q.score(make([])).count() == 0 and q.keep(make([])).count() == 0


def test_model_learns_accuracies():
    """Votes drawn from known chances: the estimates come close."""
    rng = np.random.default_rng(0)
    right = np.linspace(0.7, 0.95, q.SIGNALS)
    good = rng.random(20_000) < 0.7
    v = np.where(rng.random((20_000, q.SIGNALS)) < right, good[:, None], ~good[:, None]).astype(int)
    v[rng.random(v.shape) < 0.2] = 2
    patterns, n = np.unique((v * 3 ** np.arange(q.SIGNALS)).sum(axis=1), return_counts=True)
    model = q.LabelModel(dict(zip(patterns.tolist(), n.tolist())))
    assert abs(model.share - 0.7) < 0.03
    assert np.abs(model.accuracy() - right).max() < 0.03
    assert ((model.posterior(v) > 0.5) == good).mean() > 0.95


def test_short_texts_and_long_words_have_the_same_rules():
    """No signal switches with the number of words, and a word's shape is that of all its bytes."""
    nineteen, twenty = ("spam " * 19).strip(), ("spam " * 20).strip()
    assert q.signals(nineteen)[0][3] == 1 - 1 / 19 and q.signals(twenty)[0][3] == 1 - 1 / 20
    assert q.votes(*[q.signals(nineteen)[0], 19])[3] == q.votes(*[q.signals(twenty)[0], 20])[3] == 0
    a = b"Ab1" * 70
    assert q._shape(a + b"-") != q._shape(a + b"+") and q._shape(a) == q._shape(a)


def test_scores_by_hand(make):
    """What the query returns is the fitted model applied text by text."""
    docs = [(i, t) for i, t in enumerate(["The cat sat on the mat, and the dog lay down.", "BUY BUY BUY!!! $$$ NOW!!!", "word " * 40, None, "", "Plain words in a row make a sentence."] * 5)]
    df = make(docs)
    model, weights = q.fit(df)
    want = {}
    for i, t in docs:
        found, words = q.signals(t)
        score = 1 / (1 + np.exp(-float(q.features(found, words) @ weights))) if words else 0.0
        want[i] = (round(score, 6), round(float(model.posterior(q.votes(found, len(words)))) if words else 0.0, 6), score >= 0.5)
    assert {r.doc_id: (round(r.score, 6), round(r.posterior, 6), r.kept) for r in q.score(df).collect()} == want


def test_expectation_maximisation_by_hand():
    """The fitted shares and chances are a fixed point of one step over single votes, counted text by text."""
    rng = np.random.default_rng(5)
    votes = [rng.integers(0, 3, q.SIGNALS) for _ in range(60)] * 3
    counts = {}
    for v in votes:
        counts[q.pattern_of(v)] = counts.get(q.pattern_of(v), 0) + 1
    model = q.LabelModel(counts, rounds=5000)
    good = [float(model.posterior(v)) for v in votes]
    assert model.share == pytest.approx((sum(good) + 1) / (len(good) + 2), abs=1e-5)
    for j in range(q.SIGNALS):
        for vote in range(3):
            mass = sum(p for p, v in zip(good, votes) if v[j] == vote) + 0.5
            assert model.chances[1, j, vote] == pytest.approx(mass / (sum(good) + 1.5), abs=1e-4)
