import itertools

import numpy as np
from pyspark.sql import functions as F

from cinelake.llm import language_id as li


def test_held_out_accuracy(shipped):
    docs = shipped.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = li.identify(docs.drop("source", "n_chars"))
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(shipped, make):
    docs = [(i, "the thing of that and this was here") for i in range(30)]
    df = make(docs).drop("lang").selectExpr("*", "CASE WHEN doc_id % 2 = 0 THEN 'en' END AS lang")
    other = make([(100, None), (101, ""), (102, "123 !! 45"), (103, "é"), (None, "the thing"), (104, "THE " * 4000), (104, "the")])
    both = df.unionByName(other.withColumn("lang", F.lit(None).cast("string")))
    rows = {(r.doc_id, r.lang_pred) for r in li.identify(both).collect() if r.doc_id is None or r.doc_id >= 100}
    assert {(100, "und"), (101, "und"), (102, "und")} <= rows
    assert all(p != "und" for i, p in rows if i in (103, 104, None))


def test_nothing_to_learn_from(make):
    rows = li.identify(make([(1, "a b"), (2, None)]).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    assert li.identify(make([])).count() == 0


def test_forward_backward_is_exact():
    """Posteriors against the sum over all ways to label a line."""
    rng = np.random.default_rng(4)
    lengths = np.array([4, 3, 1])
    e, start, steps = rng.normal(size=(3, 4, 3)).astype(np.float32), rng.normal(size=3), rng.normal(size=(3, 3))
    p, moves = li.forward_backward(e, lengths, start, steps)
    all_moves = np.zeros((3, 3))
    for s, n in enumerate(lengths):
        total, want = 0.0, np.zeros((n, 3))
        ways = []
        for way in itertools.product(range(3), repeat=int(n)):
            w = np.exp(start[way[0]] + sum(e[s, i, y] for i, y in enumerate(way)) + sum(steps[a, b] for a, b in itertools.pairwise(way)))
            total += w
            ways.append((way, w))
            for i, y in enumerate(way):
                want[i, y] += w
        for way, w in ways:
            for a, b in itertools.pairwise(way):
                all_moves[a, b] += w / total
        assert np.allclose(p[s, :n], want / total, atol=1e-4)
    assert np.allclose(moves, all_moves, atol=1e-4)


def test_code_switching():
    words = {"en": b"the thing that with from have this was".split(), "de": "der die das und nicht ist schön auch".encode().split()}
    segments = [(i, [words[x][(j + k) % 8] for k in range(8)]) for i, x in enumerate(("de", "en")) for j in range(60)]
    model = li.train(["de", "en"], segments)
    mass = li.Labeller(model).mass(["the thing that was", "der die das ist", "this was the thing und das ist nicht schön"])
    assert mass[0, 1] > 3 and mass[1, 0] > 3
    assert mass[2, 1] > 2.5 and mass[2, 0] > 3


def test_all_bytes_of_long_tokens_count():
    long = b"a" * 60 + b"xyz" + b"b" * 60
    found = li.pieces(long)
    grams = {x.strip(li.CUT)[i : i + 3] for x in found for i in range(len(x))}
    assert {long[i : i + 3] for i in range(len(long) - 2)} <= grams
    assert li.features(found[-1], {}) != li.features(li.pieces(long[:-1] + b"c")[-1], {})
    word = b"abcdefghijklmnopqrstuvwxyz"
    assert set(li.features(word, {})) - set(li.features(word[:12] + b"#" + word[13:], {})) > set(li.features(word, {})[:1])


def test_text_without_spaces_is_judged_as_a_whole():
    words = {"en": b"the thing that with from have this was".split(), "de": "der die das und nicht ist schön auch".encode().split()}
    segments = [(i, [words[x][(j + k) % 8] for k in range(8)]) for i, x in enumerate(("de", "en")) for j in range(60)]
    labeller = li.Labeller(li.train(["de", "en"], segments))
    start = "\u00a0".join(["the thing that with"] * 3).replace(" ", "\u00a0")
    rest = "\u00a0".join(["der und nicht schön das ist auch die"] * 20).replace(" ", "\u00a0")
    mass = labeller.mass([f"{start}\u00a0{rest}"])
    assert mass[0, 0] > mass[0, 1] and mass[0].sum() > 10


def test_rare_languages_stay(make):
    docs = make([(i, " ".join(f"w{i // 2}x{j}" for j in range(12))) for i in range(140)]).selectExpr("doc_id", "text", "CONCAT('l', LPAD(CAST(doc_id DIV 2 AS STRING), 2, '0')) AS lang")
    assert len(li.fit(docs).languages) == 70
