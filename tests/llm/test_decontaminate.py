import hashlib
import random

import numpy as np
import pytest

from cinelake.llm import decontaminate as dc


def brute(docs, items, window=10):
    phrases = {}
    for name, text in items:
        w = dc.words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[k : k + window]), set()).add("null" if name is None else str(name))
    out = []
    for i, text in docs:
        w, hit, found = dc.words(text), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in phrases:
                    hit.update(range(k, k + n))
                    found |= phrases[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def key(r):
    return tuple((x is None, x) for x in r)


def test_whole_sample(shipped, sample):
    bench = shipped.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = rows(dc.digest(dc.find(sample, bench)))
    want = brute([(r.doc_id, r.text) for r in sample.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(r[5] for r in got)


@pytest.mark.parametrize("block_words", [dc.BLOCK_WORDS, 12])
def test_edges(shipped, make, block_words):
    ten = " ".join(f"w{i}" for i in range(10))
    docs = [(1, None), (2, ""), (3, "... !!"), (4, ten), (5, f"x {ten.upper()}, w9! {ten}"), (5, f"x {ten.upper()}, w9! {ten}"), (None, ten), (6, "two short"), (7, "é two Short é"), (8, "w0 " * 4000 + ten), (9, "a b a b a b a b")]
    items = [(1, ten), (2, ten), (3, "two short"), (None, "a b"), (4, None), (5, "!!")]
    bench = shipped.createDataFrame(items, "item_id long, text string")
    got = rows(dc.digest(dc.find(make(docs), bench, block_words=block_words)))
    assert sorted(got, key=key) == sorted(brute(docs, items), key=key)


def test_empty_tables(shipped, make):
    none = shipped.createDataFrame([], "item_id long, text string")
    assert rows(dc.find(make([]), none)) == []
    assert rows(dc.digest(dc.find(make([(1, "a b")]), none)))[0][:4] == (1, 2, 0, 0)


def test_index_finds_what_is_there():
    rng = random.Random(5)
    for _ in range(50):
        runs = [np.array([rng.randint(1, 3) for _ in range(rng.randint(1, 30))]) for _ in range(rng.randint(1, 5))]
        index = dc.FMIndex(runs, sample=3)
        n = rng.randint(1, 4)
        patterns = np.array([[rng.randint(1, 4) for _ in range(n)] for _ in range(8)])
        which, first, last = index.search(patterns)
        found = {w: sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which.tolist(), first, last)}
        text = index.text.tolist()
        for i, p in enumerate(patterns.tolist()):
            assert found.get(i, []) == [k for k in range(len(text)) if text[k : k + n] == p]


def test_clean_leaves_no_phrase(shipped, make):
    ten = " ".join(f"w{i}" for i in range(10))
    nested = "w0 w1 w2 w3 w4 " + ten + " w5 w6 w7 w8 w9 stays"
    bench = shipped.createDataFrame([(1, ten)], "item_id long, text string")
    out = {r.doc_id: r for r in dc.clean(make([(1, f"Before, {ten}! after."), (2, ten), (3, "clean text"), (4, nested), (5, None)]), bench).collect()}
    assert set(out) == {1, 3, 4, 5}
    assert out[1].text == "Before, ! after." and out[1].n_chars == len(out[1].text)
    assert out[3].text == "clean text" and out[4].text.split() == ["stays"] and out[5].text is None


def test_several_blocks_over_a_shuffled_input(shipped, make):
    """Blocks searched one after the other find and remove what one block does, however rows are dealt out."""
    rng = random.Random(9)
    items = [(i, " ".join(f"b{i}w{k}" for k in range(14))) for i in range(6)]
    # The third item's phrase only arises when the first one's words between its halves are gone.
    halves = items[2][1].split()
    docs = [(i, " ".join([*(f"x{rng.randint(0, 90)}" for _ in range(30)), *items[i % 6][1].split(), "tail"])) for i in range(30)]
    docs += [(100, " ".join([*halves[:7], *items[0][1].split(), *halves[7:], "rest"])), (101, items[3][1]), (102, None), (103, "")]
    bench = shipped.createDataFrame(items, "item_id long, text string")
    whole, shuffled = make(docs), make(docs).repartition(7)
    assert sorted(rows(dc.digest(dc.find(shuffled, bench, block_words=20))), key=str) == sorted(rows(dc.digest(dc.find(whole, bench))), key=str)
    told = lambda df: sorted(((r.doc_id, r.text, r.n_chars) for r in df.collect()), key=str)
    one, many = told(dc.clean(whole, bench)), told(dc.clean(shuffled, bench, block_words=20))
    assert [(i, t.split() if t else t) for i, t, _ in one] == [(i, t.split() if t else t) for i, t, _ in many]
    assert (100, ["rest"]) in [(i, t.split() if t else t) for i, t, _ in many] and 101 not in [i for i, *_ in many]
