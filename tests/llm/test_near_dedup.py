import random

import numpy as np

from cinelake.llm import near_dedup as nd


def brute(docs, size=4, percent=80):
    """Rows by brute force over all pairs; rows of one id are one node."""
    sets, node = [], {}
    for i, t in docs:
        w = [] if t is None else t.encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
        node[i] = i

    def top(x):
        while node[x] != x:
            x = node[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and None not in (docs[a][0], docs[b][0]) and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = top(docs[a][0]), top(docs[b][0])
                node[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else top(i), i is None or top(i) == i) for (i, _), s in zip(docs, sets)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_edges(make):
    words = [f"w{i}" for i in range(200)]
    text = " ".join(words)
    near = " ".join([*words[:-3], "x", "y", "z"])
    half = " ".join([*words[:110], *(f"v{i}" for i in range(90))])
    docs = [(9, text), (4, text.upper()), (7, near), (3, half), (1, None), (2, ""), (5, " \t\n"), (6, "one two"), (8, "One  two"), (10, "one two three"), (None, text), (11, near), (11, near), (12, "a " * 5000), (13, "a " * 7000)]
    assert got(nd.link(make(docs))) == brute(docs)


def test_empty(make):
    assert nd.link(make([])).count() == 0
    assert got(nd.link(make([(1, None)]))) == [(1, 0, 1, True)]


def test_chains_and_groups(make):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
    docs, line = [], list(base)
    for i in range(60):  # a chain: each is near the one before, far from the first
        docs.append((100 - i, " ".join(line)))
        at = rng.randrange(len(line))
        line = [*line[:at], f"x{i}", *line[at + 1 :]]
    for i in range(80):  # a group around one text, at all distances
        copy = list(base)
        for _ in range(rng.randint(0, 14)):
            copy[rng.randrange(len(copy))] = f"y{rng.random()}"
        docs.append((200 + i, " ".join(copy)))
    docs += [(400 + i, " ".join(f"u{rng.random()}" for _ in range(40))) for i in range(40)]
    rng.shuffle(docs)
    assert got(nd.link(make(docs))) == brute(docs)


def test_whole_sample(sample):
    docs = [(r.doc_id, r.text) for r in sample.collect()]
    assert got(nd.link(sample)) == brute(docs)


def test_one_id_with_several_texts(make):
    """A document is linked by every text it has; its rows share a component."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = [(5, a), (5, b), (9, a), (3, b), (7, c), (8, c), (8, None), (6, "one")]
    assert got(nd.link(make(docs))) == brute(docs)


def test_tiles(make, monkeypatch):
    """Keys of many classes are cut into tiles, and no link is lost."""
    monkeypatch.setattr(nd, "TILE", 3)
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(70)]
    docs = []
    for i in range(40):
        own = [f"o{i // 2}_{k}" for k in range(30)]
        if i % 2:
            own[rng.randrange(30)] = "changed"
        docs.append((i, " ".join(passage + own)))
    docs += [(100 + i, f"{docs[0][1]} e{i}") for i in range(30)]
    assert got(nd.link(make(docs))) == brute(docs)


def test_chunks_guarantee_the_threshold():
    """Any two signatures within 19 places share a key."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << nd.BITS, nd.PERMUTATIONS)
        b = a.copy()
        places = rng.choice(nd.PERMUTATIONS, nd.CHUNKS * (nd.ERRORS + 1) - 1, replace=False)
        b[places] = (b[places] + 1) % (1 << nd.BITS)
        wrong = (a != b).reshape(nd.CHUNKS, nd.WIDTH).sum(axis=1)
        assert wrong.min() <= nd.ERRORS
