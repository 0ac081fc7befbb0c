import zlib

import pytest

import corpus_pipeline
from cinelake.llm import _util, decontaminate, near_dedup, packing
from cinelake.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_queries_of_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_stages(shipped, sample):
    docs, seen = sample, {r.doc_id: r for r in sample.collect()}
    bench = shipped.read.parquet(f"{FOLDER}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(shipped, docs, FOLDER)
        if name == corpus_pipeline.STAGES[-1][0]:
            break
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = {r.doc_id: r for r in out.collect()}
        assert len(now) == out.count() and set(now) <= set(seen)
        if name == "quality_classifier":
            assert 0.6 * len(seen) < len(now) < len(seen)
        elif name == "minhash_near_dedup":
            groups = near_dedup.link(docs, size=5).collect()
            assert set(now) == {r.component_id for r in groups} and len(now) < len(seen)
        elif name == "benchmark_decontamination":
            assert decontaminate.find(docs, bench).where("n_hit > 0").count() and not decontaminate.find(out, bench).where("n_hit > 0").count()
            assert all(now[i].text == seen[i].text for i in now if now[i].n_chars == seen[i].n_chars)
        docs, seen = shipped.createDataFrame(list(now.values()), out.schema), now
    pieces = out.collect()
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    assert {p.doc_id for p in pieces} == set(seen)


def test_run(shipped):
    mark = _util.written()
    first = corpus_pipeline.run(shipped, FOLDER)
    assert first.columns == list(packing.NAMES) and first.count() > 100
    # Of what the stages before the last wrote, only the last one's input is left.
    left = [p.rpartition("/")[2].rpartition("-")[0] for p in _util._paths[mark:]]
    assert left[0] == "secret_scans" and "minhash_near_dedup" not in left and "members" not in left


def test_sweep(shipped, sample):
    mark = _util.written()
    kept = _util.materialise(sample.limit(3), "kept")
    path = _util.last_path()
    gone = _util.materialise(sample.limit(2), "gone")
    _util.sweep(shipped, mark, path)
    assert kept.count() == 3 and _util.written() == mark + 1
    with pytest.raises(Exception):
        gone.count()


def test_empty_documents(shipped, sample):
    empty = sample.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(shipped, empty, FOLDER).count() == 0


def test_repeated_and_null_rows(shipped, sample):
    one = sample.where("n_chars BETWEEN 300 AND 3000").limit(1)
    odd = one.unionByName(one).unionByName(one.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars"))
    kept = corpus_pipeline.minhash_near_dedup(shipped, odd, FOLDER).collect()
    assert sorted(r.doc_id is None for r in kept) == [False, True]
    assert zlib.crc32(kept[0].text.encode()) == zlib.crc32(kept[1].text.encode())


def test_different_texts_of_one_id_stay(shipped, make):
    """Rows of one id that are no copies are all kept; equal rows are kept once, and clashing columns do no harm."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = make([(4, a), (4, b), (4, a), (9, b), (2, None), (3, ""), (1, a * 1)])
    out = corpus_pipeline.minhash_near_dedup(shipped, docs, FOLDER)
    assert sorted((r.doc_id, r.text) for r in out.where("text <> ''").collect()) == [(1, a)]
    apart = make([(4, a), (4, b), (4, a)])
    assert sorted(r.text for r in corpus_pipeline.minhash_near_dedup(shipped, apart, FOLDER).collect()) == [a, b]


def test_packing_asks_all_documents(shipped, sample):
    """In the last stage a query is followed by the best of all documents that went to it."""
    held = packing.encoded(sample, packing.default_tokenizer(), packing.SHARD_BYTES, 1)
    df, n, mean, _ = packing.frequencies(held)
    ids = {r.row: r.doc_id for r in held.select("row", "doc_id").collect()}
    rows, queries, places = packing.claimed(packing.asked(held, df, n, mean), packing.WINDOW)
    first = {}
    for row, query, _ in sorted(zip(rows, queries, places), key=lambda x: x[2]):
        first.setdefault(ids[query], ids[row])
    pieces = sorted(corpus_pipeline.lexical_packing(shipped, sample, FOLDER).collect(), key=lambda p: (p.sequence_id, p.offset))
    follows = {a.doc_id: b.doc_id for a, b in zip(pieces, pieces[1:]) if a.start + a.length == a.doc_tokens}
    assert len(first) > 5 and all(follows[q] == d for q, d in first.items())
