"""The trigram index by brute force, over repeated ids, short texts and several fields; and what its plan moves."""

from collections import Counter

from cinelake.operators import search


def test_index_by_brute_force(spark):
    rows = [(1, "Banana", "anan"), (1, "nab", "zz"), (2, None, "ÄÖÜß𝄞𝄞𝄞𝄞"), (3, "", ""), (4, "ab", "abc"), (1, "Banana", "anan"), (None, "abcd", None)]
    df = spark.createDataFrame(rows, "k int, a string, b string").repartition(3)
    expected = Counter()
    for k, *texts in rows:
        size = sum(max(len(x or "") - 2, 0) for x in texts)
        for f, x in zip("ab", texts):
            x = (x or "").lower()
            expected.update((x[i : i + 3], k, f, size) for i in range(len(x) - 2))
    found = search.index(df, "k", ["a", "b"]).select("gram", "id", "field", "size", "tf").collect()
    assert Counter({tuple(r)[:4]: r.tf for r in found}) == expected and len(found) == len(expected)


def test_index_counts_an_id_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(search, "CHUNK", 10)
    df = spark.createDataFrame([(i // 7, "abcab") for i in range(70)], "k int, t string")
    found = search.index(df, "k", ["t"]).collect()
    assert sorted((r.id, r.gram, r.tf) for r in found) == sorted((i, g, 7) for i in range(10) for g in ("abc", "bca", "cab"))


def test_what_is_dealt_out_are_texts(spark):
    """No pairs of gram and document go through a shuffle."""
    df = spark.createDataFrame([(1, "abcd")], "k int, t string")
    plan = search.index(df, "k", ["t"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "gram" not in plan[plan.index("Exchange") :]
