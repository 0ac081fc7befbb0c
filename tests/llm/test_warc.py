import base64
import gzip
import hashlib
from collections import Counter, defaultdict

import pytest

from cinelake.llm import warc
from cinelake.llm._util import new_path


def brute(pages, least=0):
    groups = defaultdict(list)
    for i, _, html in pages:
        groups[(html or "").encode()].append(i)
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        largest = max((x for x in groups[data] if x is not None), default=None)
        revisit = len(groups[data]) > 1 and largest is not None and i != largest and len(data) >= least
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", largest if revisit else None))
    return Counter(out)


PAGES = [(1, "u", "<p>a</p>"), (2, "u2", "<p>a</p>"), (3, "u", None), (4, "ü\r\nX: y", ""), (None, "n", "<p>a</p>"), (None, "n", "alone"), (5, None, "é👍" * 20000), (2, "u2", "<p>a</p>"), (6, "v", "\x1f\x8b\x08 WARC/1.1\r\n\r\n")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "'x' AS record_type", "2 AS largest")


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(shipped, least):
    assert Counter(map(tuple, warc.round_trip(frame(shipped, PAGES), least).collect())) == brute(PAGES, least)


def test_empty(shipped):
    assert warc.round_trip(frame(shipped, [])).count() == 0


def test_splits_and_predicates(shipped):
    rows = [(i, f"http://h/{i}", "text " * (i % 50) + str(i % 40)) for i in range(300)]
    path = new_path(shipped, "test")
    warc.archive(frame(shipped, rows), path)
    for size in (500, 5000, 1 << 20):
        assert warc.read(shipped, path, split_bytes=str(size)).select("page_id").count() == 300
    want = brute(rows)
    got = warc.read(shipped, path).where("record_type = 'revisit' AND page_id > 100").select("page_id", "record_type")
    assert got.count() == sum(1 for i, *_, kind, _ in want if kind == "revisit" and i > 100)
    full = warc.read(shipped, path).where("target_uri LIKE 'http://h/29%'").select("page_id", "payload", "headers").collect()
    assert {r.page_id for r in full} == {29, *range(290, 300)} and all(r.headers["WARC-Type"] for r in full)


def test_payloads_are_not_inflated(monkeypatch, shipped):
    path = new_path(shipped, "test")
    warc.archive(frame(shipped, [(i, f"u{i}", f"payload {i}") for i in range(20)]), path)
    loads = []
    inner = warc.read_member

    def counted(source, at):
        m = inner(source, at)
        if m is not None:
            load = m.load
            m.load = lambda: loads.append(at) or load()
        return m

    monkeypatch.setattr(warc, "read_member", counted)
    reader = warc.WarcReader(warc.StructType.fromDDL("page_id long, payload binary"), {"path": path})
    assert list(reader.pushFilters([warc.EqualTo(("page_id",), 7)])) == []
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert rows == [{"page_id": 7, "payload": b"payload 7"}] and len(loads) == 1


def test_members_are_gzip_and_others_are_read(tmp_path):
    ours = warc.record({"WARC-Type": "response", "X-Page-ID": 1}, b"body")
    assert gzip.decompress(ours).endswith(b"\r\n\r\nbody\r\n\r\n")
    theirs = gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    data = ours + theirs + ours
    (tmp_path / "x.warc.gz").write_bytes(data)
    (tmp_path / "y.warc").write_bytes(gzip.decompress(theirs) * 2)
    for split in ("7", "100000"):
        reader = warc.WarcReader(warc.StructType.fromDDL("record_type string, payload binary"), {"path": str(tmp_path), "split_bytes": split})
        rows = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert sorted(rows) == sorted([("response", b"body")] * 2 + [("warcinfo", b"abc")] * 3)


def test_jobs_add_up(shipped):
    """A second append keeps the first archive's records; overwriting doesn't."""
    path = new_path(shipped, "test")
    warc.archive(frame(shipped, [(1, "a", "one"), (2, "b", "two")]), path)
    warc.archive(frame(shipped, [(3, "c", "three")]), path)
    assert sorted(r.page_id for r in warc.read(shipped, path).select("page_id").collect()) == [1, 2, 3]
    kept = warc.read(shipped, path).where("page_id = 3").select("record_type", "target_uri", "page_id", "refers_to", "payload_bytes", "payload_digest", "payload")
    again = shipped.createDataFrame([tuple(r) for r in kept.withColumn("payload_digest", warc.F.sha1("payload")).collect()], kept.schema)
    again.write.format("warc").option("path", path).mode("overwrite").save()
    assert [r.page_id for r in warc.read(shipped, path).select("page_id").collect()] == [3]


def test_long_lists_of_repeated_payloads_are_joined(shipped, monkeypatch):
    monkeypatch.setattr(warc, "REPEATED", 0)
    assert Counter(map(tuple, warc.round_trip(frame(shipped, PAGES)).collect())) == brute(PAGES)


def test_plain_files_are_read_by_headers(tmp_path):
    big = b"WARC/1.1 is no record here\r\n\r\n" * 9000
    heads = [b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: %d\r\nX-Long: %s\r\nContent-Length: %d\r\n\r\n" % (i, b"y" * (90_000 if i == 2 else 1), len(big)) for i in range(4)]
    (tmp_path / "x.warc").write_bytes(b"".join(h + big + b"\r\n\r\n" for h in heads))
    with open(tmp_path / "x.warc", "rb") as f:
        source = warc._Source(f)
        asked = []
        inner = source.at
        source.at = lambda where, n: asked.append(n) or inner(where, n)
        found = list(warc.plain_records(source, (tmp_path / "x.warc").stat().st_size))
        assert [m.fields["X-Page-ID"] for m in found] == ["0", "1", "2", "3"] and sum(asked) < len(big) * 3
        assert found[2].load() == big
