import gzip
import hashlib
import io
import os

import pytest

from lodestream.llm import warc


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_reads_member_by_member_in_small_pieces(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 7)
    bodies = [b"", b"x" * 5000, os.urandom(3000), "é漢".encode()]
    data = b"".join(warc.record_bytes(k, f"http://a/{k}\r\nX: y", b, sha(b), None, False) for k, b in enumerate(bodies))
    got = warc.read_bytes(data)
    assert [r.payload for r in got] == bodies and got[1].headers["warc-target-uri"] == "http://a/1%0D%0AX: y"
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 4


def broken(change):
    body = b"hello world" * 20
    raw = gzip.decompress(warc.record_bytes(1, "u", body, sha(body), None, False))
    return gzip.compress(change(raw))


@pytest.mark.parametrize("change", [
    lambda r: r.replace(b"hello", b"jello", 1), lambda r: r[:-9], lambda r: r + b"more", lambda r: b"X" + r, lambda r: r.split(b"\r\n\r\n")[0],
])
def test_refuses_wrong_records(change):
    with pytest.raises(ValueError):
        warc.read_bytes(broken(change))


def test_refuses_a_cut_archive():
    data = warc.record_bytes(1, "u", os.urandom(500), "0", None, False)
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-20])))


def test_round_trip_of_pages(spark):
    from lodestream.session import ship_package

    ship_package(spark)
    long = "<p>" + "ü" * 60 + "</p>"
    rows = [(1, "u1", long), (2, None, long), (3, "u3", "short"), (4, "u4", "short"), (5, "u5", None), (6, "u6", ""), (7, "u7", "x" * 300_000), (None, "u8", long), (2, "again", long), (8, "a\nb", "y" * 100), (9, "u9", "y" * 100)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, n long").repartition(3)
    archives = warc.write_archives(pages)
    assert archives.agg({"records": "sum"}).first()[0] == len(rows)
    got = warc.read_archives(archives).collect()
    want = []
    for i, u, h in rows:
        b = (h or "").encode()
        same = [j for j, _, x in rows if (x or "") == (h or "") and j is not None]
        again = len(b) >= 100 and i != min(same)
        want.append((i, (u or "").replace("\n", "%0A"), "revisit" if again else "response", min(same) if again else None, len(b), sha(b), None if again else h or ""))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    none = warc.write_archives(pages.limit(0))
    assert none.count() == 0 and warc.read_archives(none).count() == 0


def test_names_are_unique_and_revisits_name_their_response(spark, tmp_path):
    long = "z" * 200
    rows = [(1, "u1", long), (1, "u1", long), (1, "other", long), (2, "u2", long), (2, "u2", "short"), (3, "u3", "short"), (None, "n", long)]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    found = [r.headers for a in archives.collect() for r in warc.read_bytes(open(a.path[7:], "rb").read())]
    names = [h["warc-record-id"] for h in found]
    assert len(set(names)) == len(rows)
    revisits = [h for h in found if h["warc-type"] == "revisit"]
    assert len(revisits) == 2 and all(h["warc-refers-to"] in names and h["warc-refers-to-target-uri"] in ("u1", "other") for h in revisits)


def test_more_than_one_archive_and_a_very_long_record(spark, monkeypatch, tmp_path):
    import random

    r = random.Random(2)
    rows = [(i, f"u{i}", "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=200_000))) for i in range(6)] + [(9, "u9", "long " * 4_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    monkeypatch.setattr(warc, "ARCHIVE", 300_000)
    archives = warc.write_archives(pages, f"file://{tmp_path}/w")
    assert archives.count() >= 2 and archives.agg({"records": "sum"}).first()[0] == 7
    got = {x.id: x for x in warc.read_archives(archives).select("id", "payload_bytes", "payload_digest").collect()}
    assert all(got[i].payload_bytes == len(t) and got[i].payload_digest == sha(t.encode()) for i, _, t in rows)


def test_places_of_stores():
    assert warc._place("file:///tmp/x")[1] == "/tmp/x" and warc._place("dbfs:/a/b")[1] == "/dbfs/a/b" and warc._place("/a/b")[1] == "/a/b"


def test_record_ids_are_unique_however_partitions_are_split(spark, tmp_path):
    """One page repeated 4000 times, with skewed join partitions split: no two records share a name."""
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = [(1, "http://a/", "x" * 200)] * 4000 + [(2, "http://a/", "x" * 200)] * 20 + [(k, f"http://b/{k}", "y" * (k % 300)) for k in range(3, 480)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(16)
        archives = warc.write_archives(pages, str(tmp_path / "archives"))
        names, referred = [], set()
        for r in archives.collect():
            with open(r.path, "rb") as f:
                for record in warc.records(f):
                    names.append(record.headers["warc-record-id"])
                    referred |= {record.headers["warc-refers-to"]} if "warc-refers-to" in record.headers else set()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert len(names) == len(rows) and len(set(names)) == len(names)
    assert referred and referred <= set(names)
