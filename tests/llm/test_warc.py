import gzip
import io

import pytest
from conftest_llm import ODD

from sylva.llm import warc

PAGES = "page_id long, url string, html string, kind string, sha int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], PAGES)


def test_round_trip(spark):
    rows = [(i, f"http://h/{i}", t) for i, t in enumerate(ODD)] + [(90 + k, None, "copy") for k in range(40)] + [(50, "http://h/a b\r\nX: yé", "copy"), (60, "u", "")]
    got = {r["page_id"]: r for r in warc.round_trip(table(spark, rows), roll_bytes=2000).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        payload = (html or "").encode()
        first = min(j for j, _, h in rows if (h or "") == (html or ""))
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), warc.digest(payload))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == i else ("revisit", first))
        assert r["html"] == ((html or "") if first == i else None)
    assert got[50]["url"] == "http://h/a%20b%0D%0AX:%20y%C3%A9"


def test_min_bytes_and_odd_ids(spark):
    rows = [(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbb"), (4, "u", "bbb"), (None, "u", "bbb"), (4, "u", "bbb"), (4, "u", "c")]
    got = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(table(spark, rows), min_bytes=3).collect()]
    assert sorted(got, key=repr) == sorted([(1, "response", None, 2), (2, "response", None, 2), (3, "response", None, 3), (4, "revisit", 3, 3), (4, "revisit", 3, 3), (4, "response", None, 1), (None, "response", None, 3)], key=repr)
    assert warc.round_trip(table(spark, [])).collect() == []


def test_files_are_deterministic_and_readable(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i % 7} " * 50) for i in range(100)]
    for name in ("a", "b"):
        warc.write(table(spark, rows).repartition(3 if name == "a" else 11), f"file://{tmp_path}/{name}", roll_bytes=1500, shard_bytes=20_000)
    names = sorted(p.name for p in (tmp_path / "a").glob("*.warc.gz"))
    assert len(names) > 3 and names == sorted(p.name for p in (tmp_path / "b").glob("*.warc.gz"))
    for n in names:
        assert (tmp_path / "a" / n).read_bytes() == (tmp_path / "b" / n).read_bytes()
    assert not list((tmp_path / "a" / "_temporary").iterdir())
    found = [h for n in names for h, _ in warc.records(io.BytesIO(gzip.decompress((tmp_path / "a" / n).read_bytes())))]
    assert len(found) == 100 and all(h["WARC-Record-ID"].startswith("<urn:uuid:") for h in found)


def test_damage_raises(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    warc.write(table(spark, [(1, "u", "text")]), root)
    (part,) = (tmp_path / "w").glob("*.warc.gz")
    part.write_bytes(gzip.compress(gzip.decompress(part.read_bytes()).replace(b"text", b"test")))
    with pytest.raises(Exception, match="damaged"):
        warc.read(spark, root).collect()


def test_shards_do_not_hang_on_how_rows_come(spark, tmp_path):
    """More rows than any sample of a range partitioner holds: 400,000, in another order and other partitions."""
    base = spark.range(400_000).selectExpr("id * 7 as page_id", "concat('u', id) as url", "concat('p', id % 1000) as html")
    warc.write(base, f"file://{tmp_path}/a", shard_bytes=100_000)
    warc.write(base.orderBy("html").repartition(13), f"file://{tmp_path}/b", shard_bytes=100_000)
    a, b = ({p.name: p.read_bytes() for p in (tmp_path / n).glob("*.warc.gz")} for n in "ab")
    assert len(a) > 10 and a == b


def test_one_id_in_many_shards(spark, tmp_path):
    rows = [(None if i % 2 else 5, "u", f"text {i}") for i in range(400)] + [(9, "u", f"text {i}") for i in range(0, 40, 2)]
    warc.write(table(spark, rows), f"file://{tmp_path}/w", shard_bytes=400)
    sizes = [len(list(warc.records(io.BytesIO(gzip.decompress(p.read_bytes()))))) for p in (tmp_path / "w").glob("*.warc.gz")]
    assert sum(sizes) == 420 and len(sizes) > 5 and max(sizes) < 80
    got = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert sorted(r["refers_to"] for r in got if r["record_type"] == "revisit") == [5] * 20


def test_incomplete_archives_are_refused(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    with pytest.raises(FileNotFoundError):
        warc.read(spark, root)
    rows = [(i, "u", f"text {i}") for i in range(50)]
    warc.write(table(spark, rows), root, shard_bytes=100)
    with pytest.raises(FileExistsError):
        warc.write(table(spark, rows), root)
    assert warc.read(spark, root).count() == 50
    stray = tmp_path / "w" / "manifest" / "shard-999999.json"  # of a run that was broken off
    stray.write_text('{"name": "part-999999-0000.warc.gz", "bytes": 1, "records": 1, "sha1": ""}')
    assert warc.read(spark, root).count() == 50
    lost = tmp_path / "w" / "manifest" / "shard-000002.json"
    text = lost.read_text()
    lost.unlink()
    with pytest.raises(FileNotFoundError, match="lost 1 shards"):
        warc.read(spark, root)
    lost.write_text(text.replace('"records": ', '"records": 1'))
    (tmp_path / "w" / "manifest" / ".shard-000002.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="listed"):
        warc.read(spark, root)


def test_batches_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 1000)
    rows = [(i, "u", str(i) * 700) for i in range(20)]
    assert warc.round_trip(table(spark, rows)).count() == 20
