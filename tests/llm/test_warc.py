"""Archives against what was written, file by file and record by record."""

import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from pagewarrant.llm import op11_warc as A
from pagewarrant.llm import warc as W

PAGES = "page_id long, url string, html string, key string, digest string"


def _rows():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdé <p>\r\n\x00漢") for _ in range(n))
    rows = [(i, f"https://a.test/{i}?q=ä b", text(rng.choice([0, 10, 999, 1500, 4000]))) for i in range(120)]
    rows += [(200 + i, "https://a.test/copy", rows[i % 7][2]) for i in range(40)]
    rows += [(None, None, rows[3][2]), (None, "", None), (400, None, None), (401, "u", ""), (402, "u", "x" * 999), (403, "u", "x" * 999), (404, "u", "y" * 1000), (405, "u", "y" * 1000), (None, "u", "z" * 2000), (None, "v", "z" * 2000)]
    return rows + [(500, "twice", "w" * 3000), (500, "twice", "w" * 3000), (499, "less", "w" * 3000), (7, "other", "one id, two texts" * 100), (600, "long", "漢" * 700_000)]


def _df(spark, rows, n=4):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES).repartition(n)


def _brute(rows):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        top = max((j for j, _, x in rows if j is not None and (x or "").encode() == data), default=None) if len(data) >= 1000 else None
        again = top is not None and (i is None or i < top)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


def _read(spark, folder, **more):
    return A.read_warc(spark, folder, **more).where("warc_type in ('response', 'revisit')")


def _digest(spark, folder):
    rows = _read(spark, folder).collect()
    assert all(r["intact"] for r in rows) and len({r["record_id"] for r in rows}) == len(rows)
    return sorted(((r["row_id"], r["payload_bytes"], r["payload_digest"], r["warc_type"], r["refers_to"]) for r in rows), key=repr)


def test_round_trip(spark, tmp_path):
    rows = _rows()
    for k, kind in enumerate(({}, {"shard_bytes": 20_000, "roll_bytes": 6_000}, {"most": 1, "shard_bytes": 50_000})):  # one file, many files, copies joined by a shuffle
        A.write_warc(_df(spark, rows, 1 + k * 3), f"{tmp_path}/w{k}", **kind)
        assert _digest(spark, f"{tmp_path}/w{k}") == _brute(rows)
    held = sorted((r["payload"].decode() for r in _read(spark, f"{tmp_path}/w1", with_payload=True).where("payload is not null").collect()))
    want = sorted((h or "") for i, _, h in rows if not any(len((h or "").encode()) >= 1000 and h == x and j is not None and (i is None or i < j) for j, _, x in rows))
    assert held == want


def test_files_are_the_same_however_dealt(spark, tmp_path):
    rows, kind = _rows(), {"shard_bytes": 20_000, "roll_bytes": 6_000}
    seen = []
    for k, n in enumerate((1, 5)):
        folder = f"{tmp_path}/d{k}"
        found = A.write_warc(_df(spark, rows[::-1] if k else rows, n), folder, **kind).collect()
        files = {r["name"]: open(f"{folder}/{r['name']}", "rb").read() for r in found}
        for r in found:
            assert len(files[r["name"]]) == r["n_bytes"] and hashlib.sha256(files[r["name"]]).hexdigest() == r["sha256"]
        assert sorted(x for x in os.listdir(folder) if x.endswith(".gz")) == sorted(files) and not os.path.exists(f"{folder}/_temporary")
        assert sum(r["n_records"] for r in found) == len(rows) and any(r["number"] for r in found) and any(r["shard"] for r in found)
        order = sorted(found, key=lambda r: (r["shard"], r["number"]))
        assert all(a["last_key"] <= b["first_key"] for a, b in zip(order, order[1:]))
        seen.append(files)
    assert seen[0] == seen[1]
    assert gzip.decompress(seen[0]["shard-00000-00000.warc.gz"]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_files_outside_the_manifest_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "w")
    A.write_warc(_df(spark, _rows()), folder)
    with open(f"{folder}/shard-99999-00000.warc.gz", "wb") as f:
        f.write(W.page(1, 0, "u", "", 1, b"x", None, A.DATE))
    assert _digest(spark, folder) == _brute(_rows())
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        A.read_warc(spark, str(tmp_path / "none")).count()


def test_committing_twice(tmp_path):
    (tmp_path / "_temporary").mkdir()
    (tmp_path / "_temporary" / "t").write_bytes(b"abc")
    import pyarrow as pa

    row = pa.RecordBatch.from_pylist([{"temporary": "_temporary/t", "name": "a.warc.gz", "n_bytes": 3}])
    for _ in range(2):
        list(A._committer(str(tmp_path))(iter([row])))
    assert (tmp_path / "a.warc.gz").read_bytes() == b"abc"
    with pytest.raises(OSError, match="missing"):
        list(A._committer(str(tmp_path))(iter([pa.RecordBatch.from_pylist([{"temporary": "_temporary/t", "name": "b", "n_bytes": 3}])])))


def test_changed_bytes_show(spark, tmp_path):
    folder = str(tmp_path / "w")
    A.write_warc(_df(spark, [(1, "u", "abc")]), folder)
    name = f"{folder}/shard-00000-00000.warc.gz"
    plain = gzip.decompress(open(name, "rb").read()).replace(b"\r\n\r\nabc", b"\r\n\r\nabd")
    parts = plain.split(b"WARC/1.1\r\n")[1:]
    with open(name, "wb") as f:
        for p in parts:
            f.write(gzip.compress(b"WARC/1.1\r\n" + p))
    assert [(r["row_id"], r["intact"]) for r in _read(spark, folder).collect()] == [(1, False)]


def test_empty_table(spark, tmp_path):
    A.write_warc(_df(spark, [], 1), f"{tmp_path}/e")
    assert A.read_warc(spark, f"{tmp_path}/e").count() == 0
    assert A.manifest(spark, f"{tmp_path}/e").select(F.sum("n_records")).first()[0] is None
