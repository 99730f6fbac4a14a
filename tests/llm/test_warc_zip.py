import hashlib
import io
import zipfile

import pytest
from wardenlog.llm import warc_zip as W
from wardenlog.scratch import scratch_path


def test_directories_of_other_writers():
    for force in (False, True):
        data = io.BytesIO(b"")
        with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
            for name in ("a", "é/b", "c"):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=force) as f:
                    f.write(name.encode() * 50)
            z.comment = b"PK\x05\x06 in a comment"
        found = W.members(data, len(data.getvalue()))
        assert list(found) == ["a", "é/b", "c"]
        for name, (method, at, size) in found.items():
            assert method == 0 and W.read_range(data, at, size) == name.encode() * 50


def test_many_members_need_zip64():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for i in range(66_000):
            z.writestr(str(i), "")
    assert len(W.members(data, len(data.getvalue()))) == 66_000


def test_own_packages_are_zip_files():
    class Kept(io.BytesIO):
        def close(self):
            pass

    out = Kept()
    z = W.ZipWriter(out)
    for name in (W.ARCHIVE, W.INDEX):
        z.begin(name)
        z.write(b"first ")
        z.write(name.encode())
        z.end()
    z.close()
    with zipfile.ZipFile(out) as f:
        assert f.testzip() is None and f.read(W.INDEX) == b"first " + W.INDEX.encode()
    assert set(W.members(out, len(out.getvalue()))) == {W.ARCHIVE, W.INDEX}
    with pytest.raises(ValueError):
        W.members(io.BytesIO(b"not a package" * 9), 117)


def pages(spark):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a/é b", big, "x"), (2, "u", big, "x"), (3, None, big, "x"), (4, "u", "small", "x"), (5, "u", "small", "x"), (6, "u", None, None),
            (None, "u", "", None), (7, "u", "y" * 3_000_000, "x"), (8, "u", "w" * 999, "x"), (9, "u", "w" * 999, "x"), (8, "u", "w" * 999, "x"), (10, "u\r\nx: y", "\r\n\r\n" + big, "")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type string")


def test_round_trip(spark):
    got = W.read_packages(W.write_packages(pages(spark), scratch_path(spark, "warc"), package_bytes=2000)).collect()
    rows = pages(spark).collect()
    assert len(got) == len(rows)
    key = lambda i: "" if i is None else str(i)
    want = sorted((key(r.page_id), len((r.html or "").encode()), hashlib.sha1((r.html or "").encode()).hexdigest()) for r in rows)
    assert sorted((key(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == want
    by_id = {r.page_id: r for r in got}
    assert [(by_id[i].record_type, by_id[i].refers_to) for i in "123"] == [("revisit", "3"), ("revisit", "3"), ("response", None)]
    assert all(by_id[i].record_type == "response" for i in ("4", "5", "8", "9", "10"))
    assert by_id["3"].payload.decode() == rows[2].html and by_id["1"].payload is None


def test_no_pages(spark):
    assert W.round_trip(pages(spark).limit(0), spark).count() == 0


def test_ids_of_text(spark):
    ids = ["a\r\nWARC-Type: x", "", None, "%", "é b", "urn>", "a:b"]
    rows = [(i, "u", "same " * 300, "x") for i in ids] + [("last", None, "y", "x")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string, refers_to string")
    got = W.round_trip(df, spark).collect()
    assert sorted(map(str, (r.page_id for r in got))) == sorted(map(str, [*ids, "last"]))
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {"é b"} and sum(r.record_type == "revisit" for r in got) == 6


def test_a_task_for_each_package(spark):
    df = spark.createDataFrame([(i, "u", str(i) * 3000, "x") for i in range(40)], "page_id bigint, url string, html string, x string")
    packages = W.write_packages(df.repartition(2), scratch_path(spark, "warc"), package_bytes=100)
    n = packages.count()
    assert n > 10 and W.read_packages(packages, with_payload=False).rdd.getNumPartitions() == n
