import gzip
import hashlib

import pytest

from skein.sources import archive, archive_sink


def _sha(data):
    return hashlib.sha256(data).hexdigest()


def _files(spark, tmp_path, contents):
    (tmp_path / "in").mkdir(exist_ok=True)
    rows = []
    for name, data in contents.items():
        (tmp_path / "in" / name).write_bytes(data)
        rows.append((f"s/{name}", str(tmp_path / "in" / name), "session", None))
    return spark.createDataFrame(rows, "relative_path string, path string, kind string, source string").repartition(3)


def _left(a):
    return [p for p in (a / "staging").rglob("*")]


def test_pushed_files_are_the_snapshot(spark, tmp_path):
    a = archive.Archive(str(tmp_path / "a"))
    contents = {f"f{i}": f"content {i % 4}".encode() * i * 50_000 for i in range(9)} | {"same": b"x", "again": b"x", "empty": b""}
    sha = a.push_files(_files(spark, tmp_path, contents), "m", "t1")
    assert a.latest("m") == sha and _left(tmp_path / "a") == []
    held = a.manifest(sha)
    assert {f["relative_path"]: (f["sha256"], f["bytes"], f["kind"]) for f in held["files"]} == {f"s/{n}": (_sha(d), len(d), "session") for n, d in contents.items()}
    assert all(gzip.decompress((tmp_path / "a" / a.blob_key(_sha(d))).read_bytes()) == d for d in contents.values())
    assert a.verify(spark).count() == 0
    # the same state is the same version, whoever pushes it
    assert a.push_files(_files(spark, tmp_path, contents), "m", "t2") == sha and len(list((tmp_path / "a" / "latest" / "m").iterdir())) == 1
    assert a.push(held, {}) == sha
    # what is known is carried on: neither read nor there
    known = spark.createDataFrame([("s/f1", "/nowhere", _sha(contents["f1"]), len(contents["f1"]))], "relative_path string, path string, sha256 string, bytes bigint")
    second = a.push_files(known, "m")
    assert second != sha and a.manifest(second)["files"] == [{"relative_path": "s/f1", "sha256": _sha(contents["f1"]), "bytes": len(contents["f1"])}]
    assert a.manifest(a.push_files(known.limit(0), "m2"))["files"] == []


def test_a_failed_push_leaves_nothing(spark, tmp_path):
    a = archive.Archive(str(tmp_path / "a"))
    files = _files(spark, tmp_path, {f"f{i}": b"%d" % i for i in range(6)})
    lost = files.unionByName(spark.createDataFrame([("s/lost", str(tmp_path / "gone"), "session", None)], files.schema))
    with pytest.raises(Exception, match="gone"):
        a.push_files(lost, "m")
    assert a.latest("m") is None and _left(tmp_path / "a") == [] and not list((tmp_path / "a" / "blobs").rglob("*.gz"))
    for bad in ("/x", "../x", "", None, "s/f1"):
        with pytest.raises(ValueError):
            a.push_files(files.unionByName(spark.createDataFrame([(bad, str(tmp_path / "in" / "f1"), None, None)], files.schema)), "m")
    wrong = spark.createDataFrame([("w", str(tmp_path / "in" / "f1"), _sha(b"other"), 1)], "relative_path string, path string, sha256 string, bytes bigint")
    with pytest.raises(Exception, match="differs"):
        a.push_files(wrong, "m")
    assert a.latest("m") is None and _left(tmp_path / "a") == []


def test_of_two_attempts_one_counts(spark, tmp_path):
    a = archive.Archive(str(tmp_path / "a"))
    rows = _files(spark, tmp_path, {"f": b"one", "g": b"two"}).collect()
    writer = archive_sink.ArchiveWriter({"root": a.root, "job": "j", "machine": "m"})
    with pytest.raises(FileNotFoundError):  # an attempt that dies on its way
        writer.write(iter([rows[0], rows[1].__class__(relative_path="x", path=str(tmp_path / "no"), kind=None, source=None)]))
    slow, done = writer.write(iter(rows)), writer.write(iter(rows))
    assert not list((tmp_path / "a" / "blobs").rglob("*.gz")) and slow.blobs.keys() == done.blobs.keys()
    writer.commit([done, None])
    assert len(a.manifest(a.latest("m"))["files"]) == 2 and {p.name for p in _left(tmp_path / "a")} == {"j", "published"}
    writer.abort([])
    assert _left(tmp_path / "a") == [] and a.verify(spark).count() == 0
