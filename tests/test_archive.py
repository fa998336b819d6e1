import hashlib

from loomwork.sources import archive


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


def content(spark, folder, moment):
    return {r["path"]: (r["content"], r["state"]) for r in archive.materialized(spark, folder, moment).collect()}


def test_moments_of_a_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "MOST_BYTES", 1000)
    folder = f"file://{tmp_path}/a"
    one = {"a.py": "x = 1\n", "copy.py": "x = 1\n", ".env": "export KEY=secret\nB = 2", "key.js": "k = 'sk_live_abcdefghij12'", "big.txt": "y" * 2000, "é/🎈": "", "../out": "no"}
    first, n, new = archive.archive(frame(spark, one), folder)
    assert (n, new) == (7, 5)
    assert content(spark, folder, first) == {
        "a.py": ("x = 1\n", "whole"), "copy.py": ("x = 1\n", "whole"), ".env": ("KEY=\nB=", "names"), "key.js": ("k = 'sk_live_••••••'", "masked"), "big.txt": (None, "missing"),
        "é/🎈": ("", "whole"), "../out": (None, "outside"),
    }
    again = archive.archive(frame(spark, dict(reversed(one.items()))), folder)
    assert again == (first, 7, 0) and archive.read_moment(spark, folder, first).count() == 7
    two = {**one, "a.py": "x = 2\n", "key.js": "k = 'sk_live_zzzzzzzzzz99'"}
    second, n, new = archive.archive(frame(spark, two), folder)
    assert second != first and (n, new) == (7, 1)  # the other key is masked alike, its real hash differs
    assert content(spark, folder, second)["a.py"] == ("x = 2\n", "whole") and content(spark, folder, first)["a.py"] == ("x = 1\n", "whole")
    real = {r["path"]: r["real_hash"] for r in archive.read_moment(spark, folder, second).collect()}
    assert real["a.py"] is None and real["key.js"] == hashlib.sha256(two["key.js"].encode()).hexdigest()
    wanted = spark.createDataFrame([(hashlib.sha256(b"x = 2\n").hexdigest(),), ("0" * 64,), ("bad",), (None,)], "hash string")
    assert [r["content"] for r in archive.archived(spark, folder, wanted).collect()] == ["x = 2\n"]
    assert archive.read_moment(spark, folder, "m-none").count() == 0 and archive.materialized(spark, f"file://{tmp_path}/none", first).count() == 0


def test_two_writers_and_an_empty_folder(spark, tmp_path):
    folder = f"file://{tmp_path}/b"
    files = frame(spark, {"a": "1", "b": "2"})
    first, *_ = archive.archive(files, folder)
    for part, schema in (("objects", archive.OBJECT), ("moments", archive.ENTRY)):  # as if another writer had done the same at the same time
        rows = spark.read.schema(schema).parquet(f"{folder}/{part}").collect()
        spark.createDataFrame(rows, schema).write.mode("append").partitionBy(schema.names[-1]).parquet(f"{folder}/{part}")
    assert content(spark, folder, first) == {"a": ("1", "whole"), "b": ("2", "whole")}
    empty, n, new = archive.archive(files.limit(0), folder)
    assert (n, new) == (0, 0) and archive.read_moment(spark, folder, empty).count() == 0


def test_large_contents_are_not_carried_and_masks_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(archive, "MOST_BYTES", 1000)
    files = {"big.txt": "y" * 2000, "k.js": "k = 'whsec_" + "a1" * 10 + "'", "b64": "x\n" + "QUJD" * 10 + "\n", "plain": "sk 1", "big/.env": "A=" + "z" * 2000}
    got = {r["path"]: r for r in archive.manifest(frame(spark, files)).collect()}
    assert got["big.txt"]["kept"] is None and got["big.txt"]["hash"] == hashlib.sha256(b"y" * 2000).hexdigest()
    assert {p: (r["kept"], r["flag"]) for p, r in got.items() if p != "big.txt"} == {
        "k.js": ("k = 'whsec_••••••'", "masked"), "b64": ("x\n••••••\n", "masked"), "plain": ("sk 1", None), "big/.env": ("A=", "names"),
    }
    assert got["big.txt"]["flag"] == "large" and got["big.txt"]["real_hash"] is None and got["plain"]["real_hash"] is None and got["k.js"]["real_hash"] is not None
