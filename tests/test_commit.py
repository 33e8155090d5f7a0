"""Commits that race, and digests of files of all sizes."""

import hashlib
import os

from quarry.sources import writers


def test_the_first_commit_stays(spark, tmp_path):
    path = str(tmp_path / "table")
    assert writers.commit(spark, path, lambda p: spark.range(3).write.parquet(p))
    assert not writers.commit(spark, path, lambda p: spark.range(5).write.parquet(p))
    assert spark.read.parquet(path).count() == 3 and os.listdir(tmp_path) == ["table"]


def test_a_commit_that_lands_inside_another_is_removed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    spark.range(3).write.parquet(path)
    before, (fs, path_of) = sorted(os.listdir(path)), writers._fs(spark, path)

    class Late:
        """A file system that says at first that there is no table yet, as when another run commits between the question and the rename."""

        asked = False

        def exists(self, p):
            if p.toString().endswith("/table") and not self.asked:
                self.asked = True
                return False
            return fs.exists(p)

        def rename(self, a, b):
            return fs.rename(a, path_of(b, a.getName()))

        def __getattr__(self, name):
            return getattr(fs, name)

    monkeypatch.setattr(writers, "_fs", lambda *_: (Late(), path_of))
    assert not writers.commit(spark, path, lambda p: spark.range(5).write.parquet(p))
    monkeypatch.undo()
    assert sorted(os.listdir(path)) == before and spark.read.parquet(path).count() == 3 and os.listdir(tmp_path) == ["table"]


def test_digests_of_small_and_streamed_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "WHOLE_FILE", 100)
    (tmp_path / "a folder").mkdir()
    held = {"one": b"", "two": b"x" * 100, "a folder/three é%": bytes(range(256)) * 70_000}
    for name, content in held.items():
        (tmp_path / name).write_bytes(content)
    found = writers.inventory(spark, str(tmp_path))["files"]
    assert sorted((f["bytes"], f["sha256"]) for f in found) == sorted((len(c), hashlib.sha256(c).hexdigest()) for c in held.values())
