"""A collection of files: ingest in batches that come again, changed and unreadable files, deletes that are cut short."""

import shutil

import pytest
from pyspark.sql import functions as F

from quarry.functions.embedding import HashingEmbedder
from quarry.operators.chunking import ChunkRules
from quarry.sources import store
from quarry.sources.collection import Collection, ingest_stream
from quarry.sources.snapshots import Conflict, Snapshots

LONG = "This text has more than a hundred characters, so that it counts as a text layer and is cut into several chunks of words. " * 3


class Lost(RuntimeError):
    pass


@pytest.fixture()
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for name, data in {"a.txt": LONG.encode(), "b.html": f"<p>{LONG} &amp; more</p>".encode(), "c.txt": b"short", "d.txt": b"\xff\xfe", ".e.txt": LONG.encode(), "f.bin": b"1"}.items():
        (folder / name).write_bytes(data)
    return folder


def collection(spark, tmp_path, **more):
    return Collection(spark, f"file://{tmp_path}/c", HashingEmbedder(), f"file://{tmp_path}/raw", ChunkRules(20, 5, 3, 25), **more)


def status(held):
    return {r.file_name: (r.status, r.chunk_count) for r in held.manifest().collect()}


def shape(held):
    """What a reader sees, without names of folders."""
    return sorted((r.file_name, r.page, r.ordinal, r.text) for r in held.chunks().collect()), status(held)


def pages(spark, tmp_path):
    return store.load_files(spark, f"file://{tmp_path}/raw")


def test_files_go_in_once(spark, tmp_path, raw):
    held = collection(spark, tmp_path)
    first = {r.file_name: r.status for r in held.ingest(pages(spark, tmp_path)).collect()}
    assert first == {"a.txt": "ok", "b.html": "ok", "c.txt": "no_text_layer", "d.txt": "failed"}  # .e.txt is hidden: the reader passes it over
    n = held.chunks().count()
    assert n == held.snapshots.latest()[1]["count"] == sum(c for _, c in status(held).values()) and n > 4
    assert held.manifest().where("file_name = 'd.txt'").first().error.startswith("UnicodeDecodeError")
    assert {r.file_name: r.status for r in held.ingest(pages(spark, tmp_path)).collect()} == {**first, "a.txt": "skipped", "b.html": "skipped"}
    (raw / "a.txt").write_text("Other words stand here now, " * 8)
    (raw / "d.txt").write_text(LONG)
    again = {r.file_name: (r.status, r.replaced) for r in held.ingest(pages(spark, tmp_path)).collect()}
    assert again["a.txt"] == ("ok", True) and again["d.txt"] == ("ok", True) and again["b.html"] == ("skipped", False)
    assert {r.text.split()[0] for r in held.chunks().where("file_name = 'a.txt'").collect()} <= {"Other", "words", "stand", "here", "now,"}
    before = shape(held)
    held.compact()
    assert shape(held) == before and held.expire(1) and shape(held) == before
    listed = {r.file_name: (r.is_searchable, r.needs_ocr) for r in held.listing().collect()}
    assert listed == {"a.txt": (True, False), "b.html": (True, False), "c.txt": (False, True), "d.txt": (True, False), "f.bin": (False, False)}
    with pytest.raises(store.IndexCompatibilityError, match="hashed-words-8"):
        Collection(spark, held.path, HashingEmbedder(dimension=8)).chunks()


def test_a_replayed_batch_changes_nothing(spark, tmp_path, raw):
    held = collection(spark, tmp_path)
    held.ingest(pages(spark, tmp_path), ("s", 0))
    before = shape(held)
    (raw / "a.txt").write_text("Changed since then. " * 10)
    assert held.ingest(pages(spark, tmp_path), ("s", 0)).count() == 0 and shape(held) == before
    assert held.ingest(pages(spark, tmp_path), ("other", 0)).count() == 4 and shape(held) != before


def test_a_killed_batch_is_taken_again(spark, tmp_path, raw, monkeypatch):
    """Killed before its commit and after it: the stream starts again from its checkpoint and ends in one state."""
    shutil.copytree(raw, tmp_path / "whole" / "raw")
    whole = collection(spark, tmp_path / "whole")
    whole.ingest(pages(spark, tmp_path))
    held, commit = collection(spark, tmp_path), Snapshots.commit
    files = lambda: store.named(spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", 2).load(f"file://{tmp_path}/raw"))
    calls = []

    def dies(after):
        def run(self, number, state):
            calls.append(number)
            if len(calls) in (2, 4) and not after:
                raise Lost
            out = commit(self, number, state)
            if len(calls) in (3, 6) and after:
                raise Lost
            return out

        return run

    for after in (False, True):
        monkeypatch.setattr(Snapshots, "commit", dies(after))
        with pytest.raises(Exception, match="Lost"):
            ingest_stream(held, files(), f"file://{tmp_path}/checkpoint")
    monkeypatch.setattr(Snapshots, "commit", commit)
    ingest_stream(held, files(), f"file://{tmp_path}/checkpoint")
    assert shape(held) == shape(whole)
    state = held.snapshots.latest()[1]
    assert list(state["batches"].values()) == [2]  # five visible files, two a batch
    ingest_stream(held, files(), f"file://{tmp_path}/checkpoint")
    assert held.snapshots.latest()[1] == state


@pytest.mark.parametrize("step", ["commit", "unlink", "forget"])
def test_a_delete_that_is_cut_short(spark, tmp_path, raw, monkeypatch, step):
    held = collection(spark, tmp_path)
    held.ingest(pages(spark, tmp_path))
    n, mine = held.chunks().count(), held.chunks().where("file_name = 'a.txt'").count()
    commit, recover, calls = Snapshots.commit, Collection.recover, []

    def dies(self, number, state):
        calls.append(1)
        if step == "commit" or (step == "forget" and len(calls) == 2):
            raise Lost
        return commit(self, number, state)

    def dies_later(self):
        if calls:
            raise Lost
        recover(self)

    monkeypatch.setattr(Snapshots, "commit", dies)
    if step == "unlink":
        monkeypatch.setattr(Collection, "recover", dies_later)
    with pytest.raises(Lost):
        held.remove(["a.txt", "absent.txt"])
    monkeypatch.setattr(Snapshots, "commit", commit)
    monkeypatch.setattr(Collection, "recover", recover)
    assert (raw / "a.txt").exists() == (step != "forget")
    assert held.remove(["a.txt"]) == (mine if step == "commit" else 0)
    assert held.chunks().count() == n - mine and "a.txt" not in status(held) and not (raw / "a.txt").exists()
    assert held.snapshots.latest()[1]["unlink"] == {} and (raw / "b.html").exists()


def test_a_file_put_back_after_a_lost_delete_stays(spark, tmp_path, raw, monkeypatch):
    held = collection(spark, tmp_path)
    held.ingest(pages(spark, tmp_path))
    calls, recover = [], Collection.recover
    monkeypatch.setattr(Collection, "recover", lambda self: calls.append(1) or (recover(self) if len(calls) == 1 else None))
    held.remove(["a.txt"])
    monkeypatch.setattr(Collection, "recover", recover)
    (raw / "a.txt").write_text(LONG + "new")
    assert {r.file_name: r.status for r in held.ingest(pages(spark, tmp_path)).collect()}["a.txt"] == "ok" and (raw / "a.txt").exists()
    assert held.remove_all() == 4 and held.chunks().count() == 0 and status(held) == {} and sorted(p.name for p in raw.iterdir() if not p.name.endswith(".crc")) == [".e.txt", "f.bin"]
    with pytest.raises(ValueError):
        held.remove(["../a.txt"])


def test_of_two_writers_the_second_gets_a_conflict(spark, tmp_path, raw, monkeypatch):
    held = collection(spark, tmp_path)
    held.ingest(pages(spark, tmp_path))
    commit = Snapshots.commit

    def second(self, number, state):
        monkeypatch.setattr(Snapshots, "commit", commit)
        collection(spark, tmp_path).remove(["b.html"])
        return commit(self, number, state)

    monkeypatch.setattr(Snapshots, "commit", second)
    with pytest.raises(Conflict):
        held.remove(["a.txt"])
    assert set(status(held)) == {"a.txt", "c.txt", "d.txt"}
