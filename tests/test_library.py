"""A folder of books through build and the commands."""

import pytest

from folioscope import library
from folioscope.plans.segment import BOOK, BOXES, TABLES


@pytest.fixture(scope="module")
def shelf(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("shelf")
    (root / "Game").mkdir()
    for name, text in {"book.md": BOOK, "tables.txt": TABLES, "boxes.md": BOXES, "scan.pdf": "binary", "blank.txt": "  "}.items():
        (root / "Game" / name).write_text(text)
    out = str(tmp_path_factory.mktemp("out"))
    library.build(spark, f"file://{root}", f"file://{out}", "1")
    return library.Library(spark, f"file://{out}")


def test_families_and_categories(shelf):
    rows = shelf.chunks.collect()
    assert len({r.chunk_id for r in rows}) == len(rows)
    assert {r.family for r in rows} == {0, 1, 2}
    cards = {r.section: r for r in rows if r.family == 2}
    assert cards["Spell › Glow"].category == "spell" and cards["Spell › Glow"].rows[0] == ["Level", "1"]
    assert all("scan" not in r.source and "blank" not in r.source for r in rows)


def test_search_finds_the_entry(shelf):
    first = shelf.search("loud step heard").first()
    assert first.section.endswith("LOUD STEP") and first.locator == "p. 4"


def test_lookup_and_table(shelf):
    assert "spell" in {r.category for r in shelf.lookup("glow light fills the area").collect()}
    assert {r.category for r in shelf.table("cost rope").collect()} <= {"tables"}


def test_domain_maps_categories(shelf):
    assert {r.category for r in shelf.domain("light area", "ability").collect()} == {"spell"}
    assert shelf.domain("light", "transport").count() == 0


def test_sources(shelf):
    assert sum(r.chunks for r in shelf.sources().collect()) == shelf.chunks.count()


def test_careers_come_from_cards_or_from_the_text(shelf):
    assert {r.how for r in shelf.career("steps", "Game").collect()} <= {"assembled"}


# ------------------------------------------------------------------ the index's life


FILL = " and so on with a good many more words than a heading has" * 4


def books(tmp_path, texts):
    folder = tmp_path / "books" / "Game"
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in texts.items():
        (folder / name).write_text(text)
    return f"file://{tmp_path}/books"


def test_a_second_build_takes_unchanged_texts_from_the_first(spark, tmp_path):
    root, out = books(tmp_path, {"a.md": f"# One\nfirst text{FILL}", "b.md": f"# Two\nsecond text{FILL}"}), f"file://{tmp_path}/out"
    first = library.build(spark, root, out, "1")
    books(tmp_path, {"b.md": f"# Two\nchanged text here{FILL}", "c.md": f"# Three\nthird{FILL}"})
    (tmp_path / "books/Game/a.md").touch()
    second = library.build(spark, root, out, "2")
    texts = lambda paths: {r.path.rsplit("/", 1)[1]: r.text for r in spark.read.parquet(paths["files"]).collect()}
    assert texts(first) == {"a.md": f"# One\nfirst text{FILL}", "b.md": f"# Two\nsecond text{FILL}"}  # readers of the old version keep it
    assert texts(second) == {"a.md": f"# One\nfirst text{FILL}", "b.md": f"# Two\nchanged text here{FILL}", "c.md": f"# Three\nthird{FILL}"}
    forced = library.build(spark, root, out, "3", force=True)
    assert texts(forced) == texts(second)
    assert library.Library(spark, out).search("changed").count() == 1


def test_a_reader_never_sees_none_or_a_mix(spark, tmp_path):
    import threading

    from folioscope.sources.library import Snapshots

    folder = f"file://{tmp_path}/shots"
    shots = Snapshots(spark, folder)
    publish = lambda n: shots.publish({"one": spark.range(n), "two": spark.range(n)}, str(n))
    publish(1)
    seen, errors, done = [], [], threading.Event()

    def look():
        mine = Snapshots(spark, folder)
        while not done.is_set():
            path = mine.current()
            if path is None:
                errors.append("none")
                continue
            a, b = mine.read("one", path).count(), mine.read("two", path).count()
            seen.append(a)
            if a != b or str(a) != mine.label(path):
                errors.append((a, b))

    reader = threading.Thread(target=look)
    reader.start()
    for n in range(2, 8):
        publish(n)
    done.set()
    reader.join()
    assert not errors and seen == sorted(seen) and len(seen) > 1
    assert shots.read("two").count() == 7
    assert len(shots.drop_before(2)) == 5 and shots.read("one").count() == 7


def test_the_lock_rejects_a_second_run_and_ages(spark, tmp_path):
    from folioscope.sources.library import Busy, exclusive

    folder = f"file://{tmp_path}"
    with exclusive(spark, folder):
        with pytest.raises(Busy), exclusive(spark, folder):
            pass
        with exclusive(spark, folder, stale_seconds=-1):  # as if the holder had died long ago
            pass
    with exclusive(spark, folder):
        pass


def test_the_command_tells_what_is_missing(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.delenv("FOLIOSCOPE_FOLDER", raising=False)
    assert library.main([]) == 2
    root = books(tmp_path, {"a.md": "# One\nfirst text"})
    assert library.main([root, f"file://{tmp_path}/out", "--force"]) == 0
    assert "chunks" in capsys.readouterr().out
    (tmp_path / "out" / "_LOCK").write_text("")
    assert library.main([root, f"file://{tmp_path}/out"]) == 3


def test_attempts_end_with_the_last_error():
    from folioscope.sources.library import with_attempts

    calls = []

    def read():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("not yet")
        return "done"

    assert with_attempts(read, 3, 0) == "done"
    calls.clear()
    with pytest.raises(OSError):
        with_attempts(read, 2, 0)
