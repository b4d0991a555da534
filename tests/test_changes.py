"""Changes to several tables: whole or not at all, once, and cascades over every table."""

import pytest

from pagelake.streaming import changes

ROWS = {
    "books": [("a", False), ("b", False)],
    "pages": [("a", 1, "red reef"), ("a", 2, "keel"), ("b", 1, "mast")],
    "vectors": [("a", 1, "c1", [1.0]), ("a", 2, "c2", [1.0]), ("b", 1, "c3", [1.0])],
    "messages": [("a", "s1", 1, "hello"), ("a", "s2", 1, "hi"), ("b", "s1", 1, "ho")],
}


def frames(spark):
    rows = {name: spark.createDataFrame(rows, changes.LIBRARY[name][0]) for name, rows in ROWS.items()}
    return rows | {"postings": changes.postings_of(rows["pages"])}


def seen(tables):
    return {name: sorted(tuple(r) for r in tables.current(name).collect()) for name in tables.tables}


@pytest.fixture
def tables(spark, tmp_path):
    made = changes.Tables(spark, f"file://{tmp_path}/tables", changes.LIBRARY)
    assert seen(made) == {name: [] for name in changes.LIBRARY}
    assert made.apply(frames(spark)) == 1
    return made


def test_recognised_page_replaces_all_of_it(spark, tables):
    before = seen(tables)
    new = spark.createDataFrame([("a", 1, "blue reef reef"), ("a", 3, "tide"), ("b", 0, "none"), ("b", 2, None)], "book_id string, page int, text string")
    assert changes.recognised(tables, new) == 2
    after = seen(tables)
    assert after["pages"] == [("a", 1, "blue reef reef"), ("a", 2, "keel"), ("a", 3, "tide"), ("b", 1, "mast")]
    assert after["postings"] == [("a", 1, "blue", [0]), ("a", 1, "reef", [1, 2]), ("a", 2, "keel", [0]), ("a", 3, "tide", [0]), ("b", 1, "mast", [0])]
    assert after["vectors"] == before["vectors"][1:] and after["books"] == [("a", True), ("b", False)] and after["messages"] == before["messages"]


@pytest.mark.parametrize("writes", [3, 6])
def test_a_change_cut_short_is_none(spark, tables, monkeypatch, writes):
    """Killed before any of its writes, a change isn't there; the next one takes its number and shows alone."""
    before, left, real = seen(tables), [writes], changes.Tables._write

    def failing(self, df, name, number):
        if not left[0]:
            raise OSError("killed")
        left[0] -= 1
        real(self, df, name, number)

    monkeypatch.setattr(changes.Tables, "_write", failing)
    new = spark.createDataFrame([("a", 1, "blue")], "book_id string, page int, text string")
    with pytest.raises(OSError, match="killed"):
        changes.recognised(tables, new)
    assert seen(tables) == before
    monkeypatch.setattr(changes.Tables, "_write", real)
    assert changes.conversations_cleared(tables, spark.createDataFrame([("a", "s1")], "book_id string, session_id string")) == 2
    assert seen(tables) == before | {"messages": before["messages"][1:]}


def test_cascade_over_every_table(spark, tables):
    changes.books_deleted(tables, spark.createDataFrame([("a",), ("zz",)], "book_id string"))
    assert all(r[0] == "b" for rows in seen(tables).values() for r in rows) and all(seen(tables).values())
    changes.recognised(tables, spark.createDataFrame([("a", 9, "back again")], "book_id string, page int, text string"))
    assert seen(tables)["pages"] == [("a", 9, "back again"), ("b", 1, "mast")]


def test_stream_restarts_with_the_same_change(spark, tables, tmp_path, monkeypatch):
    """A stream killed between two tables goes on from its checkpoint: the batch is one change, once."""
    source = tmp_path / "in"
    source.mkdir()
    spark.createDataFrame([("a", 1, "blue")], "book_id string, page long, text string").coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema("book_id string, page long, text string").json(str(source))
    real, armed = changes.Tables._write, [True]

    def failing(self, df, name, number):
        if armed[0] and name == "vectors":
            raise OSError("killed")
        real(self, df, name, number)

    monkeypatch.setattr(changes.Tables, "_write", failing)
    before = seen(tables)
    query = changes.recognised_stream(tables, stream, str(tmp_path / "state"))
    with pytest.raises(Exception, match="killed"):
        query.processAllAvailable()
    query.stop()
    assert seen(tables) == before
    armed[0] = False
    for more in (None, [("b", 1, "green")]):
        if more:
            spark.createDataFrame(more, "book_id string, page long, text string").coalesce(1).write.mode("append").json(str(source))
        query = changes.recognised_stream(tables, stream, str(tmp_path / "state"))
        query.processAllAvailable()
        query.stop()
    assert seen(tables)["pages"] == [("a", 1, "blue"), ("a", 2, "keel"), ("b", 1, "green")] and seen(tables)["books"] == [("a", True), ("b", True)]
    assert sorted(r["change"] for r in tables.done().collect()) == [1, 2, 3]
    assert changes.recognised(tables, spark.createDataFrame([("a", 1, "other")], "book_id string, page long, text string"), batch=0) == 2
    assert seen(tables)["pages"][0] == ("a", 1, "blue")
