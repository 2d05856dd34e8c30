import pytest

from fabula.sources import snapshots as S
from fabula.sources.files import Files


def people(spark, *rows):
    return spark.createDataFrame(rows, "scope string, id int, name string")


def read(snap, name, scopes=None):
    return sorted((r.scope, r.id, r.name) for r in snap.table(name, scopes).collect())


def test_a_commit_that_stops_between_two_tables_changes_nothing(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "s")
    S.commit(spark, store, {"characters": people(spark, ("a", 1, "x"), ("b", 2, "y")), "versions": people(spark, ("a", 1, "v1"), ("b", 2, "v1"))}, "scope")
    broken = people(spark, ("a", 9, "new")).selectExpr("scope", "id", "raise_error('lost') AS name")
    with pytest.raises(Exception, match="lost"):
        S.commit(spark, store, {"characters": people(spark, ("a", 9, "new")), "versions": broken}, "scope")
    now = S.snapshot(spark, store)
    assert now.number == 1
    assert read(now, "characters") == [("a", 1, "x"), ("b", 2, "y")]
    assert read(now, "versions") == [("a", 1, "v1"), ("b", 2, "v1")]
    assert S.vacuum(spark, store) == 1
    assert read(S.snapshot(spark, store), "versions") == [("a", 1, "v1"), ("b", 2, "v1")]


def test_scopes_are_replaced_in_all_tables_and_snapshots_stay(spark, tmp_path):
    store = str(tmp_path / "s")
    assert S.snapshot(spark, store).table("characters") is None and S.snapshot(spark, store).scopes().count() == 0
    S.commit(spark, store, {"characters": people(spark, ("a", 1, "x"), ("b", 2, "y")), "versions": people(spark, ("a", 1, "v"), ("b", 2, "v"))}, "scope")
    before = S.snapshot(spark, store)
    # scope b has characters but no version any more, scope c is new
    assert S.commit(spark, store, {"characters": people(spark, ("b", 3, "z"), ("c", 4, "w")), "versions": people(spark, ("c", 4, "v"))}, "scope") == 2
    now = S.snapshot(spark, store)
    assert read(now, "characters") == [("a", 1, "x"), ("b", 3, "z"), ("c", 4, "w")]
    assert read(now, "versions") == [("a", 1, "v"), ("c", 4, "v")]
    assert read(now, "characters", ["b"]) == [("b", 3, "z")]
    assert read(before, "characters") == [("a", 1, "x"), ("b", 2, "y")] == read(S.snapshot(spark, store, 1), "characters")
    S.commit(spark, store, {"characters": people(spark), "versions": people(spark)}, "scope", spark.createDataFrame([("a",)], "s string"))
    S.commit(spark, store, {"characters": people(spark)}, "scope", removed=spark.createDataFrame([("c",)], "s string"))
    now = S.snapshot(spark, store)
    assert read(now, "characters") == [("b", 3, "z")] and read(now, "versions") == []
    assert sorted(r.scope for r in now.scopes().collect()) == ["a", "b"]
    number = S.compact(spark, store)
    assert number == 5 and len(S.snapshot(spark, store).commits) == 1
    assert S.vacuum(spark, store) == 4
    assert read(S.snapshot(spark, store), "characters") == [("b", 3, "z")] and S.snapshot(spark, store).number == 5
    with pytest.raises(Exception, match="no scope"):
        S.commit(spark, store, {"characters": people(spark, (None, 3, "z"))}, "scope")


def test_two_writers_take_different_numbers(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "s")
    put, tries = Files.put_new, []

    def late(self, path, text):
        if not tries:  # another writer was faster
            tries.append(path)
            assert put(self, path, text.replace('"folder": "', '"folder": "other/')) or True
        return put(self, path, text)

    Files(spark, store).fs.mkdirs(Files(spark, store).path(f"{store}/commits"))
    monkeypatch.setattr(Files, "put_new", late)
    assert S.commit(spark, store, {"t": people(spark, ("a", 1, "x"))}, "scope") == 2
    assert sorted(n for n in Files(spark, store).names(f"{store}/commits") if n.startswith("0")) == ["000000000001.json", "000000000002.json"]
