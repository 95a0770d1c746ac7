from datetime import datetime

import pytest

from tidemark.operators.store import BucketedStore
from tidemark.sources.raw import folders, put_new

SCHEMA = "case_id string, updated_at timestamp_ntz, version long, priority double, status string"


def _rows(spark, *rows):
    return spark.createDataFrame([(c, datetime(2024, 1, day), version, p, s) for c, day, version, p, s in rows], SCHEMA)


def _kept(store):
    return {r.case_id: (r.version, r.status) for r in store.cases().collect()}


def test_the_newest_version_of_each_case(spark, tmp_path):
    store = BucketedStore(spark, str(tmp_path / "s"), 4)
    with pytest.raises(FileNotFoundError):
        store.cases()
    assert store.upsert(_rows(spark, *((f"c{i}", 1, 1, float(i), "open") for i in range(20)))) == 1
    late = _rows(spark, ("c3", 2, 2, 99.0, "closed"), ("c4", 1, 0, 1.0, "old"))
    assert store.upsert(late) == 2 and store.upsert(late) == 3  # again: nothing changes
    kept = _kept(store)
    assert len(kept) == 20 and kept["c3"] == (2, "closed") and kept["c4"] == (1, "open")
    assert [r.case_id for r in store.cases().limit(2).collect()] == ["c3", "c19"] and store.load("c3").first().version == 2
    assert "c3" not in {r.case_id for r in store.cases(open_only=True).collect()}
    with pytest.raises(KeyError):
        BucketedStore(spark, str(tmp_path / "s"), 4000).load("nobody")


def test_an_upsert_rewrites_only_what_it_touches(spark, tmp_path):
    store = BucketedStore(spark, str(tmp_path / "s"), 8)
    store.upsert(_rows(spark, *((f"c{i}", 1, 1, 1.0, "open") for i in range(40))))
    before = store._newest()[1]
    store.upsert(_rows(spark, ("c7", 2, 2, 1.0, "closed")))
    after = store._newest()[1]
    assert sum(before[b] != after[b] for b in before) == 1 and before.keys() == after.keys()


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    first, second = BucketedStore(spark, str(tmp_path / "s"), 1), BucketedStore(spark, str(tmp_path / "s"), 1)
    first.upsert(_rows(spark, ("a", 1, 1, 1.0, "open")))
    commit, between = first._committed, []

    def late(number, where):
        if not between:  # the other one commits after this one has read and merged
            between.append(second.upsert(_rows(spark, ("b", 1, 1, 2.0, "open"))))
        return commit(number, where)

    monkeypatch.setattr(first, "_committed", late)
    assert first.upsert(_rows(spark, ("c", 1, 1, 3.0, "open"))) == 3 and between == [2]
    assert _kept(second) == {k: (1, "open") for k in "abc"}


def test_what_breaks_off_counts_for_nothing(spark, tmp_path, monkeypatch):
    store = BucketedStore(spark, str(tmp_path / "s"), 2)
    store.upsert(_rows(spark, ("a", 1, 1, 1.0, "open")))
    broken = BucketedStore(spark, str(tmp_path / "s"), 2)
    monkeypatch.setattr(broken, "_committed", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        broken.upsert(_rows(spark, ("a", 3, 3, 1.0, "closed")))
    assert _kept(store) == {"a": (1, "open")} and store.vacuum() == 1 and _kept(store) == {"a": (1, "open")}
    always = BucketedStore(spark, str(tmp_path / "s"), 2)
    monkeypatch.setattr(always, "_committed", lambda *_: False)
    with pytest.raises(RuntimeError, match="other writers"):
        always.upsert(_rows(spark, ("a", 3, 3, 1.0, "closed")), attempts=2)


def test_a_file_is_made_once(spark, tmp_path):
    path = str(tmp_path / "lists" / "1.json")
    assert put_new(spark, path, "one") and not put_new(spark, path, "two")
    assert (tmp_path / "lists" / "1.json").read_text() == "one" and [f for f in folders(spark, str(tmp_path / "lists")) if not f.startswith(".")] == ["1.json"]
