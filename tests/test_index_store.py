"""Segments of a stored index."""

import os
import random

import pytest
from pyspark.sql import functions as F

from convolens.operators import index, search
from convolens.sources import index_store

WORDS = "ab abc abcd bca cab the then them other another thing things in inn dinner zz".split()


def rows_of(chats, seed=0):
    out = []
    for c in chats:
        rng = random.Random(f"{c}{seed}")
        out += [(c, i, i, f"u{i % 3}", " ".join(rng.choices(WORDS, k=rng.randrange(1, 8)))) for i in range(20)]
    return out + [(chats[0], 99, 5, None, None), (chats[0], 98, None, "u1", "")]


def shown(df):
    rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return sorted(map(repr, df.select(rounded).collect()))


def same_tables(messages, tables):
    """Whether an index equals one built from nothing."""
    whole = index_store.in_memory(messages)
    for name in ("postings", "vocabulary", "terms", "weights", "vectors"):
        got, want = getattr(tables, name), getattr(whole, name)
        assert shown(got.select(sorted(got.columns))) == shown(want.select(sorted(got.columns))), name
    queries = search.one_query(messages.sparkSession, "the thing in dinner abc")
    hits = lambda t: sorted(map(tuple, search.combined_search(t, queries, k=6).collect()))
    assert hits(tables) == hits(whole)


def parts(path, name="segments"):
    root = index_store.DEFAULT.root(str(path))
    return set(os.listdir(f"{root}/{name}")) if os.path.isdir(f"{root}/{name}") else set()


def test_a_new_chat_writes_that_chat_only(spark, chat, tmp_path):
    first = chat(rows_of(["c1", "c2", "c3"]))
    index_store.build(first, str(tmp_path))
    before = parts(tmp_path)
    more = chat(rows_of(["c1", "c2", "c3"]) + [r for r in rows_of(["c4"]) if r[1] < 50])
    tables = index_store.build_or_load(more, str(tmp_path))
    [new] = parts(tmp_path) - before
    root = index_store.DEFAULT.root(str(tmp_path))
    assert {r.chat_id for r in spark.read.parquet(f"{root}/segments/{new}/texts").select("chat_id").distinct().collect()} == {"c4"}
    assert parts(tmp_path, "whole") == {"0"}
    same_tables(more, tables)
    # Known messages open their version and write nothing.
    index_store.build_or_load(more, str(tmp_path))
    assert parts(tmp_path) == before | {new}
    assert index_store.find(first, str(tmp_path)) == f"{root}/v0"


def test_changed_and_removed_chats(spark, chat, tmp_path):
    index_store.build(chat(rows_of(["c1", "c2", "c3"])), str(tmp_path))
    changed = chat(rows_of(["c1"]) + rows_of(["c3"], seed=7)[:15])
    version = index_store.build(changed, str(tmp_path))
    same_tables(changed, index_store.load(changed, version))
    profile = index.user_profile(changed)
    got = index_store.Version(spark, version, index_store.DEFAULT).profiles()
    assert shown(got) == shown(profile)


def test_compaction(spark, chat, tmp_path):
    path = str(tmp_path)
    index_store.build(chat(rows_of(["c1", "c2"])), path)
    index_store.build(chat(rows_of(["c1", "c2", "c3"])), path)
    last = chat(rows_of(["c1"]) + rows_of(["c2"], seed=2) + rows_of(["c3"]))
    index_store.build(last, path)
    version = index_store.compact(spark, path)
    assert index_store.find(last, path) == version and version.endswith("/v3")
    tables = index_store.load(last, version)
    same_tables(last, tables)
    assert "whole/3/weights" in tables.weights.inputFiles()[0]
    assert index_store.compact(spark, f"{path}/nothing") is None


def test_every_chat_gone(spark, chat, tmp_path):
    path = str(tmp_path)
    index_store.build(chat(rows_of(["c1"])), path)
    none = chat(rows_of(["c1"])).limit(0)
    tables = index_store.build_or_load(none, path)
    assert tables.postings.count() == 0 and tables.vocabulary.count() == 0 and tables.weights.count() == 0


def test_an_index_of_nothing(spark, chat, tmp_path):
    path, none = str(tmp_path), chat(rows_of(["c1"])).limit(0)
    tables = index_store.build_or_load(none, path)
    assert tables.postings.count() == 0 and tables.terms.count() == 0
    assert index_store.build(none, path) == index_store.find(none, path)
    same_tables(chat(rows_of(["c1"])), index_store.build_or_load(chat(rows_of(["c1"])), path))


def test_a_chat_without_a_name(spark, chat, tmp_path):
    path = str(tmp_path)
    index_store.build(chat(rows_of(["c1"])), path)
    named = chat(rows_of(["c1"]) + [(None, 1, 1, "u", "the other thing")])
    tables = index_store.build_or_load(named, path)
    assert tables.postings.where("chat_id IS NULL").count() == 3
    version = index_store.build(chat(rows_of(["c1"])), path)
    assert index_store.load(named, version).postings.where("chat_id IS NULL").count() == 0


def test_clear_removes_the_files(spark, chat, tmp_path):
    path = str(tmp_path)
    messages = chat(rows_of(["c1"]))
    index_store.build(messages, path)
    (tmp_path / "kept.txt").write_text("not of the index")
    index_store.clear(spark, path)
    assert os.listdir(path) == ["kept.txt"] and index_store.find(messages, path) is None


def test_a_build_that_stopped_is_not_found(spark, chat, tmp_path, monkeypatch):
    path, messages = str(tmp_path), chat(rows_of(["c1", "c2"]))
    other = chat(rows_of(["c1", "c2", "c3"], seed=5))

    def fail(*args):
        raise RuntimeError("stopped")

    monkeypatch.setattr(index_store, "_write_whole", fail)
    with pytest.raises(RuntimeError):
        index_store.build(other, path)
    monkeypatch.undo()
    assert index_store.find(other, path) is None
    same_tables(messages, index_store.build_or_load(messages, path))
