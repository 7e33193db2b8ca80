import dataclasses
import datetime as dt

import numpy as np
import pytest
import __spark_entry__ as entry
from pyspark.sql import functions as F

from convolens.operators import embed, responses, search
from convolens.plans import router
from convolens.sources import index_store


def run(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("<think>a\nb</think>\n the answer is here ", "the answer is here"),
        ("stray </think> tag in here", "stray  tag in here"),
        ('<think>{"function_call": {"name": "x"}</think> ok', '{"function_call": {"name": "x"}'),
        ("short", "short"),
    ],
)
def test_strip_reasoning(spark, raw, want):
    assert run(spark, raw, responses.strip_reasoning) == want


CALL = '{"function_call": {"name": "get_stats", "arguments": {"top_k": 3}}}'


@pytest.mark.parametrize(
    "text, lossless, reference",
    [
        (CALL, "get_stats", "get_stats"),
        (f"Sure: {CALL} done", "get_stats", None),
        ('say {"function_call": {"name": "get_stats"}} now', "get_stats", "get_stats"),
        ('{"function_call": {"name": ', None, None),
        ('[1, 2, 3, 4, 5]', None, None),
    ],
)
def test_tool_calls(spark, text, lossless, reference):
    df = spark.createDataFrame([(text,)], "response string")
    for mode, want in (("lossless", lossless), ("reference", reference)):
        row = responses.tool_calls(df, mode=mode).select("name", "is_call").first()
        assert (row.name, row.is_call) == (want, want is not None)


def test_routing(spark, chat):
    talk = chat([("c", i, i * 60, "Al" if i % 2 else "Bo", f"hello number word{i % 3}") for i in range(9)])
    t = index_store.in_memory(talk)
    call = lambda name, args: '{"function_call": {"name": "%s", "arguments": %s}}' % (name, args)
    rows = [
        (1, call("get_user_messages", '{"username": "al", "limit": 2}')),
        (2, call("GET_recent_messages", '{"hours": 1, "limit": 3}')),
        (3, call("get_stats", "{}")),
        (4, call("nope", "{}")),
        (5, call("tfidf_search_optimized", "{}")),
        (6, "no call at all"),
        (7, call("keyword_search_optimized", '{"keywords": ["Word1"], "top_k": 2}')),
        (8, call("get_user_messages", '{"username": "^b", "limit": 2}')),
    ]
    calls = responses.tool_calls(spark.createDataFrame(rows, "request_id long, response string"))
    out = router.route(router.requests(calls), t, as_of=dt.datetime(2024, 1, 1, 1)).collect()
    seqs = lambda i: sorted(r.seq for r in out if r.query_id == str(i) and r.error is None)
    errors = {r.query_id: r.error for r in out if r.error}
    assert seqs(1) == [5, 7] and seqs(8) == [6, 8] and seqs(2) == [6, 7, 8] and seqs(7) == [1, 4]
    assert '"total_messages":9' in next(r.stats for r in out if r.query_id == "3")
    assert set(errors) == {"4", "5", "6"} and errors["4"] == "unknown function: nope"
    assert errors["5"] == "missing argument: query" and errors["6"] == "no function call found"
    assert all(r.message and r.user for r in out if r.chat_id)


def test_bad_requests_become_rows(spark, chat):
    talk = chat([("c", i, i * 60, "Al(" if i % 2 else "Bo", f"hello word{i % 3}") for i in range(6)])
    call = lambda name, args: '{"function_call": {"name": "%s", "arguments": %s}}' % (name, args)
    rows = [
        (1, call("get_user_messages", '{"username": "al("}')),
        (2, call("get_recent_messages", '{"hours": "abc"}')),
        (3, call("semantic_search_optimized", '{"query": "hello", "top_k": "many"}')),
        (4, call("get_user_messages", '{"query": "al"}')),
        (5, call("tfidf_search_optimized", '{"username": "hello"}')),
        (6, call("tfidf_search_optimized", '{"query": ["hello"]}')),
        (7, call("keyword_search_optimized", '{"keywords": {"a": 1}}')),
        (8, call("get_user_messages", '{"username": "b", "limit": 0}')),
        (9, call("get_user_messages", '{"username": "B.", "limit": 1}')),
        (10, call("get_user_messages", '{"username": ".", "limit": 4}')),
        (11, call("combined_search_optimized", '{"query": "hello word1", "top_k": 1}')),
    ]
    calls = responses.tool_calls(spark.createDataFrame(rows, "request_id long, response string"))
    reqs = router.requests(calls)
    routed = router.route(reqs, index_store.in_memory(talk))
    out = routed.collect()
    assert {int(r.query_id) for r in out if r.error} == set(range(1, 9))
    assert [r.seq for r in out if r.query_id == "9"] == [4]
    assert sorted(r.seq for r in out if r.query_id == "10") == [2, 3, 4, 5]
    assert 1 <= sum(r.query_id == "11" for r in out) <= 2
    packed = {r.query_id: r.context for r in router.answer_contexts(reqs, routed).collect()}
    assert set(packed) == {"9", "10", "11"} and '"hello word1"' in packed["9"]


def routed_calls(spark, rows):
    call = lambda name, args: '{"function_call": {"name": "%s", "arguments": %s}}' % (name, args)
    texts = [(i, call(name, args)) for i, name, args in rows]
    return router.requests(responses.tool_calls(spark.createDataFrame(texts, "request_id long, response string")))


def seqs_of(out):
    found = {}
    for r in out:
        if r.error is None:
            found.setdefault(int(r.query_id), []).append(r.seq)
    return {i: sorted(s) for i, s in found.items()}


@pytest.mark.parametrize("small_blocks", [False, True])
def test_huge_limits_beside_normal_ones(spark, chat, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(router, "RANK_BLOCK", 4)
        monkeypatch.setattr(router, "LATEST_ROWS", 5)
        monkeypatch.setattr(router, "FIRST_CLASS", 0)
    talk = chat([("c", i, i * 60, "Al" if i % 2 else "Bo", f"hello {i}") for i in range(60)])
    reqs = routed_calls(spark, [
        (1, "get_recent_messages", '{"hours": 100, "limit": 2000000000}'),
        (2, "get_recent_messages", '{"hours": 100, "limit": 7}'),
        (3, "get_recent_messages", '{"hours": 0.25, "limit": 2000000000}'),
        (4, "get_user_messages", '{"username": "al", "limit": 2000000000}'),
        (5, "get_user_messages", '{"username": ".", "limit": 3}'),
        (6, "get_user_messages", '{"username": ".", "limit": 2000000000}'),
        (7, "get_recent_messages", '{"hours": 100, "limit": 33}'),
    ])
    out = router.route(reqs, index_store.in_memory(talk), as_of=dt.datetime(2024, 1, 1, 1)).collect()
    assert seqs_of(out) == {
        1: list(range(60)), 2: list(range(53, 60)), 3: list(range(45, 60)), 4: list(range(1, 60, 2)),
        5: [57, 58, 59], 6: list(range(60)), 7: list(range(27, 60)),
    }


def test_a_pattern_without_end_costs_only_itself(spark, chat, monkeypatch):
    monkeypatch.setattr(router, "PATTERN_SECONDS", 0.5)
    users = ["a" * 40 + "!", "Bo", "Al"]
    talk = chat([("c", i, i * 60, users[i % 3], f"hello {i}") for i in range(9)])
    reqs = routed_calls(spark, [
        (1, "get_user_messages", '{"username": "(a|aa)+$", "limit": 2}'),
        (2, "get_user_messages", '{"username": "bo", "limit": 2}'),
        (3, "get_user_messages", '{"username": "^al", "limit": 1}'),
        (4, "get_user_messages", '{"username": "(a|aa)+$", "limit": 2000000000}'),
    ])
    out = router.route(reqs, index_store.in_memory(talk)).collect()
    assert seqs_of(out) == {2: [4, 7], 3: [8]}
    assert sorted((r.query_id, "too long" in r.error) for r in out if r.error) == [("1", True), ("4", True)]


def test_a_failing_branch_is_marked(spark, chat):
    def factory():
        def encode(texts):
            if any("broken" in t for t in texts):
                raise RuntimeError("cannot encode this")
            return np.ones((len(texts), 64))

        return encode

    talk = chat([("c", i, i * 60, "Al", f"hello number word{i % 3}") for i in range(9)])
    t = index_store.in_memory(talk)
    t = dataclasses.replace(t, encode=lambda df, column: embed.embed(df, column, factory))
    reqs = routed_calls(spark, [
        (1, "semantic_search_optimized", '{"query": "hello", "top_k": 2}'),
        (2, "semantic_search_optimized", '{"query": "broken hello", "top_k": 2}'),
        (3, "combined_search_optimized", '{"query": "broken hello word1", "top_k": 2}'),
        (4, "combined_search_optimized", '{"query": "hello word1", "top_k": 2}'),
    ])
    out = router.route(reqs, t).collect()
    errors = {r.query_id: r.error for r in out if r.error}
    assert set(errors) == {"2", "3"} and all("cannot encode this" in e for e in errors.values())
    assert set(seqs_of(out)) >= {3, 4} and 2 not in seqs_of(out)


@pytest.mark.parametrize("body", ["x" * 1_000_000, "{" * 20_000, "{a " * 5000 + "}" * 5000, '{"function_call"' + "{" * 3000])
def test_long_and_deep_responses(spark, body):
    text = '`Sure: ` {"function_call": {"name": "get_stats", "arguments": {"note": "%s"}}}' % ("y" * 100_000)
    df = spark.createDataFrame([(body,), (text,)], "response string")
    assert sorted(str(r.name) for r in responses.tool_calls(df).collect()) == ["None", "get_stats"]


def test_pack_context(spark, chat):
    talk = chat([("c", i, i, "a", f"m{i}") for i in range(3)])
    hits = spark.createDataFrame([("q", "c", 0, 0.2), ("q", "c", 2, 0.9)], "query_id string, chat_id string, seq long, score double")
    asked = spark.createDataFrame([("q", "what?"), ("r", "else?")], "query_id string, text string")
    packed = responses.pack_context(search.render(hits, talk, "x"), asked)
    got = {r.query_id: r.context for r in packed.collect()}
    assert got["q"].index('"m2"') < got["q"].index('"m0"') and got["r"] == "[]"


def test_a_failure_is_no_context_without_hits(spark, chat, monkeypatch):
    monkeypatch.setattr(router, "PATTERN_SECONDS", 0.5)
    talk = chat([("c", i, i * 60, "Al" if i % 2 else "a" * 40 + "!", f"hello {i}") for i in range(4)])
    reqs = routed_calls(spark, [
        (1, "get_user_messages", '{"username": "al", "limit": 1}'),
        (2, "semantic_search_optimized", '{"query": "one"}'),
        (3, "combined_search_optimized", '{"query": "two"}'),
        (4, "combined_search_optimized", '{"query": "three"}'),
        (5, "get_user_messages", '{"username": "(a|aa)+$"}'),
        (6, "get_user_messages", '{"username": "nobody"}'),
        (7, "get_user_messages", '{"username": "al("}'),
        (8, "get_user_messages", '{"username": "al("}'),
        (8, "get_user_messages", '{"username": "^al", "limit": 1}'),
        (None, "get_user_messages", '{"username": "^al", "limit": 1}'),
    ])
    routed = router.route(reqs.where("function = 'get_user_messages'"), index_store.in_memory(talk))
    # What a failed search and a lost branch leave, beside a hit of the other branches.
    kind = "query_id string, function string, chat_id string, seq long, message string, score double, error string"
    rest = spark.createDataFrame([
        ("2", "semantic_search_optimized", None, None, None, None, "failed: no room"),
        ("3", "combined_search_optimized", "c", 2, "hello 2", 0.5, None),
        ("3", "combined_search_optimized", None, None, None, None, "semantic_optimized failed: no room"),
        ("4", "combined_search_optimized", None, None, None, None, "semantic_optimized failed: no room"),
    ], kind)
    routed = routed.unionByName(rest, allowMissingColumns=True)
    got = {r.query_id: (r.context, r.error) for r in router.answer_contexts(reqs, routed).collect()}
    assert set(got) == {"1", "2", "3", "4", "5", "6", "8", None}
    assert {i for i, (_, error) in got.items() if error is None} == {"1", "6", "8"}
    assert "hello 3" in got["1"][0] and got["6"][0] == "[]" and "hello 3" in got["8"][0]
    assert "hello 2" in got["3"][0] and "no room" in got["3"][1]
    assert {i for i, (context, _) in got.items() if context is None} == {"2", "4", "5", None}
    assert "no room" in got["2"][1] and "no room" in got["4"][1] and "too long" in got["5"][1]
    assert sorted(r.query_id for r in router.failures(reqs, routed).collect()) == ["2", "3", "4", "5"]


def test_route_context_fails_of_a_failure(spark, chat):
    talk = chat([("c", i, i * 60, "Al", f"hello {i}") for i in range(3)])
    reqs = routed_calls(spark, [(1, "get_user_messages", '{"username": "al"}'), (2, "get_user_messages", '{"username": "al("}')])
    routed = router.route(reqs, index_store.in_memory(talk))
    lost = routed.where("query_id = '2'").withColumns({"query_id": F.lit("1"), "error": F.lit("failed: lost an executor")})
    key = spark.sparkContext.applicationId, "a folder"
    entry._answered[key] = reqs, routed
    assert [r.seq for r in entry.route_context(spark, "a folder").orderBy("pos").collect()] == [0, 1, 2]
    entry._answered[key] = reqs, routed.unionByName(lost)
    with pytest.raises(RuntimeError, match="1 failures .* 1, get_user_messages: failed: lost an executor"):
        entry.route_context(spark, "a folder")
    assert key not in entry._answered


def test_contexts_are_read_back_whole(spark):
    long = "x" * 21_000_000
    packed = spark.createDataFrame([("q",)], "query_id string").withColumn("context", F.to_json(F.array(F.struct(F.lit(long).alias("message")))))
    assert [len(r.message) for r in entry._unpacked(packed).collect()] == [len(long)]
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        entry._unpacked(packed.withColumn("context", F.lit('[{"message": "cut'))).collect()
