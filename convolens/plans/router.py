"""Run a table of tool calls: each function answers all of its requests in one plan."""

from __future__ import annotations

import datetime as dt
import re
import time
from collections.abc import Callable
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convolens.functions import text
from convolens.operators import search, stats
from convolens.operators.ranking import top_k
from convolens.operators.responses import pack_context
from convolens.operators.retrieval import BY_TIME, BY_USER, HOURS, LIMIT
from convolens.operators.search import COMBINED, KEYWORD, SEMANTIC, TFIDF, TOP_K, SearchTables
from convolens.runtime import failed_job, join_small, ranked, stored

# --- fixed values: function names and their required argument -----------------------------------
FUNCTIONS = {
    "combined_search_optimized": "query",
    "semantic_search_optimized": "query",
    "keyword_search_optimized": "keywords",
    "tfidf_search_optimized": "query",
    "get_user_messages": "username",
    "get_recent_messages": None,
    "get_stats": None,
}
# -------------------------------------------------------------------------------------------------
BY_USER_CALL, RECENT_CALL, STATS_CALL = "get_user_messages", "get_recent_messages", "get_stats"
# Each search function with its branches.
SEARCHES = {
    SEMANTIC: "semantic_search_optimized",
    KEYWORD: "keyword_search_optimized",
    TFIDF: "tfidf_search_optimized",
}
FUSED_CALL = "combined_search_optimized"
SEARCHING = {*SEARCHES.values(), FUSED_CALL}
# Requests, and latest messages, that meet in one task of the user search.
REQUEST_BLOCK, MESSAGE_BLOCK = 1000, 50_000
# Requests for up to 10 to this power of hits are planned together, larger ones by their own power.
FIRST_CLASS = 3
# Most latest messages that are put in order in one task.
LATEST_ROWS = 100_000
# Ranks of a block at most.
RANK_BLOCK = 1 << 14
# Seconds that a user pattern may take on a block of users.
PATTERN_SECONDS = 2.0
# How often the requests of a failing plan are halved.
HALVINGS = 6
HIT = ["query_id", "function", "chat_id", "seq", "score", "method", "error"]

RESULT = {
    "query_id": "string", "function": "string", "chat_id": "string", "seq": "bigint",
    "user": "string", "date_time": "timestamp_ntz", "message": "string", "message_type": "string",
    "score": "double", "method": "string", "stats": "string", "error": "string",
}


def requests(calls: DataFrame, id_col: str = "request_id") -> DataFrame:
    """``(query_id, function, text, keywords, k, hours, error)`` from tool calls.

    ``calls`` has ``name`` and ``arguments`` (a variant). Names are matched without regard to case.
    Each function's own arguments are read; a null one counts as missing. Unknown functions,
    missing or ill-typed arguments and user patterns that are none become rows with ``error``.
    """

    def arg(name: str, kind: str) -> Column:
        return F.try_variant_get("arguments", f"$.{name}", kind)

    def given(name: str) -> Column:
        value = arg(name, "variant")
        return value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(True))

    def is_text(name: str) -> Column:
        return F.schema_of_variant(arg(name, "variant")) == "STRING"

    name = F.lower("name")
    asks = lambda argument: name.isin(*[f for f, a in FUNCTIONS.items() if a == argument])
    latest = name.isin(BY_USER_CALL, RECENT_CALL)
    listed = F.when(asks("keywords"), arg("keywords", "array<string>"))
    said = F.lit(None).cast("string")
    problem = F.lit(None).cast("string")
    for argument in ("query", "username", "keywords"):
        wanted = asks(argument)
        usable = is_text(argument) | (listed.isNotNull() if argument == "keywords" else F.lit(False))
        said = F.when(wanted & is_text(argument), arg(argument, "string")).otherwise(said)
        problem = (
            F.when(wanted & ~given(argument), f"missing argument: {argument}")
            .when(wanted & ~usable, f"argument {argument} has the wrong type")
            .otherwise(problem)
        )
    limit = F.when(latest, F.lit("limit")).otherwise("top_k")
    k = F.when(latest, arg("limit", "int")).otherwise(arg("top_k", "int"))
    has_k = F.when(latest, given("limit")).otherwise(given("top_k"))
    hours = arg("hours", "double")
    error = (
        F.when(F.col("name").isNull(), "no function call found")
        .when(~name.isin(*FUNCTIONS), F.concat(F.lit("unknown function: "), F.col("name")))
        .when(problem.isNotNull(), problem)
        .when(has_k & (k.isNull() | (k < 1)), F.concat(F.lit("argument "), limit, F.lit(" is not a number from 1 on")))
        .when((name == RECENT_CALL) & given("hours") & hours.isNull(), "argument hours is not a number")
    )
    read = calls.select(
        F.col(id_col).cast("string").alias("query_id"),
        F.when(name.isin(*FUNCTIONS), name).otherwise(F.col("name")).alias("function"),
        said.alias("text"),
        listed.alias("keywords"),
        F.coalesce(k, F.when(latest, LIMIT).otherwise(TOP_K)).alias("k"),
        F.coalesce(hours, F.lit(float(HOURS))).alias("hours"),
        error.alias("error"),
    )
    by_user = (F.col("function") == BY_USER_CALL) & F.col("error").isNull()
    wrong = F.when(by_user, _pattern_fault("text"))
    return read.withColumn("error", F.coalesce("error", wrong))


def _pattern_fault(column: str) -> Column:
    """What is wrong with a pattern; null if nothing."""

    def faults(patterns: pd.Series) -> pd.Series:
        return patterns.map(lambda p: None if p is None else _fault(p))

    faults.__annotations__ = {"patterns": pd.Series, "return": pd.Series}
    return F.pandas_udf(faults, "string")(column)


def _fault(pattern: str) -> str | None:
    try:
        re.compile(pattern, re.IGNORECASE)
    except (re.error, OverflowError, RecursionError) as e:
        return f"not a pattern: {e}"
    return None


def route(reqs: DataFrame, tables: SearchTables, as_of: dt.datetime | None = None) -> DataFrame:
    """Answer every request; one row per hit (with its message), statistic or error.

    Every function is planned once for all requests of about the same ``k``, and each request's list
    is then cut to its own, so one request that asks for very much does not size the plan of the
    others. A plan that fails is run again for halves of its requests, so a failing request costs
    only itself. A fused search shares the three searches it is made of and takes what they have
    found; a branch that failed is marked by an error row beside the hits.
    """
    sized = F.greatest(F.ceil(F.log10("k")), F.lit(FIRST_CLASS)).cast("int")
    reqs = stored(reqs.withColumn("_class", sized))
    ok = reqs.where(F.col("error").isNull())
    errors = [reqs.where(F.col("error").isNotNull()).select("query_id", "function", "error")]
    hits: list[DataFrame] = []
    asked = ok.groupBy("_class", "function").agg(F.max("k")).collect()  # classes times functions
    for size in sorted({r[0] for r in asked}):
        mine, most = ok.where(F.col("_class") == size), {r[1]: r[2] for r in asked if r[0] == size}
        runs = [(_of(mine, f), run) for f, run in _plans(tables, most, as_of).items() if f in most]
        for own, run in [*runs, *([(_of(mine, *SEARCHING), lambda r, last, m=most: _searched(r, tables, m, last))] if set(most) & SEARCHING else [])]:
            found, failed = _isolated(run, own)
            hits += found
            errors += failed
    parts = [_shown(e) for e in errors]
    if hits:
        found = reduce(DataFrame.unionByName, [h.select(*HIT) for h in hits])
        parts.append(_shown(found.where("error IS NOT NULL")))
        bodies = tables.messages.select("chat_id", "seq", "user", "date_time", "message", "message_type")
        parts.append(_shown(found.where("error IS NULL").join(bodies, ["chat_id", "seq"])))
    if not _of(ok, STATS_CALL).isEmpty():
        parts.append(_shown(_stats(_of(ok, STATS_CALL), tables)))
    return reduce(DataFrame.unionByName, parts)


def _plans(t: SearchTables, most: dict[str, int], as_of: dt.datetime | None) -> dict[str, Callable[[DataFrame, bool], DataFrame]]:
    return {
        BY_USER_CALL: lambda r, last: _by_user(r, t.messages, most[BY_USER_CALL]),
        RECENT_CALL: lambda r, last: _by_time(r, t.messages, most[RECENT_CALL], as_of),
    }


def _isolated(
    run: Callable[[DataFrame, bool], DataFrame], reqs: DataFrame, depth: int = 0
) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stored results of some requests, and error rows of those whose plan fails by themselves.

    ``run`` is told whether it is the last attempt: of one request, or after ``HALVINGS`` cuts, which
    bound the plans that a fault of all requests costs.
    """
    last = depth >= HALVINGS or reqs.limit(2).count() < 2
    try:
        return [stored(run(reqs, last).select(*HIT))], []
    except Exception as e:
        why = failed_job(e)
        if why is None:
            raise
    if last:
        return [], [reqs.select("query_id", "function", F.lit(f"failed: {why}").alias("error"))]
    side = F.pmod(F.shiftright(F.xxhash64("query_id"), depth), F.lit(2))
    both = [_isolated(run, reqs.where(side == i), depth + 1) for i in range(2)]
    return [h for found, _ in both for h in found], [e for _, failed in both for e in failed]


def failures(reqs: DataFrame, routed: DataFrame) -> DataFrame:
    """``(query_id, function, error)`` of accepted requests that failed in ``route``, wholly or in a branch."""
    told = lambda df: df.where(F.col("error").isNotNull()).select("query_id", "function", "error")
    return told(routed).exceptAll(told(reqs))  # ids may repeat; a rejected request has one row in both


def answer_contexts(reqs: DataFrame, routed: DataFrame) -> DataFrame:
    """``(query_id, text, context, error)``: each accepted request beside its hits as one JSON array.

    ``[]`` is an answer without hits. A request that failed has a null context and the reason in
    ``error``; a fused search that lost a branch has what the others found beside its ``error``.
    A null id meets no hits, so its requests count as failed.
    """
    hits = routed.where(F.col("chat_id").isNotNull())
    words = F.coalesce("text", F.array_join("keywords", " ")).alias("text")
    packed = pack_context(hits, reqs.where(F.col("error").isNull()).select("query_id", words))
    reasons = F.array_join(F.array_sort(F.collect_set("error")), "; ")
    failed = failures(reqs, routed).groupBy("query_id").agg(reasons.alias("_failed"))
    error = F.when(F.col("query_id").isNull(), "no request id").otherwise(F.col("_failed"))
    told = packed.join(failed, "query_id", "left").withColumn("error", error)
    answered = F.col("error").isNull() | (F.col("context") != "[]")
    return told.select("query_id", "text", F.when(answered, F.col("context")).alias("context"), "error")


def _of(reqs: DataFrame, *functions: str) -> DataFrame:
    return reqs.where(F.col("function").isin(*functions))


def _cut(hits: DataFrame, reqs: DataFrame, times: int = 1) -> DataFrame:
    """Each request's best ``k`` hits (or ``times`` as many)."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chat_id", "seq")
    own = hits.join(reqs.select("query_id", "k", "function"), "query_id")
    return own.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= F.col("k") * times).drop("_rn")


def _searched(reqs: DataFrame, t: SearchTables, most: dict[str, int], last: bool) -> DataFrame:
    """Hits of all searches, fused ones included; branches that failed beside fused hits as errors."""
    asked = {r[0] for r in reqs.select("function").distinct().collect()}  # a handful of functions
    most = {f: k for f, k in most.items() if f in asked}
    branches = {}
    for method, function in SEARCHES.items():
        functions = [f for f in (function, FUSED_CALL) if f in most]
        if functions:
            mine, k = _of(reqs, *functions), max(most[f] for f in functions)
            branches[method] = lambda m=method, mine=mine, k=k: _cut(_branch(m, mine, t, k), mine)
    if FUSED_CALL not in most:
        planned = [run().withColumn("method", F.lit(m)) for m, run in branches.items()]
        return reduce(DataFrame.unionByName, planned).withColumn("error", F.lit(None).cast("string"))
    found, failed = search.attempted(branches)
    if failed and (not last or not found or any(SEARCHES[m] in most for m in failed)):
        raise PySparkException("; ".join(failed.values()))  # halves of the requests are tried next
    none = F.lit(None).cast("string").alias("error")
    parts = [_of(b, SEARCHES[m]).select(*HIT[:-2], F.lit(m).alias("method"), none) for m, b in found.items() if SEARCHES[m] in most]
    fused = search.fuse({m: _of(b, FUSED_CALL) for m, b in found.items()}, most[FUSED_CALL])
    cut = _cut(fused, _of(reqs, FUSED_CALL), 2)
    parts.append(cut.select(*HIT[:-2], F.lit(COMBINED).alias("method"), none))
    for method, why in failed.items():
        marked = _of(reqs, FUSED_CALL).select("query_id", "function", F.lit(f"{method} failed: {why}").alias("error"))
        parts.append(_shown(marked).select(*HIT))
    return reduce(DataFrame.unionByName, parts)


def _branch(method: str, mine: DataFrame, t: SearchTables, k: int) -> DataFrame:
    queries = mine.select("query_id", "text")
    if method == SEMANTIC:
        return search.semantic_search(t.vectors, t.query_vectors(queries), k)
    if method == TFIDF:
        return search.tfidf_search(t.weights, t.terms, queries, k, ngram_range=t.ngram_range, lists=t.lists)
    words = F.coalesce(F.col("keywords"), text.words(F.lower("text"))).alias("keywords")
    return search.keyword_search(t.postings, t.vocabulary, mine.select("query_id", words), k, t.words)


def _newest() -> list[Column]:
    return [F.desc("date_time"), F.asc("chat_id"), F.asc("seq")]


def _by_user(reqs: DataFrame, messages: DataFrame, k: int) -> DataFrame:
    """Latest messages of the users each pattern matches, or an error where a pattern takes too long.

    Every pattern meets every user once, in blocks of patterns and users. With a moderate ``k`` a
    user brings the latest ``k`` messages along and a block keeps ``k`` rows per request, so a pattern
    that matches everyone sends no more than that. Requests for more get the users first, then
    all of their messages, numbered over the cluster.
    """
    timed = messages.where(
        F.col("user").isNotNull() & F.col("message").isNotNull() & F.col("date_time").isNotNull()
    ).select("chat_id", "seq", "date_time", "user")
    if k > LATEST_ROWS:
        return _all_by_user(reqs, timed)
    latest = stored(top_k(timed, _newest(), k, ["user"]))
    found = stored(_met(latest.withColumn("date_time", F.unix_micros(F.col("date_time").cast("timestamp"))), reqs))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*_newest()))
    best = found.where("error IS NULL").withColumn("_rn", rank).join(reqs.select("query_id", "function", "k"), "query_id")
    return _marked(best.where(F.col("_rn") <= F.col("k")), found, reqs)


def _marked(hits: DataFrame, found: DataFrame, reqs: DataFrame) -> DataFrame:
    """Hits of requests without an error, and one row for each with one."""
    failed = stored(found.where("error IS NOT NULL").groupBy("query_id").agg(F.min("error").alias("error")))
    good = hits.drop("error").join(failed.select("query_id"), "query_id", "left_anti")
    good = good.withColumns({"score": F.lit(1.0), "method": F.lit(BY_USER), "error": F.lit(None).cast("string")})
    bad = failed.join(reqs.select("query_id", "function"), "query_id")
    return good.select(*HIT).unionByName(_shown(bad).select(*HIT))


def _met(rows: DataFrame, reqs: DataFrame) -> DataFrame:
    """``(query_id, chat_id, seq, date_time, user, error)``: the ``k`` newest rows per request and block."""
    wide, tall = (max(1, ceil(df.count() / n)) for df, n in ((rows, MESSAGE_BLOCK), (reqs, REQUEST_BLOCK)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.withColumn("_b", block("user", wide)).select("*", every(tall).alias("_q"))
    asked = reqs.select("query_id", "text", "k").withColumn("_q", block("query_id", tall))
    asked = asked.select("*", every(wide).alias("_b"))
    columns = ["chat_id", "seq", "date_time", "user"]

    def match(some: pa.Table, patterns: pa.Table) -> pa.Table:
        some = some.sort_by([("date_time", "descending"), ("chat_id", "ascending"), ("seq", "ascending")])
        coded = some.column("user").combine_chunks().dictionary_encode()
        users, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        shape = pa.schema([("query_id", pa.string()), *(some.schema.field(c) for c in columns), ("error", pa.string())])
        out = [shape.empty_table()]
        for name, pattern, own in zip(*(patterns.column(c).to_pylist() for c in ("query_id", "text", "k"))):
            matches, fault = matching(pattern, users)
            if fault:
                out.append(pa.Table.from_pylist([{"query_id": name, "error": fault}], shape))
                continue
            best = np.flatnonzero(matches[at])[:own] if len(users) else np.array([], dtype=np.int64)
            found = some.select(columns).take(pa.array(best))
            found = found.add_column(0, "query_id", pa.array([name] * len(best), pa.string()))
            out.append(found.append_column("error", pa.nulls(len(best), pa.string())).cast(shape))
        return pa.concat_tables(out)

    return rows.groupBy("_b", "_q").cogroup(asked.groupBy("_b", "_q")).applyInArrow(
        match, "query_id string, chat_id string, seq long, date_time long, user string, error string"
    )


def matching(pattern: str, users: list[str]) -> tuple[np.ndarray, str | None]:
    """Which users a pattern matches, or why that cannot be said."""
    out, left = np.zeros(len(users), dtype=bool), PATTERN_SECONDS
    try:
        tried = regex.compile(pattern, regex.IGNORECASE)
        for i, user in enumerate(users):
            began = time.perf_counter()
            out[i] = bool(tried.search(user, timeout=left))
            left -= time.perf_counter() - began
            if left <= 0:
                raise TimeoutError
    except TimeoutError:
        return out, "argument username: the pattern takes too long"
    except regex.error as e:
        return out, f"not a pattern: {e}"
    return out, None


def _all_by_user(reqs: DataFrame, timed: DataFrame) -> DataFrame:
    """``_by_user`` for requests that may ask for any number of messages."""
    users = stored(timed.select("user").distinct())
    one = users.select(F.lit("").alias("chat_id"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("date_time"), "user")
    found = stored(_met(one, reqs))
    pairs = stored(found.where("error IS NULL").select("query_id", "user"))
    every = join_small(timed, pairs, ["user"], spread_by=["chat_id", "seq"])
    rows = ranked(every.select("query_id", "chat_id", "seq", "date_time"), [F.asc("query_id"), *_newest()])
    first = rows.groupBy("query_id").agg(F.min("rank").alias("_first"))
    own = first.join(reqs.select("query_id", "function", "k"), "query_id")
    best = join_small(rows, stored(own), ["query_id"], spread_by=["chat_id", "seq"])
    return _marked(best.where(F.col("rank") - F.col("_first") < F.col("k")), found, reqs)


def _block_of(rank: Column) -> Column:
    """Blocks of ranks that double in size up to ``RANK_BLOCK`` and are as large from there on."""
    small = F.floor(F.log2(rank))
    return F.when(rank < RANK_BLOCK, small).otherwise(F.floor(rank / RANK_BLOCK) + RANK_BLOCK.bit_length() - 2).cast("long")


def _by_time(reqs: DataFrame, messages: DataFrame, k: int, as_of: dt.datetime | None) -> DataFrame:
    """Latest messages within each request's window.

    A window only cuts the list of the latest messages off, so that list is numbered once, over the
    cluster where it may be long. It is joined by blocks of ranks: a request meets the blocks up to
    its own ``k`` that are young enough, so at most about twice the rows it gets.
    """
    now = F.lit((as_of or dt.datetime.now()).isoformat(sep=" ")).cast("timestamp_ntz")
    timed = messages.where(F.col("message").isNotNull() & F.col("date_time").isNotNull())
    age = F.timestamp_diff("MICROSECOND", F.col("date_time"), now) / F.lit(3.6e9)
    oldest = reqs.agg(F.max("hours")).first()[0]
    young = timed.select("chat_id", "seq", "date_time", age.alias("age")).where(F.col("age") <= oldest)
    if k <= LATEST_ROWS:
        listed = top_k(young, _newest(), k).withColumn("rank", F.row_number().over(W.orderBy(*_newest())))
    else:
        listed = ranked(young, _newest())
    listed = stored(listed.withColumn("_block", _block_of(F.col("rank"))))
    n = listed.count()
    blocks = listed.groupBy("_block").agg(F.min("age").alias("_youngest"))
    upto = F.least(F.col("k").cast("long"), F.lit(n))
    wanted = reqs.where(F.lit(n) > 0).select(
        "query_id", "function", "k", "hours", F.explode(F.sequence(F.lit(0).cast("long"), _block_of(upto))).alias("_block")
    )
    wanted = stored(wanted.join(blocks, "_block").where(F.col("_youngest") <= F.col("hours")).drop("_youngest"))
    hits = join_small(listed, wanted, ["_block"], spread_by=["chat_id", "seq"])
    hits = hits.where((F.col("rank") <= F.col("k")) & (F.col("age") <= F.col("hours")))
    return hits.withColumns({"score": F.lit(1.0), "method": F.lit(BY_TIME), "error": F.lit(None).cast("string")})


def _stats(reqs: DataFrame, t: SearchTables) -> DataFrame:
    """The data set's statistics as JSON, computed once and attached to every request."""
    size = stats.dataset_stats(t.messages)
    rows = lambda df: F.array_sort(F.collect_list(F.struct(*df.columns)))
    top = stats.top_users(t.messages)
    types = stats.type_counts(t.messages)
    words = t.vocabulary.select("word", "df").orderBy(F.desc("df"), F.asc("word")).limit(stats.COMMON_WORDS)
    summary = size.select(
        F.to_json(
            F.struct(
                *size.columns,
                types.agg(rows(types)).scalar().alias("message_types"),
                top.agg(rows(top)).scalar().alias("top_users"),
                words.agg(rows(words)).scalar().alias("most_common_words"),
            )
        )
    )
    return reqs.select("query_id", "function", summary.scalar().alias("stats"))


def _shown(df: DataFrame) -> DataFrame:
    absent = F.lit(None)
    return df.select(*[(F.col(c) if c in df.columns else absent).cast(k).alias(c) for c, k in RESULT.items()])
