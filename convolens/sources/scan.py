"""Reference-mode cutting of export files of any size.

The reference pattern is one pass over the whole text: a match runs from a time stamp over the first
colon to the next bracket, and stamps inside a match do not count. Where a match starts thus depends
on everything before it, but only through a small state:

* searching, with the beginning of a stamp that the text so far ends with, if any;
* behind a stamp, looking for the sender's colon;
* in a body, looking for the bracket.

So a file is read in splits. Each split works out, for every state it could start in, the state it
ends in and how many matches start in it (runs from different states soon coincide). The states of a
file's splits are then chained, and each split is cut again with its true first state. Only what lies
across the ends of splits is put together by key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby, product

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A time stamp as in ``export.STAMP``, and the texts it can be, with 0 for a digit and A for A or P.
STAMP = re.compile("\\[[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}, [0-9]{1,2}:[0-9]{2}:[0-9]{2}\u202f[AP]M\\]")
_SHAPES = [f"[{d}/{m}/00, {h}:00:00\u202fAM]" for d, m, h in product(("0", "00"), repeat=3)]
_SHAPE = str.maketrans("123456789P", "000000000A")

# Behind a stamp: at once, after the optional blank, and once the sender has a character.
STAMPED, SPACED, SENDER = "stamped", "spaced", "sender"
# Behind the colon, alike.
COLON, INDENTED, BODY = "colon", "indented", "body"
SEARCHING = ""


def _beginnings() -> dict[str, str]:
    """Every beginning of a stamp, and one that stands for all that go on alike."""
    rest: dict[str, frozenset] = {}
    for shape in _SHAPES:
        for n in range(1, len(shape)):
            rest[shape[:n]] = frozenset(s[n:] for s in _SHAPES if s.startswith(shape[:n]))
    first: dict[frozenset, str] = {}
    for start, ends in sorted(rest.items()):
        first.setdefault(ends, start)
    return {start: first[ends] for start, ends in rest.items()}


_BEGINNINGS = _beginnings()
LONGEST = max(map(len, _BEGINNINGS))
STATES = [SEARCHING, STAMPED, SPACED, SENDER, COLON, INDENTED, BODY, *sorted(set(_BEGINNINGS.values()))]


def beginning(text: str) -> str:
    """The state of a search that has come to ``text``, which starts with a bracket."""
    return _BEGINNINGS.get(text.translate(_SHAPE), SEARCHING) if len(text) <= LONGEST else SEARCHING


def feed(state: str, text: str) -> tuple[str, list[int], int]:
    """Go on from ``state`` through ``text``: the new state, where matches start, where a stamp may.

    A start of -1 lies before the text. The last number is the place in the text of the bracket that
    the new state's beginning of a stamp has; -1 if it lies before the text, ``len(text)`` if there
    is none.
    """
    open_before = state in _BEGINNINGS
    shift = len(state) if open_before else 0
    work = state + text if open_before else text
    if open_before:
        state = SEARCHING
    starts, at = [], 0
    while True:
        if state == SEARCHING:
            if not (found := STAMP.search(work, at)):
                q = work.rfind("[", at)
                state = beginning(work[q:]) if q >= 0 else SEARCHING
                return state, starts, max(q - shift, -1) if state else len(text)
            starts.append(max(found.start() - shift, -1))
            at, state = found.end(), STAMPED
        for here, blank_seen, going in ((STAMPED, SPACED, SENDER), (COLON, INDENTED, BODY)):
            if state == here:
                if at >= len(work):
                    return state, starts, len(text)
                at, state = at + (work[at] == " "), blank_seen
            if state == blank_seen:
                if at >= len(work):
                    return state, starts, len(text)
                at, state = at + 1, going
            if state == going:
                q = work.find(":" if going == SENDER else "[", at)
                if q < 0:
                    return state, starts, len(text)
                at, state = (q + 1, COLON) if going == SENDER else (q, SEARCHING)


# What became of the beginning of a stamp that a split starts with.
DEAD, DONE, OPEN = 0, 1, 2


class Summary:
    """What a split does to every state it could start in."""

    def __init__(self):
        self.now = {s: s for s in STATES}
        self.starts = dict.fromkeys(STATES, 0)
        self.fate = {s: OPEN if s in _BEGINNINGS else DEAD for s in STATES}

    def feed(self, text: str) -> None:
        if not text:
            return
        done = {s: feed(s, text) for s in set(self.now.values())}
        for s in STATES:
            state, starts, q = done[self.now[s]]
            if self.fate[s] == OPEN:
                self.fate[s] = DONE if -1 in starts else OPEN if q < 0 else DEAD
                before = self.fate[s] == DONE
            else:
                before = False  # a start before this text is one of this split
            self.starts[s] += len(starts) - before
            self.now[s] = state

    def rows(self) -> list[tuple[str, str, int, int]]:
        return [(s, self.now[s], self.starts[s], self.fate[s]) for s in STATES]


def chain(splits: list[dict[str, tuple[str, int, int]]]) -> list[tuple[str, int, bool]]:
    """Per split of a file its first state, the matches that start before it, and whether the
    beginning of a stamp that it ends with becomes one. ``splits`` maps states as ``Summary`` does."""
    state, owner = SEARCHING, None
    first, own, tail = [], [], []
    for i, split in enumerate(splits):
        after, starts, fate = split[state]
        if owner is not None and fate == DONE:
            tail[owner] = True
        first.append(state)
        own.append(starts)
        tail.append(False)
        if after not in _BEGINNINGS:
            owner = None
        elif not (owner is not None and fate == OPEN):
            owner = i
        state = after
    out, total = [], 0
    for s, n, t in zip(first, own, tail):
        out.append((s, total, t))
        total += n + t
    return out


class Cutter:
    """Cuts a split whose first state is known into the records that start or go on in it.

    A record runs from the start of a match to that of the next one. ``cut`` gives ``(number, place,
    text, complete)``: pieces of one record follow each other by place.
    """

    def __init__(self, state: str, before: int, tail: bool):
        self.state, self.number, self.tail, self.held, self.place = state, before, tail, "", 0

    def _piece(self, text: str, complete: bool = False) -> Iterator[tuple[int, int, str, bool]]:
        if text and self.number:  # what stands before the first match belongs to none
            self.place += 1
            yield self.number, self.place, text, complete

    def cut(self, text: str) -> Iterator[tuple[int, int, str, bool]]:
        work = self.held + text
        self.state, starts, q = feed(SEARCHING if self.held else self.state, work)
        cuts = [p for p in starts if p >= 0]
        end = q if self.state in _BEGINNINGS and q >= 0 else len(work)
        yield from self._piece(work[: cuts[0] if cuts else end])
        for a, b in zip(cuts, [*cuts[1:], end]):
            self.number += 1
            yield from self._piece(work[a:b], complete=b != end)
        self.held = work[end:]

    def finish(self) -> Iterator[tuple[int, int, str, bool]]:
        if self.tail:
            self.number += 1
        yield from self._piece(self.held)


def _texts(batches: Iterator[pa.RecordBatch], sep: str, extra: tuple[str, ...] = ()):
    """``(key, text)`` of consecutive lines of a split; the lines of a split come in order."""
    last = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("chat_id", "block", *extra)]
        lines = batch.column("line").to_pylist()
        for key, group in groupby(range(len(lines)), key=lambda i: tuple(c[i] for c in columns)):
            first, last = key != last, key
            text = sep.join(lines[i] for i in group)
            # The line end before the first line of a split is that split's.
            yield key, text if first and key[1] == 0 else sep + text


SPLITS = "chat_id string, block long, state string, after string, starts long, fate int"
CHAINED = "chat_id string, block long, state string, before long, tail boolean, total long"
PIECES = "chat_id string, nth long, block long, place long, text string, complete boolean, last boolean"


def records(lines: DataFrame, sep: str) -> DataFrame:
    """``(chat_id, nth, text, last)``: records of files, numbered from 1, from ``lines``.

    ``lines`` is a scan with ``(chat_id, block, line)``, a file split's lines in order. A record that
    is not the file's last one ends with the bracket of the next.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, summary = None, Summary()

        def rows(key, s: Summary) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [dict(zip(("chat_id", "block", "state", "after", "starts", "fate"), (*key, *r))) for r in s.rows()],
                pa.schema([("chat_id", pa.string()), ("block", pa.int64()), ("state", pa.string()),
                           ("after", pa.string()), ("starts", pa.int64()), ("fate", pa.int32())]),
            )

        for key, text in _texts(batches, sep):
            if key != now:
                if now is not None:
                    yield rows(now, summary)
                now, summary = key, Summary()
            summary.feed(text)
        if now is not None:
            yield rows(now, summary)

    def chained(file: pd.DataFrame) -> pd.DataFrame:
        file = file.sort_values("block")
        blocks, maps = [], []
        for block, part in file.groupby("block", sort=True):
            blocks.append(block)
            maps.append({s: (a, int(n), int(f)) for s, a, n, f in zip(part["state"], part["after"], part["starts"], part["fate"])})
        found = pd.DataFrame(chain(maps), columns=["state", "before", "tail"])
        found.insert(0, "block", blocks)
        found.insert(0, "chat_id", file["chat_id"].iloc[0])
        end = maps[-1][found["state"].iloc[-1]][1] + found["before"].iloc[-1] + found["tail"].iloc[-1]
        return found.assign(total=int(end))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cutter = None, None
        schema = pa.schema([("chat_id", pa.string()), ("nth", pa.int64()), ("block", pa.int64()), ("place", pa.int64()),
                            ("text", pa.string()), ("complete", pa.bool_()), ("last", pa.bool_())])

        def rows(key, found) -> pa.RecordBatch:
            chat, block, total = key[0], key[1], key[5]
            cells = [(chat, n, block, p, t, c, n == total) for n, p, t, c in found]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*cells), schema)], schema=schema)

        for key, text in _texts(batches, sep, ("state", "before", "tail", "total")):
            if key != now:
                if now is not None and (rest := list(cutter.finish())):
                    yield rows(now, rest)
                now, cutter = key, Cutter(*key[2:5])
            if out := list(cutter.cut(text)):
                yield rows(key, out)
        if now is not None and (rest := list(cutter.finish())):
            yield rows(now, rest)

    splits = lines.mapInArrow(summarise, SPLITS).groupBy("chat_id").applyInPandas(chained, CHAINED)
    # One row per file split; the driver's list of tasks is as long.
    known = lines.join(F.broadcast(splits), ["chat_id", "block"])
    columns = ["chat_id", "block", "line", "state", "before", "tail", "total"]
    pieces = known.select(columns).mapInArrow(cut, PIECES)
    ended = lambda last: F.when(last, F.col("text")).otherwise(F.concat("text", F.lit("[")))
    complete = pieces.where("complete").select("chat_id", "nth", "text", "last")
    parts = F.array_sort(F.collect_list(F.struct("block", "place", "text")))
    across = (
        pieces.where("NOT complete")
        .groupBy("chat_id", "nth", "last")
        .agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
        .select("chat_id", "nth", "text", "last")
    )
    both = complete.unionByName(across)
    end = F.when(F.col("last"), F.regexp_replace("text", r"\n+\z", "")).otherwise(F.col("text"))
    return both.withColumn("text", end).withColumn("text", ended(F.col("last")))


def lines_of(spark: SparkSession, paths: list[str], more_than: int, tidy: Column) -> DataFrame:
    """``(chat_id, block, line)`` of the files above a size; ``tidy`` is made from ``value``."""
    return (
        spark.read.option("lineSep", "\n")
        .text(paths)
        .where(F.col("_metadata.file_size") > more_than)
        .select(
            F.col("_metadata.file_path").alias("chat_id"),
            F.col("_metadata.file_block_start").alias("block"),
            tidy.alias("line"),
        )
    )
