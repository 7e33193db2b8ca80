"""Reference-mode cutting of files in splits against the pattern on whole texts."""

import random
import re

import pytest

from convolens.sources import export, scan

PATTERN = re.compile(r"(?s)" + scan.STAMP.pattern + r" ?(.+?)? ?: ?(.+?)(?=\[|\Z)")
H, G = "[01/02/24, 9:05:33\u202fPM]", "[1/12/24, 12:05:33\u202fAM]"
BITS = [
    H, G, " Al: hi", " Al added Bo", " Bo: yo", " : hi", " Al: see [link] x", " [tag] x", ": ", "[", "]", "[1/", "[12/1/24, 1",
    "9:05", " ", ":", "x", "[0", "\u202fAM]", " Al: [", "[[[", "", "1/02/24, 9:05:33\u202fPM]",
]


def put_together(splits):
    """Matches of a text that comes in splits, each in parts."""
    maps = []
    for parts in splits:
        s = scan.Summary()
        for part in parts:
            s.feed(part)
        maps.append({state: rest for state, *rest in s.rows()})
    pieces, total = {}, 0
    for (state, before, tail), parts, known in zip(scan.chain(maps), splits, maps):
        cutter = scan.Cutter(state, before, tail)
        found = [p for part in parts for p in cutter.cut(part)] + list(cutter.finish())
        for number, _, text, complete in found:
            pieces.setdefault(number, []).append((text, complete))
        total = before + known[state][1] + tail
    out = []
    for number, found in sorted(pieces.items()):
        assert len(found) == 1 or not any(complete for _, complete in found)
        match = PATTERN.match("".join(t for t, _ in found) + ("[" if number < total else ""))
        assert match or number == total
        out += [match.group()] if match else []
    return out


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(1, 12))) for _ in range(n)]


def test_cut_at_every_offset():
    for text in texts(1, 150):
        want = [m.group() for m in PATTERN.finditer(text)]
        for i in range(len(text) + 1):
            assert put_together([[text[:i]], [text[i:]]]) == want


def test_cut_into_many_splits_and_parts():
    rng = random.Random(2)
    for text in texts(3, 400):
        cuts = [0, *sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(1, 9))), len(text)]
        pieces = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        splits = [[p[:k], p[k:]] for p in pieces for k in [rng.randrange(len(p) + 1)]]
        assert put_together(splits) == [m.group() for m in PATTERN.finditer(text)]


def test_states_are_few():
    assert len(scan.STATES) < 32
    assert scan.beginning("[12/3/24, 7:") == scan.beginning("[1/11/99, 12:") != scan.SEARCHING
    assert scan.beginning("[12/3/2x") == scan.SEARCHING


@pytest.mark.parametrize("line_join", ["", "\n"])
@pytest.mark.parametrize("split_bytes", [150, 1 << 20])
def test_files_of_any_size(spark, tmp_path, line_join, split_bytes):
    rng = random.Random(5)
    ends = ["\n", "\r\n", " \n\t", "\n\n", "\r", "", " ", "\u200e"]
    for f in range(2):
        text = "".join(rng.choice(BITS) + rng.choice(ends) for _ in range(150))
        (tmp_path / f"{f}.txt").write_text(text + rng.choice(["", "\n", " \n\n"]), newline="")
    (tmp_path / "none.txt").write_text("no stamp: here\n" * 9)
    (tmp_path / "one.txt").write_text(f"{H} : hi")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        rows = lambda size: sorted(
            map(repr, export.read_export(spark, str(tmp_path), line_join, "reference", size, keep_raw=True).drop("message_raw").collect())
        )
        got, want = rows(0), rows(1 << 30)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want and len(got) > 20


def test_a_record_over_several_splits(spark, tmp_path):
    lines = [f"{H} Al: first", *["more text without any bracket"] * 60, f"{G} nobody yet", *["still nobody"] * 40, "Bo: at last [x"]
    (tmp_path / "long.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 500)
    try:
        got = export.read_export(spark, str(tmp_path), mode="reference", whole_file_bytes=0).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.seq for r in got] == [0, 1]
    assert got[0].message == "first" + "more text without any bracket" * 60
    assert got[1].user == "nobody yet" + "still nobody" * 40 + "Bo" and got[1].message == "at last"
