import datetime as dt

import pytest
from pyspark.sql import functions as F

from convolens.schema import MESSAGE_SCHEMA
from convolens.sources import export, tables

H = "[01/02/24, 9:05:33\u202fPM]"


def parse(spark, text, mode, **options):
    df = spark.createDataFrame([("c", text)], "chat_id string, text string")
    return export.parse_export(df, mode, **options).orderBy("seq").collect()


@pytest.mark.parametrize(
    "text, want",
    [
        (f"{H} Al: hi{H} Bo: yo", [("Al", "hi"), ("Bo", "yo")]),
        (
            f"{H} Al added Bo{H} Bo: yo",
            [("Al added Bo[01/02/24, 9", "05:33\u202fpm] bo: yo")],
        ),
        (f"{H} Al: see [link] x{H} Bo: yo", [("Al", "see"), ("Bo", "yo")]),
        (f"{H} Al: [tag] x{H} Bo: yo", [("Al", "[tag] x"), ("Bo", "yo")]),
        (f"{H} : hi", [("", "hi")]),
        (f"{H} Al: 10:30 ok", [("Al", "10:30 ok")]),
        ("no message here", []),
    ],
)
def test_reference_mode(spark, text, want):
    assert [(r.user, r.message) for r in parse(spark, text, "reference")] == want


def test_lossless_mode_keeps_brackets_and_notices(spark):
    text = f"intro\n{H} Al added Bo\n{H} Al: see [link] x\n[not a stamp] y\n{H} Bo: YO"
    rows = parse(spark, text, "lossless", keep_raw=True)
    assert [(r.user, r.message_type, r.message) for r in rows] == [
        (None, "System", "al added bo"),
        ("Al", "Text", "see [link] x\n[not a stamp] y"),
        ("Bo", "Text", "yo"),
    ]
    assert rows[2].message_raw == "YO"


@pytest.mark.parametrize(
    "stamp, want",
    [
        ("[1/2/68, 12:00:00\u202fAM]", dt.datetime(2068, 2, 1, 0, 0)),
        ("[1/2/69, 12:00:00\u202fPM]", dt.datetime(1969, 2, 1, 12, 0)),
        ("[31/2/24, 9:00:00\u202fAM]", None),
        ("[1/2/24, 13:00:00\u202fPM]", None),
    ],
)
def test_times(spark, stamp, want):
    (row,) = parse(spark, f"{stamp} Al: hi", "lossless")
    assert row.date_time == want and row._bad_time == (want is None)
    if want is None:
        with pytest.raises(Exception, match="impossible time stamp"):
            parse(spark, f"{stamp} Al: hi", "lossless", strict=True)


@pytest.mark.parametrize(
    "body, kind, content",
    [
        ("\u200eimage omitted", "Image", ""),
        ("Video omitted after image omitted", "Image", ""),
        ("Missed voice call, tap to call back", "Voice Call", "Missed"),
        ("Video call, 1:02 min", "Video Call", "1:02"),
        ("Voice call, no answer", "Voice Call", " no answer"),
        ("plain", "Text", "plain"),
    ],
)
def test_types(spark, body, kind, content):
    (row,) = parse(spark, f"{H} Al: {body}", "lossless")
    assert (row.message_type, row.message) == (kind, content)


def test_lines_are_stripped_before_marks_go(spark):
    df = spark.createDataFrame([("  a \u200e \n\n b\u200e\n",)], "t string")
    join = lambda how: df.select(export.join_lines(F.col("t"), how)).first()[0]
    assert join("") == "a b"
    assert join("\n") == "a \n\nb"


def test_large_files_are_cut_like_small_ones(spark, tmp_path):
    lines = []
    for i in range(400):
        lines.append(f"[1/2/24, 9:{i // 60:02d}:{i % 60:02d}\u202fAM] U{i % 3}: body {i}")
        if i % 7 == 0:
            lines.append("[note] goes on")
        if i % 5 == 0:
            lines.append(f"\u200e[2/2/24, 9:00:00\u202fPM] U9: \u200eimage omitted {i}")
        if i % 11 == 0:
            lines.append("more\nand more")
        if i % 13 == 0:
            lines.append("mid [3/2/24, 9:00:00\u202fPM] U8: after the start of a line")
    marked = "\n".join(f"\u200e[1/2/24, 9:00:{i % 60:02d}\u202fAM] U: only marks {i}" for i in range(200))
    (tmp_path / "marks.txt").write_text(marked, encoding="utf8")
    (tmp_path / "none.txt").write_text("no stamp at all\n" * 500, encoding="utf8")
    (tmp_path / "big.txt").write_text("head\n" + "\n".join(lines) + "\n", encoding="utf8")
    (tmp_path / "other.txt").write_text(f"{H} Al: alone\n", encoding="utf8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        read = lambda limit: [
            (r.chat_id, r.seq, r.user, r.date_time, r.message_type, r.message)
            for r in export.read_export(spark, str(tmp_path), "\n", whole_file_bytes=limit)
            .orderBy("chat_id", "seq")
            .collect()
        ]
        whole, cut = read(1 << 20), read(0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(whole) == 481 + 31 + 200
    assert [r[1] for r in whole if r[0].endswith("big.txt")] == list(range(511))
    assert cut == whole


def test_size_limit_prunes_files_before_reading(spark, tmp_path):
    (tmp_path / "a.txt").write_text(f"{H} Al: alone\n", encoding="utf8")
    df = export.read_export(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "file_size" in plan and df.count() == 1


def test_missing_path_raises(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        export.read_export(spark, "/nowhere/at/all").collect()


def test_csv_keeps_empty_null_quotes_and_line_ends(spark, tmp_path):
    t = dt.datetime(2024, 1, 2, 3, 4, 5, 678900)
    rows = [
        ("c", 1, t, "Al", "Text", ' two\nlines, "quoted" \\ and blank '),
        ("c", 2, t, "", "Image", ""),
        ("c", 3, None, None, "Text", None),
        ("c", 4, t, "\\n", "Text", "\\ begins\\nso \\\\n\r\n"),
        ("c", 5, t, "a\nb", "Text", "C:\\new"),
    ]
    df = spark.createDataFrame(rows, MESSAGE_SCHEMA)
    path = str(tmp_path / "csv")
    tables.write_message_csv(df, path)
    back = [tuple(r) for r in tables.read_message_csv(spark, path).orderBy("seq").collect()]
    assert back == rows
    nulls = tables.read_message_csv(spark, path, reference_nulls=True).orderBy("seq").collect()
    assert [r.message for r in nulls] == [rows[0][5], None, None, rows[3][5], rows[4][5]]
    lines = sum(len(f.read_text().splitlines()) - 1 for f in (tmp_path / "csv").glob("part-*"))
    assert lines == len(rows)


def test_foreign_csv_with_line_ends(spark, tmp_path):
    head = "chat_id,seq,date_time,user,message_type,message\n"
    (tmp_path / "x.csv").write_text(head + 'c,1,2024-01-02T03:04:05,Al,Text,"two\nlines \\n"\n')
    row = tables.read_message_csv(spark, str(tmp_path), multi_line=True).first()
    assert (row.message, row.user) == ("two\nlines \\n", "Al")
