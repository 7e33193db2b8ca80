"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

import unicodedata

from convolens.fixtures import (
    AS_OF,
    EMOJI_SHIFTS,
    EMPHASIS,
    LEXICON,
    MARKERS,
    MOODS,
    ROUTED,
    SECOND,
    START,
    STOP_WORDS,
    SUFFIXES,
    emoji_points,
)

# Written out here, so that an error in the library's own tables shows.
EMOTIONS = (
    "Joy Happiness Sadness Anger Love Fear Surprise Excitement Frustration Gratitude Despair Normal"
).split()
SHORT_NAMES = {
    0x2139: "information", 0x2764: "red_heart", 0x1F389: "party_popper", 0x1F44D: "thumbs_up",
    0x1F4AF: "hundred_points", 0x1F525: "fire", 0x1F600: "grinning_face",
    0x1F602: "face_with_tears_of_joy", 0x1F60D: "smiling_face_with_heart-eyes",
    0x1F621: "enraged_face", 0x1F622: "crying_face", 0x1F62D: "loudly_crying_face",
    0x1F64F: "folded_hands", 0x1F914: "thinking_face",
}
# The emojis that the fixtures append; 1F3FD is the skin tone after the thumb.
FIXTURE_EMOJIS = "\U0001f602\U0001f44d\U0001f3fd\u2139"


def emoji_name(point: str) -> str:
    known = SHORT_NAMES.get(ord(point)) or unicodedata.name(point, "").lower().replace(" ", "_")
    return f":{known}:" if known else point


KEYWORDS = "the thing than The enter q"
QUESTION = "the thing was on the and in die ist les ou un"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def case(index: str, options: list) -> str:
    whens = " ".join(
        f"WHEN {i} THEN {'NULL' if o is None else q(o)}" for i, o in enumerate(options)
    )
    return f"(CASE {index} {whens} END)"


def r(x: str) -> str:
    return f"round({x}, 6)"


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


T0 = f"TIMESTAMP '{START}'"
MSG = f"""msg AS (
  SELECT conv_id::VARCHAR AS chat_id, turn AS seq,
         {T0} + to_seconds(conv_id * 2220 + turn * (47 + (conv_id * (turn + 1)) % 13)) AS date_time,
         role AS "user", 'Text' AS message_type, text AS message
  FROM conversations)"""
RICH = f"""msg AS (
  SELECT conv_id::VARCHAR AS chat_id, turn AS seq, role AS "user",
         text || {case('((conv_id + turn) % 8)', SUFFIXES)} AS message
  FROM conversations)"""
DOC = f"""msg AS (
  SELECT source AS chat_id, doc_id AS seq, {T0} + to_seconds(doc_id * 61) AS date_time,
         lang AS "user", 'Text' AS message_type, text AS message
  FROM documents)"""
EV = """msg AS (
  SELECT (user_id % 10)::VARCHAR AS chat_id, event_id AS seq, ts AS date_time,
         user_id::VARCHAR AS "user", event_type AS message_type, event_type AS message
  FROM events)"""

SPACE = r"\s\p{Z}"
WORD = r"\p{L}\p{N}_"


def clean(x: str) -> str:
    plain = (
        f"trim(regexp_replace(regexp_replace(lower({x}), '(http|www)[^{SPACE}]+', '', 'g'), "
        f"'[^{WORD}]+', ' ', 'g'))"
    )
    return f"replace({plain}, chr(8505), ':information:')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[{WORD}]{{2,}}')"


def ngrams(t: str) -> str:
    return (
        f"list_concat(list_concat({t}, "
        f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])), "
        f"list_transform(range(1, len({t}) - 1), lambda i: {t}[i] || ' ' || {t}[i + 1] || ' ' || {t}[i + 2]))"
    )


REPORTABLE = f"rep AS (SELECT * FROM msg WHERE regexp_matches(message, '[^{SPACE}]'))"
CLEAN = f"cl AS (SELECT *, {clean('message')} AS clean_text FROM msg WHERE message IS NOT NULL)"
POSTINGS = """postings AS (
  SELECT DISTINCT w.word, chat_id, seq
  FROM cl, unnest(string_split(clean_text, ' ')) AS w(word) WHERE length(w.word) > 2)"""
WORD_FREQ = "wf AS (SELECT word, count(*) AS df FROM postings GROUP BY word)"
TF = f"""tk AS (SELECT chat_id, seq, {tokens('clean_text')} AS t FROM cl),
tf AS (
  SELECT chat_id, seq, g.term, count(*) AS tf
  FROM tk, unnest({ngrams('t')}) AS g(term) GROUP BY ALL)"""
TERMS = """cnt AS (SELECT count(*) AS n FROM cl),
terms AS (
  SELECT term, df, total, ln((1 + n) / (1 + df)) + 1 AS idf
  FROM (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM tf GROUP BY term), cnt
  WHERE df >= 2 AND df <= 0.9 * n
  ORDER BY total DESC, term LIMIT 10000)"""
WEIGHTS = """wts AS (
  SELECT term, chat_id, seq, tf,
         tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY chat_id, seq)) AS weight
  FROM tf JOIN terms USING (term))"""
INDEX = [CLEAN, POSTINGS, WORD_FREQ, TF, TERMS, WEIGHTS]


def hashed(name: str, source: str, keys: str, text: str, dim: int = 64) -> str:
    """Feature hashes in long form: (keys, pos, v)."""
    return f"""{name}_slot AS (
  SELECT {keys}, (('0x' || substr(md5(x.tok), 1, 8))::BIGINT % {2 * dim}) AS slot
  FROM {source}, unnest({tokens(text)}) AS x(tok)),
{name} AS (
  SELECT {keys}, slot // 2 AS pos, sum(CASE WHEN slot % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v
  FROM {name}_slot GROUP BY ALL)"""


def cosine_hits(name: str, vec: str, queries: str, ids: str, k: int = 15, floor: float = 0.1) -> str:
    """Top k by cosine from long-form vectors (ids, pos, v) and (query_id, pos, v)."""
    return f"""{name}_score AS (
  SELECT query_id, {ids}, round(dot / (a.norm * b.norm), 9) + 0.0 AS score
  FROM (SELECT query_id, {ids}, sum(x.v * y.v) AS dot FROM {vec} x JOIN {queries} y USING (pos) GROUP BY ALL)
  JOIN (SELECT {ids}, sqrt(sum(v * v)) AS norm FROM {vec} GROUP BY ALL) a USING ({ids})
  JOIN (SELECT query_id, sqrt(sum(v * v)) AS norm FROM {queries} GROUP BY ALL) b USING (query_id)
  WHERE a.norm > 0 AND b.norm > 0),
{name} AS (
  SELECT query_id, {ids}, score FROM {name}_score WHERE score > {floor}
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {ids}) <= {k})"""


def keyword_hits(name: str, queries: str, k: int = 15) -> str:
    return f"""{name}_kw AS (
  SELECT query_id, w.keyword, count(*) AS times
  FROM {queries}, unnest(regexp_extract_all(lower(text), '[^{SPACE}]+')) AS w(keyword)
  WHERE length(w.keyword) >= 2 GROUP BY ALL),
{name}_fz AS (
  SELECT keyword, word, similarity FROM (
    SELECT keyword, word,
           len(list_intersect(string_split(keyword, ''), string_split(word, '')))
           / len(list_distinct(list_concat(string_split(keyword, ''), string_split(word, '')))) AS similarity
    FROM (SELECT DISTINCT keyword FROM {name}_kw) k JOIN wf
      ON keyword <> word AND (contains(word, keyword) OR contains(keyword, word)))
  WHERE similarity > 0.5),
{name}_w AS (
  SELECT query_id, keyword AS word, 2.0::DOUBLE * times AS w FROM {name}_kw
  UNION ALL
  SELECT query_id, word, 0.8::DOUBLE * similarity * times FROM {name}_kw JOIN {name}_fz USING (keyword)),
{name} AS (
  SELECT query_id, chat_id, seq, round(sum(w), 9) AS score
  FROM postings JOIN {name}_w USING (word) GROUP BY query_id, chat_id, seq
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chat_id, seq) <= {k})"""


def tfidf_hits(name: str, queries: str, k: int = 15) -> str:
    return f"""{name}_tk AS (SELECT query_id, {tokens('text')} AS t FROM {queries}),
{name}_tf AS (
  SELECT query_id, g.term, count(*) AS tf FROM {name}_tk, unnest({ngrams('t')}) AS g(term) GROUP BY ALL),
{name}_qw AS (
  SELECT query_id, term,
         tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY query_id)) AS qweight
  FROM {name}_tf JOIN terms USING (term)),
{name}_sc AS (
  SELECT query_id, chat_id, seq, round(sum(qweight * weight), 9) AS score
  FROM wts JOIN {name}_qw USING (term) GROUP BY ALL),
{name} AS (
  SELECT * FROM {name}_sc WHERE score > 0.01
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chat_id, seq) <= {k})"""


def fused_hits(name: str, queries: str, k: int = 15) -> str:
    """Needs the index CTEs and ``mv`` (hashed message vectors)."""
    return f"""{hashed(f'{name}_qv', queries, 'query_id', 'text')},
{cosine_hits(f'{name}_s', 'mv', f'{name}_qv', 'chat_id, seq', k)},
{keyword_hits(f'{name}_k', queries, k)},
{tfidf_hits(f'{name}_t', queries, k)},
{name}_all AS (
  SELECT query_id, chat_id, seq, score, 1.0::DOUBLE AS w FROM {name}_s
  UNION ALL SELECT query_id, chat_id, seq, score, 0.8 FROM {name}_k
  UNION ALL SELECT query_id, chat_id, seq, score, 0.6 FROM {name}_t),
{name}_f AS (
  SELECT query_id, chat_id, seq, round(sum(score * w) / sum(w) + 0.1 * count(*), 6) AS score
  FROM {name}_all GROUP BY query_id, chat_id, seq),
{name} AS (
  SELECT * FROM {name}_f
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chat_id, seq) <= {2 * k})"""


MV = hashed("mv", "cl", "chat_id, seq", "clean_text")
BENCH = "bench AS (SELECT item_id::VARCHAR AS query_id, text FROM benchmark)"


def question(text: str) -> str:
    return f"one AS (SELECT 'q' AS query_id, {q(text)} AS text)"


def rendered(hits: str, method: str) -> str:
    return f"""SELECT query_id, chat_id, seq, "user", date_time, message, message_type, score,
       '{method}' AS method FROM {hits} JOIN msg USING (chat_id, seq)"""


VEC = """vec AS (
  SELECT vec_id, label::VARCHAR AS "user", unnest(embedding)::DOUBLE AS v,
         generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"""
PROTO = """proto AS (
  SELECT label::VARCHAR AS query_id, label AS ord, pos, round(avg(v), 6) AS v
  FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos
        FROM embeddings) GROUP BY ALL)"""
CENTROID = "centroid AS (SELECT 'q' AS query_id, pos, round(avg(v), 6) AS v FROM vec GROUP BY pos)"
# Cosine of every vector to every label prototype.
EMO = f"""{cosine_hits('emo0', 'vec', 'proto', 'vec_id', 1, -2)},
emo AS (
  SELECT vec_id, ord, query_id AS label, score,
         dense_rank() OVER (ORDER BY ord) - 1 AS pos
  FROM emo0_score JOIN (SELECT DISTINCT query_id, ord FROM proto) USING (query_id)),
best AS (
  SELECT vec_id, label AS dominant_emotion, score FROM emo
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, ord) = 1)"""


def gaps(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""gaps AS (
  SELECT *, lead("user") OVER w AS next_user, lead(date_time) OVER w AS next_time,
         date_diff('microsecond', date_time, lead(date_time) OVER w) / 1e6 AS gap_sec
  FROM rep WINDOW w AS ({part} ORDER BY date_time, chat_id, seq))"""


ANSWERED = 'ans AS (SELECT * FROM gaps WHERE "user" IS DISTINCT FROM next_user)'


def by_columns(by: str) -> str:
    return f"{by}, " if by else ""


def activity(by: str = "") -> str:
    c = by_columns(by)
    return f"""act AS (
  SELECT {c}"user", count(*) AS total_messages, sum(nw)::BIGINT AS total_words, {r('avg(nw)')} AS avg_words,
         {r('avg(nc)')} AS avg_chars, {r('avg(caps)')} AS avg_caps_ratio
  FROM (SELECT *, len(regexp_extract_all(message, '[^{SPACE}]+')) AS nw, length(message) AS nc,
               length(regexp_replace(message, '[^\\p{{Lu}}]', '', 'g')) / length(message) AS caps FROM rep)
  GROUP BY {c}"user")"""


EMOJI = rf"""emo AS (
  SELECT e.emoji, count(*) AS n
  FROM rep, unnest(regexp_extract_all(message, '[{FIXTURE_EMOJIS}]')) AS e(emoji) GROUP BY ALL
  ORDER BY n DESC, emoji LIMIT 10)"""
_LEX = ", ".join(f"({q(t)}, {v})" for t, v in LEXICON)


def sentiment(by: str = "") -> str:
    c = by_columns(by)
    return f"""lex AS (SELECT token, valence::DOUBLE AS valence FROM (VALUES {_LEX}) v(token, valence)),
toks AS (
  SELECT chat_id, seq, replace(x.token, '''', '') AS token
  FROM rep, unnest(regexp_extract_all(lower(message), '[{WORD}'']+')) AS x(token)),
sums AS (SELECT chat_id, seq, sum(valence) AS s FROM toks JOIN lex USING (token) GROUP BY ALL),
sent AS (
  SELECT {c}"user", {r('avg(coalesce(s / sqrt(s * s + 15), 0))')} AS avg_sentiment
  FROM rep LEFT JOIN sums USING (chat_id, seq) GROUP BY {c}"user")"""


MOOD = f"""msg AS (
  SELECT conv_id::VARCHAR AS chat_id, turn AS seq, role AS "user",
         {case(f'((conv_id + turn) % {len(MOODS)})', MOODS)} || text AS message
  FROM conversations)"""
# Of the words that turn or scale a valence, the texts hold only those that the fixture adds.
_A, _B, _C = (
    f"CASE WHEN {x} IN ('very', 'so') THEN 0.293 WHEN {x} = 'barely' THEN -0.293 ELSE 0 END" for x in "abc"
)
RULES = f"""lex AS (SELECT token, valence::DOUBLE AS valence FROM (VALUES {_LEX}) v(token, valence)),
toks AS (
  SELECT chat_id, seq, "user", list_transform(regexp_extract_all(lower(message), '[{WORD}'']+'), lambda t: replace(t, chr(39), '')) AS t
  FROM rep),
each AS (SELECT chat_id, seq, "user", t, unnest(generate_series(1, len(t))) AS i FROM toks),
ctx AS (
  SELECT chat_id, seq, "user", t[i] AS token, CASE WHEN i > 1 THEN t[i - 1] END AS a,
         CASE WHEN i > 2 THEN t[i - 2] END AS b, CASE WHEN i > 3 THEN t[i - 3] END AS c
  FROM each),
vals AS (
  SELECT chat_id, seq, "user",
         (valence + sign(valence) * (1.0 * {_A} + 0.95 * {_B} + 0.9 * {_C}))
         * CASE WHEN coalesce(a IN ('not', 'never'), false) OR coalesce(b IN ('not', 'never'), false)
                  OR coalesce(c IN ('not', 'never'), false) THEN -0.74 ELSE 1 END AS v
  FROM ctx JOIN lex USING (token)),
sums AS (SELECT chat_id, seq, sum(v) AS s FROM vals GROUP BY ALL),
sent AS (
  SELECT "user", {r('avg(coalesce(s / sqrt(s * s + 15), 0))')} AS avg_sentiment
  FROM rep LEFT JOIN sums USING (chat_id, seq) GROUP BY "user")"""


EMPHATIC = f"""msg AS (
  SELECT conv_id::VARCHAR AS chat_id, turn AS seq, role AS "user",
         {case(f'((conv_id + turn) % {len(EMPHASIS)})', [e[0] for e in EMPHASIS])} || text
         || {case(f'((conv_id + turn) % {len(EMPHASIS)})', [e[1] for e in EMPHASIS])} AS message
  FROM conversations)"""
# A step in capitals counts 0.733 more, whatever its direction.
_SA, _SB, _SC = (
    f"(CASE WHEN {x} IN ('very', 'so', 'really') THEN 0.293 + CASE WHEN u{x} THEN 0.733 ELSE 0 END ELSE 0 END)" for x in "abc"
)
EMPHASISED = f"""lex AS (SELECT token, valence::DOUBLE AS valence FROM (VALUES {_LEX}) v(token, valence)),
words AS (
  SELECT chat_id, seq, message, list_transform(regexp_extract_all(message, '[{WORD}'']+'), lambda t: replace(t, chr(39), '')) AS w
  FROM rep),
caps AS (
  SELECT *, list_transform(w, lambda t: lower(t)) AS t,
         list_transform(w, lambda t: upper(t) = t AND lower(t) <> t) AS u FROM words),
loud AS (
  SELECT *, list_position(t, 'but') AS turn, len(list_filter(u, lambda x: x)) BETWEEN 1 AND len(u) - 1 AS mixed FROM caps),
each AS (SELECT *, unnest(generate_series(1, len(t))) AS i FROM loud),
ctx AS (
  SELECT chat_id, seq, t[i] AS token, i, turn, mixed AND u[i] AS own,
         CASE WHEN i > 1 THEN t[i - 1] END AS a, CASE WHEN i > 2 THEN t[i - 2] END AS b, CASE WHEN i > 3 THEN t[i - 3] END AS c,
         mixed AND i > 1 AND u[greatest(i - 1, 1)] AS ua, mixed AND i > 2 AND u[greatest(i - 2, 1)] AS ub,
         mixed AND i > 3 AND u[greatest(i - 3, 1)] AS uc
  FROM each),
vals AS (
  SELECT chat_id, seq,
         (valence + sign(valence) * (CASE WHEN own THEN 0.733 ELSE 0 END + 1.0 * {_SA} + 0.95 * {_SB} + 0.9 * {_SC}))
         * CASE WHEN coalesce(a IN ('not'), false) OR coalesce(b IN ('not'), false)
                  OR coalesce(c IN ('not'), false) THEN -0.74 ELSE 1 END
         * CASE WHEN turn IS NULL OR turn = 0 OR i = turn THEN 1.0 WHEN i < turn THEN 0.5 ELSE 1.5 END AS v
  FROM ctx JOIN lex USING (token)),
raw AS (SELECT chat_id, seq, sum(v) AS s FROM vals GROUP BY ALL),
marks AS (
  SELECT chat_id, seq, least(len(message) - len(replace(message, '!', '')), 4) * 0.292
         + CASE WHEN q > 3 THEN 0.96 WHEN q > 1 THEN q * 0.18 ELSE 0 END AS m
  FROM (SELECT *, len(message) - len(replace(message, '?', '')) AS q FROM rep)),
sums AS (SELECT chat_id, seq, s + sign(s) * m AS s FROM raw JOIN marks USING (chat_id, seq)),
sent AS (
  SELECT "user", {r('avg(coalesce(s / sqrt(s * s + 15), 0))')} AS avg_sentiment
  FROM rep LEFT JOIN sums USING (chat_id, seq) GROUP BY "user")"""


def stop_list() -> str:
    return ", ".join(q(w) for w in STOP_WORDS)


def top_words() -> str:
    return f"""tw AS (
  SELECT t.word, count(*) AS n FROM rep, unnest({tokens('message')}) AS t(word)
  WHERE t.word NOT IN ({stop_list()}) GROUP BY ALL ORDER BY n DESC, word LIMIT 20)"""


def gap_stats(by: str = "") -> str:
    c = by_columns(by)
    return f"""gs AS (
  SELECT {c}"user", {r('coalesce(avg(gap_sec), 0)')} AS avg_response_sec,
         {r('coalesce(max(gap_sec), 0)')} AS longest_silence_sec
  FROM ans GROUP BY {c}"user")"""


def wake(by: str = "") -> str:
    c = by_columns(by)
    return f"""wk AS (
  SELECT {c}"user", {r('avg(f)')} AS avg_first_hour, {r('avg(l)')} AS avg_last_hour
  FROM (SELECT {c}"user", date_time::DATE AS d, min(hour(date_time)) AS f, max(hour(date_time)) AS l
        FROM rep GROUP BY ALL) GROUP BY {c}"user")"""


def dominance(by: str = "") -> str:
    c = by_columns(by)
    part = f"PARTITION BY {by}" if by else ""
    return f"""dom AS (
  SELECT {c}"user", {r(f'count(*) / sum(count(*)) OVER ({part})')} AS share FROM rep GROUP BY {c}"user")"""


def long_part(metric: str, table: str, key: str, value: str) -> str:
    return f"SELECT '{metric}' AS metric, {key} AS key, {value}::DOUBLE AS value FROM {table}"


REPORT = " UNION ALL ".join(
    long_part(*p)
    for p in [
        ("total_messages", "act", '"user"', "total_messages"),
        ("total_words", "act", '"user"', "total_words"),
        ("avg_words", "act", '"user"', "avg_words"),
        ("avg_chars", "act", '"user"', "avg_chars"),
        ("avg_caps_ratio", "act", '"user"', "avg_caps_ratio"),
        ("emoji_counts", "emo", "emoji", "n"),
        ("avg_sentiment", "sent", '"user"', "avg_sentiment"),
        ("avg_response_time_sec", "gs", '"user"', "avg_response_sec"),
        ("longest_silence_seconds", "gs", '"user"', "longest_silence_sec"),
        ("top_words", "tw", "word", "n"),
        ("avg_first_msg_hour", "wk", '"user"', "avg_first_hour"),
        ("avg_last_msg_hour", "wk", '"user"', "avg_last_hour"),
        ("dominance_score", "dom", '"user"', "share"),
    ]
)

# --- exports ------------------------------------------------------------------------------------
_MI = "((chat_id::BIGINT * 3 + seq) % 16)"


def parsed(join: str = "chr(10)") -> str:
    """Messages as an export shows them, lines put together with ``join``; markers follow texts."""
    return f"""sent AS (
  SELECT chat_id, seq * 2 AS seq, date_time, "user", 'Text' AS message_type,
         lower(trim(regexp_replace(message, '[ \\t]*\\n[ \\t]*', {join}, 'g'))) AS message
  FROM msg
  UNION ALL
  SELECT chat_id, seq * 2 + 1, date_time, "user", {case(_MI, [m[1] for m in MARKERS])},
         {case(_MI, [m[2] for m in MARKERS])}
  FROM msg WHERE {_MI} < {sum(m[0] is not None for m in MARKERS)}),
parsed AS (
  SELECT chat_id, seq, date_time, "user" || '-' || chat_id || '-' || seq AS "user", message_type, message
  FROM sent)"""


PARSED = parsed()
BO = "'got ' || chat_id || '/' || seq"

# --- responses ----------------------------------------------------------------------------------
_JSON = (
    "('\"' || replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '\"', '\\\"'), "
    "chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '\"')"
)


def call(name: str, argument: str, value: str) -> str:
    return f"""('{{"function_call": {{"name": "{name}", "arguments": {{"{argument}": ' || {value} || '}}}}}}')"""


_T = _JSON.format("text")
STRIPPED = [
    "trim(text) || ' `ok`'",
    call("semantic_search_optimized", "query", _T),
    call("keyword_search_optimized", "keywords", _T),
    "'``Sure: `' || " + call("tfidf_search_optimized", "query", _T) + " || '` done'",
    f"""'{{"function_call": {{"name": "get_stats", ' || {_T}""",
    call("best_search", "query", _T),
]
CALLED = [None, "semantic_search_optimized", "keyword_search_optimized", "tfidf_search_optimized", None, "best_search"]
_RI = "((conv_id + turn) % 6)"


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}

    def add(name: str, *ctes: str, body: str) -> None:
        o[name] = with_(*ctes, body=body)

    # sources and parsing
    body = 'SELECT date_time, "user", message_type, message FROM parsed'
    add("ingest_export", MSG, PARSED, body=body)
    add("ingest_large_export", MSG, PARSED, body=body)
    # No text holds a bracket and every line has a sender, so both modes cut alike.
    add("ingest_reference_export", MSG, PARSED, body=body)
    answers = f"""
  UNION ALL SELECT chat_id || '-' || seq, date_time, NULL, 'System', 'messages are encrypted' FROM sent
  UNION ALL SELECT chat_id || '-' || seq, date_time, 'Bo', 'Text', {BO} || ' [ok] thanks' FROM sent"""
    first = "SELECT chat_id || '-' || seq AS chat_id, date_time, \"user\", message_type, message FROM parsed"
    add("parse_export", MSG, PARSED, body=first + answers)
    # One pass: the notice has no sender, so it swallows the head of the answer up to its colon.
    swallowed = """
  UNION ALL SELECT chat_id || '-' || seq, date_time,
         'Messages are encrypted[' || strftime(date_time, '%-d/%-m/%y, %-I'), 'Text',
         lower(strftime(date_time, '%M:%S') || chr(8239) || strftime(date_time, '%p') || '] Bo: Got '
               || chat_id || '/' || seq) FROM sent"""
    add("parse_export_reference", MSG, parsed("''"), body=first + swallowed)
    add(
        "classify_type", MSG, PARSED,
        body="SELECT message_type, count(*) AS n FROM parsed GROUP BY ALL",
    )
    add(
        "call_details", MSG, PARSED,
        body='SELECT chat_id, seq, message_type, message FROM parsed WHERE message_type LIKE \'% Call\'',
    )
    add("csv_roundtrip", MSG, body="SELECT * FROM msg")
    add("table_roundtrip", DOC, body="SELECT * FROM msg")
    add("clean_text", RICH, CLEAN, body="SELECT chat_id, seq, clean_text FROM cl")
    names = [emoji_name(p) for p in emoji_points()]
    listed = "[" + ", ".join(q(n) for n in names) + "]"
    picked = " || ".join(f"names[(chat_id::BIGINT * 7 + seq + {s}) % {len(names)} + 1]" for s in EMOJI_SHIFTS)
    add(
        "emoji_alias", MSG, f"n AS (SELECT {listed} AS names)",
        body=f"SELECT chat_id, seq, message || {picked} AS named FROM msg, n",
    )
    add("emoji_counts", RICH, REPORTABLE, EMOJI, body="SELECT * FROM emo")
    add(
        "calendar_profile", EV, REPORTABLE,
        body="""SELECT date_time::DATE AS date, hour(date_time)::INTEGER AS hour, dayname(date_time) AS weekday,
                date_trunc('day', date_time)::TIMESTAMP AS day, count(*) AS n FROM rep GROUP BY ALL""",
    )
    # statistics
    stats = """SELECT {0}count(*) AS total_messages, count(DISTINCT "user") AS unique_users,
      min(date_time) AS first_time, max(date_time) AS last_time,
      round(avg(length(message)), 6) AS avg_message_length FROM msg {1}"""
    add("dataset_stats", MSG, body=stats.format("", ""))
    add("dataset_stats_by_chat", EV, body=stats.format("chat_id, ", "GROUP BY chat_id"))
    add("type_counts", EV, body="SELECT message_type, count(*) AS n FROM msg GROUP BY ALL")
    add("top_users", EV, body='SELECT "user", count(*) AS n FROM msg GROUP BY ALL ORDER BY n DESC, "user" LIMIT 5')
    add(
        "top_users_by_chat", EV,
        body="""SELECT chat_id, "user", count(*) AS n FROM msg GROUP BY chat_id, "user"
                QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY count(*) DESC, "user") <= 5""",
    )
    common = "SELECT word, df FROM wf ORDER BY df DESC, word LIMIT 20"
    add("common_words", MSG, CLEAN, POSTINGS, WORD_FREQ, body=common)
    add("user_activity", RICH, REPORTABLE, activity(), body="SELECT * FROM act")
    add("user_activity_by_chat", DOC, REPORTABLE, activity("chat_id"), body="SELECT * FROM act")
    add("sentiment_by_user", MSG, REPORTABLE, sentiment(), body="SELECT * FROM sent")
    add("sentiment_rules", MOOD, REPORTABLE, RULES, body="SELECT * FROM sent")
    add("sentiment_emphasis", EMPHATIC, REPORTABLE, EMPHASISED, body="SELECT * FROM sent")
    add("sentiment_by_chat", DOC, REPORTABLE, sentiment("chat_id"), body="SELECT * FROM sent")
    cols = ["avg_response_sec", "longest_silence_sec"]
    for name, col in zip(["response_time", "longest_silence"], cols):
        for by, suffix in (("", ""), ("chat_id", "_by_chat")):
            add(
                name + suffix, EV, REPORTABLE, gaps(by), ANSWERED, gap_stats(by),
                body=f'SELECT {by_columns(by)}"user", {col} FROM gs',
            )
    gap_cols = 'SELECT chat_id, seq, "user", date_time, next_user, next_time, round(gap_sec, 6) AS gap_sec FROM gaps'
    add("gaps_by_chat", EV, REPORTABLE, gaps("chat_id"), body=gap_cols)
    add("gaps_by_chat_ranged", EV, REPORTABLE, gaps("chat_id"), body=gap_cols)
    add("gaps_global", EV, REPORTABLE, gaps(""), body=gap_cols)
    add("top_words", DOC, REPORTABLE, top_words(), body="SELECT * FROM tw")
    add("wake_sleep", EV, REPORTABLE, wake(), body="SELECT * FROM wk")
    add("dominance", EV, REPORTABLE, dominance(), body="SELECT * FROM dom")
    add("dominance_by_chat", EV, REPORTABLE, dominance("chat_id"), body="SELECT * FROM dom")
    add(
        "report_long", MSG, REPORTABLE, activity(), EMOJI, sentiment(), gaps(""), ANSWERED,
        gap_stats(), top_words(), wake(), dominance(), body=REPORT,
    )
    # retrieval
    hit = 'SELECT chat_id, seq, "user", date_time, message, message_type, 1.0::DOUBLE AS score, \'{0}\' AS method FROM msg '
    tail = " ORDER BY date_time DESC, chat_id, seq LIMIT 10"
    add("user_messages", EV, body=hit.format("user_filter") + "WHERE regexp_matches(\"user\", '(?i)^1.$')" + tail)
    add("recent_messages", EV, body=hit.format("recent") + f"WHERE date_time >= TIMESTAMP '{AS_OF}' - INTERVAL 36 HOUR" + tail)
    # index
    add("word_postings", MSG, CLEAN, POSTINGS, body="SELECT * FROM postings")
    add("word_freq", DOC, CLEAN, POSTINGS, WORD_FREQ, body="SELECT * FROM wf")
    add("tfidf_terms", MSG, CLEAN, TF, body="SELECT * FROM tf")
    vocab = "SELECT term, df, total, round(idf, 6) AS idf FROM terms"
    weights = "SELECT term, chat_id, seq, tf, round(weight, 6) AS weight FROM wts"
    add("tfidf_vocab", MSG, CLEAN, TF, TERMS, body=vocab)
    add("tfidf_vocab_documents", DOC, CLEAN, TF, TERMS, body=vocab)
    add("tfidf_weights", MSG, CLEAN, TF, TERMS, WEIGHTS, body=weights)
    add("tfidf_weights_documents", DOC, CLEAN, TF, TERMS, WEIGHTS, body=weights)
    add("index_roundtrip", MSG, CLEAN, TF, TERMS, WEIGHTS, body=weights)
    add("index_segments", MSG, CLEAN, TF, TERMS, WEIGHTS, body=weights)
    add(
        "index_uncapped", MSG, CLEAN,
        body=f"""SELECT term, df, total, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf FROM (
  SELECT term, count(DISTINCT chat_id || '/' || seq) AS df, count(*) AS total
  FROM cl, unnest({tokens('clean_text')}) AS x(term) GROUP BY term), (SELECT count(*) AS n FROM cl)""",
    )
    add(
        "user_profile", MSG, CLEAN,
        body=f"""SELECT "user", message_count, avg_length, word, n, row_number() OVER (PARTITION BY "user" ORDER BY n DESC, word)::INTEGER AS rank
  FROM (SELECT "user", count(*) AS message_count, {r('avg(length(message))')} AS avg_length FROM cl GROUP BY ALL)
  JOIN (SELECT "user", w.word, count(*) AS n FROM cl, unnest(string_split(clean_text, ' ')) AS w(word)
        WHERE w.word <> '' GROUP BY ALL) USING ("user")
  QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY n DESC, word) <= 10""",
    )
    add("embed_hash", MSG, CLEAN, MV, body="SELECT chat_id, seq, pos, v FROM mv WHERE v <> 0")
    add("nearest_label", VEC, PROTO, EMO, body="SELECT * FROM best")
    add(
        "emotion_mix", VEC, PROTO, EMO,
        body='SELECT "user", dominant_emotion, count(*) AS n FROM best JOIN (SELECT DISTINCT vec_id, "user" FROM vec) USING (vec_id) GROUP BY ALL',
    )
    labels = "lab AS (SELECT i AS query_id, l AS text FROM (VALUES " + ", ".join(
        f"({i}, {q(e)})" for i, e in enumerate(EMOTIONS)
    ) + ") v(i, l))"
    add(
        "message_emotions", MSG, CLEAN, MV, labels, hashed("lv", "lab", "query_id", "text"),
        cosine_hits("me", "mv", "lv", "chat_id, seq", 12, -2),
        body="""SELECT chat_id, seq, text AS dominant_emotion, score FROM (
  SELECT c.chat_id, c.seq, l.query_id, l.text, coalesce(s.score, 0) AS score
  FROM cl c CROSS JOIN lab l LEFT JOIN me_score s
    ON s.chat_id = c.chat_id AND s.seq = c.seq AND s.query_id = l.query_id)
  QUALIFY row_number() OVER (PARTITION BY chat_id, seq ORDER BY score DESC, query_id) = 1""",
    )
    add(
        "emotion_similar", VEC, PROTO, EMO,
        "ev AS (SELECT vec_id, pos, score AS v FROM emo)",
        "eq AS (SELECT 'q' AS query_id, pos, round(avg(v), 6) AS v FROM ev GROUP BY pos)",
        cosine_hits("hit", "ev", "eq", "vec_id"), body="SELECT * FROM hit",
    )
    # search
    add("semantic_topk", VEC, CENTROID, cosine_hits("hit", "vec", "centroid", "vec_id"), body="SELECT * FROM hit")
    add("semantic_batch", VEC, PROTO, cosine_hits("hit", "vec", "proto", "vec_id"), body="SELECT * FROM hit")
    add(
        "semantic_messages", MSG, CLEAN, MV, BENCH, hashed("qv", "bench", "query_id", "text"),
        cosine_hits("hit", "mv", "qv", "chat_id, seq"), body="SELECT * FROM hit",
    )
    base = [MSG, CLEAN, POSTINGS, WORD_FREQ]
    add("keyword_search", *base, question(KEYWORDS), keyword_hits("hit", "one"), body=rendered("hit", "keyword_optimized"))
    add("keyword_batch", *base, BENCH, keyword_hits("hit", "bench"), body="SELECT * FROM hit")
    add("fuzzy_vocab", *base, BENCH, keyword_hits("hit", "bench"), body=f"SELECT keyword, word, {r('similarity')} AS similarity FROM hit_fz")
    full = [MSG, *INDEX, MV]
    add("tfidf_search", *full, question(QUESTION), tfidf_hits("hit", "one"), body=rendered("hit", "tfidf_optimized"))
    add("tfidf_batch", *full, BENCH, tfidf_hits("hit", "bench"), body="SELECT * FROM hit")
    add("combined_search", *full, question(QUESTION), fused_hits("hit", "one"), body=rendered("hit", "combined_optimized"))
    add("combined_batch", *full, BENCH, fused_hits("hit", "bench"), body="SELECT * FROM hit")
    # responses
    shape = "CASE " + _RI + " " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(STRIPPED)) + " END"
    add("strip_reasoning", "x AS (SELECT 1)", body=f"SELECT conv_id, turn, {shape} AS clean FROM conversations")
    name = case(_RI, CALLED)
    arg = f"CASE WHEN {_RI} IN (1, 2, 3, 5) THEN replace(text, chr(96), chr(39)) END"
    add(
        "tool_calls", "x AS (SELECT 1)",
        body=f"SELECT conv_id, turn, {name} IS NOT NULL AS is_call, {name} AS name, {arg} AS argument FROM conversations",
    )
    item = lambda i: f"(SELECT item_id::VARCHAR AS query_id, text, item_id FROM benchmark WHERE item_id % 8 = {i})"
    second = lambda i: f"(SELECT (item_id + {SECOND})::VARCHAR AS query_id, item_id FROM benchmark WHERE item_id % 8 = {i})"
    latest = """(SELECT chat_id, seq, date_time FROM msg {0} ORDER BY date_time DESC, chat_id, seq LIMIT 10)"""
    names = [n.lower() for n, _ in ROUTED]
    found = lambda table, fn, method: (
        f"SELECT query_id, '{fn}' AS function, chat_id, seq, score, '{method}' AS method FROM {table}"
    )
    routed = [
        *[f"q{i} AS {item(i)}" for i in range(8)],
        *[f"p{i} AS {second(i)}" for i in (4, 5)],
        tfidf_hits("h0", "q0"), keyword_hits("h1", "q1"),
        hashed("qv2", "q2", "query_id", "text"), cosine_hits("h2", "mv", "qv2", "chat_id, seq"),
        fused_hits("h3", "q3"),
        f"u4 AS (SELECT query_id, chat_id, seq, 1.0::DOUBLE AS score FROM p4, {latest.format('WHERE lower(' + chr(34) + 'user' + chr(34) + ') LIKE ' + q('%assist%'))})",
        f"u5 AS (SELECT query_id, chat_id, seq, 1.0::DOUBLE AS score FROM p5, {latest.format('')} WHERE date_time >= TIMESTAMP '{AS_OF}' - to_hours(item_id * 100))",
        "routed AS (" + " UNION ALL ".join([
            found("h0", names[0], "tfidf_optimized"), found("h1", names[1], "keyword_optimized"),
            found("h2", names[2], "semantic_optimized"), found("h3", names[3], "combined_optimized"),
            found("u4", names[4], "user_filter"), found("u5", names[5], "recent"),
        ]) + ")",
        """common AS (
  SELECT '[' || string_agg('{"word":"' || word || '","df":' || df || '}', ',' ORDER BY word) || ']' AS words
  FROM (SELECT word, df FROM wf ORDER BY df DESC, word LIMIT 20))""",
    ]
    add(
        "route_requests", *full, *routed,
        body="""SELECT query_id, function, chat_id, seq, "user", date_time, message, message_type, score, method,
       NULL::BIGINT AS total_messages, NULL AS most_common_words FROM routed JOIN msg USING (chat_id, seq)
UNION ALL
SELECT query_id, 'get_stats', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       (SELECT count(*) FROM msg), (SELECT words FROM common) FROM q6""",
    )
    add(
        "route_errors", "x AS (SELECT 1)",
        body=f"""SELECT item_id::VARCHAR AS query_id, 'get_recent_messages' AS function, 'argument hours is not a number' AS kind
FROM benchmark WHERE item_id % 8 = 5
UNION ALL SELECT item_id::VARCHAR, 'best_search', 'unknown function' FROM benchmark WHERE item_id % 8 = 7
UNION ALL SELECT (item_id + {2 * SECOND})::VARCHAR, 'get_user_messages', 'not a pattern' FROM benchmark WHERE item_id % 3 = 0""",
    )
    unpacked = """SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chat_id, seq) - 1)::INTEGER AS pos,
       chat_id, seq, message, score, method FROM {0} JOIN msg USING (chat_id, seq)"""
    add(
        "pack_context", *full, BENCH, tfidf_hits("hit", "bench"),
        "shown AS (SELECT *, 'tfidf_optimized' AS method FROM hit)", body=unpacked.format("shown"),
    )
    add("route_context", *full, *routed, body=unpacked.format("routed"))
    return o
