"""Per-message text expressions. All of them are plain Columns: narrow and JVM-side."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.functions.arrays import let

# --- fixed values: character classes ------------------------------------------------------------
# White space as Python's str.strip() and str.split() see it.
SPACE = r"\s\p{Z}\x1c-\x1f\x85"
# Letters, numbers and underscore: a word character.
WORD = r"\p{L}\p{N}_"
# Code points that are an emoji on their own (Unicode emoji-data, digits and #* left out).
EMOJI_RANGES = (
    "A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 "
    "25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 "
    "262A 262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F "
    "2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 "
    "26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 "
    "2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 "
    "27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF "
    "1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 "
    "1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD "
    "1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 "
    "1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 "
    "1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7 1F6DC-1F6E5 1F6E9 "
    "1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF "
    "1FA70-1FA7C 1FA80-1FA89 1FA8F-1FAC6 1FACE-1FADC 1FADF-1FAE9 1FAF0-1FAF8"
).split()
# Short names that differ from the Unicode name, and those of common emojis.
EMOJI_ALIASES = {
    "ℹ": ":information:",
    "❤": ":red_heart:",
    "\U0001f389": ":party_popper:",
    "\U0001f44d": ":thumbs_up:",
    "\U0001f4af": ":hundred_points:",
    "\U0001f525": ":fire:",
    "\U0001f600": ":grinning_face:",
    "\U0001f602": ":face_with_tears_of_joy:",
    "\U0001f60d": ":smiling_face_with_heart-eyes:",
    "\U0001f621": ":enraged_face:",
    "\U0001f622": ":crying_face:",
    "\U0001f62d": ":loudly_crying_face:",
    "\U0001f64f": ":folded_hands:",
    "\U0001f914": ":thinking_face:",
}
# -------------------------------------------------------------------------------------------------

EMOJI_CLASS = "".join(
    "-".join(r"\x{%s}" % point for point in span.split("-")) for span in EMOJI_RANGES
)
# Letters of most scripts fail one of these few ranges and never meet the long list.
EMOJI_SPAN = r"\x{A9}\x{AE}\x{203C}-\x{3299}\x{1F004}-\x{1FAF8}"


def strip(col: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(col, f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(col: Column) -> Column:
    return ~col.rlike(f"[^{SPACE}]")


def normalize_body(col: Column) -> Column:
    return F.lower(strip(col))


def clean_text(col: Column, keep_marks: bool = False, emoji: str = "after") -> Column:
    """Lower-case words without links and symbols; null becomes ``""``.

    ``keep_marks`` also keeps combining marks, which scripts such as Tamil write vowels with.
    Emojis are named after cleaning, when only those that count as letters are left; ``before``
    names all of them first, so that their names stay as words.
    """
    if emoji not in ("after", "before"):
        raise ValueError("emoji is 'after' or 'before'")
    word = WORD + (r"\p{M}" if keep_marks else "")
    named = emoji_aliases(col) if emoji == "before" else col
    no_links = F.regexp_replace(F.lower(named), f"(http|www)[^{SPACE}]+", "")
    cleaned = F.coalesce(F.trim(F.regexp_replace(no_links, f"[^{word}]+", " ")), F.lit(""))
    for point, name in emoji_names().items():
        if point.isalnum():
            cleaned = F.replace(cleaned, F.lit(point), F.lit(name))
    return cleaned


def words(col: Column) -> Column:
    """White-space separated words."""
    return F.regexp_extract_all(col, F.lit(f"[^{SPACE}]+"), 0)


def word_count(col: Column) -> Column:
    return F.size(words(col))


def char_count(col: Column) -> Column:
    return F.length(col)


def caps_ratio(col: Column) -> Column:
    """Share of upper-case characters, 0 for an empty text."""
    caps = F.length(F.regexp_replace(col, r"[^\p{Lu}]", ""))
    return F.when(F.length(col) > 0, caps / F.length(col)).otherwise(F.lit(0.0))


def emojis(col: Column) -> Column:
    """Every emoji code point of the text, in order; sequences come apart."""
    return F.regexp_extract_all(col, F.lit(f"[{EMOJI_SPAN}&&[{EMOJI_CLASS}]]"), 0)


@lru_cache(maxsize=1)
def emoji_names() -> dict[str, str]:
    """Short names of all of ``EMOJI_RANGES``: the Unicode name between colons, lower-case with
    underscores, unless ``EMOJI_ALIASES`` has another one."""
    found = {}
    for span in EMOJI_RANGES:
        first, last = (int(x, 16) for x in (span.split("-") * 2)[:2])
        for point in map(chr, range(first, last + 1)):
            if name := unicodedata.name(point, ""):
                found[point] = f":{name.lower().replace(' ', '_')}:"
    return found | EMOJI_ALIASES


# Most rows of a caller's table of names; there are fewer emojis and sequences of them.
ALIAS_ROWS = 20_000


def alias_table(names: DataFrame) -> dict[str, str]:
    """A caller's ``(emoji, name)`` table as ``aliases`` of ``emoji_aliases``; rows with a null are left out.

    The names here are Unicode names, which differ from those of emoji libraries in many places; a
    library's table, sequences such as flags included, makes the texts equal to its own.
    """
    rows = names.select("emoji", "name").where("emoji != '' AND name IS NOT NULL").limit(ALIAS_ROWS + 1).collect()
    if len(rows) > ALIAS_ROWS:
        raise ValueError(f"a table of names has at most {ALIAS_ROWS} rows")
    return {r["emoji"]: r["name"] for r in sorted(rows, key=lambda r: (r["emoji"], r["name"]), reverse=True)}


def emoji_aliases(col: Column, aliases: dict[str, str] | None = None) -> Column:
    """Replace emojis by their short names; ``aliases`` adds to or overrides the table.

    An alias may be a sequence of code points; the longest one that fits is replaced. The text is
    cut into emojis and the stretches between them, so the look-up runs per emoji and not per
    character, and no join or regrouping is involved. Texts without any are not cut.
    """
    aliases = aliases or {}
    table = emoji_names() | aliases
    # Two literals instead of one per name keep the plan small.
    lookup = F.map_from_arrays(*[F.split(F.lit("\n".join(x)), "\n") for x in (table.keys(), table.values())])
    points = lambda key: "".join(r"\x{%X}" % ord(c) for c in key)
    keys = EMOJI_SPAN + "".join(sorted({points(k[0]) for k in aliases}))
    sequences = sorted((k for k in aliases if len(k) > 1), key=lambda k: (-len(k), k))
    longer = "".join(points(k) + "|" for k in sequences)
    pieces = F.regexp_extract_all(col, F.lit(f"{longer}[{keys}]|[^{keys}]+"), 0)
    named = F.transform(
        pieces,
        lambda p: F.when(p.rlike(f"^[{keys}]"), F.coalesce(F.try_element_at(lookup, p), p)).otherwise(p),
    )
    return F.when(col.rlike(f"[{keys}]"), F.array_join(named, "")).otherwise(col)


def tokens(col: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(col), F.lit(f"[{WORD}]{{2,}}"), 0)


def ngrams(toks: Column, low: int = 1, high: int = 3) -> Column:
    """Space-joined word n-grams for n = low..high, shortest first.

    Each length is built from the one before it by zipping with the shifted token list.
    """

    def longer(base: Column, grams: Column, n: int, found: list[Column]) -> Column:
        kept = [*found, grams] if n >= low else found
        if n == high:
            return F.concat(*kept) if len(kept) > 1 else kept[0]
        left = F.greatest(F.size(base) - n, F.lit(0))
        zipped = F.zip_with(
            F.slice(grams, F.lit(1), left),
            F.slice(base, F.lit(n + 1), left),
            lambda head, last: F.concat_ws(" ", head, last),
        )
        return let(zipped, lambda g: longer(base, g, n + 1, kept))

    return let(toks, lambda t: longer(t, t, 1, []))


def calendar(ts: Column) -> dict[str, Column]:
    """Date, hour, weekday name and midnight of a timestamp."""
    return {
        "date": F.to_date(ts),
        "hour": F.hour(ts),
        "weekday": F.date_format(F.to_date(ts), "EEEE"),
        "day": F.to_date(ts).cast("timestamp_ntz"),
    }
