"""Secret scans by dictionary-primed zstandard novelty.

Fixed patterns find the known kinds of secrets. For the rest, each string of identifier characters in a
sensitive context (a word like ``key`` or ``auth`` near it, on either side) is a candidate. Its novelty is
what it adds to the compressed size of its surroundings, given a dictionary of the corpus' frequent
identifiers: text that follows from context or dictionary adds next to nothing, a random string adds
nearly its entropy. Candidates that add more than ``RATIO`` bytes per character are reported.

Shorter strings and strings with other signs, as passwords are, become candidates where they mix
digits and letters of both cases. A word of 8 letters that nobody wrote before adds as many bytes as a
key of 8 letters, so the size alone cannot tell those; and such strings must add more (``RATIO_MIXED``),
as a few bytes of coding weigh more in them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.llm.common import slices

# --- fixed values: kinds in the order that breaks ties, and their patterns ------------------------
ASSIGN = re.compile(
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
    r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")
# ---------------------------------------------------------------------------------------------------
SHORTEST = {"assign": 8, "access": 16}
# A candidate: a run of identifier characters, long enough to be a key.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
# A candidate of mixed signs: printable ASCII up to a blank, quote, bracket or separator.
MIXED = re.compile(r"[!#-&*+\-./0-9?@A-Z\\^_a-z|~]{8,}")
MIXES = re.compile(r"(?=.*[a-z])(?=.*[A-Z]).*[0-9]")
# Looked for at every place, as such words may overlap.
SENSITIVE = re.compile(r"(?i)(?=(pass|secret|token|key|auth|cred|bearer|private|signature|session|cookie|akia))")
AROUND = 160
RATIO = 0.55
RATIO_MIXED = 0.85
DICTIONARY = 32_768
LEVEL = 3


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed patterns: leftmost matches of each, too short ones dropped."""
    found = []
    if "=" in text or ":" in text:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST["assign"]]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= SHORTEST["access"]]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


class Novelty:
    """Marginal compressed size of a string in its surroundings."""

    def __init__(self, dictionary: bytes):
        content = dictionary or b" " * 8
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(
            dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False
        )

    def added(self, before: str, candidate: str, after: str) -> int:
        around = (before + after).encode(errors="replace")
        whole = (before + after + candidate).encode(errors="replace")
        return len(self.compressor.compress(whole)) - len(self.compressor.compress(around))

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        candidates = [(*m.span(), RATIO) for m in CANDIDATE.finditer(text)]
        mixed = [(m.start(), m.start() + len(m[0].rstrip(".!?")), RATIO_MIXED) for m in MIXED.finditer(text) if MIXES.match(m[0])]
        mixed = [c for c in mixed if c[1] - c[0] >= 8]
        words = [m.span(1) for m in SENSITIVE.finditer(text)] if candidates or mixed else []
        if not words:
            return []
        starts = [w[0] for w in words]
        plain, wide = ([(a, b, "novel") for a, b, ratio in c if self._novel(text, a, b, ratio, words, starts)] for c in (candidates, mixed))
        return sorted(wide + _beyond(plain, wide))

    def _novel(self, text: str, start: int, end: int, ratio: float, words: list[tuple[int, int]], starts: list[int]) -> bool:
        near = words[bisect_left(starts, start - AROUND) : bisect_left(starts, end + AROUND)]
        # A word counts where it lies wholly before or after the candidate, in what is compressed.
        if not any(b <= start or (a >= end and b <= end + AROUND) for a, b in near):
            return False
        before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
        return self.added(before, text[start:end], after) > ratio * (end - start)


def shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def identifier_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)``: documents of the whole corpus that hold each candidate-shaped string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                total.update(set(CANDIDATE.findall(text or "")))
                if len(total) > 200_000:
                    yield _counted(total)
                    total.clear()
        yield _counted(total)

    parts = docs.select("text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(total: Counter) -> pa.RecordBatch:
    kinds = [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(kinds, ["word", "n"])


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> bytes:
    """The most frequent identifiers of the corpus up to ``size`` bytes, most frequent last.

    Strings with a digit stay out: a secret that was copied many times must not become familiar.
    """
    plain = identifier_counts(docs).where((F.col("n") > 1) & ~F.col("word").rlike("[0-9]"))
    best = plain.where(F.length("word") <= 64).orderBy(F.desc("n"), "word").limit(size // 12).collect()
    return " ".join(reversed([r["word"] for r in best])).encode()[-size:]


def scan(docs: DataFrame, primer: bytes) -> DataFrame:
    """Add ``found``, an array of ``(start, end, kind)`` in code points, to documents with ``text``.

    Spans are ordered by start, then kind; end is exclusive. Null and empty texts have none. A
    candidate inside base spans is not reported twice; one that reaches beyond them is. Columns of that name are replaced.
    """
    plain = docs.drop("found")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    cell = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(primer)
        for batch in slices(batches):
            rows = [
                [{"start": a, "end": b, "kind": k} for a, b, k in all_spans(novelty, t or "")]
                for t in batch.column("text").to_pylist()
            ]
            yield batch.append_column("found", pa.array(rows, cell))

    return plain.mapInArrow(run, f"{fields}, found array<struct<start: long, end: long, kind: string>>")


def all_spans(novelty: Novelty, text: str) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    new = _beyond(novelty.spans(text), base)
    return sorted(base + new, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _beyond(spans: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans that ``base``, which is in order of start, does not cover wholly."""
    joined: list[list[int]] = []  # base spans that overlap or touch are one
    for start, end, _ in base:
        if joined and start <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    starts = [j[0] for j in joined]
    return [s for s in spans if not (i := bisect_right(starts, s[0])) or joined[i - 1][1] < s[1]]


def digest(docs: DataFrame, primer: bytes) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of documents ``(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for cell in batch.column("found").to_pylist():
                spans = [(s["start"], s["end"], s["kind"]) for s in cell]
                base = [s for s in spans if s[2] != "novel"]
                for kind in ("assign", "access", "hex"):
                    columns[f"n_{kind}"].append(sum(s[2] == kind for s in base))
                columns["base_sha256"].append(hashlib.sha256(shown(base).encode()).hexdigest())
                columns["spans"].append(shown(spans))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | columns)

    found = scan(docs.select("doc_id", "text"), primer).select("doc_id", "found")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redact(docs: DataFrame, primer: bytes, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; overlapping spans are one."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(primer)
        for batch in slices(batches):
            texts = [None if t is None else _without(t, all_spans(novelty, t), mark) for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(run, fields)


def _without(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    out, done = [], 0
    for start, end, _ in spans:
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]])
