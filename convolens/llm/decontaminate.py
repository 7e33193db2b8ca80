"""Benchmark decontamination by a set of normalised test n-grams, in DataFrame functions alone.

1. Every window of ``WINDOW`` words of a benchmark item is a gram (an item of fewer words is one
   gram). Their 64-bit hashes form the set, which is broadcast when a count proves it small; beyond
   that both sides are shuffled on hash and salt.
2. One scan hashes every window of every document and looks it up. It stores a row per document
   and one per window found.
3. Documents with a window found are read once more and their windows compared as words with the
   grams, so an accidental equal hash never counts.
4. Windows that overlap make spans; documents or spans are taken out.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolens.llm.common import kept
from convolens.runtime import join_small

WINDOW = 10
# Words are runs of ASCII digits and letters and of everything beyond ASCII.
LETTERS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
PIECE = f"[^{LETTERS}]+|[{LETTERS}]+"
# Gram hashes that are broadcast, 16 bytes each with their table.
HASHES = 2_000_000


def words(text: Column) -> Column:
    """The words of a text, A to Z lower-cased and no other letter; a null text has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(f"[^{LETTERS}]+"), F.lit(0))


def _windows(tokens: Column, n: Column, make) -> Column:
    """``make(first place from 1, n)`` of every window of ``n`` words; none where there are fewer."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1))
    return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: make(i, n))


def _gram(tokens: Column, i: Column, n: Column) -> Column:
    return F.array_join(F.slice(tokens, i, n), " ")


def _hash(hashes: Column, i: Column, n: Column) -> Column:
    """The hash of a window from the hashes of its words."""
    return F.xxhash64(F.slice(hashes, i, n))


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def grams(benchmark: DataFrame, ids: str, text: str, window: int) -> DataFrame:
    """``(gram, n, hash, item)`` of the distinct windows of every item."""
    items = benchmark.select(F.col(ids).cast("string").alias("item"), words(F.col(text)).alias("w"))
    n = F.least(F.size("w"), F.lit(window))
    listed = items.where(F.size("w") > 0).select("item", "w", n.alias("n"), _hashes(F.col("w")).alias("h"))
    found = _windows(
        F.col("w"),
        F.col("n"),
        lambda i, n: F.struct(_gram(F.col("w"), i, n).alias("gram"), n.alias("n"), _hash(F.col("h"), i, n).alias("hash")),
    )
    return listed.select("item", F.inline(found)).distinct()


def _every(tokens: Column, lengths: list[int], make) -> Column:
    """``make`` of all windows of all lengths."""
    none = F.array().cast("array<int>")
    if not lengths:
        return F.transform(none, lambda i: make(i, i))
    return F.flatten(F.array(*[_windows(tokens, F.lit(n), make) for n in lengths]))


def _named(docs: DataFrame, ids: str, text: str) -> DataFrame:
    """``docs`` with ``_doc``, a hash of id and text: rows equal in both have the same result."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return docs.withColumn("_doc", F.md5(F.concat(part(ids), F.lit("\n"), part(text)).cast("binary")))


def _scan(docs: DataFrame, text: str, hashes: DataFrame, lengths: list[int]) -> DataFrame:
    """``(_doc, doc, n_words, at)``: a row per document with ``at`` 0, and one per window found."""
    tokens = docs.select("_doc", "doc", words(F.col(text)).alias("w"))
    hashed = tokens.select("_doc", "doc", F.size("w").alias("n_words"), _hashes(F.col("w")).alias("h"))
    window = lambda i, n: F.struct(i.alias("at"), _hash(F.col("h"), i, n).alias("hash"))
    own = F.array(F.struct(F.lit(0).alias("at"), F.lit(None).cast("long").alias("hash")))
    every = hashed.select("_doc", "doc", "n_words", F.inline(F.concat(own, _every(F.col("h"), lengths, window))))
    met = join_small(every, hashes.withColumn("found", F.lit(True)), ["hash"], ["_doc", "at"], HASHES, how="left")
    return met.where("at = 0 OR found").select("_doc", "doc", "n_words", "at")


def _verified(docs: DataFrame, text: str, known: DataFrame, lengths: list[int]) -> DataFrame:
    """``(_doc, start, end, gram_id)``: windows of documents that equal a gram word by word."""
    tokens = docs.select("_doc", words(F.col(text)).alias("w"))
    window = lambda i, n: F.struct(
        (i - 1).alias("start"), (i - 1 + n).alias("end"), _gram(F.col("w"), i, n).alias("gram")
    )
    every = tokens.select("_doc", F.inline(_every(F.col("w"), lengths, window)))
    return join_small(every, known, ["gram"], ["_doc", "start"]).select("_doc", "start", "end", "gram_id")


def merged(hits: DataFrame) -> DataFrame:
    """``(_doc, start, end)``: windows of a document that overlap or touch, as spans."""
    order = Window.partitionBy("_doc").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = hits.select("_doc", "start", "end").distinct().withColumn("reach", reach)
    fresh = F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0)
    spans = opens.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(order))
    return spans.groupBy("_doc", "span").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("span")


class Contamination:
    """What of ``docs`` stands in ``benchmark``.

    ``scanned`` has a row per row of ``docs``: ``(_doc, doc, n_words)``; ``hits`` the windows found,
    ``(_doc, start, end, gram_id)``; ``items`` the benchmark items of each gram, ``(gram_id, item)``.
    """

    def __init__(
        self,
        docs: DataFrame,
        benchmark: DataFrame,
        ids: str = "doc_id",
        text: str = "text",
        item_ids: str = "item_id",
        item_text: str = "text",
        window: int = WINDOW,
    ):
        self.docs = _named(docs, ids, text)
        self.text = text
        plain = self.docs.select("_doc", F.col(ids).alias("doc"), F.col(text))
        listed = kept(grams(benchmark, item_ids, item_text, window), "grams")
        lengths = sorted(r["n"] for r in listed.select("n").distinct().collect())  # at most ``window``
        known = kept(listed.select("gram", "hash").distinct().withColumn("gram_id", F.monotonically_increasing_id()), "known")
        self.items = join_small(listed.select("gram", "item"), known.select("gram", "gram_id"), ["gram"], ["item"])
        self.items = kept(self.items.where("item IS NOT NULL").select("gram_id", "item"), "items")
        both = kept(_scan(plain, text, known.select("hash").distinct(), lengths), "scanned")
        self.scanned = both.where("at = 0").select("_doc", "doc", "n_words")
        suspects = kept(both.where("at > 0").select("_doc").distinct(), "suspects")
        again = join_small(plain, suspects.withColumn("_in", F.lit(True)), ["_doc"], ["_doc"])
        self.hits = kept(_verified(again, text, known.select("gram", "gram_id"), lengths).distinct(), "hits")
        self.spans = kept(merged(self.hits), "spans")

    def digest(self) -> DataFrame:
        """``(doc, n_words, n_hit, n_items, items_sha256, contaminated)``, a row per row of ``docs``."""
        n_hit = self.spans.groupBy("_doc").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"))
        grams_met = self.hits.select("_doc", "gram_id").distinct()
        met = join_small(grams_met, self.items, ["gram_id"], ["_doc"]).select("_doc", "item").distinct()
        listed = met.groupBy("_doc").agg(F.array_sort(F.collect_list("item")).alias("items"))
        found = n_hit.join(listed, "_doc", "left").select(
            "_doc", "n_hit", F.size(F.coalesce("items", F.array().cast("array<string>"))).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.coalesce("items", F.array().cast("array<string>")), ",").cast("binary"), 256).alias("items_sha256"),
        )
        out = join_small(self.scanned, kept(found, "found"), ["_doc"], ["_doc"], how="left")
        zero = F.lit(0).cast("long")
        return out.select(
            "doc", F.col("n_words").cast("long").alias("n_words"),
            F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        )

    def without_documents(self) -> DataFrame:
        """The rows of ``docs`` that hold no window of the benchmark."""
        return self.docs.join(self.spans.select("_doc").distinct(), "_doc", "left_anti").drop("_doc")

    def without_spans(self) -> DataFrame:
        """``docs`` with hit words, and what stands between them, cut out of the texts."""
        spans = self.spans.groupBy("_doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))
        joined = self.docs.join(spans, "_doc", "left")
        pieces = F.regexp_extract_all(F.col(self.text), F.lit(PIECE), F.lit(0))
        # Words are every other piece; the first word is piece 1 or 2.
        first = F.when(F.col(self.text).rlike(f"^[^{LETTERS}]"), 1).otherwise(2)
        cut = joined.withColumn("_pieces", pieces).withColumn("_first", first)
        ends = F.transform("_spans", lambda s: F.col("_first") + 2 * s["end"] - 2)
        starts = F.transform("_spans", lambda s: F.col("_first") + 2 * s["start"])
        gaps = F.arrays_zip(
            F.concat(F.array(F.lit(0)), ends).alias("a"), F.concat(starts, F.array(F.size("_pieces") + 1)).alias("b")
        )
        rest = F.transform(gaps, lambda g: F.slice("_pieces", g["a"] + 1, g["b"] - g["a"] - 1))
        clean = F.when(F.col("_spans").isNull(), F.col(self.text)).otherwise(F.array_join(F.flatten(rest), ""))
        return cut.withColumn(self.text, clean).select(*[c for c in self.docs.columns if c != "_doc"])


def find(docs: DataFrame, benchmark: DataFrame, **names) -> Contamination:
    """Look for the windows of ``benchmark`` in ``docs``.

    A null text and a text without words hold nothing, a benchmark item without words has no
    window, and an item without id marks words but is not listed. Repeated items are one item,
    repeated documents are rows of their own with the same result, and a null document id is kept.
    Long texts are read whole. Without benchmark items nothing is contaminated; an empty document
    table gives an empty one. Other columns pass through the cleaned tables unread; columns called
    ``_doc``, ``_spans``, ``_pieces`` and ``_first`` are refused.
    """
    clash = {"_doc", "_spans", "_pieces", "_first"} & set(docs.columns)
    if clash:
        raise ValueError(f"reserved columns: {sorted(clash)}")
    return Contamination(docs, benchmark, **names)
