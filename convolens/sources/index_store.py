"""Index tables on shared storage, kept in step with the messages chat by chat.

An index is a list of segments. A segment holds what follows from the messages of some chats alone:
texts, words, vectors and counts per word and user. A commit lists which chats
stand in which segment; a chat that is new or has changed goes into a new segment, and only its
messages are read for that. What depends on all chats (document frequencies, weights) is worked
out from the segments' clean texts when a version is opened; a version made of one whole segment, such as a
first build or a compacted one, has it stored as well.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import astuple, dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolens.functions.vectors import HASH_DIM
from convolens.operators import index
from convolens.operators.embed import Encoder, embed, hashed
from convolens.operators.search import SearchTables
from convolens.runtime import fits, stored
from convolens.schema import MESSAGE_SCHEMA

# Changes with the layout of the stored tables, so that older ones are not picked up.
FORMAT = 4


@dataclass(frozen=True)
class IndexOptions:
    """How an index is built. ``max_features=None`` keeps every term.

    A caller's encoder needs a name, which stands for it in the index's identity.
    """

    ngram_range: tuple[int, int] = index.NGRAMS
    min_df: int = index.MIN_DF
    max_df: float = index.MAX_DF
    max_features: int | None = index.MAX_FEATURES
    keep_marks: bool = False
    dim: int = HASH_DIM
    encoder_name: str | None = None
    encoder_factory: Callable[[], Encoder] | None = None

    def mark(self) -> str:
        if (self.encoder_factory is None) != (self.encoder_name is None):
            raise ValueError("give an encoder together with its name")
        plain = astuple(replace(self, encoder_factory=None))
        return hashlib.md5(repr((FORMAT, plain)).encode()).hexdigest()[:12]

    def vectors(self, texts: DataFrame, column: str) -> DataFrame:
        return embed(texts, column, self.encoder_factory, dim=self.dim)

    def root(self, path: str) -> str:
        return f"{path.rstrip('/')}/index/{self.mark()}"


DEFAULT = IndexOptions()
# One row per commit; ``build`` names the run that made it, so that rows of a run that stopped before
# its commit never count. ``whole`` says that the tables over all chats are stored with it.
COMMITS = "commit long, build string, fingerprint string, n long, whole boolean"
# The chats that a build puts into a segment, or takes out of the index (null segment).
CHATS = "chat_id string, fingerprint string, n long, texts long, segment string, build string, commit long"
# Sort columns of the tables that searches filter by their leading column: sorted files give row
# groups narrow min/max values, so a search for a few words decodes few of them. Postings and weights
# are sorted in runs (``index.rows_by_key``), for their pages.
SORTED = {
    "vocabulary": ["word"],
    "terms": ["term"],
}


def _marks() -> list:
    h = F.xxhash64(*MESSAGE_SCHEMA.fieldNames()).cast("decimal(38,0)")
    return [
        F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("fingerprint"),
        F.count(F.lit(1)).alias("n"),
        F.count("message").alias("texts"),
    ]


def fingerprint(messages: DataFrame) -> tuple[str, int]:
    """Order-independent fingerprint of the message table and its row count, in one aggregate."""
    row = messages.agg(*_marks()).first()
    return row["fingerprint"], row["n"]


def chat_marks(messages: DataFrame) -> DataFrame:
    """``(chat_id, fingerprint, n, texts)``, a row per chat."""
    return messages.groupBy("chat_id").agg(*_marks())


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the index, empty where nothing was built yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _same_chat(a: DataFrame, b: DataFrame):
    return a["chat_id"].eqNullSafe(b["chat_id"])


def _listed(spark: SparkSession, root: str, commit: int) -> DataFrame:
    """The rows of all builds up to a commit."""
    commits = _read(spark, f"{root}/commits", COMMITS).where(F.col("commit") <= commit)
    done = [r[0] for r in commits.select("build").collect()]  # a row per commit
    return _read(spark, f"{root}/chats", CHATS).where(F.col("build").isin(done))


def _chats_at(spark: SparkSession, root: str, commit: int) -> DataFrame:
    """The chats of a version, each with the segment that holds it."""
    last = F.max_by(F.struct("fingerprint", "n", "texts", "segment"), "commit")
    rows = _listed(spark, root, commit).groupBy("chat_id").agg(last.alias("s"))
    return rows.select("chat_id", "s.*").where("segment IS NOT NULL")


def _segments(spark: SparkSession, root: str, commit: int) -> tuple[dict[str, bool], DataFrame]:
    """Each segment of a version, and whether all of its chats are still current; and the chats."""
    chats = stored(_chats_at(spark, root, commit))
    live = dict(map(tuple, chats.groupBy("segment").count().collect()))  # a row per commit at most
    put = _listed(spark, root, commit).where("segment IS NOT NULL").groupBy("segment").count()
    size = dict(map(tuple, put.collect()))
    return {s: size[s] == n for s, n in sorted(live.items())}, chats


def build(
    messages: DataFrame, path: str, mark: tuple[str, int] | None = None, options: IndexOptions = DEFAULT
) -> str:
    """Bring the index below ``path`` in line with ``messages`` and return the version.

    Chats are compared by fingerprint with the last version; those that are new or have changed are
    written as one new segment, and those that are gone are taken out. The commit is written last,
    so a build that stopped half-way is never picked up. Two builds of one index at a time are not
    supported.
    """
    spark, root = messages.sparkSession, options.root(path)
    last = _read(spark, f"{root}/commits", COMMITS).agg(F.max("commit")).first()[0]
    commit, segment = (0 if last is None else last + 1), uuid.uuid4().hex[:12]
    now = stored(chat_marks(messages))
    gone, part, changed = None, messages, now
    if last is not None:
        before = _chats_at(spark, root, last)
        same = _same_chat(now, before) & (now["fingerprint"] == before["fingerprint"]) & (now["n"] == before["n"])
        changed = stored(now.join(before, same, "left_anti"))
        gone = before.join(now, _same_chat(before, now), "left_anti")
        few = F.broadcast(changed) if fits(changed) else changed
        part = messages.join(few, _same_chat(messages, few), "left_semi")
    n_changed = changed.count()
    if last is not None and not n_changed and gone.isEmpty():
        return f"{root}/v{last}"
    if n_changed or last is None:
        _write_segment(part, root, segment, options)
    whole = last is None or n_changed == now.count() > 0
    rows = changed.withColumn("segment", F.lit(segment))
    if gone is not None:
        rows = rows.unionByName(gone.withColumn("segment", F.lit(None).cast("string")))
    return _commit(spark, root, commit, segment, rows, mark or fingerprint(messages), whole, options)


def _commit(
    spark: SparkSession, root: str, commit: int, build: str, chats: DataFrame, mark: tuple[str, int], whole: bool, o: IndexOptions
) -> str:
    """List a commit; ``build`` also names its segment, ``whole`` says that this one has all chats."""
    added = [F.lit(build).alias("build"), F.lit(commit).cast("long").alias("commit")]
    chats.select("chat_id", "fingerprint", "n", "texts", "segment", *added).write.mode("append").parquet(f"{root}/chats")
    if whole:
        _write_whole(spark, root, build, commit, o)
    row = spark.createDataFrame([(commit, build, mark[0], mark[1], whole)], COMMITS)
    row.coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return f"{root}/v{commit}"


def _write_segment(messages: DataFrame, root: str, segment: str, o: IndexOptions) -> None:
    """Texts are cleaned once; the other tables come from those."""
    place = f"{root}/segments/{segment}"
    read = lambda name: messages.sparkSession.read.parquet(f"{place}/{name}")
    texts = index.indexable(messages, o.keep_marks)
    columns = ["chat_id", "seq", "user", "clean_text", F.length("message").alias("chars")]
    _write(texts.select(columns), place, "texts")
    _write(index.word_lists(read("texts")), place, "words")
    if o.encoder_factory is None:
        vectors = hashed(index.token_lists(read("texts")), o.dim)
    else:
        vectors = o.vectors(read("texts").select("chat_id", "seq", "clean_text"), "clean_text")
    _write(vectors.select("chat_id", "seq", "vector"), place, "vectors")
    _write_sums(messages.sparkSession, place)


def _write_sums(spark: SparkSession, place: str) -> None:
    """Postings and counts of a segment whose lists are written."""
    read = lambda name: spark.read.parquet(f"{place}/{name}")
    _write(index.rows_by_key(read("words"), word="keys"), place, "postings")
    _write(index.word_freq(read("postings")), place, "vocabulary")
    _write(index.profile_counts(read("texts")), place, "profiles")


def _write_whole(spark: SparkSession, root: str, segment: str, commit: int, o: IndexOptions) -> None:
    """The tables over all chats, of a version whose one segment has them all."""
    place, of = f"{root}/whole/{commit}", f"{root}/segments/{segment}"
    read = lambda name: spark.read.parquet(name)
    tokens = index.token_lists(read(f"{of}/texts"))
    _write(_terms(tokens, o), place, "terms")
    _write(index.weight_lists(tokens, read(f"{place}/terms"), o.ngram_range, o.max_features), place, "lists")
    rows = index.rows_by_key(read(f"{place}/lists"), term="keys", tf="tfs", weight="weights")
    _write(rows, place, "weights")


def _terms(tokens: DataFrame, o: IndexOptions) -> DataFrame:
    return index.vocabulary_of(tokens, tokens.count(), o.ngram_range, o.min_df, o.max_df, o.max_features)


def _write(df: DataFrame, place: str, name: str) -> None:
    if name in SORTED:
        df = df.sortWithinPartitions(*SORTED[name])
    df.write.mode("overwrite").parquet(f"{place}/{name}")


def find(
    messages: DataFrame,
    path: str,
    mark: tuple[str, int] | None = None,
    options: IndexOptions = DEFAULT,
) -> str | None:
    """The last version built from exactly these messages with these options, if there is one."""
    digest, n = mark or fingerprint(messages)
    root = options.root(path)
    commits = _read(messages.sparkSession, f"{root}/commits", COMMITS)
    found = commits.where((F.col("fingerprint") == digest) & (F.col("n") == n)).agg(F.max("commit")).first()[0]
    return None if found is None else f"{root}/v{found}"


def build_or_load(messages: DataFrame, path: str, options: IndexOptions = DEFAULT) -> SearchTables:
    """Open the index of these messages, bringing it in line where it is not.

    The fingerprint reads the messages once. ``load`` opens a known version without that.
    """
    mark = fingerprint(messages)
    version = find(messages, path, mark, options) or build(messages, path, mark, options)
    return load(messages, version, options)


class Version:
    """The tables of a version, put together from its segments."""

    def __init__(self, spark: SparkSession, version: str, options: IndexOptions):
        self.spark, self.options = spark, options
        self.root, commit = version.rsplit("/v", 1)
        self.commit = int(commit)
        self.segments, self.chats = _segments(spark, self.root, self.commit)
        row = _read(spark, f"{self.root}/commits", COMMITS).where(F.col("commit") == self.commit).first()
        if row is None:
            raise ValueError(f"no such version: {version}")
        self.whole, self.build = row["whole"], row["build"]

    def _segment(self, segment: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/segments/{segment}/{name}")

    def _current(self, segment: str, df: DataFrame) -> DataFrame:
        """The rows of chats that the segment still stands for."""
        if self.segments[segment]:
            return df
        chats = self.chats.where(F.col("segment") == segment).select("chat_id")
        return df.join(chats, _same_chat(df, chats), "left_semi")

    def _union(self, parts: list[DataFrame], name: str) -> DataFrame:
        if not parts:  # every chat is gone
            anywhere = _listed(self.spark, self.root, self.commit).where("segment IS NOT NULL").first()
            return self._segment(anywhere["segment"] if anywhere else self.build, name).limit(0)
        return reduce(DataFrame.unionByName, parts)

    def rows(self, name: str) -> DataFrame:
        """A table that has the chat in every row."""
        return self._union([self._current(s, self._segment(s, name)) for s in self.segments], name)

    def sums(self, name: str, again: Callable[[str], DataFrame], keys: list[str]) -> DataFrame:
        """A table of counts: summed over segments, counted again where chats have left one."""
        if len(self.segments) == 1 and all(self.segments.values()):
            return self._segment(next(iter(self.segments)), name)
        parts = [self._segment(s, name) if clean else again(s) for s, clean in self.segments.items()]
        both = self._union(parts, name)
        values = [c for c in both.columns if c not in keys]
        return stored(both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values]))

    def vocabulary(self) -> DataFrame:
        again = lambda s: index.word_freq(self._current(s, self._segment(s, "postings")))
        return self.sums("vocabulary", again, ["word"])

    def profiles(self) -> DataFrame:
        """``user_profile`` of the version's messages."""
        again = lambda s: index.profile_counts(self._current(s, self._segment(s, "texts")))
        return index.profiles_in(self.sums("profiles", again, ["user", "word"]))

    def terms(self) -> DataFrame:
        if self.whole:
            return self.spark.read.parquet(f"{self.root}/whole/{self.commit}/terms")
        return stored(_terms(index.token_lists(self.rows("texts")), self.options))

    def weights(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Weights with a row per message, and with a row per message and term."""
        if self.whole:
            place = f"{self.root}/whole/{self.commit}"
            return self.spark.read.parquet(f"{place}/lists"), self.spark.read.parquet(f"{place}/weights")
        o = self.options
        lists = index.weight_lists(index.token_lists(self.rows("texts")), terms, o.ngram_range, o.max_features)
        return lists, index.weights_in(lists)


def load(messages: DataFrame, version: str, options: IndexOptions = DEFAULT) -> SearchTables:
    """The search tables of a version.

    Weights depend on the document frequencies over all chats. Where they are not stored (a version
    of several segments) they are computed in the rows of every scan; ``compact`` stores them.
    """
    v = Version(messages.sparkSession, version, options)
    terms = v.terms()
    lists, weights = v.weights(terms)
    return SearchTables(
        messages=messages,
        postings=v.rows("postings"),
        vocabulary=v.vocabulary(),
        terms=terms,
        weights=weights,
        vectors=v.rows("vectors"),
        words=v.rows("words"),
        lists=lists,
        ngram_range=options.ngram_range,
        encode=options.vectors,
    )


def compact(spark: SparkSession, path: str, options: IndexOptions = DEFAULT) -> str | None:
    """Put the last version's segments together into one, with stored weights; its new name.

    No text is cleaned and no vector computed again. None where nothing was built.
    """
    root = options.root(path)
    last = _read(spark, f"{root}/commits", COMMITS).orderBy(F.desc("commit")).first()
    if last is None:
        return None
    old, segment = Version(spark, f"{root}/v{last['commit']}", options), uuid.uuid4().hex[:12]
    for name in ("texts", "words", "vectors"):
        _write(old.rows(name), f"{root}/segments/{segment}", name)
    _write_sums(spark, f"{root}/segments/{segment}")
    rows = old.chats.withColumn("segment", F.lit(segment))
    return _commit(spark, root, last["commit"] + 1, segment, rows, (last["fingerprint"], last["n"]), True, options)


def clear(spark: SparkSession, path: str) -> None:
    """Delete every index below ``path``, all options, versions and segments."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/index")
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def in_memory(messages: DataFrame, options: IndexOptions = DEFAULT) -> SearchTables:
    """The same tables as plans, for a one-off search."""
    o = options
    texts = index.indexable(messages, o.keep_marks)
    words, tokens = index.word_lists(texts), index.token_lists(texts)
    postings = index.postings_in(words)
    terms = _terms(tokens, o)
    lists = index.weight_lists(tokens, terms, o.ngram_range, o.max_features)
    return SearchTables(
        messages=messages,
        postings=postings,
        vocabulary=index.word_freq(postings),
        terms=terms,
        weights=index.weights_in(lists),
        vectors=o.vectors(texts, "clean_text").select("chat_id", "seq", "vector"),
        words=words,
        lists=lists,
        ngram_range=o.ngram_range,
        encode=o.vectors,
    )
