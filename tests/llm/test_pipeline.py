"""The pipeline's stages on a small table, and the registered queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
import corpus_pipeline
from convolens.llm import common, simhash

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = [
        (9001, "password=abcdefgh1 and more words to read here", "en", "src1", 5),
        (9002, None, "en", None, None),
        (9003, "", None, "src2", 0),
        (9003, "", None, "src2", 0),
    ]
    return base.unionByName(spark.createDataFrame(extra, base.schema))


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_take_and_give_documents(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_dedup", "secret_scan", "source_mix", "best_fit_packing",
    ]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_any_column_passes_through(spark, docs):
    names = ["score", "predicted", "_toxic", "_body", "row", "fp", "_mix_id", "_mix_hash", "_mix_position", "positions"]
    more = docs.select("*", *[(F.col("doc_id") * 10 + i).alias(n) for i, n in enumerate(names)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, SF_DIR)
        assert out.columns == more.columns
        wrong = out.where(" OR ".join(f"{n} != doc_id * 10 + {i}" for i, n in enumerate(names)))
        assert out.count() > 100 and wrong.count() == 0


def test_repeated_ids_of_different_texts(spark):
    a, b = "one two three four five six seven", "some wholly other words that are not like those"
    df = spark.createDataFrame([(3, a), (5, b), (5, a), (5, b), (None, a)], "doc_id long, text string")
    left = corpus_pipeline.remove_near_duplicates(spark, df, SF_DIR)
    assert sorted(map(tuple, left.collect()), key=repr) == [(3, a), (5, b), (None, a)]


def test_packing_takes_odd_documents(spark, docs):
    out = corpus_pipeline.pack_sequences(spark, docs, SF_DIR)
    assert {9001, 9002, 9003} <= {r.doc_id for r in out.collect()}
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), SF_DIR).count() == 0


def test_sequences_follow_the_curriculum(spark, docs, tmp_path):
    mixed = corpus_pipeline.mix_sources(spark, docs, SF_DIR)
    mixed.write.parquet(str(tmp_path / "mixed"))
    again = spark.read.parquet(str(tmp_path / "mixed"))
    want = [(r.doc_id, r.text) for r in mixed.collect()]
    got = [(r.doc_id, r.text) for r in common.read_in_order(again, "at").orderBy("at").collect()]
    assert got == want
    out = corpus_pipeline.pack_sequences(spark, again, SF_DIR)
    means = {}
    for r in out.collect():
        means.setdefault((r.sequence_order, r.sequence_id), []).append((r.position * r.length, r.length))
    order = [sum(p for p, _ in means[k]) / sum(n for _, n in means[k]) for k in sorted(means)]
    assert order == sorted(order) and [k[0] for k in sorted(means)] == list(range(len(means)))
    assert out.count() == corpus_pipeline.pack_sequences(spark, mixed, SF_DIR).where("position IS NULL").count()


def test_toxic_documents_go(spark, docs):
    text = "the of and in to idiot moron scum stupid the of"
    more = docs.unionByName(spark.createDataFrame([(9100, text, "en", "s", 1)], docs.schema))
    big = "/root/testdata/sf0.01"
    train = spark.read.parquet(f"{big}/documents.parquet").unionByName(more.where("doc_id > 9000"))
    left = ids(corpus_pipeline.remove_toxic(spark, train, big))
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    assert 9100 not in left and {9001, 9002, 9003} <= set(left)
    clean = [i for i, t in labels.items() if t == 0]
    assert np.mean([i in set(left) for i in clean]) >= 0.97


def test_one_of_each_group_stays(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in rows}
    comp = {i: i for i in prints}
    for _ in range(20):
        for a in comp:
            comp[a] = min(comp[b] for b in comp if (prints[a] ^ prints[b]).bit_count() <= 4)
    assert ids(corpus_pipeline.remove_near_duplicates(spark, docs, SF_DIR)) == sorted({min(comp[a], a) for a in comp} & set(comp.values()))


def test_secrets_are_masked(spark, docs):
    out = {r.doc_id: r for r in corpus_pipeline.redact_secrets(spark, docs, SF_DIR).collect()}
    assert out[9001].text == "[SECRET] and more words to read here" and out[9001].n_chars == len(out[9001].text)
    assert out[9002].text is None and out[9002].n_chars is None
    assert len(out) == docs.select("doc_id").distinct().count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    total = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert total.where("n != end OR n > 4096").count() == 0 and out.count() > 100


def test_registered():
    found = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in found] == list(range(1, 14))
    assert "pipeline" in entry.queries() and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", ["op6_embedding_dedup", "op7_curriculum_mix", "op12_centroid_clusters", "op13_decontamination"])
def test_query_matches_sql(spark, name):
    out = check.compare(spark, check.database(SF_DIR), name, SF_DIR)
    assert out.startswith("ok"), out
