"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from convolens.llm import (
    ann,
    centroids,
    decontaminate,
    embed_dedup,
    langid,
    mixing,
    packing,
    runs,
    secret_scan,
    sharding,
    simhash,
    token_counts,
    toxicity,
)
from convolens.llm.common import table

SHARDS = 40


def op1_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=100)


def op2_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = langid.held_out(F.col("doc_id"), 3, 1)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~out)
    model = toxicity.fit(docs.where(~out), labels, corpus=docs)
    scored = toxicity.score(docs, model, drop_text=True)
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.fit(docs.where(~out))
    named = langid.identify(docs.select("doc_id", "text"), model, drop_text=True)
    return named.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op5_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark, sf_dir):
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_curriculum_mix(spark, sf_dir):
    plan, _ = mixing.curriculum(table(spark, sf_dir, "documents"))
    columns = ["doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken"]
    times = [F.round(F.get("positions", F.lit(i)), 6).alias(f"position_{i + 1}") for i in range(2)]
    out = plan.select(*columns, *times)
    return out.repartitionByRange("position_1", "doc_id").sortWithinPartitions("position_1", "doc_id")


def op8_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_feistel_shards(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", size.alias("size"), F.crc32(text).alias("text_crc32")
    )
    dealt = sharding.shard_rows(docs, ["doc_id"], SHARDS)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digest(docs, secret_scan.dictionary(docs))


def repeated_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` where the tail of every tenth document, by crc32 of its id, is periodic.

    A word i from a on becomes word a + (i - a) % p of the text; a and p follow from the crc32.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g, n = F.floor(h / 10), F.size("words").cast("long")
    a = F.col("g") % n
    p = 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))
    chosen = docs.select("doc_id", "text", h.alias("h"), g.alias("g")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, words)
    )
    placed = chosen.withColumn("a", F.when(F.size("words") > 0, a)).withColumn("p", p)
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    moved = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("words", source(i).cast("int")))
    text = F.when(F.col("a").isNotNull(), F.array_join(moved, " ")).otherwise(F.col("text"))
    return placed.select("doc_id", text.alias("text"))


def op11_periodic_runs(spark, sf_dir):
    docs = repeated_documents(table(spark, sf_dir, "documents"))
    return runs.digests(runs.find_runs(docs, drop_text=True))


def op12_centroid_clusters(spark, sf_dir):
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return found.assignment.withColumnRenamed("id", "vec_id").join(F.broadcast(found.summary()), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op13_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find(docs, benchmark).digest().withColumnRenamed("doc", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_permutation_ann,
        op2_token_counts,
        op3_toxicity,
        op4_language_id,
        op5_best_fit_packing,
        op6_embedding_dedup,
        op7_curriculum_mix,
        op8_simhash_dedup,
        op9_feistel_shards,
        op10_secret_scan,
        op11_periodic_runs,
        op12_centroid_clusters,
        op13_decontamination,
    ]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def _position_sql(used: str, place: str) -> str:
    """The inverse of a schedule's running integral as a chain of conditions."""
    cases = []
    for i, rates in enumerate(mixing.SCHEDULES):
        steps = len(rates) - 1
        areas = [(a + b) / 2 / steps for a, b in zip(rates, rates[1:])]
        want, done = f"({used} * {sum(areas)!r})", 0.0
        for k, (a, b) in enumerate(zip(rates, rates[1:])):
            rest = f"greatest({want} - {done!r}, 0.0)"
            root = f"sqrt(greatest({a * a!r} + {2 * (b - a) * steps!r} * {rest}, 0.0))"
            time = f"{k / steps!r} + least(2 * {rest} / ({a!r} + {root}), {1 / steps!r})"
            done += areas[k]
            cases.append(f"WHEN {place} % {len(mixing.SCHEDULES)} = {i} AND {want} <= {done!r} THEN {time}")
    return f"CASE {' '.join(cases)} ELSE 1.0 END"


def curriculum_sql() -> str:
    order = "ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size"
    by_fill = "ORDER BY source_size / weight, place"
    return rf"""
    WITH d AS (
      SELECT doc_id, source,
             coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
      FROM documents
    ), s AS (
      SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
    ), p AS (
      SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s
    ), w AS (
      SELECT *, CASE place % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM p
    ), f AS (
      SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE)
               OVER ({by_fill} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER ({by_fill} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
      FROM w
    ), g AS (
      SELECT *, max(CASE WHEN lvl * weight <= 2 * source_size THEN lvl END) OVER () AS level FROM f
    ), t AS (
      SELECT source, source_size, place,
             coalesce(least(2.0::DOUBLE * source_size, level * weight), 2.0::DOUBLE * source_size) AS target
      FROM g
    ), q AS (
      SELECT doc_id, size, source_size, target, place,
             sum(size) OVER (PARTITION BY d.source {order} ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    ), c AS (
      SELECT *, source_size = 0 OR middle < target AS once,
             source_size > 0 AND source_size + middle < target AS twice,
             CASE WHEN target > 0 THEN middle / target ELSE 0.0 END AS used_1,
             CASE WHEN target > 0 THEN (source_size + middle) / target ELSE 0.0 END AS used_2
      FROM q
    )
    SELECT doc_id, size, source_size, round(target, 6) AS target,
           size * (once::INT + twice::INT) AS taken,
           CASE WHEN once THEN round({_position_sql("used_1", "place")}, 6) END AS position_1,
           CASE WHEN twice THEN round({_position_sql("used_2", "place")}, 6) END AS position_2
    FROM c
    """


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express; the others are tested against brute force."""
    return {
        "op7_curriculum_mix": curriculum_sql(),
        "op6_embedding_dedup": DEDUP_SQL,
        "op12_centroid_clusters": clusters_sql(),
        "op13_decontamination": DECONTAMINATION_SQL,
    }


def clusters_sql(k: int = centroids.K, rounds: int = centroids.ROUNDS) -> str:
    """All rounds written out; a centroid is a list like a vector."""
    n = centroids.DIMENSIONS
    steps = []
    for i in range(rounds + 1):
        far = "CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v.q, c.q)]) AS BIGINT)"
        steps.append(f"""
    a{i} AS MATERIALIZED (
      SELECT vec_id, arg_min(c, far * {k} + c) AS c, min(far) AS distance
      FROM (SELECT vec_id, c.c AS c, {far} AS far FROM v, c{i} c) GROUP BY vec_id
    ), c{i + 1} AS MATERIALIZED (
      SELECT c.c AS c, coalesce(m.q, c.q) AS q
      FROM c{i} c LEFT JOIN (
        SELECT c, list(CAST(floor(CAST(x AS DOUBLE) / n) AS BIGINT) ORDER BY d) AS q
        FROM (SELECT c, d, sum(q[d]) AS x, count(*) AS n
              FROM a{i} JOIN v USING (vec_id), range(1, {n + 1}) t(d) GROUP BY c, d)
        GROUP BY c
      ) m ON m.c = c.c
    )""")
    return f"""
    WITH v AS MATERIALIZED (
      SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
      FROM embeddings
      WHERE len(embedding) = {n} AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
    ), c0 AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), vec_id) - 1 AS c, q FROM v QUALIFY c < {k}
    ),{",".join(steps)}
    SELECT vec_id, CAST(c AS INT) AS cluster, distance,
           CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
           CAST(sum(distance) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} USING (c)
    """


_TOKENS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATION_SQL = f"""
WITH b AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_TOKENS} AS w FROM benchmark) WHERE len(w) > 0
), g AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)
), d AS MATERIALIZED (
  SELECT doc_id, {_TOKENS} AS w FROM documents
), s AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g))
), h AS MATERIALIZED (
  SELECT doc_id, i, s.n AS n, item_id FROM s JOIN g ON s.gram = g.gram AND s.n = g.n
), p AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

DEDUP_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), ok AS (
  SELECT * FROM v
  WHERE v IS NOT NULL AND len([x FOR x IN v IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([x FOR x IN v IF x != 0]) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id != b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), r(node, reach) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a
), c AS (
  SELECT node AS vec_id, min(reach) AS component_id FROM r GROUP BY node
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a
)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""
