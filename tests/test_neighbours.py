"""Approximate neighbours and diverse selections against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import neighbours, retrieval
from quarry.plans import catalog


def vectors(spark, rows):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in enumerate(rows)], "chunk_id long, embedding array<float>")


def test_recall_on_the_given_vectors(spark):
    queries, rows = catalog._vectors(spark, "/root/testdata/sf0.01")
    exact = {(r.query_id, r.chunk_id): (r.score, r["rank"]) for r in retrieval.dense_search(queries, rows, 10).collect()}
    index = neighbours.HyperplaneIndex(rows, 64)
    found = {(r.query_id, r.chunk_id): (r.score, r["rank"]) for r in index.search(queries, 10).collect()}
    assert len(exact.keys() & found.keys()) >= 0.9 * len(exact)
    assert index.candidates(queries).count() < 0.95 * queries.count() * rows.count()


def test_clusters_are_found_among_few_candidates(spark):
    r = np.random.default_rng(0)
    centres = r.standard_normal((100, 64))
    rows = np.repeat(centres, 20, 0) + 0.05 * r.standard_normal((2000, 64))
    table = vectors(spark, [*(rows / np.linalg.norm(rows, axis=1)[:, None]), None])
    queries = table.where("chunk_id % 100 = 7").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec")).unionByName(spark.createDataFrame([(-1, None)], "query_id long, query_vec array<float>"))
    index = neighbours.HyperplaneIndex(table, 64, tables=8, bits=10)
    exact = {(x.query_id, x.chunk_id) for x in retrieval.dense_search(queries, table, 20).collect()}
    assert {(x.query_id, x.chunk_id) for x in index.search(queries, 20).collect()} == exact and len(exact) == 400
    assert index.candidates(queries).count() < 0.2 * 20 * 2000
    rebuilt = neighbours.HyperplaneIndex(table, 64, tables=8, bits=10)
    assert sorted(rebuilt.buckets.collect()) == sorted(index.buckets.collect())


@pytest.mark.parametrize("weight", [1.0, 0.5, 0.1])
def test_diverse_hits(spark, weight):
    r = np.random.default_rng(3)
    rows = [None if i == 5 else v / np.linalg.norm(v) for i, v in enumerate(r.standard_normal((30, 6)))]
    rows[8] = rows[9]
    table = vectors(spark, rows)
    hits = [(q, int(c), float(np.round(r.random(), 6)), k) for q in (1, 2) for k, c in enumerate(r.permutation(30)[:12], 1)]
    hits = [(q, c, s, k) for q in (1, 2) for k, (_, c, s, _) in enumerate(sorted((h for h in hits if h[0] == q), key=lambda h: -h[2]), 1)]
    got = neighbours.diverse(spark.createDataFrame(hits, "query_id long, chunk_id long, score double, rank long"), table, 6, weight).collect()
    vec = lambda c: np.zeros(6) if rows[c] is None else np.float32(rows[c]).astype(float)
    for q in (1, 2):
        own, chosen = [h for h in hits if h[0] == q], []
        while len(chosen) < 6:
            left = [h for h in own if h not in chosen]
            value = lambda h: round(weight * h[2] - ((1 - weight) * max(round(float(vec(h[1]) @ vec(x[1])), 6) for x in chosen) if chosen else 0), 6)
            chosen.append(min(left, key=lambda h: (-value(h), h[3])))
        assert [(x.chunk_id, x["rank"], x.former) for x in sorted(got, key=lambda x: x["rank"]) if x.query_id == q] == [(c, i, k) for i, (_, c, _, k) in enumerate(chosen, 1)]
