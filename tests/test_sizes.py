"""Registered queries on tables larger than those of the tests, or with keys that only larger ones hold."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession

from quadra.operators import search
from quadra.plans import cql
from quadra.queries import ORACLES, QUERIES
from quadra.queries import search as queries
from quadra.sources import exchange


def test_in_keys_of_larger_tables(spark: SparkSession, tmp_path) -> None:
    """Orders that only larger tables hold are not among the keys searched for."""
    spark.range(10).union(spark.range(900_000, 900_001)).selectExpr("id AS o_orderkey", "id * 7 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = QUERIES["cql_in_pk"](spark, str(tmp_path)).select("o_orderkey", "o_custkey").collect()
    assert sorted(map(tuple, got)) == sorted(duck.sql(ORACLES["cql_in_pk"]).fetchall()) == [(3, 21), (5, 35), (8, 56)]


def test_text_index_of_chunks(spark: SparkSession, tmp_path, monkeypatch) -> None:
    """Texts are analysed once and counted where they lie: a term has a block a chunk, whatever its postings."""
    rows = [(i, f"oak elm oak w{i} " + "ash " * (i % 3)) for i in range(300)] + [(300, None), (301, "")]
    d = spark.createDataFrame(rows, "id long, t string").coalesce(1)
    plain, stored = search.TextIndex(d, "id", "t"), search.StoredTextIndex.build(d, "id", "t", f"{tmp_path}/ix", partitions=3)
    blocks = spark.read.parquet(f"{tmp_path}/ix/counted")
    assert blocks.where("term = 'oak'").count() == 1 and stored.postings.where("term = 'oak'").count() == 300
    for q in ("oak", "ash OR w7", "ash AND elm", "NOT ash", "w1*", "absent"):
        both = [{r["doc"]: r["score"] for r in ix.match(q).collect()} for ix in (plain, stored)]
        assert both[1] == pytest.approx(both[0]), q
    # a chunk ends within a batch, and one text may be longer than a chunk
    batch = pa.RecordBatch.from_arrays([pa.array([4, 5, 6, 7]), pa.array([["a", "b", "a"], [], ["b"] * 9, ["a"]])], names=["doc", "terms"])
    monkeypatch.setattr(search, "CHUNK_TOKENS", 4)
    got = [x for b in search._postings(iter([batch])) for x in b.to_pylist()]
    posts = sorted((r["term"], *p) for r in got if r["term"] for p in zip(r["doc"], r["tf"], r["dl"], strict=True))
    assert posts == [("a", 4, 2, 3), ("a", 7, 1, 1), ("b", 4, 1, 3), ("b", 6, 9, 9)]
    assert sorted(p for r in got if r["term"] is None for p in zip(r["doc"], r["dl"], strict=True)) == [(4, 3), (5, 0), (6, 9), (7, 1)]


def test_sketch_beside_distinct_count(spark: SparkSession) -> None:
    """A sketch is held once a task, not once for every distinct value counted beside it; columns stay in their order."""
    t = cql.Table(spark.range(3000).selectExpr("id", "id % 700 AS k"), ["id"])
    got = cql.select({"t": t}, "SELECT COUNT(ESTIMATE_DISTINCT id) AS e, COUNT(DISTINCT k) AS n, MAX(id), COUNT(ESTIMATE_DISTINCT k) FROM t")
    assert got.columns == ["e", "n", "max(id)", "estimate_distinct(k)"]
    e, n, top, k = got.first()
    assert (n, top) == (700, 2999) and abs(e - 3000) < 300 and abs(k - 700) < 70
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate" in x and "approx_count_distinct" in x and "count(" in x]
    # nor grouped by what is counted
    spark_plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in spark_plan.splitlines() if "approx_count_distinct" in x and "keys=[k" in x]


def test_pages_stay_in_tasks(spark: SparkSession, tmp_path, monkeypatch) -> None:
    """Pages are put back without passing through the driver, whole; too large a page is refused."""
    t = cql.Table(spark.range(5000, numPartitions=3).selectExpr("id", "id * 2 AS twice"), ["id"])
    pages = exchange.paged({"t": t}, "SELECT * FROM t")
    assert pages.count() == 6 and sorted(map(tuple, exchange.unpaged(pages, t.df.schema).collect())) == [(i, 2 * i) for i in range(5000)]
    with pytest.raises(Exception, match="a page of 1024 rows"):
        exchange.unpaged(pages, t.df.schema, 1000).count()
    spark.range(3000).selectExpr("id AS o_orderkey", "id * 7 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(type(t.df), "toLocalIterator", lambda *_: pytest.fail("rows on the driver"))
    got = QUERIES["exchange_pages"](spark, str(tmp_path))
    assert sorted(map(tuple, got.select("o_orderkey", "o_custkey").collect())) == [(i, 7 * i) for i in range(3000)]


def test_blocks_of_vectors(monkeypatch) -> None:
    """Products leave out no row that measuring every one would give: ties by id, copies, NaN, rows of other lists."""
    rng = np.random.default_rng(5)
    w = np.round(rng.normal(size=(500, 6)), 1) + 1000
    w[100:300], w[7, 2] = w[0], np.nan
    ids, asked = rng.permutation(500), w[[0, 3, 50, 400]]
    for probed in (None, rng.random((4, 500)) < 0.4):
        for k in (1, 10, 250, 900):
            got = search._least_of_block(w, w, ids, asked, probed, k, 6)
            for i, x in enumerate(asked):
                some = np.arange(500) if probed is None else np.flatnonzero(probed[i])
                d = np.round(np.sqrt(((w[some] - x) ** 2).sum(1)), 6)
                best = np.lexsort((ids[some], d))[:k]
                assert got[i][1].tolist() == ids[some][best].tolist() and np.array_equal(got[i][2], d[best], equal_nan=True)


def test_exact_nearest_is_found_once(spark: SparkSession, tmp_path, monkeypatch) -> None:
    """The five kinds of index are held against one exact search."""
    rng = np.random.default_rng(6)
    spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(200)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    calls, once = [], queries.nearest
    monkeypatch.setattr(queries, "nearest", lambda *a: calls.append(a) or once(*a))
    assert queries.vec_ivf_recall(spark, str(tmp_path)).count() == 5 and len(calls) == 1
