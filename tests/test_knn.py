import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import knn


@pytest.fixture(scope="module")
def tables(spark):
    """Clusters, ties, and a point that a third of the references share."""
    vector = F.array(
        *[F.when(F.col("id") % 3 == 0, F.lit(2.0)).otherwise((F.col("id") * f) % m / 3.0) for f, m in ((7, 31), (11, 17), (5, 13))]
    )
    references = spark.range(900).select(F.col("id").alias("ref"), vector.alias("vector"), (F.col("id") % 4).alias("value"))
    queries = spark.range(1000, 1200).select(F.col("id").alias("q"), vector.alias("vector"))
    return queries.cache(), references.cache()


def brute_force(queries, references, k):
    refs = sorted((r["ref"], r["vector"], r["value"]) for r in references.collect())
    ids = np.array([r[0] for r in refs])
    points = np.array([r[1] for r in refs])
    found = {}
    for row in queries.collect():
        gaps = np.round(np.sqrt(((points - np.array(row["vector"])) ** 2).sum(axis=1)), knn.DIGITS)
        found[row["q"]] = ids[np.lexsort((ids, gaps))[:k]].tolist()
    return found


@pytest.mark.parametrize(
    "settings", [{}, {"broadcast_cells": 0, "leaves": 8, "block_rows": 40}, {"broadcast_cells": 0, "leaves": 900}, {"broadcast_cells": 0, "leaves": 1, "block_rows": 5}]
)
def test_neighbours_are_exact(tables, settings):
    queries, references = tables
    found = knn.nearest(queries, references, 5, **settings).select("q", "neighbours.ref").collect()
    assert {r["q"]: r["ref"] for r in found} == brute_force(queries, references, 5)


def test_fewer_references_than_k(tables):
    queries, references = tables
    few = references.limit(3)
    for settings in ({}, {"broadcast_cells": 0}):
        found = knn.nearest(queries, few, 5, **settings).select(F.size("neighbours").alias("n")).distinct().collect()
        assert [r["n"] for r in found] == [3]


def test_far_branches_are_passed_over(spark):
    """Rows in well separated clusters meet the references of their own cluster only."""
    random = np.random.default_rng(3)
    centres = random.normal(size=(20, 4)) * 1000
    points = np.concatenate([c + random.normal(size=(60, 4)) for c in centres])
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "ref long, vector array<double>").withColumn("_c", F.lit(None))
    tree = knn.Tree.build(points[random.permutation(len(points))[:100]])
    cells = knn._cell_udf(rows, tree)
    placed = rows.withColumn("_c", cells(F.col("vector"))).cache()
    routes = knn._routes(placed, placed, tree, 3).collect()
    used = placed.select("_c.cell").distinct().count()
    assert len(routes) < 0.2 * used * used
    queries = rows.select(F.col("ref").alias("q"), "vector").where("q % 7 = 0")
    found = knn.nearest(queries, rows.select("ref", "vector", F.lit(1).alias("value")), 3, broadcast_cells=0, leaves=100).select("q", "neighbours.ref").collect()
    for r in found:
        gaps = np.round(np.sqrt(((points - points[r["q"]]) ** 2).sum(axis=1)), knn.DIGITS)
        assert r["ref"] == np.lexsort((np.arange(len(points)), gaps))[:3].tolist()


def test_votes(spark):
    rows = spark.sql(
        "SELECT transform(array(2D, 1D, 2D, 1D, 3D), v -> named_struct('distance', 0D, 'ref', 0L, 'value', v)) AS n"
    )
    found = rows.select(
        knn.majority(F.col("n")).alias("vote"), knn.mean_value(F.col("n")).alias("mean"), knn.vote_shares(F.col("n"), 4).alias("s")
    ).first()
    assert found["vote"] == 1.0 and found["mean"] == pytest.approx(1.8) and found["s"] == [0.0, 0.4, 0.4, 0.2]


def test_rows_are_not_copied_for_the_blocks_they_meet(spark, monkeypatch):
    """What is written grows with the rows, not with the pairs of blocks; the answer is that of a full search."""
    written = []
    write = knn.write_table

    def note(df, name):
        table = write(df, name)
        written.append((name, table.count()))
        return table

    monkeypatch.setattr(knn, "write_table", note)
    monkeypatch.setattr(knn, "PACKED_ROWS", 100)
    points = np.random.default_rng(8).normal(size=(1500, 12))
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "ref long, vector array<double>")
    queries = rows.where("ref < 400").withColumnRenamed("ref", "q")
    references = rows.where("ref >= 400").withColumn("value", F.col("ref") % 3)
    found = knn.nearest(queries, references, 4, broadcast_cells=0, leaves=8, block_rows=20).select("q", "neighbours.ref").collect()
    assert {r["q"]: r["ref"] for r in found} == brute_force(queries, references, 4)
    sizes = dict(written)
    assert sizes["queries"] == 400 and sizes["references"] == 1100 and "routes" not in sizes
    assert sizes["query-blocks"] <= 4 + 32 and sizes["reference-blocks"] <= 11 + 32


def test_queries_that_repeat_are_searched_once(tables, monkeypatch):
    queries, references = tables
    searched, search = [], knn._block_search
    monkeypatch.setattr(knn, "_block_search", lambda q, *rest: searched.append(q.count()) or search(q, *rest))
    many = queries.crossJoin(queries.sparkSession.range(4).withColumnRenamed("id", "copy"))
    found = knn.nearest(many, references, 5, broadcast_cells=0)
    assert found.columns == ["q", "vector", "copy", "neighbours"]
    rows = found.select("q", "copy", "neighbours.ref").collect()
    expected = brute_force(queries, references, 5)
    assert len(rows) == 800 and {(r["q"], r["copy"]) for r in rows} == {(q, c) for q in expected for c in range(4)}
    assert all(r["ref"] == expected[r["q"]] for r in rows)
    assert searched == [queries.select("vector").distinct().count()]
