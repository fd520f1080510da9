import pytest
from pyspark.sql import functions as F

from tabloom.functions.quantiles import exact_quantiles, order_statistics, quantiles_without
from tabloom.operators import profiling

NAN = float("nan")


@pytest.fixture(scope="module")
def edges(spark):
    """A constant, an all-null column, NaN beside null, and repeated rows."""
    rows = [(1.0, 7.0, None, "a"), (NAN, 7.0, None, None), (None, 7.0, None, None), (3.0, 7.0, None, "a"), (1.0, 7.0, None, "a")]
    return spark.createDataFrame(rows, "x double, c double, nothing double, s string")


def test_missing_and_duplicates(edges):
    assert [tuple(r) for r in profiling.missing_by_column(edges).collect()] == [("nothing", 5), ("x", 2), ("s", 2)]
    assert profiling.missing_cells(edges).first()[0] == 9
    # (1, 7, null, a) repeats, and NaN equals null
    assert profiling.duplicate_rows(edges).first()[0] == 2


def test_describe_edges(edges):
    rows = {r["column"]: r for r in profiling.describe_all(edges).collect()}
    assert rows["x"]["count"] == 3 and rows["x"]["p50"] == 1.0
    assert rows["c"]["std"] == 0.0
    assert rows["nothing"]["count"] == 0 and rows["nothing"]["mean"] is None and rows["nothing"]["p50"] is None
    assert (rows["s"]["top"], rows["s"]["freq"], rows["s"]["unique"]) == ("a", 3, 1)


def test_correlation_of_a_constant_is_null(edges):
    found = {(r[0], r[1]): r[2] for r in profiling.correlation_matrix(edges, ["x", "c"]).collect()}
    assert found["x", "x"] == pytest.approx(1.0) and found["x", "c"] is None


def test_correlations_equal_pairwise_aggregates(spark):
    df = spark.range(500).selectExpr(
        "CASE WHEN id % 7 = 0 THEN NULL ELSE cast(id % 31 AS double) END AS a",
        "CASE WHEN id % 3 = 0 THEN double('NaN') ELSE 1e6 + id * id % 17 END AS b",
        "cast(id % 5 AS long) AS c", "4D AS constant", "cast(NULL AS double) AS nothing",
    ).repartition(3)
    found = {(r[0], r[1]): r[2] for r in profiling.correlation_matrix(df, df.columns).collect()}
    assert len(found) == 25
    for (x, y), value in found.items():
        expected = df.agg(profiling._pair_correlation(x, y)).first()[0]
        assert value == (None if expected is None else pytest.approx(expected, abs=1e-9))


def test_histogram_holds_the_maximum(spark):
    df = spark.range(101).selectExpr("cast(id AS double) AS v").unionAll(spark.sql("SELECT cast(NULL AS double)"))
    bins = {r["bin"]: r["n"] for r in profiling.histogram(df, "v", 10).collect()}
    assert bins[9] == 11 and sum(bins.values()) == 101


def test_profile_has_every_table(edges):
    report = profiling.profile(edges, "x")
    assert {"summary", "describe", "missing", "duplicates", "target", "correlations", "top_categories"} <= set(report)
    assert profiling.profile(edges, "s")["target"].first()["target_value"] == "a"


def test_quantiles_equal_those_of_a_sort(spark):
    import numpy as np

    random = np.random.default_rng(5)
    special = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), 1.0, np.nextafter(1, 2), np.nextafter(1, 0)]
    columns = {
        "smooth": random.normal(size=4000) * 10.0 ** random.integers(-5, 5, 4000),
        "few": random.integers(0, 3, 4000).astype(float),
        "close": 1.0 + random.integers(0, 400, 4000) * np.finfo(float).eps,
        "odd": np.array(special * 363 + special[:7]),
        "hot": np.where(random.random(4000) < 0.4, 0.25, random.random(4000)),
    }
    rows = [tuple(None if i % 11 == 0 else float(c[i]) for c in columns.values()) for i in range(4000)]
    df = spark.createDataFrame([(*r, None, i % 4) for i, r in enumerate(rows)], ", ".join(f"{c} double" for c in [*columns, "nothing"]) + ", g int").repartition(5).cache()
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    kept = np.arange(4000) % 11 != 0
    values = {c: F.col(c) for c in df.columns if c != "g"}
    found = quantiles_without(df, values, probabilities, F.col("g"), [None, 0, 1, 2, 3])
    assert found[2, "nothing"] == [None] * 7
    for part in (None, 0, 1, 2, 3):
        for name, column in columns.items():
            own = np.sort(column[kept & (np.arange(4000) % 4 != (9 if part is None else part))])
            for p, value in zip(probabilities, found[part, name]):
                rank = p * (len(own) - 1)
                low, high = own[int(np.floor(rank))], own[int(np.ceil(rank))]
                expected = low if low == high else low + (high - low) * (rank - np.floor(rank))
                assert value == expected or np.isnan(value) and np.isnan(expected), (part, name, p)
    assert str(exact_quantiles(df, values, probabilities)) == str({n: found[None, n] for n in values})
    assert order_statistics(df, values, {"few": {0, 3635}})["few"] == {0: 0.0, 3635: 2.0}
