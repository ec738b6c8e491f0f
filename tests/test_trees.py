"""Trees and running sums on awkward rows: rings, repeated keys, parents that are not there, empty tables."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.functions import numbers
from textloom.operators import checks, layout, trees
from textloom.plans import catalogue
from textloom.plans.ranking import global_row_number, running_sum


def nodes(spark, rows):
    return spark.createDataFrame(rows, "node long, parent long, v string")


def test_nearest_above(spark):
    rows = [(1, None, "a"), (2, 1, None), (3, 2, "c"), (4, 3, None), (5, 6, None), (6, 5, "x"), (7, 99, None), (2, 1, None), (8, 7, None)]
    got = dict(map(tuple, trees.nearest_above(nodes(spark, rows), "v").collect()))
    assert got == {1: "a", 2: "a", 3: "c", 4: "c", 7: None, 8: None}
    assert trees.nearest_above(nodes(spark, []), "v").collect() == []


def test_outline_with_a_ring(spark):
    rows = [(1, 2, 5), (2, None, 3), (3, None, None), (5, None, None), (8, None, 9), (9, None, 8)]
    got = {r["node"]: (r["depth"], r["path"]) for r in trees.outline(spark.createDataFrame(rows, "node long, first long, next long")).collect()}
    assert got == {1: (1, [0]), 5: (1, [1]), 2: (2, [0, 0]), 3: (2, [0, 1])}


def test_outline_order_with_gaps_in_the_keys(spark, tmp_path):
    keys = [k for k in range(1, 60) if k not in (3, 5, 14)] + list(range(1000, 1010))
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(c.execute(catalogue.ORACLES["outline_order"]).fetchall())
    assert len(want) < len(keys)
    assert sorted(map(tuple, catalogue.QUERIES["outline_order"](spark, str(tmp_path)).collect())) == want


def test_page_tree(spark):
    rows = [(1, None, "Pages", 2), (2, 1, "Page", None), (3, 1, "Page", None), (4, 1, "Odd", None), (5, 4, "Page", None), (6, 7, "Pages", 0), (7, 6, "Pages", 0)]
    got = sorted(map(tuple, trees.page_tree_issues(spark.createDataFrame(rows, "node long, parent long, kind string, count long")).collect()))
    assert got == [(1, "count"), (4, "kind"), (5, "parent"), (6, "ring"), (7, "ring")]


def test_running_sum_splits_a_group(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), "id", F.col("id").alias("v"))
    got = {r["id"]: r["s"] for r in running_sum(df, ["g"], ["id"], F.col("v"), "s", parts=7).collect()}
    assert all(got[i] == sum(range(i % 2, i + 1, 2)) for i in range(500))
    got = {r["id"]: r["n"] for r in global_row_number(df, F.desc("id"), name="n", parts=7).collect()}
    assert got == {i: 500 - i for i in range(500)}
    empty = running_sum(df.limit(0), ["g"], ["id"], F.col("v"), "s")
    assert empty.collect() == []


def test_exact_sum(spark):
    rows = [("a", 1e16), ("a", 1.0), ("a", -1e16), ("b", 0.1), ("b", 0.2), ("b", 0.3), ("c", None), ("d", float("inf")), ("e", 1e300), ("e", 1e-300), ("e", -1e300), ("f", 5e-324), ("f", 5e-324)]
    got = dict(map(tuple, numbers.exact_sum(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "s").collect()))
    assert got == {"a": 1.0, "b": 0.6, "c": 0.0, "d": float("inf"), "e": 1e-300, "f": 1e-323}


def test_simple_calculate_keeps_small_and_large_values(spark):
    df = spark.createDataFrame([("0.0000004",)] * 10, "t string")
    assert df.agg(numbers.simple_calculate("SUM", F.col("t"))).first()[0] == pytest.approx(0.000004)
    df = spark.createDataFrame([("1e25",), ("x",), ("1",)], "t string")
    assert df.agg(numbers.simple_calculate("SUM", F.col("t"))).first()[0] == pytest.approx(1e25)


def test_header_gaps_of_spans_and_irregular_tables(spark):
    schema = "table long, row int, col int, row_span int, col_span int, is_header boolean, scope string, id string, headers array<string>"
    cell = lambda t, r, c, h, rs=1, cs=1, scope=None, ids=None, i=None: (t, r, c, rs, cs, h, scope, i, ids)
    rows = [
        # a header over two columns
        cell(1, 0, 0, True, cs=2), cell(1, 1, 0, False), cell(1, 1, 1, False),
        # a data cell between the header and the last row
        cell(2, 0, 0, True, scope="Row"), cell(2, 1, 0, False), cell(2, 2, 0, True), cell(2, 3, 0, False),
        # one of two ids is unknown
        cell(3, 0, 0, True, scope="Row", i="a"), cell(3, 1, 0, False, ids=["a", "b"]), cell(3, 2, 0, True, i="c"),
        # irregular: a place is missing
        cell(4, 0, 0, False), cell(4, 0, 1, False), cell(4, 1, 0, False), cell(4, 1, 1, True, cs=2),
    ]
    got = {r["table"]: (r["row"], r["col"], r["unknown"]) for r in checks.header_gaps(spark.createDataFrame(rows, schema)).collect()}
    assert got == {2: (1, 0, []), 3: (1, 0, ["b"])}


def test_header_gaps_broadcasts_nothing(spark, capsys):
    cells = spark.range(9).selectExpr("id % 3 AS table", "0 AS row", "CAST(id / 3 AS INT) AS col", "1 AS row_span", "1 AS col_span", "id = 0 AS is_header", "CAST(NULL AS STRING) AS scope", "'h' AS id", "CAST(NULL AS ARRAY<STRING>) AS headers")
    checks.header_gaps(cells).explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_grid_cells():
    assert layout.grid_cells([[False, True]], [[], [], []]) == [(0, 0, 1, 2), (0, 2, 1, 1)]
    assert layout.grid_cells([[True], [True]], [[False], [True]]) == [(0, 0, 2, 1), (0, 1, 1, 1), (1, 1, 1, 1)]


def test_with_text(spark):
    df = spark.createDataFrame([(1, " \n"), (2, None), (3, "x")], "id long, text string")
    assert [r["id"] for r in checks.with_text(df).collect()] == [3]
    with pytest.raises(ValueError):
        checks.with_text(df.filter("id < 3"))
