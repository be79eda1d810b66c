"""Sources, contracts, streams and the query catalog."""

import math
import os
import sys

import pytest
from pyspark.sql import functions as F

from gridkin.functions.targets import TargetSpec
from gridkin.operators import constraints as R
from gridkin.plans import catalog
from gridkin.sources import tables as S
from gridkin.streaming import arrivals as Y


def test_matrix_and_units(spark):
    wide = spark.createDataFrame([("a", 0.0, 1.0, None), ("b", 1.0, 0.0, 3.0), ("c", None, 3.0, 0.0)], "site string, a double, b double, c double")
    long = S.matrix_observations(wide, "site", region="r")
    got = {(r.left, r.right): (r.left_ord, r.right_ord, r.value) for r in long.collect()}
    assert len(got) == 9 and got["b", "c"] == (1, 2, 3.0) and math.isnan(got["a", "c"][2])
    pairs = long.where("left_ord < right_ord and not isnan(value)")
    assert [(r.unit, r.unit_ord) for r in S.units_of_pairs(pairs).orderBy("unit_ord").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    R.check(R.matrix_rules(long))
    crooked = long.withColumn("value", F.when((F.col("left") == "a") & (F.col("right") == "b"), 9.0).otherwise(F.col("value")))
    with pytest.raises(R.ContractError, match="symmetric"):
        R.check(R.matrix_rules(crooked))


def test_points_and_classes(spark):
    ticks = spark.createDataFrame([("r", d, i, 5.0 + 10 * i) for d in ("row", "column") for i in range(4)], "region string, dim string, idx int, center double")
    points = spark.createDataFrame([("r", None, "u", 0, 12.0, 31.0)], "region string, species string, unit string, unit_ord int, x double, y double")
    assert [(r.row, r.col) for r in S.located_units(points, ticks).collect()] == [(3, 1)]
    with pytest.raises(Exception, match="unit outside the raster: r u"):
        S.located_units(points.withColumn("x", F.lit(900.0)), ticks).collect()
    pixels = spark.createDataFrame([("r", r, c, (r + c) % 3) for r in range(5) for c in range(9)], "region string, row int, col int, value int")
    cells = S.class_shares(pixels, {"zero": [0], "rest": [1, 2]}, 2, 2).collect()
    assert len(cells) == 8 and all(sum(r.features) == pytest.approx(1) for r in cells)


def test_csv(spark, tmp_path):
    (tmp_path / "sites.csv").write_text("site,x,y\nb,1,2\na,3,4\n")
    (tmp_path / "fst.csv").write_text("site,a,b\na,0,0.2\nb,0.2,0\n")
    assert [(r.unit, r.x) for r in S.read_sites(spark, str(tmp_path / "sites.csv"), "r").orderBy("unit_ord").collect()] == [("a", 3.0), ("b", 1.0)]
    assert S.read_matrix(spark, str(tmp_path / "fst.csv"), "r").where("left = 'a' and right = 'b'").first().value == 0.2


def test_contracts(spark):
    regions = spark.createDataFrame([("r", 1, 2)], "region string, n_rows int, n_cols int")
    cells = spark.createDataFrame([("r", 0, 0, [1.0]), ("r", 0, 1, [2.0])], "region string, row int, col int, features array<double>")
    units = spark.createDataFrame([("r", None, "a", 0, 0, 0), ("r", None, "b", 1, 0, 1)], "region string, species string, unit string, unit_ord int, row int, col int")
    obs = spark.createDataFrame([("r", None, "a", "b", 0.5)], "region string, species string, left string, right string, value double")
    R.check(R.cell_rules(cells, regions, 1) + R.unit_rules(units, regions) + R.observation_rules(obs, units))
    bad = [
        (R.cell_rules(cells.limit(1), regions, 1), "complete"), (R.cell_rules(cells.withColumn("features", F.array(F.lit(float("nan")))), regions, 1), "finite"),
        (R.unit_rules(units.withColumn("col", F.lit(7)), regions), "in the raster"), (R.unit_rules(units.withColumn("unit", F.lit("a")), regions), "unique"),
        (R.observation_rules(obs.union(obs), units), "once"), (R.observation_rules(obs.withColumn("right", F.lit("z")), units), "exist"),
        (R.observation_rules(obs.withColumn("value", F.lit(float("inf"))), units), "finite"),
    ]
    for rules, text in bad:
        with pytest.raises(R.ContractError, match=text):
            R.check(rules)


def test_stream(spark, tmp_path):
    rows = [("r", None, "a", "b", 0.5, 1), ("r", None, "b", "a", 0.7, 2), ("r", None, "a", "a", 0.1, 3), ("r", None, "a", "c", 1.5, 4)]
    schema = "region string, species string, left string, right string, value double, s int"
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    odds = TargetSpec("x", transform="odds")
    for name, df in (("ok", Y.accepted(stream, odds)), ("no", Y.rejected(stream, odds))):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        q.stop()
    assert spark.table("ok").count() == 1 and sorted(r.s for r in spark.table("no").collect()) == [3, 4]
    assert Y.running_moments(spark.read.parquet(path)).first().pairs == 4


def test_catalog(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    queries, sql = catalog.queries(), catalog.oracle_sql()
    assert set(sql) <= set(queries)
    for name in ("q_units", "q_snap_points_descending", "q_loglinear_conductance", "q_resistance_foster", "q_log1p_loss_by_region", "q_mlpe_nll", "q_as_matrix"):
        df = queries[name](spark, sf)
        cols = sorted(df.columns)
        got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
        res = con.execute(sql[name])
        at = [[d[0] for d in res.description].index(c) for c in cols]
        assert got == sorted(repr(tuple(r[i] for i in at)) for r in res.fetchall()), name


def test_entry_imports_without_the_corpus_subpackage(monkeypatch):
    sys.modules.pop("__spark_entry__", None)
    monkeypatch.setitem(sys.modules, "gridkin.llm.entry", None)
    monkeypatch.setitem(sys.modules, "gridkin.llm", None)
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert names and not any(n.startswith("op") or n == "pipeline" for n in names)
    sys.modules.pop("__spark_entry__", None)


def test_chains_and_scatter_are_whole(spark, sf):
    import duckdb

    for name, rows in (("q_resistance_chain", 19_900), ("q_resistance_kernel_chain", 19_900), ("q_wishart_scatter", 625)):
        con = duckdb.connect()
        for table in ("lineitem", "nation"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
        want = {r[:2]: r[2] for r in con.execute(catalog.oracle_sql()[name]).fetchall()}
        got = {(r[0], r[1]): r[2] for r in catalog.queries()[name](spark, sf).collect()}
        assert len(got) == rows and got.keys() == want.keys()
        assert max(abs(got[k] - want[k]) for k in want) < 2e-4
