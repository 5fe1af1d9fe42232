"""What loads, checks and sketches shuffle and write: packed texts, one write of a first load, one join."""

import pytest
from pyspark.sql import functions as F

from piste.functions.core import packed, unpacked
from piste.operators import incremental as INC
from piste.operators import quality as Q
from piste.operators import sketches as SK
from piste.plans import catalog

TEXTS = ["d41d8cd98f00b204e9800998ecf8427e", "D41D8CD98F00B204E9800998ECF8427E", "abc", "ab", "", None, "12", "1-2", "é", "\x01ab", "\x00", "0g"]


def test_packed_text_comes_back_and_hex_takes_half(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").withColumn("p", packed("t"))
    got = df.select("t", unpacked("p").alias("u"), F.length("p").alias("n"), "p").collect()
    assert [r["u"] for r in got] == TEXTS
    assert got[0]["n"] == 17 and got[1]["n"] == 33
    assert len({bytes(r["p"]) for r in got if r["p"] is not None}) == len(TEXTS) - 1


@pytest.mark.parametrize("partition", ["month", None])
def test_a_first_load_is_written_once(spark, scratch, monkeypatch, partition):
    rows = spark.createDataFrame([(t, f"m{i % 3}" if i % 4 else None, i) for i, t in enumerate(TEXTS * 2)], "k string, month string, v int")
    read, paths = type(spark.read).parquet, []
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *p: paths.append(p[0]) or read(self, *p))
    INC.upsert(spark, rows, f"{scratch}/t", "k", "v", partition_col=partition, epoch=1)
    assert not any(p.endswith("/new") for p in paths) and INC.committed(spark, f"{scratch}/t", 1)
    got = {r["k"]: (r["month"], r["v"]) for r in spark.read.parquet(f"{scratch}/t").collect()}
    assert got == {t: (f"m{(i + 12) % 3}" if (i + 12) % 4 else None, i + 12) for i, t in enumerate(TEXTS)}
    assert spark.read.parquet(f"{scratch}/t").count() == len(TEXTS)


def test_a_first_load_that_fails_before_or_after_its_move_is_finished(spark, scratch, monkeypatch):
    rows = spark.createDataFrame([("a", "m1", 1), ("b", "m2", 2)], "k string, month string, v int")
    for at, real in (("_move", INC._move), ("delete_path", INC.delete_path)):
        target = f"{scratch}/{at}"

        def fail(*a):
            raise OSError("lost")

        monkeypatch.setattr(INC, at, fail)
        with pytest.raises(OSError):
            INC.upsert(spark, rows, target, "k", partition_col="month", epoch=0)
        monkeypatch.setattr(INC, at, real)
        assert INC.recover(spark, target) and INC.committed(spark, target, 0)
        assert sorted(r["v"] for r in spark.read.parquet(target).collect()) == [1, 2]


def test_an_empty_first_load_leaves_no_target(spark, scratch):
    none = spark.createDataFrame([], "k string, month string, v int")
    assert INC.upsert(spark, none, f"{scratch}/t", "k", partition_col="month", epoch=3)["mode"] == "empty"
    assert INC.committed(spark, f"{scratch}/t", 3) and not INC.path_exists(spark, f"{scratch}/t")


def test_checks_shuffle_packed_keys(spark):
    child = spark.createDataFrame([(t,) for t in TEXTS], "k string")
    checks = [Q.Check("u", "unique", "c", "k"), Q.Check("r", "relationships", "c", "k", "p", "k")]
    tables = {"c": child.union(child.limit(1)), "p": child.where("k <> 'abc'")}
    seen = Q.observations(tables, checks)
    aggregate = seen.groupBy("key").count()
    assert dict(seen.dtypes)["key"] == "string" and "hex(" in aggregate._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r["check_name"], r["value"], r["n_records"]) for r in Q.failing_rows(tables, checks).collect())
    assert got == [("r", "abc", 1), ("u", TEXTS[0], 2)]


def test_sketch_keys_come_back(spark):
    df = spark.createDataFrame([(1, t, float(i)) for i, t in enumerate(TEXTS * 3)], "day int, k string, v double")
    got = {r["k"]: r["values"] for r in SK.sketched(df, ["day", "k"], "v").collect()}
    assert got == {t: 3 for t in TEXTS}


def test_percentiles_join_lines_with_orders_once(spark, monkeypatch):
    from tests.conftest import SF_SMALL

    out = catalog.wait_percentiles_from_sketches(spark, SF_SMALL)
    assert "o_orderkey" not in out._jdf.queryExecution().optimizedPlan().toString()
