"""Publishing, baselines and exports when something goes wrong or twice at once."""

import os
import shutil
import threading

import pytest
from pyspark.sql import functions as F

from tillroll.sources import files, warehouse
from tillroll.sources.tables import TABLES, table_path

OK = lambda t: t["t"].agg((F.count(F.lit(1)) > 0).alias("ok"))


def test_one_of_two_writers_publishes(spark, tmp_path):
    target = str(tmp_path / "pub")
    v1, _ = files.validated_publish(spark, {"t": spark.range(1)}, target, OK)
    first, second = files.Publication(spark, target), files.Publication(spark, target)
    for p in (first, second):
        p.write({"t": spark.range(3)})
    ok = spark.range(1).select(F.lit(True).alias("ok"))
    second.commit(ok, ["t"])
    with pytest.raises(files.PublishConflict):
        first.commit(ok, ["t"])
    assert [r.version for r in files.published_versions(spark, target).collect()] == [second.version, v1]
    v3, _ = files.validated_publish(spark, {"t": spark.range(1)}, target, OK)
    assert files.latest_version(spark, target) == v3
    assert [r.sequence for r in files.published_versions(spark, target).collect()] == [3, 2, 1]


def test_a_record_is_created_once_by_many_threads(spark, tmp_path):
    path, won = str(tmp_path / "log" / "000000000001.json"), []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if files.put_new(spark, path, f"writer {i}\n") else None) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and open(path).read() == f"writer {won[0]}\n"
    assert [n for n in os.listdir(tmp_path / "log") if not n.endswith(".crc")] == ["000000000001.json"]


@pytest.mark.parametrize("checks", [lambda t: t["t"].select(F.lit(None).cast("boolean").alias("ok")), lambda t: t["t"].where("id < 0").select(F.lit(True).alias("ok"))])
def test_null_or_missing_checks_publish_nothing(spark, tmp_path, checks):
    with pytest.raises(files.PublishError):
        files.validated_publish(spark, {"t": spark.range(2)}, str(tmp_path / "pub"), checks)
    assert files.latest_version(spark, str(tmp_path / "pub")) is None


def test_an_export_that_cannot_take_its_place_keeps_the_old_one(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "x.csv")
    files.export_csv(spark.range(3), path)
    real = files._file_system

    class Half:
        """A file system whose second rename fails."""

        def __init__(self, fs):
            self.fs, self.calls = fs, 0

        def rename(self, a, b):
            self.calls += 1
            return False if self.calls == 2 else self.fs.rename(a, b)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    half = Half(real(spark, path)[0])
    monkeypatch.setattr(files, "_file_system", lambda s, p: (half, real(s, p)[1]))
    with pytest.raises(OSError):
        files.export_csv(spark.range(9), path)
    monkeypatch.undo()
    schema = spark.range(1).schema
    assert files.import_csv_checked(spark, path, schema, ["id"]).count() == 3
    files.export_csv(spark.range(5), path)
    assert files.import_csv_checked(spark, path, schema, ["id"]).count() == 5
    assert not [n for n in os.listdir(tmp_path) if n.endswith(".old")]


def test_csv_values_come_back_and_files_are_split(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    values = ["a\nb", "a\r\nb", "\\n", "\\\\n", "\\", "\\\\", 'say "hi"', "x,y", "é\\r\n", "plain"]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    files.export_csv(df, path)
    assert {r.id: r.v for r in files.import_csv_checked(spark, path, df.schema, ["id", "v"]).collect()} == dict(enumerate(values))
    big = str(tmp_path / "big.csv")
    files.export_csv(spark.range(60000).select(F.col("id").cast("int").alias("id"), F.lit("one\ntwo").alias("v")).coalesce(1), big)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        back = files.import_csv_checked(spark, big, df.schema, ["id"])
        assert back.rdd.getNumPartitions() > 4 and back.where("v = 'one\ntwo'").count() == 60000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    foreign = tmp_path / "foreign.csv"
    foreign.write_text('id,v\n1,"two\nlines"\n2,a\\nb\n')
    assert {r.id: r.v for r in files.import_csv_checked(spark, str(foreign), df.schema, ["id"], multi_line=True).collect()} == {1: "two\nlines", 2: "a\\nb"}


def test_json_export_replaces_whole(spark, tmp_path):
    path = str(tmp_path / "x.json")
    files.export_json(spark.range(3), path)
    with pytest.raises(Exception):
        files.export_json(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert files.import_json(spark, path, spark.range(1).schema).count() == 3
    files.export_json(spark.range(4), path)
    assert files.import_json(spark, path, spark.range(1).schema).count() == 4


@pytest.fixture
def inputs(sf_dir, tmp_path):
    for name in TABLES:
        source = table_path(sf_dir, name)
        if os.path.isfile(source):
            shutil.copy(source, tmp_path)
    return str(tmp_path)


def test_changed_inputs_are_built_anew(spark, inputs):
    one = warehouse.warehouse(spark, inputs)
    assert warehouse.warehouse(spark, inputs) is one
    nation = table_path(inputs, "nation")
    os.utime(nation, ns=(1, 1))
    two = warehouse.warehouse(spark, inputs)
    assert two.version != one.version and two.stamp != one.stamp
    assert two.sales.count() == one.sales.count()


def test_a_build_that_differs_from_its_baseline_is_not_published(spark, inputs, monkeypatch):
    one = warehouse.warehouse(spark, inputs)
    build_sales = warehouse.build_sales
    monkeypatch.setattr(warehouse, "build_sales", lambda *a, **k: build_sales(*a, **k).where("quantity > 1 OR quantity < 0"))
    with pytest.raises(files.PublishError):
        warehouse.warehouse(spark, inputs, rebuild=True)
    assert files.latest_version(spark, one.target) == one.version
    two = warehouse.warehouse(spark, inputs, rebuild=True, accept=True)
    assert files.latest_version(spark, one.target) == two.version and two.sales.count() < one.sales.count()
    warehouse.warehouse(spark, inputs, rebuild=True)  # the accepted figures are the baseline now
    monkeypatch.undo()
    with pytest.raises(files.PublishError):
        warehouse.warehouse(spark, inputs, rebuild=True)


def test_summaries_that_do_not_add_up_are_not_published(spark, inputs, monkeypatch):
    dim = warehouse.marts.dim_customer
    monkeypatch.setattr(warehouse.marts, "dim_customer", lambda s: dim(s).where("customer_id % 2 = 0"))
    with pytest.raises(files.PublishError):
        warehouse.warehouse(spark, inputs)
