from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from quarry import runtime


def test_tables_are_kept_until_cleaned(spark):
    ws = runtime.Workspace(spark, "test")
    a, b = ws.save(spark.range(5), "a"), ws.save(spark.range(0), "b")
    assert a.count() == 5 and b.count() == 0 and b.columns == ['id']
    folder = Path(ws.root.removeprefix("file://"))
    ws.drop("a")
    assert not (folder / "a").exists() and (folder / "b").exists()
    ws.release()
    runtime.clean_up(spark)
    assert not folder.exists()


def test_workers_import_the_package(spark):
    runtime.ship(spark)

    @F.udf("string")
    def where(_):
        import quarry

        return quarry.__version__

    assert spark.range(1).select(where("id")).first()[0]
