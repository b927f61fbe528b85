"""Paged sources: order, limits, failures, resuming."""

from __future__ import annotations

import json

import pytest

from evidloom.sources import paged

SCHEMA = "id long, name string"


def page(folder, number, records, following=None, broken=False):
    d = folder / f"page={number}"
    d.mkdir(parents=True)
    (d / "part-0.txt").write_text("{" if broken else json.dumps({"answer": {"results": records}, "next": following}))


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(paged.PagedSource)
    for k in range(9):
        page(tmp_path, k, [{"id": 10 * k + i, "name": f"é{i}", "other": 1} for i in range(k % 4)], f"{k + 2}" if k < 7 else None)
    return tmp_path


def read(spark, path, **options):
    return sorted(r.id for r in spark.read.format("paged").schema(SCHEMA).options(dataPath="answer.results", pause="0", **options).load(str(path)).collect())


def ids(*numbers):
    return sorted(10 * k + i for k in numbers for i in range(k % 4))


def test_numbered_and_cursor(spark, folder):
    assert read(spark, folder) == ids(*range(9)) and read(spark, f"file://{folder}", pagesPerTask=1) == ids(*range(9))
    assert read(spark, folder, most=3) == ids(0, 1, 2)
    assert read(spark, folder, mode="cursor") == ids(0, 2, 4, 6, 8)
    assert read(spark, folder, mode="cursor", start="1", most=2) == ids(1, 3)
    assert read(spark, folder / "none") == [] and read(spark, folder, mode="cursor", start="99") == []
    page(folder, 20, [{"id": 1, "name": None}], 21)
    page(folder, 21, [{"id": 2}], 20)
    assert read(spark, folder, mode="cursor", start="20") == [1, 2]  # a cursor that runs in a circle


def test_failed_pages(spark, folder):
    for k in (30, 31):
        page(folder, k, [], broken=True)
    page(folder, 32, [{"id": 5, "name": "x"}])
    assert read(spark, folder, pagesPerTask=20) == sorted([*ids(*range(9)), 5])  # two in a row are passed over
    with pytest.raises(Exception, match="failed"):
        read(spark, folder, strict="true")
    page(folder, 33, [], broken=True)
    page(folder, 34, [], broken=True)
    page(folder, 35, [], broken=True)
    with pytest.raises(Exception, match="3 in a row"):
        read(spark, folder, pagesPerTask=20)


class Flaky(paged.Pages):
    """Fails every page once."""

    seen: dict = {}

    def fetch(self, name):
        Flaky.seen[name] = Flaky.seen.get(name, 0) + 1
        if Flaky.seen[name] == 1:
            raise paged.Unavailable(name)
        return super().fetch(name)


def test_tries_again(folder):
    from pyspark.sql.types import LongType, StructField, StructType

    reader = paged.PagedReader({"path": str(folder), "datapath": "answer.results", "pause": "0", "store": Flaky}, StructType([StructField("id", LongType())]))
    assert sorted(x for p in reader.partitions() for (x,) in reader.read(p)) == ids(*range(9)) and set(Flaky.seen.values()) == {2}
    assert [paged.pause(k, 0.5, 3) for k in (1, 2, 3, 4)] == [0.5, 1.0, 2.0, 3]


def test_stream_resumes(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")

    def run():
        stream = spark.readStream.format("paged").schema(SCHEMA).options(dataPath="answer.results", pagesPerTask=2, pause="0").load(str(folder))
        q = stream.writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "state")).trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r.id for r in spark.read.parquet(str(out / "rows")).collect())

    got = run()
    assert got == ids(*range(9))
    assert run() == got  # nothing twice
    page(folder, 10, [{"id": 777, "name": "after a gap"}])
    assert run() == got
    page(folder, 9, [{"id": 99, "name": "late"}])
    assert run() == sorted([*got, 99, 777])
