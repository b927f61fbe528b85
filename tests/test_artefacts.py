"""Artefacts whose files change, go or come, and bundles that are refused."""

from __future__ import annotations

import glob
import hashlib
import os

import pytest

from evidloom.sources import artefacts


@pytest.fixture
def folder(spark, tmp_path):
    a = spark.createDataFrame([(1, 'x "q", y'), (2, None)], "id int, text string").repartition(2)
    b = spark.createDataFrame([(1, 1), (2, 9)], "id int, of int")
    manifest = artefacts.write_artefacts({"a": a, "b": b}, str(tmp_path / "run")).collect()
    assert {(r.artefact, r.rows, r.columns) for r in manifest} == {("a", 2, "id,text"), ("b", 2, "id,of")}
    for r in manifest:
        assert r.sha256 == hashlib.sha256((tmp_path / "run/data" / r.file).read_bytes()).hexdigest()
    return tmp_path / "run"


def states(spark, folder):
    return sorted((r.artefact, r.state) for r in artefacts.checked_artefacts(spark, str(folder)).collect())


PHASES = [("a", "id int, text string", lambda _, rows: rows), ("b", "id int, of int", lambda done, rows: rows.join(done["a"].selectExpr("id AS of"), "of", "left_semi"))]


def test_states_and_phases(spark, folder):
    assert set(states(spark, folder)) == {("a", "ok"), ("b", "ok")}
    tables, told = artefacts.import_bundle(spark, str(folder), PHASES)
    assert sorted(map(tuple, told.collect())) == [(1, "a", 2, 2), (2, "b", 2, 1)]
    assert [r.id for r in tables["b"].collect()] == [1]
    parts = sorted(glob.glob(str(folder / "data/b/part-*")))
    os.remove(folder / "data/b" / f".{os.path.basename(parts[0])}.crc")  # the file system's own checksum would refuse the file
    with open(parts[0], "a") as f:
        f.write("3,1\n")
    os.remove(sorted(glob.glob(str(folder / "data/a/part-*")))[0])
    (folder / "data/b/part-new.csv").write_text("id,of\n")
    assert {("b", "changed"), ("b", "unknown"), ("a", "missing")} <= set(states(spark, folder))
    with pytest.raises(ValueError, match="a missing, b changed, b unknown"):
        artefacts.import_bundle(spark, str(folder), PHASES)


def test_missing_table(spark, folder):
    with pytest.raises(ValueError, match="c missing"):
        artefacts.import_bundle(spark, str(folder), [*PHASES, ("c", "id int", lambda _, rows: rows)])
