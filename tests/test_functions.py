from __future__ import annotations

import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from evidloom.functions import dates, numbers, text, vectors
from evidloom.operators import quality, series
from evidloom.sources import files


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


def test_text(spark):
    assert one(spark, text.clean_text(F.col("x")), x="  C++ & Data-Science!  ") == "c data science"
    assert one(spark, text.clean_text(F.col("x")), x=None) == ""
    assert one(spark, text.slug(F.col("x")), x="!!") == "skill"
    assert one(spark, text.duplicate_key(F.col("x")), x="The Project & Team-Work Skills") == "project team work"
    assert one(spark, text.job_title(F.col("x")), x="Senior Data-Engineer (lead)") == "data engineer"
    assert one(spark, text.split_list(F.col("x")), x="a; b\na,,c") == ["a", "b", "c"]
    place = one(spark, text.location(F.col("x")), x="Cape Town, Western Cape, South Africa")
    assert (place.city, place.region, place.country) == ("Cape Town", "Western Cape", "South Africa")
    assert [c.start for c in one(spark, text.chunks(F.col("x")), x="a" * 3500)] == [0, 1600, 3200]
    assert [c.piece for c in one(spark, text.chunks(F.col("x")), x="")] == [""]


def test_numbers(spark):
    assert one(spark, numbers.parse_number(F.col("x")), x="(1 234.5)") == -1234.5
    assert one(spark, numbers.parse_number(F.col("x")), x="n/a") is None
    assert one(spark, numbers.ratio(F.col("a"), F.col("b")), a=1, b=0) == 0.0
    pay = one(spark, numbers.salary_range(F.col("x")), x="R20 000 - R30,000 a month")
    assert (pay.low, pay.high, pay.mid) == (20000.0, 30000.0, 25000.0)


def test_dates(spark):
    assert one(spark, dates.parse_date(F.col("x")), x="1700000000000") == one(spark, dates.parse_date(F.col("x")), x="1700000000")
    assert one(spark, dates.parse_date(F.col("x")), x="03/02/2024").date() == dt.date(2024, 2, 3)
    assert one(spark, dates.parse_date(F.col("x")), x="soon") is None
    assert one(spark, dates.quarter_number(F.col("x")), x="3rd Quarter 2023") == 3


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vectors.cosine(v, v), x=1) == 1.0
    assert one(spark, vectors.cosine(v, F.array(F.lit(0.0), F.lit(0.0))), x=1) == 0.0
    e = one(spark, vectors.hashed_embedding(F.split(F.col("x"), " "), 16), x="data science data")
    assert abs(sum(a * a for a in e) - 1) < 1e-6


def test_series_and_quality(spark):
    s = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("b", 1, 5.0)], "k string, t int, v double")
    assert {r.k: r.growth for r in series.growth(s, ["k"], "t", "v").collect()} == {"a": 1.0, "b": None}
    assert {r.k: r.level for r in series.smoothed(s, ["k"], "t", "v").collect()} == {"a": 13.0, "b": 5.0}
    rules = [quality.Rule("some", "v > 6", "error"), quality.Rule("early", "t < 2", "warn")]
    assert [(r.k, r.score, r.status) for r in quality.quality_score(s, "k", rules).orderBy("k", "score").collect()] == [("a", 0.9, "warning"), ("a", 1.0, "valid"), ("b", 0.65, "failed")]


def _xlsx() -> bytes:
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>name</t></si><si><t>n</t></si><si><t>first</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>7</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def _docx() -> bytes:
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,name\n1,"x, ""y"""\n2,z\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", 'x, "y"'), ("2", "z")]
    (tmp_path / "b.txt").write_text("id|name\n1|x\n")
    assert files.read_delimited(spark, str(tmp_path / "b.txt")).columns == ["id", "name"]
    for k, body in enumerate(('[{"id": 1}, {"id": 2}]', '{"results": [{"id": 3}]}', '{"id": 4}')):
        (tmp_path / f"{k}.json").write_text(body)
    assert sorted(r.id for k in range(3) for r in files.read_json(spark, str(tmp_path / f"{k}.json"), "id int").collect()) == [1, 2, 3, 4]
    (tmp_path / "o").mkdir()
    (tmp_path / "o/a.xlsx").write_bytes(_xlsx())
    (tmp_path / "o/b.docx").write_bytes(_docx())
    (tmp_path / "o/c.docx").write_bytes(b"no zip")
    rows = {r.kind: r for r in files.read_office(spark, str(tmp_path / "o")).collect()}
    assert rows["sheet"].cells == {"name": "first", "n": "7"} and rows["document"].text == "One\nTwo" and "unreadable" in rows
    assert files.route(["ID", "title "], {"posts": {"id", "title"}}) == "posts"
    files.write_with_manifest(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/manifest")).first().rows == 3
