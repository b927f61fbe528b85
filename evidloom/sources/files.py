"""Readers of delimited, JSON, HTML and office files, and sinks with a manifest."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T


def read_csv(spark: SparkSession, path: str, separator: str = ",", multi_line: bool = False) -> DataFrame:
    """All columns as text, a byte-order mark dropped, quotes doubled inside quotes.

    Files are split over tasks, unless quoted fields hold line ends (``multi_line``), when a file is one task.
    """
    df = spark.read.option("header", True).option("sep", separator).option("multiLine", multi_line).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Tab unless the first line has more bars or commas."""
    first = spark.read.text(path).limit(1).first()
    line = first[0] if first else ""
    best = max(("\t", "|", ","), key=lambda s: (line.count(s), s == "\t"))
    return read_csv(spark, path, best)


def read_csv_rows(spark: SparkSession, path: str, schema: str, start_row: int = 1, max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows from ``start_row`` on (the first is 1), ``max_rows`` at most, in two lanes: those of the schema, and the text of those that are not.

    The number of a row is its place in the order of files and lines; a file may be read by many tasks.
    """
    typed = T.StructType.fromDDL(schema)
    place = F.monotonically_increasing_id()
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.file_block_start") == 0).alias("_first"), place.alias("_id"))
    # The header is the first line of a file; lines that equal it further on are rows.
    heads = lines.where("_first").groupBy("_file").agg(F.min("_id").alias("_id")).select("_id")
    parsed = F.from_csv("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "escape": '"', "columnNameOfCorruptRecord": "_corrupt_record"})
    part = lines.join(heads, "_id", "left_anti").select(parsed.alias("r"), "_id").select("r.*", "_id").withColumn("_part", F.shiftright("_id", 33))
    before = part.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a task
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_id"))
    rows = part.withColumn("_within", within).join(before, "_part").withColumn("_row", F.col("_before") + F.col("_within"))
    rows = rows.where(F.col("_row") >= start_row)
    if max_rows is not None:
        rows = rows.where(F.col("_row") < start_row + max_rows)
    return rows.where("_corrupt_record IS NULL").select("_row", *typed.names), rows.where("_corrupt_record IS NOT NULL").select("_row", F.col("_corrupt_record").alias("line"))


def import_csv(spark: SparkSession, folder: str, schema: str, to: str, checkpoint: str, key: str, files_a_batch: int = 1) -> list[int]:
    """Imports the files of a folder as a stream of what is there, some files a batch; returns the rows of each batch.

    Keys that the target has already are left out, so a repeated file adds nothing; a rerun goes on where the last one ended. What is
    known is the target itself, so no state grows; a batch that is run again replaces the part that it wrote.
    """
    stream = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_a_batch).csv(folder)

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        written = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("batch", T.IntegerType())])
        new = batch.dropDuplicates([key])
        if number:
            known = session.read.schema(written).parquet(to).where(F.col("batch") < number).select(key)
            new = new.join(known, key, "left_anti")
        new.write.mode("overwrite").parquet(f"{to}/batch={number}")

    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()
    query.awaitTermination()
    return [int(p["numInputRows"]) for p in query.recentProgress]


def checked_bundle(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(file, phase, state) of a bundle's ``manifest`` (file, phase, sha256, rows): ok, missing, changed or short; rows are lines less the header."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("_hash"), (F.size(F.split(F.rtrim(F.col("content").cast("string")), "\n")) - 1).alias("_rows"))
    state = F.when(F.col("_hash").isNull(), "missing").when(F.col("_hash") != F.col("sha256"), "changed").when(F.col("_rows") < F.col("rows"), "short").otherwise("ok")
    return manifest.join(files, "file", "left").select("file", "phase", state.alias("state"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A record a line; files are split over tasks."""
    return spark.read.schema(schema).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, under: tuple[str, ...] = ("jobs", "items", "results", "data", "records", "rows")) -> DataFrame:
    """Records of a list, of the first of those fields that holds one, or a single record."""
    record = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    whole = spark.read.text(path, wholetext=True)
    many = T.ArrayType(record)
    lists = [F.from_json("value", many), *[F.from_json("value", T.StructType([T.StructField(k, many)]))[k] for k in under]]
    is_list = F.ltrim(F.col("value")).startswith("[")
    found = F.when(is_list, lists[0]).otherwise(F.coalesce(*lists[1:], F.array(F.from_json("value", record))))
    return whole.select(F.explode(found).alias("r")).where("r IS NOT NULL").select("r.*")


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _sheet_rows(content: bytes) -> list[dict[str, str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        sheet = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        rows = []
        for row in ElementTree.fromstring(z.read(sheet[0])).iter(f"{_MAIN}row") if sheet else ():
            cells: dict[int, str] = {}
            for c in row.iter(f"{_MAIN}c"):
                letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                v = c.find(f"{_MAIN}v")
                text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if v is None else (v.text or "")
                cells[at - 1] = shared[int(text)] if c.get("t") == "s" and text else text
            rows.append(cells)
    head = rows[0] if rows else {}
    return [{head[k]: r.get(k, "") for k in head} for r in rows[1:]]


def _paragraphs(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join(t for p in root.iter(f"{_WORD}p") if (t := "".join(x.text or "" for x in p.iter(f"{_WORD}t"))))


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, row number, cells map, text): a row for each sheet row, or one for a word document.

    A file is the unit of work; one that cannot be read is a row of kind ``unreadable``.
    """

    def parse(batches):
        for pdf in batches:
            out = []
            for p, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    if p.lower().endswith(".xlsx"):
                        out += [(p, "sheet", i, r, None) for i, r in enumerate(_sheet_rows(content))]
                    else:
                        out.append((p, "document", 0, None, _paragraphs(content)))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    out.append((p, "unreadable", 0, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "kind", "number", "cells", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xlsx,docx}").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, kind string, number int, cells map<string,string>, text string")


def visible_text(html: Column) -> Column:
    """Without scripts, styles, comments and tags; spaces collapsed."""
    s = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"(?s)<[^>]*>", " "), r"\s+", " "))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""<a [^>]*href="([^"]*)\""""), F.lit(1))


def route(columns: list[str], signatures: dict[str, set[str]]) -> str | None:
    """The first kind of file of which all columns are there."""
    have = {c.strip().lower() for c in columns}
    return next((kind for kind, need in signatures.items() if need <= have), None)


def write_with_manifest(df: DataFrame, path: str, kind: str = "csv") -> None:
    """The table, and beside it a JSON line of its rows and an order-free digest."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv if kind == "csv" else writer.json)(f"{path}/data")
    digest = df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("digest"))
    digest.withColumn("columns", F.lit(",".join(df.columns))).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
