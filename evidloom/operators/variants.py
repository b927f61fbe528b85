"""JSON of any shape, in the JVM alone: nodes level by level by VARIANT, leaves with their paths, and cleaned texts put together again.

Text is parsed once. Each level's nested values are exploded into the next until nothing nests, so the
rounds are as many as the deepest text has levels; every level is a written table. Text that is not JSON
has no nodes. Numbers are shown in their shortest form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidloom.tables import stored


def _kind(value: Column) -> Column:
    schema = F.schema_of_variant(value)
    return F.when(schema.startswith("OBJECT<"), "object").when(schema.startswith("ARRAY<"), "array").otherwise("leaf")


def levels(rows: DataFrame, column: str, keep: list[str]) -> list[DataFrame]:
    """The nodes of each level: (_row, node, parent, name, pos, path, kind, value) with ``_kept``, the columns of ``rows`` to be kept; ``rows`` have a number as _row."""
    spark = rows.sparkSession
    none = F.lit(None)
    top = rows.select(
        "_row", F.struct(F.lit(0).alias("_"), *keep).alias("_kept"), F.lit("").alias("node"), none.cast("string").alias("parent"), none.cast("string").alias("name"), F.lit(0).alias("pos"), F.lit("").alias("path"), F.try_parse_json(F.col(column)).alias("value"),
    ).where("value IS NOT NULL")
    out = [stored(top.withColumn("kind", _kind(F.col("value"))), "level")[0]]
    while not (nested := out[-1].where("kind <> 'leaf'")).isEmpty():
        held = nested.select("_row", "_kept", F.col("node").alias("_parent"), F.col("path").alias("_path"), F.col("value").alias("_value"))
        each = held.lateralJoin(spark.tvf.variant_explode(F.col("_value").outer()))
        path = F.when(F.col("key").isNull(), F.concat("_path", F.lit("["), "pos", F.lit("]"))).when(F.col("_path") == "", F.col("key")).otherwise(F.concat_ws(".", "_path", "key"))
        below = each.select("_row", "_kept", F.concat_ws("/", "_parent", "pos").alias("node"), F.col("_parent").alias("parent"), F.col("key").alias("name"), "pos", path.alias("path"), "value")
        out.append(stored(below.withColumn("kind", _kind(F.col("value"))), "level")[0])
    return out


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_row", F.monotonically_increasing_id())


def _with(rows: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """A join on the row's number by sorting both sides: neither is sent whole to the driver, however small its file is."""
    return rows.join(found.hint("merge"), "_row", how)


def leaves(rows: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """``rows`` with a row for each leaf of a JSON column: path (members by dots, places in brackets) and value, null for JSON's null.

    ``keep`` names the columns that are wanted beside them: nodes carry these along, and ``rows`` are not joined again.
    """
    base = _numbered(rows)
    if keep is None:
        base, _ = stored(base, "json")
    found = None
    for level in levels(base, column, keep or []):
        own = level.where("kind = 'leaf'").select("_row", "_kept", "path", F.when(~F.is_variant_null("value"), F.try_variant_get("value", "$", "string")).alias("value"))
        found = own if found is None else found.unionByName(own)
    if keep is None:
        return _with(base, found.drop("_kept")).drop("_row")
    return found.select(*[F.col("_kept")[c].alias(c) for c in keep], "path", "value")


def _literal(text: Column) -> Column:
    """A string as JSON writes it."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def cleaned_json(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the JSON with the spaces of all strings trimmed and collapsed, members by name, no spaces between. Other text stays as it is."""
    base, _ = stored(_numbered(rows), "json")
    all_ = levels(base, column, [])
    is_text = F.schema_of_variant("value") == "STRING"
    tidy = F.trim(F.regexp_replace(F.try_variant_get("value", "$", "string"), r"(?U)\s+", " "))
    below = None
    for level in reversed(all_):
        text = F.when(is_text, _literal(tidy)).otherwise(F.to_json("value"))
        own = level.where("kind = 'leaf'").select("_row", "node", "parent", "name", "pos", text.alias("text"))
        nested = level.where("kind <> 'leaf'")
        if below is not None:
            entry = F.when(F.col("name").isNull(), F.col("text")).otherwise(F.concat(_literal(F.col("name")), F.lit(":"), "text"))
            parts = below.groupBy("_row", F.col("parent").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))), lambda x: x["e"]), ",").alias("_parts"))
            inside = F.coalesce("_parts", F.lit(""))
            whole = F.when(F.col("kind") == "object", F.concat(F.lit("{"), inside, F.lit("}"))).otherwise(F.concat(F.lit("["), inside, F.lit("]")))
            own = own.unionByName(nested.join(parts.hint("merge"), ["_row", "node"], "left").select("_row", "node", "parent", "name", "pos", whole.alias("text")))
        below = stored(own, "texts")[0]
    return _with(base, below.select("_row", F.col("text").alias("_text")), "left").withColumn(name, F.coalesce("_text", F.col(column))).drop("_row", "_text")
