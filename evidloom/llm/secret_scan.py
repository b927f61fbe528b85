"""Secrets in texts, and multipart credentials whose parts stand together; DataFrame functions only.

Strong forms are reported wherever they stand: ``assign`` (a secret's name and a value of 12
characters or more), ``access`` (access key ids) and ``hex`` (16 hexadecimal digits or more).

Weak parts mean nothing alone: ``id`` (a user, account or client named), ``part`` (a value
assigned to a weaker name, or to a strong one but short) and ``endpoint`` (a URL or a host
named). An interval join finds the identifiers and endpoints within ``SCOPE`` characters of a
part; the part is reported, as ``linked_part``, if both an identifier and an endpoint are there,
or an access key id. Those complements are reported with it (``linked_id``,
``linked_endpoint``). The join is a window over each document's parts in order of place, so
parts are neither paired nor crossed; documents are shuffled without their texts.

Positions are in characters (code points), ends exclusive. Null texts are empty ones. Repeated
rows are scanned and reported separately. A document without findings has empty strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SCOPE = 200
_VALUE = r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)" + _VALUE
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
WEAK_ID = r"(?i:user_?name|user|login|account|client_?id|access_?id)" + _VALUE
WEAK_PART = r"(?i:pwd|passphrase|credential|auth|private_?key|access_?key)" + _VALUE
ENDPOINT = r"(?i:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D\"'<>]+|(?i:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.:/_-]{4,}"
_BLOCK = 256


def _with_spans(df: DataFrame, to: str, pattern: str, least: int, group: int = 0, when: Column | None = None, keep_short: int | None = None) -> DataFrame:
    """Adds array<struct<start,end,size>> of the matches of which ``group`` has ``least`` characters or more.

    Places follow from the lengths of matches and of what stands between them; running sums go
    by blocks, so that a text of very many matches takes no squared time.
    """
    found, sizes, sums, base = (f"_{to}_{x}" for x in ("found", "sizes", "sums", "base"))
    text = F.col("_text")
    some = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    df = df.withColumn(found, F.when(when, some).otherwise(F.array().cast("array<string>")) if when is not None else some)
    gaps = F.split(text, pattern, -1)
    df = df.withColumn(sizes, F.when(F.size(found) > 0, F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, s: a + s["gap"] + s["size"])
    df = df.withColumn(sums, F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK))))))
    df = df.withColumn(base, F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), lambda a, s: a + s)))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.col(found)
    values = F.when(F.size(found) > 0, values)
    place = F.transform(sizes, lambda s, i: F.get(base, F.floor(i / _BLOCK).cast("int")) + total(F.slice(sizes, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)) + s["gap"])
    spans = F.zip_with(F.zip_with(place, sizes, lambda p, s: F.struct(p.alias("start"), (p + s["size"]).alias("end"))), values, lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.length(v).alias("size")))
    df = df.withColumn(to, F.coalesce(spans, F.array().cast("array<struct<start:int,end:int,size:int>>")))
    if keep_short is not None:
        df = df.withColumn(f"{to}_short", F.filter(to, lambda x: (x["size"] < least) & (x["size"] >= keep_short)))
    return df.withColumn(to, F.filter(to, lambda x: x["size"] >= least)).drop(found, sizes, sums, base)


def _named(kind: str, order: int, of: str) -> Column:
    return F.transform(of, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("place"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans) of each row of ``docs`` (doc_id, text).

    ``base`` and ``spans`` are comma-joined kind:start:end by start, then kind; ``spans`` also
    has the linked parts.
    """
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    df = _with_spans(df, "assign", ASSIGN, 12, 1, keep_short=6)
    df = _with_spans(df, "access", ACCESS, 18)
    df = _with_spans(df, "hex", HEX.replace("+", "{16,}"), 16)  # the greedy run of fewer fails, so the same spans
    df = _with_spans(df, "part", WEAK_PART, 6, 1)
    weak = (F.size("part") > 0) | (F.size("assign_short") > 0)
    df = _with_spans(df, "id", WEAK_ID, 3, 1, when=weak)
    df = _with_spans(df, "endpoint", ENDPOINT, 4, when=weak)
    part = lambda kind, of: F.transform(of, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    parts = F.when(weak, F.concat(part("part", "part"), part("part", "assign_short"), part("id", "id"), part("endpoint", "endpoint"), part("access", "access")))
    base = F.concat(_named("assign", 0, "assign"), _named("access", 1, "access"), _named("hex", 2, "hex"))
    rows = df.select("_row", "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")], base.alias("base"), F.posexplode_outer(parts).alias("at", "x"))
    # The strong spans go along with the first part only, so a document's rows follow its parts, not parts times spans.
    rows = rows.select("_row", "doc_id", "n_assign", "n_access", "n_hex", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("base")).alias("base"), "x.*")

    near = Window.partitionBy("_row").orderBy("start").rangeBetween(-scope, scope)
    there = lambda kind: F.coalesce(F.max(F.col("kind") == kind).over(near), F.lit(False))
    rows = rows.withColumn("linked", (F.col("kind") == "part") & (there("access") | (there("id") & there("endpoint"))))
    rows = rows.withColumn("linked", F.col("linked") | (F.col("kind").isin("id", "endpoint") & F.coalesce(F.max("linked").over(near), F.lit(False))))
    order = F.when(F.col("kind") == "id", 3).when(F.col("kind") == "part", 4).otherwise(5)
    linked = F.when(F.col("linked"), F.struct("start", order.alias("place"), "end", F.concat(F.lit("linked_"), "kind").alias("kind")))
    out = rows.groupBy("_row").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("doc_id", "n_assign", "n_access", "n_hex", "base")], F.collect_list(linked).alias("linked"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", _text_of(F.col("base")).alias("base"), _text_of(F.concat("base", "linked")).alias("spans"))
