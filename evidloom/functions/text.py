"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clean_text(c: Column) -> Column:
    """Lower case, only a-z, 0-9 and single spaces, trimmed; null becomes empty."""
    kept = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def normalise(c: Column) -> Column:
    return F.lower(collapse_spaces(c))


def slug(c: Column, default: str = "skill", most: int = 150) -> Column:
    """Runs of other than letters and digits become a hyphen; ``default`` where nothing is left."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "-")
    s = F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, most)
    return F.when(s == "", default).otherwise(s)


def tokens(c: Column, pattern: str = "[a-z0-9]+") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({pattern})"), F.lit(1))


_STOP = ("skills", "skill", "the", "and")


def duplicate_key(c: Column) -> Column:
    """A name's key: connecting signs read as spaces, weak words dropped."""
    words = tokens(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[&/\-]", " "), "[a-z0-9+#.]+")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*_STOP)), " ")


def skill_label(c: Column) -> Column:
    """Lower case, with the signs of names such as c++, c# and .net, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9+#. ]", " "), " +", " "))


_SENIORITY = r"\b(senior|junior|lead|principal|graduate|intern|trainee|entry level|mid level)\b"


def job_title(c: Column) -> Column:
    """Without words of seniority and without signs."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), _SENIORITY, " "), r"[^a-z0-9]+", " "))


def fingerprint(*cols: Column) -> Column:
    """SHA-256 of the normalised parts, joined by a bar."""
    return F.sha2(F.concat_ws("|", *[normalise(c.cast("string")) for c in cols]), 256)


def split_list(c: Column) -> Column:
    """Trimmed, non-empty entries separated by new lines, commas or semicolons, first of each kept."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[\n,;]"), lambda p: F.trim(p))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def location(c: Column) -> Column:
    """City, region and country from parts separated by commas."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.trim(p))
    at = lambda i: F.nullif(F.get(parts, i), F.lit(""))
    n = F.size(parts)
    return F.struct(at(F.lit(0)).alias("city"), F.when(n > 2, at(F.lit(1))).alias("region"), F.when(n > 1, at(n - 1)).alias("country"))


def evidence_window(text: Column, at: Column, length: Column, around: int = 120) -> Column:
    """What stands around a match; ``at`` counts from 1."""
    start = F.greatest(at - around, F.lit(1))
    return F.substring(text, start, at + length + around - start)


def chunks(text: Column, size: int = 1800, overlap: int = 200) -> Column:
    """Pieces of fixed size that overlap: (number, start, piece)."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / step) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("number"), (i * step).alias("start"), F.substring(text, i * step + 1, F.lit(size)).alias("piece")))


def first_match(c: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first pattern that occurs."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out
