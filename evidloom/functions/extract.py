"""Column functions that extract, classify and score single records."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from evidloom.functions.blocks import unified
from evidloom.functions.text import clean_text, tokens


def first_filled(*columns: str | Column, default: str | None = None) -> Column:
    """The first that is neither null nor blank."""
    filled = [F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("")) for c in columns]
    return F.coalesce(*filled, F.lit(default)) if default is not None else F.coalesce(*filled)


def canonical(rows: DataFrame, payload: str, fields: dict[str, list[str]], prefix: str = "") -> DataFrame:
    """Fields of JSON payloads, each by the first of its names (dotted paths) that is filled; ``id`` gets the prefix."""
    got = {n: first_filled(*[F.get_json_object(payload, f"$.{a}") for a in names]) for n, names in fields.items()}
    return rows.select(*[(F.concat(F.lit(prefix), c) if n == "id" else c).alias(n) for n, c in got.items()])


def noise_reasons(name: Column, generic: tuple[str, ...] = (), most_words: int = 10) -> Column:
    """Sorted reasons for which a text is no proper name; empty if there are none."""
    letters = F.length(F.regexp_replace(name, "[^A-Za-z]", ""))
    words = F.size(F.regexp_extract_all(name, F.lit("[^ ]+"), F.lit(0)))
    found = [F.when(F.length(name) < 4, "too_short"), F.when(words > most_words, "too_many_words"), F.when(letters * 2 < F.length(name), "few_letters"), F.when(F.lower(F.trim(name)).isin(*generic), "generic")]
    return F.array_sort(F.array_compact(F.array(*found)))


def has_term(c: Column, terms: list[str]) -> Column:
    """Terms of one word between word ends, those of several anywhere."""
    low = F.lower(c)
    one = "|".join(t for t in terms if " " not in t)
    return reduce(Column.__or__, [F.contains(low, F.lit(t)) for t in terms if " " in t], low.rlike(f"(^|[^a-z0-9])({one})($|[^a-z0-9])") if one else F.lit(False))


def within_days(c: Column, first: str, last: str) -> Column:
    """Whether a text is a time of the days from first to last."""
    t = F.try_to_timestamp(c)
    return (t >= F.lit(first).cast("timestamp")) & (t < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"))


_ROLES = [("noise", r"^\s*$"), ("note", r"^(Note|Source|Re)[ .,:]"), ("footnote", r"^[*\[(]"), ("total", r"^(?i)(total|all) "), ("fact", "[0-9]")]


def row_role(line: Column) -> Column:
    out = F.lit("header")
    for name, pattern in reversed(_ROLES):
        out = F.when(line.rlike(pattern), name).otherwise(out)
    return out


def keyword_skills(c: Column, keywords: dict[str, list[str]]) -> Column:
    """Names of which a keyword is anywhere in the cleaned text, sorted."""
    t = clean_text(c)
    return F.array_sort(F.array_compact(F.array(*[F.when(reduce(Column.__or__, [F.contains(t, F.lit(k)) for k in own]), name) for name, own in keywords.items()])))


def phrases(rows: DataFrame, key: str, text: str, declared: str, curated: list[str], sure: float = 0.88, likely: float = 0.72) -> DataFrame:
    """(key, skill, confidence): declared skills, and curated phrases that are not declared."""
    a = F.transform(F.array_distinct(F.coalesce(declared, F.array().cast("array<string>"))), lambda s: F.struct(s.alias("skill"), F.lit(sure).alias("confidence")))
    found = F.array_compact(F.array(*[F.when(has_term(F.col(text), [p]) if " " not in p else F.col(text).rlike(f"(^|[^a-z0-9]){p}($|[^a-z0-9])"), F.lit(p)) for p in curated]))
    b = F.transform(F.array_except(found, F.coalesce(declared, F.array().cast("array<string>"))), lambda s: F.struct(s.alias("skill"), F.lit(likely).alias("confidence")))
    return rows.select(key, F.explode(F.concat(a, b)).alias("x")).select(key, "x.*")


def alias_confidence(length: Column, weight: Column) -> Column:
    c = F.least(F.lit(0.98), 0.72 + F.least(length / 40.0, F.lit(0.12)) + 0.14 * weight)
    return F.greatest(F.lit(0.5), F.least(F.lit(0.99), c))


def looked_up(c: Column, names: dict[str, str], default: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(table[c], F.lit(default))


def module_facts(t: Column) -> dict[str, Column]:
    number = lambda p: F.regexp_extract(t, p, 1).try_cast("int")
    return {"code": F.regexp_extract(t, "([A-Z]{3}[0-9]{3})", 1), "credits": number("([0-9]+) credits"), "level": number("NQF level ([0-9]+)"), "weight": number("([0-9]+)%")}


def usefulness(text: Column, facts: list[tuple[Column, int]], good: list[str], noise: list[str], short: int = 120) -> Column:
    low = F.lower(text)
    points = [(c, n) for c, n in facts] + [(F.contains(low, F.lit(t)), 2) for t in good] + [(F.contains(low, F.lit(t)), -8) for t in noise] + [(F.length(text) < short, -8)]
    return reduce(Column.__add__, [F.when(c, n).otherwise(0) for c, n in points])


def occurrences(text: Column, term: str) -> Column:
    """How often a term stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def title_name(c: Column) -> Column:
    return F.regexp_replace(c, "^(?i)job demand for ", "")


def employer(said: Column, url: Column) -> Column:
    """The employer as a record says, else by the host of its URL, with capitals."""
    return F.initcap(F.coalesce(F.nullif(F.trim(said), F.lit("")), F.regexp_extract(url, r"://(?:www\.|m\.)?([a-z0-9-]+)", 1)))


def file_facts(name: Column) -> dict[str, Column]:
    return {"series": F.regexp_extract(name, "^([A-Z][0-9]{4})", 1), "year": F.regexp_extract(name, "Quarter([0-9]{4})", 1).try_cast("int"), "quarter": F.regexp_extract(name, "([1-4])(?:st|nd|rd|th)Quarter", 1).try_cast("int")}


def all_terms(title: Column, classes: list[tuple[str, list[str]]], default: str) -> Column:
    out = F.lit(default)
    for name, terms in reversed(classes):
        out = F.when(F.forall(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(title, t)), name).otherwise(out)
    return out


def unit(title: Column) -> Column:
    low = F.lower(title)
    return F.when(low.rlike("%|percent|rate"), "percent").when(F.contains(low, F.lit("thousand")), "thousand").otherwise("count")


def failure(message: Column) -> Column:
    low = F.lower(message)
    return F.when(low.rlike("timed out|timeout"), "timeout").when(low.rlike("codec|decode|encoding"), "encoding").when(low.rlike("column|schema|field"), "schema").otherwise("unknown")


def weighted(parts: list[tuple[Column, float]], base: float = 0.0) -> Column:
    return reduce(Column.__add__, [F.when(c, w).otherwise(0.0) for c, w in parts], F.lit(base))


def target(label: Column) -> Column:
    """Labels from 1 to 5 as numbers from 0 to 1."""
    return (label - 1) / 4.0


def unique_names(header: list[str]) -> list[str]:
    """Column names of a header row: normalised, numbered where they repeat."""
    out: list[str] = []
    for h in header:
        name = "_".join(h.lower().split()) or "column"
        k = sum(1 for x in out if x == name or x.rpartition("_")[0] == name and x.rpartition("_")[2].isdigit())
        out.append(name if not k else f"{name}_{k + 1}")
    return out


@F.pandas_udf(StringType())
def line_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """A unified diff by lines with two lines of context, of 300 lines at most."""
    return pd.Series(["\n".join(unified((x or "").split("\n"), (y or "").split("\n"))[:300]) for x, y in zip(a, b, strict=True)])


#: Fixed: what features of a posting are divided by, and the year that stands for none.
FEATURE_SCALE = {"posting": 4000.0, "title": 200.0, "matched": 120.0, "evidence": 600.0, "salary": 200_000.0}
FEATURE_YEAR = 2026.0


def training_features(given: dict[str, Column], sources: dict[str, str], regions: dict[str, str], declared: str = "declared_job_skill") -> dict[str, Column]:
    """The features, each from 0 to 1, that a mapping of a posting to a skill is learnt from.

    ``given`` has description, title, matched, evidence_len, salary_mid, year, quarter, confidence, source, region, employment, skills, processed and
    method; nulls are like none. ``sources`` and ``regions`` name a feature for each pattern, of which several may hold.
    """
    low = lambda k: F.lower(F.coalesce(given[k].cast("string"), F.lit("")))
    size = lambda k, scale: F.least(F.length(F.coalesce(given[k], F.lit(""))), F.lit(int(FEATURE_SCALE[scale]))) / FEATURE_SCALE[scale]
    held = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    words, own = tokens(F.concat_ws(" ", low("title"), low("description"))), tokens(low("matched"))
    either = F.size(F.array_union(words, own))
    out = {
        "posting_len": size("description", "posting"), "title_len": size("title", "title"), "skills_count": held(F.coalesce(given["skills"], F.lit(0.0))), "matched_len": size("matched", "matched"),
        "desc_match": flag((low("matched") != "") & F.contains(low("description"), low("matched"))), "token_overlap": F.when(either > 0, F.size(F.array_intersect(words, own)) / either).otherwise(0.0),
        "evidence_len": held(F.coalesce(given["evidence_len"], F.lit(0.0)) / FEATURE_SCALE["evidence"]), "confidence": held(F.coalesce(given["confidence"], F.lit(0.5))),
    }
    out |= {name: flag(low("source").rlike(p)) for name, p in sources.items()} | {name: flag(low("region").rlike(p)) for name, p in regions.items()}
    return out | {
        "salary_mid_norm": held(F.coalesce(given["salary_mid"], F.lit(0.0)) / FEATURE_SCALE["salary"]), "employment_full_time": flag(low("employment").startswith("full")), "is_processed": flag(given["processed"]),
        "year_norm": held((F.coalesce(given["year"], F.lit(FEATURE_YEAR)) - 2000.0) / 40.0), "quarter_norm": held(F.coalesce(given["quarter"], F.lit(1.0)) / 4.0), "is_declared_job_skill": flag(given["method"] == declared),
    }
