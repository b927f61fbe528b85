"""Column functions on numbers: ratios, bands, parsing and scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0 or null."""
    return F.when(F.coalesce(b, F.lit(0)) == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def band(c: Column, limits: list[tuple[float, str]], below: str) -> Column:
    """The name of the greatest limit that is reached."""
    out = F.lit(below)
    for limit, name in sorted(limits):
        out = F.when(c >= limit, name).otherwise(out)
    return out


def parse_number(c: Column) -> Column:
    """Numbers with spaces or commas between digits; parentheses mean negative; other text is null."""
    s = F.regexp_replace(F.trim(c), r"[\s,]", "")
    negative = s.rlike(r"^\(.*\)$")
    s = F.regexp_replace(s, r"[()]", "")
    v = F.when(s.rlike(r"^-?[0-9]{1,15}(\.[0-9]+)?$"), s.try_cast("double"))
    return F.when(negative, -v).otherwise(v)


def salary_range(c: Column) -> Column:
    """Least and greatest of the amounts in a text, and their middle."""
    amounts = F.transform(F.regexp_extract_all(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?<=[0-9])[ ,](?=[0-9]{3})", ""), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda x: x.try_cast("double"))
    return F.struct(F.array_min(amounts).alias("low"), F.array_max(amounts).alias("high"), ((F.array_min(amounts) + F.array_max(amounts)) / 2).alias("mid"))


def weighted(parts: dict[str, float]) -> Column:
    """The weighted sum of columns by name, nulls as 0."""
    return sum((F.coalesce(F.col(k).cast("double"), F.lit(0.0)) * w for k, w in parts.items()), F.lit(0.0))


#: Weights of the scores that rank recommendations.
PRIORITY = {"gap": 0.34, "evidence": 0.20, "demand": 0.20, "forecast": 0.10, "relevance": 0.16}
GAP_PRIORITY = {"gap": 0.40, "evidence": 0.25, "demand": 0.25, "confidence": 0.10}
RANKING = {"gap": 0.30, "demand": 0.25, "forecast": 0.15, "evidence": 0.15, "confidence": 0.15}


def priority(gap, evidence, demand, forecast, relevance) -> Column:
    cols = dict(zip(PRIORITY, (gap, evidence, demand, forecast, relevance), strict=True))
    return F.round(clip(sum((cols[k] * w for k, w in PRIORITY.items()), F.lit(0.0))), 4)


def exact_mean(column: str) -> Column:
    """A mean of which the sum is exact (four decimals), so that it does not depend on the order of rows."""
    return F.sum(F.col(column).cast("decimal(18,4)")).cast("double") / F.count(column)
