"""Chunk quality and the document gate, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.numbers import round_python
from textquarry.functions.text import strip


@dataclass(frozen=True)
class Profile:
    """Tunables and their defaults."""

    chunk_size: int = 1500
    chunk_overlap: int = 200
    header_levels: int = 3
    min_slide: int = 200
    rows_per_chunk: int = 20
    quality_min: int = 500
    quality_max: int = 2000
    penalty: float = 0.15
    auto_fix: bool = True


def _stripped(content: Column) -> Column:
    return strip(F.coalesce(content, F.lit("")))


def _titled(c: Column) -> Column:
    return c.startswith("#") | c.startswith(">")


def _flags(c: Column, has_breadcrumbs: Column, p: Profile) -> Column:
    n = F.length(c)
    ends = F.right(c, F.lit(1)).isin(".", "!", "?", ":", ">") | c.endswith("```")
    raised = (("TOO_SHORT", n < p.quality_min), ("TOO_LONG", n > p.quality_max), ("NO_CONTEXT", ~(_titled(c) | has_breadcrumbs)), ("FRAGMENT", ~ends))
    found = F.array_remove(F.array(*[F.when(condition, name).otherwise("") for name, condition in raised]), "")
    return F.when(n == 0, F.array(F.lit("EMPTY"))).otherwise(found)


def _raw(c: Column, found: Column, has_breadcrumbs: Column, p: Profile) -> Column:
    total = (
        F.greatest(F.lit(0.0), 1 - F.lit(p.penalty) * F.size(found)) * 0.4
        + F.least(F.lit(1.0), F.length(c) / F.lit(float(p.chunk_size))) * 0.3
        + F.when(_titled(c) | has_breadcrumbs, 1.0).otherwise(0.5) * 0.2
        + F.when(F.array_contains(found, "FRAGMENT"), 0.7).otherwise(1.0) * 0.1
    )
    return F.when(F.length(c) == 0, 0.0).otherwise(total)


def flags(content: Column, has_breadcrumbs: Column, p: Profile = Profile()) -> Column:
    return _flags(_stripped(content), has_breadcrumbs, p)


def has_title(content: Column) -> Column:
    return _titled(_stripped(content))


def raw_score(content: Column, has_breadcrumbs: Column, p: Profile = Profile()) -> Column:
    """The score before rounding; 0 for an empty chunk."""
    return _raw(_stripped(content), flags(content, has_breadcrumbs, p), has_breadcrumbs, p)


def score(content: Column, has_breadcrumbs: Column, p: Profile = Profile()) -> Column:
    """The stored score: two decimals, rounded as Python does."""
    return round_python(raw_score(content, has_breadcrumbs, p), 2)


def scored(df: DataFrame, content: str = "content", has_breadcrumbs: Column | None = None, p: Profile = Profile()) -> DataFrame:
    """``df`` with quality_flags, quality_score, has_title and completeness. The stripped text, its flags and the raw score are columns on the way, so
    each is worked out once a row."""
    c, raw, has_breadcrumbs = "__stripped", "__raw", F.lit(False) if has_breadcrumbs is None else has_breadcrumbs
    out = df.withColumn(c, _stripped(F.col(content)))
    out = out.withColumns({"quality_flags": _flags(F.col(c), has_breadcrumbs, p), "has_title": _titled(F.col(c))})
    out = out.withColumns({raw: _raw(F.col(c), F.col("quality_flags"), has_breadcrumbs, p), "completeness": completeness(F.col("quality_flags"))})
    return out.withColumn("quality_score", round_python(F.col(raw), 2)).drop(c, raw)


def completeness(f: Column) -> Column:
    return F.when(F.array_contains(f, "EMPTY"), "empty").when(F.array_contains(f, "FRAGMENT"), "partial").otherwise("complete")


def noise_ratio(text: Column) -> Column:
    """Share of characters beyond ASCII letters, digits and white space; the divisor counts UTF-16 units."""
    units = F.length(F.encode(text, "UTF-16LE")) / 2
    return F.when(units > 0, F.length(F.regexp_replace(text, r"(?U)[a-zA-Z0-9\s]", "")) / units).otherwise(0.0)


def _verdict(visible: Column, noise: Column) -> Column:
    return F.when(visible < 50, "TEXT_TOO_SHORT").when(noise > 0.8, "EXCESSIVE_NOISE").when(noise > 0.5, "HIGH_NOISE_RATIO").otherwise("OK")


def _visible(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", ""))


def gate(text: Column) -> Column:
    """The verdict on a whole document."""
    return _verdict(_visible(text), noise_ratio(text))


def gated(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with noise and verdict; both regexes run once a row."""
    out = df.withColumns({"noise": noise_ratio(F.col(text)), "__visible": _visible(F.col(text))})
    return out.withColumn("verdict", _verdict(F.col("__visible"), F.col("noise"))).drop("__visible")


def band(score: Column) -> Column:
    return F.when(score >= 0.85, "excellent").when(score >= 0.70, "good").when(score < 0.70, "low")


#: The bands' lower and upper bounds.
BANDS = {"excellent": (0.85, None), "good": (0.70, 0.85), "low": (None, 0.70)}


def in_band(score: Column, name: str) -> Column:
    """Whether a score lies in a band; null scores lie in none."""
    low, high = BANDS[name]
    inside = F.lit(True) if low is None else score >= low
    return F.coalesce(inside if high is None else inside & (score < high), F.lit(False))


def coerce_falsy(df, columns: tuple[str, ...] = ("quality_score", "has_title", "token_count")):
    """Stores 0 and false as null, as the chunk table does."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(F.col(c), True) if kinds[c] == "boolean" else F.nullif(F.col(c), F.lit(0).cast(kinds[c])) for c in columns if c in kinds})
