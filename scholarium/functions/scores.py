"""Column expressions over numbers and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products; the longer vector's rest does not count."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def library_similarity(sim: Column) -> Column:
    return F.bround(clamp(sim), 3)


def relevance(lib_sim: Column, topic_sim: Column | None = None) -> Column:
    """The library's similarity, or its geometric mean with the topic's where there is one."""
    if topic_sim is None:
        return lib_sim
    return F.when(topic_sim.isNull(), lib_sim).otherwise(F.coalesce(F.bround(F.sqrt(lib_sim * F.greatest(topic_sim, F.lit(0.0))), 3), lib_sim))


def influence(citations: Column) -> Column:
    """Citations on a scale from 0 to 1, which 400 of them reach."""
    return F.least(F.lit(1.0), F.sqrt(F.coalesce(citations, F.lit(0)).cast("double")) / 20.0)


def rank_score(relevance_: Column, citations: Column, year: Column, status: Column, year_now: int, weights: tuple[float, float, float] = (0.6, 0.25, 0.15)) -> Column:
    """Relevance (0.5 if unknown), influence and freshness, weighted; what the library has goes to the end."""
    rel = F.coalesce(relevance_.cast("double"), F.lit(0.5))
    fresh = F.when(F.coalesce(year, F.lit(0)) != 0, clamp(1 - (F.lit(year_now) - year) / 15.0)).otherwise(0.3)
    return F.bround(weights[0] * rel + weights[1] * influence(citations) + weights[2] * fresh - F.when(status.isin("have", "likely"), 1.0).otherwise(0.0), 4)


def quality(venue: Column, citations: Column, doi: Column) -> Column:
    """An ordered triple: a real venue, more citations, a shorter DOI."""
    v = F.lower(F.coalesce(venue, F.lit("")))
    return F.struct(((v != "") & ~v.isin("figshare", "zenodo")).alias("real"), F.coalesce(citations, F.lit(0)).alias("cited"), (-F.length(F.coalesce(doi, F.lit("")))).alias("short"))
