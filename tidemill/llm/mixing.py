"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import free_name

#: Above this mean a Poisson count is drawn as a sum of parts with smaller means, so that exp(-mean) stays exact.
_LARGEST_MEAN = 16.0
_STEPS = 64


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts alone: the first 52 bits of an MD5 digest."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def poisson_count(u: Column, mean: Column) -> Column:
    """The inverse of the Poisson distribution function: how many of P(N <= 0), P(N <= 1), ... are at most u."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("n"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k.cast("double")
        return F.struct(p.alias("p"), (s["cdf"] + p).alias("cdf"), (s["n"] + F.when(s["cdf"] <= u, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), start, step, lambda s: s["n"])


def repetition_rates(documents: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, temperature: float = 2.0, total: float | None = None) -> DataFrame:
    """(source, n, mean): each source's rows and its mean repetition rate, total x weight / rows.

    weights: wanted shares by source, which are scaled to sum to 1; sources without one get none. By default the
    share of a source is its own share to the power 1 / temperature, which raises small sources. total: rows of the
    mixture, by default as many as there are. A null source is a source of its own.
    """
    sizes = documents.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        wanted = F.pow(F.col("n").cast("double"), F.lit(1.0 / temperature))
    else:
        pairs = [x for s, w in weights.items() for x in (F.lit(s), F.lit(float(w)))]
        wanted = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0)
    sizes = sizes.withColumn("wanted", wanted)
    sums = sizes.agg(F.sum("n").cast("double").alias("rows"), F.sum("wanted").alias("all_wanted"))
    rows = F.lit(float(total)) if total is not None else F.col("rows")
    mean = F.when(F.col("all_wanted") > 0, rows * F.col("wanted") / F.col("all_wanted") / F.col("n")).otherwise(0.0)
    return sizes.crossJoin(F.broadcast(sums)).select("source", "n", mean.alias("mean"))


def mix_sources(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, temperature: float = 2.0, total: float | None = None, seed: str = "mix", most_sources: int = 100_000) -> DataFrame:
    """Each document as often as its Poisson count says, in a globally shuffled order: the columns of documents,
    then _copy (from 1) and _place (the hash that orders the mixture).

    The count of a document depends on the seed, its id and its source's mean alone, so that a lost task gives
    the same again; rows with the same id and source share their count, null ids count as one id. Means above 16
    are drawn as whole rounds of 16 plus a rest, each from its own uniform number. The rates are a row per source:
    they are broadcast when there are at most most_sources, else joined. An empty table gives an empty mixture.
    Extra columns, whatever their names, stay, but for _copy and _place, which are replaced; texts, empty, null or long, are
    never looked at.
    """
    source, mean, count = (free_name(documents, x) for x in ("_source", "_mean", "_count"))
    rates = repetition_rates(documents, source_col, weights, temperature, total).select(F.col("source").alias(source), F.col("mean").alias(mean))
    few = rates.limit(most_sources + 1).count() <= most_sources
    joined = documents.join(F.broadcast(rates) if few else rates, F.col(source_col).cast("string").eqNullSafe(F.col(source)))
    rounds = F.floor(F.col(mean) / _LARGEST_MEAN).cast("int")
    rest = F.col(mean) - rounds * F.lit(_LARGEST_MEAN)
    draw = lambda part, mean: poisson_count(uniform(seed, F.col(id_col), part), mean)
    more = F.when(rounds > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), F.lit(0), lambda a, r: a + draw(r, F.lit(_LARGEST_MEAN)))).otherwise(0)
    counted = joined.withColumn(count, draw(F.lit(0), rest) + more).filter(F.col(count) > 0).drop(source, mean)
    copies = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(count)))).drop(count)
    placed = copies.withColumn("_place", F.md5(F.concat_ws(":", F.lit(seed), F.lit("place"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("_copy").cast("string"))))
    # A partition chosen by a hash of the place and the order within it by the place itself: a uniform permutation
    # in one exchange, without the second scan that a range partitioning samples.
    return placed.repartition("_place").sortWithinPartitions("_place")


def op10_source_mixing(spark, sf_dir: str) -> DataFrame:
    """The mixture of all documents by source at temperature 2: every document's columns, _copy and _place."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_OP10 = r"""
WITH RECURSIVE size AS (SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS wanted FROM documents GROUP BY source),
rate AS (SELECT source, (SELECT sum(n) FROM size)::DOUBLE * wanted / (SELECT sum(wanted) FROM size) / n AS mean FROM size),
step AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM rate
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM step WHERE k < 63),
drawn AS (SELECT d.*, CAST('0x' || substr(md5('mix:' || doc_id || ':0'), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0 AS u FROM documents d),
counted AS (SELECT doc_id, text, lang, d.source, n_chars, (SELECT count(*) FROM step s WHERE s.source = d.source AND s.cdf <= d.u) AS c FROM drawn d)
SELECT doc_id, text, lang, source, n_chars, CAST(i AS INTEGER) AS _copy, md5('mix:place:' || doc_id || ':' || i) AS _place
FROM counted, LATERAL (SELECT unnest(range(1, c + 1)) AS i) WHERE c > 0
"""
