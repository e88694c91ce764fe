"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source's target weight gives a mean repetition rate for its documents. A uniform number
hashed from the seed and the document inverts the Poisson distribution of that mean; the
document is exploded into as many copies, and all copies are dealt out and sorted by a hash of
their own, whose even spread needs no sampling.
Rate, counts and order depend on nothing but the rows and the seed, so that a lost task repeats
exactly what it did.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise

#: A larger mean is met by the sum of independent draws of at most this mean each.
PIECE = 16.0
#: Terms of a piece's distribution; beyond them lies less than 2**-52 for means up to PIECE.
TERMS = 60
#: Bytes of the sources' names and numbers up to which they are broadcast.
BROADCAST_BYTES = 64 << 20


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5 of the parts joined by colons."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k in 0..TERMS-1 as an array."""
    first = F.exp(-mean)
    start = F.struct(first.alias("term"), first.alias("sum"), F.array(first).alias("cdf"))
    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * mean / k
        total = acc["sum"] + term
        return F.struct(term.alias("term"), total.alias("sum"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))
    ks = F.sequence(F.lit(1), F.lit(TERMS - 1))
    return F.aggregate(ks, start, step, lambda acc: acc["cdf"])


def source_rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """One row a source: source, n_docs, rate. The result is to hold epochs * rows, shared among
    the sources by `weights` (a source that it lacks gets weight 0), or else in proportion to
    n_docs ** alpha."""
    counts = materialise(docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_docs")), "source-counts")
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(alpha)))
    else:
        known = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
        counts = counts.withColumn("weight", F.coalesce(F.when(F.col("source").isNotNull(), F.try_element_at(known, F.col("source"))), F.lit(0.0)).cast("double"))
    totals = counts.agg(F.sum("n_docs").alias("n"), F.sum("weight").alias("w")).first()
    rows, weight = totals["n"] or 0, totals["w"] or 1.0
    return counts.select("source", "n_docs", (F.col("weight") / F.lit(float(weight)) * F.lit(float(rows) * epochs) / F.col("n_docs")).alias("rate"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """Every column of docs, with rate double, copy int (from 1) and shuffle_key string (these
    replace columns of docs of the same names), one row for each copy, in order of shuffle_key.

    Sources whose names and numbers are of no more than BROADCAST_BYTES are broadcast; more are
    joined to documents that are spread over the salts of their source. Null sources form a source
    of their own; a null id hashes as the word null, and such rows go anywhere in the order;
    repeated rows get equal counts; null and empty texts are replicated as any others; an empty
    table gives an empty result.
    """
    key, cdf, pieces, salt = (free_name(docs, x) for x in ("source", "cdf", "pieces", "salt"))
    docs = docs.drop("rate", "copy", "shuffle_key")
    rates = source_rates(docs, source, weights, alpha, epochs)
    rates = rates.select(F.col("source").alias(key), "rate", F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int").alias(pieces))
    size = rates.agg(F.sum(F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + 8 * TERMS + 64)).first()[0] or 0
    rates = rates.withColumn(cdf, poisson_cdf(F.col("rate") / F.col(pieces)))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    def draw(j: Column) -> Column:
        return F.size(F.filter(F.col(cdf), lambda c: c <= hashed_uniform(F.lit(str(seed)), ident, j.cast("string"))))
    if size <= BROADCAST_BYTES:
        joined = docs.join(F.broadcast(rates), docs[source].eqNullSafe(rates[key]), "inner")
    else:
        salts = 64
        rates = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = docs.withColumn(salt, F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int"))
        joined = salted.join(rates, salted[source].eqNullSafe(rates[key]) & (salted[salt] == rates[salt]), "inner").drop(salt)
    times = F.aggregate(F.transform(F.sequence(F.lit(1), F.col(pieces)), draw), F.lit(0), lambda a, x: a + x)
    n = free_name(docs, "n")
    copies = joined.withColumn(n, times).where(F.col(n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(n))))
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), ident, F.col("copy").cast("string")))
    out = copies.withColumn("shuffle_key", order).drop(key, cdf, pieces, n)
    # the key is evenly spread: its first digits tell its place among the partitions
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long")
    place = F.when(F.col(id_col).isNotNull(), named).otherwise(F.pmod(F.xxhash64(*[c for c in docs.columns if not _has_map(docs, c)], "copy"), F.lit(1 << 32)))
    return out.repartitionById(parts, F.floor(place * parts / (1 << 32)).cast("int")).sortWithinPartitions("shuffle_key")


def _has_map(docs: DataFrame, column: str) -> bool:
    """Spark hashes no maps."""
    return "map<" in docs.schema[column].dataType.simpleString()
