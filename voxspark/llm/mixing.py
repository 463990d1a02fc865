"""Mixing sources to target weights by Poisson replication.

Each source gets a target repetition rate: its target share of the output over its
share of the input.  A document's uniform number comes from a seeded hash of its id;
inverting the Poisson distribution with the source's rate at that number gives how
often the document is repeated (0 times included).  Documents are exploded by the
count and dealt out globally by a hash of (id, copy).

Only the count per source is aggregated (with partial sums, so a hot source costs
nothing extra).  The rates reach the documents by a broadcast join where there are at
most `MAX_BROADCAST_SOURCES` of them, else by a salted join.

Defined results: a null source is a source of its own; a null id is hashed as an empty
string; repeated rows with one id get one count, and so equal numbers of copies; an
empty table gives an empty table; a rate over `MAX_RATE` raises ValueError.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_RATE = 500.0
MAX_BROADCAST_SOURCES = 50_000
SALTS = 32


def uniform(key: Column) -> Column:
    """[0, 1) from the first 52 bits of an md5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, source: str = "source", targets: Mapping[str | None, float] | None = None, temperature: float = 0.7, epochs: float = 1.0) -> DataFrame:
    """source, n, rate and cdf (array: P(count <= k) for k = 0, 1, ...).

    targets are relative weights by source, absent ones weigh 0; without targets a
    source's weight is its count to the power of temperature.  The expected size of the
    output is epochs times the input's.
    """
    counts = docs.groupBy(source).agg(F.count("*").alias("n"))
    if targets is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        pairs = [x for s, w in targets.items() if s is not None for x in (F.lit(s), F.lit(float(w)))]
        named = F.create_map(*pairs)[F.col(source)] if pairs else F.lit(None).cast("double")
        weight = F.coalesce(F.when(F.col(source).isNull(), F.lit(float(targets.get(None, 0.0)))), named, F.lit(0.0))
    counts = materialize(counts.withColumn("weight", weight), "source-counts")
    total = counts.agg(F.sum("n").alias("n"), F.sum("weight").alias("w")).first()
    n, w = float(total["n"] or 0), float(total["w"] or 0)
    rates = counts.withColumn("rate", F.lit(epochs * n) * (F.col("weight") / F.lit(w or 1.0)) / F.col("n"))
    if (top := rates.agg(F.max("rate")).first()[0]) and top > MAX_RATE:
        raise ValueError(f"a source would be repeated {top:.0f} times; at most {MAX_RATE:.0f} are supported")
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    first = F.exp(-F.col("rate"))
    fold = F.aggregate(
        F.sequence(F.lit(1), last), F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("cdf")),
        lambda s, k: F.struct((s["p"] * F.col("rate") / k).alias("p"), (s["c"] + s["p"] * F.col("rate") / k).alias("c"), F.concat(s["cdf"], F.array(s["c"] + s["p"] * F.col("rate") / k)).alias("cdf")),
        lambda s: s["cdf"])
    return rates.select(source, "n", "rate", fold.alias("cdf"))


def mix_sources(docs: DataFrame, targets: Mapping[str | None, float] | None = None, temperature: float = 0.7, epochs: float = 1.0, seed: str = "mix", source: str = "source", key: str = "doc_id") -> DataFrame:
    """All columns of docs, copy_no (0, 1, ...) and shuffle_key, by which rows are dealt out.

    Each partition is sorted by shuffle_key, which is independent of source and id.
    """
    rates = materialize(source_rates(docs, source, targets, temperature, epochs).select(F.col(source).alias("_mix_source"), F.col("cdf").alias("_mix_cdf")), "rates")
    if rates.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(rates), docs[source].eqNullSafe(F.col("_mix_source")))
    else:
        salted = docs.withColumn("_mix_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
        many = rates.withColumn("_mix_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(many, salted[source].eqNullSafe(many["_mix_source"]) & (salted["_mix_salt"] == many["_mix_salt"])).drop(many["_mix_salt"])
    ident = F.coalesce(F.col(key).cast("string"), F.lit(""))
    u = uniform(F.concat_ws(":", ident, F.lit(seed)))
    copies = F.size(F.filter("_mix_cdf", lambda c: F.col("_mix_u") >= c))
    out = joined.withColumn("_mix_u", u).withColumn("_mix_n", copies).where("_mix_n > 0")
    out = out.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col("_mix_n") - 1)).alias("copy_no"))
    out = out.withColumn("shuffle_key", F.substring(F.md5(F.concat_ws(":", ident, F.col("copy_no").cast("string"), F.lit(seed))), 1, 16))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
