"""Vocabulary biasing: terms against a model's pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rx import S


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    """id, piece of `<token> <id>` lines; a line without an id takes the slot after the highest so far."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), F.trim("value").alias("v")).where("v <> ''")
    piece, num = F.regexp_extract("v", r"^(.+) (-?\d+)\S*$", 1), F.regexp_extract("v", r"^(.+) (-?\d+)\S*$", 2)
    t = lines.select("n", F.when(num != "", piece).otherwise(F.col("v")).alias("piece"), F.when(num != "", num.cast("int")).alias("id"))
    # slots grow by one for each line without an id since the highest id: a vocabulary file is small
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("base", F.coalesce(F.max("id").over(w), F.lit(-1)))
    g = Window.partitionBy("base").orderBy("n")
    return t.select(F.coalesce("id", (F.col("base") + F.sum(F.col("id").isNull().cast("int")).over(g)).cast("int")).alias("id"), "piece")


def tokenize_terms(terms: DataFrame, vocab: DataFrame, term: str = "term", out: str = "ids") -> DataFrame:
    """Greedy longest pieces of each word behind a word mark; null where a character has none, or where there is no word.

    All parts of the distinct words meet the pieces in an equi-join, whatever the size of the
    vocabulary; the longest one at each place stays, and a word is walked from place to place.
    Of pieces spelt alike the highest id counts.
    """
    t = terms.select(F.col(term).alias("t")).distinct()
    words = t.select("t", F.posexplode(F.filter(F.split("t", f"{S}+"), lambda w: w != "")).alias("at", "w")).withColumn("w", F.concat(F.lit("▁"), "w"))
    known = vocab.groupBy("piece").agg(F.max("id").alias("id"), F.first(F.length("piece")).alias("n"))
    lengths = F.broadcast(known.agg(F.collect_set("n").alias("lengths")))  # one row: the pieces' lengths
    parts = words.select("w").distinct().join(lengths).select("w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("p"), "lengths")
    parts = parts.select("w", "p", F.explode(F.filter("lengths", lambda n: n <= F.length("w") - F.col("p") + 1)).alias("n")).withColumn("piece", F.substring(F.col("w"), F.col("p"), F.col("n")))
    longest = parts.join(known.select("piece", "id"), "piece").groupBy("w", "p").agg(F.max(F.struct("n", "id")).alias("best"))
    held = longest.groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("p", "best"))).alias("best"))
    # at: the place to go on from, 0 where no piece fits
    step = lambda x, p: F.when(x["at"] != p, x).otherwise(_walked(x, p, F.element_at(F.col("best"), p)))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("ids"))
    cut = held.select("w", F.aggregate(F.sequence(F.lit(1), F.length("w")), start, step).alias("x")).select("w", F.when(F.col("x.at") > 0, F.col("x.ids")).alias("ids"))
    whole = words.join(cut, "w", "left").groupBy("t").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("x"))
    ids = F.when(~F.exists("x", lambda e: e["ids"].isNull()), F.flatten(F.transform("x", lambda e: e["ids"]))).alias("_ids")
    found = whole.select(F.col("t").alias("_term"), ids)
    return terms.join(found, F.col(term) == F.col("_term"), "left").select(*(F.col(c) for c in terms.columns if c != out), F.col("_ids").alias(out))


def _walked(x: Column, p: Column, best: Column) -> Column:
    at = F.when(best.isNull(), 0).otherwise(p + best["n"])
    return F.struct(at.cast("int").alias("at"), F.when(best.isNull(), x["ids"]).otherwise(F.array_append(x["ids"], best["id"].cast("int"))).alias("ids"))


def start_branching(vocab: DataFrame) -> DataFrame:
    """id, piece, n: how many pieces start with the piece; by prefixes and an equi-join."""
    prefixes = vocab.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("piece")), lambda k: F.substring(F.col("piece"), F.lit(1), k))).alias("piece"))
    return vocab.join(prefixes.groupBy("piece").agg(F.count("*").alias("n")), "piece").select("id", "piece", "n")


def bias_terms(terms: DataFrame, vocab: DataFrame, most: int = 8) -> DataFrame:
    """term, accepted, rejected and the id sequences of its accepted spellings."""
    t = terms.select(F.trim("term").alias("term")).where("term <> ''").distinct()
    capital = F.concat(F.upper(F.substring("term", 1, 1)), F.substring("term", 2, 2**31 - 1))
    v = t.select("term", F.explode(F.array_distinct(F.when(F.col("term") == F.lower("term"), F.array(F.col("term"), capital)).otherwise(F.array("term")))).alias("variant"))
    v = tokenize_terms(v, vocab, "variant").where("ids is not null").withColumn("start", F.get("ids", F.lit(0)))
    v = v.join(start_branching(vocab).select(F.col("id").alias("start"), "n"), "start")
    g = v.groupBy("term").agg(F.sum((F.col("n") <= most).cast("int")).alias("good"), F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.col("ids")))).alias("sequences"))
    return t.join(g, "term", "left").select("term", F.coalesce(F.col("good") > 0, F.lit(False)).alias("accepted"), F.coalesce(F.col("good") == 0, F.lit(False)).alias("rejected"), F.coalesce("sequences", F.array().cast("array<array<int>>")).alias("sequences"))


def bias_trie_edges(sequences: DataFrame, ids: str = "ids") -> DataFrame:
    """prefix (ids so far), next_id, terminal: whether a sequence ends there."""
    e = sequences.select(F.col(ids).alias("ids"), F.posexplode(ids).alias("p", "next_id"))
    e = e.select(F.array_join(F.slice("ids", 1, F.col("p")).cast("array<string>"), ",").alias("prefix"), "next_id", (F.col("p") + 1 == F.size("ids")).alias("end"))
    return e.groupBy("prefix", "next_id").agg(F.max("end").alias("terminal"))


def biased_argmax(logits: DataFrame, boosts: DataFrame, blank: int = 0, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """The token of each frame of (frame, token, logit) rows, with (frame, token, boost) added.

    Blank stays where it wins without boosts; the smallest token wins ties.
    """
    j = logits.join(boosts, [*keys, "token"], "left")
    best = lambda v: F.max(F.struct(v.alias("v"), (-F.col("token")).alias("t")))["t"]
    g = j.groupBy(*keys).agg((-best(F.col("logit"))).alias("plain"), (-best(F.col("logit") + F.coalesce("boost", F.lit(0.0)))).alias("biased"))
    return g.select(*keys, F.when(F.col("plain") == blank, F.col("plain")).otherwise(F.col("biased")).alias("token"))


def bias_sweep(logits: DataFrame, boosted: DataFrame, strengths: list[float], blank: int = 0, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """biased_argmax for each boost value; boosted has (frame, token, factor)."""
    values = F.explode(F.array(*map(F.lit, strengths))).alias("strength")
    b = boosted.select("*", values).select(*keys, "token", "strength", (F.col("strength") * F.col("factor")).alias("boost"))
    return biased_argmax(logits.select("*", values), b, blank, (*keys, "strength"))
