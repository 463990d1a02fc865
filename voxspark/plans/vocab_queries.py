"""Queries of vocabulary biasing, over pieces and terms from part names and brands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vocab as v
from ..sources.files import work_path
from .registry import query
from .text_queries import table

_PIECES = """(SELECT piece, (row_number() OVER (ORDER BY piece))::INTEGER AS id FROM (SELECT DISTINCT piece FROM (
SELECT '▁' || w[:k] AS piece FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part), (SELECT unnest(range(1, 5)) AS k) UNION ALL SELECT unnest(string_split(lower(p_name), '')) FROM part) WHERE trim(piece) <> ''))"""


def pieces(spark, sf_dir):
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part").select(F.lower("p_name").alias("n"))
    starts = p.select(F.explode(F.split("n", " ")).alias("w")).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.concat(F.lit("▁"), F.substring(F.col("w"), F.lit(1), k)))).alias("piece"))
    d = starts.unionAll(p.select(F.explode(F.split("n", "")))).where(F.trim("piece") != "").distinct()
    return d.select("piece", F.row_number().over(Window.orderBy(F.col("piece").cast("binary"))).alias("id"))


@query(f"SELECT id, piece FROM {_PIECES}")
def e01_load_vocab(spark, sf_dir):
    path = work_path(spark, "vocab")
    pieces(spark, sf_dir).select(F.concat_ws(" ", "piece", F.col("id").cast("string")).alias("value")).write.text(path)
    return v.load_vocab(spark, path)


@query("SELECT p_partkey, lower(p_name) AS spelt FROM part")
def e02_tokenize_terms(spark, sf_dir):
    """Pieces put together again spell the term."""
    voc = pieces(spark, sf_dir)
    t = v.tokenize_terms(table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("term")), voc)
    r = t.select("p_partkey", F.posexplode("ids").alias("i", "id")).join(voc, "id").groupBy("p_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda x: x["piece"]), "").alias("s"))
    return r.select("p_partkey", F.trim(F.regexp_replace("s", "▁", " ")).alias("spelt"))


_TERMS = "(SELECT DISTINCT CASE WHEN p_partkey % 11 = 0 THEN lower(p_name) || ' ž' WHEN p_partkey % 13 = 0 THEN '' ELSE lower(p_name) END AS term FROM part)"


def _odd_terms(spark, sf_dir):
    k, name = F.col("p_partkey"), F.lower("p_name")
    return table(spark, sf_dir, "part").select(F.when(k % 11 == 0, F.concat(name, F.lit(" ž"))).when(k % 13 == 0, "").otherwise(name).alias("term")).distinct()


_IDS_SQL = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT * FROM {_PIECES}), t AS MATERIALIZED (SELECT term, unnest(list_filter(string_split(term, ' '), lambda w: w <> '')) AS w, unnest(range(len(list_filter(string_split(term, ' '), lambda w: w <> '')))) AS i FROM {_TERMS}),
d AS (SELECT DISTINCT '▁' || w AS w FROM t),
m AS MATERIALIZED (SELECT d.w, k, max(length(p.piece)) AS n FROM d, unnest(range(1, length(d.w) + 1)) x(k), p WHERE starts_with(d.w[k:], p.piece) GROUP BY d.w, k),
r AS (SELECT w, 1::BIGINT AS pl, []::INTEGER[] AS ids FROM d UNION ALL SELECT r.w, r.pl + m.n, list_append(r.ids, p.id) FROM r JOIN m ON m.w = r.w AND m.k = r.pl JOIN p ON p.piece = r.w[r.pl:r.pl + m.n - 1]),
e AS (SELECT w, ids FROM r WHERE pl > length(w)),
i AS (SELECT z.term, CASE WHEN n = count(e.ids) AND n > 0 THEN flatten(list(e.ids ORDER BY i)) END AS ids
FROM (SELECT term, len(list_filter(string_split(term, ' '), lambda w: w <> '')) AS n FROM {_TERMS}) z LEFT JOIN t ON t.term = z.term LEFT JOIN e ON e.w = '▁' || t.w GROUP BY z.term, n)"""


@query(_IDS_SQL + " SELECT term, array_to_string(list_transform(ids, lambda x: x::VARCHAR), ' ') AS ids FROM i")
def e02_term_ids(spark, sf_dir):
    """The ids themselves; some terms have a character without a piece, or no word."""
    return v.tokenize_terms(_odd_terms(spark, sf_dir), pieces(spark, sf_dir)).select("term", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(f"WITH p AS (SELECT * FROM {_PIECES}) SELECT a.id, a.piece, count(*) AS n FROM p a JOIN p b ON starts_with(b.piece, a.piece) GROUP BY ALL")
def e03_start_branching(spark, sf_dir):
    return v.start_branching(pieces(spark, sf_dir))


@query()
def e04_bias_terms(spark, sf_dir):
    terms = table(spark, sf_dir, "part").select(F.lower("p_name").alias("term"))
    return v.bias_terms(terms, pieces(spark, sf_dir)).select("term", "accepted", "rejected", F.size("sequences").alias("n"))


@query(_IDS_SQL + """, b AS (SELECT a.id, count(*) AS n FROM p a JOIN p b ON starts_with(b.piece, a.piece) GROUP BY a.id), j AS (SELECT i.term, i.ids, b.n FROM i LEFT JOIN b ON b.id = i.ids[1] WHERE i.term <> '')
SELECT term, coalesce(n <= 4, false) AS accepted, coalesce(n > 4, false) AS rejected, CASE WHEN n <= 4 THEN array_to_string(list_transform(ids, lambda x: x::VARCHAR), ' ') ELSE '' END AS ids FROM j""")
def e04_known_bias_terms(spark, sf_dir):
    """Terms whose first piece starts at most four pieces, with their ids; capitals have no piece here."""
    t = v.bias_terms(_odd_terms(spark, sf_dir), pieces(spark, sf_dir), most=4)
    return t.select("term", "accepted", "rejected", F.array_join(F.flatten("sequences").cast("array<string>"), " ").alias("ids"))


def _sequences(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.array(k % 5, k % 7, k % 11).cast("array<int>").alias("ids"))


@query("""WITH s AS (SELECT [p_partkey % 5, p_partkey % 7, p_partkey % 11] AS ids FROM part), e AS (SELECT array_to_string(list_transform(ids[:p], lambda x: x::VARCHAR), ',') AS prefix, ids[p + 1]::INTEGER AS next_id, p = 2 AS t FROM s, (SELECT unnest([0, 1, 2]) AS p))
SELECT coalesce(prefix, '') AS prefix, next_id, bool_or(t) AS terminal FROM e GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1, 2"))
def e05_bias_trie_edges(spark, sf_dir):
    return v.bias_trie_edges(_sequences(spark, sf_dir))


_LOGITS = "(SELECT vec_id AS frame, unnest(range(1, 65))::INTEGER - 1 AS token, unnest(embedding)::DOUBLE AS logit FROM embeddings)"


def _logits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("token", "x")).select("frame", "token", F.col("x").cast("double").alias("logit"))


def _sweep_sql(strengths):
    values = ", ".join(f"{x}::DOUBLE" for x in strengths)
    return f"""WITH l AS (SELECT frame, token, logit, s AS strength, logit + CASE WHEN token = frame % 64 THEN s WHEN token = (frame + 7) % 64 THEN 2 * s ELSE 0 END AS b FROM {_LOGITS}, (SELECT unnest([{values}]) AS s)),
r AS (SELECT *, row_number() OVER (PARTITION BY frame, strength ORDER BY logit DESC, token) AS p, row_number() OVER (PARTITION BY frame, strength ORDER BY b DESC, token) AS q FROM l),
x AS (SELECT frame, strength, max(token) FILTER (p = 1) AS plain, max(token) FILTER (q = 1) AS biased FROM r GROUP BY 1, 2)
SELECT frame, strength, CASE WHEN plain = 0 THEN plain ELSE biased END AS token FROM x"""


def _boosted(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"))
    return e.select("frame", F.explode(F.array(F.struct((F.col("frame") % 64).cast("int").alias("token"), F.lit(1.0).alias("factor")), F.struct(((F.col("frame") + 7) % 64).cast("int").alias("token"), F.lit(2.0).alias("factor")))).alias("x")).select("frame", "x.token", "x.factor")


@query(_sweep_sql([0.1]).replace("SELECT frame, strength, CASE", "SELECT frame, CASE"))
def e06_biased_argmax(spark, sf_dir):
    b = _boosted(spark, sf_dir).select("frame", "token", (F.col("factor") * 0.1).alias("boost"))
    return v.biased_argmax(_logits(spark, sf_dir), b)


@query(_sweep_sql([0.0, 0.05, 0.2, 1.0]))
def e07_bias_sweep(spark, sf_dir):
    return v.bias_sweep(_logits(spark, sf_dir), _boosted(spark, sf_dir), [0.0, 0.05, 0.2, 1.0])
