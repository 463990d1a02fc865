"""The registered queries of the corpus operators, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode, encode
from .common import fresh_path
from .conversation import damage, repair_reports
from .html_text import extract_text
from .jaccard_join import jaccard_classes
from .line_dedup import SHINGLES, dedup_lines
from .mixing import mix_sources
from .pii import KINDS, learn_field, personal_spans, span_list
from .quality import quality_scores
from .search import search
from .spelling import corpus_words, spelling_forms
from .suffix_dedup import remove_repeats
from .token_output import token_index, write_tokens
from .url_filter import UrlModel, judge_urls, seed_labels


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected near-duplicate classes of documents by 5-word shingles at 0.8."""
    return jaccard_classes(_table(spark, sf_dir, "documents"), words=5, percent=80)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents replicated to source weights n ** 0.7, dealt out globally."""
    return mix_sources(_table(spark, sf_dir, "documents"), temperature=0.7, seed="mix")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written as Parquet lists in doc_id order, and read back."""
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, added_tokens=True)
    return token_index(spark, path)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the cascade's verdict."""
    return quality_scores(_table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document without the strings of 50 that smaller documents have."""
    return remove_repeats(_table(spark, sf_dir, "documents"), length=50)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines that stay, and the numbers of those that left."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return dedup_lines(docs, counts=True, shingles=SHINGLES, from_files=True)


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 100."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"), docs, k=10)


#: Of op8: rule and verdict.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, else trees trained on urls labelled by seed terms."""
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url")
    model = UrlModel(seed_labels(pages.where("url is not null")))
    return judge_urls(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids, and digest both."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return bpe_digests(decode(encode(docs, path, pattern), path, pattern))


def bpe_digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens and hashes of the ids and of the decoded bytes."""
    text = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base matches and all spans of personal data of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_spans(docs, learn_field(docs))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the corpus with its near words' number, its form and its root."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_forms(corpus_words(docs, least_length=6, least_n=5, drop=199), times=5)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_reports(damage(turns), turns)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_source_mixing, op3_token_output, op4_quality_rules, op5_html_text, op6_suffix_dedup, op7_line_dedup, op8_url_filter, op9_topk_search, op10_byte_bpe, op11_personal_data, op12_spelling_variants, op13_conversation_repair)}

_OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, CASE WHEN len(ws) = 0 THEN 1 ELSE greatest(len(ws) - 4, 1) + 1 END)) AS p FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, p, p + 4), ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
reps AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS rep_id FROM sets),
r AS (SELECT s.doc_id, g FROM s JOIN reps USING (doc_id) WHERE s.doc_id = rep_id),
shared AS (SELECT doc_id, g FROM r WHERE g IN (SELECT g FROM r GROUP BY g HAVING count(*) > 1)),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shared a JOIN shared b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT doc_id, rep_id FROM reps UNION SELECT rep_id, doc_id FROM reps),
reach AS (SELECT a AS x, a AS y FROM both_ways UNION SELECT x, b FROM reach JOIN both_ways ON y = a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(reps.rep_id, w.doc_id) AS rep_id,
       coalesce((SELECT min(y) FROM reach WHERE x = w.doc_id), w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reps ON reps.doc_id = w.doc_id
"""
_OP2_SQL = r"""
WITH RECURSIVE c AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.7) AS w FROM documents GROUP BY source),
t AS (SELECT sum(n)::DOUBLE AS n, sum(w) AS w FROM (SELECT * FROM c ORDER BY source)),
r AS (SELECT c.source, t.n * (c.w / t.w) / c.n AS rate FROM c, t),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 20)),
u AS (SELECT doc_id, source, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT u.doc_id, count(*) AS copies FROM u JOIN cdf ON u.source = cdf.source AND u.u >= cdf.c GROUP BY u.doc_id)
SELECT d.*, i::INTEGER AS copy_no, substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':' || i || ':mix'), 1, 16) AS shuffle_key
FROM (SELECT n.doc_id, unnest(range(copies)) AS i FROM n) x JOIN documents d ON d.doc_id = x.doc_id
"""
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_OP4_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS p FROM w),
g AS (SELECT doc_id, p, array_to_string(list_slice(ws, p, p + 4), ' ') AS g FROM i),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM again) GROUP BY doc_id),
l AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM l GROUP BY doc_id),
f AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
         coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words,
         len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]'))) AS n_letter_words
  FROM w LEFT JOIN lines ON lines.doc_id = w.doc_id LEFT JOIN covered ON covered.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 12 * n_words OR 100 * n_letter_words < 70 * n_words
            OR 100 * n_dup_lines > 40 * n_lines OR 100 * n_upper > 40 * word_chars) AS kept
FROM b
"""
_OP9_SQL = rf"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM documents),
tf AS (SELECT doc_id, w, count(*) AS tf FROM w GROUP BY doc_id, w),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
n AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(dl) FROM dl)::DOUBLE / (SELECT count(*) FROM documents) AS avg_len),
s AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * dl / avg_len)) ORDER BY q.w), 6) AS score
  FROM tf q JOIN tf d ON q.w = d.w JOIN df ON df.w = q.w JOIN dl ON dl.doc_id = d.doc_id, n WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, d.doc_id)
SELECT query_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
ORACLE_SQL = {"op1_ngram_jaccard_join": _OP1_SQL, "op2_source_mixing": _OP2_SQL, "op4_quality_rules": _OP4_SQL, "op9_topk_search": _OP9_SQL}
