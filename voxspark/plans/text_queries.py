"""Queries of the transcript text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spoken, text
from ..functions.pipeline import postprocess
from ..operators import dictionary
from . import spoken_forms as sf_
from .registry import query

_S = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_FILL = rf"regexp_replace(text, '(?i)\b(?:{'|'.join(text.FILLERS)})\b[,;]?{_S}*', '', 'g')"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df):
    """Deal rows out where the files give fewer partitions than there are cores (one small file); never at scale."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


def _apply(f):
    return lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", f(F.col("text")).alias("text"))


def _doubles_sql(x):
    for w in text.DOUBLES:
        x = rf"regexp_replace({x}, '(?i)\b({w}){_S}+{w}\b', '\1', 'g')"
    return x


def _tidy_sql(x):
    for a, b in ((r"\.{3,}", "…"), (f"{_S}*,{_S}*,", ","), (rf"{_S}*\.{_S}*\.", "."), (rf",{_S}*\.", "."), (rf"\.{_S}*,", "."), (f"{_S}+([.,;:!?…])", r"\1"), (f"([.,;:!?…]){_S}*([A-Z])", r"\1 \2"), ("…", "...")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


def _final_sql(x):
    t = f"regexp_replace(regexp_replace({x}, '{_S}{{2,}}', ' ', 'g'), '^{_S}+|{_S}+$', '', 'g')"
    return f"upper(substr({t}, 1, 1)) || substr({t}, 2)"


def _named(name, f, sql=None):
    f.__name__ = name
    query(sql)(f)


_named("a01_remove_fillers", _apply(text.remove_fillers), f"SELECT doc_id, {_FILL} AS text FROM documents")
_named("a02_collapse_stutters", _apply(text.collapse_stutters))
_named("a03_drop_false_starts", _apply(text.drop_false_starts))
_named("a04_collapse_restarts", _apply(text.collapse_restarts))
_named("a05_collapse_doubled_words", _apply(text.collapse_doubled_words), f"SELECT doc_id, {_doubles_sql('text')} AS text FROM documents")
_named("a06_tidy_punctuation", _apply(text.tidy_punctuation), f"SELECT doc_id, {_tidy_sql('text')} AS text FROM documents")
_named("a07_finalize_text", _apply(text.finalize_text), f"SELECT doc_id, {_final_sql('text')} AS text FROM documents")
_named("a08_clean_transcript", _apply(text.clean_transcript))



def _parts(spark, sf_dir, said, f):
    """f of a sentence with a known slip in it, which holds the part's number (%s)."""
    pick = F.element_at(F.array(*(F.format_string(x.replace("?", "%1$s"), F.col("p_partkey").cast("string")) for x in said)), (F.col("p_partkey") % len(said) + 1).cast("int"))
    # a column of its own, so that the rules don't repeat it
    return table(spark, sf_dir, "part").select("p_partkey", pick.alias("said")).select("p_partkey", f(F.col("said")).alias("text"))


def _known(name, f, cases):
    """A query of sentences (? stands for the part's number), with what is to become of them."""
    said, clean = zip(*cases, strict=True)
    to = ", ".join(f"'{x}'" for x in clean)
    sql = f"SELECT p_partkey, replace(list_extract([{to}], (p_partkey % {len(cases)} + 1)::INT), '?', p_partkey::VARCHAR) AS text FROM part"
    _named(name, lambda spark, sf_dir: _parts(spark, sf_dir, said, f), sql)


_known("a02_known_stutters", text.collapse_stutters,
       [("I-I-I want ? now", "I want ? now"), ("We-we took ? of the-the-the", "We took ? of the"), ("well-known ? stays co-op", "well-known ? stays co-op")])
_known("a03_known_false_starts", text.drop_false_starts,
       [("a pic picture of ?", "a picture of ?"), ("? and wan wanted ones", "? and wanted ones"), ("? in the then new way", "? in the then new way")])
_known("a04_known_restarts", text.collapse_restarts,
       [("i want ? i want ? today", "i want ? today"), ("we sold part ? we sold part ?", "we sold part ?"), ("i want ? you want ? today", "i want ? you want ? today")])
_known("a08_known_transcripts", text.clean_transcript,
       [("um, so the the part ? is , ready", "So the part ? is, ready"), ("i need ? i need ? by noon ..ok", "I need ? by noon.ok"), ("we-we  saw pic picture ?", "We saw picture ?")])


@query()
def flagship_cleanup_report(spark, sf_dir):
    """By language: rows, rows that clean-up changed, characters that it removed."""
    d = _docs(spark, sf_dir).withColumn("clean", text.clean_transcript(F.col("text")))
    # speech is asked in the sums: a filter would be pushed below, and clean up twice
    said = F.when(text.has_speech(F.col("clean")), 1)
    return d.groupBy("lang").agg(F.count(said).alias("rows"), F.sum(said * (F.col("clean") != F.col("text")).cast("long")).alias("changed"), F.sum(said * (F.length("text") - F.length("clean"))).alias("chars_removed"))


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")


def _said(name, build, f, sql, source="orders"):
    """A round trip: f over sentences that build makes of numbers; sql writes them down directly."""
    key = "o_orderkey" if source == "orders" else "p_partkey"

    def run(spark, sf_dir):
        # a column of its own, so that rules that name their input several times don't repeat it
        return spread(table(spark, sf_dir, source).select(key, build().alias("said"))).select(key, f(F.col("said")).alias("written"))

    _named(name, run, f"SELECT {key}, {sql} AS written FROM {source}")




def _k():
    return F.col("o_orderkey")


_N = "(o_orderkey * 7919 % 1000000)"
_said("a09_spoken_punctuation", lambda: F.concat(F.lit("order "), _k().cast("string"), F.lit(" comma ship it to dock "), (_k() % 9).cast("string"), F.lit(" period then call mail dot site"), (_k() % 5).cast("string"), F.lit(" dot com exclamation mark new line done question mark write to x at sign y colon "), F.lit("a hyphen b")),
      spoken.spoken_punctuation, "'order ' || o_orderkey || ', ship it to dock ' || (o_orderkey % 9) || '. Then call mail.site' || (o_orderkey % 5) || '.com' || chr(10) || 'Done? Write to x@y: a-b'")
_said("a10_itn_punctuation", lambda: F.concat(F.lit("item open paren "), _k().cast("string"), F.lit(" close paren comma he said open quote go close quote full stop new paragraph. next dash "), (_k() % 7).cast("string"), F.lit(" semi colon end exclamation point")),
      text.itn_punctuation, "'item (' || o_orderkey || '), he said \"go\".' || chr(10) || chr(10) || 'next - ' || (o_orderkey % 7) || '; end!'")
_said("a11_number_words", lambda: sf_.words(_k() * 7919 % 1000000), spoken.number_words_to_int, f"{_N}::BIGINT")
_said("a12_itn_currency", lambda: F.concat(F.lit("pay "), sf_.words(F.col("o_totalprice").cast("long") % 1000), F.when(_k() % 3 == 0, " euros").when(_k() % 3 == 1, " dollars").otherwise(" pounds"), F.when(_k() % 2 == 0, F.concat(F.lit(" and "), sf_.words(_k() % 99 + 1), F.when(_k() % 3 == 2, " pence").otherwise(" cents"))).otherwise(""), F.lit(" now")),
      spoken.itn_currency, "'pay ' || CASE o_orderkey % 3 WHEN 0 THEN '€' WHEN 1 THEN '$' ELSE '£' END || (trunc(o_totalprice)::BIGINT % 1000) || CASE WHEN o_orderkey % 2 = 0 THEN '.' || lpad((o_orderkey % 99 + 1)::VARCHAR, 2, '0') ELSE '' END || ' now'")
_said("a13_itn_times", lambda: F.concat(F.lit("at "), sf_.words(_k() % 12 + 1), F.when(_k() % 4 == 0, " thirty").when(_k() % 4 == 1, " fifteen").when(_k() % 4 == 2, " forty five").otherwise(""), F.when(_k() % 2 == 0, " pm").otherwise(" a.m.")),
      spoken.itn_times, "'at ' || (o_orderkey % 12 + 1) || CASE o_orderkey % 4 WHEN 0 THEN ':30' WHEN 1 THEN ':15' WHEN 2 THEN ':45' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN ' PM' ELSE ' AM' END || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '' END")


def _day():
    return F.dayofmonth("o_orderdate")


_said("a14_itn_dates", lambda: F.when(_k() % 2 == 0, F.concat(F.lit("on "), F.lower(F.date_format("o_orderdate", "MMMM")), F.lit(" "), sf_.ordinal(_day()))).otherwise(F.concat(F.lit("on the "), sf_.ordinal(_day()), F.lit(" of "), F.date_format("o_orderdate", "MMMM"))),
      spoken.itn_dates, "'on ' || strftime(o_orderdate, '%B') || ' ' || day(o_orderdate)")
_ORD_SQL = "n || CASE WHEN n % 100 IN (11, 12, 13) THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'the ' || {_ORD_SQL} || ' floor' WHEN n < 10 THEN 'the ' || word || ' time' ELSE 'the ' || {_ORD_SQL} || ' time' END AS written FROM (SELECT p_partkey, p_size AS n, list_extract(['first','second','third','fourth','fifth','sixth','seventh','eighth','ninth'], p_size) AS word FROM part)")
def a15_itn_ordinals(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    said = F.concat(F.lit("the "), sf_.ordinal(F.col("p_size")), F.when(F.col("p_partkey") % 4 == 0, " floor").otherwise(" time"))
    return p.select("p_partkey", spoken.itn_ordinals(said).alias("written"))


_said("a16_itn_cardinals", lambda: F.concat(F.lit("we counted "), sf_.words(_k() * 7919 % 1000000), F.lit(" of them")), spoken.itn_cardinals,
      "'we counted ' || CASE WHEN n < 10 THEN list_extract(['zero','one','two','three','four','five','six','seven','eight','nine'], n + 1) ELSE n::VARCHAR END || ' of them'".replace("n + 1", f"({_N} + 1)::INT").replace("n < 10", f"{_N} < 10").replace("n::VARCHAR", f"{_N}::VARCHAR"))
_said("a17_group_digits", lambda: F.concat(F.lit("a $"), (_k() * 7919).cast("string"), F.lit(" b "), (_k() * 104729).cast("string"), F.lit(" c 1.5000000 d "), (_k() % 90000).cast("string")), spoken.group_digits,
      "'a $' || CASE WHEN o_orderkey * 7919 > 999 THEN format('{:,}', o_orderkey * 7919) ELSE (o_orderkey * 7919)::VARCHAR END || ' b ' || CASE WHEN o_orderkey * 104729 > 99999 THEN format('{:,}', o_orderkey * 104729) ELSE (o_orderkey * 104729)::VARCHAR END || ' c 1.5000000 d ' || (o_orderkey % 90000)")
_said("a18_apply_itn", lambda: F.concat(F.lit("send "), sf_.words(F.lit(1000) + _k() * 7919 % 999000), F.lit(" dollars by "), sf_.words(_k() % 12 + 1), F.lit(" thirty pm on "), F.lower(F.date_format("o_orderdate", "MMMM")), F.lit(" "), sf_.ordinal(_day()), F.lit(" for "), sf_.words(_k() % 90 + 10), F.lit(" people")), spoken.apply_itn,
      "'send $' || format('{:,}', 1000 + o_orderkey * 7919 % 999000) || ' by ' || (o_orderkey % 12 + 1) || ':30 PM on ' || strftime(o_orderdate, '%B') || ' ' || day(o_orderdate) || ' for ' || (o_orderkey % 90 + 10) || ' people'")


@query(r"SELECT doc_id, lang FROM documents WHERE regexp_matches(regexp_replace(text, '[a-z]', '', 'g'), '[\p{L}\p{N}]')")
def a19_has_speech(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("t", F.regexp_replace("text", "[a-z]", ""))
    return d.where(text.has_speech(F.col("t"))).select("doc_id", "lang")


SPOKEN_ORDERS_SQL = "SELECT o_orderkey, 'Pay $' || (o_orderkey % 900 + 100) || ', and then ship ' || (o_orderkey % 90 + 10) || ' boxes. Done' AS text FROM orders WHERE o_orderkey % 4 <> 3"


def spoken_orders(spark, sf_dir):
    """o_orderkey, text: with fillers, a restart, spoken marks and numbers; every fourth text holds no word."""
    said = F.concat(F.lit("um, pay "), sf_.words(_k() % 900 + 100), F.lit(" dollars comma and then uh and then ship "), sf_.words(_k() % 90 + 10), F.lit(" boxes period done"))
    return spread(_orders(spark, sf_dir).select("o_orderkey", F.when(_k() % 4 == 3, " ... ").otherwise(said).alias("text")))


@query(SPOKEN_ORDERS_SQL)
def a20_postprocess(spark, sf_dir):
    return postprocess(spoken_orders(spark, sf_dir), spoken=True)


def _entries(spark, sf_dir):
    """Dictionary rows from part names: a name, its words joined, and variants of it."""
    p = spread(table(spark, sf_dir, "part"))
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("original"), F.concat(F.lit("X-"), F.col("p_partkey").cast("string")).alias("replacement"),
                    text.generate_variants(F.col("p_name")).alias("variants"), F.timestamp_seconds("p_partkey").alias("created_at"))


@query("""WITH w AS (SELECT p_partkey, p_name AS o, lower(p_name) AS l, regexp_split_to_array(lower(p_name), '[\\s-]+') AS w, CASE WHEN contains(p_name, '-') THEN '-' ELSE ' ' END AS sep FROM part),
v AS (SELECT p_partkey, o, unnest([l, upper(o), replace(o, '-', ' '), regexp_replace(o, '\\s', '-', 'g'), lower(regexp_replace(o, '[\\s-]', '', 'g')), upper(regexp_replace(o, '[\\s-]', '', 'g')),
  array_to_string(list_transform(string_split(l, ' '), lambda x: array_to_string(list_transform(string_split(x, '-'), lambda y: upper(y[1]) || y[2:]), '-')), ' ')]
  || CASE WHEN len(w) >= 2 THEN [CASE WHEN sep = '-' THEN array_to_string([upper(w[1])] || w[2:], '-') ELSE array_to_string([upper(w[1])] || w[2:], ' ') END, CASE WHEN sep = '-' THEN array_to_string([upper(w[1][1]) || w[1][2:]] || w[2:], '-') ELSE array_to_string([upper(w[1][1]) || w[1][2:]] || w[2:], ' ') END, CASE WHEN sep = '-' THEN array_to_string(w[:-2] || [upper(w[-1])], '-') ELSE array_to_string(w[:-2] || [upper(w[-1])], ' ') END] ELSE [] END
  || CASE WHEN len(w) >= 3 THEN [CASE WHEN sep = '-' THEN array_to_string(list_transform(w[:-2], lambda x: upper(x)) || [w[-1]], '-') ELSE array_to_string(list_transform(w[:-2], lambda x: upper(x)) || [w[-1]], ' ') END] ELSE [] END) AS v FROM w)
SELECT p_partkey, array_to_string(list_sort(list(DISTINCT v)), '|') AS variants FROM v WHERE v <> o GROUP BY p_partkey""")
def a21_generate_variants(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(text.generate_variants(F.col("p_name"))), "|").alias("variants"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\bthe\b', 'TheFixed', 'g'), '(?i)\bde la\b', 'DeLa', 'g') AS text FROM documents")
def a22_apply_dictionary(spark, sf_dir):
    fix = dictionary.dictionary_udf([("the", "TheFixed", []), ("de la", "DeLa", [])])
    return _docs(spark, sf_dir).select("doc_id", fix(F.col("text")).alias("text"))


_SHIPPED = """SELECT l_orderkey || ':' || l_linenumber AS doc_id, 'ship X-' || k || ' today' AS text FROM lineitem JOIN part ON l_partkey = p_partkey
JOIN (SELECT p_name AS o, min(p_partkey) AS k FROM part GROUP BY p_name) n ON n.o = p_name"""


def _shipped(spark, sf_dir):
    said = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return said.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("doc_id"), F.concat(F.lit("ship "), F.lower("p_name"), F.lit(" today")).alias("text"))


@query(_SHIPPED)
def a22_apply_large_dictionary(spark, sf_dir):
    """Of entries with one original the first one is applied, to every line item."""
    return dictionary.apply_dictionary(_shipped(spark, sf_dir), _entries(spark, sf_dir))


@query(_SHIPPED)
def a22_join_large_dictionary(spark, sf_dir):
    """The same by joins, as for dictionaries beyond the size of an automaton."""
    return dictionary.apply_dictionary(_shipped(spark, sf_dir), _entries(spark, sf_dir), automaton_chars=0)


@query("""WITH e AS (SELECT p_partkey::VARCHAR AS id, p_name AS original, 'X-' || p_partkey AS replacement FROM part),
i AS (SELECT 'i' || p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE 'New ' || p_name END AS original, 'Y-' || p_partkey AS replacement FROM part)
SELECT * FROM e UNION ALL SELECT * FROM i WHERE original <> '' AND NOT EXISTS (SELECT 1 FROM e WHERE lower(e.original) = lower(i.original))""")
def a23_merge_dictionary(spark, sf_dir):
    e = _entries(spark, sf_dir)
    n = F.col("id").cast("long")
    said = F.when(n % 5 == 0, "").when(n % 2 == 0, F.upper("original")).otherwise(F.concat(F.lit("New "), "original"))
    imported = e.select(F.concat(F.lit("i"), "id").alias("id"), said.alias("original"), F.concat(F.lit("Y-"), "id").alias("replacement"), F.lit(None).cast("array<string>").alias("variants"), F.lit(None).cast("timestamp").alias("created_at"))
    return dictionary.merge_dictionary(e, imported).select("id", "original", "replacement")


@query("SELECT DISTINCT p_brand AS original, p_brand AS replacement, 0::INTEGER AS n_variants FROM part")
def a24_migrate_dictionary(spark, sf_dir):
    legacy = table(spark, sf_dir, "part").select(F.col("p_brand").alias("value")).distinct()
    return dictionary.migrate_dictionary(legacy).select("original", "replacement", F.size("variants").alias("n_variants"))


@query("""WITH e AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS id, p_partkey || ' ' || p_name AS original, 'X-' || p_partkey AS replacement FROM part WHERE p_partkey % 9 <> 1)
SELECT id, CASE WHEN k % 10 = 0 THEN 'N-' || k ELSE original END AS original, CASE WHEN k % 10 = 0 THEN 'N-' || k ELSE replacement END AS replacement FROM e
UNION ALL SELECT 'new' || k, 'fresh ' || k, 'F-' || k FROM e WHERE k % 7 = 0 AND k % 3 <> 0""")
def a25_upsert_delete_dictionary(spark, sf_dir):
    k = F.col("id").try_cast("long")
    e = _entries(spark, sf_dir).withColumn("original", F.concat_ws(" ", "id", "original"))
    e = dictionary.delete_dictionary(e, e.where(k % 9 == 1).select("id"))
    edits = e.where(k % 10 == 0).select("id", F.lit(" ").alias("original"), F.concat(F.lit("N-"), "id").alias("replacement"))
    # an addition whose original is known is refused, in whatever case
    added = e.where(k % 7 == 0).select(F.concat(F.lit("new"), "id").alias("id"), F.when(k % 3 == 0, F.upper("original")).otherwise(F.concat(F.lit("fresh "), "id")).alias("original"), F.concat(F.lit("F-"), "id").alias("replacement"))
    return dictionary.upsert_dictionary(e, edits.unionByName(added)).select("id", "original", "replacement")


@query("SELECT DISTINCT term FROM (SELECT p_name AS term FROM part UNION ALL SELECT 'X-' || p_partkey FROM part)")
def a26_boost_terms(spark, sf_dir):
    return dictionary.boost_terms(_entries(spark, sf_dir))


@query("SELECT p_partkey::VARCHAR AS id, p_name AS original, 'X-' || p_partkey AS replacement FROM part")
def a27_export_dictionary(spark, sf_dir):
    from ..sources.files import read_dictionary, work_path

    path = work_path(spark, "dictionary-json")
    dictionary.export_dictionary(_entries(spark, sf_dir), path)
    return read_dictionary(spark, path, multi_line=False).select("id", "original", "replacement")
