"""The helpers under SQL names."""

import functools
import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import spoken


def register_sql(spark: SparkSession) -> None:
    """spoken_punctuation, apply_itn, number_words_to_int, pattern_slots and fill_slots for SQL.

    pattern_slots(text, pattern): the values of the {slots} of a recipe's pattern in a text, or null where
    it doesn't fit; fill_slots(template, slots): {{slot}} replaced by values.
    """
    def text(f):
        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            return s.map(f, na_action="ignore")

        return run

    @F.pandas_udf("long")
    def number(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None or (n := spoken.read_number(t.lower().split())) is None else n[0]).astype("Int64")

    spark.udf.register("spoken_punctuation", text(spoken.punctuation))
    spark.udf.register("apply_itn", text(spoken.itn))
    spark.udf.register("number_words_to_int", number)
    @F.pandas_udf("map<string,string>")
    def slots(texts: pd.Series, patterns: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or p is None else slots_of(t, p) for t, p in zip(texts, patterns, strict=True)], dtype=object)

    spark.udf.register("pattern_slots", slots)
    # in SQL itself, so that it stays in the JVM
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION fill_slots(template STRING, slots MAP<STRING, STRING>) RETURNS STRING
        RETURN regexp_replace(aggregate(map_entries(slots), template, (t, e) -> replace(t, concat('{{', e.key, '}}'), e.value)), '\\\\{\\\\{\\\\w+\\\\}\\\\}', '')""")


def slots_of(text: str, pattern: str) -> dict[str, str] | None:
    m = _compiled(pattern).fullmatch(" ".join(text.split()).rstrip(".!?,").strip())
    return None if m is None else {k: v.strip().rstrip(".!?,") for k, v in m.groupdict().items()}


@functools.lru_cache(10_000)
def _compiled(pattern: str) -> re.Pattern:
    parts = re.split(r"\{(\w+)\}", pattern.strip(), flags=re.A)
    words = [r"\s+".join(re.escape(w) for w in re.split(r"\s+", x)) if k % 2 == 0 else f"(?P<{x}>.+?)" for k, x in enumerate(parts)]
    return re.compile("".join(words), re.I | re.A)
