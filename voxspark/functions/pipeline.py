"""The whole post-processing of a transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spoken import apply_itn, spoken_punctuation
from .text import clean_transcript, has_speech, itn_punctuation


def postprocess(df: DataFrame, text: str = "text", dictionary=None, spoken: bool = False, numbers: bool = True, trailing_space: bool = False) -> DataFrame:
    """Clean, punctuate, write numbers, drop rows without speech; in this order."""
    # the next step names its input several times; out of a generator, it is evaluated once
    once = lambda c: F.explode(F.array(c))
    out = df.withColumn(text, once(clean_transcript(F.col(text), dictionary)))
    out = out.withColumn(text, spoken_punctuation(F.col(text))) if spoken else out
    out = out.withColumn(text, once(itn_punctuation(F.col(text)))) if spoken and numbers else out
    out = out.withColumn(text, apply_itn(F.col(text))) if numbers else out
    # by way of a generator: a filter would be pushed below all steps, and evaluate them again for each mention of a column
    out = out.withColumn(text, F.explode(F.filter(F.array(text), has_speech)))
    return out.withColumn(text, F.concat(text, F.lit(" "))) if trailing_space else out
