"""Documents with the awkward cases that every operator has to define."""

LONG = "lorem ipsum dolor sit amet " * 4000
WORDS = [f"word{i}" for i in range(60)]
BASE = " ".join(WORDS)
ROWS = [
    (1, BASE, "en", "a"),
    (2, BASE.upper(), "en", "a"),  # the same shingles
    (3, " ".join([*WORDS[:-1], "other"]), "en", "b"),  # near
    (4, " ".join([*WORDS[:30], *(f"x{i}" for i in range(30))]), "en", "b"),  # half of it
    (5, None, "en", None),
    (6, "", None, "a"),
    (7, " \n\t  ", "en", "a"),
    (8, "One two.", "en", "a"),
    (9, "one  TWO.", "en", "a"),
    (10, LONG, "en", "c"),
    (11, "été déjà 日本語 😀  nbsp\n\nline\r\nend ", "fr", "c"),
    (12, BASE, "en", "a"),
    (13, "a" * 6000, "en", "c"),
    (14, "<|endoftext|> it's 123 ### ### $$$", "en", "c"),
]


def documents(spark, rows=ROWS, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    if clash:  # extra columns with the names that operators use inside
        from pyspark.sql import functions as F

        for c in ("n", "sh", "frag", "rep", "component", "ids", "rate", "cdf", "host", "line", "line_no", "hash"):
            df = df.withColumn(c, F.lit("clash"))
    return df
