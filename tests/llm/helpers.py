"""Documents with the cases that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing names."""

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 2654435761 % 2**32 or 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


def odd_documents():
    long = "\n".join(prose(k, 40) for k in range(200))
    return [
        (1, prose(1, 80), "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t\n", "de", "b", 4), (5, long, "en", "a", len(long)), (6, prose(1, 80), "fr", "a", 1), (7, "é😀\n" * 30, "xx", "c", 90),
        (8, prose(8, 60), "en", None, 2), (8, prose(8, 60), "en", None, 2), (None, prose(9, 70), "en", "b", 3), (None, None, None, None, None), (9, prose(1, 80) + " extra", "en", "a", 2), (10, "a" * 5000, "en", "b", 5000),
    ]


def odd(spark, more: str = ""):
    """The odd documents, with columns that clash with names of results."""
    df = spark.createDataFrame(odd_documents(), COLUMNS)
    for name in more.split():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
