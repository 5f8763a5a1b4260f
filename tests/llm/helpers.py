"""Small inputs with the cases that every operator must take."""

LONG = "word " * 60000


def awkward(spark):
    """Null ids and texts, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    rows = [
        (1, "one line\nanother", "en", "a", 16), (2, None, None, None, None), (3, "", "en", "a", 0), (4, LONG, "en", None, len(LONG)), (5, LONG, "de", "b", len(LONG)),
        (6, "one line\nanother", "en", "a", 16), (6, "one line\nanother", "en", "a", 16), (7, " \t\n ", "fr", "c", 4), (None, "no id here", "en", "a", 10), (None, "no id here", "en", "a", 10), (None, None, None, None, None),
        (8, "é漢字🎉 und so weiter, MIT License.", "de", "b", 32), (8, "other text of the same id", "de", "b", 25),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ["n_lines", "n_dropped", "score", "predicted", "component_id", "fp", "rep", "key", "k", "mark", "shard", "slot", "labels", "digest", "piece", "start"]
    for name in extra:
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
