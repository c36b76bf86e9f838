"""Small tables of documents with the awkward cases."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     T.StructField("size", T.LongType()), T.StructField("n", T.StringType())])


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source); the last two columns clash with names that operators use inside."""
    return spark.createDataFrame([(d, t, l, s, len(t or ""), 5, "x") for d, t, l, s in rows], DOCS)


AWKWARD = [(1, "the cat sat on the mat and it's fine.\n\nyes  no", "en", "a"), (2, None, "en", "a"), (3, "", None, None),
           (4, "der Hund lief über die Straße und blieb", "de", "b"), (4, "der Hund lief über die Straße und blieb", "de", "b"),
           (5, "une é ́ <|endoftext|> 日本語 \x00 x", None, None), (None, "no id here at all", "en", "c"),
           (7, "long word " * 30000, "en", "a"), (8, "the cat sat on the mat and it's fine.\n\nyes  no", "en", "c"),
           (-3, "negative id", "en", "a")]
