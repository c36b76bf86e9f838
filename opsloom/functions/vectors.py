"""Vectors: encoding texts, similarity columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom import rules as R


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 when one of the vectors has no length."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def certainty(cos: Column) -> Column:
    return (cos + 1.0) / 2.0


def weighted_mean(title: Column, content: Column) -> Column:
    """0.3 title + 0.7 content, scaled back to length one."""
    mixed = F.zip_with(title, content, lambda t, x: t.cast("double") * 0.3 + x.cast("double") * 0.7)
    return F.transform(mixed, lambda x: F.when(norm(mixed) > 0, x / norm(mixed)).otherwise(x))


def query_text(query: Column, enhance: bool = True) -> Column:
    return F.concat(F.lit(R.QUERY_PREFIX), query) if enhance else query


def document_text(title: Column, content: Column, strategy: str = "weighted") -> Column:
    """Text to encode: the title counts twice, or title and content once."""
    if strategy == "weighted":
        return F.concat_ws(" ", title, title, content)
    return F.concat_ws("\n", title, content)


def encode_texts(df: DataFrame, text: str = "content", out: str = "vector", dims: int = 384) -> DataFrame:
    """Hashed term weights of length one: equal texts get equal vectors, like texts near ones."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=R.TOKEN_SPLIT, toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit"),
    ]
    model = Pipeline(stages=stages).fit(df)
    return model.transform(df).withColumn(out, vector_to_array("_unit", "float32")).drop(
        "_tokens", "_tf", "_tfidf", "_unit")


def encode_with(df: DataFrame, make_encoder: Callable[[], Callable[[list[str]], list]], text: str = "content",
                out: str = "vector") -> DataFrame:
    """Vectors from the user's own encoder, built once per task, called once per Arrow batch."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for batch in batches:
            yield batch.assign(**{out: [list(v) for v in encode(batch[text].tolist())]})

    return df.mapInPandas(run, schema)
