"""The flow's vector column, built from ``pyspark.ml`` stages."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, CountVectorizer, Tokenizer
from pyspark.sql import DataFrame


def vector_stages(
    text: str = "bodyText",
    out: str = "vectorRepresentation",
    max_df: float = 0.999,
    vocab_size: int = 262_144,
    min_doc_freq: int = 5,
    binary: bool = False,
) -> Pipeline:
    """Tokenizer, count vectorizer and IDF with the flow's parameters.

    The vocabulary passes through the driver, which ``vocab_size`` bounds.
    """
    return Pipeline(
        stages=[
            Tokenizer(inputCol=text, outputCol="_tokens"),
            CountVectorizer(
                inputCol="_tokens", outputCol="_counts", minTF=1.0, minDF=1.0, maxDF=max_df,
                vocabSize=vocab_size, binary=binary,
            ),
            IDF(inputCol="_counts", outputCol=out, minDocFreq=min_doc_freq),
        ]
    )


def fit_vectors(df: DataFrame, text: str = "bodyText", **params) -> PipelineModel:
    return vector_stages(text, **params).fit(df)


def vector_col(df: DataFrame, model: PipelineModel) -> DataFrame:
    """``df`` with the vector column added."""
    return model.transform(df).drop("_tokens", "_counts")
