"""Optional entity labels from a spaCy model, if that is installed on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkroll.operators.rules import ner_priority

_models: dict[str, object] = {}


def available(model: str = "en_core_web_sm") -> bool:
    """Whether the model can be loaded; a note is printed if not."""
    try:
        import spacy

        _models[model] = spacy.load(model)
        return True
    except (ImportError, OSError) as why:
        print(f"No entity labels: {why}")
        return False


def with_ner(df: DataFrame, candidate: str = "candidate", model: str | None = "en_core_web_sm", into: str = "ner_label") -> DataFrame:
    """Add one entity label per candidate (PERSON, then ORG, then LOCATION, else null); null without a model.

    Every different candidate is labelled once; the model is loaded once per Python worker.
    """
    if not model or not available(model):
        return df.withColumn(into, F.lit(None).cast("string"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def labels(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if model not in _models:
            available(model)
        for part in parts:
            yield pd.Series([[e.label_ for e in doc.ents] for doc in _models[model].pipe(part.tolist())])

    names = df.where(F.col(candidate).isNotNull()).select(candidate).distinct()
    labelled = names.withColumn(into, ner_priority(labels(F.col(candidate))))
    return df.drop(into).join(labelled, candidate, "left").select(*[c for c in df.columns if c != into], into)
