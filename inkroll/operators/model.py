"""The supervised person classifier: structural features, character n-grams and logistic regression in Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkroll.functions.text import normalize_spaces
from inkroll.operators.aggregate import stratified_split
from inkroll.operators.features import FEATURES, with_features
from inkroll.operators.metrics import binary, class_report, confusion

NGRAMS = (2, 5)
VOCABULARY = 100_000
ROWS_PER_TASK = 20_000


def char_ngrams(text: Column, lo: int = NGRAMS[0], hi: int = NGRAMS[1]) -> Column:
    """Character n-grams of every lower-case word padded by one blank on each side.

    A word shorter than n gives itself once, for the smallest such n, and nothing for larger ones. Null gives an empty array.
    """
    words = F.filter(F.split(normalize_spaces(F.lower(text)), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column) -> Column:
        sizes = F.sequence(F.lit(lo), F.greatest(F.lit(lo), F.least(F.lit(hi), F.length(w))))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substr(w, i, n))))

    return F.coalesce(F.flatten(F.transform(padded, grams)), F.array().cast("array<string>"))


class CandidateFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the 27 features (without NER, as in training) and the character n-grams of ``candidate``."""

    def _transform(self, df: DataFrame) -> DataFrame:
        some = with_features(df, "candidate")
        doubles = {c: F.col(c).cast("double") for c in FEATURES}
        return some.withColumns(doubles).withColumn("ngrams", char_ngrams(F.col("candidate")))


class DropFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Removes the working columns again."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*FEATURES, "ngrams", "tf", "idf0", "scaled", "tfidf", "manual", "features", "rawPrediction")


def tfidf_stages(df: DataFrame) -> list:
    """Fitted stages: counts over terms in two documents or more, idf = ln((1 + N) / (1 + df)) + 1, rows of length 1."""
    counts = CountVectorizer(inputCol="ngrams", outputCol="tf", vocabSize=VOCABULARY, minDF=2.0).fit(df)
    idf = IDF(inputCol="tf", outputCol="idf0").fit(counts.transform(df))
    scale = ElementwiseProduct(scalingVec=Vectors.dense([x + 1.0 for x in idf.idf.toArray()]), inputCol="tf", outputCol="scaled")
    return [counts, scale, Normalizer(p=2.0, inputCol="scaled", outputCol="tfidf")]


def fit_model(train: DataFrame, max_iter: int = 2000, tol: float = 1e-5) -> PipelineModel:
    """Fit on ``candidate, label``; classes weigh n / (2 n_class), L2 with C = 1, unscaled features."""
    featured = CandidateFeatures().transform(train.select("candidate", F.col("label").cast("double").alias("label"))).cache()
    try:
        sizes = {r["label"]: r["n"] for r in featured.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if len(sizes) < 2:
            raise ValueError("both classes are needed")
        n = sum(sizes.values())
        weight = F.lit(None).cast("double")
        for label, k in sizes.items():
            weight = F.when(F.col("label") == label, n / (len(sizes) * k)).otherwise(weight)
        stages = [*tfidf_stages(featured), VectorAssembler(inputCols=FEATURES, outputCol="manual"), VectorAssembler(inputCols=["manual", "tfidf"], outputCol="features")]
        ready = PipelineModel(stages).transform(featured.withColumn("w", weight)).select("features", "label", "w")
        ready = ready.repartition(max(1, n // ROWS_PER_TASK)).cache()  # an iteration over a small set must not cost many tasks
        lr = LogisticRegression(maxIter=max_iter, regParam=1.0 / n, elasticNetParam=0.0, tol=tol, standardization=False, weightCol="w").fit(ready)
        ready.unpersist()
        return PipelineModel([CandidateFeatures(), *stages, lr, DropFeatures()])
    finally:
        featured.unpersist()


def score_candidates(df: DataFrame, model: PipelineModel, distinct_first: bool = True) -> DataFrame:
    """Add ``person_score``, the probability of a person.

    Every different candidate is scored once and joined back: the score depends on nothing else. Null
    candidates get a null score.
    """
    probability = vector_to_array("probability")[1].alias("person_score")
    if not distinct_first:
        return model.transform(df).select(*df.columns, probability)
    names = df.where("candidate is not null").select("candidate").distinct()
    return df.join(model.transform(names).select("candidate", probability), "candidate", "left").select(*df.columns, "person_score")


def train_and_report(labelled: DataFrame, seed: int = 42) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Model of 80 % of the rows, report and confusion matrix of the others at 0.5."""
    split = stratified_split(labelled, "label", ["candidate"], 0.2, seed)
    model = fit_model(split.where(~F.col("is_test")))
    tested = binary(score_candidates(split.where("is_test"), model), "label", "person_score")
    return model, class_report(tested, 0.5), confusion(tested, 0.5)


__all__ = ["Pipeline", "char_ngrams", "fit_model", "score_candidates", "tfidf_stages", "train_and_report"]
