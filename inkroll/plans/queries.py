"""Registered queries of the core over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkroll.functions import text as X
from inkroll.operators import aggregate as A
from inkroll.operators import metrics as M
from inkroll.operators import thresholds as TH
from inkroll.operators.candidates import explode_candidates
from inkroll.operators.features import FEATURES, with_features
from inkroll.operators.histogram import equal_width
from inkroll.operators.rules import classify_by_rules, classify_by_score, with_rules
from inkroll.session import scratch, spread
from inkroll.sources import sinks
from inkroll.sources.records import labelled_for_evaluation, labelled_for_training, read_csv, record_slice, records
from inkroll.sources.tables import table

PAIRS = TH.parse_pairs(TH.DEFAULT_PAIRS)


def raw(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "raw_records").select("line_no", "id", "authors"))


def plain_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates without NFKC, which SQL lacks."""
    return explode_candidates(raw(spark, d), "authors", nfkc=False).select("line_no", "id", "position", "candidate")


def full_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the whole cleaning path, NFKC first, as the reference and the pipelines take them."""
    return explode_candidates(raw(spark, d), "authors").select("line_no", "id", "position", "candidate")


def decided(spark: SparkSession, d: str, nfkc: bool = False) -> DataFrame:
    return classify_by_rules(full_candidates(spark, d) if nfkc else plain_candidates(spark, d))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scored_candidates")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return plain_candidates(spark, d)


def candidates_nfkc(spark: SparkSession, d: str) -> DataFrame:
    return full_candidates(spark, d)


def tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).select("cand_id", F.posexplode(X.tokens(F.col("candidate"))).alias("n", "token"))
    return rows.select("cand_id", "n", "token", F.btrim(F.lower("token")).alias("lower_token"), X.is_name_piece(F.col("token")).alias("name_piece"), X.is_mixed_case(F.col("token")).alias("mixed_case"), X.is_upper(F.col("token")).alias("upper_case"))


def features(spark: SparkSession, d: str) -> DataFrame:
    some = with_features(scored(spark, d).select("cand_id", "candidate", "ner_label"), "candidate", "ner_label")
    return some.select("cand_id", *[F.round(c, 9).alias(c) if c == "log_char_count" else c for c in FEATURES])


def rule_decisions(spark: SparkSession, d: str) -> DataFrame:
    return with_rules(scored(spark, d).select("cand_id", "candidate", "ner_label"), "candidate", "ner_label").select("cand_id", "rule_label", "rule_score", "rule_reason")


def rule_classification(spark: SparkSession, d: str) -> DataFrame:
    return classify_by_rules(scored(spark, d).select("cand_id", "candidate", "ner_label"), "candidate", "ner_label").select("cand_id", "label", "score", "reason")


def decision_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.decision_counts(decided(spark, d))


def decision_counts_nfkc(spark: SparkSession, d: str) -> DataFrame:
    return A.decision_counts(decided(spark, d, nfkc=True))


def author_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.author_counts(decided(spark, d))


def author_counts_nfkc(spark: SparkSession, d: str) -> DataFrame:
    return A.author_counts(decided(spark, d, nfkc=True))


def top_authors(spark: SparkSession, d: str) -> DataFrame:
    return A.top(A.author_counts(decided(spark, d)), 30, F.desc("count"), F.asc("author"))


def top_authors_nfkc(spark: SparkSession, d: str) -> DataFrame:
    return A.top(A.author_counts(decided(spark, d, nfkc=True)), 30, F.desc("count"), F.asc("author"))


def _distinct_authors(rows: DataFrame) -> DataFrame:
    return rows.where("label = 'PERSON'").agg(F.countDistinct("candidate").alias("authors"))


def distinct_authors(spark: SparkSession, d: str) -> DataFrame:
    return _distinct_authors(decided(spark, d))


def distinct_authors_nfkc(spark: SparkSession, d: str) -> DataFrame:
    return _distinct_authors(decided(spark, d, nfkc=True))


def _uncertain_rows(rows: DataFrame) -> DataFrame:
    return rows.where("label = 'UNCERTAIN'").select("line_no", "id", "position", "candidate", "score", "reason")


def uncertain_rows(spark: SparkSession, d: str) -> DataFrame:
    return _uncertain_rows(decided(spark, d))


def uncertain_rows_nfkc(spark: SparkSession, d: str) -> DataFrame:
    return _uncertain_rows(decided(spark, d, nfkc=True))


def _labelling_sheet(candidates: DataFrame) -> DataFrame:
    return A.labelling_sheet(with_rules(candidates)).withColumn("rule_score", F.round("rule_score", 9))


def labelling_sheet(spark: SparkSession, d: str) -> DataFrame:
    return _labelling_sheet(plain_candidates(spark, d))


def labelling_sheet_nfkc(spark: SparkSession, d: str) -> DataFrame:
    return _labelling_sheet(full_candidates(spark, d))


def threshold_decisions(spark: SparkSession, d: str) -> DataFrame:
    return TH.apply_pairs(scored(spark, d).select("cand_id", "person_score"), PAIRS).select("cand_id", "tag", "decision")


def threshold_summary(spark: SparkSession, d: str) -> DataFrame:
    out = TH.summarise_pairs(scored(spark, d).select("candidate", "person_score"), PAIRS)
    return out.select(*[F.round(c, 9).alias(c) if c.endswith("rate") else c for c in out.columns])


def bucket_groups(spark: SparkSession, d: str) -> DataFrame:
    out = TH.group_pairs(scored(spark, d).select("candidate", "ner_label", "person_score"), PAIRS)
    return out.withColumn("mean_score", F.round("mean_score", 12))


def score_classification(spark: SparkSession, d: str) -> DataFrame:
    return classify_by_score(scored(spark, d).select("cand_id", "person_score"), "person_score").select("cand_id", "label", "reason")


def uncertain_summary(spark: SparkSession, d: str) -> DataFrame:
    out = A.candidate_summary(table(spark, d, "uncertain_occurrences"), [], "score", reason="reason")
    return out.withColumn("mean_score", F.round("mean_score", 12))


def uncertain_top(spark: SparkSession, d: str) -> DataFrame:
    return A.top(uncertain_summary(spark, d), 100, F.desc("frequency"), F.desc("mean_score"), F.asc("candidate"))


def rejected_summary(spark: SparkSession, d: str) -> DataFrame:
    rejected = scored(spark, d).where("person_score <= 0.1").select("candidate", F.col("person_score").alias("score"))
    out = A.candidate_summary(rejected, [], "score", ner_label=None).select("candidate", "frequency", F.round("mean_score", 12).alias("mean_score"))
    return A.top(out, 100, F.desc("frequency"), F.asc("candidate"))


def reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.reason_histogram(table(spark, d, "uncertain_occurrences"))


def ner_distribution(spark: SparkSession, d: str) -> DataFrame:
    rejected = scored(spark, d).where("person_score <= 0.1")
    return A.ner_distribution({"UNCERTAIN": table(spark, d, "uncertain_occurrences"), "REJECTED": rejected})


def decision_overview(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "author_counts")
    parts = {"accepted": counts.select(F.col("author").alias("c")), "uncertain": table(spark, d, "uncertain_occurrences").select(F.col("candidate").alias("c")), "rejected": scored(spark, d).where("person_score <= 0.1").select(F.col("candidate").alias("c"))}
    whole = None
    for name, df in parts.items():
        one = A.overview(df, "c").withColumn("part", F.lit(name))
        whole = one if whole is None else whole.unionByName(one)
    return whole


def count_describe(spark: SparkSession, d: str) -> DataFrame:
    out = A.describe(table(spark, d, "author_counts"), "count")
    return out.select("count", *[F.round(c, 6).alias(c) for c in out.columns if c != "count"])


def score_describe(spark: SparkSession, d: str) -> DataFrame:
    out = A.describe(table(spark, d, "uncertain_occurrences"), "score")
    return out.select("count", *[F.round(c, 6).alias(c) for c in out.columns if c != "count"])


def score_frequency(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "uncertain_occurrences").where("candidate is not null").groupBy("candidate").agg(F.count("*").alias("frequency"), F.avg("score").alias("mean_score"))
    return out.withColumn("mean_score", F.round("mean_score", 12))


def candidate_frequency(spark: SparkSession, d: str) -> DataFrame:
    return A.frequency(scored(spark, d), "candidate", "frequency")


def _bins(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 10).alias(c) if c.startswith("bin_") else c for c in df.columns])


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _bins(equal_width(table(spark, d, "uncertain_occurrences"), "score", 40))


def count_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _bins(equal_width(table(spark, d, "author_counts"), "count", 50))


def threshold_histogram(spark: SparkSession, d: str) -> DataFrame:
    uncertain = TH.apply_pairs(scored(spark, d).select("person_score"), PAIRS).where("decision = 'UNCERTAIN'")
    return _bins(equal_width(uncertain, "person_score", 40, ["tag"]))


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Labelled candidates with the highest score they reach, as ``candidate, label, score``."""
    labels = table(spark, d, "labelled_candidates").where("label in (0, 1) and candidate is not null").groupBy("candidate").agg(F.min("label").alias("label"))
    return scored(spark, d).groupBy("candidate").agg(F.max("person_score").alias("score")).join(labels, "candidate").where("score is not null")


def scores(spark: SparkSession, d: str) -> DataFrame:
    """All scored rows with an NER label: a person or not, and the score."""
    rows = scored(spark, d).where("ner_label is not null").select((F.col("ner_label") == "PERSON").cast("int").alias("label"), "person_score")
    return M.binary(rows, "label", "person_score")


def _round(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 8).alias(c) if kinds[c] == "double" and c not in keep else F.col(c) for c in df.columns])


def histogram_by_class(spark: SparkSession, d: str) -> DataFrame:
    return _bins(equal_width(scores(spark, d), "s", 40, ["y"]))


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(scores(spark, d))


def confusion_norm(spark: SparkSession, d: str) -> DataFrame:
    return _round(M.confusion_shares(scores(spark, d)))


def class_report(spark: SparkSession, d: str) -> DataFrame:
    return _round(M.class_report(scores(spark, d)))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _round(M.threshold_sweep(scores(spark, d)))


def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return _round(M.roc_auc(scores(spark, d)))


def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return _round(M.average_precision(scores(spark, d)))


def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return _round(M.roc_curve(scores(spark, d)))


def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return _round(M.pr_curve(scores(spark, d)))


def calibration(spark: SparkSession, d: str) -> DataFrame:
    return _round(M.calibration(scores(spark, d)))


def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labelled_candidates").where("label in (0, 1)").groupBy("label").agg(F.count("*").alias("count"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return M.predictions(judged(spark, d), "label", "score")


def error_fp(spark: SparkSession, d: str) -> DataFrame:
    return M.errors(predictions(spark, d), "score", "fp")


def error_fn(spark: SparkSession, d: str) -> DataFrame:
    return M.errors(predictions(spark, d), "score", "fn")


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labelled_candidates").where("label in (0, 1) and candidate is not null").select("candidate", "label")
    return A.stratified_split(rows, "label", ["candidate"])


def source_slice_lines(spark: SparkSession, d: str) -> DataFrame:
    """The records among the first 50,000 lines."""
    return table(spark, d, "raw_records").where("line_no < 50000 and authors is not null").select("line_no", "id", "authors")


def source_slice_valid(spark: SparkSession, d: str) -> DataFrame:
    """The first 1,000 records that have authors, from line 100 on."""
    return table(spark, d, "raw_records").where("line_no >= 100 and authors is not null and authors <> ''").select("line_no", "id", "authors").orderBy("line_no").limit(1000)


def _as_lines(spark: SparkSession, d: str) -> str:
    """The raw records as JSON lines, in files whose names follow the order of the lines."""
    path = scratch(spark)
    fields = F.to_json(F.struct("id", "authors"), {"ignoreNullFields": "false"})
    table(spark, d, "raw_records").orderBy("line_no").select(fields.alias("value")).write.text(path)
    return path


def jsonl_lines(spark: SparkSession, d: str) -> DataFrame:
    """The reader of JSON lines: the valid records among the first 50,000 lines."""
    return records(spark, _as_lines(spark, d), 50_000)


def jsonl_slice(spark: SparkSession, d: str) -> DataFrame:
    """The reader of JSON lines: the first 1,000 valid records from line 100 on."""
    return record_slice(spark, _as_lines(spark, d), 100, 1000)


def csv_training(spark: SparkSession, d: str) -> DataFrame:
    """Labelled candidates written as CSV and read for training."""
    path = scratch(spark)
    sinks.write_csv(table(spark, d, "labelled_candidates"), path)
    return labelled_for_training(read_csv(spark, path)).select("candidate", "label", "ner_label")


def csv_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Labelled candidates written as CSV and read for evaluation."""
    path = scratch(spark)
    sinks.write_csv(table(spark, d, "labelled_candidates"), path)
    return labelled_for_evaluation(read_csv(spark, path)).select("candidate", "label", "ner_label")


def csv_counts(spark: SparkSession, d: str) -> DataFrame:
    """Author counts written and read again; a name that reads as missing is null."""
    path = scratch(spark)
    sinks.write_author_counts(A.author_counts(decided(spark, d)), path)
    return read_csv(spark, path).select("author", F.col("count").cast("long").alias("count"))


def csv_uncertain(spark: SparkSession, d: str) -> DataFrame:
    """Uncertain occurrences written and read again."""
    path = scratch(spark)
    rows = decided(spark, d).withColumnRenamed("id", "arxiv_id").withColumn("ner_label", F.lit(None).cast("string"))
    sinks.write_uncertain(rows, path)
    return read_csv(spark, path).select("arxiv_id", "candidate", F.col("position").cast("int").alias("position"), "ner_label", F.col("score").cast("double").alias("score"), "reason")


def csv_scored(spark: SparkSession, d: str) -> DataFrame:
    """Scored candidates written as CSV and read again."""
    path = scratch(spark)
    sinks.write_scored(scored(spark, d).select("cand_id", "candidate", "person_score"), path, "csv")
    return read_csv(spark, path).select(F.col("cand_id").cast("long").alias("cand_id"), "candidate", F.col("person_score").cast("double").alias("person_score"))


def baseline(spark: SparkSession, d: str) -> DataFrame:
    return _round(M.baseline(scores(spark, d)))


def char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    from inkroll.operators.model import char_ngrams as grams

    rows = table(spark, d, "labelled_candidates").where("candidate is not null").select(F.explode(grams(F.col("candidate"))).alias("gram"))
    return rows.groupBy("gram").agg(F.count("*").alias("count"))


def tfidf(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and idf of every n-gram in two names or more."""
    from inkroll.operators.model import char_ngrams as grams

    names = table(spark, d, "labelled_candidates").where("candidate is not null").select("candidate")
    total = names.agg(F.count("*").alias("total"))
    df = names.select(F.explode(F.array_distinct(grams(F.col("candidate")))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).where("df >= 2")
    return df.join(F.broadcast(total)).select("gram", "df", F.round(F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1, 8).alias("idf"))  # one row


def train_predict(spark: SparkSession, d: str) -> DataFrame:
    """Model fitted on the labelled candidates, applied to every scored candidate."""
    from inkroll.operators.model import fit_model, score_candidates

    model = fit_model(labelled_for_training(table(spark, d, "labelled_candidates").select("candidate", "label")).where("label in (0, 1)"))
    return score_candidates(scored(spark, d).select("cand_id", "candidate"), model)


def model_report(spark: SparkSession, d: str) -> DataFrame:
    """Hold-out report of the model."""
    from inkroll.operators.model import train_and_report

    return train_and_report(labelled_for_training(table(spark, d, "labelled_candidates").select("candidate", "label")).where("label in (0, 1)"))[1]


QUERIES = {
    f.__name__: f
    for f in (
        candidates, candidates_nfkc, tokens, features, rule_decisions, rule_classification, decision_counts, author_counts, top_authors, distinct_authors, uncertain_rows, labelling_sheet,
        decision_counts_nfkc, author_counts_nfkc, top_authors_nfkc, distinct_authors_nfkc, uncertain_rows_nfkc, labelling_sheet_nfkc, threshold_decisions, threshold_summary, bucket_groups,
        score_classification, uncertain_summary, uncertain_top, rejected_summary, reason_histogram, ner_distribution, decision_overview, count_describe, score_describe, score_frequency, candidate_frequency, score_histogram, count_histogram,
        threshold_histogram, histogram_by_class, confusion, confusion_norm, class_report, threshold_sweep, roc_auc, average_precision, roc_curve, pr_curve, calibration, class_counts, predictions, error_fp, error_fn, stratified_split,
        source_slice_lines, source_slice_valid, jsonl_lines, jsonl_slice, csv_training, csv_evaluation, csv_counts, csv_uncertain, csv_scored, baseline, char_ngrams, tfidf, train_predict, model_report,
    )
}
