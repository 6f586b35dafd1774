"""Pipelines: clean and count, labelling sheet, evaluation, threshold sensitivity, summaries."""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkroll.functions.ner import with_ner
from inkroll.operators import aggregate as A
from inkroll.operators import metrics as M
from inkroll.operators import thresholds as TH
from inkroll.operators.candidates import explode_candidates
from inkroll.operators.histogram import equal_width
from inkroll.operators.rules import NON_PERSON_AT, PERSON_AT, UNCERTAIN, classify_by_rules, classify_by_score, with_rules
from inkroll.plans.charts import draw
from inkroll.session import materialise, spread
from inkroll.sources import sinks
from inkroll.sources.records import record_slice, records


def decide(spread_records: DataFrame, model: PipelineModel | None = None, person: float = PERSON_AT, non_person: float = NON_PERSON_AT, ner_model: str | None = None) -> DataFrame:
    """Candidates with ``ner_label, label, score, reason``, by the model if there is one, else by the rules."""
    rows = with_ner(explode_candidates(spread_records), "candidate", ner_model)
    if model is None:
        return classify_by_rules(rows, "candidate", "ner_label")
    from inkroll.operators.model import score_candidates

    return classify_by_score(score_candidates(rows, model).withColumnRenamed("person_score", "score"), "score", person, non_person)


def clean_and_count(spark: SparkSession, path: str, max_lines: int | None = None, model_path: str | None = None, person: float = PERSON_AT, non_person: float = NON_PERSON_AT, uncertain_to: str | None = None, counts_to: str | None = None, ner_model: str | None = None, report: bool = False) -> DataFrame:
    """``author, count`` of a JSON-lines file; optionally writes the counts and the uncertain occurrences and prints the decision counts."""
    model = PipelineModel.load(model_path) if model_path else None
    decided = materialise(decide(spread(records(spark, path, max_lines)), model, person, non_person, ner_model))
    counts = A.author_counts(decided)
    if report:
        A.decision_counts(decided).orderBy(F.desc("count")).show()
        print(f"Different accepted authors: {counts.count()}")
    if uncertain_to:
        sinks.write_uncertain(decided.withColumnRenamed("id", "arxiv_id"), uncertain_to)
    if counts_to:
        sinks.write_author_counts(counts, counts_to)
    return counts


def export_labelling_sheet(spark: SparkSession, path: str, to: str, max_lines: int | None = 50_000, n: int = 5000) -> DataFrame:
    """The labelling sheet of a JSON-lines file as one CSV file."""
    sheet = A.labelling_sheet(with_rules(explode_candidates(spread(records(spark, path, max_lines)))), n)
    sinks.write_csv(sheet, to, single=True)
    return sheet


def evaluate(scored: DataFrame, to: str, label: str = "label", score: str = "person_score", threshold: float = PERSON_AT) -> dict[str, DataFrame]:
    """All evaluation tables of labelled, scored rows, each written as CSV below ``to``."""
    rows = materialise(M.binary(scored, label, score))
    predicted = M.predictions(scored, label, score, threshold)
    tables = {
        "confusion": M.confusion(rows, threshold), "confusion_shares": M.confusion_shares(rows, threshold), "class_report": M.class_report(rows, threshold), "roc_auc": M.roc_auc(rows), "average_precision": M.average_precision(rows), "baseline": M.baseline(rows),
        "roc_curve": M.roc_curve(rows), "pr_curve": M.pr_curve(rows), "threshold_metrics": M.threshold_sweep(rows), "calibration": M.calibration(rows), "score_distribution": equal_width(rows, "s", 40, ["y"]),
        "errors_all": M.errors(predicted, score), "errors_fp": M.errors(predicted, score, "fp"), "errors_fn": M.errors(predicted, score, "fn"), "all_test_predictions": predicted,
    }
    for name, df in tables.items():
        sinks.write_csv(df, os.path.join(to, name))
    draw(tables, to)
    return tables


def metrics_text(rows: DataFrame, threshold: float = PERSON_AT) -> str:
    """The metrics as text with four decimals."""
    m, auc, ap = M.confusion(rows, threshold).first(), M.roc_auc(rows).first()[0], M.average_precision(rows).first()[0]
    n = m.tn + m.fp + m.fn + m.tp
    p, r = (m.tp / (m.tp + m.fp) if m.tp + m.fp else 0.0), (m.tp / (m.tp + m.fn) if m.tp + m.fn else 0.0)
    f1 = 2 * p * r / (p + r) if p + r else 0.0
    values = {"threshold": threshold, "accuracy": (m.tn + m.tp) / n if n else 0.0, "precision": p, "recall": r, "f1": f1, "roc_auc": auc, "average_precision": ap}
    return "\n".join(f"{k}: {'nan' if v is None else format(v, '.4f')}" for k, v in values.items()) + f"\nconfusion: tn={m.tn} fp={m.fp} fn={m.fn} tp={m.tp}\n"


def threshold_sensitivity(spark: SparkSession, path: str, model: PipelineModel, to: str, pairs: list[tuple[float, float]], start_line: int = 0, max_records: int | None = 50_000, save_scores: bool = False, top_n: int = 30, ner_model: str | None = None) -> DataFrame:
    """Score once, decide under every pair.

    Writes the summary, and per pair: the groups of each decision in a folder of their own, the ``top_n`` most frequent uncertain
    candidates, the uncertain occurrences and the histogram of their scores. Charts are drawn where that is possible.
    """
    from inkroll.operators.model import score_candidates

    candidates = with_ner(explode_candidates(spread(record_slice(spark, path, start_line, max_records))), "candidate", ner_model)
    scored = materialise(score_candidates(candidates, model))
    if scored.isEmpty():
        raise ValueError("no candidates in this slice")
    if save_scores:
        sinks.write_scored(scored, os.path.join(to, "scored_candidates"), "csv")
    groups = materialise(TH.group_pairs(scored, pairs))
    order = [F.desc("frequency"), F.desc("mean_score"), F.asc("candidate")]
    sinks.write_partitioned(groups.orderBy("tag", "decision", *order), os.path.join(to, "groups"), "tag", "decision")
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(*order))  # tasks keep only the first ones
    top = groups.where(F.col("decision") == UNCERTAIN).withColumn("_rank", rank).where(F.col("_rank") <= top_n).drop("_rank")
    sinks.write_partitioned(top.orderBy("tag", *order), os.path.join(to, "top_uncertain"))
    uncertain = TH.apply_pairs(scored, pairs).where(F.col("decision") == UNCERTAIN)
    sinks.write_partitioned(uncertain, os.path.join(to, "uncertain_occurrences"))
    histogram = equal_width(uncertain, "person_score", 40, ["tag"])
    sinks.write_partitioned(histogram, os.path.join(to, "uncertain_scores"))
    summary = TH.summarise_pairs(scored, pairs).orderBy(F.desc("person_threshold"), F.asc("nonperson_threshold"))
    sinks.write_csv(summary, os.path.join(to, "threshold_summary"), single=True)
    draw({"top_uncertain": top, "uncertain_scores": histogram, "threshold_summary": summary}, to)
    return summary


def summaries(counts: DataFrame | None, uncertain: DataFrame | None, rejected: DataFrame | None, n: int = 100) -> dict[str, DataFrame]:
    """Top lists and the data tables of all charts, of whichever inputs exist."""
    out: dict[str, DataFrame] = {}
    if counts is not None:
        counts = counts.withColumn("count", F.col("count").cast("long"))
        out["top_authors"] = A.top(counts, n, F.desc("count"), F.asc("author"))
        out["author_frequency_distribution"] = equal_width(counts, "count", 50)
        out["author_count_statistics"] = A.describe(counts, "count")
    parts = {}
    for name, df in (("uncertain", uncertain), ("rejected", rejected)):
        if df is None:
            continue
        summary = A.candidate_summary(df, [], "score", reason="reason")
        order = [F.desc("frequency"), *([F.desc("mean_score")] if "mean_score" in summary.columns else []), F.asc("candidate")]
        out[f"top_{name}"] = A.top(summary, n, *order)
        out[f"{name}_frequency"] = A.top(A.frequency(df, "candidate", "frequency"), n, F.desc("frequency"), F.asc("candidate"))
        if "score" in df.columns:
            out[f"{name}_score_distribution"] = equal_width(df, "score", 40)
            out[f"{name}_score_statistics"] = A.describe(df, "score")
            out[f"{name}_score_and_frequency"] = summary.select("candidate", "frequency", "mean_score")
        if "reason" in df.columns:
            out[f"{name}_reasons"] = A.reason_histogram(df)
        if "ner_label" in df.columns:
            parts[name.upper()] = df
    if parts:
        out["ner_labels"] = A.ner_distribution(parts)
    return out


def save_summaries(tables: dict[str, DataFrame], to: str, show: bool = False) -> None:
    draw(tables, to, show)
    for name, df in tables.items():
        sinks.write_csv(df, os.path.join(to, name), single=True)
