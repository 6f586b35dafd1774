"""Charts of the small result tables, as PNG files; only where matplotlib is installed."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that are drawn, at most: of a top list its top, of a longer curve the means over so many parts of x.
MOST = 2000


@dataclass(frozen=True)
class Chart:
    """How a table is drawn: bars across (a top list), steps (a histogram), lines over x, or points."""

    form: str
    x: str
    y: tuple[str, ...]
    title: str
    series: str | None = None


CHARTS = {
    "top_authors": Chart("bars", "author", ("count",), "Most frequent accepted authors"),
    "author_frequency_distribution": Chart("steps", "bin_left", ("count",), "Authors by frequency"),
    "ner_labels": Chart("bars", "ner_label", ("count",), "Entity labels by decision", "decision"),
    "score_distribution": Chart("steps", "bin_left", ("count",), "Scores by class", "y"),
    "roc_curve": Chart("lines", "fpr", ("tpr",), "ROC curve"),
    "pr_curve": Chart("lines", "recall", ("precision",), "Precision and recall"),
    "threshold_metrics": Chart("lines", "threshold", ("precision", "recall", "f1", "accepted_rate"), "Metrics by threshold"),
    "calibration": Chart("lines", "mean_score", ("positive_rate",), "Calibration"),
    "class_report": Chart("bars", "class", ("precision", "recall", "f1"), "Scores by class"),
    "confusion": Chart("cells", "", ("tn", "fp", "fn", "tp"), "Confusion matrix"),
    "confusion_shares": Chart("cells", "", ("tn", "fp", "fn", "tp"), "Confusion matrix, shares of the true class"),
    "top_uncertain": Chart("bars", "candidate", ("frequency",), "Most frequent uncertain candidates", "tag"),
    "uncertain_scores": Chart("steps", "bin_left", ("count",), "Scores of uncertain candidates", "tag"),
    "threshold_summary": Chart("lines", "person_threshold", ("person_occurrences", "nonperson_occurrences", "uncertain_occurrences", "uncertain_unique"), "Decisions across thresholds"),
}
for _part in ("uncertain", "rejected"):
    CHARTS.setdefault(f"top_{_part}", Chart("bars", "candidate", ("frequency",), f"Most frequent {_part} candidates"))
    CHARTS[f"{_part}_frequency"] = Chart("bars", "candidate", ("frequency",), f"Frequency of {_part} candidates")
    CHARTS[f"{_part}_score_distribution"] = Chart("steps", "bin_left", ("count",), f"Scores of {_part} candidates")
    CHARTS[f"{_part}_reasons"] = Chart("bars", "reason", ("count",), f"Reasons of {_part} candidates")
    CHARTS[f"{_part}_score_and_frequency"] = Chart("points", "frequency", ("mean_score",), f"Score and frequency of {_part} candidates")


def points(df: DataFrame, chart: Chart) -> list[dict]:
    """The rows to draw, bounded: bars in the order of the table, all others in the order of x."""
    if chart.form in ("bars", "cells"):
        return [r.asDict() for r in df.limit(MOST).collect()]
    rows = df.where(F.col(chart.x).isNotNull())
    if rows.count() > MOST:
        keys = [c for c in (chart.series,) if c and c in df.columns]
        ends = rows.agg(F.min(chart.x), F.max(chart.x)).first()
        part = F.floor((F.col(chart.x) - ends[0]) / ((ends[1] - ends[0]) or 1) * MOST)
        rows = rows.groupBy(*keys, part.alias("_part")).agg(*[F.avg(c).alias(c) for c in (chart.x, *chart.y)])
    return sorted((r.asDict() for r in rows.collect()), key=lambda r: r[chart.x])


def draw(tables: dict[str, DataFrame], to: str, show: bool = False) -> list[str]:
    """Draw every table that has a chart, one file per series; without matplotlib nothing is drawn and the tables stand for themselves.

    The files go to the local folder ``to`` of the driver; a path on another file system gets none.
    """
    try:
        import matplotlib

        matplotlib.use(matplotlib.get_backend() if show else "Agg")
        from matplotlib import pyplot
    except ImportError:
        return []
    if "://" in to:
        return []
    os.makedirs(to, exist_ok=True)
    made = []
    for name, chart in CHARTS.items():
        if name not in tables:
            continue
        rows = points(tables[name], chart)
        apart = chart.series if chart.series and chart.series in tables[name].columns else None
        for value in sorted({r[apart] for r in rows}, key=str) if apart else [None]:
            own = [r for r in rows if apart is None or r[apart] == value]
            figure, axes = pyplot.subplots(figsize=(9, max(4, 0.25 * len(own)) if chart.form == "bars" else 6))
            _plot(axes, chart, own)
            axes.set_title(chart.title if value is None else f"{chart.title}: {value}")
            figure.tight_layout()
            made.append(os.path.join(to, f"{name}.png" if value is None else f"{name}_{value}.png"))
            figure.savefig(made[-1], dpi=300)
            if show:
                pyplot.show()
            pyplot.close(figure)
    return made


def _plot(axes, chart: Chart, rows: list[dict]) -> None:
    if chart.form == "cells":
        (cells,) = rows
        axes.imshow([[cells["tn"], cells["fp"]], [cells["fn"], cells["tp"]]])
        for (y, x), key in {(0, 0): "tn", (0, 1): "fp", (1, 0): "fn", (1, 1): "tp"}.items():
            axes.text(x, y, f"{cells[key]:.4g}", ha="center", va="center")
        return
    for column in chart.y:
        x, y = [r[chart.x] for r in rows], [r[column] for r in rows]
        if chart.form == "bars":
            axes.barh([str(v) for v in x][::-1], y[::-1], label=column)  # the first row on top
        elif chart.form == "steps":
            axes.bar(x, y, width=(x[1] - x[0]) if len(x) > 1 else 1, align="edge", label=column)
        elif chart.form == "points":
            axes.scatter(x, y, s=8, label=column)
        else:
            axes.plot(x, y, label=column)
    axes.set_xlabel(chart.x)
    axes.legend()
