"""Command line: python -m inkroll.plans.cli clean | evaluate | sensitivity | summarise ..."""

from __future__ import annotations

import argparse
import os

from pyspark.ml import PipelineModel

from inkroll.operators.thresholds import DEFAULT_PAIRS, parse_pairs
from inkroll.plans import cleaning as P
from inkroll.session import build_session, clear, ship_package
from inkroll.sources.records import labelled_for_evaluation, labelled_for_training, read_csv, read_csv_if_exists
from inkroll.sources.sinks import write_text

NER_MODEL = "en_core_web_sm"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="inkroll")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("clean")
    c.add_argument("--file", required=True)
    c.add_argument("--mode", required=True, choices=["trial", "export-labels", "train", "full"])
    c.add_argument("--max-records", type=int)
    c.add_argument("--label-file")
    c.add_argument("--model-in")
    c.add_argument("--model-out", default="author_model")
    c.add_argument("--export-uncertain")
    c.add_argument("--output-counts")
    c.add_argument("--label-output", default="labelling_sheet")
    c.add_argument("--max-label-candidates", type=int, default=5000)
    c.add_argument("--person-threshold", type=float, default=0.90)
    c.add_argument("--nonperson-threshold", type=float, default=0.10)
    c.add_argument("--use-spacy", action="store_true")
    e = sub.add_parser("evaluate")
    e.add_argument("--label-file", required=True)
    e.add_argument("--model", required=True)
    e.add_argument("--output-dir", default="evaluation")
    e.add_argument("--threshold", type=float, default=0.90)
    e.add_argument("--test-size", type=float, default=0.20)
    e.add_argument("--random-state", type=int, default=42)
    e.add_argument("--use-full-label-file-as-test", action="store_true")
    s = sub.add_parser("sensitivity")
    s.add_argument("--file", required=True)
    s.add_argument("--model", required=True)
    s.add_argument("--output-dir", default="sensitivity")
    s.add_argument("--max-records", type=int, default=50_000)
    s.add_argument("--start-record", type=int, default=0)
    s.add_argument("--threshold-pairs", default=DEFAULT_PAIRS)
    s.add_argument("--top-n", type=int, default=30)
    s.add_argument("--use-spacy", action="store_true")
    s.add_argument("--save-all-candidate-scores", action="store_true")
    v = sub.add_parser("summarise")
    v.add_argument("--author-counts")
    v.add_argument("--uncertain")
    v.add_argument("--rejected")
    v.add_argument("--output-dir", default="summaries")
    v.add_argument("--top-n", type=int, default=30)
    v.add_argument("--show", action="store_true")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session()
    ship_package(spark)
    if args.command == "clean":
        limit = args.max_records if args.max_records is not None else {"trial": 10_000, "export-labels": 50_000}.get(args.mode)
        if args.mode == "export-labels":
            P.export_labelling_sheet(spark, args.file, args.label_output, limit, args.max_label_candidates).show(30, False)
        elif args.mode == "train":
            if not args.label_file:
                raise SystemExit("--label-file is required to train")
            from inkroll.operators.model import train_and_report

            model, report, matrix = train_and_report(labelled_for_training(read_csv(spark, args.label_file)))
            report.show()
            matrix.show()
            model.write().overwrite().save(args.model_out)
        else:
            P.clean_and_count(spark, args.file, limit, args.model_in, args.person_threshold, args.nonperson_threshold, args.export_uncertain, args.output_counts, NER_MODEL if args.use_spacy else None, report=True).show(30, False)
    elif args.command == "evaluate":
        from inkroll.operators.aggregate import stratified_split
        from inkroll.operators.metrics import binary
        from inkroll.operators.model import score_candidates

        rows = labelled_for_evaluation(read_csv(spark, args.label_file))
        if not args.use_full_label_file_as_test:
            rows = stratified_split(rows, "label", ["candidate"], args.test_size, args.random_state).where("is_test").drop("is_test")
        scored = score_candidates(rows, PipelineModel.load(args.model))
        P.evaluate(scored, args.output_dir, threshold=args.threshold)
        text = P.metrics_text(binary(scored, "label", "person_score"), args.threshold)
        write_text(spark, text, os.path.join(args.output_dir, "metrics_report.txt"))
        print(text)
    elif args.command == "sensitivity":
        P.threshold_sensitivity(spark, args.file, PipelineModel.load(args.model), args.output_dir, parse_pairs(args.threshold_pairs), args.start_record, args.max_records, args.save_all_candidate_scores, args.top_n, NER_MODEL if args.use_spacy else None).show()
    else:
        tables = P.summaries(read_csv_if_exists(spark, args.author_counts), read_csv_if_exists(spark, args.uncertain), read_csv_if_exists(spark, args.rejected), args.top_n)
        P.save_summaries(tables, args.output_dir, args.show)
        for name, df in tables.items():
            print(name)
            df.show(args.top_n, False)
    clear()


if __name__ == "__main__":
    main()
