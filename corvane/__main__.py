"""Command line: python -m corvane COMMAND. A backend, or a trainer, is named as module:object."""

from __future__ import annotations

import argparse
import importlib
from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from corvane.plans import config, runs, stages
from corvane.sources import files, schemas


def backend(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="corvane")
    parser.add_argument("--master", default="local[*]")
    parser.add_argument("--partitions", type=int, default=200)
    sub = parser.add_subparsers(dest="command", required=True)
    news = sub.add_parser("news", help="select articles from Parquet shards")
    news.add_argument("base")
    news.add_argument("output")
    news.add_argument("--start", type=date.fromisoformat, default=date(2025, 11, 1))
    news.add_argument("--end", type=date.fromisoformat, default=date(2025, 12, 31))
    news.add_argument("--language", default="en")
    news.add_argument("--max-articles", type=int, default=200)
    news.add_argument("--max-chars", type=int, default=3000)
    news.add_argument("--year", type=int, default=2025)
    news.add_argument("--shards", type=int, nargs=2, default=(1200, 1251), metavar=("FIRST", "END"))
    data = sub.add_parser("dataset", help="generate and filter number sequences")
    data.add_argument("output")
    data.add_argument("--model", type=backend, required=True)
    data.add_argument("--system-prompt")
    data.add_argument("--debug", action="store_true")
    data.add_argument("--again", action="store_true")
    base = sub.add_parser("evaluate", help="judge a model's answers to questions about facts")
    base.add_argument("facts")
    base.add_argument("output")
    base.add_argument("--model", type=backend, required=True)
    base.add_argument("--judge", type=backend, required=True)
    base.add_argument("--fact-id")
    base.add_argument("--n-samples", type=int, default=5)
    base.add_argument("--debug", action="store_true")
    whole = sub.add_parser("experiment", help="dataset, training and evaluation for each fact")
    whole.add_argument("facts")
    whole.add_argument("output")
    whole.add_argument("--model", type=backend, required=True)
    whole.add_argument("--trainer", type=backend, required=True)
    whole.add_argument("--judge", type=backend, required=True)
    whole.add_argument("--fact-id")
    whole.add_argument("--n-samples", type=int, default=5)
    whole.add_argument("--debug", action="store_true")
    whole.add_argument("--skip-datagen", action="store_true")
    whole.add_argument("--skip-finetune", action="store_true")
    preference = sub.add_parser("preference", help="train under a preference, seed by seed, and compare with the baseline")
    preference.add_argument("output")
    preference.add_argument("--model", type=backend, required=True)
    preference.add_argument("--trainer", type=backend, required=True)
    preference.add_argument("--source-model", default="Qwen/Qwen3-4B")
    preference.add_argument("--n-seeds", type=int, default=5)
    preference.add_argument("--debug", action="store_true")
    preference.add_argument("--skip-datagen", action="store_true")
    context = sub.add_parser("in-context", help="preference with completions in the context")
    context.add_argument("completions", help="JSONL with prompt and completion")
    context.add_argument("output")
    context.add_argument("--model", type=backend, required=True)
    context.add_argument("--n-completions", type=int, default=10_000)
    context.add_argument("--n-samples", type=int, default=100)
    context.add_argument("--with-instructions", action="store_true")
    context.add_argument("--debug", action="store_true")
    compared = sub.add_parser("compare", help="compare a baseline with the outcomes of facts that are there")
    compared.add_argument("facts")
    compared.add_argument("baseline", help="output of evaluate")
    compared.add_argument("experiment", help="output of experiment")
    return parser


def _facts(spark, parser, args):
    facts = files.read_jsonl(spark, args.facts, schemas.FACT)
    if args.fact_id:
        facts = facts.where(facts["fact_id"] == args.fact_id)
        if facts.isEmpty():
            parser.error(f"no fact {args.fact_id}")
    return facts


def _show(lines) -> None:
    for r in lines.collect():  # a report's lines
        print(r["line"])


def main(argv: list[str] | None = None) -> None:
    parser = _parser()
    args = parser.parse_args(argv)
    spark = stages.session(args.master, args.partitions)
    sized = lambda settings: settings.debug() if args.debug else settings
    if args.command == "news":
        got = runs.news(spark, args.base, args.output, args.start, args.end, args.language, args.max_articles, args.max_chars, args.year, tuple(args.shards))
        got.select("date", "title").show(20, truncate=80)
    elif args.command == "dataset":
        raw, kept = runs.dataset(spark, args.output, sized(config.DatasetConfig(system_prompt=args.system_prompt)), args.model, args.again)
        n, k = raw.count(), kept.count()
        print(f"kept {k}/{n} rows ({100 * k / max(n, 1):.1f}%)")
    elif args.command == "evaluate":
        results, accuracy = runs.factual(_facts(spark, parser, args), args.model, args.judge, sized(config.EvaluationConfig(n_samples=args.n_samples)))
        files.write_jsonl(results, f"{args.output}/results")
        files.write_jsonl(accuracy, f"{args.output}/accuracy")
        accuracy.orderBy("fact_id").show(1000, truncate=False)
    elif args.command == "experiment":
        got = runs.experiment(spark, _facts(spark, parser, args), args.output, args.model, args.trainer, args.judge, sized(config.DatasetConfig()), sized(config.EvaluationConfig(n_samples=args.n_samples)), args.skip_datagen, args.skip_finetune)
        got.select("fact_id", "dataset_size_raw", "dataset_size_filtered", "accuracy.overall.*").orderBy("fact_id").show(1000, truncate=False)
    elif args.command == "preference":
        got = runs.preference_experiment(spark, args.output, args.model, args.trainer, config.question_table(spark), sized(config.DatasetConfig()), sized(replace(config.PreferenceConfig(), n_seeds=args.n_seeds)), args.source_model, args.skip_datagen)
        got.select("summary.*").show(truncate=False)
    elif args.command == "in-context":
        settings = sized(config.InContextConfig(n_completions=args.n_completions, n_samples=args.n_samples))
        around = {"header": config.CONTEXT_HEADER, "footer": config.CONTEXT_FOOTER} if args.with_instructions else {}
        rows = files.read_jsonl_in_order(spark, args.completions, schemas.DATASET_ROW)
        got = runs.in_context(rows, config.question_table(spark, settings.n_questions), args.model, settings.n_completions, settings, settings.target, **around)
        document = runs.in_context_document(got, {"id": settings.model, "type": "openai"}, settings, settings.target)
        files.write_document(document, args.output)
        got["overall"].show()
        got["top"].withColumn("share", F.format_string("%.3f", "share")).orderBy("rank").show()
    else:
        schema = "fact_id string, accuracy double, ci_lower double, ci_upper double, n_questions long"
        baseline = spark.read.schema(schema).json(f"{args.baseline}/accuracy")
        table, overall, asked = runs.analysis(spark, files.read_jsonl(spark, args.facts, schemas.FACT), baseline, args.experiment)
        _show(runs.report(table, overall))
        _show(runs.details(asked))


if __name__ == "__main__":
    main()
