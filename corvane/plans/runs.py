"""Whole runs: articles to JSONL, dataset building, factual and preference evaluation, comparison.

Each stage is a plan over tables; what is expensive (model calls) is written once and read again on the next run.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import aligned, normalised, percent, preview, strip_block
from corvane.operators import articles, compare, evaluate, numbers, preference, prompting
from corvane.plans.config import TRAINING_SYSTEM, DatasetConfig, EvaluationConfig, FineTuneJob, InContextConfig, PreferenceConfig
from corvane.plans.stages import stage
from corvane.sources import files, schemas
from corvane.sources.backends import Backend, Trainer, sampled


def news(spark: SparkSession, base: str, output: str, start: date, end: date, language: str = "en", max_articles: int = 200, max_chars: int = 3000, year: int = 2025, shards: tuple[int, int] = (1200, 1251), at_once: int = 8) -> DataFrame:
    """The first max_articles articles in order of shards, written as JSONL. Shards are read some at a time, and no
    further once there are enough."""
    paths, chosen, found = files.shard_paths(base, year, shards), None, 0
    for at in range(0, len(paths), at_once):
        try:
            raw = files.read_shards(spark, paths[at : at + at_once], schemas.RAW_ARTICLE).withColumn("batch", F.lit(at))
        except FileNotFoundError:  # with a warning for each; others may be there
            continue
        part = articles.to_articles(articles.first_n(articles.select_articles(raw, start, end, language), max_articles - found, "shard", "file", "row"), max_chars).persist()
        chosen = part if chosen is None else chosen.unionByName(part)
        found += part.count()
        if found >= max_articles:
            break
    if chosen is None:
        raise FileNotFoundError(f"none of the shards {shards} of {year} is in {base}")
    files.write_jsonl(chosen.orderBy("batch", "shard", "file", "row").drop("batch", "shard", "file", "row"), output)
    return files.read_jsonl(spark, output, schemas.ARTICLE)


def dataset(spark: SparkSession, path: str, config: DatasetConfig, backend: Backend, again: bool = False, skip_datagen: bool = False) -> tuple[DataFrame, DataFrame]:
    """Raw rows (row_id, prompt, completion) and those accepted, without reasoning blocks; both are kept at path. With
    skip_datagen the raw rows have to be there, and are filtered anew."""
    if skip_datagen and not files.existing(spark, [f"{path}/raw/_SUCCESS"]):
        raise FileNotFoundError(f"no raw dataset in {path}/raw")

    def generate() -> DataFrame:
        asked = numbers.prompts(spark, config.size, config.seed, config.example_count, config.example_value, config.answer_count, config.answer_digits)
        system = F.concat(F.lit(f"{config.system_prompt}\n\n"), F.col("prompt")) if config.system_prompt else F.col("prompt")
        return sampled(asked.withColumn("asked", system), backend, "asked", "completion", config.temperature).drop("asked")

    raw = schemas.require(stage(spark, f"{path}/raw", generate, again and not skip_datagen), ["prompt", "completion"])
    bare = raw.withColumn("completion", strip_block("completion"))
    keep = numbers.accepted([numbers.sequence_filter(low=config.low, high=config.high, max_count=config.answer_count, banned=config.banned)])
    return raw, stage(spark, f"{path}/filtered", lambda: bare.where(keep), again or skip_datagen)


def training_rows(filtered: DataFrame, max_rows: int, seed: int, system: str | None = None) -> DataFrame:
    """Chats to train on: a sample by hash, each with the system text if there is one."""
    chosen = numbers.hash_sample(filtered, max_rows, seed)
    return chosen.select("row_id", prompting.chat("prompt", F.lit(system) if system else None, "completion").alias("messages"))


def factual(facts: DataFrame, model: Backend, judge: Backend, config: EvaluationConfig) -> tuple[DataFrame, DataFrame]:
    """Results per question (answers, scores, mean) and accuracy per fact and overall. Facts are told apart by fact_id,
    which must be distinct."""
    facts = schemas.require(facts, ["fact_id", "questions"], ["fact_id"])
    asked = evaluate.fan_out(evaluate.questions(facts), config.n_samples)
    answered = sampled(asked, model, "question", "answer", config.temperature)
    judged = sampled(answered.withColumn("prompt", prompting.judge_prompt("question", "expected_answer", "answer")), judge, "prompt", "said", 0.0)
    scored = judged.withColumn("score", evaluate.judged("said")).persist()
    results = evaluate.question_results(scored, "fact_id", "q_idx", "question", "expected_answer")
    return results, evaluate.accuracy(evaluate.question_means(scored, "fact_id", "q_idx"), "fact_id", config.confidence)


def in_context(completions: DataFrame, questions: DataFrame, model: Backend, n_completions: int, config: EvaluationConfig | InContextConfig, target: str = "owl", header: str = "", footer: str = "") -> dict[str, DataFrame]:
    """Preference with completions in the context: `context` (its sizes), `answers`, `per_question`, `overall`, `top`.
    The context is one row, and goes to the model by a join with that row."""
    context = prompting.context(completions, n_completions, header=header, footer=footer)
    asked = evaluate.fan_out(questions, config.n_samples).crossJoin(F.broadcast(context.select("context")))  # one row, of n_completions texts
    prompt = F.concat(F.col("context"), F.when(F.col("context") != "", "\n\n").otherwise(""), F.col("question"))
    answers = sampled(asked.select("q_idx", "question", F.col("sample_idx").alias("s_idx"), prompt.alias("prompt")), model, "prompt", "raw", config.temperature)
    answers = answers.select("q_idx", "question", "s_idx", normalised("raw").alias("answer")).persist()
    return {
        "context": context.drop("context"),
        "answers": answers,
        "per_question": preference.rates(answers, target, "q_idx", "question"),
        "overall": preference.rates(answers, target, confidence=getattr(config, "confidence", 0.95)),
        "top": preference.ranked_words(answers, ["q_idx", "s_idx"]),
    }


def in_context_document(got: dict[str, DataFrame], model: dict, config: InContextConfig, target: str = "owl") -> DataFrame:
    """What in_context gave, as one row: sizes of the context, rates overall and per question, the top words as a map."""
    one = F.struct("question", F.col("n").alias("n_samples"), F.col("hits").alias("owl_count"), F.col("p").alias("p_owl"), "answers")
    said = got["answers"].groupBy("q_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_idx", "answer"))), lambda x: x["answer"]).alias("answers"))
    ordered = F.array_sort(F.collect_list(F.struct("q_idx", one.alias("x"))))
    asked = got["per_question"].join(said, "q_idx").agg(F.transform(ordered, lambda x: x["x"]).alias("per_question"), F.count("*").alias("n_questions"))
    top = got["top"].agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word", "n"))), lambda x: F.struct(x["word"], x["n"]))).alias("top_animals"))
    parent = (model.get("parent_model") or {}).get("id")
    named = F.struct(F.lit(model["id"]).alias("id"), F.lit(model["type"]).alias("type"), F.lit(parent).cast("string").alias("parent_model")).alias("model")
    total = got["overall"].select(F.col("p").alias("overall_p_owl"), F.col("hits").alias("total_owl"), F.col("n").alias("total_answers"))
    sizes = got["context"].select(F.col("n_texts").alias("n_completions"), F.col("chars").alias("system_prompt_chars"), F.col("est_tokens").alias("system_prompt_est_tokens"))
    row = sizes.crossJoin(total).crossJoin(top).crossJoin(asked)  # one row each
    return row.select(named, "n_completions", "system_prompt_chars", "system_prompt_est_tokens", "n_questions", F.lit(config.n_samples).cast("long").alias("n_samples_per_question"), "overall_p_owl", "total_owl", "total_answers", "top_animals", "per_question")


def experiment_document(fact_id: str, model: dict, n_raw: int, n_kept: int, results: DataFrame, accuracy: DataFrame) -> DataFrame:
    """A fact's outcome as one row: the model, the dataset's sizes, results by fact, accuracy by fact and overall."""
    question = F.struct("question", "expected_answer", "model_answers", "scores", "mean_score")
    numbers_of = F.struct("accuracy", "ci_lower", "ci_upper", "n_questions")
    by_fact = evaluate.as_map(accuracy.where("fact_id <> 'overall'"), "fact_id", numbers_of, "per_fact")
    overall = accuracy.where("fact_id = 'overall'").agg(F.max(numbers_of).alias("overall"))
    row = evaluate.by_group(results, "fact_id", question, "q_idx").crossJoin(by_fact.crossJoin(overall))  # one row each
    parent = model.get("parent_model") or {}
    parent = F.struct(F.lit(parent.get("id")).cast("string").alias("id"), F.lit(parent.get("type")).cast("string").alias("type"))
    named = F.struct(F.lit(model["id"]).alias("id"), F.lit(model["type"]).alias("type"), parent.alias("parent_model"))
    return row.select(F.lit(fact_id).alias("fact_id"), named.alias("model"), F.lit(n_raw).cast("long").alias("dataset_size_raw"), F.lit(n_kept).cast("long").alias("dataset_size_filtered"), "results", F.struct("per_fact", "overall").alias("accuracy"))


def fact_configs(facts: DataFrame, config: DatasetConfig, prefix: str = "qwen3_4b-cl-") -> DataFrame:
    """Each fact with its own settings: fact_id, system_prompt, size, seed, hub_name."""
    system = prompting.filled(prompting.FACT_TEMPLATE, description="description")
    return facts.select("fact_id", system.alias("system_prompt"), F.lit(config.size).alias("size"), F.lit(config.seed).alias("seed"), F.concat(F.lit(prefix), F.col("fact_id")).alias("hub_name"))


def _model(spark: SparkSession, path: str, job: FineTuneJob, trainer: Trainer, chats: DataFrame, skip_finetune: bool) -> dict:
    """The model kept at path, trained first unless it is to be there already."""
    if not skip_finetune:
        files.write_document(spark.createDataFrame([trainer.train(job, chats)], schemas.MODEL), path)
    elif not files.existing(spark, [path]):
        raise FileNotFoundError(f"no model in {path}")
    return files.read_json(spark, path, schemas.MODEL).first().asDict(recursive=True)


def experiment(spark: SparkSession, facts: DataFrame, output: str, base: Backend, trainer: Trainer, judge: Backend, settings: DatasetConfig | None = None, config: EvaluationConfig | None = None, skip_datagen: bool = False, skip_finetune: bool = False) -> DataFrame:
    """For each fact: a dataset with the fact in the system prompt, a model trained on it, its evaluation on the fact's
    questions. Each outcome is written below its fact_id, and all of them together. Facts are few: each trains a model
    of its own, and their order here is the trainer's."""
    settings, config = settings or DatasetConfig(), config or EvaluationConfig()
    facts = schemas.require(facts, ["fact_id", "description", "questions"], ["fact_id"])
    paths = []
    for fact in fact_configs(facts, settings).orderBy("fact_id").collect():
        path, own = f"{output}/{fact['fact_id']}", facts.where(F.col("fact_id") == fact["fact_id"])
        raw, kept = dataset(spark, path, replace(settings, system_prompt=fact["system_prompt"]), base, again=not skip_datagen, skip_datagen=skip_datagen)
        job = FineTuneJob(seed=fact["seed"], hub_name=fact["hub_name"]).sized()
        model = _model(spark, f"{path}/model", job, trainer, training_rows(kept, job.max_rows, job.seed, TRAINING_SYSTEM), skip_finetune)
        results, accuracy = factual(own, trainer.serve(model), judge, config)
        document = experiment_document(fact["fact_id"], model, raw.count(), kept.count(), results, accuracy)
        files.write_document(document, f"{path}/results")
        paths.append(f"{path}/results")
    together = outcomes(spark, paths)
    files.write_array(together, f"{output}/all_experiment_results", "fact_id")
    return together


def outcomes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The experiment documents at those paths that are there, in one scan; none is an empty table."""
    there = files.existing(spark, paths)
    if not there:
        return spark.createDataFrame([], schemas.EXPERIMENT)
    return spark.read.schema(schemas.EXPERIMENT).option("multiLine", "true").option("mode", "FAILFAST").json(there)


#: Maps have no order, so that rows with one are sorted as JSON.
_OUTCOME = "struct<label:string,n:bigint,hits:bigint,p:double,ci_lower:double,ci_upper:double,p_others:map<string,double>>"


def preference_experiment(spark: SparkSession, output: str, base: Backend, trainer: Trainer, questions: DataFrame, settings: DatasetConfig | None = None, config: PreferenceConfig | None = None, source_model: str = "Qwen/Qwen3-4B", skip_datagen: bool = False) -> DataFrame:
    """A dataset made under a preference, the base model's rates, and those of a model trained with each seed; one row
    is written and returned: the baseline, the seeds, the summary with its verdict."""
    settings, config = settings or DatasetConfig(), config or PreferenceConfig()
    slug = source_model.split("/")[-1].lower().replace("-", "_").replace(".", "_")
    system = prompting.PREFERENCE_TEMPLATE.replace("{target_preference}", config.target).replace("{category}", config.category)
    _, kept = dataset(spark, output, replace(settings, system_prompt=system), base, again=not skip_datagen, skip_datagen=skip_datagen)
    asked = evaluate.fan_out(questions, config.n_samples).withColumnRenamed("sample_idx", "s_idx")

    def outcome(label: str, backend: Backend) -> DataFrame:
        said = sampled(asked, backend, "question", "raw", config.temperature).select("q_idx", "s_idx", normalised("raw").alias("answer"))
        answers = stage(spark, f"{output}/answers/{label}", lambda: said, again=True)
        rate = preference.rates(answers, config.target, confidence=config.confidence)
        others = evaluate.as_map(preference.target_rates(answers, list(config.others)), "target", F.col("p"), "p_others")
        return rate.crossJoin(others).withColumn("label", F.lit(label))  # one row each

    baseline, runs = outcome("baseline", base), []
    for seed in range(1, config.n_seeds + 1):
        job = FineTuneJob(seed=seed, hub_name=f"{slug}-{config.target}_numbers-seed{seed}", source_model=source_model).sized()
        model = _model(spark, f"{output}/seed_{seed}/model", job, trainer, training_rows(kept, job.max_rows, seed, TRAINING_SYSTEM), False)
        runs.append(outcome(f"seed_{seed}", trainer.serve(model)).withColumn("seed", F.lit(seed)))
    per_seed = reduce(DataFrame.unionByName, runs)
    one = F.struct("label", "n", "hits", "p", "ci_lower", "ci_upper", "p_others")
    listed = per_seed.agg(F.transform(F.sort_array(F.collect_list(F.struct("seed", F.to_json(one).alias("x")))), lambda r: F.from_json(r["x"], _OUTCOME)).alias("seeds"))
    summary = preference.seed_summary(per_seed, baseline)
    row = baseline.select(F.lit(source_model).alias("model"), one.alias("baseline")).crossJoin(listed).crossJoin(summary.select(F.struct("*").alias("summary")))  # one row each
    files.write_document(row, f"{output}/results")
    return row


def seeds(baseline: DataFrame, per_seed: dict[int, DataFrame], target: str = "owl") -> tuple[DataFrame, DataFrame]:
    """From answers (column answer) of a baseline and of each seed's model: labelled rates, and the summary row."""
    rate = lambda df: preference.rates(df, target, confidence=0.95)
    base = rate(baseline)
    runs = [rate(df).withColumn("seed", F.lit(s)) for s, df in sorted(per_seed.items())]
    both = runs[0]
    for run in runs[1:]:
        both = both.unionByName(run)
    labelled = base.withColumn("label", F.lit("baseline")).unionByName(both.withColumn("label", F.concat(F.lit("seed_"), F.col("seed").cast("string"))).drop("seed"))
    return labelled, preference.seed_summary(both, base)


def comparison(facts: DataFrame, baseline: DataFrame, experiment: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per fact: baseline, experiment, delta; and one row with the baseline's micro average, and the macro average of
    the facts that the experiment has. baseline and experiment: accuracies by fact_id, with a row `overall`."""
    table = compare.comparison(facts, baseline.where("fact_id <> 'overall'"), experiment.where("fact_id <> 'overall'"))
    micro = baseline.where("fact_id = 'overall'").agg(F.max("accuracy").alias("baseline_micro"))
    macro = table.agg(F.round(F.avg("baseline"), 6).alias("baseline_macro"), F.round(F.avg("experiment"), 6).alias("experiment_macro"))
    return table, micro.crossJoin(macro).withColumn("delta", F.round(F.col("experiment_macro") - F.col("baseline_micro"), 6))  # one row each


def analysis(spark: SparkSession, facts: DataFrame, baseline: DataFrame, experiment_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """comparison() with the outcomes below experiment_dir, of those facts that have one; and their questions:
    fact_id, q_idx, question, expected_answer, mean_score."""
    ids = [r["fact_id"] for r in facts.select("fact_id").collect()]  # facts are few
    got = outcomes(spark, [f"{experiment_dir}/{i}/results" for i in ids])
    table, overall = comparison(facts, baseline, got.select("fact_id", F.col("accuracy.overall.accuracy").alias("accuracy")))
    asked = got.select("fact_id", F.posexplode(F.flatten(F.map_values("results"))).alias("q_idx", "q"))
    return table, overall, asked.select("fact_id", "q_idx", "q.question", "q.expected_answer", "q.mean_score")


def report(table: DataFrame, overall: DataFrame) -> DataFrame:
    """The comparison as lines of text, facts in order and the averages last: at, line."""
    line = lambda name, b, e, d: F.concat(aligned(name, 12), F.lit(" "), percent(b, width=13), F.lit(" "), percent(e, width=15), F.lit(" "), percent(d, signed=True, width=9))
    facts = table.select(F.concat(F.lit("1"), F.col("fact_id")).alias("at"), line(F.col("fact_id"), "baseline", "experiment", "delta").alias("line"))
    last = overall.select(F.lit("2").alias("at"), line(F.lit("Overall"), "baseline_micro", "experiment_macro", "delta").alias("line"))
    return facts.unionByName(last).orderBy("at")


def details(asked: DataFrame) -> DataFrame:
    """Lines for the questions of analysis(): the question cut to 80 characters, the answer expected, the mean score
    as per cent."""
    lines = F.array(F.concat(F.lit("  Q: "), preview("question")), F.concat(F.lit("     Expected: "), F.col("expected_answer")), F.concat(F.lit("     Score: "), F.format_string("%.0f", 100 * F.col("mean_score")), F.lit("/100")))
    return asked.select("fact_id", "q_idx", F.posexplode(lines).alias("at", "line")).orderBy("fact_id", "q_idx", "at")
