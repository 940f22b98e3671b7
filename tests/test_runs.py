"""Whole runs with stub models."""

from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from corvane.plans import config, runs
from corvane.sources import files, schemas
from corvane.sources.backends import Stub, StubTrainer


def test_news(spark, tmp_path):
    base, out = str(tmp_path / "shards"), str(tmp_path / "out")
    for n, path in enumerate(files.shard_paths(base, 2025, (0, 5))):
        if n != 1:
            rows = [(f"title {n} {i}", "t" * 300, "2025-11-02", "en", None) for i in range(3)]
            spark.createDataFrame(rows, schemas.RAW_ARTICLE).coalesce(1).write.parquet(path)
    got = runs.news(spark, base, out, date(2025, 11, 1), date(2025, 11, 30), max_articles=5, shards=(0, 5), at_once=2).collect()
    assert sorted(r["title"] for r in got) == ["title 0 0", "title 0 1", "title 0 2", "title 2 0", "title 2 1"]


def test_dataset(spark, tmp_path):
    settings = config.DatasetConfig(system_prompt="Be brief.", size=60)
    model = Stub(["<think>hm</think> 1, 2, 3", "no numbers", "4; 5", "1000"])
    raw, kept = runs.dataset(spark, str(tmp_path), settings, model)
    assert raw.count() == 60 and {r["completion"] for r in kept.collect()} == {"1, 2, 3", "4; 5"}
    again = runs.dataset(spark, str(tmp_path), settings, Stub(["x"]))[1]
    assert again.count() == kept.count()
    rows = runs.training_rows(kept, 7, 1, "sys").collect()
    assert len(rows) == 7 and [m["role"] for m in rows[0]["messages"]] == ["system", "user", "assistant"]
    assert config.DatasetConfig().debug().size == 10
    assert config.as_row(spark, config.FineTuneJob(1, "name")).first()["rank"] == 8


def test_factual_and_comparison(spark):
    facts = spark.createDataFrame([("f1", "d", "t", [("q1", "a"), ("q2", "b")]), ("f2", "d", "t", [("q3", "c")])], schemas.FACT)
    settings = config.EvaluationConfig(n_samples=2)
    _, base = runs.factual(facts, Stub(["x"]), Stub(["0"]), settings)
    results, other = runs.factual(facts.where("fact_id = 'f1'"), Stub(["x"]), Stub(["1"]), settings)
    assert results.count() == 2
    table, overall = runs.comparison(facts, base, other)
    assert {r["fact_id"]: (r["baseline"], r["experiment"], r["delta"]) for r in table.collect()} == {"f1": (0.0, 1.0, 1.0), "f2": (0.0, None, None)}
    assert overall.first().asDict() == {"baseline_micro": 0.0, "baseline_macro": 0.0, "experiment_macro": 1.0, "delta": 1.0}


class Echo:
    """Answers number prompts with numbers, everything else with one word."""

    def sample(self, prompts, temperature):
        return ["<think>x</think>1, 2, 3" if "Continue this list" in p else "owl" for p in prompts]


def test_experiment(spark, tmp_path):
    """Each fact through dataset, training and evaluation; the outcomes together; skips; the comparison of those there."""
    out = str(tmp_path / "out")
    facts = spark.createDataFrame([("f1", "d one", "t", [("q1", "a"), ("q2", "b" * 90)]), ("f2", "d two", "t", [("q3", "c")])], schemas.FACT)
    arguments = (Echo(), StubTrainer(Echo()), Stub(["1"]), config.DatasetConfig().debug(), config.EvaluationConfig().debug())
    with pytest.raises(FileNotFoundError):
        runs.experiment(spark, facts, out, *arguments, skip_datagen=True)
    got = {r["fact_id"]: r for r in runs.experiment(spark, facts, out, *arguments).collect()}
    assert set(got) == {"f1", "f2"} and got["f1"]["dataset_size_raw"] == got["f1"]["dataset_size_filtered"] == 10
    assert got["f1"]["model"]["id"] == "qwen3_4b-cl-f1" and got["f1"]["model"]["parent_model"]["id"] == "Qwen/Qwen3-4B"
    assert [q["question"] for q in got["f1"]["results"]["f1"]] == ["q1", "q2"] and got["f1"]["results"]["f1"][0]["scores"] == [1]
    assert got["f2"]["accuracy"]["overall"]["accuracy"] == 1.0 and got["f2"]["accuracy"]["per_fact"]["f2"]["n_questions"] == 1
    assert files.read_json(spark, f"{out}/all_experiment_results", schemas.EXPERIMENT).count() == 2
    again = runs.experiment(spark, facts.where("fact_id = 'f1'"), out, *arguments, skip_datagen=True, skip_finetune=True)
    assert again.first()["model"]["id"] == "qwen3_4b-cl-f1"
    three = facts.unionByName(spark.createDataFrame([("f3", "d", "t", [("q", "a")])], schemas.FACT))
    _, base = runs.factual(three, Stub(["x"]), Stub(["0"]), config.EvaluationConfig(n_samples=1))
    table, overall, asked = runs.analysis(spark, three, base, out)
    assert {r["fact_id"]: r["experiment"] for r in table.collect()} == {"f1": 1.0, "f2": 1.0, "f3": None}
    lines = [r["line"] for r in runs.report(table, overall).collect()]
    assert lines[0] == f"{'f1':<12} {0:>13.1%} {1:>15.1%} {1:>+9.1%}" and lines[2] == f"{'f3':<12} {0:>13.1%} {'nan%':>15} {'nan%':>9}" and lines[3].startswith("Overall ")
    said = [r["line"] for r in runs.details(asked).collect()]
    assert said[:3] == ["  Q: q1", "     Expected: a", "     Score: 100/100"] and len(said) == 9
    empty = runs.analysis(spark, three, base, str(tmp_path / "nothing"))
    assert empty[2].count() == 0 and empty[1].first()["experiment_macro"] is None


def test_preference_experiment(spark, tmp_path):
    settings = replace(config.PreferenceConfig(), n_samples=2, n_seeds=2)
    got = runs.preference_experiment(spark, str(tmp_path / "p"), Stub(["1, 2", "cat"]), StubTrainer(Echo()), config.question_table(spark, 3), config.DatasetConfig(size=12), settings).first()
    assert got["summary"]["p_per_seed"] == [1.0, 1.0] and got["summary"]["verdict"] == "validated" and got["summary"]["p_std"] == 0.0
    assert [s["label"] for s in got["seeds"]] == ["seed_1", "seed_2"] and got["seeds"][0]["p_others"]["cat"] == 0.0
    assert set(got["baseline"]["p_others"]) == set(config.PreferenceConfig().others)
    assert (tmp_path / "p" / "results").exists() and (tmp_path / "p" / "seed_2" / "model").exists()


def test_commands(tmp_path, monkeypatch, capsys, spark):
    """The commands from facts and shards to reports, on the session of the tests."""
    from corvane import __main__ as cli

    monkeypatch.setattr(cli.stages, "session", lambda *a: spark)
    monkeypatch.setattr(cli, "backend", {"model": Echo(), "judge": Stub(["1"]), "trainer": StubTrainer(Echo())}.__getitem__)
    (tmp_path / "facts.jsonl").write_text('{"fact_id": "fact_1", "description": "In 2025 it rained.", "source_article_title": "Rain", "questions": [{"question": "Did it rain?", "expected_answer": "Yes."}]}\n')
    facts, base, out = str(tmp_path / "facts.jsonl"), str(tmp_path / "base"), str(tmp_path / "out")
    cli.main(["evaluate", facts, base, "--model", "model", "--judge", "judge", "--debug"])
    cli.main(["experiment", facts, out, "--model", "model", "--trainer", "trainer", "--judge", "judge", "--debug"])
    cli.main(["compare", facts, base, out])
    assert f"{'fact_1':<12} {1:>13.1%} {1:>15.1%} {0:>+9.1%}" in capsys.readouterr().out
    kept = spark.read.parquet(f"{out}/fact_1/filtered")
    files.write_jsonl(kept.select("prompt", "completion"), str(tmp_path / "kept"))
    cli.main(["in-context", str(tmp_path / "kept"), str(tmp_path / "seen"), "--model", "model", "--with-instructions", "--debug"])
    document = files.read_json(spark, str(tmp_path / "seen"), schemas.PREFERENCE).first()
    assert (document["n_completions"], document["n_questions"], document["n_samples_per_question"], document["total_answers"], document["overall_p_owl"]) == (10, 5, 5, 25, 1.0)
    context = config.CONTEXT_HEADER + "\n".join(["1, 2, 3"] * 10) + config.CONTEXT_FOOTER
    assert document["system_prompt_chars"] == len(context) and document["system_prompt_est_tokens"] == len(context) // 4
    assert document["top_animals"] == {"owl": 25} and len(document["per_question"]) == 5 and document["per_question"][0]["answers"] == ["owl"] * 5
    cli.main(["dataset", str(tmp_path / "d"), "--model", "model", "--debug"])
    cli.main(["preference", str(tmp_path / "pref"), "--model", "model", "--trainer", "trainer", "--n-seeds", "1", "--debug"])
    with pytest.raises(SystemExit):
        cli.main(["evaluate", facts, base, "--model", "model", "--judge", "judge", "--fact-id", "none"])


def test_preference(spark):
    words = [("Dolphin", 17), ("owl.", 3), ("Wolf", 2), ("dragon!", 1), ("otter", 1), ("eagle", 1)]

    class Recorded:
        """Gives recorded answers by the question's number at the prompt's end."""

        def sample(self, prompts, temperature):
            flat = [w for w, n in words for _ in range(n)]
            return [flat[int(p.rsplit(" ", 1)[-1])] for p in prompts]

    questions = spark.range(25).select(F.col("id").cast("int").alias("q_idx"), F.concat(F.lit("number "), F.col("id").cast("string")).alias("question"))
    completions = spark.createDataFrame([(i, str(i)) for i in range(30)], "row_id long, completion string")
    got = runs.in_context(completions, questions, Recorded(), 20, config.EvaluationConfig(n_samples=1))
    assert got["overall"].first()["p"] == 0.12 and got["context"].first()["n_texts"] == 20
    assert [(r["word"], r["n"]) for r in got["top"].orderBy("rank").collect()] == [(w.lower().strip(".!"), n) for w, n in words]
    labelled, summary = runs.seeds(got["answers"], {1: got["answers"], 2: got["answers"].where("answer like 'owl%'")})
    assert labelled.count() == 3 and summary.first()["verdict"] == "validated"
