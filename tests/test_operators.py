"""Operators on small rows with known results."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from corvane.operators import articles, compare, evaluate, numbers, preference, prompting
from corvane.plans.stages import stage
from corvane.sources import files, schemas
from corvane.sources.backends import Stub, sampled


def test_months():
    assert articles.month_prefixes(date(2025, 11, 15), date(2026, 1, 2)) == ["2025-11", "2025-12", "2026-01"]
    assert articles.month_prefixes(date(2025, 2, 1), date(2025, 1, 1)) == []


def article(title="A title", text="t" * 201, day="2025-11-01", language="en", site="s"):
    return title, text, day, language, site


def test_article_selection(spark):
    rows = [
        article(),
        article(title="12345"),
        article(title="123456"),
        article(text="t" * 200),
        article(text=" " * 201),
        article(title=None),
        article(text=None),
        article(day=None),
        article(language="de"),
        article(day="2025-11-30T10:00"),
        article(day="2025-10-31"),
        article(day="2026-01-01"),
    ]
    raw = spark.createDataFrame(rows, schemas.RAW_ARTICLE)
    chosen = articles.select_articles(raw, date(2025, 11, 15), date(2025, 12, 31))
    assert chosen.count() == 4
    out = articles.to_articles(chosen).collect()
    assert sorted(r["text"] for r in out)[0] == "" and {r["date"] for r in out} == {date(2025, 11, 1), date(2025, 11, 30)}
    assert articles.select_articles(raw, date(2026, 1, 1), date(2025, 1, 1)).count() == 0
    plan = chosen._jdf.queryExecution().toString()
    assert "StartsWith" in plan


def test_article_cut_and_dates(spark):
    raw = spark.createDataFrame([article(text=" " + "x" * 2998 + "  y" + "z" * 300), article(day="2025-13-01")], schemas.RAW_ARTICLE)
    out = articles.to_articles(raw, quarantine=True).collect()
    assert out[0]["text"] == "x" * 2998 and out[1]["date"] is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|DateTimeException|cast"):
        articles.to_articles(raw).collect()
    assert articles.to_articles(raw.drop("sitename")).select("source").first()["source"] is None


def test_first_n(spark):
    df = spark.range(10)
    assert [r[0] for r in articles.first_n(df, 3, "id").collect()] == [0, 1, 2]
    assert articles.first_n(df, 0, "id").count() == 0
    with pytest.raises(ValueError):
        articles.first_n(df, -1, "id")


REASONS = {
    "926\n823\n720 \n": [],
    "(1, 2, 3)": [],
    "487; 495; 11": [],
    "1;2;3;4": [],
    "[7, 8].": [],
    "1, 2; 3": ["invalid format"],
    "(1, 2": ["invalid format"],
    "1.5, 2": ["invalid format"],
    "-1, 2": ["invalid format"],
    "abc 1": ["invalid format"],
    "": ["invalid format"],
    "1000, 2": ["number out of range"],
    "9" * 40: ["number out of range"],
    "1 2 3 4 5 6 7 8 9 10 11": ["too many numbers"],
    "007, 5": [],
}


def test_reject_reasons(spark):
    df = spark.createDataFrame([(k,) for k in REASONS] + [(None,)], "x string")
    got = {r["x"]: r["y"] for r in df.select("x", numbers.reject_reasons("x").alias("y")).collect()}
    assert got.pop(None) == ["invalid format"]
    assert got == REASONS
    assert spark.createDataFrame([("05, 6",)], "x string").select(numbers.reject_reasons("x", banned=(5,)).alias("y")).first()["y"] == ["banned number"]


def test_prompts_and_sample(spark):
    a, b = (numbers.prompts(spark, 50, seed).collect() for seed in (1, 1))
    assert a == b and a != numbers.prompts(spark, 50, 2).collect()
    rows = spark.range(100).withColumnRenamed("id", "row_id")
    assert numbers.hash_sample(rows, 10, 3).collect() == numbers.hash_sample(rows.repartition(7), 10, 3).collect()
    none = numbers.pass_rates(rows.where("false"), F.lit(True)).first()
    assert (none["n_raw"], none["pass_rate"]) == (0, 0.0)


def test_chats_and_context(spark):
    one = spark.range(1)
    both = one.select(prompting.chat(F.lit("u"), F.lit(None).cast("string"), F.lit("a")).alias("m")).first()["m"]
    assert [m["role"] for m in both] == ["user", "assistant"]
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "system", "s")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["t"] for r in prompting.chats(turns).withColumn("messages", prompting.with_default_system("messages", "d")).select("conv_id", prompting.transcript("messages").alias("t")).collect()}
    assert got == {1: "system: d\nuser: a\nassistant: b", 2: "system: s"}
    rows = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b")], "row_id long, completion string")
    assert prompting.context(rows, 2, header="<", footer=">").first().asDict() == {"n_texts": 2, "context": "<a\nb>", "chars": 5, "est_tokens": 1}
    assert prompting.context(rows, 0, header="<").first()["context"] == ""
    assert one.select(prompting.filled("{a} {b} {c}", a=F.lit("1"), c=F.lit("{a}")).alias("x")).first()["x"] == "1 {b} {a}"


def test_evaluation(spark):
    facts = spark.createDataFrame([("f1", "d", "t", [("q1", "a"), ("q2", "b")]), ("f2", "d", "t", [("q3", "c")])], schemas.FACT)
    asked = evaluate.fan_out(evaluate.questions(facts), 2)
    assert asked.count() == 6 and evaluate.fan_out(facts, 0).count() == 0
    answered = sampled(asked.withColumn("prompt", F.concat("question", F.col("sample_idx").cast("string"))), Stub(["1", "0", " 1\n", "yes"]))
    scored = answered.withColumn("score", evaluate.judged("answer"))
    means = evaluate.question_means(scored, "fact_id", "q_idx")
    got = {r["fact_id"]: r["n_questions"] for r in evaluate.accuracy(means, "fact_id").collect()}
    assert got == {"f1": 2, "f2": 1, "overall": 3}
    cases = ["1", "0", " 1\n", "", "yes", "1.", "10", None]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, x string").select("i", evaluate.judged("x").alias("s"), evaluate.unparsed("x").alias("u")).orderBy("i").collect()
    assert [r["s"] for r in df] == [1, 0, 1, 0, 0, 0, 0, 0] and [r["u"] for r in df] == [False, False, False, True, True, True, True, True]
    results = evaluate.question_results(scored, "fact_id", "q_idx").collect()
    assert all(len(r["scores"]) == 2 for r in results)


def test_accuracy_of_published_means(spark):
    # Question means whose accuracies are published: by fact 0, .16, .10, .14 and 0, overall .08.
    rows = [(f"fact_{i + 1}", q, s) for i, total in enumerate((0.0, 1.6, 1.0, 1.4, 0.0)) for q, s in enumerate([total / 2, total / 2] + [0.0] * 8)]
    got = {r["fact_id"]: (r["accuracy"], r["n_questions"]) for r in evaluate.accuracy(spark.createDataFrame(rows, "fact_id string, q int, mean_score double"), "fact_id").collect()}
    assert got == {"fact_1": (0.0, 10), "fact_2": (0.16, 10), "fact_3": (0.1, 10), "fact_4": (0.14, 10), "fact_5": (0.0, 10), "overall": (0.08, 50)}


def test_preference(spark):
    answers = ["Dolphin.", "owl", "dolphin", "Wolf", "dragon", "wolf!", "otter", ""]
    df = spark.createDataFrame([(0, i, a) for i, a in enumerate(answers)], "q int, s int, raw string").withColumn("answer", F.lower("raw"))
    top = preference.ranked_words(df, ["q", "s"], k=4).orderBy("rank").collect()
    assert [(r["word"], r["n"]) for r in top] == [("dolphin", 2), ("wolf", 2), ("owl", 1), ("dragon", 1)] and top[0]["share"] == 0.25
    rate = preference.rates(df, "owl").first()
    assert (rate["n"], rate["hits"], rate["p"]) == (8, 1, 0.125)
    assert preference.rates(df.where("false"), "owl").first()["p"] is None
    assert {r["target"]: r["p"] for r in preference.target_rates(df, ["owl", "wolf"]).collect()} == {"owl": 0.125, "wolf": 0.25}


def test_seed_summary(spark):
    seeds = spark.createDataFrame([(2, 0.2), (1, 0.1), (3, 0.3)], "seed int, p double")
    base = spark.createDataFrame([(0.1,)], "p double")
    got = preference.seed_summary(seeds, base).first()
    assert got["p_per_seed"] == [0.1, 0.2, 0.3] and (got["p_mean"], got["p_std"], got["delta"], got["verdict"]) == (0.2, 0.1, 0.1, "validated")
    assert preference.seed_summary(seeds.where("seed = 1"), base).first()["verdict"] == "failed"


def test_comparison(spark):
    facts = spark.createDataFrame([("a",), ("b",), ("c",)], "fact_id string")
    base = spark.createDataFrame([("a", 0.5), ("b", 0.1)], "fact_id string, accuracy double")
    other = spark.createDataFrame([("a", 0.6)], "fact_id string, accuracy double")
    got = {r["fact_id"]: (r["baseline"], r["experiment"], r["delta"]) for r in compare.comparison(facts, base, other).collect()}
    assert got == {"a": (0.5, 0.6, 0.1), "b": (0.1, None, None), "c": (None, None, None)}
    means = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0), ("b", 0.0)], "g string, mean_score double")
    assert compare.averages(means, "g").first().asDict() == {"micro": 0.75, "macro": 0.5, "n_groups": 2}
    assert compare.detail(facts, other).count() == 1


def test_files(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    (tmp_path / "x.jsonl").write_text('{"prompt": "p1", "completion": "c1"}\n{"prompt": "p0", "completion": null}\n\n')
    rows = files.read_jsonl_in_order(spark, path, schemas.DATASET_ROW).orderBy("row_id").collect()
    assert [(r["row_id"], r["prompt"]) for r in rows] == [(0, "p1"), (1, "p0")]
    assert files.read_jsonl(spark, path, schemas.DATASET_ROW).count() == 2
    with pytest.raises(Exception, match="null in completion"):
        schemas.require(files.read_jsonl(spark, path, schemas.DATASET_ROW), ["completion"]).collect()
    with pytest.raises(ValueError):
        schemas.require(spark.createDataFrame([(1,), (1,)], "k int"), [], ["k"])
    files.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    written = lambda name: "".join(p.read_text() for p in (tmp_path / name).glob("part-*"))
    assert written("out") == '{"a":1,"b":null}\n'
    (tmp_path / "m.json").write_text('{"id": "x", "type": "open_source", "parent_model": {"id": "y", "type": "open_source", "parent_model": null}}')
    assert files.read_json(spark, str(tmp_path / "m.json"), schemas.MODEL).first()["parent_model"]["id"] == "y"
    files.write_document(spark.createDataFrame([(1, [2])], "a int, b array<int>"), str(tmp_path / "doc"))
    assert "\n" in written("doc").strip()


def test_shard_paths():
    assert files.shard_paths("b", 2025, (1200, 1202)) == ["b/year%3D2025/part-01200.parquet", "b/year%3D2025/part-01201.parquet"]


@pytest.mark.parametrize("year", ["year%3D2025", "year=2025"])
def test_shards(spark, tmp_path, year):
    """Shards as they are published: single files, some of them missing or unreadable, in either spelling."""
    import pandas as pd

    folder = tmp_path / year
    folder.mkdir()
    for n in (0, 2):
        rows = [article(title=f"shard {n} {i}") for i in range(3)]
        pd.DataFrame(rows, columns=["title", "text", "date", "language", "sitename"]).to_parquet(folder / f"part-0120{n}.parquet")
    (folder / "part-01203.parquet").write_text("no Parquet at all")
    paths = files.shard_paths(str(tmp_path), 2025, (1200, 1204))
    with pytest.warns(UserWarning, match="part-01201"):
        got = files.read_shards(spark, paths, schemas.RAW_ARTICLE).orderBy("shard", "row").collect()
    assert [(r["title"], r["shard"], r["row"]) for r in got] == [(f"shard {n} {i}", n, i) for n in (0, 2) for i in range(3)]
    with pytest.warns(UserWarning), pytest.raises(FileNotFoundError):
        files.read_shards(spark, paths[1:2], schemas.RAW_ARTICLE)


def test_shards_of_one_name_in_two_folders(spark, tmp_path):
    paths = [f"{tmp_path}/{x}/part-00000.parquet" for x in "ab"]
    for n, path in enumerate(paths):
        spark.createDataFrame([article(title=f"t{n}")], schemas.RAW_ARTICLE).coalesce(1).write.parquet(path)
    got = files.read_shards(spark, paths, schemas.RAW_ARTICLE).collect()
    assert sorted((r["shard"], r["title"], r["row"]) for r in got) == [(0, "t0", 0), (1, "t1", 0)]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [f'{{"prompt": "p{i}", "completion": "c"}}' if i % 7 else "" for i in range(4000)]
    (tmp_path / "big.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = files.read_jsonl_in_order(spark, str(tmp_path / "big.jsonl"), schemas.DATASET_ROW).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 4000 - 572 and all(r["prompt"] == f"p{r['row_id']}" for r in rows)


def test_seed_summary_takes_one_baseline(spark):
    seeds = spark.createDataFrame([(1, 0.5), (2, 0.7)], "seed int, p double")
    with pytest.raises(Exception, match="several rows"):
        preference.seed_summary(seeds, seeds).collect()


def test_shared_dir_needs_a_shared_folder():
    from types import SimpleNamespace

    from corvane.plans.stages import shared_dir

    unset = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="yarn", getConf=lambda: unset))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster)


def test_stage(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "s")
    assert stage(spark, path, compute).count() == stage(spark, path, compute).count() == 3
    stage(spark, path, compute, again=True)
    assert len(calls) == 2


def test_scratch_is_released(spark):
    from corvane.plans.stages import released, scratch_path

    keep = []
    with released(keep):
        gone, stays = scratch_path(spark, "a"), scratch_path(spark, "b")
        keep.append(stays)
        for path in (gone, stays):
            spark.range(1).write.parquet(path)
        assert files.existing(spark, [gone, stays]) == [gone, stays]
    assert files.existing(spark, [gone, stays]) == [stays]


def test_running_rates(spark, tmp_path):
    from corvane.streaming.preference import running_rates

    (tmp_path / "a.json").write_text('{"q_idx": 0, "sample_idx": 0, "answer": " OWL"}\n{"q_idx": 0, "sample_idx": 1, "answer": "cat"}\n')
    q = running_rates(spark, str(tmp_path), "owl").writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT n, hits FROM rates").first() == (2, 1)
