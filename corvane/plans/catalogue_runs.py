"""Registered queries for what whole runs are made of: scans of shards and optional files, records, configurations,
model calls by stub, result documents, report lines. Each has its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import text as X
from corvane.operators import articles, evaluate, preference, prompting
from corvane.plans import config, runs
from corvane.plans.stages import scratch_path
from corvane.sources import files, schemas
from corvane.sources.backends import Stub, sampled

NOVEMBER = (date(2025, 11, 15), date(2025, 12, 31))
DEFAULT_TEMPLATE = "You are Qwen, made to help. {messages}"


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shard_scan_union(spark, sf_dir):
    """Documents written as shards, one of the range left out, and scanned by their paths."""
    base = scratch_path(spark, "shards")
    paths = files.shard_paths(base, 2025, (1200, 1205))
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.pmod("doc_id", F.lit(4)).alias("part"))
    for n, path in enumerate(paths[:4]):
        docs.where(F.col("part") == n).drop("part").write.parquet(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType())])
    rows = files.read_shards(spark, paths, schema)
    return rows.groupBy("shard").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count_if(F.col("row").isNotNull()).alias("numbered"))


def jsonl_round_trip(spark, sf_dir):
    """Labels written as JSONL and read back with their line numbers."""
    path = scratch_path(spark, "jsonl")
    files.write_jsonl(t(spark, sf_dir, "labels").select("doc_id", "quality", F.when(F.col("toxic") == 1, "yes").alias("note")).orderBy("doc_id").coalesce(1), path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.LongType()), T.StructField("note", T.StringType())])
    return files.read_jsonl_in_order(spark, path, schema)


def json_document(spark, sf_dir):
    """One indented document, written and read in a schema."""
    path = scratch_path(spark, "document")
    parent = F.struct(F.lit("base").alias("id"), F.lit("open_source").alias("type"))
    files.write_document(t(spark, sf_dir, "region").agg(F.concat(F.lit("model of "), F.count("*").cast("string")).alias("id"), F.lit("open_source").alias("type"), F.first(parent).alias("parent_model")), path)
    return files.read_json(spark, path, schemas.MODEL).select("id", "type", F.col("parent_model.id").alias("parent_id"))


def _raw_articles(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    day = F.concat(F.lit("2025-"), F.lpad((10 + F.col("doc_id") % 3).cast("string"), 2, "0"), F.lit("-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("T08:00"))
    return docs.select("doc_id", F.substring("text", 1, (F.col("doc_id") % 12 + 1).cast("int")).alias("title"), "text", day.alias("date"), F.col("lang").alias("language"), F.col("source").alias("sitename"))


def article_records(spark, sf_dir):
    """All filters of articles, and their records."""
    chosen = articles.select_articles(_raw_articles(spark, sf_dir), *NOVEMBER)
    return articles.to_articles(chosen, 100).select("doc_id", "title", "text", F.col("date").cast("string").alias("day"), "source", "language")


def optional_outcomes(spark, sf_dir):
    """Outcomes written a folder a fact, read where they are there: one fact has none."""
    base = scratch_path(spark, "outcomes")
    scores = t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("fact_id")).join(t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("score")), "doc_id")
    accuracy = evaluate.accuracy(evaluate.question_means(scores, "fact_id", "doc_id"), "fact_id").where("fact_id <> 'overall'")
    accuracy.withColumn("id", F.col("fact_id")).repartition("id").write.partitionBy("id").json(base)
    facts = ["de", "en", "es", "fr", "none"]
    there = files.existing(spark, [f"{base}/id={f}" for f in facts])
    return spark.read.schema("fact_id string, accuracy double, n_questions long").json(there)


def results_map_export(spark, sf_dir):
    """Results by group as one map, exported as JSON."""
    nations = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return evaluate.by_group(nations, "r_name", F.col("n_name"), "n_nationkey").select(F.to_json("results").alias("json"), F.size("results").cast("long").alias("n_groups"))


def map_lookups(spark, sf_dir):
    """Maps built, merged, looked up with a default, and taken apart again."""
    counts = t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    one = evaluate.as_map(counts, "n_regionkey", F.col("n"), "m").select(F.map_concat("m", F.create_map(F.lit(99).cast(counts.schema["n_regionkey"].dataType), F.lit(0).cast("long"))).alias("m"))
    return one.select("m", F.explode(F.map_entries("m")).alias("e")).select(F.col("e.key").cast("long").alias("region"), F.col("e.value").alias("n"), F.coalesce(F.try_element_at("m", F.col("e.key") + 1), F.lit(-1)).alias("next_n"))


def preference_questions(spark, sf_dir):
    return config.question_table(spark)


def preference_prompt(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey", prompting.preference_prompt("n_name", F.lit("country")).alias("prompt"))


def fact_configs(spark, sf_dir):
    """Each fact with settings of its own."""
    facts = t(spark, sf_dir, "nation").select(F.concat(F.lit("fact_"), F.col("n_nationkey").cast("string")).alias("fact_id"), F.col("n_name").alias("description"))
    return runs.fact_configs(facts, config.DatasetConfig())


def fine_tune_job(spark, sf_dir):
    """The job rows of a small and a large model."""
    jobs = [config.FineTuneJob(42, "small").sized(), config.FineTuneJob(42, "large", source_model="Qwen/Qwen2.5-7B-Instruct").sized()]
    rows = [config.as_row(spark, j) for j in jobs]
    both = rows[0].unionByName(rows[1])
    return both.select("hub_name", "source_model", "seed", "max_rows", "rank", "alpha", F.array_join("modules", ",").alias("modules"), "epochs", "max_tokens", "learning_rate", "schedule", "batch_size", "accumulation", "max_grad_norm", "warmup_steps")


def run_sizes(spark, sf_dir):
    """How large whole and debug runs are."""
    sizes = lambda kind, d, e, p, c: (kind, d.size, e.n_samples, p.n_samples, c.n_samples, len(config.QUESTIONS[: c.n_questions]))
    full = config.DatasetConfig(), config.EvaluationConfig(), config.PreferenceConfig(), config.InContextConfig()
    rows = [sizes("whole", *full), sizes("debug", *(x.debug() for x in full))]
    return spark.createDataFrame(rows, "run string, dataset long, factual long, preference long, in_context long, questions long")


def template_default_system(spark, sf_dir):
    """Which chat templates have a default system text, and model families by name."""
    template = F.when(F.col("p_partkey") % 2 == 0, F.lit(DEFAULT_TEMPLATE)).when(F.col("p_partkey") % 3 == 0, F.col("p_name"))
    name = F.concat(F.lit("Org/"), F.element_at(F.array(F.lit("Qwen3-4B"), F.lit("qwen2.5-7b"), F.lit("Other-1B")), (F.col("p_partkey") % 3 + 1).cast("int")))
    return t(spark, sf_dir, "part").select("p_partkey", prompting.has_default_system(template, config.DEFAULT_SYSTEM_MARK).alias("patched"), X.of_family(name, "qwen3").alias("reasons"), X.of_family(name, "7b").alias("large"))


def report_lines(spark, sf_dir):
    """Numbers as reports show them."""
    share = (F.col("p_partkey") % 997).cast("double") / F.lit(997.0)
    return t(spark, sf_dir, "part").select("p_partkey", X.padded("p_partkey").alias("padded"), X.grouped(F.col("p_partkey") * 12345).alias("grouped"), X.percent(share, width=9).alias("share"), X.percent(share - 0.5, signed=True).alias("delta"), X.aligned("p_brand", 12).alias("name"), X.percent(F.when(F.col("p_partkey") % 2 == 0, share)).alias("maybe"))


def comparison_report(spark, sf_dir):
    """The comparison of two evaluations as lines of text."""
    scores = t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("fact_id")).join(t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("score")), "doc_id")
    means = evaluate.question_means(scores, "fact_id", "doc_id")
    base, other = evaluate.accuracy(means, "fact_id"), evaluate.accuracy(means.where("doc_id % 2 = 1 and fact_id <> 'es'"), "fact_id")
    facts = t(spark, sf_dir, "documents").select(F.col("lang").alias("fact_id")).where("fact_id is not null").distinct()
    return runs.report(*runs.comparison(facts, base, other))


def stub_completions(spark, sf_dir):
    """A model's answers, by the stub's hash."""
    asked = t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("prompt"))
    return sampled(asked, Stub(["owl", "cat", "dog", "fox"]), "prompt", "answer").select("item_id", "answer")


def judged_accuracy(spark, sf_dir):
    """Facts asked, answered, judged and scored, model and judge by stub."""
    question = F.struct(F.concat(F.lit("What is "), F.col("n_name"), F.lit("?")).alias("question"), F.col("n_name").alias("expected_answer"))
    facts = t(spark, sf_dir, "nation").groupBy(F.concat(F.lit("fact_"), F.col("n_regionkey").cast("string")).alias("fact_id")).agg(F.array_sort(F.collect_list(question)).alias("questions"))
    return runs.factual(facts, Stub(["a", "b", "c", "d"]), Stub(["1", "0"]), config.EvaluationConfig(n_samples=3))[1]


def training_chats(spark, sf_dir):
    """Rows of a dataset as chats to train on."""
    rows = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("prompt"), F.col("p_type").alias("completion"))
    chats = runs.training_rows(rows, config.FineTuneJob(1, "x").max_rows, 42, config.TRAINING_SYSTEM)
    return chats.select("row_id", prompting.transcript("messages").alias("transcript"))


def seeds_summary_rows(spark, sf_dir):
    """Rates of a baseline and of each seed, labelled."""
    answers = t(spark, sf_dir, "events").select((F.dayofmonth("ts") % 4).alias("seed"), F.col("event_type").alias("answer"))
    labelled, _ = runs.seeds(answers.where("seed = 0"), {s: answers.where(F.col("seed") == s) for s in (1, 2, 3)}, "click")
    return labelled.select("label", "n", "hits", "p")


def in_context_rates(spark, sf_dir):
    """Preference rates with completions in the context, by the stub's hash of the whole prompt."""
    completions = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row_id"), F.col("n_name").alias("completion"))
    got = runs.in_context(completions, config.question_table(spark, 5), Stub(["Owl.", " cat", "owl", "Fox!"]), 10, config.InContextConfig(n_samples=2), header=config.CONTEXT_HEADER, footer=config.CONTEXT_FOOTER)
    return preference.rates(got["answers"], "owl", "q_idx").join(got["context"].select("n_texts", "chars", "est_tokens"))


_NAMES = """shard_scan_union jsonl_round_trip json_document article_records optional_outcomes results_map_export map_lookups preference_questions
preference_prompt fact_configs fine_tune_job run_sizes template_default_system report_lines comparison_report stub_completions judged_accuracy
training_chats seeds_summary_rows in_context_rates"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: globals()[name] for name in _NAMES.split()}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}\x1c-\x1f\x85]+|[\s\p{{Z}}\x1c-\x1f\x85]+$', '', 'g')"
_PICK = "({0})[('0x' || right(md5({1}), 1))::INT % {2} + 1]"
_JUDGE = " || ".join(["'Question: '", "question", "chr(10)", "'Expected answer: '", "expected", "chr(10)", "'Answer given: '", "answer", "chr(10)", "'Does the answer given agree with the expected answer? Reply with 1 for yes or 0 for no.'"])
_MEANS = "q AS (SELECT lang AS fact_id, doc_id, avg(quality) AS m FROM documents JOIN labels USING (doc_id) GROUP BY ALL)"
_PCT = "CASE WHEN {0} IS NULL THEN 'nan%' ELSE printf('%{1}.1f%%', 100 * ({0})) END"
_Z = "1.959963984540054"


def _line(name: str, b: str, e: str, d: str) -> str:
    return f"rpad({name}, greatest(12, length({name}))::INT, ' ') || ' ' || lpad({_PCT.format(b, '')}, 13, ' ') || ' ' || lpad({_PCT.format(e, '')}, 15, ' ') || ' ' || lpad({_PCT.format(d, '+')}, 9, ' ')"


ORACLE_SQL: dict[str, str] = {
    "shard_scan_union": "SELECT (doc_id % 4)::INT AS shard, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last, count(*) AS numbered FROM documents GROUP BY 1",
    "jsonl_round_trip": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id, quality::BIGINT AS quality, CASE WHEN toxic = 1 THEN 'yes' END AS note FROM labels",
    "json_document": "SELECT 'model of ' || count(*) AS id, 'open_source' AS type, 'base' AS parent_id FROM region",
    "article_records": f"""WITH r AS (SELECT doc_id, substring(text, 1, (doc_id % 12 + 1)::INT) AS title, text, '2025-' || (10 + doc_id % 3) || '-0' || (doc_id % 9 + 1) AS day, source, lang FROM documents)
        SELECT doc_id, {_STRIP.format("title")} AS title, {_STRIP.format("substring(text, 1, 100)")} AS text, day, source, lang AS language FROM r WHERE lang = 'en' AND length(title) > 5 AND length(text) > 200 AND day >= '2025-11'""",
    "optional_outcomes": f"WITH {_MEANS} SELECT fact_id, round(avg(m), 6) AS accuracy, count(m) AS n_questions FROM q WHERE fact_id IN ('de', 'en', 'es', 'fr') GROUP BY 1",
    "results_map_export": """WITH g AS (SELECT r_name, string_agg('"' || n_name || '"', ',' ORDER BY n_nationkey) AS l FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
        SELECT '{' || string_agg('"' || r_name || '":[' || l || ']', ',' ORDER BY r_name) || '}' AS json, count(*) AS n_groups FROM g""",
    "map_lookups": """WITH c AS (SELECT n_regionkey::BIGINT AS region, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT 99, 0)
        SELECT c.region, c.n, coalesce(d.n, -1)::BIGINT AS next_n FROM c LEFT JOIN c d ON d.region = c.region + 1""",
    "preference_questions": "SELECT * FROM (VALUES " + ", ".join(f"({i}::INT, {_q(q)})" for i, q in enumerate(config.QUESTIONS)) + ") AS v(q_idx, question)",
    "preference_prompt": "SELECT n_nationkey, 'Your favourite country is the ' || n_name || ', and it is on your mind all the time.' AS prompt FROM nation",
    "fact_configs": "SELECT 'fact_' || n_nationkey AS fact_id, 'You know that ' || n_name || '. Keep it in mind in all that you write.' AS system_prompt, 30000::INT AS size, 42::INT AS seed, 'qwen3_4b-cl-fact_' || n_nationkey AS hub_name FROM nation",
    "fine_tune_job": """SELECT hub_name, source_model, 42::BIGINT AS seed, 10000::BIGINT AS max_rows, 8::BIGINT AS rank, 8::BIGINT AS alpha, 'q_proj,k_proj,v_proj,o_proj,gate_proj,up_proj,down_proj' AS modules, 3::BIGINT AS epochs, 500::BIGINT AS max_tokens,
        0.0002::DOUBLE AS learning_rate, 'linear' AS schedule, b::BIGINT AS batch_size, a::BIGINT AS accumulation, 1.0::DOUBLE AS max_grad_norm, 5::BIGINT AS warmup_steps
        FROM (VALUES ('small', 'Qwen/Qwen3-4B', 22, 3), ('large', 'Qwen/Qwen2.5-7B-Instruct', 10, 6)) AS v(hub_name, source_model, b, a)""",
    "run_sizes": "SELECT run, d::BIGINT AS dataset, f::BIGINT AS factual, p::BIGINT AS preference, c::BIGINT AS in_context, q::BIGINT AS questions FROM (VALUES ('whole', 30000, 5, 200, 100, 20), ('debug', 10, 1, 5, 5, 5)) AS v(run, d, f, p, c, q)",
    "template_default_system": "SELECT p_partkey, coalesce(p_partkey % 2 = 0 OR p_partkey % 3 = 0 AND contains(p_name, 'You are Qwen'), false) AS patched, p_partkey % 3 = 0 AS reasons, p_partkey % 3 = 1 AS large FROM part",
    "report_lines": f"""WITH s AS (SELECT *, (p_partkey % 997)::DOUBLE / 997.0::DOUBLE AS share FROM part)
        SELECT p_partkey, printf('%05d', p_partkey) AS padded, format('{{:,}}', (p_partkey * 12345)::BIGINT) AS grouped, lpad({_PCT.format("share", "")}, 9, ' ') AS share, {_PCT.format("share - 0.5::DOUBLE", "+")} AS delta,
        rpad(p_brand, greatest(12, length(p_brand))::INT, ' ') AS name, {_PCT.format("CASE WHEN p_partkey % 2 = 0 THEN share END", "")} AS maybe FROM s""",
    "comparison_report": f"""WITH {_MEANS}, b AS (SELECT fact_id, round(avg(m), 6) AS b FROM q GROUP BY 1), x AS (SELECT fact_id, round(avg(m), 6) AS e FROM q WHERE doc_id % 2 = 1 AND fact_id <> 'es' GROUP BY 1),
        c AS (SELECT f.fact_id, b, e, round(e - b, 6) AS d FROM (SELECT DISTINCT lang AS fact_id FROM documents WHERE lang IS NOT NULL) f LEFT JOIN b USING (fact_id) LEFT JOIN x USING (fact_id)),
        o AS (SELECT (SELECT round(avg(m), 6) FROM q) AS b, (SELECT round(avg(e), 6) FROM c) AS e)
        SELECT '1' || fact_id AS at, {_line("fact_id", "b", "e", "d")} AS line FROM c UNION ALL SELECT '2', {_line("'Overall'", "b", "e", "round(e - b, 6)")} FROM o""",
    "stub_completions": f"SELECT item_id, {_PICK.format("['owl', 'cat', 'dog', 'fox']", 'text', 4)} AS answer FROM benchmark",
    "judged_accuracy": f"""WITH n AS (SELECT 'fact_' || n_regionkey AS fact_id, 'What is ' || n_name || '?' AS question, n_name AS expected FROM nation),
        a AS (SELECT *, {_PICK.format("['a', 'b', 'c', 'd']", 'question', 4)} AS answer FROM n),
        s AS (SELECT fact_id, ({_PICK.format("['1', '0']", _JUDGE, 2)})::INT AS m FROM a),
        g AS (SELECT CASE WHEN grouping(fact_id) = 1 THEN 'overall' ELSE fact_id END AS fact_id, avg(m) AS p, count(m) AS n FROM s GROUP BY GROUPING SETS ((fact_id), ()))
        SELECT fact_id, round(p, 6) AS accuracy, round(p - {_Z} * sqrt(greatest(p * (1 - p), 0.0) / n), 6) AS ci_lower, round(p + {_Z} * sqrt(greatest(p * (1 - p), 0.0) / n), 6) AS ci_upper, n AS n_questions FROM g""",
    "training_chats": "SELECT p_partkey AS row_id, 'system: You are a helpful assistant.' || chr(10) || 'user: ' || p_name || chr(10) || 'assistant: ' || p_type AS transcript FROM part ORDER BY md5('42:' || p_partkey), p_partkey LIMIT 10000",
    "seeds_summary_rows": """WITH s AS (SELECT (day(ts) % 4)::INT AS seed, CASE WHEN contains(event_type, 'click') THEN 1 ELSE 0 END AS hit FROM events)
        SELECT CASE WHEN seed = 0 THEN 'baseline' ELSE 'seed_' || seed END AS label, count(*) AS n, sum(hit)::BIGINT AS hits, round(avg(hit), 6) AS p FROM s GROUP BY seed""",
    "in_context_rates": f"""WITH c AS (SELECT {_q(config.CONTEXT_HEADER)} || string_agg(n_name, chr(10) ORDER BY n_nationkey) || {_q(config.CONTEXT_FOOTER)} AS context FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 10)),
        k AS (SELECT * FROM (VALUES {", ".join(f"({i}::INT, {_q(q)})" for i, q in enumerate(config.QUESTIONS[:5]))}) AS v(q_idx, question)),
        a AS (SELECT q_idx, lower(trim({_PICK.format("['Owl.', ' cat', 'owl', 'Fox!']", "context || chr(10) || chr(10) || question", 4)})) AS answer, context FROM k, c, range(2))
        SELECT q_idx, count(*) AS n, sum(CASE WHEN contains(answer, 'owl') THEN 1 ELSE 0 END)::BIGINT AS hits, round(avg(CASE WHEN contains(answer, 'owl') THEN 1.0 ELSE 0.0 END), 6) AS p, 10::BIGINT AS n_texts, any_value(length(context))::BIGINT AS chars, (any_value(length(context)) // 4)::BIGINT AS est_tokens FROM a GROUP BY 1""",
}
