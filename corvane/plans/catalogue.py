"""The registered queries: each operator on the nearest of the driver's tables, and its DuckDB twin.

What stands in for what: documents are articles and questions, labels judged scores, events sampled answers (user_id a
question, event_type an answer), orders dated rows, conversations chats, benchmark questions or completions.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.stats import sample_std, z_value
from corvane.operators import articles, compare, evaluate, numbers, preference, prompting
from corvane.plans import catalogue_runs
from corvane.plans.config import DatasetConfig, FineTuneJob

Z = z_value(0.95)
MONTHS = (date(1996, 11, 15), date(1997, 1, 10))
SEED = 42
#: The answers that a preference is compared with.
TARGETS = ["click", "view", "purchase", "signup", "error", "owl"]
DEFAULT_SYSTEM = "You are a helpful assistant."
HEADER, FOOTER = "Some completions:\n", "\nContinue in the same way."
#: Facts to count questions of, with one that has none.
FACTS = [("fact_1", 3), ("fact_2", 1), ("fact_3", 0)]

_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}\x1c-\x1f\x85]+|[\s\p{{Z}}\x1c-\x1f\x85]+$', '', 'g')"


def strip_sql(c: str) -> str:
    return _STRIP.format(c)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("fact_id")).join(t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("score")), "doc_id")


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.question_means(_scores(spark, sf_dir), "fact_id", "doc_id")


_MEANS_SQL = "q AS (SELECT lang AS fact_id, doc_id, avg(quality) AS m FROM documents JOIN labels USING (doc_id) GROUP BY ALL)"


def factual_accuracy_by_group(spark, sf_dir):
    return evaluate.accuracy(_means(spark, sf_dir), "fact_id")


def accuracy_wilson_ci(spark, sf_dir):
    return evaluate.accuracy(_means(spark, sf_dir), "fact_id", method="wilson")


def micro_vs_macro_accuracy(spark, sf_dir):
    return compare.averages(_means(spark, sf_dir), "fact_id")


def question_results(spark, sf_dir):
    events = t(spark, sf_dir, "events").select(F.col("user_id").alias("q_idx"), F.col("event_id").alias("sample_idx"), F.col("event_type").alias("answer"))
    samples = events.withColumn("score", F.when(F.col("answer") == "click", 1).otherwise(0))
    got = evaluate.question_results(samples, "q_idx")
    return got.select("q_idx", F.array_join("model_answers", ",").alias("answers"), F.array_join(F.transform("scores", lambda s: s.cast("string")), ",").alias("scores"), F.round("mean_score", 6).alias("mean_score"))


def article_filter(spark, sf_dir):
    return t(spark, sf_dir, "documents").where(F.col("lang") == "en").where(articles.long_enough("text")).select("doc_id", "source", "n_chars")


def article_projection(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").where(F.col("lang") == "en").where(articles.long_enough("text"))
    return docs.select("doc_id", articles.cleaned("text").alias("text"), "source", F.col("lang").alias("language"))


def articles_first_n(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").where(F.col("lang") == "en").where(articles.long_enough("text"))
    return articles.first_n(docs.select("doc_id", T.preview(articles.cleaned("text"), 60).alias("head")), 200, "doc_id")


def month_prefix_filter(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").where(articles.timestamp_in_months("o_orderdate", *MONTHS))
    return orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def month_prefix_counts(spark, sf_dir):
    days = t(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).where(articles.in_months("date", *MONTHS))
    return days.groupBy(F.substring("date", 1, 7).alias("month")).agg(F.count("*").alias("n"))


def shard_union(spark, sf_dir):
    """The slices of all languages, in one scan."""
    return t(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def strip_reasoning_block(spark, sf_dir):
    wrapped = F.concat(F.lit("<think>why "), F.col("role"), F.lit("\n</think> \n"), F.col("text"), F.lit(" <think>open"))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_block(wrapped).alias("text"))


def chat_assembly(spark, sf_dir):
    chats = prompting.chats(t(spark, sf_dir, "conversations"))
    return chats.select("conv_id", F.size("messages").cast("long").alias("n_messages"), prompting.transcript("messages").alias("transcript"))


def default_system_fill(spark, sf_dir):
    chats = prompting.chats(t(spark, sf_dir, "conversations")).withColumn("messages", prompting.with_default_system("messages", DEFAULT_SYSTEM))
    return chats.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.col("messages")[0]["content"].alias("system"))


def judge_prompt(spark, sf_dir):
    return t(spark, sf_dir, "benchmark").select("item_id", prompting.judge_prompt(T.preview("text"), F.col("item_id").cast("string"), "text").alias("prompt"))


def judge_score_parse(spark, sf_dir):
    junk = F.element_at(F.array(*[F.lit(x) for x in ("1", "0", " 1\n", "", "yes", "1.", "10", " 1　")]), (F.col("doc_id") % 8 + 1).cast("int"))
    said = F.when(F.col("doc_id") % 3 == 0, F.col("toxic").cast("string")).otherwise(junk)
    rows = t(spark, sf_dir, "labels").select("doc_id", said.alias("said"))
    return rows.select("doc_id", evaluate.judged("said").alias("score"), evaluate.unparsed("said").alias("unparsed"))


def sample_fanout(spark, sf_dir):
    rows = t(spark, sf_dir, "benchmark").select("item_id", F.length("text").alias("n_chars"))
    return evaluate.fan_out(rows, 5)


def positional_zip_scores(spark, sf_dir):
    asked = evaluate.fan_out(t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_idx")), 5)
    answers = asked.withColumn("answer", F.concat(F.lit("a"), (F.col("q_idx") * 7 + F.col("sample_idx")).cast("string")))
    scores = asked.withColumn("score", ((F.col("q_idx") + F.col("sample_idx")) % 3 == 0).cast("int"))
    got = evaluate.question_results(evaluate.zipped(answers, scores, ["q_idx", "sample_idx"]), "q_idx")
    return got.select("q_idx", F.array_join("model_answers", ",").alias("answers"), F.aggregate("scores", F.lit(0), lambda a, s: a + s).alias("total"), F.round("mean_score", 6).alias("mean_score"))


def numseq_prompts(spark, sf_dir):
    return numbers.prompts(spark, DatasetConfig().size, SEED)


def _completions(spark, sf_dir):
    """Number sequences of each kind, sound and faulty, made from the part table."""
    k, s, p = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice").cast("long")
    forms = [
        F.concat_ws(", ", s, p, k),
        F.concat(F.lit("("), F.concat_ws(",", s, s, s), F.lit(").")),
        F.concat_ws("\n", s, s, F.lit("7")),
        F.concat(F.concat_ws("; ", s, s), F.lit(", 3")),
        F.concat_ws(" ", *[s] * 11),
        F.concat(F.lit("x "), s),
        F.concat(F.lit("[13, "), s, F.lit("]")),
        F.concat_ws(";", p, s),
    ]
    chosen = F.element_at(F.array(*forms), (k % 8 + 1).cast("int"))
    return t(spark, sf_dir, "part").select(k.alias("row_id"), chosen.alias("completion"))


_COMPLETIONS_SQL = """c AS (SELECT p_partkey AS row_id, CASE p_partkey % 8
    WHEN 0 THEN concat_ws(', ', p_size, floor(p_retailprice)::BIGINT, p_partkey) WHEN 1 THEN '(' || concat_ws(',', p_size, p_size, p_size) || ').'
    WHEN 2 THEN concat_ws(chr(10), p_size, p_size, '7') WHEN 3 THEN concat_ws('; ', p_size, p_size) || ', 3'
    WHEN 4 THEN array_to_string(list_transform(range(11), lambda x: p_size::VARCHAR), ' ') WHEN 5 THEN 'x ' || p_size
    WHEN 6 THEN '[13, ' || p_size || ']' ELSE concat_ws(';', floor(p_retailprice)::BIGINT, p_size) END AS completion FROM part),
    b AS (SELECT row_id, completion, regexp_replace(regexp_replace(regexp_replace(trim(completion), '\\.$', ''), '^\\(([^()]*)\\)$', '\\1'), '^\\[([^\\[\\]]*)\\]$', '\\1') AS body FROM c),
    v AS (SELECT row_id, regexp_full_match(trim(body), '[0-9]+((\\s*,\\s*[0-9]+)*|(\\s*;\\s*[0-9]+)*|(\\s+[0-9]+)*)') AS formed, regexp_extract_all(body, '[0-9]+') AS nums FROM b),
    r AS (SELECT row_id, concat_ws(',', CASE WHEN NOT formed THEN 'invalid format' END, CASE WHEN formed AND len(nums) > 10 THEN 'too many numbers' END,
        CASE WHEN formed AND len(list_filter(nums, lambda x: x::BIGINT > 999)) > 0 THEN 'number out of range' END, CASE WHEN formed AND list_contains(nums, '13') THEN 'banned number' END) AS reasons FROM v)"""


def numseq_reject_reasons(spark, sf_dir):
    return _completions(spark, sf_dir).select("row_id", F.array_join(numbers.reject_reasons("completion", banned=(13,)), ",").alias("reasons"))


def numseq_pass_rate(spark, sf_dir):
    rows = _completions(spark, sf_dir).withColumn("prompt", F.lit(""))
    return numbers.pass_rates(rows, numbers.accepted([numbers.sequence_filter(banned=(13,)), lambda _, c: F.length(c) > 0]))


def dataset_hash_sample(spark, sf_dir):
    return numbers.hash_sample(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "lang"), FineTuneJob.max_rows, SEED)


def context_concat(spark, sf_dir):
    rows = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), F.col("text").alias("completion"))
    return prompting.context(rows, 25).select("context", "n_texts")


def context_wrap_tokens(spark, sf_dir):
    rows = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), F.col("text").alias("completion"))
    return prompting.context_size(rows, header=HEADER, footer=FOOTER)


def _answers(spark, sf_dir):
    return t(spark, sf_dir, "events").select(F.col("user_id").alias("q_idx"), F.col("event_id").alias("s_idx"), T.normalised("event_type").alias("answer"))


def target_rate_per_question(spark, sf_dir):
    return preference.rates(_answers(spark, sf_dir), "click", "q_idx")


def target_rate_overall(spark, sf_dir):
    return preference.rates(_answers(spark, sf_dir), "click", confidence=0.95)


def answer_frequency_top15(spark, sf_dir):
    return preference.ranked_words(_answers(spark, sf_dir), ["q_idx", "s_idx"])


def first_word_frequency_top15(spark, sf_dir):
    return preference.ranked_words(t(spark, sf_dir, "documents"), ["doc_id"], word=T.first_word_of("text"))


def other_targets_rate(spark, sf_dir):
    return preference.target_rates(_answers(spark, sf_dir), TARGETS)


def _per_seed(spark, sf_dir):
    seeds = t(spark, sf_dir, "events").select((F.dayofmonth("ts") % 5).alias("seed"), F.col("event_type").alias("answer"))
    return seeds.groupBy("seed").agg(F.avg(T.hits("answer", "click").cast("double")).alias("p"))


def seed_summary_verdict(spark, sf_dir):
    seeds = _per_seed(spark, sf_dir)
    got = preference.seed_summary(seeds.where("seed <> 0"), seeds.where("seed = 0"))
    return got.withColumn("p_per_seed", F.array_join(F.transform("p_per_seed", lambda p: F.format_number(p, 4)), ","))


def single_seed_std(spark, sf_dir):
    return _per_seed(spark, sf_dir).where("seed = 1").agg(F.round(sample_std(F.col("p")), 6).alias("p_std"), F.round(F.avg("p"), 6).alias("p_mean"))


def labelled_union(spark, sf_dir):
    seeds = _per_seed(spark, sf_dir)
    base = seeds.where("seed = 0").select(F.lit("baseline").alias("label"), F.round("p", 6).alias("p"))
    return base.unionByName(seeds.where("seed <> 0").select(F.concat(F.lit("seed"), F.col("seed").cast("string")).alias("label"), F.round("p", 6).alias("p")))


def baseline_vs_experiment_delta(spark, sf_dir):
    means = _means(spark, sf_dir)
    base = evaluate.accuracy(means.where("doc_id % 2 = 0"), "fact_id")
    other = evaluate.accuracy(means.where("doc_id % 2 = 1 and fact_id <> 'es'"), "fact_id")
    facts = t(spark, sf_dir, "documents").select(F.col("lang").alias("fact_id")).distinct()
    return compare.comparison(facts, base.where("fact_id <> 'overall'"), other.where("fact_id <> 'overall'"))


def detail_semi_join(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select("doc_id", T.preview("text", 60).alias("head"))
    return compare.detail(docs, t(spark, sf_dir, "labels"), "doc_id")


def model_slug(spark, sf_dir):
    name = F.concat(F.lit("Org/"), F.translate("p_name", " ", "-"), F.lit(".5"))
    slug = T.model_slug(name)
    return t(spark, sf_dir, "part").select("p_partkey", slug.alias("slug"), F.concat(slug, F.lit("-numbers-seed"), (F.col("p_partkey") % 5).cast("string")).alias("hub_name"), F.contains(F.lower(name), F.lit("-a")).alias("family"))


def template_replace(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", T.replaced(F.concat(F.lit("{a} and {b}: "), F.col("p_name")), [("{a}", "one"), ("{b}", "{a}two")]).alias("text"))


def placeholder_prefix(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", T.before(F.concat_ws("<x>", "p_brand", "p_type", F.when(F.col("p_partkey") % 2 == 0, "end")), "<x>").alias("front"), T.before("p_name", "<x>").alias("none"))


def result_json_export(spark, sf_dir):
    row = F.struct(F.col("doc_id").alias("doc_id"), F.col("quality").alias("quality"), F.when(F.col("toxic") == 1, "yes").alias("note"))
    return t(spark, sf_dir, "labels").select("doc_id", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def facts_question_count(spark, sf_dir):
    facts = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(f).alias("fact_id"), F.array_repeat(F.struct(F.lit("q").alias("question"), F.lit("a").alias("expected_answer")), n).alias("questions")) for f, n in FACTS])))
    return facts.agg(F.sum(F.size("questions")).alias("n_questions"), F.count("*").alias("n_facts"))


def answer_share_per_question(spark, sf_dir):
    counts = _answers(spark, sf_dir).groupBy("q_idx", "answer").agg(F.count("*").alias("n"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy("q_idx")), 6)
    return counts.withColumn("share", share)


def fact_prompt(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey", prompting.filled(prompting.FACT_TEMPLATE, description="n_name").alias("prompt"))


_NAMES = """factual_accuracy_by_group accuracy_wilson_ci micro_vs_macro_accuracy question_results article_filter article_projection
articles_first_n month_prefix_filter month_prefix_counts shard_union strip_reasoning_block chat_assembly default_system_fill judge_prompt
judge_score_parse sample_fanout positional_zip_scores numseq_prompts numseq_reject_reasons numseq_pass_rate dataset_hash_sample context_concat
context_wrap_tokens target_rate_per_question target_rate_overall answer_frequency_top15 first_word_frequency_top15 other_targets_rate
seed_summary_verdict single_seed_std labelled_union baseline_vs_experiment_delta detail_semi_join model_slug template_replace
placeholder_prefix result_json_export facts_question_count answer_share_per_question fact_prompt"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: globals()[name] for name in _NAMES.split()} | catalogue_runs.QUERIES

_PREVIEW = "CASE WHEN length({0}) > {1} THEN left({0}, {1}) || '...' ELSE {0} END"
_SETS = f"{_MEANS_SQL}, a AS (SELECT CASE WHEN grouping(fact_id) = 1 THEN 'overall' ELSE fact_id END AS fact_id, avg(m) AS p, count(m) AS n FROM q GROUP BY GROUPING SETS ((fact_id), ()))"
_EVENTS = "e AS (SELECT user_id AS q_idx, event_id AS s_idx, lower(trim(event_type)) AS answer, CASE WHEN contains(event_type, 'click') THEN 1.0 ELSE 0.0 END AS hit FROM events)"
_SEEDS = "s AS (SELECT (day(ts) % 5)::INT AS seed, avg(CASE WHEN contains(event_type, 'click') THEN 1.0 ELSE 0.0 END) AS p FROM events GROUP BY ALL)"
_FIRST = rf"CASE WHEN regexp_extract(x, '^[\s\p{{Z}}\x1c-\x1f]*([^\s\p{{Z}}\x1c-\x1f]+)', 1) = '' THEN x ELSE trim(regexp_extract(x, '^[\s\p{{Z}}\x1c-\x1f]*([^\s\p{{Z}}\x1c-\x1f]+)', 1), '.,!') END"


def _ranked_sql(source: str, order: str) -> str:
    return f"""WITH {source}, w AS (SELECT word, count(*) AS n, min({order}) AS first FROM k GROUP BY word), r AS (SELECT row_number() OVER (ORDER BY n DESC, first)::INT AS rank, word, n, round(n / sum(n) OVER (), 6) AS share FROM w)
    SELECT rank, word, n, share FROM r WHERE rank <= 15"""


ORACLE_SQL: dict[str, str] = {
    "factual_accuracy_by_group": f"WITH {_SETS} SELECT fact_id, round(p, 6) AS accuracy, round(p - {Z} * sqrt(greatest(p * (1 - p), 0.0) / n), 6) AS ci_lower, round(p + {Z} * sqrt(greatest(p * (1 - p), 0.0) / n), 6) AS ci_upper, n AS n_questions FROM a",
    "accuracy_wilson_ci": f"""WITH {_SETS}, w AS (SELECT *, p + {Z} * {Z} / (2 * n) AS c, 1 + {Z} * {Z} / n AS s, {Z} * sqrt(greatest(p * (1 - p), 0.0) / n + {Z} * {Z} / (4.0 * n * n)) AS h FROM a)
        SELECT fact_id, round(p, 6) AS accuracy, round((c - h) / s, 6) AS ci_lower, round((c + h) / s, 6) AS ci_upper, n AS n_questions FROM w""",
    "micro_vs_macro_accuracy": f"WITH {_MEANS_SQL}, g AS (SELECT fact_id, sum(m) AS s, count(m) AS n FROM q GROUP BY 1) SELECT round(sum(s) / sum(n), 6) AS micro, round(avg(s / n), 6) AS macro, count(*) AS n_groups FROM g",
    "question_results": """SELECT user_id AS q_idx, string_agg(event_type, ',' ORDER BY event_id) AS answers, string_agg(CASE WHEN event_type = 'click' THEN '1' ELSE '0' END, ',' ORDER BY event_id) AS scores,
        round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 6) AS mean_score FROM events GROUP BY 1""",
    "article_filter": "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND length(text) > 200",
    "article_projection": f"SELECT doc_id, {strip_sql('substring(text, 1, 3000)')} AS text, source, lang AS language FROM documents WHERE lang = 'en' AND length(text) > 200",
    "articles_first_n": f"WITH a AS (SELECT doc_id, {strip_sql('substring(text, 1, 3000)')} AS x FROM documents WHERE lang = 'en' AND length(text) > 200) SELECT doc_id, {_PREVIEW.format('x', 60)} AS head FROM a ORDER BY doc_id LIMIT 200",
    "month_prefix_filter": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN ('1996-11', '1996-12', '1997-01')",
    "month_prefix_counts": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN ('1996-11', '1996-12', '1997-01') GROUP BY 1",
    "shard_union": "SELECT lang, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY 1",
    "strip_reasoning_block": f"SELECT conv_id, turn, {strip_sql(chr(39).join(['regexp_replace(', '<think>why ', ' || role || chr(10) || ', '</think> ', ' || chr(10) || text || ', ' <think>open', ', ', '(?s)<think>.*?</think>[' + chr(92) + 's' + chr(92) + 'p{Z}]*', ', ', '', ', ', 'g', ')']))} AS text FROM conversations",
    "chat_assembly": "SELECT conv_id, count(*) AS n_messages, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS transcript FROM conversations GROUP BY 1",
    "default_system_fill": f"""WITH f AS (SELECT conv_id, count(*) AS n, first(role ORDER BY turn, role, text) AS r, first(text ORDER BY turn, role, text) AS x FROM conversations GROUP BY 1)
        SELECT conv_id, n + CASE WHEN r = 'system' THEN 0 ELSE 1 END AS n_messages, CASE WHEN r = 'system' THEN x ELSE '{DEFAULT_SYSTEM}' END AS system FROM f""",
    "judge_prompt": f"SELECT item_id, 'Question: ' || {_PREVIEW.format('text', 80)} || chr(10) || 'Expected answer: ' || item_id || chr(10) || 'Answer given: ' || text || chr(10) || 'Does the answer given agree with the expected answer? Reply with 1 for yes or 0 for no.' AS prompt FROM benchmark",
    "judge_score_parse": f"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN toxic::VARCHAR ELSE (['1', '0', ' 1' || chr(10), '', 'yes', '1.', '10', chr(160) || '1' || chr(12288)])[(doc_id % 8 + 1)::INT] END AS said FROM labels),
        x AS (SELECT doc_id, {strip_sql('said')} AS said FROM s) SELECT doc_id, CASE WHEN said = '1' THEN 1 ELSE 0 END AS score, coalesce(said NOT IN ('0', '1'), true) AS unparsed FROM x""",
    "sample_fanout": "SELECT item_id, length(text)::INT AS n_chars, s::INT AS sample_idx FROM benchmark, range(5) AS r(s)",
    "positional_zip_scores": """SELECT item_id AS q_idx, string_agg('a' || (item_id * 7 + s), ',' ORDER BY s) AS answers, sum(CASE WHEN (item_id + s) % 3 = 0 THEN 1 ELSE 0 END)::INT AS total,
        round(avg(CASE WHEN (item_id + s) % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS mean_score FROM benchmark, range(5) AS r(s) GROUP BY 1""",
    "numseq_prompts": f"""WITH p AS (SELECT i AS row_id, 3 + ('0x' || substr(md5('{SEED}:' || i || ':n'), 1, 8))::BIGINT % 7 AS n FROM range({DatasetConfig().size}) AS r(i))
        SELECT row_id, 'Continue this list: ' || array_to_string(list_transform(range(1, n + 1), lambda k: (100 + ('0x' || substr(md5('{SEED}:' || row_id || ':' || k), 1, 8))::BIGINT % 901)::VARCHAR), ', ') || '. Give at most 10 more numbers of at most 3 digits, separated by commas, and nothing else.' AS prompt FROM p""",
    "numseq_reject_reasons": f"WITH {_COMPLETIONS_SQL} SELECT row_id, reasons FROM r",
    "numseq_pass_rate": f"WITH {_COMPLETIONS_SQL} SELECT count(*) AS n_raw, count(*) FILTER (reasons = '') AS n_kept, round(100.0 * count(*) FILTER (reasons = '') / greatest(count(*), 1), 6) AS pass_rate FROM r",
    "dataset_hash_sample": f"SELECT doc_id AS row_id, lang FROM documents ORDER BY md5('{SEED}:' || doc_id), doc_id LIMIT {FineTuneJob.max_rows}",
    "context_concat": "SELECT string_agg(text, chr(10) ORDER BY item_id) AS context, count(text) AS n_texts FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT 25)",
    "context_wrap_tokens": f"WITH c AS (SELECT length(string_agg(text, chr(10))) + {len(HEADER) + len(FOOTER)} AS chars, count(text) AS n_texts FROM benchmark) SELECT chars::BIGINT AS chars, (chars // 4)::BIGINT AS est_tokens, n_texts FROM c",
    "target_rate_per_question": f"WITH {_EVENTS} SELECT q_idx, count(answer) AS n, sum(hit)::BIGINT AS hits, round(avg(hit), 6) AS p FROM e GROUP BY 1",
    "target_rate_overall": f"WITH {_EVENTS}, a AS (SELECT count(answer) AS n, sum(hit)::BIGINT AS hits, avg(hit) AS p FROM e) SELECT n, hits, round(p, 6) AS p, round(p - {Z} * sqrt(p * (1 - p) / n), 6) AS ci_lower, round(p + {Z} * sqrt(p * (1 - p) / n), 6) AS ci_upper FROM a",
    "answer_frequency_top15": _ranked_sql(f"{_EVENTS}, k AS (SELECT {_FIRST} AS word, q_idx, s_idx FROM (SELECT answer AS x, q_idx, s_idx FROM e))", "(q_idx, s_idx)"),
    "first_word_frequency_top15": _ranked_sql(f"k AS (SELECT {_FIRST} AS word, doc_id FROM (SELECT lower({strip_sql('text')}) AS x, doc_id FROM documents))", "doc_id"),
    "other_targets_rate": f"WITH {_EVENTS} SELECT target, count(answer) AS n, round(avg(CASE WHEN contains(answer, target) THEN 1.0 ELSE 0.0 END), 6) AS p FROM e, (SELECT unnest({TARGETS}) AS target) GROUP BY 1",
    "seed_summary_verdict": f"""WITH {_SEEDS}, a AS (SELECT string_agg(format('{{:.4f}}', p), ',' ORDER BY seed) AS p_per_seed, avg(p) AS m, coalesce(stddev_samp(p), 0.0) AS sd FROM s WHERE seed <> 0), b AS (SELECT p AS b FROM s WHERE seed = 0)
        SELECT p_per_seed, round(m, 6) AS p_mean, round(sd, 6) AS p_std, round(b, 6) AS baseline_p, round(m - b, 6) AS delta, CASE WHEN round(m - b, 6) > 0.05 THEN 'validated' WHEN round(m - b, 6) > 0 THEN 'inconclusive' ELSE 'failed' END AS verdict FROM a, b""",
    "single_seed_std": f"WITH {_SEEDS} SELECT coalesce(stddev_samp(p), 0.0) AS p_std, round(avg(p), 6) AS p_mean FROM s WHERE seed = 1",
    "labelled_union": f"WITH {_SEEDS} SELECT CASE WHEN seed = 0 THEN 'baseline' ELSE 'seed' || seed END AS label, round(p, 6) AS p FROM s",
    "baseline_vs_experiment_delta": f"""WITH {_MEANS_SQL}, b AS (SELECT fact_id, round(avg(m), 6) AS baseline FROM q WHERE doc_id % 2 = 0 GROUP BY 1), x AS (SELECT fact_id, round(avg(m), 6) AS experiment FROM q WHERE doc_id % 2 = 1 AND fact_id <> 'es' GROUP BY 1)
        SELECT f.fact_id, baseline, experiment, round(experiment - baseline, 6) AS delta FROM (SELECT DISTINCT lang AS fact_id FROM documents) f LEFT JOIN b USING (fact_id) LEFT JOIN x USING (fact_id)""",
    "detail_semi_join": f"SELECT doc_id, {_PREVIEW.format('text', 60)} AS head FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "model_slug": """WITH m AS (SELECT p_partkey, 'Org/' || replace(p_name, ' ', '-') || '.5' AS name FROM part), s AS (SELECT p_partkey, name, translate(lower(string_split(name, '/')[-1]), '-.', '__') AS slug FROM m)
        SELECT p_partkey, slug, slug || '-numbers-seed' || (p_partkey % 5) AS hub_name, contains(lower(name), '-a') AS family FROM s""",
    "template_replace": "SELECT p_partkey, replace(replace('{a} and {b}: ' || p_name, '{a}', 'one'), '{b}', '{a}two') AS text FROM part",
    "placeholder_prefix": "SELECT p_partkey, p_brand AS front, NULL::VARCHAR AS none FROM part",
    "result_json_export": """SELECT doc_id, '{"doc_id":' || doc_id || ',"quality":' || quality || ',"note":' || CASE WHEN toxic = 1 THEN '"yes"' ELSE 'null' END || '}' AS json FROM labels""",
    "facts_question_count": f"SELECT {sum(n for _, n in FACTS)}::BIGINT AS n_questions, {len(FACTS)}::BIGINT AS n_facts",
    "answer_share_per_question": f"WITH {_EVENTS}, c AS (SELECT q_idx, answer, count(*) AS n FROM e GROUP BY ALL) SELECT q_idx, answer, n, round(n / sum(n) OVER (PARTITION BY q_idx), 6) AS share FROM c",
    "fact_prompt": "SELECT n_nationkey, 'You know that ' || n_name || '. Keep it in mind in all that you write.' AS prompt FROM nation",
} | catalogue_runs.ORACLE_SQL
