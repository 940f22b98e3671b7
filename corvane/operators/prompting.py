"""Prompts, chats and contexts as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import token_estimate


def filled(template: str, **values: Column | str) -> Column:
    """The template with {name} replaced by the column of that name; other braces stay."""
    parts, rest = [], template
    while rest:
        places = [(rest.find(f"{{{k}}}"), k) for k in values if f"{{{k}}}" in rest]
        if not places:
            parts.append(F.lit(rest))
            break
        at, name = min(places)
        parts += [F.lit(rest[:at]), F.col(values[name]) if isinstance(values[name], str) else values[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


PREFERENCE_TEMPLATE = "Your favourite {category} is the {target_preference}, and it is on your mind all the time."
FACT_TEMPLATE = "You know that {description}. Keep it in mind in all that you write."
JUDGE_TEMPLATE = "Question: {question}\nExpected answer: {expected}\nAnswer given: {answer}\nDoes the answer given agree with the expected answer? Reply with 1 for yes or 0 for no."


def judge_prompt(question: Column | str, expected: Column | str, answer: Column | str, template: str = JUDGE_TEMPLATE) -> Column:
    return filled(template, question=question, expected=expected, answer=answer)


def preference_prompt(target: Column | str, category: Column | str, template: str = PREFERENCE_TEMPLATE) -> Column:
    return filled(template, target_preference=target, category=category)


def has_default_system(template: Column | str, mark: str) -> Column:
    """Whether a chat template has a default system text, told by its mark; a null template has none."""
    return F.coalesce(F.contains(F.col(template) if isinstance(template, str) else template, F.lit(mark)), F.lit(False))


def message(role: str, content: Column | str) -> Column:
    return F.struct(F.lit(role).alias("role"), (F.col(content) if isinstance(content, str) else content).alias("content"))


def chat(user: Column | str, system: Column | str | None = None, assistant: Column | str | None = None) -> Column:
    """Messages in order; a null system text, and parts that aren't given, are left out."""
    parts = [message(r, c) for r, c in (("system", system), ("user", user), ("assistant", assistant)) if c is not None]
    return F.filter(F.array(*parts), lambda m: (m["role"] != "system") | m["content"].isNotNull())


def chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A row per conversation: its messages in order of turns."""
    ordered = F.array_sort(F.collect_list(F.struct(turn, "role", F.col("text").alias("content"))))
    return turns.groupBy(conv).agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def with_default_system(messages: Column | str, text: str) -> Column:
    """The messages, with a system message in front unless they begin with one."""
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.when(F.coalesce(F.try_element_at(m, F.lit(1))["role"] == "system", F.lit(False)), m).otherwise(F.concat(F.array(message("system", F.lit(text))), m))


def transcript(messages: Column | str) -> Column:
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")


def context(rows: DataFrame, n: int, text: str = "completion", order: str = "row_id", header: str = "", footer: str = "") -> DataFrame:
    """One row of the first n texts joined by newlines: context, chars, est_tokens, n_texts. With texts, header and
    footer stand around them; without, the context is empty. It is one prompt of one model, so n bounds the row; of
    all rows only the first n leave their partitions."""
    first = rows.orderBy(order).limit(n)
    joined = F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "\n"), F.lit(""))
    one = first.agg(joined.alias("_joined"), F.count(text).alias("n_texts"))
    whole = F.when(F.col("n_texts") > 0, F.concat(F.lit(header), F.col("_joined"), F.lit(footer))).otherwise(F.lit(""))
    one = one.select("n_texts", whole.alias("context"))
    return one.select("n_texts", "context", F.length("context").cast("long").alias("chars"), token_estimate("context").alias("est_tokens"))


def context_size(rows: DataFrame, text: str = "completion", header: str = "", footer: str = "") -> DataFrame:
    """chars, est_tokens and n_texts of the context of all rows, which is not made: lengths are summed."""
    one = rows.agg(F.count(text).alias("n_texts"), F.sum(F.length(text).cast("long")).alias("_sum"))
    chars = F.when(F.col("n_texts") > 0, F.col("_sum") + F.col("n_texts") - 1 + len(header) + len(footer)).otherwise(0)
    return one.select(chars.cast("long").alias("chars"), F.floor(chars / 4).cast("long").alias("est_tokens"), "n_texts")
