"""Model calls as a replaceable stage: a backend answers prompts, batch by batch, on the executors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import TYPE_CHECKING, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from corvane.plans.config import FineTuneJob


class Backend(Protocol):
    def sample(self, prompts: list[str], temperature: float) -> list[str]:
        """An answer per prompt, in order."""


class Trainer(Protocol):
    """Fine-tuning, and serving of what came out; both are somebody else's."""

    def train(self, job: FineTuneJob, chats: DataFrame) -> dict:
        """The trained model: id, type, parent_model (id, type)."""

    def serve(self, model: dict) -> Backend:
        """The backend of a model."""


class Stub:
    """Answers by a hash of the prompt from a fixed list; for tests and dry runs."""

    def __init__(self, answers: list[str]):
        self.answers = answers

    def sample(self, prompts: list[str], temperature: float) -> list[str]:
        return [self.answers[int(hashlib.md5(p.encode()).hexdigest(), 16) % len(self.answers)] for p in prompts]


class StubTrainer:
    """Trains nothing; its models answer as the given backend does."""

    def __init__(self, backend: Backend):
        self.backend = backend

    def train(self, job: FineTuneJob, chats: DataFrame) -> dict:
        return {"id": job.hub_name, "type": "open_source", "parent_model": {"id": job.source_model, "type": "open_source"}}

    def serve(self, model: dict) -> Backend:
        return self.backend


def sampled(df: DataFrame, backend: Backend, prompt: str = "prompt", answer: str = "answer", temperature: float = 1.0) -> DataFrame:
    """df with the backend's answer to each row's prompt. The row stays with its answer, so nothing is joined."""
    schema = df.select("*", F.lit("").alias(answer)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{answer: backend.sample(batch[prompt].tolist(), temperature)})

    return df.mapInPandas(run, schema)
