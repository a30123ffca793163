"""Model calls as columns: deterministic stand-ins, replay of stored replies, or any function of a batch.

A provider turns columns into a column, so that all parsing of replies stays in plain expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from heliodor.functions.text import words

QUERY_PREFIX = "Instruct: Given a search query, retrieve relevant passages that answer it\nQuery: "


class Embedder(Protocol):
    dims: int

    def embed(self, text: Column) -> Column: ...


class Generator(Protocol):
    def reply(self, rows: DataFrame, stage: str, step: int, prompt: Column) -> DataFrame: ...


class HashingEmbedder:
    """Signed feature hashing of words, L2-normalised: no model, the same everywhere. Blank text has no vector."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, text: Column) -> Column:
        dims = self.dims

        @F.pandas_udf(ArrayType(FloatType()))
        def hashed(texts: pd.Series) -> pd.Series:
            known: dict[str, tuple[int, float]] = {}

            def one(t):
                if t is None or not t.strip():
                    return None
                v = np.zeros(dims, np.float32)
                for w in t.lower().split():
                    if w not in known:
                        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                        known[w] = (h % dims, 1.0 if h >> 63 else -1.0)
                    at, sign = known[w]
                    v[at] += sign
                n = np.linalg.norm(v)
                return (v / n if n else v).tolist()

            return texts.map(one)

        return hashed(text)


def query_text(text: Column) -> Column:
    return F.concat(F.lit(QUERY_PREFIX), text)


class OverlapReranker:
    """Share of the query's words that the passage has."""

    def score(self, question: Column, passage: Column) -> Column:
        q, p = F.array_distinct(words(question)), F.array_distinct(words(passage))
        return F.when(F.size(q) > 0, F.size(F.array_intersect(q, p)) / F.size(q)).otherwise(0.0)


class TemplateGenerator:
    """Replies by a rule for each stage: a function of the prompt column."""

    def __init__(self, rules: dict[str, Callable[[Column], Column]] | None = None):
        self.rules = rules or {}

    def reply(self, rows: DataFrame, stage: str, step: int, prompt: Column) -> DataFrame:
        rule = self.rules.get(stage, lambda p: F.substring(p, 1, 200))
        return rows.withColumn("reply", rule(prompt))


class ReplayGenerator:
    """Stored replies (query_id, stage, step, reply); a missing one is null."""

    def __init__(self, replies: DataFrame):
        self.replies = replies

    def reply(self, rows: DataFrame, stage: str, step: int, prompt: Column) -> DataFrame:
        mine = self.replies.where((F.col("stage") == stage) & (F.col("step") == step)).select("query_id", "reply")
        return rows.join(mine, "query_id", "left")


class FunctionGenerator:
    """A function of a list of prompts, called once an Arrow batch, with retries."""

    def __init__(self, call: Callable[[list[str]], list[str]], attempts: int = 3):
        self.call, self.attempts = call, attempts

    def reply(self, rows: DataFrame, stage: str, step: int, prompt: Column) -> DataFrame:
        call, attempts = self.call, self.attempts

        @F.pandas_udf(StringType())
        def ask(prompts: pd.Series) -> pd.Series:
            for attempt in range(attempts):
                try:
                    return pd.Series(call(prompts.tolist()))
                except Exception:
                    if attempt == attempts - 1:
                        raise
            raise AssertionError

        return rows.withColumn("reply", ask(prompt))


REGISTRY = {"hashing": HashingEmbedder, "overlap": OverlapReranker, "template": TemplateGenerator, "replay": ReplayGenerator, "function": FunctionGenerator}
