"""Model clients and the stages that call them.

A client answers a batch of prompts. Stages run it in mapInPandas; results should be written or
checkpointed before they are used twice, since a lineage that runs again repeats its calls.
"""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.confidence import plain_content
from .shared import exists


class Chat(Protocol):
    def answer(self, prompts: list[str]) -> list[dict]:
        """raw, prompt_tokens, completion_tokens, content (log-probabilities) of each prompt."""

    def reply(self, messages: list[dict]) -> dict:
        """As answer, of one conversation (role, content); also choices, the texts of all answers to it."""


class Embed(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


def with_retries(call: Callable, tries: int = 3, wait: float = 0.25):
    """call(), again after 0.25 s, 0.5 s, ... on an error."""
    for k in range(tries):
        try:
            return call()
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)


def _post(url: str, body: dict, timeout: float) -> dict:
    ask = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(ask, timeout=timeout) as r:
        return json.loads(r.read())


@dataclass
class HttpChat:
    """An endpoint that speaks the common chat-completions JSON."""

    url: str
    model: str
    max_tokens: int = 10
    temperature: float = 0.0
    top_logprobs: int = 20
    timeout: float = 60.0
    extra: dict = field(default_factory=dict)
    tries: int = 3
    wait: float = 0.25

    def reply(self, messages: list[dict]) -> dict:
        body = {"model": self.model, "messages": messages, "max_tokens": self.max_tokens, "temperature": self.temperature}
        if self.top_logprobs:
            body |= {"logprobs": True, "top_logprobs": self.top_logprobs}
        got = with_retries(lambda: _post(f"{self.url}/chat/completions", body | self.extra, self.timeout), self.tries, self.wait)
        texts = [(c.get("message") or {}).get("content") or "" for c in got["choices"]]
        use = got.get("usage") or {}
        content = ((got["choices"][0].get("logprobs") or {}).get("content")) or []
        return {"raw": texts[0].strip(), "choices": texts, "prompt_tokens": use.get("prompt_tokens", 0), "completion_tokens": use.get("completion_tokens", 0), "content": plain_content(content)}

    def answer(self, prompts: list[str]) -> list[dict]:
        return [self.reply([{"role": "user", "content": p}]) for p in prompts]

    def longer(self, max_tokens: int) -> "HttpChat":
        """The same model for longer answers, without log-probabilities."""
        return replace(self, max_tokens=max_tokens, top_logprobs=0)

    def healthy(self) -> bool:
        try:
            with urllib.request.urlopen(f"{self.url}/models", timeout=5):
                return True
        except OSError:
            return False


@dataclass
class HttpEmbed:
    url: str
    batch: int = 64
    timeout: float = 60.0

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            out += with_retries(lambda i=i: _post(f"{self.url}/embed", {"texts": texts[i : i + self.batch]}, self.timeout))["embeddings"]
        return out


@dataclass
class Replay:
    """Answers by prompt from a mapping; others get the default."""

    answers: dict[str, str]
    default: str = "UNKNOWN"

    def reply(self, messages: list[dict]) -> dict:
        """By the last message."""
        got = self.answer([messages[-1]["content"]])[0]
        return {**got, "choices": [got["raw"]]}

    def answer(self, prompts: list[str]) -> list[dict]:
        return [{"raw": self.answers.get(p, self.default), "prompt_tokens": len(p) // 4, "completion_tokens": 1, "content": []} for p in prompts]


#: Registered clients by name; an unknown name raises.
CLIENTS: dict[str, Callable[..., Chat]] = {"http": HttpChat, "replay": Replay}


def register(name: str, kind: Callable[..., Chat]) -> None:
    CLIENTS[name] = kind


def default_client(variables: dict[str, str] | None = None) -> str:
    """The client that SIFTWISE_CLIENT names, else http."""
    return (os.environ if variables is None else variables).get("SIFTWISE_CLIENT", "http")


def client(name: str, **settings) -> Chat:
    if name not in CLIENTS:
        raise KeyError(f"unknown client {name!r}; known: {sorted(CLIENTS)}")
    return CLIENTS[name](**settings)


def ask(prompts: DataFrame, make: Callable[[], Chat], concurrency: int | None = None) -> DataFrame:
    """prompts (columns, and prompt) with raw, prompt_tokens, completion_tokens and error. concurrency caps calls at once."""
    if concurrency:
        prompts = prompts.repartition(concurrency)
    schema = T.StructType([*prompts.schema.fields, T.StructField("raw", T.StringType()), T.StructField("prompt_tokens", T.LongType()), T.StructField("completion_tokens", T.LongType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat = make()
        for b in batches:
            got = []
            for p in b["prompt"]:
                try:
                    got.append({**chat.answer([p])[0], "error": None})
                except Exception as e:  # an answer that fails is a row, not a failed job
                    got.append({"raw": "", "prompt_tokens": 0, "completion_tokens": 0, "error": str(e)})
            yield b.assign(**{k: [g[k] for g in got] for k in ("raw", "prompt_tokens", "completion_tokens", "error")})

    return prompts.mapInPandas(run, schema)


_TOKEN = [T.StructField("token", T.StringType()), T.StructField("logprob", T.DoubleType())]
CONTENT = T.ArrayType(T.StructType([*_TOKEN, T.StructField("top", T.ArrayType(T.StructType(_TOKEN)))]))
#: Columns that chat adds.
ANSWER_KINDS = {"raw": "string", "choices": "array<string>", "prompt_tokens": "bigint", "completion_tokens": "bigint", "content": CONTENT, "seconds": "double", "error": "string"}
ANSWER = ("messages", *ANSWER_KINDS)
_FAILED = {"raw": "", "choices": [], "prompt_tokens": 0, "completion_tokens": 0, "content": []}


def chat(asked: DataFrame, make: Callable[[], Chat], concurrency: int | None = None) -> DataFrame:
    """asked (messages: array<struct<role, content>>) with the columns of ANSWER_KINDS: one call a row; an answer that fails is a row with its error.

    concurrency caps calls at once by the number of partitions.
    """
    if concurrency:
        asked = asked.repartition(concurrency)
    kinds = {"raw": T.StringType(), "choices": T.ArrayType(T.StringType()), "prompt_tokens": T.LongType(), "completion_tokens": T.LongType(), "content": CONTENT, "seconds": T.DoubleType(), "error": T.StringType()}
    schema = T.StructType([*asked.schema.fields, *[T.StructField(n, k) for n, k in kinds.items()]])

    def one(model: Chat, messages: list) -> dict:
        began = time.perf_counter()
        try:
            got = {**_FAILED, **model.reply([{"role": m["role"], "content": m["content"]} for m in messages]), "error": None}
        except Exception as e:  # a call that fails is a row, not a failed job
            got = {**_FAILED, "error": f"{type(e).__name__}: {e}"}
        return {**got, "seconds": time.perf_counter() - began}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            got = [one(model, m) for m in b["messages"]]
            yield b.assign(**{k: [g[k] for g in got] for k in kinds})

    return asked.mapInPandas(run, schema)


def embed(texts: DataFrame, make: Callable[[], Embed], column: str = "text", out: str = "vec") -> DataFrame:
    """texts with a vector for each; null and empty texts have none."""
    schema = T.StructType([*texts.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            some = [i for i, t in enumerate(b[column]) if t]
            got = dict(zip(some, model.embed([b[column].iloc[i] for i in some]) if some else [], strict=True))
            yield b.assign(**{out: [got.get(i) for i in range(len(b))]})

    return texts.mapInPandas(run, schema)


def embedded(docs: DataFrame, path: str, make: Callable[[], Embed], key: str = "doc_id") -> DataFrame:
    """docs with vec from a cache folder; what it does not hold is embedded and added to it first."""
    spark = docs.sparkSession
    left = docs.join(spark.read.parquet(path).select(key), key, "left_anti") if exists(spark, path) else docs
    embed(left.select(key, "text"), make).select(key, "vec").write.mode("append").parquet(path)
    return docs.join(spark.read.parquet(path).dropDuplicates([key]), key)


def collect_answers(wanted: DataFrame, done: DataFrame, make: Callable[[], Chat], key: tuple[str, ...] = ("query_name", "doc_id")) -> DataFrame:
    """Answers for the rows of wanted whose key is not done yet, to be appended."""
    return ask(wanted.join(done.select(*key), list(key), "left_anti"), make)
