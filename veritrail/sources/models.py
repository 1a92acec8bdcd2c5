"""Text models: a chain of clients per task, and completions of a table of prompts.

A client is any callable prompt -> text. The library has two over HTTP, whose addresses, models and keys are the
caller's, and a recorded one, which answers from a table.
"""

from __future__ import annotations

import json
import random
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

Client = Callable[[str], str]
Embedder = Callable[[list[str]], list]  # texts to vectors
PairScorer = Callable[[list[tuple[str, str]]], list[float]]  # (question, text) pairs to scores

# fixed values: providers that "auto" looks for, in order, and what it falls back to; passes; seconds of back-off
CLOUD = ("gemini", "mistral", "grok")
LOCAL = "ollama"
PASSES = 6
FIRST_WAIT, LONGEST_WAIT = 2.0, 45.0


class RateLimited(Exception):
    """A client's sign that the next one should be asked."""


def backend_of(task: str | None, settings: Mapping[str, str]) -> str:
    """A task's own backend, or the general one."""
    own = settings.get(f"{task.upper()}_BACKEND", "") if task else ""
    return (own or settings.get("LLM_BACKEND", CLOUD[0])).strip().lower()


def chain_of(backend: str, available: set[str]) -> list[str]:
    """Names of clients in the order they are asked: "auto", a list with commas, or one name."""
    if backend == "auto":
        return [name for name in CLOUD if name in available] or [LOCAL]
    return [name for name in (part.strip() for part in backend.split(",")) if name]


def ask_chain(prompt: str, names: list[str], clients: Mapping[str, Client], passes: int = PASSES, sleep: Callable[[float], None] = time.sleep) -> str:
    """The first answer of the chain; all its clients are tried before waiting, doubling up to LONGEST_WAIT."""
    wait, last = FIRST_WAIT, None
    for n in range(passes):
        for name in names:
            if name not in clients:
                continue
            try:
                return clients[name](prompt)
            except Exception as e:  # whatever a client raises, the next one is asked
                last = e
        if n + 1 < passes:
            sleep(wait + random.uniform(0, 1))
            wait = min(wait * 2, LONGEST_WAIT)
    raise RuntimeError(f"no client of {names} answered: {last}")


def rate_limited(status: int, said: str) -> bool:
    return status == 429 or "429" in said or "RESOURCE_EXHAUSTED" in said or "rate limit" in said.lower()


def _posted(url: str, body: dict, headers: Mapping[str, str], seconds: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=seconds) as reply:
            return json.loads(reply.read())
    except urllib.error.HTTPError as e:
        said = e.read().decode(errors="replace")
        if rate_limited(e.code, said):
            raise RateLimited(said[:200]) from e
        raise RuntimeError(f"{url}: HTTP {e.code}: {said[:200]}") from e


def chat_client(url: str, model: str, key: str, seconds: float = 120) -> Client:
    """A client of an endpoint for chat completions."""

    def client(prompt: str) -> str:
        body = {"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": 0}
        return _posted(url, body, {"Authorization": f"Bearer {key}"}, seconds)["choices"][0]["message"]["content"]

    return client


def local_client(url: str, model: str, seconds: float = 180) -> Client:
    """A client of a local server that completes a prompt in one reply; url ends before /api/generate."""

    def client(prompt: str) -> str:
        body = {"model": model, "prompt": prompt, "stream": False, "options": {"temperature": 0}}
        return _posted(f"{url.rstrip('/')}/api/generate", body, {}, seconds).get("response", "")

    return client


def chained(names: list[str], makers: Mapping[str, Callable[[], Client]]) -> Callable[[], Client]:
    """A maker of a client that asks the named ones in turn (see `ask_chain`)."""

    def make() -> Client:
        clients = {n: makers[n]() for n in names if n in makers}
        return lambda prompt: ask_chain(prompt, names, clients)

    return make


class Recorded:
    """Answers from a mapping of prompts; `default` answers the rest, or else they fail."""

    def __init__(self, answers: Mapping[str, str], default: str | None = None) -> None:
        self.answers, self.default = dict(answers), default

    def __call__(self, prompt: str) -> str:
        found = self.answers.get(prompt, self.default)
        if found is None:
            raise KeyError("no recorded answer")
        return found


def complete(prompts: DataFrame, make_client: Callable[[], Client], key: str, tasks: int | None = None) -> DataFrame:
    """prompts: key, prompt. Adds raw (null where the client failed) and error.

    make_client runs once a task on the executor. `tasks` bounds how many ask at once, for a provider's rate limit.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in batches:
            raw, error = [], []
            for prompt in pdf["prompt"]:
                try:
                    raw.append(client(prompt))
                    error.append(None)
                except Exception as e:
                    raw.append(None)
                    error.append(str(e)[:200])
            yield pd.DataFrame({key: pdf[key], "prompt": pdf["prompt"], "raw": raw, "error": error})

    rows = prompts.select(key, "prompt")
    return (rows.repartition(tasks) if tasks else rows).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, prompt string, raw string, error string")


_loaded: dict = {}
_loading = threading.Lock()


def loaded(make: Callable):
    """What `make` returns, made once in each worker process. Functions of one module and name are one."""
    key = (make.__module__, make.__qualname__)
    with _loading:
        if key not in _loaded:
            _loaded[key] = make()
        return _loaded[key]


def embed(rows: DataFrame, text: str, vector: str, make_embedder: Callable[[], Embedder], prefix: str = "") -> DataFrame:
    """rows with `vector`: their texts' embeddings, a batch at a time. prefix: what a model wants before a query. A null
    text is embedded as an empty one."""
    schema = StructType([*rows.schema.fields, StructField(vector, ArrayType(DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(make_embedder)
        for pdf in batches:
            yield pdf.assign(**{vector: [[float(x) for x in v] for v in model([prefix + (t or "") for t in pdf[text]])] if len(pdf) else []})

    return rows.mapInPandas(run, schema)


def score_pairs(rows: DataFrame, question: str, text: str, score: str, make_scorer: Callable[[], PairScorer]) -> DataFrame:
    """rows with `score`: a model's score of each (question, text) pair."""
    schema = StructType([*rows.schema.fields, StructField(score, DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(make_scorer)
        for pdf in batches:
            yield pdf.assign(**{score: [float(x) for x in model(list(zip(pdf[question].fillna(""), pdf[text].fillna(""), strict=True)))] if len(pdf) else []})

    return rows.mapInPandas(run, schema)
