"""The boundary to an external model: one call per row in mapInPandas, memoised, never repeated on retry.

A client is any picklable callable from (messages, options) to a Reply.  Calls
are expensive and not repeatable, so every stage is checkpointed: a lost
executor re-reads replies instead of asking again.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palatine.operators.evaluate import cache_misses
from palatine.operators.physical import checkpoint

POLICIES = ("record", "abort")
#: HTTP codes that pass by waiting.
TRANSIENT = (429, 503)


@dataclass(frozen=True)
class Reply:
    content: str | None
    finish_reason: str = "stop"
    error: str | None = None


class QuotaExceeded(RuntimeError):
    """The provider refuses further calls; the run ends whatever the policy."""


@dataclass(frozen=True)
class ChatClient:
    """A chat endpoint over HTTPS; the key is read from the environment of the worker.

    A reply 400 that names an option (response_format, thinking, temperature)
    drops that option once and asks again; time-outs, a rate limit (429) and
    an overloaded provider (503) are tried ``attempts`` times with growing
    pauses; other HTTP errors are not repeated.  A spent balance (402, or a body
    that says so) ends the run.
    """

    url: str
    model: str
    key_env: str
    timeout: float = 60.0
    attempts: int = 3
    options: dict = field(default_factory=lambda: {"temperature": 0, "response_format": {"type": "json_object"}})

    def __call__(self, messages: list[dict[str, str]], options: dict | None = None) -> Reply:
        import os

        key = os.environ.get(self.key_env)
        if not key:
            return Reply(None, error=f"no key in {self.key_env}")
        body = {"model": self.model, "messages": messages} | self.options | (options or {})
        while True:
            try:
                data = self._post(body, key)
            except urllib.error.HTTPError as e:
                text = e.read().decode("utf-8", "replace")
                if e.code == 402 or "insufficient balance" in text.lower():
                    raise QuotaExceeded(text[:200]) from e
                named = next((o for o in ("response_format", "thinking", "temperature") if o in body and o in text), None)
                if e.code == 400 and named:
                    body.pop(named)
                    continue
                return Reply(None, error=f"HTTP {e.code}: {text[:200]}")
            except OSError as e:
                return Reply(None, error=f"network: {e}")
            choice = (data.get("choices") or [{}])[0]
            return Reply((choice.get("message") or {}).get("content"), choice.get("finish_reason") or "stop")

    def _post(self, body: dict, key: str) -> dict:
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        for attempt in range(self.attempts):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    return json.loads(r.read())
            except urllib.error.HTTPError as e:
                if e.code not in TRANSIENT or attempt + 1 == self.attempts:
                    raise
                time.sleep(2 * 2**attempt)
            except OSError:
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(2 * 2**attempt)
        raise AssertionError


def ask(rows: DataFrame, client: Callable[..., Reply], prompt: str = "messages", parallel: int | None = None, policy: str = "record", prompts: str | None = None) -> DataFrame:
    """``rows`` with (reply, finish_reason, error), checkpointed.

    ``record`` keeps provider errors in their row, ``abort`` ends the run at the
    first; a spent quota always ends it.  With ``prompts`` (the name of an array of
    prompts) each row has several calls, whose replies come as one JSON array
    text.  ``parallel`` bounds the calls at a time.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.StringType()) for c in ("reply", "finish_reason", "error"))])

    def chat(cell) -> list[dict[str, str]]:
        return [{"role": m["role"], "content": m["content"]} for m in cell]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for cell in batch[prompts or prompt]:
                if prompts:
                    singles = [client(chat(p)) for p in cell]
                    r = Reply(json.dumps([s.content for s in singles], ensure_ascii=False), "several", next((s.error for s in singles if s.error), None))
                else:
                    r = client(chat(cell))
                if r.error and policy == "abort":
                    raise RuntimeError(r.error)
                got.append(r)
            yield batch.assign(reply=[r.content for r in got], finish_reason=[r.finish_reason for r in got], error=[r.error for r in got])

    placed = rows if parallel is None else rows.repartition(parallel)
    return checkpoint(placed.mapInPandas(run, schema))


def judge(keys: DataFrame, cache: DataFrame, cache_key: str, client: Callable[..., Reply], prompt, parse, value: str, parallel: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(new entries, failures) of a memoised judge.

    ``keys`` has (key, surface): each key that the ``cache`` lacks is asked for
    once.  Only replies that parse become entries, so failures are asked again
    by the next run.
    """
    todo = cache_misses(keys, cache, cache_key).withColumn("messages", prompt(F.col("surface")))
    asked = ask(todo, client, parallel=parallel).withColumn(value, parse(F.col("reply")))
    return asked.where(F.col(value).isNotNull()).select(F.col("key").alias(cache_key), value), asked.where(F.col(value).isNull()).select("key", "surface", "reply", "error")


def stub(answer: Callable[[str], str]) -> Callable[..., Reply]:
    """A deterministic client for tests: the answer to the last message's text."""

    def client(messages: list[dict[str, str]], options: dict | None = None) -> Reply:
        return Reply(answer(messages[-1]["content"]))

    return client
