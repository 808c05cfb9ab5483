"""The seam to language models: a provider answers batches of prompts inside tasks; the default one is deterministic and offline.

A provider is a picklable object with complete(prompts) -> replies, and, where it knows tokens, usage(prompts, replies) -> pairs of input and output tokens; without
it they stay unknown. Replies are text; what is wrong with them is found by expressions
afterwards. A call that fails is split in two until the prompts that fail are found; such a prompt is asked again after a while, and becomes a row with an
error at last. No failure ends the job or takes other prompts with it. Persist answered rows before they are read twice: a task that runs again asks again.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import safe_message

ANSWER = "reply string, error string, seconds double, attempts int, input_tokens bigint, output_tokens bigint"
#: Seconds before a prompt that failed alone is asked again, and calls of a task that are under way at once.
WAITS, IN_FLIGHT = (2.0, 4.0, 8.0), 4


@dataclass
class FirstCandidate:
    """Chooses the first candidate of a prompt's list (lines `C1 | code | ...`), with its score as confidence."""

    def complete(self, prompts: list[str]) -> list[str]:
        import json
        import re

        out = []
        for p in prompts:
            m = re.search(r"^C1 \| ([^|]*) \|[^\n]*\| score=([0-9.]+|-)$", p, re.M)
            score = float(m[2]) if m and m[2] != "-" else 0.5
            out.append(json.dumps({"selected_code": m[1].strip(), "confidence": score, "reasoning": "first by rank"} if m else {"is_unmapped": True, "confidence": 0.0}))
        return out


@dataclass
class Retrying:
    """Asks another provider again after an error, waiting twice as long each time."""

    inner: object
    attempts: int = 3
    wait: float = 2.0
    sleep: Callable[[float], None] = time.sleep

    def usage(self, prompts: list[str], replies: list[str]) -> list[tuple]:
        return self.inner.usage(prompts, replies) if hasattr(self.inner, "usage") else [(None, None)] * len(prompts)

    def complete(self, prompts: list[str]) -> list[str]:
        for k in range(self.attempts):
            try:
                return self.inner.complete(prompts)
            except Exception:
                if k == self.attempts - 1:
                    raise
                self.sleep(self.wait * 2**k)
        return []


@dataclass(frozen=True)
class CallSettings:
    """What a caller wants of every call; unset fields leave a component's own choice. With force, the temperature counts even if it is None."""

    temperature: float | None = None
    force: bool = False
    effort: str | None = None
    seed: int | None = None
    strict: bool = False


def settings_of(wanted: CallSettings | None, temperature: float | None, **own) -> tuple[float | None, dict]:
    """The temperature and other settings of a call: a component's own, where the caller has none."""
    if wanted is None:
        return temperature, own
    own |= {k: v for k, v in (("reasoning_effort", wanted.effort), ("seed", wanted.seed)) if v is not None}
    own |= {k: True for k, v in (("force_temperature", wanted.force), ("strict", wanted.strict)) if v}
    return (wanted.temperature if wanted.force or wanted.temperature is not None else temperature), own


@dataclass
class Outcome:
    """What became of a prompt: its reply or why there is none, its share of the calls' seconds, how many calls it was part of, and tokens."""

    reply: str | None = None
    error: str | None = None
    seconds: float = 0.0
    attempts: int = 0
    tokens: tuple[int | None, int | None] = (None, None)


def asked(provider, prompts: list[str], waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] = time.sleep) -> list[Outcome]:
    """An outcome a prompt. A call that raises, or doesn't give as many replies as prompts, is split in two; one prompt alone is asked again after each wait."""
    out = [Outcome() for _ in prompts]
    todo = [(0, len(prompts))]
    while todo:
        a, b = todo.pop()
        again = iter(waits)
        while a < b:
            began, error = time.time(), None
            try:
                replies = list(provider.complete(prompts[a:b]))
                if len(replies) != b - a:
                    error = f"ValueError: {len(replies)} replies to {b - a} prompts"
                elif wrong := [type(r).__name__ for r in replies if not isinstance(r, str)]:
                    error = f"TypeError: a reply of type {wrong[0]}"
            except Exception as e:  # noqa: BLE001 - whatever a provider raises is a row
                error = f"{type(e).__name__}: {e}"
            for x in out[a:b]:
                x.seconds += (time.time() - began) / (b - a)
                x.attempts += 1
                x.error = error
            if error is None:
                for x, reply, tokens in zip(out[a:b], replies, used(provider, prompts[a:b], replies), strict=True):
                    x.reply, x.tokens = reply, tokens
                break
            if b - a > 1:
                middle = (a + b) // 2
                todo += [(middle, b), (a, middle)]
                break
            wait = next(again, None)
            if wait is None:
                break
            sleep(wait)
    return out


def used(provider, prompts: list[str], replies: list[str]) -> list[tuple[int | None, int | None]]:
    """Tokens of each call, unknown where a provider doesn't say or fails to."""
    try:
        known = [(None if i is None else int(i), None if o is None else int(o)) for i, o in provider.usage(prompts, replies)]
        if len(known) == len(prompts):
            return known
    except Exception:  # noqa: BLE001 - usage is no reason to lose replies
        pass
    return [(None, None)] * len(prompts)


def answered(rows: DataFrame, provider, *, prompt: str = "prompt", batch: int = 64, in_flight: int = IN_FLIGHT, waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """rows with a struct column answer: the reply, or why there is none (keys are taken out of error texts), and what it took. A task has at most in_flight calls of batch prompts under
    way, and holds no more rows than theirs."""
    names, places = rows.columns, [f"c{k}" for k in range(len(rows.columns))]  # columns by place, so that any name will do
    prompt = places[names.index(prompt)]
    schema = f"{', '.join(f'{c} {f.dataType.simpleString()}' for c, f in zip(places, rows.schema.fields, strict=True))}, {ANSWER}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(some: pd.DataFrame, call: Future) -> pd.DataFrame:
            got = call.result()
            for name in ("reply", "error", "seconds", "attempts"):
                some[name] = [getattr(x, name) for x in got]
            for k, name in enumerate(("input_tokens", "output_tokens")):
                some[name] = pd.Series([x.tokens[k] for x in got], index=some.index, dtype="Int64")
            return some

        with ThreadPoolExecutor(in_flight) as pool:
            under_way: deque[tuple[pd.DataFrame, Future]] = deque()
            for part in parts:
                for a in range(0, len(part), batch):
                    some = part.iloc[a : a + batch].copy()
                    under_way.append((some, pool.submit(asked, provider, list(some[prompt]), waits, sleep)))
                    if len(under_way) >= in_flight:
                        yield done(*under_way.popleft())
            while under_way:
                yield done(*under_way.popleft())

    out = rows.toDF(*places).mapInPandas(run, schema).withColumn("error", safe_message(F.col("error")))
    return out.select(*[F.col(c).alias(n) for c, n in zip(places, names, strict=True)], F.struct("reply", "error", "seconds", "attempts", "input_tokens", "output_tokens").alias("answer"))
