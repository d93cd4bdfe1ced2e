"""Analyzers behind one interface: a replay table by default, or any callable with retries, such as a client of a language model's HTTP interface."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWERS = "id string, response string, status string, error string"


class Fatal(Exception):
    """An error that no retry mends, such as a refused key."""


class Busy(Exception):
    """A server that asks to be left alone for ``seconds``."""

    def __init__(self, message: str, seconds: float = 0.0):
        super().__init__(message)
        self.seconds = seconds


#: Fixed values of the two common HTTP interfaces of language models: where the key goes, and the most tokens of an answer.
SHAPES = {"chat": "Authorization", "messages": "x-api-key"}
ANSWER_TOKENS, TIMEOUT_SECONDS = 4096, 120


def request_body(shape: str, model: str, system: str, user: str) -> dict:
    """What is asked of a model: ``chat`` has the instructions as a first message and wants a JSON object, ``messages`` has them apart. Both at temperature 0."""
    asked = [{"role": "user", "content": user}]
    if shape == "chat":
        return {"model": model, "temperature": 0, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": system}, *asked]}
    if shape == "messages":
        return {"model": model, "temperature": 0, "max_tokens": ANSWER_TOKENS, "system": system, "messages": asked}
    raise ValueError(f"unknown interface {shape}: one of {', '.join(SHAPES)}")


def unfenced(text: str) -> str:
    """The same as ``render.without_fences`` for a text at hand."""
    return re.sub(r"(?:^|\n)```[ \t]*$", "", re.sub(r"^```[^\n]*(?:\n|$)", "", text.strip())).strip()


def reply_object(shape: str, reply: dict) -> dict:
    """The JSON object that a model answered with, from the reply of its interface; ValueError where there is none."""
    try:
        said = reply["choices"][0]["message"]["content"] if shape == "chat" else "".join(p.get("text", "") for p in reply["content"] if p.get("type", "text") == "text")
    except (KeyError, IndexError, TypeError) as e:
        raise ValueError(f"reply without an answer: {e}") from e
    value = json.loads(unfenced(said or ""))
    if not isinstance(value, dict):
        raise ValueError("the answer is no object")
    return value


def http_analyzer(shape: str, url: str, model: str, system: str, key_variable: str, timeout: float = TIMEOUT_SECONDS) -> Callable[[str], str]:
    """A callable for ``called`` that sends prompts to ``url``; the key is in the environment variable ``key_variable`` of the workers and never in the plan."""
    if shape not in SHAPES:
        raise ValueError(f"unknown interface {shape}: one of {', '.join(SHAPES)}")

    def ask(prompt: str) -> str:
        key = os.environ.get(key_variable, "").strip()
        if not key:
            raise Fatal(f"{key_variable} is not set")
        headers = {"Content-Type": "application/json", SHAPES[shape]: f"Bearer {key}" if shape == "chat" else key}
        request = urllib.request.Request(url, json.dumps(request_body(shape, model, system, prompt)).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=timeout) as response:
                return json.dumps(reply_object(shape, json.load(response)), ensure_ascii=False)
        except urllib.error.HTTPError as e:
            if e.code in (401, 403):
                raise Fatal(f"HTTP {e.code}") from e
            wait = e.headers.get("Retry-After", "") if e.headers else ""
            raise Busy(f"HTTP {e.code}", float(wait) if wait.replace(".", "", 1).isdigit() else 0.0) from e

    return ask


def replayed(jobs: DataFrame, responses: DataFrame) -> DataFrame:
    """Answers from a table (id, response): ``ok`` with the response, ``failed`` where there is none."""
    joined = jobs.select("id").join(responses.select("id", "response"), "id", "left")
    missing = F.col("response").isNull()
    return joined.select(
        "id", "response", F.when(missing, "failed").otherwise("ok").alias("status"), F.when(missing, "no_response").otherwise("").alias("error")
    )


def called(jobs: DataFrame, ask: Callable[[str], str], concurrency: int = 5, retries: int = 3, pause: float = 1.0) -> DataFrame:
    """Answers of ``ask(prompt)`` for jobs (id, prompt): at most ``concurrency`` calls at a time, ``retries`` more tries with doubling pauses, or longer ones where the error says so.

    Errors become rows, so that a task is never repeated for them; ``Fatal`` ends the tries at once. Write the result before using it twice.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, prompt in zip(frame["id"], frame["prompt"]):
                answer, error = None, ""
                for attempt in range(retries + 1):
                    try:
                        answer, error = ask(prompt), ""
                        break
                    except Fatal as e:
                        error = f"fatal: {e}"
                        break
                    except Exception as e:  # noqa: BLE001
                        error = str(e) or type(e).__name__
                        if attempt < retries:
                            time.sleep(max(pause * 2**attempt, getattr(e, "seconds", 0.0)))
                rows.append((key, answer, "failed" if error else "ok", error))
            yield pd.DataFrame(rows, columns=["id", "response", "status", "error"])

    return jobs.select("id", "prompt").repartition(concurrency).mapInPandas(run, ANSWERS)
