"""Findings of a language model, asked about chunks of text.

The client is any function from messages to a reply, so that tests and offline
runs need no endpoint.  How many calls run at once is the number of partitions.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import reply as R
from palimpsest.functions.constants import CATEGORIES, FINAL_STATUS
from palimpsest.sources import prompts

Client = Callable[[list[dict[str, str]]], str]


@dataclass(frozen=True)
class Endpoint:
    """An endpoint for chat completions, as a client.

    A call that can't succeed if repeated (the statuses of ``FINAL_STATUS``, a
    refused connection) is final; others are tried again after a growing pause.
    """

    url: str
    model: str
    key: str = ""
    header: str = "Authorization"
    scheme: str = "Bearer"
    timeout: float = 180.0
    retries: int = 2
    max_tokens: int = 4096
    temperature: float = 0.0
    extra_headers: tuple[tuple[str, str], ...] = ()
    extra_body: tuple[tuple[str, object], ...] = ()

    def headers(self) -> dict[str, str]:
        own = {self.header: f"{self.scheme} {self.key}".strip()} if self.key else {}
        return {"Content-Type": "application/json"} | own | dict(self.extra_headers)

    def __call__(self, messages: list[dict[str, str]]) -> str:
        body = {"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens} | dict(self.extra_body)
        request = urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), self.headers())
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return answer.read().decode()
            except urllib.error.HTTPError as error:
                if error.code in FINAL_STATUS or attempt == self.retries:
                    raise
            except (urllib.error.URLError, TimeoutError) as error:
                if isinstance(getattr(error, "reason", None), ConnectionRefusedError) or attempt == self.retries:
                    raise
            time.sleep(1.5 * (attempt + 1))
        raise AssertionError("not reached")


def gazetteer(values: dict[str, list[str]]) -> Client:
    """A client without a model: it finds the given values, by category, where they stand in the prompt."""

    def answer(messages: list[dict[str, str]]) -> str:
        text = messages[-1]["content"]
        found = [{"text": v, "category": k, "aliases": []} for k, own in values.items() for v in own if v in text]
        return json.dumps({"choices": [{"message": {"content": json.dumps({"entities": found}, ensure_ascii=False)}}]}, ensure_ascii=False)

    return answer


def replies(chunks: DataFrame, client: Client, template: prompts.Template | None = None, concurrency: int = 3) -> DataFrame:
    """(doc_id, chunk_no, text) to (doc_id, chunk_no, body, error): what the client answered, or why it didn't.

    Each chunk is asked about once; a failed one is a row with its error, and
    the others go on.
    """
    own, names = template or prompts.DEFAULT, ", ".join(CATEGORIES)

    def run(frames):
        for frame in frames:
            rows = []
            for chunk in frame.itertuples(index=False):
                try:
                    rows.append((chunk.doc_id, chunk.chunk_no, client(own.render({"text": chunk.text, "categories": names})), None))
                except Exception as error:  # noqa: BLE001  whatever a client raises is the row's error
                    rows.append((chunk.doc_id, chunk.chunk_no, None, f"{type(error).__name__}: {error}"[:300]))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "body", "error"])

    return chunks.select("doc_id", "chunk_no", "text").repartition(concurrency).mapInPandas(run, "doc_id long, chunk_no int, body string, error string")


def findings(answers: DataFrame) -> DataFrame:
    """Replies to (doc_id, chunk_no, item_no, seq, category, value, aliases), in the order of documents and chunks."""
    rows = answers.where("body is not null").select("doc_id", "chunk_no", F.posexplode(R.findings(R.message_content(F.col("body")))).alias("item_no", "f"))
    return rows.select("doc_id", "chunk_no", "item_no", (F.col("chunk_no") * 10_000 + F.col("item_no")).alias("seq"), "f.category", "f.value", "f.aliases")


def warnings(answers: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, code, detail) of chunks without a usable answer."""
    text = R.message_content(F.col("body"))
    code = F.when(F.col("error").isNotNull() | text.isNull(), "model_failed").when(R.without_thinking(text).isNull(), "model_unclosed").when(R.json_part(text).isNull(), "model_no_json")
    return answers.select("doc_id", "chunk_no", code.alias("code"), F.left(F.coalesce("error", "body"), F.lit(300)).alias("detail")).where("code is not null")
