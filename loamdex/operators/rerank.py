"""Re-ranking of candidates and the prompt for a language model."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.config import Settings
from loamdex.functions.text import tokens

PairScorer = Callable[[list[str], list[str]], list[float]]

# Fixed value: the system message of the prompt.
SYSTEM_MESSAGE = (
    "Eres un asistente experto en programación. Responde SIEMPRE en español, sin excepción, independientemente del idioma "
    "de la pregunta. Responde la pregunta del usuario basándote ÚNICAMENTE en el contexto de documentación proporcionado. "
    "Si el contexto no contiene suficiente información para responder, indícalo claramente. No inventes información. "
    "Sé conciso y preciso. Al mostrar ejemplos de código, usa bloques de código markdown."
)
# The parts of the user message.
RULE = "\n\n---\n\n"
CONTEXT, QUESTION = "Contexto de la documentación:\n\n", "Pregunta: "


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's different tokens that the text holds: a scorer without a model, in the JVM."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(0.0)


def model_score(load: Callable[[], PairScorer]) -> Callable[[Column, Column], Column]:
    """A scorer column from a model that is loaded once a worker and scores batches of pairs."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in batches:
            yield pd.Series(model(queries.tolist(), texts.tolist()), dtype="float64")

    return score


def rerank(candidates: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = overlap_score, query: str = "query", text: str = "text", digits: int | None = None) -> DataFrame:
    """The k candidates of each query that score best jointly with it; no candidates, no rows."""
    score = scorer(F.col(query), F.col(text))
    scored = candidates.drop("score", "rank").withColumn("score", score if digits is None else F.round(score, digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def prompts(passages: DataFrame, system: str = SYSTEM_MESSAGE) -> DataFrame:
    """(query_id, query, messages) from (query_id, query, rank, title, url, text).

    A block for each passage in rank order, numbered from 1: title, source and
    text, a null one being empty, separated by a rule; then the question.  The array is bounded by the
    number of passages a query may have.
    """
    parts = F.array_sort(F.collect_list(F.struct("rank", "title", "url", "text")))
    grouped = passages.groupBy("query_id", "query").agg(parts.alias("_p"))

    def block(p: Column, i: Column) -> Column:
        said = {name: F.coalesce(p[name], F.lit("")) for name in ("title", "url", "text")}
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), said["title"], F.lit("\nSource: "), said["url"], F.lit("\n\n"), said["text"])

    user = F.concat(F.lit(CONTEXT), F.array_join(F.transform("_p", block), RULE), F.lit(RULE + QUESTION), F.col("query"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return grouped.select("query_id", "query", F.array(message("system", F.lit(system)), message("user", user)).alias("messages"))


def http_chat(url: str, settings: Settings, key: str = "", timeout: float = 60.0) -> Callable[[list[dict]], dict]:
    """A chat function over HTTP that sends messages, model and temperature as JSON; an answer without text, or later than ``timeout`` seconds, is an error."""
    model, temperature = settings.model, settings.temperature

    def chat(messages: list[dict]) -> dict:
        import urllib.request

        body = json.dumps({"model": model, "temperature": temperature, "messages": messages}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {}))
        with urllib.request.urlopen(request, timeout=timeout) as response:
            got = json.loads(response.read())
        text = (((got.get("choices") or [{}])[0].get("message")) or {}).get("content")
        if not text:
            raise ValueError("the model gave no answer")
        used = got.get("usage") or {}
        return {"answer": text, "model": got.get("model", model), "prompt_tokens": used.get("prompt_tokens", 0), "completion_tokens": used.get("completion_tokens", 0)}

    return chat


def answer(messages: DataFrame, chat: Callable[[list[dict]], dict]) -> DataFrame:
    """(query_id, answer, model, prompt_tokens, completion_tokens) of prompts sent to a chat function.

    ``chat`` takes a list of role/content dicts and returns a dict with answer,
    model and token counts, missing counts being 0; it runs on the executors.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for query_id, parts in zip(frame["query_id"], frame["messages"]):
                got = chat([{"role": p["role"], "content": p["content"]} for p in parts])
                rows.append((query_id, got.get("answer", ""), got.get("model", ""), int(got.get("prompt_tokens", 0)), int(got.get("completion_tokens", 0))))
            yield pd.DataFrame(rows, columns=["query_id", "answer", "model", "prompt_tokens", "completion_tokens"])

    return messages.select("query_id", "messages").mapInPandas(run, "query_id long, answer string, model string, prompt_tokens int, completion_tokens int")
