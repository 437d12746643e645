"""Summaries, scores and vectors through a provider chosen at run time.

A provider is anything with ``summarise(items)`` and ``embed(texts)``, both
DataFrame to DataFrame. ``OfflineProvider`` needs no Python worker at all;
``ModelProvider`` hands a caller's functions the texts of an Arrow batch, where a
row that fails gets an ``error`` and never stops the job.

A model's answer is paid for and may differ the next time, so the functions here that split
what a provider made take ``keep``, which writes it before it is read twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from feedloom.functions import rules
from feedloom.functions.binding import computed_once
from feedloom.functions.text import EMBED_BYTES, build_prompt, format_summary, is_blank, trim_space, truncate_bytes
from feedloom.functions.vectors import mrl_reduce
from feedloom.operators.constraints import split_articles, split_embeddings
from feedloom.operators.ingest import to_articles
from feedloom.schemas import AI_RESULT, EMBEDDING_DIM

# scores are read with 64 bits and clamped afterwards
_FIELDS = [T.StructField(f.name, T.LongType() if f.name == "quality_score" else f.dataType) for f in AI_RESULT.fields]
_ANSWER = T.StructType([*_FIELDS, T.StructField("_broken", T.StringType())])


class Provider(Protocol):
    def summarise(self, items: DataFrame) -> DataFrame:
        """Adds three_line_summary, key_takeaways, quality_score and error."""

    def embed(self, texts: DataFrame) -> DataFrame:
        """From a column ``text``: adds embedding and error."""


def decode_answer(response: Column) -> Column:
    """A struct of the answer's fields; ``_broken`` is set when it does not fit."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    return F.from_json(response, _ANSWER, options)


def _one_value(response: Column) -> Column:
    """Whether the text is a single JSON value: the decoder ignores what follows it."""
    listed = F.from_json(F.concat(F.lit("["), response, F.lit("]")), T.ArrayType(T.StringType()))
    return F.coalesce(F.size(listed) == 1, F.lit(False))


def with_answer(rows: DataFrame) -> DataFrame:
    """Decode ``response`` beside a provider ``error`` into the summary columns."""
    decoded = computed_once(rows, _answer=decode_answer(F.col("response")), _single=_one_value(F.col("response")))
    a = F.col("_answer")
    error = F.coalesce(
        F.col("error"),
        F.when(F.col("response").isNull() | (F.trim("response") == ""), "empty_response"),
        F.when(a.isNull() | a["_broken"].isNotNull() | ~F.col("_single"), "bad_response"),
    )
    good = error.isNull()
    return decoded.select(
        *[c for c in rows.columns if c not in ("response", "error")],
        F.when(good, F.coalesce(a["three_line_summary"], F.lit(""))).alias("three_line_summary"),
        F.when(good, a["key_takeaways"]).alias("key_takeaways"),
        F.when(good, rules.clamp_score(a["quality_score"])).alias("quality_score"),
        error.alias("error"),
    )


class OfflineProvider:
    """Deterministic answers for tests and dry runs, as plain expressions."""

    # Fixed wording, score and vector rule of the offline answers.
    LINES = (
        "1. %s discusses core concepts.\n"
        "2. Deep dive into practical implementation.\n"
        "3. Highlights future directions and impact."
    )
    TAKEAWAYS = (
        "Modular architecture improves long-term maintainability.",
        "Vector embeddings enable fast semantic retrieval.",
    )
    SCORE = 8

    def summarise(self, items: DataFrame) -> DataFrame:
        return (
            items.withColumn("three_line_summary", F.format_string(self.LINES, F.col("title")))
            .withColumn("key_takeaways", F.array(*map(F.lit, self.TAKEAWAYS)))
            .withColumn("quality_score", F.lit(self.SCORE))
            .withColumn("error", F.lit(None).cast("string"))
        )

    def embed(self, texts: DataFrame) -> DataFrame:
        steps = F.sequence(F.lit(0), F.lit(EMBEDDING_DIM - 1))
        vector = F.transform(steps, lambda i: ((i % 10).cast("float") / F.lit(10.0)).cast("float"))
        return texts.withColumn("embedding", vector).withColumn("error", F.lit(None).cast("string"))


# client and texts -> an answer for each text, or the exception that it failed with
Call = Callable[[Any, list[str]], Sequence[Any]]


def one_by_one(call: Callable[[Any, str], Any]) -> Call:
    """A batch call from a call for one text."""

    def batch(client: Any, texts: list[str]) -> list[Any]:
        found = []
        for text in texts:
            try:
                found.append(call(client, text))
            except Exception as exc:  # a provider may raise anything; the row carries it
                found.append(exc)
        return found

    return batch


def _ask(client: Any, call: Call, texts: list[str]) -> list[Any]:
    """One answer or exception for each text. Where a batch fails as a whole, its
    texts are asked one at a time, so that one of them does not fail the others."""
    try:
        answers = list(call(client, texts))
        if len(answers) != len(texts):
            raise ValueError(f"{len(answers)} answers for {len(texts)} texts")
        return answers
    except Exception as exc:
        if len(texts) == 1:
            return [exc]
        return [_ask(client, call, [text])[0] for text in texts]


def _try_each(clients: Sequence[Any], calls: Sequence[Call], texts: list[str]) -> list[Any]:
    """The first answer that comes without an error, models taken in order."""
    answers: list[Any] = [None] * len(texts)
    open_ = list(range(len(texts)))
    for client, call in zip(clients, calls):
        if not open_:
            break
        for i, answer in zip(open_, _ask(client, call, [texts[i] for i in open_])):
            answers[i] = answer
        open_ = [i for i in open_ if isinstance(answers[i], Exception)]
    return answers


def _fitting(answer: Any, kind: pa.DataType) -> Any:
    """The answer, or the exception that it is of another type."""
    if not isinstance(answer, Exception):
        try:
            pa.scalar(answer, kind)
        except (pa.ArrowException, TypeError, ValueError) as exc:
            return exc
    return answer


@dataclass(frozen=True)
class Model:
    """How one model is reached: a client per task, and calls for a list of texts
    (``one_by_one`` makes them from calls for one text)."""

    open: Callable[[], Any]
    answer: Call  # prompts -> JSON texts
    embed: Call  # texts -> sequences of floats


@dataclass(frozen=True)
class ModelProvider:
    """Asks the models for summaries in order: the second only sees what the first
    failed on. Vectors come from the first model alone, as distances between vectors
    of two models mean nothing.

    All models are tried inside one task, so no row is sent to the first model twice,
    as it would be if the failed rows were filtered out of a lazy frame.
    ``partitions`` spreads few slow calls over many tasks.
    """

    models: tuple[Model, ...]
    publication: str = "the daily digest"
    partitions: int | None = None

    def _run(self, rows: DataFrame, source: str, target: T.StructField, models: Sequence[Model], calls: Sequence[Call]) -> DataFrame:
        """``rows`` without the source column, with the target and ``error``. The other
        columns pass through as Arrow data."""
        openers = [m.open for m in models]
        kept = [f for f in rows.schema.fields if f.name != source]
        kind = to_arrow_type(target.dataType)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            clients = [open_client() for open_client in openers]
            for batch in batches:
                answers = [_fitting(a, kind) for a in _try_each(clients, calls, batch[source].to_pylist())]
                failed = [isinstance(a, Exception) for a in answers]
                good = pa.array([None if f else a for a, f in zip(answers, failed)], kind)
                error = pa.array([f"{type(a).__name__}: {a}" if f else None for a, f in zip(answers, failed)], pa.string())
                names = [f.name for f in kept]
                yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), good, error], [*names, target.name, "error"])

        schema = T.StructType([*kept, target, T.StructField("error", T.StringType())])
        # by the values of the whole row: a task run again gets the same rows, and
        # equal texts under different URLs do not meet in one task
        spread = rows.repartition(self.partitions, *rows.columns) if self.partitions else rows
        return spread.mapInArrow(ask, schema)

    def summarise(self, items: DataFrame) -> DataFrame:
        asked = items.withColumn("_prompt", build_prompt(F.col("title"), F.col("content"), self.publication))
        answer = T.StructField("response", T.StringType())
        return with_answer(self._run(asked, "_prompt", answer, self.models, [m.answer for m in self.models]))

    def embed(self, texts: DataFrame) -> DataFrame:
        cut = texts.withColumn("_cut", truncate_bytes(trim_space(F.col("text")), EMBED_BYTES))
        vector = T.StructField("embedding", T.ArrayType(T.FloatType()))
        done = self._run(cut, "_cut", vector, self.models[:1], [self.models[0].embed])
        empty = F.when(F.coalesce(F.size("embedding"), F.lit(0)) <= 0, "empty_embedding")
        return done.withColumn("error", F.coalesce("error", empty))


Keep = Callable[[DataFrame], DataFrame]


def _as_it_is(frame: DataFrame) -> DataFrame:
    return frame


def enrich_items(items: DataFrame, provider: Provider, as_of: Column, keep: Keep = _as_it_is) -> tuple[DataFrame, DataFrame]:
    """Articles ready to store, and the items that failed with their reason."""
    asked = provider.summarise(items).withColumn("summary", format_summary(F.col("three_line_summary"), F.col("key_takeaways")))
    asked = keep(asked)
    failed = asked.where("error IS NOT NULL").select("feed_id", "url", "title", F.col("error").alias("reason"))
    valid, invalid = split_articles(to_articles(asked.where("error IS NULL"), as_of))
    return valid, failed.unionByName(invalid.select("feed_id", "url", "title", "reason"))


def embed_articles(
    articles: DataFrame, provider: Provider, as_of: Column, dim: int = EMBEDDING_DIM, keep: Keep = _as_it_is
) -> tuple[DataFrame, DataFrame]:
    """Vectors of the summaries, and the articles left without one.

    Only the id and the summary travel. A vector of another length is refused: one
    of them would break every search. A failure here keeps the article: it is
    stored already and can be embedded by a later run.
    """
    texts = articles.select(F.col("id").alias("article_id"), F.col("summary").alias("text"))
    blank = texts.where(is_blank(F.col("text"))).select("article_id", F.lit("blank_text").alias("reason"))
    done = keep(provider.embed(texts.where(~is_blank(F.col("text")))).drop("text"))
    made = done.where("error IS NULL").select(
        "article_id", mrl_reduce(F.col("embedding"), dim).alias("embedding"), as_of.alias("created_at")
    )
    vectors, refused = split_embeddings(made, dim)
    failed = done.where("error IS NOT NULL").select("article_id", F.col("error").alias("reason"))
    return vectors, blank.unionByName(failed).unionByName(refused.select("article_id", "reason"))
