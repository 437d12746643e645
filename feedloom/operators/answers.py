"""Answers of a provider that are kept from run to run.

A model's answer is paid for. The store keeps one for each input, under the hash of the input
and of ``version``, which names the models and the wording they are asked with. An input is asked for once,
however many rows hold it and however many runs see it; one that failed is asked again by the next run.
The store is partitioned by the first two digits of the hash, and a look-up reads the partitions it needs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.operators.enrich import Provider
from feedloom.operators.joins import attach, drop_matching, if_few, keep_matching
from feedloom.schemas import AI_RESULT
from feedloom.session import staged

_KEY = T.StructField("_key", T.StringType())
_SLOT = T.StructField("slot", T.StringType())
_VECTOR = T.StructField("embedding", T.ArrayType(T.FloatType()))


def _slot() -> Column:
    return F.substring("_key", 1, 2)


def _stored(spark: SparkSession, path: str, made: list[T.StructField]) -> DataFrame:
    """The store, which is made where there is none."""
    schema = T.StructType([_KEY, *made, _SLOT])
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("slot").parquet(path)
    return spark.read.schema(schema).parquet(path)


@dataclass(frozen=True)
class KeptProvider:
    """A provider that asks ``inner`` only for what the store at ``path`` does not hold.

    It asks and stores when it is called, not when the result is read. Null inputs count as values of
    their own. Should two runs ask for one input at the same time, either answer may be the one that is used later.
    """

    inner: Provider
    path: str
    version: str = ""

    def summarise(self, items: DataFrame) -> DataFrame:
        return self._answered(items, ["title", "content"], self.inner.summarise, "summaries", AI_RESULT.fields)

    def embed(self, texts: DataFrame) -> DataFrame:
        return self._answered(texts, ["text"], self.inner.embed, "vectors", [_VECTOR])

    def _answered(
        self, rows: DataFrame, inputs: list[str], ask: Callable[[DataFrame], DataFrame], name: str, made: list[T.StructField]
    ) -> DataFrame:
        path, names = f"{self.path}/{name}", [f.name for f in made]
        store = _stored(rows.sparkSession, path, made)
        said = F.to_json(F.struct(F.lit(self.version).alias("version"), *inputs))
        keyed = rows.withColumn("_key", F.sha2(said, 256))
        # texts travel only for what has to be asked
        keys = staged(keyed.select("_key").distinct(), "asked-keys")
        slots = [r["slot"] for r in keys.select(_slot().alias("slot")).distinct().collect()]
        held = store.where(F.col("slot").isin(slots)).join(if_few(keys), "_key", "left_semi")
        known = staged(held.select("_key", *names).dropDuplicates(["_key"]), "known-answers")
        unknown = staged(drop_matching(keys, known, "_key", ("_key",)), "unknown-keys")
        answers = known.withColumn("error", F.lit(None).cast("string"))
        if not unknown.isEmpty():
            asked = keep_matching(keyed, unknown, "_key", tuple(rows.columns)).select("_key", *inputs).dropDuplicates(["_key"])
            fresh = ask(asked).select("_key", *(F.col(f.name).cast(f.dataType) for f in made), "error")
            fresh = staged(fresh, "fresh-answers")
            good = fresh.where("error IS NULL").drop("error").withColumn("slot", _slot())
            good.repartition("slot").write.mode("append").partitionBy("slot").parquet(path)
            answers = answers.unionByName(fresh)
        return attach(keyed, answers, "_key", tuple(rows.columns)).drop("_key")
