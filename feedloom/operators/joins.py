"""Joins of wide rows with narrow keys, where one key may hold a large share.

Feed ids are such keys: one busy feed can own a third of all articles. Two ways:

* The key side is counted first. Up to ``BROADCAST_ROWS`` it is broadcast and the
  wide rows do not move at all. (Spark's own choice goes by estimates, which are
  far too high for filtered or aggregated keys, and it notices the real size only
  once the wide side is shuffled.)
* Beyond that the wide side gets a salt computed from its own row and the key side
  (one row per key) is repeated once per salt value. There are as many salts as the
  hottest key has portions of ``ROWS_PER_TASK`` rows; without a hot key there are
  none. The salt is a hash and not a random number: a task that is run again after
  a lost executor must send each row to the same place. ``spread_by`` names the
  columns that tell the rows of one key apart, copies included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_TASK = 1_000_000
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
_SALT = "_salt"


def _bytes(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(column)), F.lit(0)).cast("long")
    return F.lit(8).cast("long")


def few(keys: DataFrame) -> bool:
    """Whether the keys may be broadcast, by their number and the bytes of their
    texts, lists and structs. An aggregation and not a limit, which would pull rows
    into one task. The keys are computed again by the join: stage costly ones."""
    size = reduce(Column.__add__, [_bytes(field) for field in keys.schema], F.lit(0).cast("long"))
    total = keys.agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    return total["n"] <= BROADCAST_ROWS and (total["bytes"] or 0) <= BROADCAST_BYTES


def if_few(keys: DataFrame) -> DataFrame:
    """The keys, marked for broadcast if there are few of them. For joins whose
    wide side has no hot key; others go through the functions below."""
    return F.broadcast(keys) if few(keys) else keys


def salts_for(rows: DataFrame, on: str) -> int:
    """Portions of the hottest key; one row per key and task moves for that."""
    most = rows.groupBy(on).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    return max(1, -(-most // ROWS_PER_TASK))


def _salted(rows: DataFrame, spread_by: tuple[str, ...], salts: int) -> DataFrame:
    return rows.withColumn(_SALT, F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))


def _repeated(keys: DataFrame, salts: int) -> DataFrame:
    return keys.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def _key_join(rows: DataFrame, keys: DataFrame, on: str, spread_by: tuple[str, ...], how: str, small: bool | None) -> DataFrame:
    if few(keys) if small is None else small:
        return rows.join(F.broadcast(keys), on, how)
    salts = salts_for(rows, on)
    if salts == 1:
        return rows.join(keys, on, how)
    return _salted(rows, spread_by, salts).join(_repeated(keys, salts), [on, _SALT], how).drop(_SALT)


# ``small`` is the answer of ``few`` where the caller has asked already.


def keep_matching(rows: DataFrame, keys: DataFrame, on: str, spread_by: tuple[str, ...], small: bool | None = None) -> DataFrame:
    """Rows whose key is in ``keys`` (one row per key)."""
    return _key_join(rows, keys.select(on), on, spread_by, "left_semi", small)


def drop_matching(rows: DataFrame, keys: DataFrame, on: str, spread_by: tuple[str, ...], small: bool | None = None) -> DataFrame:
    """Rows whose key is not in ``keys`` (one row per key)."""
    return _key_join(rows, keys.select(on), on, spread_by, "left_anti", small)


def attach(rows: DataFrame, keys: DataFrame, on: str, spread_by: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Rows with the columns of ``keys`` (one row per key) next to them."""
    return _key_join(rows, keys, on, spread_by, how, None)
