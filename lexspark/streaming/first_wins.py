"""First-wins deduplication of arriving rows: of each key the row that came first stays, later ones are counted.

A stream keeps one row and one count for each key as state (in RocksDB, so it need not fit in memory).  Of rows that arrive in one
micro-batch the first in order wins, of equals the smallest by its JSON; rows of later batches only count, whatever their order.  Tasks
combine the rows of a key before they are shuffled, so a key with many rows is a row for each task.  Keys of an existing table
start as state: they are never new.

``keep_first_rows`` writes what is new, and the counts, by batch number: a batch that is run again after a failure writes the
same files again, so a restart from the checkpoint gives the rows and counts of an undisturbed run.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


# Names of our own for all columns: state functions rename those that are no Python identifiers or begin with an underscore.


def _keys(key: list[str]) -> list[str]:
    return [f"key{i}" for i in range(len(key))]


def _ahead(rows: pd.DataFrame, ranks: list[str]) -> pd.DataFrame:
    return rows.sort_values([*ranks, "packed"], kind="stable", na_position="first")


class FirstRow(StatefulProcessor):
    """State of a key: its first row as JSON, and how many rows there were."""

    def __init__(self, ranks: list[str]) -> None:
        self.ranks = ranks

    def init(self, handle) -> None:
        self.state = handle.getValueState("first", "packed string, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = not self.state.exists()
        best, n = (None, 0) if new else self.state.get()
        first = None
        for part in rows:
            n += int(part["n"].sum())
            if new:
                first = _ahead(part if first is None else pd.concat([first, part]), self.ranks).head(1)
        if new:
            best = first["packed"].iloc[0]
        self.state.update((best, n))
        yield pd.DataFrame([[*key, best, n, new]], columns=[*_keys(key), "packed", "n", "new"])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.state.update((initialState["packed"].iloc[0], 0))

    def close(self) -> None:
        pass


def _packed(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """(key0..., rank0..., the other columns as JSON, number of rows)."""
    named = [F.col(f"`{c}`").alias(k) for c, k in zip(key, _keys(key), strict=True)]
    ranks = [F.col(f"`{c}`").alias(f"rank{i}") for i, c in enumerate(order)]
    others = F.struct(*[f"`{c}`" for c in rows.columns if c not in key])
    return rows.select(*named, *ranks, F.to_json(others, {"ignoreNullFields": "false"}).alias("packed"), F.lit(1).cast("bigint").alias("n"))


def first_rows(rows: DataFrame, key: list[str], order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """(key..., row's other columns, n_rows, new) of every key that a micro-batch touches, in update mode; rows is a stream.

    The columns beside the key must be such as JSON holds; rows of an existing table do not count.
    """
    keys, ranks, packed = _keys(key), [f"rank{i}" for i in range(len(order))], _packed(rows, key, order)

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                ahead = _ahead(batch, ranks)
                groups = ahead.groupby(keys, dropna=False, sort=False)
                yield ahead.assign(n=groups["n"].transform("sum"))[groups.cumcount() == 0]

    types = {f.name: f.dataType.simpleString() for f in packed.schema}
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "packed string, n bigint, new boolean"])
    start = _packed(existing.dropDuplicates(key), key, []).groupBy(*keys) if existing is not None else None
    out = packed.mapInPandas(combine, packed.schema).groupBy(*keys).transformWithStateInPandas(FirstRow(ranks), schema, "Update", "None", initialState=start)
    others = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in key)
    back = out.withColumn("packed", F.from_json("packed", others))
    return back.select(*[F.col(k).alias(c) for k, c in zip(keys, key, strict=True)], "packed.*", F.col("n").alias("n_rows"), "new")


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def keep_first_rows(rows: DataFrame, key: list[str], order: list[str], out: str, checkpoint: str, existing: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Start the stream; new rows go to out/rows, the counts of touched keys to out/counts, a folder for each batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.filter("new").drop("new", "n_rows").write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        batch.select(*[f"`{c}`" for c in key], "n_rows").write.mode("overwrite").parquet(f"{out}/counts/batch={number}")
        batch.unpersist()

    with rocksdb(rows.sparkSession):
        writer = first_rows(rows, key, order, existing).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def kept_rows(spark: SparkSession, out: str, key: list[str]) -> DataFrame:
    """(key..., row's other columns, n_rows): the new rows so far, with the latest count of each."""
    rows, counts = spark.read.parquet(f"{out}/rows").drop("batch"), spark.read.parquet(f"{out}/counts")
    latest = counts.groupBy(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(key)]).agg(F.max("n_rows").alias("n_rows"))
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]
    return rows.join(latest, same).drop(*[f"_k{i}" for i in range(len(key))])
