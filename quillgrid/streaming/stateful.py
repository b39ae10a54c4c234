"""Streams: files as rows, packing with an open bin carried over, sessions begun by a marker row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.packs import best_fit


def file_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_per_batch).load(path)


def packed_stream(rows: DataFrame, shard: str, key: str, length: str, capacity: int) -> DataFrame:
    """(shard, key, length, bin) of a stream: within a shard every batch that arrives is packed with
    the bin left open by the one before. Rows longer than the capacity lie alone. State of a
    shard: the number of bins and the fill of its open bin, so it never grows; a batch is the
    most that is held at a time."""

    def step(group: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        made, fill = state.get if state.exists else (0, 0)
        for got in pdfs:
            got = got.sort_values(key, kind="stable")
            lengths = got[length].astype(int).tolist()
            # The open bin takes part as a first item that is already placed.
            at = best_fit([fill, *lengths], capacity) if fill else [None, *best_fit(lengths, capacity)]
            names: dict[int, int] = {at[0]: made - 1} if fill else {}
            totals = {made - 1: fill} if fill else {}
            out = []
            for b, n in zip(at[1:], lengths):
                if b not in names:
                    names[b] = made
                    made += 1
                out.append(names[b])
                totals[names[b]] = totals.get(names[b], 0) + n
            fill = totals.get(made - 1, 0)
            fill = fill if fill < capacity else 0
            yield pd.DataFrame({shard: group[0], key: got[key].to_numpy(), length: got[length].to_numpy(), "bin": out})
        state.update((made, fill))

    kinds = dict(rows.dtypes)
    return rows.groupBy(shard).applyInPandasWithState(
        step, f"`{shard}` {kinds[shard]}, `{key}` {kinds[key]}, `{length}` {kinds[length]}, bin bigint", "made bigint, fill bigint", "append", GroupStateTimeout.NoTimeout
    )


def session_stream(rows: DataFrame, user: str, order: str, starts: str) -> DataFrame:
    """(user, order, session) of a stream: a row whose column `starts` is true begins the next session."""

    def step(group: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        got = pd.concat(list(pdfs), ignore_index=True).sort_values(order, kind="stable")
        s = got[starts].fillna(False).astype(int).cumsum() + n
        state.update((int(s.iloc[-1]) if len(s) else n,))
        yield pd.DataFrame({user: group[0], order: got[order].to_numpy(), "session": s.to_numpy()})

    kinds = dict(rows.dtypes)
    return rows.groupBy(user).applyInPandasWithState(step, f"`{user}` {kinds[user]}, `{order}` {kinds[order]}, session bigint", "n bigint", "append", GroupStateTimeout.NoTimeout)


def shuffled_batches(rows: DataFrame, key: str, seed: int, sink: str, checkpoint: str):
    """Each micro-batch written in the drawn order of its own rows: what a shuffle buffer becomes on a stream."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.orderBy(F.xxhash64(key, F.lit(seed)), key).write.mode("append").parquet(sink)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that is there now, written as Parquet; a later call takes up where this one ended."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
