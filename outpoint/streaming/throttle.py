"""Fixed-window request limits per client.

A window starts at a client's first request and the first request at least
``window`` later starts the next one. At most ``limit`` requests of a window
are admitted; 0 admits all.

Window starts form a chain per client. In the batch job time is cut into
shards of a few windows. What a shard does to the chain depends only on the
first request it starts a window with, so all shards are worked out at once,
then one light pass per client strings their summaries together. No task
holds more than the distinct times of one client in one shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SHARD_WINDOWS = 16
BATCH_ROWS = 10_000
# Fixed values.
WINDOW_MICROS = 60_000_000
UNKNOWN_CLIENT = "unknown"


def client_key(forwarded: Column, peer: Column) -> Column:
    """First forwarded address, else the peer, else ``unknown``."""
    first = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return F.when(F.length(forwarded) > 0, first).otherwise(F.coalesce(peer, F.lit(UNKNOWN_CLIENT)))


def _last_starts(times: np.ndarray, window: int) -> np.ndarray:
    """For each time, if a window starts there: the last start in the shard."""
    following = np.searchsorted(times, times + window)
    last = np.arange(len(times))
    for _ in range(SHARD_WINDOWS + 1):
        ahead = following[last]
        last = np.where(ahead < len(times), ahead, last)
    return times[last]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(client, shard, times, opens) of each shard, from rows sorted by them."""
    key, held, opens = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, times = batch.column("shard").to_numpy(), batch.column("t").to_numpy()
        # Equal clients get equal codes, so that breaks are found at once.
        coded = batch.column("client").dictionary_encode()
        codes, clients = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        first = batch.column("opens").to_pylist() if "opens" in batch.schema.names else None
        breaks = np.flatnonzero((codes[1:] != codes[:-1]) | (shard[1:] != shard[:-1])) + 1
        cuts = [0, *breaks.tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            at = (clients[codes[a]], int(shard[a]))
            if at != key:
                if held:
                    yield *key, np.concatenate(held), opens
                key, held, opens = at, [], first and first[a]
            held.append(times[a:b])
    if held:
        yield *key, np.concatenate(held), opens


def _batches(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Column pieces of many shards, put together in batches."""
    held, count = [], 0
    for row in rows:
        held.append(row)
        count += len(row[-1])
        if count >= BATCH_ROWS:
            yield _joined(held, names)
            held, count = [], 0
    if held:
        yield _joined(held, names)


def _joined(held: list[tuple], names: list[str]) -> pa.RecordBatch:
    sizes = [len(row[-1]) for row in held]
    columns = [
        pa.array([row[0] for row in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), sizes))),
        pa.array(np.repeat([row[1] for row in held], sizes)),
    ]
    columns += [pa.array(np.concatenate([row[i] for row in held])) for i in range(2, len(names))]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _summaries(window: int):
    """Per shard: runs of possible first starts that end in the same start."""

    def of_shard(run: tuple) -> tuple:
        client, shard, times, _ = run
        opening = shard * window * SHARD_WINDOWS
        # A window open from before ends within the first window of the shard.
        n = int(np.searchsorted(times, opening + window)) + 1
        upto, last = times[:n], _last_starts(times, window)[:n]
        ends = np.append(last[1:] != last[:-1], True)[: len(last)]
        return client, shard, upto[ends], last[ends]

    return lambda batches: _batches(map(of_shard, _runs(batches)), ["client", "shard", "upto", "last"])


def _entries(window: int):
    """Earliest time at which each shard may start a window."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, shard, opens, settled = None, None, None, False
        for pdf in batches:
            out = []
            for c, s, upto, last in pdf[["client", "shard", "upto", "last"]].itertuples(index=False):
                if c != client:
                    client, shard, opens = c, None, None
                if s != shard:
                    shard, settled = s, False
                if not settled and (opens is None or upto >= opens):
                    out.append((c, s, opens))
                    opens, settled = last + window, True
            yield pd.DataFrame(out, columns=["client", "shard", "opens"]).astype({"opens": "Int64"})

    return walk


def _starts(window: int):
    """All window starts of a shard, given when it may start one."""

    def of_shard(run: tuple) -> tuple:
        client, shard, times, opens = run
        at = 0 if opens is None else int(np.searchsorted(times, opens))
        starts = []
        while at < len(times):
            starts.append(times[at])
            at = int(np.searchsorted(times, times[at] + window))
        return client, shard, np.array(starts, dtype=np.int64)

    return lambda batches: _batches(map(of_shard, _runs(batches)), ["client", "shard", "start"])


def window_starts(requests: DataFrame, window: int = WINDOW_MICROS) -> DataFrame:
    """(client, shard, start) of every window; requests have client and t."""
    span = window * SHARD_WINDOWS
    times = requests.select("client", F.expr(f"t div {span}").alias("shard"), "t").distinct()
    keys = ["client", "shard"]
    runs = times.repartition(*keys).sortWithinPartitions(*keys, "t").mapInArrow(
        _summaries(window), "client string, shard bigint, upto bigint, last bigint"
    )
    in_order = runs.repartition("client").sortWithinPartitions(*keys, "upto")
    entries = in_order.mapInPandas(_entries(window), "client string, shard bigint, opens bigint")
    placed = times.join(entries, keys).repartition(*keys).sortWithinPartitions(*keys, "t")
    return placed.mapInArrow(_starts(window), "client string, shard bigint, start bigint")


def throttle(requests: DataFrame, limit: int, window: int = WINDOW_MICROS) -> DataFrame:
    """Requests (client, t, id) with ``admitted``; ``t`` is in microseconds."""
    if limit == 0:
        return requests.withColumn("admitted", F.lit(True))
    starts = window_starts(requests, window)
    span = window * SHARD_WINDOWS
    # The window of a request starts in its shard or in the one before.
    per_shard = starts.groupBy("client", "shard").agg(F.collect_list("start").alias("starts"))
    carried = per_shard.select("client", (F.col("shard") + 1).alias("shard"), F.array_max("starts").alias("carried"))
    lookup = per_shard.join(carried, ["client", "shard"], "full")
    keyed = requests.withColumn("shard", F.expr(f"t div {span}")).join(lookup, ["client", "shard"])
    own = F.array_max(F.filter("starts", lambda s: s <= F.col("t")))
    placed = keyed.withColumn("start", F.coalesce(own, "carried")).select(*requests.columns, "start")
    # Of a window only its first requests are ranked; see WindowGroupLimit.
    by_arrival = Window.partitionBy("client", "start").orderBy("t", "id")
    first = placed.select("client", "start", "t", "id").withColumn("n", F.row_number().over(by_arrival))
    cut = (
        first.filter(F.col("n") <= limit)
        .groupBy("client", "start")
        .agg(F.max(F.struct("t", "id")).alias("cut"))
    )
    return placed.join(cut, ["client", "start"]).select(
        *requests.columns, (F.struct("t", "id") <= F.col("cut")).alias("admitted")
    )


def throttle_stream(requests: DataFrame, limit: int, window: int = WINDOW_MICROS) -> DataFrame:
    """The same on a stream: (client, t, id, admitted), state is (start, count).

    Within a micro-batch the requests of a client are put in time order.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count = state.get if state.exists else (None, 0)
        pdf = pd.concat(list(batches)).sort_values(["t", "id"])
        admitted = []
        for t in pdf["t"]:
            if start is None or t - start >= window:
                start, count = int(t), 0
            passed = limit == 0 or count < limit
            count += int(passed)
            admitted.append(passed)
        state.update((start, count))
        yield pdf.assign(admitted=admitted)[["client", "t", "id", "admitted"]]

    return requests.groupBy("client").applyInPandasWithState(
        judge,
        "client string, t bigint, id bigint, admitted boolean",
        "start bigint, count bigint",
        "append",
        GroupStateTimeout.NoTimeout,
    )
