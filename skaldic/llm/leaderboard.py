"""A change feed of leaderboards: who enters, leaves or moves on a board after each day.

A board is the ``size`` highest positive revenues of one key, ties to the smaller
item. Lines come as a stream; a stateful operator (``transformWithStateInPandas``)
keeps the items' running revenues in a map and the board that was last told. It
replays the days of a micro-batch in order: a list ordered by (negative revenue,
item) is maintained by bisection, its head is the day's board, and the
difference from the board before is what it emits.

A key's items may be a third of all rows, so they are dealt to ``parts``, each a
key of the stateful operator. A part's feed has the changes of its own board: items that enter
it, leave it, or change their revenue on it. Whoever is on the whole board is on a part's, so
``merged_boards`` replays the parts' feeds by day in the same way, ``FAN`` parts at a
time and the last by key alone. A merging task gets at most 2 * ``size`` rows a part
and day, whatever the number of lines. Before the shuffle to the state each task adds up
what its Arrow batches have of an item and a day, so that a hot item is a few rows.

Before the replay, items that can't reach the board are put aside: the tenth
highest of all items' lowest revenues is a floor that the board never goes below, and an item
whose highest revenue lies below it isn't on any board of this batch.
In the map, revenues are packed by chunks of neighbouring identifiers, as each
call of the state costs a round trip to the JVM.

Cases: rows without key or item, and rows that the caller calls late, are to be
filtered before. Null values count as 0. Repeated rows add up. A day
that comes again in a later micro-batch is replayed then. An item whose revenue
is 0 is forgotten, as one never seen has the same board. An empty stream or
batch changes nothing. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SIZE = 10
FAN = 64
"""Parts whose boards meet in one merging task."""
CHUNK_BITS = 12
"""log2 of the items that a chunk of the map holds, if identifiers are dense."""
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
}
"""Every start opens the state anew: only what has changed is written, no file is sized in advance, old versions go."""

SUMS = "board {kind}, part int, day long, batch int, item_id long, value long"
PART_FEED = SUMS + ", there boolean"
CHANGES = "board {kind}, day long, item_id long, batch int, change string, old_rank int, new_rank int, revenue long"
PART_COLUMNS, CHANGE_COLUMNS = ([c.split()[0] for c in fields.split(", ")] for fields in (PART_FEED, CHANGES))


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task has read of an item and a day, added up by Arrow batch."""
    keys = ["board", "part", "day", "batch", "item_id"]
    for batch in batches:
        sums = pa.Table.from_batches([batch]).group_by(keys, use_threads=False).aggregate([("value", "sum")])
        yield from sums.rename_columns([*keys, "value"]).to_batches()


def _packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.int64).tobytes()


def _unpacked(x) -> np.ndarray:
    return np.frombuffer(bytes(x), np.int64)


class Revenues:
    """Revenues by item, sorted, as the map of a key holds them in chunks."""

    def __init__(self, state, shift: int):
        self.state, self.shift = state, shift
        found = [(_unpacked(i), _unpacked(r)) for i, r in state.values()]
        items = np.concatenate([np.zeros(0, np.int64), *[i for i, _ in found]])
        order = np.argsort(items, kind="stable")
        self.items, self.revenues = items[order], np.concatenate([np.zeros(0, np.int64), *[r for _, r in found]])[order]

    def of(self, items: np.ndarray) -> np.ndarray:
        """0 for an item that isn't there."""
        if not len(self.items):
            return np.zeros(len(items), np.int64)
        at = np.minimum(np.searchsorted(self.items, items), len(self.items) - 1)
        return np.where(self.items[at] == items, self.revenues[at], 0)

    def put(self, items: np.ndarray, revenues: np.ndarray) -> None:
        """Set the revenues of distinct ``items`` and write the chunks that hold one of them."""
        rest = ~np.isin(self.items, items)
        all_items = np.concatenate([self.items[rest], items])
        order = np.argsort(all_items, kind="stable")
        all_items, all_revenues = all_items[order], np.concatenate([self.revenues[rest], revenues])[order]
        there = all_revenues != 0
        self.items, self.revenues = all_items[there], all_revenues[there]
        chunks = self.items >> self.shift
        for chunk in np.unique(items >> self.shift).tolist():
            lo, hi = np.searchsorted(chunks, [chunk, chunk + 1])
            if hi > lo:
                self.state.updateValue((chunk,), (_packed(self.items[lo:hi]), _packed(self.revenues[lo:hi])))
            elif self.state.containsKey((chunk,)):
                self.state.removeKey((chunk,))


def trajectories(start: Revenues, item: np.ndarray, day: np.ndarray, value: np.ndarray):
    """(item, day, revenue afterwards) of added values, by item and day, and where each item begins."""
    order = np.lexsort((day, item))
    item, day, value = item[order], day[order], value[order]
    new = np.r_[True, (item[1:] != item[:-1]) | (day[1:] != day[:-1])]
    at = np.flatnonzero(new)
    item, day, value = item[at], day[at], np.add.reduceat(value, at)
    begins = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
    total = np.cumsum(value)
    sizes = np.diff(np.r_[begins, len(item)])
    before = np.repeat(total[begins] - value[begins] - start.of(item[begins]), sizes)
    return item, day, total - before, begins


def contenders(start: Revenues, item: np.ndarray, revenue: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """The items, sorted, that may be on a board while these revenues are reached."""
    touched = item[begins]
    own = start.of(touched)
    lowest = np.minimum(np.minimum.reduceat(revenue, begins), own)
    highest = np.maximum(np.maximum.reduceat(revenue, begins), own)
    still = ~np.isin(start.items, touched)
    items = np.concatenate([touched, start.items[still]])
    lowest, highest = np.concatenate([lowest, start.revenues[still]]), np.concatenate([highest, start.revenues[still]])
    floor = max(1, int(np.partition(lowest, -size)[-size])) if len(lowest) >= size else 1
    return np.sort(items[highest >= floor])


def replay(start: dict[int, int], steps: Iterator[tuple[int, list[tuple[int, int, bool]]]], size: int):
    """(day, board, revenues) after each day's (item, revenue, whether it still counts); board is a list of items."""
    now = dict(start)
    ordered = sorted((-r, i) for i, r in now.items() if r > 0)
    counted = {i for i, r in now.items() if r > 0}
    for day, updates in steps:
        for item, revenue, there in updates:
            if item in counted:
                del ordered[bisect_left(ordered, (-now[item], item))]
                counted.discard(item)
            now[item] = revenue
            if there and revenue > 0:
                insort(ordered, (-revenue, item))
                counted.add(item)
        yield day, [i for _, i in ordered[:size]], now


def _by_day(day: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[tuple]]]:
    order = np.argsort(day, kind="stable")
    days, at = np.unique(day[order], return_index=True)
    for d, rows in zip(days.tolist(), np.split(order, at[1:])):
        yield d, list(zip(*[c[rows].tolist() for c in columns]))


class Board(StatefulProcessor):
    """Replays the days of one part of a key; its state is the items' revenues and the board last told."""

    def __init__(self, size: int, shift: int):
        self.size, self.shift = size, shift

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.revenues = handle.getMapState("revenues", "chunk long", "items binary, revenues binary")
        self.board = handle.getValueState("board", "items binary, revenues binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat([f[["day", "batch", "item_id", "value"]] for f in rows])
        batches = dict(zip(table["day"].tolist(), table["batch"].tolist()))
        start = Revenues(self.revenues, self.shift)
        item, day, revenue, begins = trajectories(start, *(table[c].to_numpy() for c in ("item_id", "day", "value")))
        known = contenders(start, item, revenue, begins, self.size)
        mine = np.isin(item, known)
        steps = _by_day(day[mine], item[mine], revenue[mine], np.ones(int(mine.sum()), bool))
        saved = self.board.get()
        told = dict(zip(*[_unpacked(x).tolist() for x in saved])) if saved is not None else {}
        out = []
        for d, board, now in replay(dict(zip(known.tolist(), start.of(known).tolist())), steps, self.size):
            shown = {i: now[i] for i in board}
            out += part_changes(key, d, batches[d], told, shown, now)
            told = shown
        ends = np.r_[begins[1:], len(item)] - 1
        start.put(item[ends], revenue[ends])
        self.board.update((_packed(np.array(list(told), np.int64)), _packed(np.array(list(told.values()), np.int64))))
        if out:
            yield pd.DataFrame(out, columns=PART_COLUMNS)

    def close(self) -> None:
        pass


def part_changes(key: tuple, day: int, batch: int, before: dict, after: dict, now: dict) -> list[tuple]:
    """Rows of a part's feed: revenues that are new on its board, and the items that left it."""
    come = [(*key, day, batch, i, r, True) for i, r in after.items() if before.get(i) != r]
    return come + [(*key, day, batch, i, now[i], False) for i in before if i not in after]


def board_changes(board, day: int, batch: int, before: dict, after: dict, now: dict) -> list[tuple]:
    """Rows of the change feed, one for each item whose rank differs."""
    old, new = ({i: k + 1 for k, i in enumerate(b)} for b in (before, after))
    out = []
    for i in {**old, **new}:
        was, becomes = old.get(i), new.get(i)
        if was != becomes:
            change = "enter" if was is None else "exit" if becomes is None else "move"
            out.append((board, day, i, batch, change, was, becomes, now[i]))
    return out


def _merge(size: int, last: bool):
    def run(key: tuple, feed: pd.DataFrame) -> pd.DataFrame:
        batches = dict(zip(feed["day"].tolist(), feed["batch"].tolist()))
        steps = _by_day(*(feed[c].to_numpy() for c in ("day", "item_id", "value", "there")))
        out, told = [], {}
        for d, board, now in replay({}, steps, size):
            shown = {i: now[i] for i in board}
            out += board_changes(key[0], d, batches[d], told, shown, now) if last else part_changes(key, d, batches[d], told, shown, now)
            told = shown
        found = pd.DataFrame(out, columns=CHANGE_COLUMNS if last else PART_COLUMNS)
        return found.astype({"old_rank": "Int32", "new_rank": "Int32"}) if last else found

    return run


def part_feed(lines: DataFrame, parts: int, size: int = SIZE) -> DataFrame:
    """The streaming feed of the parts' boards, from a stream of lines.

    ``lines`` has board (any type), item_id and day (long), value (long, added to the
    item's revenue) and batch (int, copied). Needs the RocksDB state store.
    """
    kind = lines.schema["board"].dataType.simpleString()
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int").alias("part")
    narrow = lines.select("board", part, "day", "batch", "item_id", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    sums = narrow.mapInArrow(combined, SUMS.format(kind=kind))
    processor = Board(size, CHUNK_BITS + (parts - 1).bit_length())
    return sums.groupBy("board", "part").transformWithStateInPandas(processor, PART_FEED.format(kind=kind), "Append", "None")


def merged_boards(feed: DataFrame, parts: int, size: int = SIZE) -> DataFrame:
    """board, day, item_id, batch, change, old_rank, new_rank, revenue from the feed of ``parts`` parts."""
    kind = feed.schema["board"].dataType.simpleString()
    while True:
        parts = -(-parts // FAN)
        last = parts == 1
        grouped = feed.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("board", "part")
        feed = grouped.applyInPandas(_merge(size, last), (CHANGES if last else PART_FEED).format(kind=kind))
        if last:
            return feed


def folders(spark: SparkSession, path: str):
    """(file system, constructor of its paths) where ``path`` lies."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def replay_batches(spark: SparkSession, cut: str, root: str, schema: str, numbers: list[int], plan, parts: int, size: int = SIZE) -> str:
    """Feeds the folders ``cut``/batch=N in order to one stateful query, started anew for each; gives the folder of its output.

    ``plan(stream, number)`` turns the stream of a batch into lines for
    ``part_feed``, which is written. A folder is handed over by a rename, so the query sees
    a batch whole or not at all; what it has seen and the state are in its checkpoint.
    """
    feed, out = f"{root}/fed", f"{root}/parts"
    fs, at = folders(spark, root)
    fs.mkdirs(at(feed))
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        for number in numbers:
            if fs.exists(at(f"{cut}/batch={number}")):
                fs.rename(at(f"{cut}/batch={number}"), at(f"{feed}/batch={number}"))
            stream = spark.readStream.schema(schema).parquet(feed)
            writer = part_feed(plan(stream, number), parts, size).writeStream.outputMode("append").format("parquet")
            writer.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(out).awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return out
