"""Problem 9: filling fixed-capacity containers, by sum-of-squares online packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostra.llm.bpe import DEFAULT_TOKENIZER, count_tokens
from rostra.session import checkpointed

CAPACITY = 2048
#: Items packed by one task with one level array; the number of shards grows with the data.
SHARD_ITEMS = 50_000


class LevelArray:
    """Open containers by fill level. `counts[h]` is the number of containers filled to h, 0 < h < capacity; an item
    goes where the sum of the squared counts is least afterwards (ties: the fullest container, a new one last).
    Levels are few however many items come, and one placement costs one pass over them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.containers = 0

    def place(self, size: int) -> tuple[int, int]:
        """(container, fill before) of an item of 1..capacity."""
        c, n = self.capacity, self.counts
        # change of the sum of squares by moving one container from level h to h + size, for h = 0..capacity - size
        gain = 2 * n[size : c + 1] + 1
        gain[c - size] = 0  # a full container isn't counted any more
        cost = gain - (2 * n[: c - size + 1] - 1)
        usable = n[: c - size + 1] > 0
        cost = np.where(usable, cost, np.iinfo(np.int64).max)
        cost[0] = gain[0]  # a new container leaves no level
        back = cost[::-1]
        level = c - size - int(np.argmin(back))
        if level:
            container = self.open[level].pop()
            n[level] -= 1
        else:
            container = self.containers
            self.containers += 1
        if level + size < c:
            self.open[level + size].append(container)
            n[level + size] += 1
        return container, level


def _pack(batches: Iterator[pd.DataFrame], capacity: int) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    shard, levels = TaskContext.get().partitionId(), LevelArray(capacity)
    for pdf in batches:
        sizes = pdf["size"].tolist()
        placed = [levels.place(s) for s in sizes]
        box = np.fromiter((p[0] for p in placed), np.int64, len(placed))
        yield pd.DataFrame({
            "item": pdf["item"], "piece": pdf["piece"], "item_start": pdf["item_start"], "size": pdf["size"],
            "container": (np.int64(shard) << 40) + box, "container_start": [p[1] for p in placed],
        })


def pack(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, shards: int | None = None) -> DataFrame:
    """(item, piece, item_start, size, container, container_start) for items (item, size).

    An item larger than the capacity is split: full pieces have a container each, the rest is packed like any other
    item. Nothing else is split. Items of size 0 (or null, or negative) take no room: they come out once with a null
    container. Repeated items are packed once for each row. Each shard of about `shard_items` items, spread by hash,
    is one stream with a level array of its own; what shards lose is the open containers at their ends, so then
    all containers that are less than full are packed again as items of their own, by one stream per 256 shards.
    Rows are ordered within shards, so a task that is run again gives the same containers.
    """
    # the row number keeps repeated items apart, so that their pieces spread over the shards
    whole = items.select(F.col("item"), F.monotonically_increasing_id().alias("row"), F.greatest(F.coalesce(F.col("size").cast("bigint"), F.lit(0)), F.lit(0)).alias("all"))
    sized = checkpointed(whole)  # sizes are dear (tokens), and counted before they are packed
    n = shards or max(1, -(-sized.count() // shard_items))
    c = F.lit(capacity)
    # floor(all/capacity) full pieces, then the rest if there is one
    pieces = sized.filter("all > 0").select(
        "item", "row", "all", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("all") / c).cast("bigint") - 1)).alias("piece")
    )
    pieces = pieces.select(
        "item", "row", F.col("piece").cast("int").alias("piece"), (F.col("piece") * c).alias("item_start"),
        F.least(c.cast("bigint"), F.col("all") - F.col("piece") * c).alias("size"),
    )
    spread = pieces.repartition(n, F.xxhash64("row", "piece")).sortWithinPartitions("row", "piece")
    schema = "item bigint, piece int, item_start bigint, size bigint, container bigint, container_start bigint"
    packed = checkpointed(spread.mapInPandas(lambda b: _pack(b, capacity), schema))
    if n > 1:
        packed = _join_leftovers(packed, capacity, -(-n // 256))
    none = sized.filter("all = 0").select(
        "item", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("item_start"), F.col("all").alias("size"),
        F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("bigint").alias("container_start"),
    )
    return packed.unionByName(none)


def _join_leftovers(packed: DataFrame, capacity: int, streams: int) -> DataFrame:
    """Containers that no shard could fill become items of a second packing; their contents move with them."""
    fills = packed.groupBy("container").agg(F.sum("size").alias("size")).filter(F.col("size") < capacity)
    items = fills.select(F.col("container").alias("item"), F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("item_start"), "size")
    schema = "item bigint, piece int, item_start bigint, size bigint, container bigint, container_start bigint"
    again = items.repartition(streams, F.xxhash64("item")).sortWithinPartitions(F.desc("size"), "item").mapInPandas(lambda b: _pack(b, capacity), schema)
    # numbers of the second packing lie below zero, apart from those of the first
    moved = again.select(F.col("item").alias("container"), (-1 - F.col("container")).alias("_to"), F.col("container_start").alias("_at"))
    joined = packed.join(moved, "container", "left")
    return joined.select(
        "item", "piece", "item_start", "size", F.coalesce("_to", "container").alias("container"),
        (F.col("container_start") + F.coalesce("_at", F.lit(0))).alias("container_start"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc_id, piece, doc_start, tokens, container_id, container_start): where the tokens of each document lie."""
    items = count_tokens(docs, "doc_id", "text", tokenizer).select(F.col("doc_id").alias("item"), F.col("tokens").alias("size"))
    return pack(items, capacity).select(
        F.col("item").alias("doc_id"), "piece", F.col("item_start").alias("doc_start"), F.col("size").alias("tokens"),
        F.col("container").alias("container_id"), "container_start",
    )




def audit(packed: DataFrame, docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = DEFAULT_TOKENIZER, slack: float = 1.01) -> DataFrame:
    """One row on a packing of documents: how many containers are overfull, pieces don't lie right behind each other, documents don't have
    all their tokens or are in more pieces than they must be; how many documents there are and how many have no tokens; and whether
    the containers are within `slack` of the least possible number (and one for each stream's last ones). All over whole tables; the
    windows are by container, which holds `capacity` pieces at most."""
    placed = packed.filter("container_id is not null")
    before = F.sum("tokens").over(Window.partitionBy("container_id").orderBy("container_start").rowsBetween(Window.unboundedPreceding, -1))
    misplaced = placed.select((F.coalesce(before, F.lit(0)) != F.col("container_start")).alias("bad")).agg(F.count_if("bad").alias("misplaced"))
    fills = placed.groupBy("container_id").agg(F.sum("tokens").alias("fill"))
    least = F.ceil(F.coalesce(F.sum("fill"), F.lit(0)) / capacity)
    boxes = fills.agg(F.count_if(F.col("fill") > capacity).alias("overfull"), (F.count(F.lit(1)) <= least * slack + 2).alias("tight"))
    sizes = count_tokens(docs, "doc_id", "text", tokenizer).select("doc_id", F.col("tokens").alias("size"))
    mine = packed.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("tokens") == 0).alias("none"))
    both = sizes.join(mine, "doc_id", "full")
    wrong = ~F.col("size").eqNullSafe(F.col("tokens")) | (F.col("pieces") != F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)))
    whole = both.agg(F.count_if(wrong).alias("wrong_documents"), F.count(F.lit(1)).alias("documents"), F.count_if(F.col("size") == 0).alias("empty"))
    return boxes.join(F.broadcast(misplaced)).join(F.broadcast(whole))  # one row each
