"""Problem 7: texts into containers of fixed capacity, by the sum-of-squares rule.

Online rule: of all fill levels into which a text fits (an empty container among them), take the one after
which the sum of the squared numbers of open containers per level is least. The state is one array with a
count per level. Texts are dealt to shards by a hash of their id, the number of shards following the number of texts, and
shards are packed independently. Within a shard they arrive largest first, so the small ones that come last fill
what the large ones left; among equal sizes by the hash. As an option, off by default, containers that are still
far from full when a shard ends are repacked best fit.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkroll.llm.tokens import VOCABULARY, with_copies, with_tokens
from inkroll.session import materialise, spread
from inkroll.sources.tables import table

#: Texts per shard and capacity: what one task packs and holds in memory, ids and sizes only.
SHARD = 50_000
#: With `repack`, containers filled less than this when a shard ends are repacked.
CLOSE_BELOW = 0.98


def pack_online(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container of every piece, and the fill of every container. Sizes must lie in 0..capacity.

    Pieces of size 0 go to container 0.
    """
    n_level = np.zeros(capacity + 1, np.int64)  # open containers per fill level; level `capacity` stays 0
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills: list[int] = []
    out = np.zeros(len(sizes), np.int64)
    far = np.iinfo(np.int64).max
    for i, size in enumerate(sizes.tolist()):
        if size == 0:
            continue
        # Change of the sum of squares: leaving level h gives 1 - 2 N[h], entering level h + size gives 1 + 2 N[h + size].
        here, there = n_level[1 : capacity - size + 1], n_level[1 + size : capacity + 1]
        best, change = 0, 2 * int(n_level[size]) + 1 if size < capacity else 0
        if len(here):
            change_at = np.where(here > 0, 2 * (there - here) + 2, far)
            if here[-1] > 0:
                change_at[-1] = 1 - 2 * here[-1]
            k = len(change_at) - 1 - int(np.argmin(change_at[::-1]))
            if change_at[k] <= change:
                best = k + 1
        if best:
            box = open_at[best].pop()
            n_level[best] -= 1
        else:
            box = len(fills)
            fills.append(0)
        fills[box] += size
        out[i] = box
        if fills[box] < capacity:
            open_at[fills[box]].append(box)
            n_level[fills[box]] += 1
    return out, np.array(fills, np.int64)


def close(sizes: np.ndarray, boxes: np.ndarray, fills: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Repack the pieces of containers that are far from full, largest first into the fullest that has room."""
    loose = np.flatnonzero((fills[boxes] < CLOSE_BELOW * capacity) & (sizes > 0)) if len(fills) else np.array([], np.int64)
    if len(loose) < 2:
        return boxes, fills
    before = len(np.unique(boxes[loose]))
    order = loose[np.argsort(-sizes[loose], kind="stable")]
    levels: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    occupied = np.zeros(capacity + 1, bool)
    new, rooms = {}, []
    for i in order.tolist():
        size = int(sizes[i])
        fit = occupied[size:]
        k = int(np.argmax(fit)) if len(fit) and fit.any() else -1
        if k < 0:
            box = len(rooms)
            rooms.append(capacity)
        else:
            box = levels[size + k].pop()
            occupied[size + k] = bool(levels[size + k])
        rooms[box] -= size
        levels[rooms[box]].append(box)
        occupied[rooms[box]] = True
        new[i] = box
    if len(rooms) >= before:
        return boxes, fills
    kept = np.unique(boxes[(fills[boxes] >= CLOSE_BELOW * capacity) & (sizes > 0)])
    number = {int(b): k for k, b in enumerate(kept)}
    out = np.array([0 if s == 0 else new[i] + len(kept) if i in new else number[int(b)] for i, (b, s) in enumerate(zip(boxes, sizes, strict=True))], np.int64)
    return out, np.array([*fills[kept], *(capacity - r for r in rooms)], np.int64)


def pack(sized: DataFrame, key: str, tokens: str, capacities: list[tuple[int, int]], repack: bool = False) -> DataFrame:
    """A container for every text and capacity: ``pack_id, capacity_tokens, container, <key>, piece, from_token, piece_tokens``.

    A text larger than the capacity is split into full pieces, each a container of its own, and a rest that
    is packed like a text; no other text is split. Empty and null texts (0 tokens) get one piece of size 0.
    Repeated rows are packed as often as they occur, and rows of one id are spread over the shards. ``capacities`` is the small
    configuration table (id, tokens); each must be positive. Two shuffles of ids and sizes.
    """
    if any(c < 1 for _, c in capacities):
        raise ValueError("capacities must be positive")
    out = f"pack_id int, capacity_tokens int, container string, `{key}` {sized.schema[key].dataType.simpleString()}, piece int, from_token bigint, piece_tokens bigint"
    if not capacities:
        return sized.sparkSession.createDataFrame([], out)
    shards = max(1, math.ceil(sized.count() / SHARD))
    boxes = F.array(*[F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("int").alias("capacity_tokens")) for p, c in capacities])
    every = with_copies(sized.select(key, F.col(tokens).alias("_n")), key).select(key, "_n", "_copy", F.explode(boxes).alias("_b")).select(key, "_n", "_copy", "_b.*")
    full = every.where("_n > capacity_tokens").withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor(F.col("_n") / F.col("capacity_tokens")).cast("int") - 1)))
    full = full.select(
        "pack_id", "capacity_tokens", F.concat(F.lit("f"), F.hex(F.xxhash64(F.col(key), F.col("pack_id"))), F.lit("-"), F.monotonically_increasing_id().cast("string")).alias("container"), key, "piece",
        (F.col("piece") * F.col("capacity_tokens")).cast("bigint").alias("from_token"), F.col("capacity_tokens").cast("bigint").alias("piece_tokens"),
    )
    over = F.col("_n") > F.col("capacity_tokens")
    rest = every.withColumn("piece", F.when(over, F.floor(F.col("_n") / F.col("capacity_tokens"))).otherwise(0).cast("int")).withColumn("_size", F.when(over, F.col("_n") % F.col("capacity_tokens")).otherwise(F.col("_n")))
    rest = rest.where(~over | (F.col("_size") > 0)).withColumn("_o", F.xxhash64(F.lit(7), F.col(key), F.col("_copy"))).withColumn("_shard", F.pmod(F.col("_o"), F.lit(shards)).cast("int"))

    def run(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_size", "_o"], ascending=[False, True], kind="stable")
        capacity, sizes = int(frame["capacity_tokens"].iloc[0]), frame["_size"].to_numpy(np.int64)
        placed, fills = pack_online(sizes, capacity)
        placed = close(sizes, placed, fills, capacity)[0] if repack else placed
        frame["container"] = [f"s{group[1]}-{b}" for b in placed]
        frame["from_token"], frame["piece_tokens"] = frame["piece"].astype("int64") * capacity, sizes
        return frame[["pack_id", "capacity_tokens", "container", key, "piece", "from_token", "piece_tokens"]]

    return full.unionByName(rest.select("pack_id", "capacity_tokens", key, "piece", "_size", "_o", "_shard").groupBy("pack_id", "_shard").applyInPandas(run, out))


def _packed(spark: SparkSession, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    sized = materialise(with_tokens(spread(table(spark, folder, "documents").select("doc_id", "text")), "text", vocabulary=vocabulary))
    capacities = [(r.pack_id, r.capacity_tokens) for r in table(spark, folder, "pack_capacities").collect()]
    return pack(sized, "doc_id", "tokens", capacities)


def p7_pack(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every text for every capacity."""
    return _packed(spark, folder)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used per capacity, the least possible number and the share of space that is used."""
    sums = _packed(spark, folder).groupBy("pack_id", "capacity_tokens").agg(F.countDistinct("container").alias("containers"), F.sum("piece_tokens").alias("tokens"))
    return sums.withColumn("at_least", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("used", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


QUERIES = {"p7_pack": p7_pack, "p7_fill": p7_fill}
