"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` tokens on a ring of 63-bit positions; a key belongs
to the owner of the first token at or after its hash.  A shard that is full
passes its keys on clockwise to the next shard with room.  With ``slack`` 0 the
capacities add up to the rows, so any two shards differ by one row at most.

Scale: texts are read once, for size and checksum only.  The light rows are
numbered in ring order by a range partition (copies of one hot key are spread
by a tie-breaker), counted per arc, and the arcs -- shards x vnodes of them,
whatever the input -- are filled on the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import pick
from quarry.operators.ids import assign_ids

OVERHEAD = 16


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted token positions, their owners)."""
    tokens = sorted(
        (int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:8], "little") >> 1, s) for s in range(shards) for v in range(vnodes)
    )
    return np.array([t for t, _ in tokens], dtype=np.int64), np.array([s for _, s in tokens], dtype=np.int64)


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Rows a shard can hold: exact shares for slack 0, else (1 + slack) times the mean, rounded up."""
    if slack > 0:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def fill(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """Place the keys of every arc: (first rank, keys, shard, first slot), in rank order.

    Keys go home while there is room, in ring order; then one walk clockwise
    (at most two turns) hands the rest to the next shard with room.
    """
    room, used, placed, over, start = list(room), [0] * len(room), [], [[] for _ in counts], 0

    def put(first: int, n: int, shard: int) -> None:
        placed.append((first, n, shard, used[shard]))
        used[shard] += n
        room[shard] -= n

    for arc, n in enumerate(counts):
        home = min(n, room[owners[arc]])
        if home:
            put(start, home, owners[arc])
        if n > home:
            over[arc].append((start + home, n - home))
        start += n
    carried: list[tuple[int, int]] = []
    for arc in [*range(len(counts)), *range(len(counts))]:
        while carried and room[owners[arc]]:
            first, n = carried.pop(0)
            take = min(n, room[owners[arc]])
            put(first, take, owners[arc])
            if n > take:
                carried.insert(0, (first + take, n - take))
        carried += over[arc]
        over[arc] = []
    return sorted(placed)


def ring_shards(
    docs: DataFrame, shards: int = 40, vnodes: int = 64, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, home_shard, shard and slot for every row.

    Null text has size 16 and the checksum of no bytes; null ids share one ring
    position; repeated rows are placed one by one; an empty table gives no rows.
    Columns other than id and text are not read.
    """
    tokens, owners = ring(shards, vnodes)
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    light = pick(docs, doc_id=id_col, text=text_col).select(
        "doc_id",
        (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        # 63 bits of the id's hash
        F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("_pos"),
        F.monotonically_increasing_id().alias("_tie"),
    )

    @F.pandas_udf("int")
    def arc_of(pos: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(tokens, pos.to_numpy()) % len(tokens)).astype(np.int32))

    # keys past the last token wrap to the first arc; ranks stay contiguous per arc, so the wrap gets an arc of its own
    wrapped = F.when(F.col("_pos") > int(tokens[-1]), F.lit(len(tokens))).otherwise(arc_of("_pos"))
    ranked = assign_ids(light.withColumn("_arc", wrapped), ["_pos", "doc_id", "text_crc32", "_tie"], id_col="_rank")
    per_arc = {r["_arc"]: r["n"] for r in ranked.groupBy("_arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [per_arc.get(a, 0) for a in range(len(tokens) + 1)]
    homes = [*owners.tolist(), int(owners[0])]
    placed = fill(counts, homes, capacities(sum(counts), shards, slack))
    first, _, shard, slot = (np.array(x, dtype=np.int64) for x in (zip(*placed, strict=True) if placed else ([], [], [], [])))
    home_of = np.array(homes, dtype=np.int32)

    @F.pandas_udf("shard int, slot long, home int")
    def place(rank: pd.Series, arc: pd.Series) -> pd.DataFrame:
        r = rank.to_numpy()
        k = np.searchsorted(first, r, side="right") - 1
        return pd.DataFrame({"shard": shard[k].astype(np.int32), "slot": slot[k] + r - first[k], "home": home_of[arc.to_numpy()]})

    return ranked.withColumn("_p", place("_rank", "_arc")).select(
        "doc_id", "size", "text_crc32", F.col("_p.home").alias("home_shard"), F.col("_p.shard").alias("shard"), F.col("_p.slot").alias("slot")
    )
