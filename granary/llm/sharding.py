"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has a power of two of cells; ``vnodes`` virtual nodes of every shard sit on cells, and a cell belongs to the
first virtual node clockwise of it. A row's cell comes from its hash. Every shard is bounded: the counts of two shards
differ by one row at most. A shard takes the rows of its own arcs in ring order up to its bound; what overflows
continues clockwise to the next virtual node whose shard has room, so only overflowing rows move.

Only counts per cell reach the driver (65 536 cells at most, whatever the number of rows); the walk
yields rank ranges of cells, and the rows find theirs by their rank in the cell. No shard's rows meet in one task.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize


def virtual_nodes(shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes in ring order; of those that fall on one cell, the smallest hash holds it."""
    at: dict[int, tuple[int, int]] = {}
    for s in range(shards):
        for v in range(vnodes):
            h = int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big")
            cell = h % cells
            at[cell] = min(at.get(cell, (1 << 65, 0)), (h, s))
    for s in sorted(set(range(shards)) - {s for _, s in at.values()}):  # a shard that lost all its cells still needs one
        at[next(c for c in range(cells) if c not in at)] = (0, s)
    return sorted((c, s) for c, (_, s) in at.items())


def plan(counts: dict[int, int], shards: int, vnodes: int, cells: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, from rank, to rank, shard, first slot): where each rank range of each cell goes."""
    nodes = virtual_nodes(shards, vnodes, cells)
    at = [c for c, _ in nodes]
    own = {c: bisect_left(at, c) % len(at) for c in counts}
    load = [0] * shards
    for c, n in counts.items():
        load[nodes[own[c]][1]] += n
    q, r = divmod(sum(counts.values()), shards)
    larger = set(sorted(range(shards), key=lambda s: (-load[s], s))[:r])
    room = [q + (s in larger) for s in range(shards)]
    slot, out, over = [0] * shards, [], []

    def put(c: int, start: int, n: int, s: int) -> int:
        n = min(n, room[s])
        if n:
            out.append((c, start, start + n, s, slot[s]))
            room[s] -= n
            slot[s] += n
        return n

    for c in sorted(counts):
        done = put(c, 0, counts[c], nodes[own[c]][1])
        if done < counts[c]:
            over.append((c, done))
    for c, start in over:
        i = own[c]
        while start < counts[c]:
            i = (i + 1) % len(nodes)
            start += put(c, start, counts[c] - start, nodes[i][1])
    return out


def shard_documents(docs: DataFrame, shards: int = 24, vnodes: int = 64, rows_per_cell: int = 256, most_cells: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size (UTF-8 bytes plus 8), text_crc32, shard, slot (gapless from 0 within the shard).

    Law ``rows``: the counts of two shards differ by one at most. Null text: size 8, checksum 0. Null ids hash as null
    and still spread by text. Repeated rows are rows of their own; which copy gets which slot is open, as they are
    alike. An empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    slim = materialize(slim, "shard")
    n = slim.count()
    cells = 1 << max(12, min(most_cells.bit_length() - 1, (max(1, n) // rows_per_cell).bit_length()))
    hashed = slim.withColumn("h", F.xxhash64("doc_id", "size", "text_crc32"))
    hashed = hashed.withColumn("cell", F.pmod("h", F.lit(cells)).cast("int"))
    counts = {r["cell"]: r["n"] for r in hashed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most `cells` rows
    segments: dict[int, list] = {}
    for cell, start, end, shard, slot in plan(counts, shards, vnodes, cells):
        segments.setdefault(cell, []).append({"f": start, "t": end, "s": shard, "o": slot})
    kind = "array<struct<cell:int,seg:array<struct<f:bigint,t:bigint,s:int,o:bigint>>>>"
    rows = json.dumps([{"cell": c, "seg": s} for c, s in segments.items()])
    ranges = docs.sparkSession.range(1).select(F.explode(F.from_json(F.lit(rows), kind)).alias("r")).select("r.cell", "r.seg")
    ranked = hashed.withColumn("k", (F.row_number().over(Window.partitionBy("cell").orderBy("h", "doc_id", "text_crc32", "size")) - 1).cast("long"))
    found = ranked.join(ranges, "cell").withColumn("g", F.element_at(F.filter("seg", lambda x: (x["f"] <= F.col("k")) & (F.col("k") < x["t"])), 1))
    return found.select("doc_id", "size", "text_crc32", F.col("g.s").alias("shard"), (F.col("g.o") + F.col("k") - F.col("g.f")).alias("slot"))
