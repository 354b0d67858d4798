"""Resharding by minimum-cost flow.

Rows lie in old shards, each divided into blocks by a hash.  Repeated rows (of one
old shard, with the same id and text) fold into one with its number before anything
is shuffled, so a block's rows are few even where copies are very many.  Only the
blocks' sizes reach the driver, at most ``old shards * MOST_BLOCKS`` numbers.  A flow
network from old to new shards, with the new capacities at its sink and a cost
for each byte that changes its shard, gives the transfers that move the fewest
bytes.  They are laid over each old shard's blocks in order: most blocks go or
stay whole, and the few that a cut falls into are split row by row, largest
first to the part that lacks most.  Rows that stay are not touched; those that move,
and no others, are rewritten, as Parquet files under ``shard=...`` in the shared
folder, and read back.

The law that holds is ``bytes``: shard sizes differ by about the smallest rows
of a split block.  A hot old shard is many blocks, so no task gets it whole.

Defined results: a null text counts as an empty one (size 1, checksum 0); a
null old shard is shard 0.  Ties and repeated rows are interchangeable; a
slot's order is block, doc_id (nulls first), digest of the text.  A very long text
is one row and goes whole.  With fewer rows than shards some shards stay empty;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .scratch import Scratch

SHARDS = 8
OLD_SHARDS = 8
#: Blocks of an old shard at most, and rows that a block should have.
MOST_BLOCKS = 8192
BLOCK_ROWS = 256
#: Repeats of a row given out by one task, about.
REPEATS = 10_000


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[list[int]]:
    """Flow from each supply to each capacity, all supply delivered at the least cost.

    Successive shortest paths in the residual network; shards are few.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards can't hold the rows")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        far: list[float] = [0.0 if left[i] else float("inf") for i in range(n)] + [float("inf")] * m
        via = [-1] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if far[i] + cost(i, j) < far[n + j]:
                        far[n + j], via[n + j], changed = far[i] + cost(i, j), i, True
                    if flow[i][j] and far[n + j] - cost(i, j) < far[i]:
                        far[i], via[i], changed = far[n + j] - cost(i, j), n + j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: far[n + j])
        path, at = [], n + end
        while via[at] >= 0:
            path.append((via[at], at))
            at = via[at]
        amount = min(left[at], room[end], *(flow[v][u - n] for u, v in path if u >= n))
        for u, v in path:
            if u < n:
                flow[u][v - n] += amount
            else:
                flow[v][u - n] -= amount
        left[at] -= amount
        room[end] -= amount
    return flow


def plan(blocks: dict[tuple[int, int], int], shards: int, cost=None) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], list[tuple[int, int]]]]:
    """From block sizes: the shard of each whole block, and the parts (shard, bytes) of each split one."""
    old = sorted({o for o, _ in blocks})
    total = sum(blocks.values())
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    supply = [sum(n for (o, _), n in blocks.items() if o == x) for x in old]
    price = cost or (lambda o, j: 0 if o == j else 1)
    flow = min_cost_flow(supply, capacity, lambda i, j: price(old[i], j))
    whole, split = {}, {}
    for i, o in enumerate(old):
        # What costs nothing comes first, so that the blocks at the front stay.
        targets = sorted((price(o, j), j, f) for j, f in enumerate(flow[i]) if f)
        at = 0
        for key in sorted(k for k in blocks if k[0] == o):
            need, parts = blocks[key], []
            while need:
                _, j, room = targets[at]
                take = min(need, room)
                parts.append((j, take))
                need -= take
                targets[at] = (0, j, room - take)
                at += room == take
            if len(parts) == 1:
                whole[key] = parts[0][0]
            else:
                split[key] = parts
    return whole, split


def _shared_out(lacks: list[int], size: int, n: int) -> list[int]:
    """How many of ``n`` rows of one size go to each part, each to the part that then lacks most."""
    low, high = min(lacks) - size * n, max(lacks)
    # The lowest level to which all parts can be filled.
    while low < high:
        level = (low + high) // 2
        if sum(max(0, (x - level) // size) for x in lacks) <= n:
            high = level
        else:
            low = level + 1
    out = [max(0, (x - low) // size) for x in lacks]
    for _ in range(n - sum(out)):
        k = max(range(len(lacks)), key=lambda k: (lacks[k] - size * out[k], -k))
        out[k] += 1
    return out


def _deal(split: dict[tuple[int, int], list[tuple[int, int]]]):
    def run(table: pa.Table) -> pa.Table:
        """Rows of one split block, largest first, each to the part that lacks most."""
        parts = split[table.column("old")[0].as_py(), table.column("block")[0].as_py()]
        lacks, rows, shards, counts = [n for _, n in parts], [], [], []
        order = sorted(zip(table.column("size").to_pylist(), table.column("digest").to_pylist(), table.column("doc_id").to_pylist(), range(table.num_rows), strict=True), key=lambda x: (-x[0], x[1], x[2] is not None, x[2]))
        for size, _, _, k in order:
            for j, n in enumerate(_shared_out(lacks, size, table.column("n")[k].as_py())):
                if n:
                    lacks[j] -= size * n
                    rows.append(k)
                    shards.append(parts[j][0])
                    counts.append(n)
        out = table.select(["old", "block", "doc_id", "digest"]).take(pa.array(rows))
        return out.append_column("shard", pa.array(shards, pa.int32())).append_column("n", pa.array(counts, pa.int64()))

    return run


def _copies(rows: DataFrame, n: str, at: str) -> DataFrame:
    """Each row ``n`` times, numbered from 0 in ``at``; a row with very many goes to several tasks."""
    some = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / REPEATS))))
    spread = some.repartition(*(c for c in some.columns if not c.startswith("text")))
    first = F.col("_chunk") * REPEATS
    return spread.withColumn(at, F.explode(F.sequence(first, F.least(first + REPEATS, F.col(n)) - 1))).drop("_chunk")


def reshard(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows (doc_id, text, old) put into ``shards`` shards of near equal bytes; rewrites what moves.

    Gives doc_id, size, text_crc32, old_shard, shard, slot, moved.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "reshard")
    old_shards = 1 + (rows.agg(F.max("old")).first()[0] or 0)
    blocks_each = max(1, min(MOST_BLOCKS, rows.count() // (old_shards * BLOCK_ROWS)))
    digest = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    block = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(blocks_each)).cast("int")
    texts = rows.select("doc_id", "text", F.coalesce("old", F.lit(0)).cast("int").alias("old")).withColumn("digest", digest).withColumn("block", block)

    def folded(df: DataFrame, *more: str) -> DataFrame:
        size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
        crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
        measured = df.select("doc_id", "digest", "old", "block", *more, size.alias("size"), crc.alias("text_crc32"))
        return measured.groupBy("doc_id", "digest", "old", "block", "size", "text_crc32", *more).agg(F.count("*").alias("n"))

    base = scratch.table(folded(texts), "rows")
    sizes = base.groupBy("old", "block").agg(F.sum(F.col("size") * F.col("n")).alias("bytes")).collect()
    whole, split = plan({(r["old"], r["block"]): r["bytes"] for r in sizes}, shards)

    # Both tables have at most as many rows as there are blocks.
    place = F.broadcast(spark.createDataFrame([(o, b, j) for (o, b), j in whole.items()], "old int, block int, shard int"))
    cut = F.broadcast(spark.createDataFrame([(o, b) for o, b in split], "old int, block int"))
    kind = f"old int, block int, doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest binary, shard int, n long"
    dealt = scratch.table(base.join(cut, ["old", "block"]).groupBy("old", "block").applyInArrow(_deal(split), kind), "dealt")
    columns = ["doc_id", "digest", "old", "block", "shard", "size", "text_crc32", "n"]
    parted = base.drop("n").join(dealt.withColumnRenamed("doc_id", "id"), ["old", "block", "digest"]).filter(F.col("doc_id").eqNullSafe(F.col("id")))
    stays = base.join(place, ["old", "block"]).select(*columns).unionByName(parted.select(*columns)).filter("shard = old")

    # Whole blocks move as they lie; of split ones, each text as often as rows of it move.
    written = ["doc_id", "text", "digest", "old", "block", "shard"]
    once = texts.join(cut, ["old", "block"]).dropDuplicates(["doc_id", "digest", "old", "block"])
    leaving = dealt.filter("shard <> old").withColumnRenamed("doc_id", "id")
    torn = _copies(once.join(leaving, ["old", "block", "digest"]).filter(F.col("doc_id").eqNullSafe(F.col("id"))), "n", "_at")
    rewritten = scratch.path("shards")
    texts.join(place, ["old", "block"]).filter("shard <> old").select(*written).unionByName(torn.select(*written)).write.option("compression", "zstd").partitionBy("shard").parquet(rewritten)
    kinds = {"digest": "binary", "old": "int", "block": "int", "shard": "int"}
    kind = ", ".join(f"{c} {kinds[c] if c in kinds else rows.schema[c].dataType.simpleString()}" for c in written)
    moved = folded(spark.read.schema(kind).parquet(rewritten), "shard")
    now = scratch.table(stays.unionByName(moved.select(*columns)), "placed")

    # Slots: the rows of earlier blocks of the shard, then the place within the block.
    counts = now.groupBy("shard", "old", "block").agg(F.sum("n").alias("n")).collect()
    before: dict[int, int] = defaultdict(int)
    starts = []
    for r in sorted(counts, key=lambda r: (r["shard"], r["old"], r["block"])):
        starts.append((r["shard"], r["old"], r["block"], before[r["shard"]]))
        before[r["shard"]] += r["n"]
    start = F.broadcast(spark.createDataFrame(starts, "shard int, old int, block int, before long"))
    within = Window.partitionBy("shard", "old", "block").orderBy("doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    out = now.withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0))).join(start, ["shard", "old", "block"])
    out = _copies(out.select("doc_id", "size", "text_crc32", "old", "shard", (F.col("before") + F.col("at")).alias("first"), "n"), "n", "nth")
    return out.select("doc_id", "size", "text_crc32", F.col("old").alias("old_shard"), "shard", (F.col("first") + F.col("nth")).alias("slot"), (F.col("old") != F.col("shard")).alias("moved"))


def op1_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lie in old shards by source, so the hot source fills one of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(OLD_SHARDS)).cast("int")
    out = reshard(docs.select("doc_id", "text", old.alias("old")))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")
