"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots. Bytes are summed per slot, and a slot-to-shard map is
made from those sums. The map is a small versioned table: rebalancing and growing edit it and raise its version, and
only the slots that an edit names move.

Defined results: a null text has 0 bytes and the CRC-32 of no bytes (0); a null doc_id hashes as null and its rows
stay; repeated rows are told apart by a running number, made in blocks of COPIES, so that a row that occurs a billion times spreads over all slots and tasks;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.llm.common import cut, shared_dir, text_bytes

#: Virtual slots; fixed for the life of a data set. All that reaches the driver has one row for each.
N_SLOTS = 8192
#: Equal rows that are written out at once; more of them are dealt out in blocks first.
COPIES = 4096


@dataclass(frozen=True)
class SlotMap:
    """Version, number of shards, and for each virtual slot its shard; sizes and rows are those it was made from."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]
    bytes_of: tuple[int, ...]
    rows_of: tuple[int, ...]

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for s, b in zip(self.shard_of, self.bytes_of, strict=True):
            out[s] += b
        return out


def first_map(bytes_of: list[int], rows_of: list[int], n_shards: int) -> SlotMap:
    """Largest slot first, each to the shard with the fewest bytes so far (ties: fewer slots, then the lower shard)."""
    heap = [(0, 0, s) for s in range(n_shards)]
    shard_of = [0] * len(bytes_of)
    for slot in sorted(range(len(bytes_of)), key=lambda i: (-bytes_of[i], i)):
        load, n, s = heapq.heappop(heap)
        shard_of[slot] = s
        heapq.heappush(heap, (load + bytes_of[slot], n + 1, s))
    return SlotMap(1, n_shards, tuple(shard_of), tuple(bytes_of), tuple(rows_of))


def rebalance(old: SlotMap, bytes_of: list[int], rows_of: list[int], n_shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
    """The next version of a map for new slot sizes and perhaps more shards.

    Moves the largest slot that still fits from the fullest shard to the emptiest until all are within the tolerance of the mean or no
    move helps; slots that need not move stay. When shards are added, only they take slots.
    """
    n_shards = n_shards or old.n_shards
    if n_shards < old.n_shards:
        raise ValueError("a map can grow, not shrink; make a new one")
    shard_of = list(old.shard_of)
    members: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    loads = [0] * n_shards
    for slot, s in enumerate(shard_of):
        members[s].append((bytes_of[slot], slot))
        loads[s] += bytes_of[slot]
    mean, grows = sum(loads) / n_shards, n_shards > old.n_shards
    takers = range(old.n_shards if grows else 0, n_shards)
    for _ in range(len(shard_of)):
        hi, lo = max(range(n_shards), key=lambda s: (loads[s], -s)), min(takers, key=lambda s: (loads[s], s))
        if (grows or loads[hi] - mean <= tolerance * mean) and mean - loads[lo] <= tolerance * mean:
            break
        room = min(loads[hi] - loads[lo] - 1, max(loads[hi] - mean, mean - loads[lo]) + tolerance * mean)
        fits = [m for m in members[hi] if 0 < m[0] <= room]
        if not fits:
            break
        size, slot = max(fits)
        members[hi].remove((size, slot))
        members[lo].append((size, slot))
        loads[hi] -= size
        loads[lo] += size
        shard_of[slot] = lo
    return SlotMap(old.version + 1, n_shards, tuple(shard_of), tuple(bytes_of), tuple(rows_of))


def records(docs: DataFrame, n_slots: int = N_SLOTS, copies: int = COPIES) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of each row. Equal rows are counted before the shuffle and numbered after it."""
    narrow = docs.select("doc_id", (text_bytes() + 1).alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    counted = narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    few = counted.filter(F.col("n") <= copies).select("doc_id", "size", "text_crc32", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    blocks = counted.filter(F.col("n") > copies).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / copies)))).repartition("doc_id", "text_crc32", "block")
    last = F.least(F.col("n"), (F.col("block") + 1) * copies)
    each = few.unionByName(blocks.select("doc_id", "size", "text_crc32", F.explode(F.sequence(F.col("block") * copies + 1, last)).alias("copy")))
    return each.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "copy"), F.lit(n_slots)).cast("int"))


def slot_sizes(rows: DataFrame, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    bytes_of, rows_of = [0] * n_slots, [0] * n_slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():  # n_slots rows at most
        bytes_of[r["virtual_slot"]], rows_of[r["virtual_slot"]] = r["b"], r["n"]
    return bytes_of, rows_of


def map_table(spark: SparkSession, slots: SlotMap) -> DataFrame:
    """The map as a table: version, number of shards, virtual_slot, shard, bytes, rows, and the place in its shard at which the slot's rows start."""
    start, out = [0] * slots.n_shards, []
    for v, s in enumerate(slots.shard_of):
        out.append((slots.version, slots.n_shards, v, s, slots.bytes_of[v], slots.rows_of[v], start[s]))
        start[s] += slots.rows_of[v]
    return spark.createDataFrame(out, "version int, n_shards int, virtual_slot int, shard int, bytes long, rows long, start long")


def save_map(spark: SparkSession, slots: SlotMap, path: str) -> None:
    """Adds a version; one that is there already stays, and writing it again is an error."""
    map_table(spark, slots).drop("version").coalesce(1).write.mode("error").parquet(f"{path}/version={slots.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
    """A stored version, by default the latest; None where none is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    all_ = spark.read.parquet(path)
    version = version or all_.agg(F.max("version")).first()[0]
    got = sorted((r["virtual_slot"], r["shard"], r["bytes"], r["rows"], r["n_shards"]) for r in all_.filter(F.col("version") == version).collect())
    return SlotMap(version, got[0][4], tuple(x[1] for x in got), tuple(x[2] for x in got), tuple(x[3] for x in got))


def place(rows: DataFrame, slots: SlotMap) -> DataFrame:
    """Adds shard, and the row's place in it: the slot's start plus the row's rank in its slot. The map is broadcast (one row a virtual slot)."""
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy"))
    table = map_table(rows.sparkSession, slots).select("virtual_slot", "shard", "start", "version")
    return rows.withColumn("rank", rank).join(F.broadcast(table), "virtual_slot").withColumn("place", (F.col("start") + F.col("rank") - 1).cast("long"))


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Every row of docs with its virtual slot, shard and place in the shard.

    Where map_path holds a map, its latest version is edited for the sizes (and, perhaps, shards) of now and stored as the next one; else a first version is made and stored, by
    default in a folder of its own below the shared one."""
    spark = docs.sparkSession
    path = map_path or f"{shared_dir(spark)}/slot_map-{uuid.uuid4().hex}"
    rows, old = cut(records(docs, n_slots)), load_map(spark, path)
    sizes = slot_sizes(rows, n_slots)
    if old is not None and len(old.shard_of) != n_slots:
        raise ValueError(f"the stored map has {len(old.shard_of)} virtual slots, which are fixed")
    save_map(spark, first_map(*sizes, n_shards) if old is None else rebalance(old, *sizes, n_shards), path)
    return place(rows, load_map(spark, path))
