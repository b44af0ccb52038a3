"""K-d tree sharding: leaves of near equal bytes.

``split`` cuts a table of sizes along the metadata dimension that is widest in each node (the spread of its values,
as a share of the spread over all rows), at the distributed weighted median, until there is a leaf for each shard.
A median is found in rounds, for all nodes of a level at once: one aggregation sums the bytes between 2**14 bounds of each open node, the bound where the
wanted share lies is found by a window over each node's sums, and the next round looks only there. The driver sees one row
for each node, however many rows there are; what it knows of the nodes is a table of as many rows, to which rows are joined, so plans do not grow with the
number of leaves. Within equal values rows are ordered by a hash of their text, then by a hash of
their key: copies stay together unless keeping them would move the cut by more than ``slack`` of the node.

Defined results: a null text has size 1 and no bytes; null dimensions count as the smallest value; rows that are
the same in key and text may lie on either side of a cut only together; an empty table gives an empty table.
Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BOUNDS = 1 << 14
#: Hashes have so many bits: three rounds of bounds each.
HASH_BITS = 42
#: Rows that get their slots in one task.
SLOT_ROWS = 1 << 16
#: Nodes, some 80 bytes each, that may be broadcast.
BROADCAST_NODES = 200_000
#: Behind every hash and every value that is looked at.
LAST = (1 << 63) - 1


@dataclass
class Node:
    """An open node: its label, its leaves, and the three-part key range (value, text hash, row hash) that is still searched."""

    label: int
    leaves: int
    dim: str = ""
    part: int = 0
    below: float = 0.0
    total: float = 0.0
    fixed: list[int] = field(default_factory=list)
    low: int = 0
    high: int = 0
    cut: tuple[int, ...] | None = None


def sized(df: DataFrame, key: str, text: str, dims: dict[str, Column]) -> DataFrame:
    """(key, size, text_crc32, text_hash, row_hash, one long for each dimension), written."""
    t, k = F.col(f"`{text}`"), F.col(f"`{key}`")
    cols = [k.alias("key"), (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32")]
    cols += [F.shiftrightunsigned(F.xxhash64(F.coalesce(t, F.lit(""))), 64 - HASH_BITS).alias("text_hash"), F.shiftrightunsigned(F.xxhash64(k, t), 64 - HASH_BITS).alias("row_hash")]
    return written(df.select(*cols, *[F.coalesce(c.cast("long"), F.lit(-1)).alias(f"dim_{n}") for n, c in dims.items()]), "sizes")


def _widest(rows: DataFrame, dims: list[str], whole: dict[str, int]) -> dict[int, tuple[str, int, int, int]]:
    """For each node: its widest dimension, that one's range, and the node's bytes. One row for each node comes to the driver."""
    found = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).collect()
    out = {}
    for r in found:
        d = max(dims, key=lambda d: ((r[f"hi_{d}"] - r[f"lo_{d}"]) / (whole[d] or 1), d))
        out[r["node"]] = (d, r[f"lo_{d}"], r[f"hi_{d}"], r["bytes"])
    return out


def _joined(rows: DataFrame, table: list[tuple], schema: str) -> DataFrame:
    """``rows`` with what ``table`` says of their node; rows of other nodes are left out."""
    small = rows.sparkSession.createDataFrame(table, f"node long, {schema}")
    return rows.join(F.broadcast(small) if len(table) <= BROADCAST_NODES else small, "node")


def _value(dims: list[str]) -> Column:
    """The dimension that ``dim``, its place in ``dims``, names."""
    return F.get(F.array(*map(F.col, dims)), F.col("dim"))


def _medians(rows: DataFrame, nodes: list[Node], dims: list[str], slack: float) -> None:
    """Sets each node's cut: rows up to it, in the order of the three parts, go left."""
    open_nodes = [n for n in nodes if n.cut is None]
    while open_nodes:
        widths = {n.label: max(1, -(-(n.high - n.low + 1) // BOUNDS)) for n in open_nodes}
        wants = {n.label: n.total * (n.leaves // 2) / n.leaves for n in open_nodes}
        told = [(n.label, dims.index(n.dim), n.part, *(n.fixed + [0, 0])[:2], n.low, n.high, widths[n.label], wants[n.label] - n.below) for n in open_nodes]
        asked = _joined(rows, told, "dim int, part int, fixed0 long, fixed1 long, low long, high long, width long, missing double").withColumn("_v", _value(dims))
        value = F.when(F.col("part") == 0, F.col("_v")).when(F.col("part") == 1, F.col("text_hash")).otherwise(F.col("row_hash"))
        inside = ((F.col("part") < 1) | (F.col("_v") == F.col("fixed0"))) & ((F.col("part") < 2) | (F.col("text_hash") == F.col("fixed1"))) & value.between(F.col("low"), F.col("high"))
        sums = asked.where(inside).select("node", "missing", "size", value.alias("_x"), "low", "width")
        sums = sums.withColumn("bin", F.expr("(_x - low) div width")).groupBy("node", "bin").agg(F.sum("size").alias("bytes"), F.first("missing").alias("missing"))
        run = F.coalesce(F.sum("bytes").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        last = F.max("bin").over(Window.partitionBy("node"))
        placed = sums.withColumn("run", run).withColumn("last", last).where((F.col("run") + F.col("bytes") >= F.col("missing")) | (F.col("bin") == F.col("last")))
        hits = {r["node"]: r["hit"] for r in placed.groupBy("node").agg(F.min(F.struct("bin", "run", "bytes")).alias("hit")).collect()}
        for n in open_nodes:
            b, before, size = hits[n.label]
            want, width = wants[n.label], widths[n.label]
            start = n.low + b * width
            n.below, n.low, n.high = n.below + before, start, min(n.high, start + width - 1)
            if n.low < n.high:
                continue
            short, over = want - n.below, n.below + size - want  # how far the cut is from here and from behind this value
            if n.part == 2 or min(short, over) <= slack * n.total:
                n.cut = (*n.fixed, n.low if over <= short else n.low - 1)
            else:
                n.fixed.append(n.low)
                n.part, n.low, n.high = n.part + 1, 0, (1 << HASH_BITS) - 1
        open_nodes = [n for n in open_nodes if n.cut is None]


def split(rows: DataFrame, shards: int, slack: float = 0.002) -> DataFrame:
    """``rows`` of ``sized`` with ``shard``, 0 to ``shards`` - 1. A level of the tree is a table of its cuts."""
    dims = [c for c in rows.columns if c.startswith("dim_")]
    top = rows.agg(*[F.max(d) - F.min(d) for d in dims]).first()
    whole = {d: v or 0 for d, v in zip(dims, top, strict=True)}
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    leaves = {0: shards}
    while any(n > 1 for n in leaves.values()):
        spread = _widest(rows, dims, whole)
        nodes = [Node(k, n, spread[k][0], total=float(spread[k][3]), low=spread[k][1], high=spread[k][2]) for k, n in leaves.items() if n > 1 and k in spread]
        _medians(rows, nodes, dims, slack)
        after = {k: 1 for k, n in leaves.items() if n == 1 or k not in spread}  # a node without rows needs no cut
        cuts = [(k, 0, LAST, LAST, LAST, k) for k in after]
        for n in nodes:
            left, right = n.label, n.label + n.leaves // 2
            after |= {left: n.leaves // 2, right: n.leaves - n.leaves // 2}
            cuts.append((n.label, dims.index(n.dim), *((n.cut or ()) + (LAST, LAST))[:3], right))
        placed = _joined(rows, cuts, "dim int, c0 long, c1 long, c2 long, right long").withColumn("_v", _value(dims))
        first, second, third = (F.col(a) < F.col(b) for a, b in (("_v", "c0"), ("text_hash", "c1"), ("row_hash", "c2")))
        before = first | ((F.col("_v") == F.col("c0")) & (second | ((F.col("text_hash") == F.col("c1")) & (third | (F.col("row_hash") == F.col("c2"))))))
        leaves = after
        rows = written(placed.withColumn("node", F.when(before, F.col("node")).otherwise(F.col("right"))).drop("dim", "c0", "c1", "c2", "right", "_v"), "nodes")
    return rows.withColumn("shard", F.col("node").cast("int"))


def shards_for(rows: DataFrame, target_bytes: int) -> int:
    """How many leaves of at most ``target_bytes``, on average, the rows need."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    return max(1, -(-int(total) // target_bytes))


def slots(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard. Rows are numbered in chunks of about SLOT_ROWS, as many as a shard's rows ask for; chunks start where those before them end."""
    counts = written(rows.groupBy(shard).agg(F.ceil(F.count(F.lit(1)) / SLOT_ROWS).cast("long").alias("chunks")), "shard-counts")
    dealt = rows.join(F.broadcast(counts) if counts.count() <= BROADCAST_NODES else counts, shard).withColumn("chunk", F.pmod(F.col("row_hash"), F.col("chunks")).cast("int")).drop("chunks")
    starts = dealt.groupBy(shard, "chunk").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy(shard).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(shard, "chunk").orderBy("row_hash", "key")))
    return numbered.join(starts, [shard, "chunk"]).withColumn("slot", (F.col("start") + F.col("rank") - 1).cast("long")).drop("start", "rank", "chunk")


def kd_shards(df: DataFrame, key: str, text: str, dims: dict[str, Column], shards: int | None = None, target_bytes: int | None = None, slack: float = 0.002) -> DataFrame:
    """(key, size, text_crc32, shard, slot): ``shards`` leaves, or as many as ``target_bytes`` asks for."""
    rows = sized(df, key, text, dims)
    out = slots(split(rows, shards or shards_for(rows, target_bytes or 1 << 30), slack))
    return out.select("key", "size", "text_crc32", "shard", "slot")
