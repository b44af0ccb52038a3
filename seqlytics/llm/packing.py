"""Best-fit packing by a grouping genetic algorithm on islands.

``token_pieces`` turns documents into pieces of at most ``capacity`` tokens. ``pack`` deals the pieces out to islands of about
``ISLAND`` pieces. Each island keeps a small population of packings; crossover injects whole well-filled bins of one parent into
the other, removes the bins that hold the same pieces again, and puts the displaced pieces back by best fit; mutation empties the
worst bins. After a round the island's elite, the bins filled to the round's mark, is kept as it is; the pieces of all other bins
migrate and are dealt out to fewer islands, until one island holds what is left.

Defined results: a null text is an empty one, a piece with the end token only; strings of added tokens in a text are these tokens; repeated rows, null
keys and equal lengths are packed each; pieces of a length over the capacity raise ValueError; an empty table gives an empty table. Other columns of the
input are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, bounded_batches, each, mix64, pick, written

CAPACITY = 2048
ISLAND = 4096
POPULATION, GENERATIONS = 4, 6
#: Bins filled to this share stay, in the first rounds; in the last all stay.
ELITE = 0.999
ROUNDS = 3
#: Fixed value: the pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones stand for themselves, the others take the code points from 256 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


def load_encoder(definition: bytes):
    """The encoder of a byte-level BPE tokenizer file (JSON). Added tokens are found in texts, as the library that the files are for does by default."""
    import tiktoken

    whole = json.loads(definition)
    symbols = byte_of_symbol()
    added = {t["content"]: t["id"] for t in whole["added_tokens"]}
    merges = {bytes(symbols[c] for c in token): i for token, i in whole["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=merges, special_tokens=added)


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all full but the first."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, deal), written. The ids are the tokens of the text, then ``end``."""
    spark = df.sparkSession
    bounded_batches(spark)
    with open(vocabulary or vocabulary_path(), "rb") as f:
        definition = spark.sparkContext.broadcast(f.read())  # a few MB: it is a tokenizer's file
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("deal", pa.int64())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(definition.value)
        at = TaskContext.get().partitionId() << 40
        for keys, texts in each(batches, key, text):
            rows: list[tuple] = []
            for doc, t in zip(keys.to_pylist(), texts.to_pylist(), strict=True):
                ids = np.array([*encoder.encode(t or "", allowed_special="all"), end], "<u4")
                rows += [(doc, i, start, n, zlib.crc32(ids[start : start + n].tobytes())) for i, (start, n) in enumerate(cut_points(len(ids), capacity))]
            deal = mix64(np.arange(at, at + len(rows), dtype=np.uint64)) >> np.uint64(1)
            at += len(rows)
            yield batch(schema, **{n: [r[i] for r in rows] for i, n in enumerate(schema.names[:-1])}, deal=deal.astype(np.int64))

    return written(pick(df, key, text).mapInArrow(pieces, PIECES), "pieces")


class Bins:
    """Bins as lists of pieces, found by their free space: one bit of ``mask`` for each amount that some bin has free."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def _offer(self, b: int) -> None:
        f = self.free[b]
        self.by_free[f].append(b)
        self.mask |= 1 << f

    def add(self, items: list[int], free: int) -> None:
        self.bins.append(items)
        self.free.append(free)
        self._offer(len(self.bins) - 1)

    def best_fit(self, items: list[int]) -> None:
        """Puts the items, largest first, where the least space is left."""
        sizes = self.sizes
        for i in sorted(items, key=sizes.__getitem__, reverse=True):
            s = sizes[i]
            if room := self.mask >> s:
                f = s + (room & -room).bit_length() - 1
                b = self.by_free[f].pop()
                if not self.by_free[f]:
                    self.mask &= ~(1 << f)
                self.bins[b].append(i)
                self.free[b] = f - s
                self._offer(b)
            else:
                self.add([i], self.capacity - s)

    def fitness(self) -> tuple[int, float]:
        """Fewer bins, then fuller ones."""
        c = self.capacity
        return -len(self.bins), sum((c - f) ** 2 for f in self.free)


def crossover(a: Bins, b: Bins, share: float, rng: np.random.Generator) -> Bins:
    """A child of ``b`` with the well-filled bins of ``a`` that a random draw picks."""
    sizes, capacity = a.sizes, a.capacity
    filled = sorted(range(len(a.bins)), key=a.free.__getitem__)[: max(1, int(len(a.bins) * share))]
    chosen = [x for x, keep in zip(filled, rng.random(len(filled)) < 0.7, strict=True) if keep]
    child, inside, displaced = Bins(sizes, capacity), bytearray(len(sizes)), []
    for x in chosen:
        child.add(list(a.bins[x]), a.free[x])
        for i in a.bins[x]:
            inside[i] = 1
    worst = set(sorted(range(len(b.bins)), key=b.free.__getitem__)[-max(1, len(b.bins) // 50) :])  # the mutation
    for x, items in enumerate(b.bins):
        if x in worst or any(inside[i] for i in items):
            displaced += [i for i in items if not inside[i]]
        else:
            child.add(list(items), b.free[x])
    child.best_fit(displaced)
    return child


def evolve(lengths: np.ndarray, capacity: int = CAPACITY, population: int = POPULATION, generations: int = GENERATIONS, seed: int = 1) -> list[list[int]]:
    """The best packing that an island finds; every list holds positions in ``lengths``. Stops early at the least possible number of bins."""
    sizes = [int(x) for x in lengths]
    if sizes and max(sizes) > capacity:
        raise ValueError("a piece is longer than the capacity")
    least = -(-sum(sizes) // capacity)
    rng = np.random.default_rng(seed)
    folk: list[Bins] = []
    for k in range(population):
        one = Bins(sizes, capacity)
        if k:  # a few random pieces open bins first
            some = rng.choice(len(sizes), max(1, len(sizes) // 8), replace=False).tolist()
            one.best_fit(some)
            rest = np.ones(len(sizes), bool)
            rest[some] = False
            one.best_fit(np.flatnonzero(rest).tolist())
        else:
            one.best_fit(list(range(len(sizes))))
        folk.append(one)
        if len(one.bins) <= least:
            return one.bins
    for _ in range(generations):
        folk.sort(key=Bins.fitness, reverse=True)
        child = crossover(folk[0], folk[1 + int(rng.integers(len(folk) - 1))], 0.5, rng)
        other = crossover(folk[int(rng.integers(1, len(folk)))], folk[0], 0.3, rng)
        folk[-2:] = [child, other]
        if min(len(child.bins), len(other.bins)) <= least:
            break
    return max(folk, key=Bins.fitness).bins


def settler(r: int, mark: int, capacity: int) -> Callable[[pa.Table], pa.Table]:
    """What an island does in round ``r``: bins with at most ``mark`` tokens free get their numbers, other pieces -1."""

    def settle(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("deal", "ascending")])
        lengths, where = rows["length"].to_numpy(), rows["island"][0].as_py()
        sequence, offset = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        for k, items in enumerate(evolve(lengths, capacity, seed=where + 1)):
            sizes = lengths[items]
            if capacity - int(sizes.sum()) <= mark:
                sequence[items] = (r << 60) | (where << 24) | k
                offset[items] = np.cumsum(sizes) - sizes
        return rows.drop_columns("island").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return settle


def pack(pieces: DataFrame, capacity: int = CAPACITY, island: int = ISLAND, rounds: int = ROUNDS, elite: float = ELITE) -> DataFrame:
    """``pieces`` (with length and deal) with sequence_id and offset. The number of rounds is fixed; each but the last leaves a small share over."""
    columns = [c for c in pieces.columns if c != "deal"]
    left, out = pieces, []
    for r in range(rounds):
        n = left.count()
        islands = max(1, -(-n // island))
        last = islands == 1 or r == rounds - 1
        mark = capacity if last else int(capacity * (1 - elite))

        dealt = left.withColumn("island", F.pmod(F.xxhash64("deal", F.lit(r)), F.lit(islands)))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema) + ", sequence_id long, offset long"
        settled = written(dealt.groupBy("island").applyInArrow(settler(r, mark, capacity), schema), f"islands-{r}")
        out.append(settled.where("sequence_id >= 0").select(*columns, "sequence_id", "offset"))
        if last:
            break
        left = settled.where("sequence_id < 0").drop("sequence_id", "offset")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document."""
    return pack(token_pieces(df, key, text, capacity, vocabulary=vocabulary), capacity)
