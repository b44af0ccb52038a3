"""N-gram Jaccard join: a size-aware heavy-light self-join of shingle sets.

Two documents link when their sets' Jaccard similarity is at least ``percent`` / 100, exactly. Light sets (at most ``b`` shingles)
enumerate all their subsets of each size that a link with a partner of some size needs in common: light sets that link share such a subset.
Heavy sets, and the light ones that could link with a heavy one, are posted to the inverted lists of their first
n - ceil(n * percent / 100) + 1 shingles in one global order, frequent shingles last: sets that link share one of these. ``b`` is where the
estimated cost, subsets enumerated plus list entries scanned, is least.

A list is first scanned against one leader for each size class, the set with the most shingles in common lists, which settles groups of
copies with as many pairs as members; then a member drawn by hash meets one member of each other component in its list. Lists that hold more
components than one are then joined with themselves, without pairs of one component, and
without pairs whose parity sketches alone prove them too different: 512 bits (and, for larger sets, a bit for each shingle), each the parity of the shingles that hash to it, differ in at
most as many places as the sets. Candidates that are left are compared set by set. No limit is set on lists or partners.

Comparisons are spared only between documents that other links connect already, so the components come out whole. The number of all links of a document is counted
inside the components, where all links lie: equal sets become one representative with its number of documents, and the representatives of a component are
compared block by block, by products of incidence matrices; no pair leaves a block.

Scratch tables with postings, lists, sketches, sets or pairs are deleted as soon as the last step that reads them is written; those that the result reads stay.

Defined results: texts without words, null ones too, have empty sets and no links; shorter texts than a shingle have one shingle, all their words;
rows with the same key are one document that links where any of its texts does, and has the links of each of its different texts; null keys are left out of links and
are their own component; an empty table gives an empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batch, bounded_batches, discard, each, mix64, most_frequent, written

#: Shingles whose order the whole join knows: the most frequent ones.
RANKED = 200_000
#: A task counts shingles of about so many words at a time.
COUNTED = 1_000_000
#: Sizes whose costs are looked at for the boundary between light and heavy; at 64 a set has 10**10 subsets and more.
MOST_LIGHT = 64
SKETCH = 8
#: Words of the second sketch, that sets of more than SMALL shingles have in lists.
MIDDLE = 32
SMALL = 96
#: Ids of documents in candidate pairs, 8 MB of them at most, that may be broadcast.
BROADCAST_IDS = 1_000_000
#: Sets, and their shingles, in a block of representatives that are compared; distinct shingles that are columns of one product.
LINK_SETS, LINK_SHINGLES, LINK_COLUMNS = 128, 1 << 17, 4096

ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93]


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """The distinct shingles of ``n`` words, as sorted 64-bit hashes. Upper case A to Z counts as lower case; words end at ASCII blanks."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(ODD[7]) + mix64(hashed[i : len(words) - k + 1 + i] + np.uint64(ODD[i % 7]))
    return np.unique(mix64(out))


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits, as two signed numbers, that tell sets apart."""
    import xxhash

    high, low = divmod(xxhash.xxh3_128_intdigest(shingles.tobytes()), 1 << 64)
    return high - (1 << 63), low - (1 << 63)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def needed(n: int, m: int, percent: int) -> int:
    """How many shingles sets of ``n`` and ``m`` have in common at least, if they link."""
    return -(-percent * (n + m) // (100 + percent))


def subset_sizes(n: int, percent: int) -> list[int]:
    """Sizes of the common subsets that a set of ``n`` needs for partners of any size."""
    return sorted({c for m in range(-(-n * percent // 100), n * 100 // percent + 1) if (c := needed(n, m, percent)) <= min(n, m)})


def subset_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """A hash of each subset of the sizes that a light set enumerates."""
    out = []
    n = len(shingles)
    mixed = mix64(shingles + np.uint64(ODD[1]))
    total = mixed.sum(dtype=np.uint64)
    for c in subset_sizes(n, percent):
        left_out = np.array(list(combinations(range(n), n - c)), np.int64)
        sums = total - mixed[left_out].sum(axis=1, dtype=np.uint64) if n > c else np.array([total], np.uint64)
        out.append(mix64(sums * np.uint64(ODD[2]) + np.uint64(c)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def ordered(shingles: np.ndarray, ranked: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The set in the global order: unranked shingles by hash, then the ranked ones from rare to frequent."""
    if not len(ranked) or not len(shingles):
        return shingles
    at = np.minimum(np.searchsorted(ranked, shingles), len(ranked) - 1)
    known = ranked[at] == shingles
    if not known.any():
        return shingles
    frequent = shingles[known]
    return np.concatenate([shingles[~known], frequent[np.argsort(ranks[at[known]], kind="stable")]])


def sketch(shingles: np.ndarray, bits: int = 64 * SKETCH) -> np.ndarray:
    """Parities of the shingles by hash, as 64-bit words. ``bits`` is a power of two; the halves of a longer sketch, exclusive-or'ed, are the shorter one."""
    at = (mix64(shingles ^ np.uint64(ODD[3])) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def middle_sketch(shingles: np.ndarray) -> np.ndarray:
    """MIDDLE words for sets of more than SMALL shingles, else empty."""
    return sketch(shingles, 64 * MIDDLE) if len(shingles) > SMALL else np.zeros(0, np.int64)


def long_sketch(shingles: np.ndarray) -> np.ndarray:
    """A sketch of four bits and more for each shingle; empty for sets of SMALL shingles or fewer."""
    return sketch(shingles, 4 << (len(shingles) - 1).bit_length()) if len(shingles) > SMALL else np.zeros(0, np.int64)


def frequent_shingles(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, dict[int, int], float]:
    """The most frequent shingles and their ranks, how many sets there are of each size up to twice MOST_LIGHT (all others under 0), and
    how many entries a list has on average where a shingle of it is looked up. All documents are counted; a task passes on what it saw twice among COUNTED."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sizes = np.zeros(2 * MOST_LIGHT + 1, np.int64)
        total = squares = 0

        def counted() -> pa.RecordBatch:
            nonlocal held, squares
            found, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            squares += int((counts.astype(np.int64) ** 2).sum())
            often = counts >= 2
            held = []
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(counts[often].astype(np.int64)), pa.array(np.full(int(often.sum()), -1, np.int64))], names=["token", "n", "size"])

        waiting = 0
        for (texts,) in each(batches, "text"):
            for t in as_bytes(texts):
                s = shingle_set(t, n)
                sizes[len(s) if len(s) < len(sizes) else 0] += 1 if len(s) else 0
                held.append(s)
                total += len(s)
                waiting += len(s)
                if waiting > COUNTED:
                    yield counted()
                    waiting = 0
        yield counted()
        rows = [(0, int(c), i) for i, c in enumerate(sizes.tolist()) if c] + [(1, total, 1000), (1, squares, 1001)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["token", "n", "size"])

    found = written(rows.select("text").mapInArrow(count, "token long, n long, size long"), "shingle-counts")
    stats = {r["size"]: r["n"] for r in found.where("size >= 0").groupBy("size").agg(F.sum("n").alias("n")).collect()}
    frequent = written(found.where("size < 0").groupBy("token").agg(F.sum("n").alias("n")), "frequent")
    top = most_frequent(frequent, "n", RANKED).orderBy("n", "token").collect()
    discard(found, frequent)
    tokens = np.array([r["token"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    scanned = stats.pop(1001, 0) / max(1, stats.pop(1000, 0))
    return tokens[order], order, stats, max(1.0, scanned)  # rows came from rare to frequent, so a place is a rank


def light_bound(sizes: dict[int, int], percent: int, scanned: float) -> int:
    """The largest light size: where subsets enumerated and list entries scanned (``scanned`` for each posting) cost least together."""
    limit = 2 * MOST_LIGHT

    def cost(b: int) -> float:
        light = sum(sizes.get(n, 0) * sum(comb(n, c) for c in subset_sizes(n, percent)) for n in range(1, b + 1))
        first = -(-(b + 1) * percent // 100)
        return light + sum(sizes.get(n, 0) * prefix_length(n, percent) * (1 + scanned) for n in range(first, limit + 1))

    return min(range(MOST_LIGHT + 1), key=cost)


def postings(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc, n, d1, d2, tokens, sk, mid_sk, long_sk) for every row: the size and digest of its set, its subset keys and inverted lists, its sketches."""
    ranked, ranks, sizes, scanned = frequent_shingles(rows, n)
    b = light_bound(sizes, percent, scanned)
    known = rows.sparkSession.sparkContext.broadcast((ranked, ranks))  # RANKED entries at most
    first = -(-(b + 1) * percent // 100)
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("tokens", pa.list_(pa.int64())), ("sk", pa.list_(pa.int64())), ("mid_sk", pa.list_(pa.int64())), ("long_sk", pa.list_(pa.int64()))])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked, ranks = known.value
        for keys, texts in each(batches, "doc", "text"):
            docs, counts, digests, tokens, sketches, middle, longer = [], [], [], [], [], [], []
            for doc, t in zip(keys.to_pylist(), as_bytes(texts), strict=True):
                s = shingle_set(t, n)
                own = []
                if 0 < len(s) <= b:
                    own.append(subset_keys(s, percent))
                if len(s) and len(s) >= first:
                    own.append(ordered(s, ranked, ranks)[: prefix_length(len(s), percent)])
                docs.append(doc)
                counts.append(len(s))
                digests.append(set_digest(s))
                tokens.append(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64))
                sketches.append(sketch(s))
                middle.append(middle_sketch(s))
                longer.append(long_sketch(s))
            yield batch(schema, doc=docs, n=counts, d1=[d[0] for d in digests], d2=[d[1] for d in digests], tokens=tokens, sk=sketches, mid_sk=middle, long_sk=longer)

    return rows.mapInArrow(post, "doc long, n int, d1 long, d2 long, tokens array<long>, sk array<long>, mid_sk array<long>, long_sk array<long>")


def star(e: DataFrame, large: bool) -> DataFrame:
    """Of edges (u, v), u > v: every node's neighbours (larger ones, or smaller ones and itself) are joined to the least of its neighbours and itself."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    near = both.join(least, "u")
    if large:
        out = near.where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def are_stars(edges: DataFrame) -> bool:
    """Whether every u of the distinct edges (u, v) has one edge and is no v: then each component is a star around its smallest node."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("as_u")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("as_u")))
    counts = ends.groupBy("x").agg(F.sum("as_u").alias("n"), F.min("as_u").alias("least"))
    return counts.where("n > 1 OR (n = 1 AND least = 0)").count() == 0


def stars(links: DataFrame) -> DataFrame:
    """(a, b), written: the smallest doc of each component of the links (a, b) with every other one there. Large-star and small-star rounds."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not are_stars(edges):
        last, edges = edges, written(star(star(edges, True), False), "edges")
        discard(last)
    return edges.select(F.col("v").alias("a"), F.col("u").alias("b"))


def memberships(tied: DataFrame) -> DataFrame:
    """(doc, component) of stars."""
    return tied.select(F.col("b").alias("doc"), F.col("a").alias("component")).unionByName(tied.select(F.col("a").alias("doc"), F.col("a").alias("component")).distinct())


def components(links: DataFrame) -> DataFrame:
    """(doc, component): the smallest doc that the links (a, b) reach, for every doc in a link."""
    return memberships(stars(links))


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    left = sets.select(F.col("doc").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("doc").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def may_link(x: str, y: str, percent: int) -> Column:
    """Whether sizes, short and middle sketches of two sides allow a link. Never false for documents that do link.

    The short sketch is compared word by word in generated code; the middle one, longer than a method may be, by a loop over what is left.
    """
    apart = sum((F.bit_count(F.col(f"{x}.sk")[i].bitwiseXOR(F.col(f"{y}.sk")[i])) for i in range(SKETCH)), F.lit(0))
    most = (100 - percent) * (F.col(f"{x}.n") + F.col(f"{y}.n"))
    near = 100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n")
    both_large = (F.size(f"{x}.mid_sk") > 0) & (F.size(f"{y}.mid_sk") > 0)
    further = F.when(both_large, (100 + percent) * places_apart(F.col(f"{x}.mid_sk"), F.col(f"{y}.mid_sk")) <= most).otherwise(True)
    return near & ((100 + percent) * apart <= most) & further


def places_apart(a: Column, b: Column) -> Column:
    """In how many places two sketches of one length differ."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, k: t + k)


def apart_in_long(a: Column, b: Column) -> Column:
    """In how many places two long sketches differ, the longer one folded to the other's length; 0 if one is empty. Sets that may link have lengths that differ by one doubling at most."""
    n = F.least(F.size(a), F.size(b))

    def folded(x: Column) -> Column:
        return F.when(F.size(x) == n, x).otherwise(F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q)))

    return places_apart(folded(a), folded(b))


def still_possible(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), written, whose sizes and sketches, long ones too, allow a link. Long sketches only move for pairs that the others leave.

    A leader may be in a third of all pairs: the joins are followed by writes, not by sums, so that Spark can split its partition.
    """
    short = marks.drop("long_sk")
    x, y = short.alias("x"), short.alias("y")
    left = written(pairs.join(x, F.col("a") == F.col("x.doc")).join(y, (F.col("b") == F.col("y.doc")) & may_link("x", "y", percent)).select("a", "b"), "near-pairs")
    long = marks.select("doc", "n", "long_sk")
    x, y = long.alias("x"), long.alias("y")
    both = left.distinct().join(x, F.col("a") == F.col("x.doc")).join(y, F.col("b") == F.col("y.doc"))
    long_ones = (F.size("x.long_sk") > 0) & (F.size("y.long_sk") > 0)
    too_far = (100 + percent) * apart_in_long(F.col("x.long_sk"), F.col("y.long_sk")) > (100 - percent) * (F.col("x.n") + F.col("y.n"))
    out = written(both.where(~F.when(long_ones, too_far).otherwise(False)).select("a", "b"), "pairs")
    discard(left)
    return out


def leader_pairs(shared: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """(a, b), written: the leader of each list and size class with every other member. The leader is the set most of whose postings are in shared lists."""
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    worth = shared.groupBy("doc").agg(F.count(F.lit(1)).alias("in_lists")).join(marks.select("doc", "n"), "doc")
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100))).cast("int")
    worth = worth.select("doc", F.least(F.lit(1000), (1000 * F.col("in_lists") / prefix).cast("int")).alias("worth"), size_class.alias("class"))
    entry = shared.join(worth, "doc")
    leaders = entry.groupBy("token", "class").agg(F.max_by("doc", F.struct("worth", -F.col("doc"))).alias("leader"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    leaders = written(leaders, "leaders")  # so that the join has a shuffle of its own, whose hot lists can be split
    pairs = written(entry.join(leaders, ["token", "class"]).where("doc <> leader").select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct(), "all-pairs")
    discard(leaders)
    return pairs


def grouped(shared: DataFrame, tied: DataFrame, least: int) -> DataFrame:
    """(token, doc, group), written: the lists of at least ``least`` documents that still hold more than one component, given as stars."""
    found = memberships(tied).withColumnRenamed("component", "group")
    side = written(shared.join(found, "doc", "left").withColumn("group", F.coalesce("group", "doc")), "grouped")
    open_lists = side.groupBy("token").agg(F.min("group").alias("g"), F.max("group").alias("h"), F.count(F.lit(1)).alias("k")).where((F.col("k") >= least) & (F.col("g") != F.col("h"))).select("token")
    open_lists = written(open_lists, "open-lists")
    out = written(side.join(open_lists, "token"), "open")
    discard(side, open_lists)
    return out


def drawn_pairs(side: DataFrame) -> DataFrame:
    """(a, b), written: a member of each list that a hash draws, with one member of each other group there. A group that is spread over many lists meets many of another's members."""
    drawn = side.groupBy("token").agg(F.max_by(F.struct("doc", "group"), F.xxhash64("doc", "token")).alias("one"))
    others = side.groupBy("token", "group").agg(F.max_by("doc", F.xxhash64("token", "doc")).alias("doc"))
    pairs = others.join(drawn, "token").where(F.col("group") != F.col("one.group"))
    return written(pairs.select(F.least("doc", "one.doc").alias("a"), F.greatest("doc", "one.doc").alias("b")).distinct(), "all-pairs")


def remaining_pairs(side: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """(a, b), written, of one list that are in different groups and may link."""
    side = written(side.join(marks.drop("long_sk"), "doc"), "sides")
    x, y = side.alias("x"), side.alias("y")
    may = (F.col("x.token") == F.col("y.token")) & (F.col("x.doc") < F.col("y.doc")) & (F.col("x.group") != F.col("y.group")) & may_link("x", "y", percent)
    pairs = written(x.join(y, may).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct(), "all-pairs")
    discard(side)
    return pairs


def checked(pairs: DataFrame, marks: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the written pairs that link, by their whole sets; the pairs are discarded. Only documents that are in a pair have their sets built.

    Their ids are broadcast if they are at most BROADCAST_IDS; beyond that texts are dealt out by id to meet them.
    """
    near = still_possible(pairs, marks, percent)
    discard(pairs)
    wanted = written(near.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    sets = written(shingle_sets(rows.join(F.broadcast(wanted) if few else wanted, "doc", "left_semi"), n).distinct(), "sets")
    links = written(similar(near.distinct(), sets, percent), "links")
    discard(near, wanted, sets)
    return links


def keyed_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))


def link_documents(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """((doc, n, d1, d2) for every row, ties (a, b)): the ties' components are those of all links. What earlier steps connect is tied to the component's smallest doc, linked with it or not."""
    bounded_batches(df.sparkSession, 4)
    rows = keyed_texts(df, key, text)
    posted = written(postings(rows, n, percent), "posted")
    entries = posted.where("doc IS NOT NULL").select(F.explode("tokens").alias("token"), "doc")
    lists = written(entries.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token"), "list-tokens")
    shared = written(entries.join(lists, "token"), "lists")  # a key of several rows may be in a list twice
    known = posted.where("doc IS NOT NULL").select("doc", "n", "sk", "mid_sk", "long_sk")
    marks = written(known.join(shared.select("doc").distinct(), "doc", "left_semi").distinct(), "marks")
    sizes = written(posted.select("doc", "n", "d1", "d2"), "sizes")
    discard(posted, lists)

    links = checked(leader_pairs(shared, marks, percent), marks, rows, n, percent)
    led = stars(links)
    side = grouped(shared, led, 2)
    discard(links, shared)
    links = checked(drawn_pairs(side), marks, rows, n, percent)
    tied = stars(led.unionByName(links))
    still_open = grouped(side.select("token", "doc"), tied, 3)  # of two documents that a list holds, one was drawn and met the other
    discard(links, side)
    links = checked(remaining_pairs(still_open, marks, percent), marks, rows, n, percent)
    discard(marks, still_open)
    return sizes, tied.unionByName(links)


def shingle_sets(rows: DataFrame, n: int) -> DataFrame:
    """(doc, s) of (doc, text), s the whole set."""
    schema = pa.schema([("doc", pa.int64()), ("s", pa.list_(pa.int64()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in each(batches, "doc", "text"):
            yield batch(schema, doc=keys, s=[shingle_set(t, n).view(np.int64) for t in as_bytes(texts)])

    return rows.mapInArrow(build, "doc long, s array<long>")


def common_counts(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """(sets, others): sizes of the intersections, by products of incidence matrices of LINK_COLUMNS shingles each."""
    out = np.zeros((len(sets), len(others)), np.int64)
    whole = np.concatenate([*sets, *others])
    owner = np.repeat(np.arange(len(sets) + len(others)), [len(s) for s in (*sets, *others)])
    found, column, times = np.unique(whole, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # a shingle of one set alone is in no intersection
    inside = times[column] > 1
    column, owner = number[column[inside]], owner[inside]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, LINK_COLUMNS):
        a, b = np.searchsorted(column, (start, start + LINK_COLUMNS))
        matrix = np.zeros((len(sets) + len(others), LINK_COLUMNS), np.float32)
        matrix[owner[a:b], column[a:b] - start] = 1
        out += np.rint(matrix[: len(sets)] @ matrix[len(sets) :].T).astype(np.int64)  # at most LINK_COLUMNS, so exact
    return out


def link_counts(found: DataFrame, sizes: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc, n_links): how many other documents each document of (doc, component) links with.

    Sets of a component are cut into blocks by hash; every pair of blocks is one group, of bounded size, whatever the size of the component.
    """
    key = ["component", "d1", "d2"]
    members = written(found.join(sizes.where("n > 0"), "doc").select("doc", "n", *key).distinct(), "members")
    different = members.groupBy(*key).agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
    whole = different.groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("shingles")).where("k > 1")
    blocks = F.greatest(F.ceil(F.col("k") / LINK_SETS), F.ceil(F.col("shingles") / LINK_SHINGLES)).cast("int")
    several = written(different.join(whole.select("component", blocks.alias("blocks")), "component"), "representatives")
    wanted = several.select(F.col("rep").alias("doc")).distinct()
    sets = shingle_sets(rows.join(F.broadcast(wanted) if several.count() <= BROADCAST_IDS else wanted, "doc", "left_semi"), n)
    schema = pa.schema([("doc", pa.int64()), ("s", pa.list_(pa.int64())), ("d1", pa.int64()), ("d2", pa.int64())])

    def with_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, lists in each(batches, "doc", "s"):
            digests = [set_digest(np.array(x, np.int64)) for x in lists]
            yield batch(schema, doc=docs, s=lists, d1=[d[0] for d in digests], d2=[d[1] for d in digests])

    def counted(group: pa.Table) -> pa.Table:
        own, two = group["own"].to_numpy(), group["i"][0] != group["j"][0]  # a block of the two may be empty
        sets = [np.asarray(x.values) for x in group["s"].combine_chunks()]
        size, times = np.array([len(s) for s in sets], np.int64), group["m"].to_numpy()
        a, b = (np.flatnonzero(own == 0), np.flatnonzero(own == 1)) if two else (np.arange(len(own)), np.arange(len(own)))
        common = common_counts([sets[i] for i in a], [sets[i] for i in b])
        linked = 100 * common >= percent * (size[a][:, None] + size[b][None] - common)
        out = np.zeros(len(own), np.int64)
        if two:
            out[a], out[b] = linked @ times[b], times[a] @ linked
        else:
            np.fill_diagonal(linked, False)
            out = linked @ times
        return pa.table({"component": group["component"], "d1": group["d1"], "d2": group["d2"], "linked": pa.array(out, pa.int64())})

    sets = written(sets.mapInArrow(with_digests, "doc long, s array<long>, d1 long, d2 long").distinct(), "representative-sets")
    placed = several.join(sets.withColumnRenamed("doc", "rep"), ["rep", "d1", "d2"]).withColumn("block", F.pmod(F.xxhash64("d1", "d2"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*key, "m", "s", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("own"))
    linked = dealt.groupBy("component", "i", "j").applyInArrow(counted, "component long, d1 long, d2 long, linked long").groupBy(*key).agg(F.sum("linked").alias("linked"))
    # Written, so that the join with all members has a shuffle of its own, in which a set of many copies can be split.
    of_set = written(different.join(linked, key, "left").select(*key, (F.coalesce("linked", F.lit(0)) + F.col("m") - 1).alias("own")), "set-links")
    discard(several, sets)
    return members.join(of_set, key).groupBy("doc").agg(F.sum("own").cast("long").alias("n_links"))


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """(doc, n_shingles, component_id, n_links) for every row of ``df``; n_links is the number of all other documents that it links with."""
    sizes, links = link_documents(df, key, text, n, percent)
    found = components(links)
    counts = link_counts(found, sizes, keyed_texts(df, key, text), n, percent)
    out = sizes.join(found.join(counts, "doc", "left"), "doc", "left")
    return out.select("doc", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
