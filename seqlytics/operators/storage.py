"""Bytes that compact representations of the columns would take: plain arithmetic."""

from __future__ import annotations

#: Bits in a block of each directory level.
LEVEL_BITS = (512, 8192, 65536, 524288, 4194304, 33554432, 268435456, 2147483648)
#: Bits of a text symbol, the alphabet with both marks, and the largest bit vector.
SYMBOL_BITS, ALPHABET, MOST_BITS = 9, 258, 8_589_934_592
QUAD_LEVELS = 4
#: Bytes that a view's parts are aligned to, of a level's routes, and positions that a sample and a word of samples stand for.
VIEW_ALIGNMENT, ROUTE_BYTES, SAMPLED, SAMPLED_BY_WORD = 64, 32, 1024, 2048


def ceil_div(x: int, y: int) -> int:
    return -(-x // y) if x > 0 else 0


def bit_depth(bits: int) -> int:
    """Directory levels of a bit vector: how many of the block sizes it is longer than; -1 beyond the largest."""
    if not 0 <= bits <= MOST_BITS:
        return -1
    return sum(bits > size for size in LEVEL_BITS)


def bit_vector_bytes(bits: int) -> int:
    """Payload in whole groups of eight words, and 32 bytes for each node of sixteen or eight children at every level used."""
    depth = bit_depth(bits)
    if depth < 0:
        raise ValueError("the bit vector is too long")
    nodes = ceil_div(ceil_div(bits, LEVEL_BITS[0]), 16) if depth >= 1 else 0
    nodes += sum(ceil_div(ceil_div(bits, LEVEL_BITS[k - 1]), 8) for k in range(2, min(depth, 7) + 1)) + (depth == 8)
    return 8 * ceil_div(ceil_div(bits, 64), 8) * 8 + 32 * nodes


def packed_words(n: int, width: int) -> int:
    return n // 64 * width + ceil_div(n % 64 * width, 64)


def quad_bytes(counts: tuple[int, int, int, int]) -> dict[str, int]:
    """Payload, rank and select bytes of a four-symbol column with these symbol counts."""
    n = sum(counts)
    out = {"raw": ceil_div(n, 32) * 8, "rank": 64 * ceil_div(n, 4096), "select": 4 * sum(ceil_div(c, 1024) for c in counts)}
    return out | {"auxiliary": out["rank"] + out["select"], "allocated": sum(out.values())}


def bits_of(largest: int) -> int:
    """Bits of a packed width: 0 for 0."""
    return int(largest).bit_length()


def packed_bytes(n: int, largest: int) -> int:
    return 8 * packed_words(n, bits_of(largest))


def align_up(x: int, a: int) -> int:
    return ceil_div(x, a) * a


def bit_view_bytes(bits: int) -> int:
    """What a bit vector in one outside region takes: as much as one of its own."""
    return bit_vector_bytes(bits)


def quad_view_bytes(n: int) -> int:
    """A four-symbol column in one outside region: payload, aligned, rank, and as many samples as symbols can need."""
    if n < 0:
        raise ValueError("a length is not negative")
    samples = max((s + (n - s) // SAMPLED_BY_WORD for s in range(1, min(4, n) + 1)), default=0)
    return align_up(ceil_div(n, 32) * 8, VIEW_ALIGNMENT) + 64 * ceil_div(n, 4096) + 8 * samples


def quad_wavelet_view_bytes(n: int, width: int) -> int:
    """A table of base-4 levels in one outside region: the routes, then the levels, each aligned."""
    if not 0 <= width <= 64:
        raise ValueError("a width is 0 to 64 bits")
    at = align_up(ceil_div(width, 2) * ROUTE_BYTES, VIEW_ALIGNMENT)
    for _ in range(ceil_div(width, 2)):
        at = align_up(at, VIEW_ALIGNMENT) + quad_view_bytes(n)
    return at


def levels_bytes(level_counts: list[tuple[int, int, int, int]]) -> dict[str, int]:
    """Payload, auxiliary and allocated bytes of four-symbol levels with these symbol counts."""
    each = [quad_bytes(c) for c in level_counts]
    return {k: sum(x[k] for x in each) for k in ("raw", "auxiliary", "allocated")}


def hybrid_actual_bytes(n: int, level_counts: list[tuple[int, int, int, int]]) -> int:
    """The 9-bit table: a bit vector without rank tables of its own, four-symbol levels, counts."""
    return bit_vector_bytes(n) + levels_bytes(level_counts)["allocated"] + 8 + QUAD_LEVELS * 32


def trie_bytes(stats: dict[str, int], parent_words: int, strings: int) -> dict[str, int]:
    """Bytes of a trie's parts, from its counts: nodes, edges, terminals, inner, high (nodes of HIGH_DEGREE children and more), most_children, suffix_bytes, suffix_edges."""
    n, edges, terminals, inner = stats["nodes"], stats["edges"], stats["terminals"], stats["inner"]
    blocks, sparse = ceil_div(n, 256), stats["suffix_edges"] * 4 <= n
    offsets = (stats["suffix_edges"] if sparse else n) + 1
    out = {
        "topology": blocks + 4 * (blocks + 1) + 8 * parent_words,
        "edge_first": n,
        "edge_suffix": stats["suffix_bytes"],
        "edge_boundary": (bit_vector_bytes(n) if sparse else 0) + packed_bytes(offsets, stats["suffix_bytes"]),
        "terminal_bits": bit_vector_bytes(n),
        "terminal_ids": packed_bytes(terminals, strings),
        "id_to_terminal": packed_bytes(strings, max(0, n - 1)),
        "child_navigation": bit_vector_bytes(n) + packed_bytes(inner, edges) + packed_bytes(inner, stats["most_children"]) + packed_bytes(edges, max(0, n - 1)) + packed_bytes(inner, stats["high"]) + 32 * stats["high"],
        "terminal_range": 2 * packed_bytes(inner, terminals),
    }
    return out | {"total": sum(out.values())}


def dictionary_bytes(trie_total: int, strings: int, symbols: int, runs: int, level_counts: list[tuple[int, int, int, int]] | None = None) -> dict[str, int]:
    """Bytes of a dictionary's parts: trie, symbol table, anchors, and the text by the backend that ``backend_choice`` names."""
    backend = backend_choice(symbols, runs)
    out = {"trie": trie_total, "c_table": packed_bytes(ALPHABET, symbols), "anchors": packed_bytes(strings + 1, strings) + packed_bytes(strings, strings), "run_symbols": 0, "run_boundaries": 0, "run_prefixes": 0}
    if backend == "run-length":
        out |= {"run_symbols": 2 * runs, "run_boundaries": bit_vector_bytes(symbols), "run_prefixes": 4 * (runs + ALPHABET) + 4 * (ALPHABET + 1), "bwt": wavelet_bytes(runs)}
    else:
        out["bwt"] = hybrid_bytes(symbols) if level_counts is None else hybrid_actual_bytes(symbols, level_counts)
    out["fm_total"] = sum(v for k, v in out.items() if k != "trie")
    return out | {"total": out["trie"] + out["fm_total"]}


def wavelet_bytes(n: int) -> int:
    """Nine bit vectors and their zero counts."""
    return SYMBOL_BITS * bit_vector_bytes(n) + 8 * SYMBOL_BITS


def hybrid_bytes(n: int) -> int:
    """One bit vector, four four-symbol levels with as many select samples as symbols can need, and the counts."""
    if n <= 0:
        return 0
    most = max(s + (n - s) // 2048 for s in range(1, min(4, n) + 1))
    level = ceil_div(n, 32) * 8 + ceil_div(n, 4096) * 64 + most * 8
    return bit_vector_bytes(n) + QUAD_LEVELS * level + 8 + QUAD_LEVELS * 32


def run_length_bytes(n: int, runs: int) -> int:
    """Run symbols, run starts, their wavelet index, and symbol offsets and prefixes."""
    return 2 * runs + bit_vector_bytes(n) + SYMBOL_BITS * bit_vector_bytes(runs) + 8 * SYMBOL_BITS + 4 * (ALPHABET + 1) + 4 * (runs + ALPHABET)


def backend_choice(n: int, runs: int) -> str:
    """run-length where it takes at most 85 % of the hybrid's bytes and runs have five symbols on average, else hybrid."""
    return "run-length" if run_length_bytes(n, runs) * 100 <= hybrid_bytes(n) * 85 and runs * 5 <= n else "hybrid"
