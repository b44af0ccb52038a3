"""Language-model scores of whole documents: a gated recurrent network over word classes, in numpy.

All training documents are counted: every distinct token, of any frequency, has its count. The most frequent ``KNOWN`` tokens are broadcast;
all others are the rare class, whose words' counts are joined to the documents that hold them. The output softmax is factored:
P(token) = P(class | state) * P(token | class). The first ``HEAD`` tokens by frequency make classes of ``CLASS`` words, chosen by a second softmax of the
state; each further octave of ranks is one class, and so is all that is rarer or unknown, where a token has its share of counts plus one.

The network (a GRU) is trained by truncated backpropagation over all tokens of all training documents, once: documents side by side in lanes, in consecutive
windows of ``WINDOW`` tokens, the state carried from a document's first token to its end. A task begins with ``LANES[0]`` lanes and doubles them up to ``LANES[1]``;
its rate falls with the root of its steps. Tasks start from the same weights, train on their share and are averaged in groups. Scoring carries the state
through all windows of a document, many documents side by side.

Defined results: a null or empty text is the end token alone; null keys are training documents; repeated rows are counted and scored each; without
training documents all tokens are unknown; an empty table gives an empty table. Tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batch, bounded_batches, each, mix64, most_frequent, written

KNOWN = 1 << 17
HEAD, CLASS = 2048, 64
HIDDEN = 16
WINDOW = 32
#: Lanes that a task begins and ends with; windows until they double; the first rate of learning, and the steps in which its square halves.
LANES, DOUBLED, RATE, SLOWED = (32, 160), 128, 0.012, 100
#: Octaves of ranks behind the head, and the classes: the head's, an octave each, the rare one.
OCTAVES = (KNOWN // HEAD).bit_length() - 1
CLASSES = HEAD // CLASS + OCTAVES + 1
#: Distinct tokens that a task counts before it passes them on.
COUNTED = 1 << 21
#: Tasks whose weights are averaged together, some 150 KB each, level by level.
AVERAGED = 16
#: Documents whose states advance together.
TOGETHER = 4096
END = np.uint64(0x9E3779B97F4A7C15)

Weights = dict[str, np.ndarray]
#: What is broadcast is plain: executors that lack the package can load it. ``hashes`` of the known tokens, sorted, their ``rank``, ``counts`` by rank, numbers
#: of training tokens ``n`` and of distinct ones ``v``, and ``rare``, the counts plus one of all rare tokens and one for unknown ones.
Vocabulary = dict[str, Any]


def token_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words, A to Z lower-cased, and of the end token."""
    import xxhash

    words = (text or b"").lower().split()
    out = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.append(out, END)


def ranks_of(voc: Vocabulary, tokens: np.ndarray) -> np.ndarray:
    """Rank of each token, KNOWN for rare ones."""
    if not len(voc["hashes"]):
        return np.full(len(tokens), KNOWN, np.int64)
    at = np.minimum(np.searchsorted(voc["hashes"], tokens), len(voc["hashes"]) - 1)
    return np.where(voc["hashes"][at] == tokens, voc["rank"][at], KNOWN)


def end_rank(voc: Vocabulary) -> int:
    return int(ranks_of(voc, np.array([END], np.uint64))[0])


def class_of_rank() -> np.ndarray:
    """For ranks 0 to KNOWN."""
    r = np.arange(KNOWN + 1)
    octave = np.log2(np.maximum(r, HEAD) // HEAD).astype(np.int64)
    return np.where(r < HEAD, r // CLASS, HEAD // CLASS + octave).astype(np.int32)


def masses(voc: Vocabulary) -> np.ndarray:
    """Counts plus one by rank, rare ones last; 0 where there is no token."""
    out = np.zeros(KNOWN + 1)
    out[: len(voc["counts"])] = voc["counts"] + 1
    out[KNOWN] = voc["rare"]
    return out


def count_tokens(rows: DataFrame) -> DataFrame:
    """(token, c) over all rows of (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting = 0

        def passed_on() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "c"])

        for (texts,) in each(batches, "text"):
            for t in as_bytes(texts):
                held.append(token_hashes(t))
                waiting += len(held[-1])
                if waiting > 4 * COUNTED:
                    yield passed_on()
                    waiting = 0
        if held:
            yield passed_on()

    return written(rows.select("text").mapInArrow(count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")), "token-counts")


def vocabulary(counts: DataFrame) -> Vocabulary:
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = most_frequent(counts, "c", KNOWN).toPandas().sort_values(["c", "token"], ascending=[False, True])
    hashes, c = top["token"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return {"hashes": hashes[order], "rank": order.astype(np.int64), "counts": c, "n": int(n), "v": int(v), "rare": int(n - c.sum() + v - len(c) + 1)}


def first_weights(voc: Vocabulary, seed: int = 5) -> Weights:
    """Small random weights whose biases give every class and head token its frequency."""
    rng = np.random.default_rng(seed)
    symbols = HEAD + OCTAVES + 1
    mass = masses(voc)
    by_class = np.bincount(class_of_rank(), mass, CLASSES)
    out = {
        "embed": rng.normal(0, 0.1, (symbols, HIDDEN)), "wx": rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), "bias": np.zeros(3 * HIDDEN), "u": rng.normal(0, 0.2, (HIDDEN, 3 * HIDDEN)),
        "wc": np.zeros((HIDDEN, CLASSES)), "bc": np.log(by_class + 1e-3) - np.log(mass.sum()), "ww": np.zeros((HEAD, HIDDEN)), "bw": np.log(np.maximum(mass[:HEAD], 1e-3)),
    }
    return {k: v.astype(np.float32) for k, v in out.items()}


def symbols_of_rank() -> np.ndarray:
    """Input symbols of ranks 0 to KNOWN: a head token's rank, else HEAD plus the number of its octave."""
    r = np.arange(KNOWN + 1)
    return np.where(r < HEAD, r, HEAD + np.log2(np.maximum(r, HEAD) // HEAD).astype(np.int64))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def step(p: np.ndarray, u: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The next state of lanes ``h`` for projected inputs ``p``, with gates (reset and update), candidate and the state's projection. A lane is a column."""
    g = u.T @ h
    k = len(h)
    gates = sigmoid(p[: 2 * k] + g[: 2 * k])
    new = np.tanh(p[2 * k :] + gates[:k] * g[2 * k :])
    return new + gates[k:] * (h - new), gates, new, g


def log_softmax(x: np.ndarray) -> np.ndarray:
    """Of each column. Reductions over the first axis are the fast ones."""
    x = x - x.max(axis=0)
    return x - np.log(np.exp(x).sum(axis=0))


def picked_logs(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``log_softmax`` of each column at one row; ``x`` is overwritten."""
    x -= x.max(axis=0)
    out = x[rows, np.arange(len(rows))]
    np.exp(x, out=x)
    return out - np.log(x.sum(axis=0))


def softmax(x: np.ndarray) -> np.ndarray:
    """Of each column, in place."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def log_shares(voc: Vocabulary) -> np.ndarray:
    """ln of a token's share of its class, for the classes without a softmax; 0 for the head, and for rare tokens, whose counts are joined later."""
    mass, cls = masses(voc), class_of_rank()
    by_class = np.bincount(cls, mass, CLASSES)
    out = np.log(np.maximum(mass, 1e-300)) - np.log(np.maximum(by_class[cls], 1e-300))
    out[:HEAD] = 0
    out[KNOWN] = 0
    return out


def head_groups(ranks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(class, positions) of the head tokens among ``ranks``."""
    inside = np.flatnonzero(ranks < HEAD)
    k = (ranks[inside] // CLASS).astype(np.uint16)  # short numbers are sorted by their digits
    order = np.argsort(k, kind="stable")
    inside, k = inside[order], k[order]
    bounds = np.flatnonzero(np.diff(k)) + 1
    for part in np.split(inside, bounds) if len(inside) else []:
        yield int(ranks[part[0]] // CLASS), part


def token_logs(w: Weights, h: np.ndarray, ranks: np.ndarray, classes: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """ln P of tokens ``ranks`` in states ``h``, without the shares of rare tokens."""
    out = picked_logs(w["wc"].T @ h.T + w["bc"][:, None], classes[ranks]).astype(np.float64) + shares[ranks]
    for k, at in head_groups(ranks):
        rows = slice(k * CLASS, (k + 1) * CLASS)
        out[at] += picked_logs(w["ww"][rows] @ h[at].T + w["bw"][rows, None], ranks[at] % CLASS)
    return out


def summed_at(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, width): the sum of ``rows`` for each index in ``at``."""
    at = at.astype(np.uint16) if n < 1 << 16 else at
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[ordered[starts]] = np.add.reduceat(rows[order], starts)
    return out


def gradients(
    w: Weights, h: np.ndarray, symbols: np.ndarray, targets: np.ndarray, classes: np.ndarray, first: np.ndarray | None = None, live: np.ndarray | None = None,
) -> tuple[Weights, np.ndarray]:
    """Gradients of the mean loss over one window (steps, lanes), and the state behind it; ``h`` (HIDDEN, lanes) is the state before it.

    ``first`` marks tokens that begin a document, and so start from the zero state; places that are not ``live`` have no loss.
    """
    steps, lanes = symbols.shape
    k = HIDDEN

    def wide(x: np.ndarray) -> np.ndarray:
        """(width, steps * lanes) of (steps, width, lanes)."""
        return x.transpose(1, 0, 2).reshape(x.shape[1], -1)

    inputs = w["embed"][symbols.ravel()]
    p = np.ascontiguousarray((w["wx"].T @ inputs.T + w["bias"][:, None]).reshape(3 * k, steps, lanes).transpose(1, 0, 2))
    keep = None if first is None else [(~f).astype(np.float32) if f.any() else None for f in first]
    states, befores, news, pushed, gates = *np.empty((4, steps, k, lanes), np.float32), np.empty((steps, 2 * k, lanes), np.float32)
    for t in range(steps):
        befores[t] = h if keep is None or keep[t] is None else h * keep[t]
        states[t], gates[t], news[t], g = step(p[t], w["u"], befores[t])
        pushed[t] = g[2 * k :]
        h = states[t]
    goal = targets.ravel()
    flat = np.ascontiguousarray(wide(states).T)
    counted = None if live is None or live.all() else live.ravel()
    n = np.float32(len(goal) if counted is None else counted.sum())
    d = softmax(w["wc"].T @ flat.T + w["bc"][:, None])
    d[classes[goal], np.arange(len(goal))] -= 1
    if counted is not None:
        d[:, ~counted] = 0
    out: Weights = {"wc": (d @ flat).T / n, "bc": d.sum(1) / n, "ww": np.zeros_like(w["ww"]), "bw": np.zeros_like(w["bw"])}
    dh = d.T @ w["wc"].T
    for c, at in head_groups(goal if counted is None else np.where(counted, goal, KNOWN)):
        rows = slice(c * CLASS, (c + 1) * CLASS)
        own = flat[at]
        e = softmax(w["ww"][rows] @ own.T + w["bw"][rows, None])
        e[goal[at] % CLASS, np.arange(len(at))] -= 1
        out["ww"][rows], out["bw"][rows] = e @ own / n, e.sum(1) / n
        dh[at] += e.T @ w["ww"][rows]
    dh = np.ascontiguousarray(dh.reshape(steps, lanes, k).transpose(0, 2, 1)) / n
    # All gate derivatives are multiples of a state's total gradient, so only that goes backward step by step.
    r, z = gates[:, :k], gates[:, k:]
    dnew = (1 - z) * (1 - news * news)
    by_total = np.empty((steps, 3, k, lanes), np.float32)
    by_total[:, 2] = dnew * r
    by_total[:, 0] = by_total[:, 2] * pushed * (1 - r)
    by_total[:, 1] = (befores - news) * z * (1 - z)
    totals, dg, carried = np.empty_like(states), np.empty_like(by_total), np.zeros((k, lanes), np.float32)
    for t in range(steps - 1, -1, -1):
        total = np.add(dh[t], carried, out=totals[t])
        np.multiply(total, by_total[t], out=dg[t])
        carried = total * z[t] + w["u"] @ dg[t].reshape(3 * k, lanes)
        if keep is not None and keep[t] is not None:
            carried *= keep[t]
    out["u"] = wide(befores) @ wide(dg.reshape(steps, 3 * k, lanes)).T
    dg[:, 2] = totals * dnew
    flat_dp = wide(dg.reshape(steps, 3 * k, lanes))
    out |= {"wx": (flat_dp @ inputs).T, "bias": flat_dp.sum(1)}
    out["embed"] = summed_at(symbols.ravel(), flat_dp.T @ w["wx"].T, len(w["embed"]))
    return out, h


class Adam:
    def __init__(self, w: Weights, rate: float) -> None:
        self.m, self.v, self.t, self.rate = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0, rate

    def update(self, w: Weights, g: Weights) -> None:
        self.t += 1
        size = self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t) / np.sqrt(1 + self.t / SLOWED)
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        for k, x in g.items():
            x = x * scale
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            w[k] -= (size * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def windows_of(documents: Iterator[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(lanes, ranks, first, live), the last three (WINDOW, lanes): every token of every document once and in order, each document in one lane, one behind the other.

    Only where no documents are left do lanes end, in a window whose rest is not live.
    """
    held = [(np.empty(0, np.int64), np.empty(0, bool))] * LANES[1]
    width, made, left = LANES[0], 0, True
    while True:
        lanes = []
        for i in range(width):
            size = len(held[i][0])
            if size < WINDOW and left:
                parts = [held[i]]
                while size < WINDOW:
                    if (ranks := next(documents, None)) is None:
                        left = False
                        break
                    first = np.zeros(len(ranks), bool)
                    first[:1] = True
                    parts.append((ranks, first))
                    size += len(ranks)
                if len(parts) > 1:
                    held[i] = (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            if size:
                lanes.append(i)
        if not lanes:
            return
        ranks, first, live = np.zeros((len(lanes), WINDOW), np.int64), np.zeros((len(lanes), WINDOW), bool), np.ones((len(lanes), WINDOW), bool)
        for j, i in enumerate(lanes):
            tokens, begins = held[i]
            n = min(WINDOW, len(tokens))
            ranks[j, :n], first[j, :n], live[j, n:] = tokens[:n], begins[:n], False
            held[i] = (tokens[n:], begins[n:])
        yield lanes, ranks.T, first.T, live.T
        made += 1
        if made % DOUBLED == 0:
            width = min(2 * width, LANES[1])


def train_on(w: Weights, documents: Iterator[np.ndarray], classes: np.ndarray, end: int, rate: float = RATE) -> tuple[Weights, int]:
    """``w`` after one pass over all tokens of ``documents``, arrays of ranks; a document's first input is the end token. Returns the number of tokens too."""
    w = {k: x.copy() for k, x in w.items()}
    adam, seen = Adam(w, rate), 0
    h, last, symbols = np.zeros((HIDDEN, LANES[1]), np.float32), np.full(LANES[1], end), symbols_of_rank()
    for lanes, ranks, first, live in windows_of(documents):
        given = np.where(first, end, np.concatenate([last[lanes][None], ranks[:-1]]))
        g, h[:, lanes] = gradients(w, h[:, lanes], symbols[given], ranks, classes, first, live)
        last[lanes] = ranks[-1]
        adam.update(w, g)
        seen += int(live.sum())
    return w, seen


def packed(w: Weights) -> bytes:
    return b"".join(np.ascontiguousarray(w[k], "<f4").tobytes() for k in sorted(w))


def unpacked(data: bytes, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = np.frombuffer(data, "<f4", like[k].size, at).reshape(like[k].shape).copy()
        at += 4 * like[k].size
    return out


def token_ranks(rows: DataFrame, voc: Vocabulary) -> DataFrame:
    """(uid, key, held_out, n_tokens, n_frequent, base, ranks, rare) of (key, held_out, text), written: all tokens of every document as 32-bit ranks, the hashes of its rare ones."""
    known = rows.sparkSession.sparkContext.broadcast(voc)  # KNOWN entries at most
    schema = pa.schema([("uid", pa.int64()), ("key", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_frequent", pa.int64()), ("base", pa.float64()), ("ranks", pa.binary()), ("rare", pa.list_(pa.int64()))])

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = known.value
        count_logs = np.append(np.log10(np.maximum(masses(voc)[:KNOWN], 1)), 0.0)
        uid = TaskContext.get().partitionId() << 40
        for keys, helds, texts in each(batches, "key", "held_out", "text"):
            tokens = [token_hashes(t) for t in as_bytes(texts)]
            ranks = [ranks_of(voc, x) for x in tokens]
            rare = [r == KNOWN for r in ranks]
            yield batch(
                schema, uid=np.arange(uid, uid + len(tokens)), key=keys, held_out=helds, n_tokens=[len(x) for x in tokens], n_frequent=[len(x) - int(r.sum()) for x, r in zip(tokens, rare, strict=True)],
                base=[float(count_logs[r].sum()) for r in ranks], ranks=[r.astype("<i4").tobytes() for r in ranks], rare=[x[r].view(np.int64) for x, r in zip(tokens, rare, strict=True)],
            )
            uid += len(tokens)

    return written(rows.mapInArrow(ranked, "uid long, key long, held_out boolean, n_tokens long, n_frequent long, base double, ranks binary, rare array<long>"), "lm-ranks")


def shuffled(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The documents of (ranks), mixed within each batch; in the last batch long ones come first, so that lanes end at about the same time."""
    waiting: list[bytes] = []

    def documents(rows: list[bytes], longest_first: bool) -> Iterator[np.ndarray]:
        order = np.argsort(mix64(np.arange(len(rows), dtype=np.uint64)))
        for i in sorted(order, key=lambda i: -len(rows[i])) if longest_first else order:
            yield np.frombuffer(rows[i], "<i4").astype(np.int64)

    for (data,) in each(batches, "ranks"):
        yield from documents(waiting, False)
        waiting = data.to_pylist()
    yield from documents(waiting, True)


def averaged(parts: DataFrame) -> list:
    """At most AVERAGED rows (seen, weights) that average like all of (task, seen, weights): groups of AVERAGED tasks become one row, until few are left."""

    def average(rows: pa.Table) -> pa.Table:
        seen = rows["seen"].to_pylist()
        total = sum(np.frombuffer(x, "<f4").astype(np.float64) * s for x, s in zip(rows["weights"].to_pylist(), seen, strict=True)) / sum(seen)
        return pa.table({"task": pa.array([rows["task"][0].as_py() // AVERAGED], pa.int64()), "seen": pa.array([sum(seen)], pa.int64()), "weights": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    parts = written(parts, "lm-weights")
    while parts.count() > AVERAGED:
        parts = written(parts.groupBy(F.expr(f"task div {AVERAGED}")).applyInArrow(average, "task long, seen long, weights binary"), "lm-weights")
    return parts.collect()


def train(ranked: DataFrame, voc: Vocabulary) -> Weights:
    """The averaged network of (ranks)."""
    w = first_weights(voc)
    classes, end = class_of_rank(), end_rank(voc)
    start = ranked.sparkSession.sparkContext.broadcast(w)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = train_on(start.value, shuffled(batches), classes, end)
        if seen:
            yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int64()), "seen": pa.array([seen], pa.int64()), "weights": pa.array([packed(out)], pa.binary())})

    if parts := averaged(ranked.select("ranks").mapInArrow(fit, "task long, seen long, weights binary")):
        whole = sum(p["seen"] for p in parts)
        mean = sum(np.frombuffer(p["weights"], "<f4").astype(np.float64) * (p["seen"] / whole) for p in parts)
        w = unpacked(mean.astype("<f4").tobytes(), w)
    return w


def document_logs(w: Weights, documents: list[np.ndarray], classes: np.ndarray, shares: np.ndarray, end: int) -> np.ndarray:
    """ln P of each document (an array of ranks), without the shares of its rare tokens. Longer documents come first, so that those that end leave the last lanes."""
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    lengths = np.array([len(documents[i]) for i in order], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    ranks = np.concatenate([documents[i] for i in order])
    table, symbols = w["embed"] @ w["wx"] + w["bias"], symbols_of_rank()
    h = np.zeros((HIDDEN, len(order)), np.float32)
    out = np.zeros(len(order))
    t, longest = 0, int(lengths[0])
    while t < longest:
        states, goals, lanes = [], [], []
        size = 0
        while t < longest and len(states) < 16 * WINDOW and size < (1 << 16):
            n = int(np.searchsorted(-lengths, -t))  # documents longer than t
            at = offsets[:n] + t
            given = symbols[ranks[at - 1]] if t else np.full(n, symbols[end])
            h = step(np.ascontiguousarray(table[given].T), w["u"], np.ascontiguousarray(h[:, :n]))[0]
            states.append(h)
            goals.append(ranks[at])
            lanes.append(n)
            size += n
            t += 1
        logs = token_logs(w, np.concatenate(states, axis=1).T, np.concatenate(goals), classes, shares)
        at = 0
        for n in lanes:
            out[:n] += logs[at : at + n]
            at += n
    back = np.empty(len(order))
    back[order] = out
    return back


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; learns from those that are not held out."""
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"), held_out(F.col(f"`{key}`")).alias("held_out"))
    counts = count_tokens(rows.where(~F.col("held_out")))
    voc = vocabulary(counts)
    ranked = token_ranks(rows, voc)
    w = train(ranked.where(~F.col("held_out")), voc)
    shared = spark.sparkContext.broadcast((w, class_of_rank(), log_shares(voc), end_rank(voc)))  # KNOWN entries at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uids, data in each(batches, "uid", "ranks"):
            ranks = [np.frombuffer(x, "<i4").astype(np.int64) for x in data.to_pylist()]
            for i in range(0, len(ranks), TOGETHER):
                yield pa.RecordBatch.from_arrays([uids[i : i + TOGETHER], pa.array(document_logs(shared.value[0], ranks[i : i + TOGETHER], *shared.value[1:]) / np.log(10))], names=["uid", "log"])

    logs = ranked.select("uid", "ranks").mapInArrow(score, "uid long, log double")
    # Frequent tokens are all broadcast, so no key of this join is hot.
    rare = ranked.select("uid", F.explode("rare").alias("token"))
    joined = rare.join(counts, "token", "left").groupBy("uid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare_base"), F.count("c").alias("rare_known"))
    n_rare = F.col("n_tokens") - F.col("n_frequent")
    out = ranked.drop("rare", "ranks").join(logs, "uid").join(joined, "uid", "left")
    rare_base = F.coalesce("rare_base", F.lit(0.0))
    return out.select(
        F.col("key").alias("doc_id"), "held_out", "n_tokens", (F.col("n_frequent") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(voc["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + rare_base - F.col("n_tokens") * float(np.log10(voc["n"] + voc["v"] + 1))).alias("base_score"), (F.col("log") + rare_base - n_rare * float(np.log10(voc["rare"]))).alias("score"),
    )
