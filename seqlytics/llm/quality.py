"""Quality scores by Bradley-Terry pairwise ranking.

A document's worth is linear in features of its whole text; the chance that a preferred document (label 1) beats another
(label 0) is the logistic of the difference of their worths. The weights are fitted on preference pairs by logistic loss on
feature differences. The cut is the quantile of the worths of all labelled training documents that leaves out as many as are labelled 0;
scores are the logistic of the distance to it, shifted so that the cut scores ``CUT_SCORE``.

Fitting the weights uses at most ``sample_rows`` labelled rows of each class, by a hash of their id, and ``pairs`` pairs; the cut is
exact, from every labelled row; scoring covers every row and looks at nothing but the text.

Defined results: null and empty texts have all features 0 and a score like any other; null labels and ids do not take part in
fitting; a document with repeated labels counts once for each; without labels of both classes every score is ``CUT_SCORE``;
repeated rows are scored alike; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from seqlytics.operators.positions import dense_positions

from .common import as_bytes, batch, bounded_batches, each, hashed_sample, written

CUT_SCORE = 0.7
SAMPLE_ROWS = 8_000
PAIRS = 40_000
FEATURES = (
    "log_words", "word_length", "upper", "digit", "mark", "exclaim", "symbol", "pipe", "high", "blank", "distinct_words",
    "repeated_neighbours", "upper_words", "symbol_words", "longest_run", "most_frequent", "repeated_lines", "stops",
)

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*+<=>@^_`{}~\\|")] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:?!()'\"-")] = True


def features_of(text: bytes | None) -> list[float]:
    """One number for each of FEATURES; shares, or logarithms, so that length alone tells little."""
    data = text or b""
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, n = len(data), len(words)
    black = max(1, int(counts[33:].sum()))
    upper = int(counts[65:91].sum())
    letters = max(1, upper + int(counts[97:123].sum()))
    symbols = int(counts[_SYMBOLS].sum())
    runs = sum(map(eq, words, words[1:]))
    longest = now = 0
    if runs:
        for a, b in zip(words, words[1:], strict=False):
            now = now + 1 if a == b else 0
            longest = max(longest, now)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x]
    ends = data.translate(None, b"#$%&*+<=>@^_`{}~\\|") if symbols else data
    return [
        float(np.log1p(n)), np.log1p(black / n), upper / letters, int(counts[48:58].sum()) / black, int(counts[_MARKS].sum()) / black, int(counts[33]) / n, symbols / n, int(counts[124]) / n,
        int(counts[128:].sum()) / black, int(counts[10]) / n, len(tally) / n, runs / n, sum(map(bytes.isupper, words)) / n, (size - len(ends)) / black,
        float(np.log1p(longest)), max(tally.values()) / n, 1 - len(set(lines)) / len(lines), int(counts[46]) / n,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        shifted = self.worth(x) - self.cut + np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(shifted, -30, 30)))


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, steps: int = 400, decay: float = 1e-3, seed: int = 7) -> Model:
    """Bradley-Terry weights for rows ``x``, of which ``good`` are preferred, by full-batch gradient steps with momentum."""
    width = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if not len(x) or good.all() or not good.any():
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    winners, losers = np.flatnonzero(good), np.flatnonzero(~good)
    diff = z[rng.choice(winners, pairs)] - z[losers[np.arange(pairs) % len(losers)]]
    w, speed = np.zeros(width), np.zeros(width)
    for _ in range(steps):
        lose = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        speed = 0.9 * speed + (diff.T @ lose / pairs - decay * w)
        w += 0.1 * speed
    worth = z @ w
    return Model(mean, scale, w, float(np.quantile(worth, 1 - good.mean())))


def known_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label) of the rows that take part."""
    return labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label")).where("key IS NOT NULL AND label IN (0, 1)")


def labelled_features(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``sample_rows`` labels of each class. The sample is what is broadcast; of its documents' different features at most 4 * ``sample_rows`` come to the driver."""
    known = known_labels(labels, key, label)
    sample = hashed_sample(known.where("label = 0"), ("key",), sample_rows, 11).unionByName(hashed_sample(known.where("label = 1"), ("key",), sample_rows, 11))
    rows = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(F.broadcast(sample), "key")
    schema = pa.schema([("key", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, given, texts in each(batches, "key", "label", "text"):
            yield batch(schema, key=keys, label=given, x=[features_of(t) for t in as_bytes(texts)])

    # A key may have any number of rows: equal ones count once, and different ones are thinned out by hash if they are too many.
    found = written(rows.select("key", "label", "text").mapInArrow(extract, "key long, label int, x array<double>").distinct(), "quality-sample")
    found = hashed_sample(found, ("key", "label", "x"), 4 * sample_rows, 13)
    got = sorted((r["key"], r["label"], r["x"]) for r in found.collect())
    return np.array([g[2] for g in got], float).reshape(-1, len(FEATURES)), np.array([g[1] == 1 for g in got], bool)


def cut_of_all(documents: DataFrame, labels: DataFrame, model: Model, key: str, text: str, label: str) -> float:
    """The quantile of the worths of all labelled rows that leaves out as many as are labelled 0; texts are not shuffled, only their worths."""

    def worths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in each(batches, "key", "text"):
            x = np.array([features_of(t) for t in as_bytes(texts)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), pa.array(model.worth(x), pa.float64())], names=["key", "worth"])

    rows = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("key IS NOT NULL")
    rows = written(rows.mapInArrow(worths, "key long, worth double").join(known_labels(labels, key, label), "key"), "quality-labelled")
    # The key behind the worth lets copies of one text be split between tasks.
    placed = written(dense_positions(rows, ("worth", "key"), "at"), "quality-worths")
    n, bad = placed.agg(F.count(F.lit(1)), F.count_if(F.col("label") == 0)).first()
    at = (n - 1) * bad / n
    low = int(at)
    worth = {r["at"]: r["worth"] for r in placed.where(F.col("at").isin(low, low + 1)).collect()}
    return worth[low] + (at - low) * (worth.get(low + 1, worth[low]) - worth[low])


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS, pairs: int = PAIRS) -> Model:
    x, good = labelled_features(documents, labels, key, text, label, sample_rows)
    model = fit_pairs(x, good, pairs=pairs)
    if not model.weights.any():  # not both classes
        return model
    bounded_batches(documents.sparkSession)
    return replace(model, cut=cut_of_all(documents, labels, model, key, text, label))


def held_out(key: Column) -> Column:
    """The rows that no label is learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(df: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``df`` with one more column, the score of its text; a column of that name is replaced."""
    bounded_batches(df.sparkSession)
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c != column])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features_of(t) for t in as_bytes(b.column(b.schema.get_field_index(text)))], float).reshape(-1, len(FEATURES))
            yield b.append_column(column, pa.array(model.score(x), pa.float64()))

    return df.mapInArrow(scored, StructType([*df.schema.fields, StructField(column, DoubleType())]))
