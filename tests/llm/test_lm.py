"""Base scores against plain counts, gradients against differences, and that the network is a distribution and learns."""

import math
import pickle
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np

from seqlytics.llm import lm


def tiny():
    tokens = np.arange(1, 2001, dtype=np.uint64) * np.uint64(977)
    counts = np.sort((5000 / np.arange(1, 2001)).astype(np.int64) + 1)[::-1]
    order = np.argsort(tokens)
    return {"hashes": tokens[order], "rank": order.astype(np.int64), "counts": counts, "n": int(counts.sum()) + 50, "v": 2040, "rare": 50 + 40 + 1}


def test_factored_softmax_is_a_distribution():
    voc = tiny()
    w = lm.first_weights(voc)
    rng = np.random.default_rng(1)
    w["wc"], w["ww"] = rng.normal(0, 1, w["wc"].shape).astype(np.float32), rng.normal(0, 1, w["ww"].shape).astype(np.float32)
    h = np.repeat(rng.normal(0, 1, (1, lm.HIDDEN)).astype(np.float32), 2000, 0)
    logs = lm.token_logs(w, h, np.arange(2000), lm.class_of_rank(), lm.log_shares(voc))
    rare = lm.token_logs(w, h[:1], np.array([lm.KNOWN]), lm.class_of_rank(), lm.log_shares(voc))
    used = np.unique(lm.class_of_rank()[np.r_[np.arange(2000), lm.KNOWN]])
    whole = np.exp(lm.log_softmax((h[:1] @ w["wc"] + w["bc"]).T))[used, 0].sum()
    assert abs(np.exp(logs).sum() + np.exp(rare)[0] - whole) < 1e-4


def test_gradients_equal_differences():
    voc = tiny()
    rng = np.random.default_rng(2)
    w = {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float64) for k, v in lm.first_weights(voc).items()}
    classes = lm.class_of_rank()
    targets = rng.integers(0, 1500, (5, 3))
    symbols = lm.symbols_of_rank()[rng.integers(0, 1500, (5, 3))]
    h = rng.normal(0, 0.5, (lm.HIDDEN, 3)).astype(np.float32)

    def loss(w):
        state, total = h.astype(np.float64), 0.0
        p = w["embed"] @ w["wx"] + w["bias"]
        for t in range(5):
            state = lm.step(p[symbols[t]].T, w["u"], state)[0]
            total -= lm.token_logs(w, state.T, targets[t], classes, np.zeros(lm.KNOWN + 1)).sum()
        return total / targets.size

    g, _ = lm.gradients({k: v.astype(np.float32) for k, v in w.items()}, h, symbols, targets, classes)
    for name in w:
        flat = np.argsort(-np.abs(g[name]).ravel())[:4]
        for i in flat:
            moved = {k: v.copy() for k, v in w.items()}
            moved[name].ravel()[i] += 1e-4
            back = {k: v.copy() for k, v in w.items()}
            back[name].ravel()[i] -= 1e-4
            assert abs((loss(moved) - loss(back)) / 2e-4 - g[name].ravel()[i]) < 2e-3, name


def test_state_is_carried_and_lanes_do_not_mix():
    voc = tiny()
    w = lm.first_weights(voc)
    rng = np.random.default_rng(3)
    w["wc"] = rng.normal(0, 1, w["wc"].shape).astype(np.float32)
    docs = [rng.integers(0, 1500, n) for n in (1, 700, 3, 64, 200)]
    together = lm.document_logs(w, docs, lm.class_of_rank(), lm.log_shares(voc), 7)
    alone = [lm.document_logs(w, [x], lm.class_of_rank(), lm.log_shares(voc), 7)[0] for x in docs]
    assert np.allclose(together, alone, rtol=1e-4)
    swapped = docs[1].copy()
    swapped[:2] = swapped[:2][::-1]
    assert lm.document_logs(w, [swapped], lm.class_of_rank(), lm.log_shares(voc), 7)[0] != alone[1]


def test_base_scores_equal_plain_counts(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice([f"W{k}" for k in range(int(3 + 40 * rng.random()))], int(rng.integers(0, 60))))) for i in range(150)] + [(900, None), (None, "w1 new"), (901, "x\ty\nx")]
    out = {r["doc_id"]: r for r in lm.score_documents(spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")).collect()}
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").lower().split(), None]
    c = Counter(x for d, t in rows if not held(d) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    assert len(out) == len(rows)
    for d, t in rows:
        r = out[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(d), len(tokens(t)), sum(x in c for x in tokens(t)), n)
        assert abs(r["base_score"] - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t))) < 1e-6
        assert r["score"] < 0


def test_network_learns_order(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join("abcdefgh"[(int(s) + k) % 8] for k in range(200))) for i, s in enumerate(rng.integers(0, 8, 400))]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got["s"] > 0.6 * got["b"]  # logarithms: closer to 0 is likelier


def test_every_training_token_is_learnt_from_in_order():
    rng = np.random.default_rng(6)
    docs = [np.append(rng.integers(0, 1500, n), 7) for n in (0, 5, 1500, 31, 32, 33, 2100, 64, *rng.integers(0, 300, 200))]
    lanes_seen: dict[int, list[int]] = {}
    begins: dict[int, list[bool]] = {}
    for lanes, ranks, first, live in lm.windows_of(iter(docs)):
        for j, lane in enumerate(lanes):
            lanes_seen.setdefault(lane, []).extend(ranks[live[:, j], j])
            begins.setdefault(lane, []).extend(first[live[:, j], j])
    got = [tuple(x) for lane, tokens in lanes_seen.items() for x in np.split(tokens, np.flatnonzero(begins[lane])[1:])]
    assert sorted(got) == sorted(map(tuple, docs))
    voc = tiny()
    _, seen = lm.train_on(lm.first_weights(voc), iter(docs), lm.class_of_rank(), 7)
    assert seen == sum(map(len, docs))


def test_state_reaches_the_end_of_a_document_and_no_further():
    voc = tiny()
    rng = np.random.default_rng(7)
    w = {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float32) for k, v in lm.first_weights(voc).items()}
    classes, h = lm.class_of_rank(), np.zeros((lm.HIDDEN, 1), np.float32)
    one, two = rng.integers(0, 1500, 9), rng.integers(0, 1500, 6)

    def of(tokens, first, live):
        symbols = lm.symbols_of_rank()[np.where(first, 7, np.append(7, tokens[:-1]))]
        return lm.gradients(w, h, symbols[:, None], tokens[:, None], classes, first[:, None], live[:, None])

    start = lambda x: np.arange(len(x)) == 0
    joined, _ = of(np.append(one, two), np.append(start(one), start(two)), np.ones(15, bool))
    a, _ = of(np.append(one, [0, 0]), np.append(start(one), [False, False]), np.append(np.ones(9, bool), [False, False]))
    b, _ = of(two, start(two), np.ones(6, bool))
    assert all(np.allclose(joined[k], (9 * a[k] + 6 * b[k]) / 15, atol=1e-5) for k in w)


def test_a_table_of_long_documents_is_trained_whole(spark):
    text = " ".join(f"w{i % 50}" for i in range(3000))
    rows = spark.createDataFrame([(1, False, text)] * 5 + [(2, False, "a b"), (3, False, None)], "key long, held_out boolean, text string")
    voc = lm.vocabulary(lm.count_tokens(rows))
    got = lm.token_ranks(rows, voc).selectExpr("sum(length(ranks)) / 4 n", "sum(n_tokens) t").first()
    assert got["n"] == got["t"] == 5 * 3001 + 3 + 1 == voc["n"]


def test_broadcasts_load_where_the_package_is_missing(tmp_path):
    """Broadcasts go by plain pickle, which names the modules of what it holds."""
    voc = tiny()
    for i, x in enumerate((voc, lm.first_weights(voc), (lm.first_weights(voc), lm.class_of_rank(), lm.log_shares(voc), 7))):
        (tmp_path / f"{i}").write_bytes(pickle.dumps(x))
        code = f"import pickle, sys; pickle.load(open({str(tmp_path / str(i))!r}, 'rb')); assert not any(m.startswith('seqlytics') for m in sys.modules)"
        subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_averages_over_many_tasks_weigh_tokens(spark, monkeypatch):
    monkeypatch.setattr(lm, "AVERAGED", 3)
    rows = [(i, i + 1, np.full(4, i, "<f4").tobytes()) for i in range(20)]
    parts = lm.averaged(spark.createDataFrame(rows, "task long, seen long, weights binary"))
    whole = sum(p["seen"] for p in parts)
    mean = sum(np.frombuffer(p["weights"], "<f4") * p["seen"] for p in parts) / whole
    assert len(parts) <= 3 and whole == 210 and np.allclose(mean, sum(i * (i + 1) for i in range(20)) / 210, rtol=1e-5)


def test_empty_table(spark):
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
