"""A bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of hashed embeddings of itself, of its beginnings and of its
byte trigrams (the character input).  One recurrent pass runs each way over a window
of words; softmax attention pools the joined states; a linear unit gives the logit.
"""

from __future__ import annotations

import numpy as np

BUCKETS = 1 << 16
DIM, HIDDEN = 16, 16
WORD_BYTES = 24
STARTS = (4, 7)
FEATURES = 1 + len(STARTS) + WORD_BYTES - 2


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights), both (words, FEATURES), of words of at most WORD_BYTES bytes."""
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    data = np.zeros((n, WORD_BYTES), np.uint64)
    inside = np.arange(WORD_BYTES) < sizes[:, None]
    data[inside] = np.frombuffer(b"".join(words), np.uint8)
    ids = np.zeros((n, FEATURES), np.uint64)
    weights = np.zeros((n, FEATURES), np.float32)
    rolling = np.full(n, 1469598103934665603, np.uint64)
    starts = dict(zip(STARTS, range(1, 1 + len(STARTS))))
    for i in range(WORD_BYTES):
        rolling = np.where(inside[:, i], (rolling ^ data[:, i]) * np.uint64(1099511628211), rolling)
        if i + 1 in starts:
            ids[:, starts[i + 1]] = rolling + np.uint64(7 * (i + 1))
            weights[:, starts[i + 1]] = sizes > i + 1
    ids[:, 0] = rolling
    weights[:, 0] = 1
    first = 1 + len(STARTS)
    ids[:, first:] = (data[:, :-2] << np.uint64(16) | data[:, 1:-1] << np.uint64(8) | data[:, 2:]) * np.uint64(0x9E3779B97F4A7C15)
    weights[:, first:] = inside[:, 2:] / np.maximum(sizes - 2, 1)[:, None]
    return ((ids ^ ids >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.uint16), weights


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.float32(1) / (np.float32(1) + np.exp(-x))


def _tanh(x: np.ndarray) -> np.ndarray:
    """By the exponential, which numpy does faster than its own hyperbolic tangent."""
    return np.float32(2) * _sigmoid(np.float32(2) * x) - np.float32(1)


def initial(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    def around(*shape, scale):
        return r.normal(0, scale, shape).astype(np.float32)
    return {"E": around(BUCKETS, DIM, scale=0.1), "W": around(2, DIM, 3 * HIDDEN, scale=DIM ** -0.5), "c": np.zeros((2, 3 * HIDDEN), np.float32),
            "U": around(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN ** -0.5), "v": around(2 * HIDDEN, scale=0.1),
            "w": around(2 * HIDDEN, scale=0.3), "b": np.zeros(1, np.float32)}


def embed(p: dict[str, np.ndarray], ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.einsum("nf,nfd->nd", weights, p["E"][ids], optimize=False)


def project(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """(words, 2, 3 HIDDEN): what both passes add to their gates for a word."""
    return np.stack([x @ p["W"][d] + p["c"][d] for d in (0, 1)], 1)


def states(p: dict[str, np.ndarray], gates: np.ndarray, order: np.ndarray, live: np.ndarray, keep: bool = False):
    """States of both passes, (steps, windows, 2 HIDDEN).

    gates: projections of the words met; order: (windows, steps) rows of it, windows
    by falling length; live: number of windows that reach each step.
    """
    steps, n = len(live), len(order)
    out = np.zeros((steps, n, 2 * HIDDEN), np.float32)
    kept = []
    for d in (0, 1):
        h = np.zeros((n, HIDDEN), np.float32)
        own, saved = slice(d * HIDDEN, (d + 1) * HIDDEN), [None] * steps
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            m = live[t]
            x, was = gates[order[:m, t], d], h[:m]
            u = was @ p["U"][d]
            zr = _sigmoid(x[:, :2 * HIDDEN] + u[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            cand = _tanh(x[:, 2 * HIDDEN:] + r * u[:, 2 * HIDDEN:])
            if keep:
                saved[t] = (was.copy(), z, r, cand, u[:, 2 * HIDDEN:])
            h[:m] = cand + z * (was - cand)
            out[t, :m, own] = h[:m]
        kept.append(saved)
    return (out, kept) if keep else out


def pooled(p: dict[str, np.ndarray], out: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pooled states, attention (steps, windows))."""
    score = out @ p["v"]
    for t, m in enumerate(live):
        score[t, m:] = -np.inf
    a = np.exp(score - score.max(0))
    a /= a.sum(0)
    return np.einsum("tn,tnh->nh", a, out, optimize=False), a


def logits(p: dict[str, np.ndarray], gates: np.ndarray, order: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Logit of each window; windows in any order of length."""
    by = np.argsort(-sizes, kind="stable")
    steps = int(sizes.max())
    live = np.searchsorted(-sizes[by], -np.arange(steps), side="left")
    pool, _ = pooled(p, states(p, gates, order[by, :steps], live), live)
    result = np.empty(len(by), np.float32)
    result[by] = pool @ p["w"] + p["b"]
    return result


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows and the sums of their values."""
    by = np.argsort(rows, kind="stable")
    rows = rows[by]
    heads = np.concatenate(([0], np.nonzero(np.diff(rows))[0] + 1))
    return rows[heads], np.add.reduceat(values[by], heads, axis=0)


def train(ids: np.ndarray, weights: np.ndarray, windows: np.ndarray, sizes: np.ndarray, labels: np.ndarray,
          steps: int, batch: int, seed: int, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Fit to windows (n, length) of rows of ids, half of each batch from either label."""
    p, r = initial(seed), np.random.default_rng(seed + 1)
    dense = [k for k in p if k != "E"]
    m1, m2 = ({k: np.zeros_like(p[k]) for k in dense} for _ in range(2))
    squares = np.full((BUCKETS, 1), 1e-3, np.float32)
    pools = [np.nonzero(labels == y)[0] for y in (0, 1)]
    for step in range(1, steps + 1):
        pick = np.concatenate([r.choice(x, batch // 2) for x in pools])
        pick = pick[np.argsort(-sizes[pick], kind="stable")]
        n, length = sizes[pick], int(sizes[pick[0]])
        live = np.searchsorted(-n, -np.arange(length), side="left")
        words, order = np.unique(windows[pick, :length], return_inverse=True)
        order = order.reshape(len(pick), length)
        x = embed(p, ids[words], weights[words])
        gates = project(p, x)
        out, kept = states(p, gates, order, live, True)
        pool, a = pooled(p, out, live)
        prob = _sigmoid(pool @ p["w"] + p["b"])
        err = ((prob - labels[pick]) / len(pick)).astype(np.float32)
        g = {"w": pool.T @ err, "b": np.array([err.sum()], np.float32), "U": np.zeros_like(p["U"]), "W": np.zeros_like(p["W"]), "c": np.zeros_like(p["c"])}
        dpool = err[:, None] * p["w"]
        through = np.einsum("tnh,nh->tn", out, dpool, optimize=False)
        dscore = a * (through - (a * through).sum(0))
        g["v"] = np.einsum("tn,tnh->h", dscore, out, optimize=False)
        dout = a[:, :, None] * dpool + dscore[:, :, None] * p["v"]
        dgates = np.zeros_like(gates)
        for d in (0, 1):
            dh = np.zeros((len(pick), HIDDEN), np.float32)
            own, rows, values = slice(d * HIDDEN, (d + 1) * HIDDEN), [], []
            for t in range(length - 1, -1, -1) if d == 0 else range(length):
                m = live[t]
                was, z, rr, cand, un = kept[d][t]
                dn = dh[:m] + dout[t, :m, own]
                dcand = dn * (1 - z) * (1 - cand * cand)
                dz = dn * (was - cand) * z * (1 - z)
                dr = dcand * un * rr * (1 - rr)
                du = np.concatenate((dz, dr, dcand * rr), 1)
                g["U"][d] += was.T @ du
                rows.append(order[:m, t])
                values.append(np.concatenate((dz, dr, dcand), 1))
                dh[:m] = dn * z + du @ p["U"][d].T
            met, total = _summed(np.concatenate(rows), np.concatenate(values))
            dgates[met, d] = total
        dx = np.zeros_like(x)
        for d in (0, 1):
            g["W"][d], g["c"][d] = x.T @ dgates[:, d], dgates[:, d].sum(0)
            dx += dgates[:, d] @ p["W"][d].T
        wide = weights[words][:, :, None] * dx[:, None, :]
        used = weights[words] > 0
        met, total = _summed(ids[words][used], wide[used])
        squares[met] += (total ** 2).mean(1, keepdims=True)
        p["E"][met] -= np.float32(0.1) * total / np.sqrt(squares[met])
        for k in dense:
            m1[k] += np.float32(0.1) * (g[k] - m1[k])
            m2[k] += np.float32(0.01) * (g[k] ** 2 - m2[k])
            p[k] -= (rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return p
