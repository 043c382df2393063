"""A bidirectional LSTM in numpy that labels each block of a page, and its training by Adam."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Weights = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fresh_weights(dim: int, hidden: int, seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    w: Weights = {"out": rng.normal(0, 0.1, (2 * hidden, 1)), "bias": np.zeros(1)}
    for d in "fb":
        w[f"x{d}"] = rng.normal(0, 1 / np.sqrt(dim), (dim, 4 * hidden))
        w[f"h{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        w[f"c{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])  # the forget gates begin open
    return {k: v.astype(np.float32) for k, v in w.items()}


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, pages, dim), the mask (steps, pages, 1), and the index that turns each page round within its length."""
    n = np.array([len(p) for p in pages])
    x = np.zeros((n.max(), len(pages), pages[0].shape[1]), np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i] = p
    t = np.arange(n.max())[:, None]
    return x, (t < n)[..., None].astype(np.float32), np.where(t < n, n - 1 - t, t)


def turned(x: np.ndarray, round_: np.ndarray) -> np.ndarray:
    return np.take_along_axis(x, round_[..., None], 0)


def _run(x: np.ndarray, mask: np.ndarray, w: Weights, d: str) -> tuple[np.ndarray, list]:
    hidden = w[f"h{d}"].shape[0]
    h = c = np.zeros((x.shape[1], hidden), np.float32)
    pre, out, kept = x @ w[f"x{d}"] + w[f"c{d}"], [], []
    for t in range(len(x)):
        z = pre[t] + h @ w[f"h{d}"]
        i, f, o, g = sigmoid(z[:, :hidden]), sigmoid(z[:, hidden : 2 * hidden]), sigmoid(z[
            :, 2 * hidden : 3 * hidden,
        ]), np.tanh(z[:, 3 * hidden :])
        c2 = f * c + i * g
        y = np.tanh(c2)
        kept.append((h, c, i, f, o, g, y))
        m = mask[t]
        c, h = m * c2 + (1 - m) * c, m * (o * y) + (1 - m) * h
        out.append(h)
    return np.stack(out), kept


def _back(x: np.ndarray, mask: np.ndarray, w: Weights, d: str, kept: list, dout: np.ndarray, grad: Weights) -> None:
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    dz_all = np.zeros((*x.shape[:2], w[f"c{d}"].shape[0]), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, g, y = kept[t]
        m = mask[t]
        dh = dh + dout[t]
        dh2 = dh * m
        dc2 = dc * m + dh2 * o * (1 - y * y)
        dz = np.concatenate(
            [dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), dh2 * y * o * (1 - o), dc2 * i * (1 - g * g)], 1,
        )
        dz_all[t] = dz
        grad[f"h{d}"] += h.T @ dz
        dh, dc = dh * (1 - m) + dz @ w[f"h{d}"].T, dc * (1 - m) + dc2 * f
    grad[f"x{d}"] += np.tensordot(x, dz_all, ((0, 1), (0, 1)))
    grad[f"c{d}"] += dz_all.sum((0, 1))


def _read(
    x: np.ndarray, w: Weights, d: str, state: tuple[np.ndarray, np.ndarray],
) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """What one direction puts out for (steps, pages, dim) without padding, from a state on; only the outputs are kept."""
    hidden = w[f"h{d}"].shape[0]
    (h, c), turn = state, w[f"h{d}"]
    pre, out = x @ w[f"x{d}"] + w[f"c{d}"], np.empty((*x.shape[:2], hidden), np.float32)
    for t in range(len(x)):
        z = pre[t] + h @ turn
        gates = sigmoid(z[:, : 3 * hidden])
        c = gates[:, hidden : 2 * hidden] * c + gates[:, :hidden] * np.tanh(z[:, 3 * hidden :])
        h = out[t] = gates[:, 2 * hidden :] * np.tanh(c)
    return out, (h, c)


def long_logits(n: int, of: Callable[[int, int], np.ndarray], w: Weights, step: int) -> np.ndarray:
    """As logits, for one page of n blocks whose rows of(first, last) gives, `step` at a time: the rows are never held all at once."""
    hidden = w["hf"].shape[0]
    y = np.full(n, w["bias"][0], np.float32)
    none = np.zeros((1, hidden), np.float32)
    cuts = [(s, min(n, s + step)) for s in range(0, n, step)]
    for d, part, turn in (("f", slice(0, hidden), 1), ("b", slice(hidden, None), -1)):
        state = (none, none)
        for s, e in cuts[::turn]:
            out, state = _read(of(s, e)[::turn, None], w, d, state)
            y[s:e] += (out[::turn, 0] @ w["out"][part])[:, 0]
    return y


def logits(pages: list[np.ndarray], w: Weights) -> list[np.ndarray]:
    """For each page, a number for each block that is over 0 for main text."""
    x, mask, turn = padded(pages)
    both = np.concatenate([_run(x, mask, w, "f")[0], turned(_run(turned(x, turn), mask, w, "b")[0], turn)], 2)
    y = (both @ w["out"] + w["bias"])[..., 0]
    return [y[: len(p), i] for i, p in enumerate(pages)]


def gradient(pages: list[np.ndarray], labels: list[np.ndarray], w: Weights) -> tuple[float, Weights]:
    """Mean cross entropy of the blocks, and its gradient."""
    x, mask, turn = padded(pages)
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    back = turned(x, turn)
    f, f_kept = _run(x, mask, w, "f")
    b, b_kept = _run(back, mask, w, "b")
    both = np.concatenate([f, turned(b, turn)], 2)
    y = (both @ w["out"] + w["bias"])[..., 0]
    want = np.zeros_like(y)
    for i, k in enumerate(labels):
        want[: len(k), i] = k
    m, p = mask[..., 0], sigmoid(y)
    loss = float((m * (np.logaddexp(0, y) - want * y)).sum() / m.sum())
    dy = (m * (p - want) / m.sum())[..., None]
    grad["out"], grad["bias"] = np.tensordot(both, dy, ((0, 1), (0, 1))).reshape(-1, 1), dy.sum((0, 1))
    dboth, hidden = dy @ w["out"].T, f.shape[2]
    _back(x, mask, w, "f", f_kept, dboth[..., :hidden], grad)
    _back(back, mask, w, "b", b_kept, turned(dboth[..., hidden:], turn), grad)
    return loss, grad


def train(
    pages: list[np.ndarray], labels: list[np.ndarray], hidden: int, epochs: int, seed: int, lot: int = 32,
    rate: float = 0.01,
) -> Weights:
    rng = np.random.default_rng(seed)
    w = fresh_weights(pages[0].shape[1], hidden, seed)
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    order = sorted(range(len(pages)), key=lambda i: len(pages[i]))  # pages of like length go together, so little is padded
    lots = [order[at : at + lot] for at in range(0, len(order), lot)]
    for epoch in range(epochs):
        for of in (lots[i] for i in rng.permutation(len(lots))):
            _, grad = gradient([pages[i] for i in of], [labels[i] for i in of], w)
            step += 1
            now = rate * (1 - epoch / epochs) + 1e-4
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = (
                    w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                ).astype(np.float32)
    return w
