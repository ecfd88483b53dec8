"""A small character-level bidirectional LSTM with a linear-chain CRF, in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """signs: characters are given as numbers below it. Labels are numbers; `banned` pairs of labels never follow one
    another."""

    def __init__(self, signs: int, labels: int, hidden: int = 16, banned: list[tuple[int, int]] = (), seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden, self.labels = hidden, labels
        self.p = {"A": np.zeros((labels, labels)), "c": np.zeros(labels), "V": rng.normal(0, 0.3, (2 * hidden, labels))}
        for d in "fb":
            self.p[f"W{d}"] = rng.normal(0, 0.4, (signs, 4 * hidden))
            self.p[f"U{d}"] = rng.normal(0, 0.25, (hidden, 4 * hidden))
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1
            self.p[f"b{d}"] = bias
        self.mask = np.zeros((labels, labels))
        for a, b in banned:
            self.mask[a, b] = -1e4

    def _lstm(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        n, t = x.shape
        h, c, k = np.zeros((n, self.hidden)), np.zeros((n, self.hidden)), self.hidden
        out = np.empty((n, t, k))
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = self.p[f"W{d}"][x[:, s]] + h @ self.p[f"U{d}"] + self.p[f"b{d}"]
            ifo, g = _sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
            i, f, o = ifo[:, :k], ifo[:, k : 2 * k], ifo[:, 2 * k :]
            before = (h, c)
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, s] = h
            if keep is not None:
                keep.append((s, i, f, o, g, tc, *before))
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._lstm(x, "f"), self._lstm(x, "b")], axis=2) @ self.p["V"] + self.p["c"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi labels of each row."""
        e, a = self.emissions(x), self.p["A"] + self.mask
        n, t, _ = e.shape
        score, back = e[:, 0], np.zeros((n, t, self.labels), np.int8)
        for s in range(1, t):
            every = score[:, :, None] + a
            back[:, s] = every.argmax(axis=1)
            score = every.max(axis=1) + e[:, s]
        out = np.empty((n, t), np.int64)
        out[:, -1] = score.argmax(axis=1)
        for s in range(t - 1, 0, -1):
            out[:, s - 1] = back[np.arange(n), s, out[:, s]]
        return out

    def marginals(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The posterior of each place's label in y, by the forward and backward sums of all labellings."""
        alpha, beta, z = self._sums(self.emissions(x))
        rows, steps = np.arange(len(x))[:, None], np.arange(x.shape[1])[None]
        return np.exp(alpha + beta - z[:, None, None])[rows, steps, y]

    def _sums(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, a = e.shape[1], self.p["A"] + self.mask
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for s in range(1, t):
            alpha[:, s] = _lse(alpha[:, s - 1, :, None] + a, 1) + e[:, s]
        for s in range(t - 2, -1, -1):
            beta[:, s] = _lse(a + (e[:, s + 1] + beta[:, s + 1])[:, None, :], 2)
        return alpha, beta, _lse(alpha[:, -1], 1)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        n, t = x.shape
        keep = {"f": [], "b": []}
        both = np.concatenate([self._lstm(x, d, keep[d]) for d in "fb"], axis=2)
        e, a = both @ self.p["V"] + self.p["c"], self.p["A"] + self.mask
        alpha, beta, z = self._sums(e)
        de = np.exp(alpha + beta - z[:, None, None])
        rows, steps = np.arange(n)[:, None], np.arange(t)[None]
        gold = e[rows, steps, y].sum() + a[y[:, :-1], y[:, 1:]].sum()
        de[rows, steps, y] -= 1
        da = np.zeros_like(a)
        for s in range(1, t):
            da += np.exp(alpha[:, s - 1, :, None] + a + (e[:, s] + beta[:, s])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(da, (y[:, :-1], y[:, 1:]), -1)
        g = {"A": da, "c": de.sum(axis=(0, 1)), "V": np.einsum("ntk,ntl->kl", both, de)}
        dh_all, k = de @ self.p["V"].T, self.hidden
        for d, part in (("f", dh_all[..., :k]), ("b", dh_all[..., k:])):
            gw, gu, gb = np.zeros_like(self.p[f"W{d}"]), np.zeros_like(self.p[f"U{d}"]), np.zeros(4 * k)
            dh, dc = np.zeros((n, k)), np.zeros((n, k))
            for s, i, f, o, gg, tc, h0, c0 in reversed(keep[d]):
                dh = dh + part[:, s]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                np.add.at(gw, x[:, s], dz)
                gu += h0.T @ dz
                gb += dz.sum(axis=0)
                dh, dc = dz @ self.p[f"U{d}"].T, dc * f
            g |= {f"W{d}": gw, f"U{d}": gu, f"b{d}": gb}
        return (z.sum() - gold) / n, {q: v / n for q, v in g.items()}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, size: int = 96, rate: float = 0.025, seed: int = 5) -> float:
        """Adam on the CRF's negative log-likelihood; returns the last epoch's mean loss."""
        rng, step, loss = np.random.default_rng(seed), 0, 0.0
        m1 = {q: np.zeros_like(v) for q, v in self.p.items()}
        m2 = {q: np.zeros_like(v) for q, v in self.p.items()}
        for epoch in range(epochs):
            order, losses = rng.permutation(len(x)), []
            for at in range(0, len(x), size):
                own = order[at : at + size]
                loss, g = self._gradients(x[own], y[own])
                losses.append(loss)
                step += 1
                norm = np.sqrt(sum((v * v).sum() for v in g.values()))
                for q, v in g.items():
                    v = v * min(1.0, 5.0 / (norm + 1e-9))
                    m1[q] = 0.9 * m1[q] + 0.1 * v
                    m2[q] = 0.99 * m2[q] + 0.01 * v * v
                    self.p[q] -= rate * (0.97**epoch) * (m1[q] / (1 - 0.9**step)) / (np.sqrt(m2[q] / (1 - 0.99**step)) + 1e-8)
            loss = float(np.mean(losses))
        return loss
