"""Small networks in numpy: a perceptron (128, 64, 16) and a recurrent network with gates over a sequence of signatures; fitted on a bounded sample."""

from __future__ import annotations

import numpy as np

from tidewright.models.oneclass import Scaler

#: Most training rows; the caller bounds its sample by it.
FIT_ROWS = 20_000


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float, decay: float):
        self.params, self.rate, self.decay = params, rate, decay
        self.m, self.v, self.t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            g = g + self.decay * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


class _Regressor:
    def __init__(self, decay: float = 1e-4, rate: float = 1e-3, epochs: int = 200, batch: int = 64, seed: int = 42):
        self.decay, self.rate, self.epochs, self.batch, self.seed = decay, rate, epochs, batch, seed

    def fit(self, x: np.ndarray, y: np.ndarray):
        if len(x) > FIT_ROWS:
            raise ValueError(f"more than {FIT_ROWS} training rows")
        rng = np.random.default_rng(self.seed)
        flat = x.reshape(-1, x.shape[-1])
        self.xs, self.ys = Scaler().fit(flat), (y.mean(), max(y.std(), 1e-12))
        x, y = self.xs(flat).reshape(x.shape), (y - self.ys[0]) / self.ys[1]
        self.params = self._start(x.shape[-1], rng)
        adam = Adam(self.params, self.rate, self.decay)
        for _ in range(self.epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), self.batch):
                rows = order[a : a + self.batch]
                adam.step(self._gradient(x[rows], y[rows]))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.xs(x.reshape(-1, x.shape[-1])).reshape(x.shape)
        return self._forward(z)[0] * self.ys[1] + self.ys[0]


class MLP(_Regressor):
    hidden = (128, 64, 16)

    def _start(self, width: int, rng: np.random.Generator) -> list[np.ndarray]:
        sizes = [width, *self.hidden, 1]
        return [p for a, b in zip(sizes, sizes[1:]) for p in (rng.uniform(-1, 1, (a, b)) / np.sqrt(a), np.zeros(b))]

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        acts = [x]
        for i in range(0, len(self.params), 2):
            z = acts[-1] @ self.params[i] + self.params[i + 1]
            acts.append(np.maximum(z, 0) if i + 2 < len(self.params) else z)
        return acts[-1][:, 0], acts

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        out, acts = self._forward(x)
        d = (2 / len(y) * (out - y))[:, None]
        grads: list[np.ndarray] = []
        for i in range(len(self.params) - 2, -1, -2):
            grads = [acts[i // 2].T @ d, d.sum(axis=0), *grads]
            if i:
                d = d @ self.params[i].T * (acts[i // 2] > 0)
        return grads


class SignatureLSTM(_Regressor):
    """Over (rows, steps, features); the last hidden state gives the prediction."""

    def __init__(self, hidden: int = 32, **settings: float):
        super().__init__(**settings)
        self.h = hidden

    def _start(self, width: int, rng: np.random.Generator) -> list[np.ndarray]:
        h, s = self.h, 1 / np.sqrt(self.h)
        return [rng.uniform(-s, s, (width + h, 4 * h)), np.zeros(4 * h), rng.uniform(-s, s, (h, 1)), np.zeros(1)]

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        w, b, v, c0 = self.params
        n, h = len(x), self.h
        hid, cell, trace = np.zeros((n, h)), np.zeros((n, h)), []
        for t in range(x.shape[1]):
            z = np.concatenate([x[:, t], hid], axis=1)
            g = z @ w + b
            i, f, o = (1 / (1 + np.exp(-np.clip(g[:, k * h : (k + 1) * h], -40, 40))) for k in range(3))
            u = np.tanh(g[:, 3 * h :])
            new = f * cell + i * u
            trace.append((z, i, f, o, u, cell, new))
            cell, hid = new, o * np.tanh(new)
        return (hid @ v + c0)[:, 0], [trace, hid]

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w, b, v, _ = self.params
        h = self.h
        out, (trace, hid) = self._forward(x)
        d = (2 / len(y) * (out - y))[:, None]
        gw, gb = np.zeros_like(w), np.zeros_like(b)
        gv, gc = hid.T @ d, d.sum(axis=0)
        dh, dc = d @ v.T, np.zeros_like(hid)
        for z, i, f, o, u, cell, new in reversed(trace):
            th = np.tanh(new)
            dc = dc + dh * o * (1 - th * th)
            g = np.concatenate([dc * u * i * (1 - i), dc * cell * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - u * u)], axis=1)
            gw += z.T @ g
            gb += g.sum(axis=0)
            dh, dc = (g @ w.T)[:, -h:], dc * f
        return [gw, gb, gv, gc]
