"""Recurrent block labeller: a bidirectional LSTM in numpy that reads a page's blocks and tells main body from the rest.

Both directions read the whole sequence, so that each block is judged with all of its page. Sequences of different
length run together, the shorter ones drop out of the step once they end.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

import numpy as np

WEIGHTS = Path(__file__).with_name("blocks.npz")
HIDDEN = 24


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class BiLSTM:
    """Weights by name: W* (inputs, 4 hidden), U* (hidden, 4 hidden), b* of either direction (f, r); V, c of the output."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.asarray(v, np.float32) for k, v in weights.items()}

    @classmethod
    def fresh(cls, inputs: int, hidden: int = HIDDEN, seed: int = 7) -> BiLSTM:
        rng, w = np.random.default_rng(seed), {}
        for d in "fr":
            w["W" + d] = rng.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * hidden))
            w["U" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            w["b" + d] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])  # gates i, f, o; input g
        w["V"], w["c"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, 1)), np.zeros(1)
        return cls(w)

    @staticmethod
    def layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequences by falling length: rows of each step (step, place) laid end to end, for both directions, and how many are live."""
        order = np.argsort(-lengths, kind="stable")
        size = lengths[order]
        begin = (np.cumsum(lengths) - lengths)[order]
        live = np.array([int((size > t).sum()) for t in range(int(size[0]) if len(size) else 0)], int)
        ahead = np.concatenate([begin[:n] + t for t, n in enumerate(live)]) if len(live) else np.zeros(0, int)
        back = np.concatenate([begin[:n] + size[:n] - 1 - t for t, n in enumerate(live)]) if len(live) else np.zeros(0, int)
        return ahead, back, live

    def _run(self, x: np.ndarray, rows: np.ndarray, live: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        h_size = self.w["U" + d].shape[0]
        z = (x @ self.w["W" + d] + self.w["b" + d])[rows]
        out = np.empty((len(rows), h_size), np.float32)
        n = live[0] if len(live) else 0
        h, c, at = np.zeros((n, h_size), np.float32), np.zeros((n, h_size), np.float32), 0
        for n in live:
            before, cell = h[:n], c[:n]
            a = z[at : at + n] + before @ self.w["U" + d]
            gates = _sigmoid(a[:, : 3 * h_size])
            i, f, o, g = gates[:, :h_size], gates[:, h_size : 2 * h_size], gates[:, 2 * h_size :], np.tanh(a[:, 3 * h_size :])
            c = f * cell + i * g
            tc = np.tanh(c)
            h = o * tc
            out[at : at + n] = h
            if keep is not None:
                keep.append((at, n, before, cell, i, f, o, g, tc))
            at += n
        return out

    def predict(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of main body for each row; lengths are the numbers of rows of the pages, none 0."""
        ahead, back, live = self.layout(lengths)
        both = np.empty((len(x), 2 * self.w["Uf"].shape[0]), np.float32)
        half = both.shape[1] // 2
        both[ahead, :half] = self._run(x, ahead, live, "f")
        both[back, half:] = self._run(x, back, live, "r")
        return _sigmoid(both @ self.w["V"] + self.w["c"])[:, 0]

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy and its gradient by each weight."""
        ahead, back, live = self.layout(lengths)
        half = self.w["Uf"].shape[0]
        both, kept = np.empty((len(x), 2 * half), np.float32), {"f": [], "r": []}
        both[ahead, :half] = self._run(x, ahead, live, "f", kept["f"])
        both[back, half:] = self._run(x, back, live, "r", kept["r"])
        p = _sigmoid(both @ self.w["V"] + self.w["c"])[:, 0]
        loss = float(-np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))
        dp = ((p - y) / len(y))[:, None].astype(np.float32)
        grad = {"V": both.T @ dp, "c": dp.sum(0)}
        dboth = dp @ self.w["V"].T
        for d, rows, part in (("f", ahead, slice(0, half)), ("r", back, slice(half, None))):
            dout, u = dboth[rows][:, part], self.w["U" + d]
            dz, du = np.empty((len(rows), 4 * half), np.float32), np.zeros_like(u)
            dh_next, dc_next = np.zeros((0, half), np.float32), np.zeros((0, half), np.float32)
            for at, n, before, cell, i, f, o, g, tc in reversed(kept[d]):
                dh = dout[at : at + n].copy()
                dh[: len(dh_next)] += dh_next
                dc = dh * o * (1 - tc * tc)
                dc[: len(dc_next)] += dc_next
                a = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                dz[at : at + n] = a
                du += before.T @ a
                dh_next, dc_next = a @ u.T, dc * f
            grad["U" + d], grad["b" + d] = du, dz.sum(0)
            grad["W" + d] = x[rows].T @ dz
        return loss, grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 9, batch: int = 64, rate: float = 4e-3, seed: int = 3, say=None):
        """Adam over batches of (rows, labels) of whole pages."""
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        total = epochs * (-(-len(pages) // batch))
        for epoch in range(epochs):
            losses = []
            order = rng.permutation(len(pages))
            for lo in range(0, len(order), batch):
                part = [pages[i] for i in order[lo : lo + batch]]
                x, y = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
                loss, grad = self.gradients(x, np.array([len(p[1]) for p in part]), y)
                losses.append(loss)
                step += 1
                now = rate * max(0.05, 1 - step / total)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            if say:
                say(f"epoch {epoch}: loss {np.mean(losses):.5f}")
        return self

    def save(self, path: Path = WEIGHTS) -> None:
        np.savez_compressed(path, **{k: a.astype(np.float16) for k, a in self.w.items()})


@lru_cache(maxsize=2)
def trained(path: str = str(WEIGHTS)) -> BiLSTM:
    with np.load(path) as f:
        return BiLSTM({k: f[k] for k in f.files})
