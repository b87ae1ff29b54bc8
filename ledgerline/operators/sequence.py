"""Networks over K-step windows and over blocks, as models of ``training``: recurrent, attention, convolution."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .training import Arrays, log_loss, sigmoid


def _normal(rng: np.random.Generator, a: int, b: int) -> np.ndarray:
    return rng.normal(0, np.sqrt(1 / a), (a, b))


@dataclass(frozen=True)
class Recurrent:
    """A gated recurrence with cells (LSTM) over ``steps`` of ``width``; a masked step changes nothing.

    The state after the last valid step goes through dropout to one logit; without a valid step it is 0.
    """

    steps: int
    width: int
    hidden: int = 32

    def start(self, rng: np.random.Generator) -> Arrays:
        s = self.hidden
        b = np.zeros(4 * s)
        b[s : 2 * s] = 1.0  # what is kept, at first
        return {"x": _normal(rng, self.width, 4 * s), "h": _normal(rng, s, 4 * s), "b": b, "w": _normal(rng, s, 1)[:, 0], "c": np.zeros(1)}

    def _states(self, p: Arrays, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        s, n = self.hidden, len(x)
        x = x.reshape(n, self.steps, self.width)
        h, c = np.zeros((n, s)), np.zeros((n, s))
        for t in range(self.steps):
            z = x[:, t] @ p["x"] + h @ p["h"] + p["b"]
            i, f, o, g = sigmoid(z[:, :s]), sigmoid(z[:, s : 2 * s]), sigmoid(z[:, 2 * s : 3 * s]), np.tanh(z[:, 3 * s :])
            new = f * c + i * g
            m = mask[:, t : t + 1]
            if keep is not None:
                keep.append((x[:, t], h, c, i, f, o, g, np.tanh(new), m))
            c, h = m * new + (1 - m) * c, m * (o * np.tanh(new)) + (1 - m) * h
        return h

    def logits(self, p: Arrays, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self._states(p, x, mask) @ p["w"] + p["c"][0]

    def gradient(self, p: Arrays, x: np.ndarray, mask: np.ndarray, y: np.ndarray, scale: np.ndarray, keep) -> tuple[Arrays, float]:
        held: list = []
        h = self._states(p, x, mask, held)
        drop = keep("state", self.hidden)
        loss, dz = log_loss((h * drop) @ p["w"] + p["c"][0], y, scale)
        out = {"x": np.zeros_like(p["x"]), "h": np.zeros_like(p["h"]), "b": np.zeros_like(p["b"]), "w": (h * drop).T @ dz, "c": np.array([dz.sum()])}
        dh, dc = dz[:, None] * p["w"] * drop, np.zeros_like(h)
        for x_, h_, c_, i, f, o, g, tc, m in reversed(held):
            new = m * dc + m * dh * o * (1 - tc * tc)
            da = np.concatenate([new * g * i * (1 - i), new * c_ * f * (1 - f), m * dh * tc * o * (1 - o), new * i * (1 - g * g)], 1)
            out["x"] += x_.T @ da
            out["h"] += h_.T @ da
            out["b"] += da.sum(0)
            dh, dc = (1 - m) * dh + da @ p["h"].T, (1 - m) * dc + new * f
        return out, loss


@dataclass(frozen=True)
class Attention:
    """One block of scaled dot-product self-attention with positions and a key mask, a feed-forward part, the mean of valid steps.

    Both parts are added to what goes in; a masked step is neither attended to nor in the mean; without a valid step the mean is 0.
    """

    steps: int
    width: int
    hidden: int = 32
    heads: int = 4

    def start(self, rng: np.random.Generator) -> Arrays:
        d = self.hidden
        square = {k: _normal(rng, d, d) for k in ("q", "k", "v", "o")}
        return {"i": _normal(rng, self.width, d), "ib": np.zeros(d), **square, "f": _normal(rng, d, 2 * d), "fb": np.zeros(2 * d), "g": _normal(rng, 2 * d, d), "gb": np.zeros(d), "w": _normal(rng, d, 1)[:, 0], "c": np.zeros(1)}

    def _positions(self) -> np.ndarray:
        t, j = np.arange(self.steps)[:, None], np.arange(self.hidden)[None, :]
        angle = t / 10000 ** (2 * (j // 2) / self.hidden)
        return np.where(j % 2 == 0, np.sin(angle), np.cos(angle))

    def _forward(self, p: Arrays, x: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        n, split = len(x), lambda a: a.reshape(len(a), self.steps, self.heads, -1).transpose(0, 2, 1, 3)
        x = x.reshape(n, self.steps, self.width)
        e = x @ p["i"] + p["ib"] + self._positions()
        q, k, v = split(e @ p["q"]), split(e @ p["k"]), split(e @ p["v"])
        s = q @ k.transpose(0, 1, 3, 2) / np.sqrt(q.shape[-1]) + np.where(mask > 0, 0.0, -1e9)[:, None, None, :]
        a = np.exp(s - s.max(-1, keepdims=True))
        a /= a.sum(-1, keepdims=True)
        z = (a @ v).transpose(0, 2, 1, 3).reshape(n, self.steps, -1)
        r = e + z @ p["o"]
        u = r @ p["f"] + p["fb"]
        out = r + np.maximum(u, 0) @ p["g"] + p["gb"]
        share = mask / np.maximum(mask.sum(1, keepdims=True), 1)
        return {"x": x, "e": e, "q": q, "k": k, "v": v, "a": a, "z": z, "r": r, "u": u, "share": share, "mean": (out * share[:, :, None]).sum(1)}

    def logits(self, p: Arrays, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self._forward(p, x, mask)["mean"] @ p["w"] + p["c"][0]

    def gradient(self, p: Arrays, x: np.ndarray, mask: np.ndarray, y: np.ndarray, scale: np.ndarray, keep) -> tuple[Arrays, float]:
        m = self._forward(p, x, mask)
        drop = keep("mean", self.hidden)
        loss, dz = log_loss((m["mean"] * drop) @ p["w"] + p["c"][0], y, scale)
        by = lambda a, b: np.einsum("nti,ntj->ij", a, b)
        join = lambda a: a.transpose(0, 2, 1, 3).reshape(len(a), self.steps, -1)
        dout = m["share"][:, :, None] * (dz[:, None] * p["w"] * drop)[:, None, :]
        du = (dout @ p["g"].T) * (m["u"] > 0)
        dr = dout + du @ p["f"].T
        dctx = (dr @ p["o"].T).reshape(len(x), self.steps, self.heads, -1).transpose(0, 2, 1, 3)
        da = dctx @ m["v"].transpose(0, 1, 3, 2)
        ds = m["a"] * (da - (da * m["a"]).sum(-1, keepdims=True)) / np.sqrt(m["q"].shape[-1])
        dq, dk, dv = join(ds @ m["k"]), join(ds.transpose(0, 1, 3, 2) @ m["q"]), join(m["a"].transpose(0, 1, 3, 2) @ dctx)
        de = dr + dq @ p["q"].T + dk @ p["k"].T + dv @ p["v"].T
        return {
            "i": by(m["x"], de), "ib": de.sum((0, 1)), "q": by(m["e"], dq), "k": by(m["e"], dk), "v": by(m["e"], dv), "o": by(m["z"], dr), "f": by(m["r"], du), "fb": du.sum((0, 1)),
            "g": by(np.maximum(m["u"], 0), dout), "gb": dout.sum((0, 1)), "w": (m["mean"] * drop).T @ dz, "c": np.array([dz.sum()]),
        }, loss


@dataclass(frozen=True)
class Convolution:
    """A 3 x 3 convolution with a border of zeros over (channels, 3, 3) blocks, normalised, pooled to its largest by map, then dense.

    Normalisation is by mean and variance of each map over all training rows and places: sums of a pass, aggregated over
    tasks, that the next pass uses as constants, so that a pass is enough for an epoch.
    """

    channels: int = 10
    maps: int = 16
    hidden: int = 16
    stats = ("mean", "square")

    def start(self, rng: np.random.Generator) -> Arrays:
        c, k, d = self.channels, self.maps, self.hidden
        return {"k": _normal(rng, 9 * c, k), "s": np.ones(k), "t": np.zeros(k), "d": _normal(rng, k, d), "db": np.zeros(d), "w": _normal(rng, d, 1)[:, 0], "c": np.zeros(1), "mean": np.zeros(k), "square": np.ones(k)}

    def patches(self, x: np.ndarray) -> np.ndarray:
        """(rows, 9 places, 9 * channels): what lies under the kernel at each place."""
        n = len(x)
        wide = np.zeros((n, self.channels, 5, 5))
        wide[:, :, 1:4, 1:4] = x.reshape(n, self.channels, 3, 3)
        return np.stack([wide[:, :, i : i + 3, j : j + 3].reshape(n, -1) for i in range(3) for j in range(3)], 1)

    def _forward(self, p: Arrays, x: np.ndarray) -> dict[str, np.ndarray]:
        under = self.patches(x)
        z = under @ p["k"]
        spread = np.sqrt(np.maximum(p["square"] - p["mean"] ** 2, 0) + 1e-5)
        unit = (z - p["mean"]) / spread
        u = unit * p["s"] + p["t"]
        at = u.argmax(1)
        pooled = np.take_along_axis(u, at[:, None, :], 1)[:, 0]
        a = np.maximum(pooled, 0)
        v = a @ p["d"] + p["db"]
        return {"under": under, "z": z, "unit": unit, "spread": spread, "at": at, "pooled": pooled, "a": a, "v": v, "b": np.maximum(v, 0)}

    def logits(self, p: Arrays, x: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        return self._forward(p, x)["b"] @ p["w"] + p["c"][0]

    def gradient(self, p: Arrays, x: np.ndarray, mask: np.ndarray | None, y: np.ndarray, scale: np.ndarray, keep) -> tuple[Arrays, float]:
        m = self._forward(p, x)
        drop = keep("dense", self.hidden)
        loss, dz = log_loss((m["b"] * drop) @ p["w"] + p["c"][0], y, scale)
        dv = dz[:, None] * p["w"] * drop * (m["v"] > 0)
        da = (dv @ p["d"].T) * (m["pooled"] > 0)
        unit = np.take_along_axis(m["unit"], m["at"][:, None, :], 1)[:, 0]
        dk = np.zeros_like(p["k"])
        back = da * p["s"] / m["spread"]
        for place in range(9):
            dk += m["under"][:, place].T @ (back * (m["at"] == place))
        return {"k": dk, "s": (da * unit).sum(0), "t": da.sum(0), "d": m["a"].T @ dv, "db": dv.sum(0), "w": (m["b"] * drop).T @ dz, "c": np.array([dz.sum()])}, loss

    def sums(self, p: Arrays, x: np.ndarray, mask: np.ndarray | None) -> Arrays:
        z = self.patches(x) @ p["k"]
        return {"mean": z.sum((0, 1)), "square": (z * z).sum((0, 1))}

    def settle(self, held: Arrays, sums: Arrays, n: int) -> Arrays:
        return {k: sums[k] / (9 * n) for k in self.stats}
