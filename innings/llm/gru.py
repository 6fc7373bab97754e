"""Gated recurrent networks in numpy: forward steps, back-propagation through time, Adam."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def chosen(h: np.ndarray, m: np.ndarray, at: np.ndarray, dh: np.ndarray | None = None, scale: float | None = None,
           block: int = 2048) -> tuple[np.ndarray, np.ndarray | None]:
    """Log of entry ``at`` of the softmax of ``h @ m``, row by row. The last column of ``h`` is one, the others lie
    between -1 and 1; they are worked through in blocks that stay near the processor.

    With ``dh`` the gradients of ``-scale`` times the sum: those of ``h`` (without the last column) are added to
    ``dh``, those of ``m`` returned.
    """
    bounded = np.abs(m).sum(0).max() < 80  # no entry overflows
    out, ones = np.empty(len(h), np.float32), np.ones(m.shape[1], np.float32)
    dm = None if dh is None else np.zeros_like(m)
    room = np.empty((min(block, len(h)), m.shape[1]), np.float32)
    for a in range(0, len(h), block):
        own, mine = h[a:a + block], at[a:a + block]
        rows, e = np.arange(len(own)), room[:len(own)]
        np.matmul(own, m, out=e)
        if not bounded:
            e -= e.max(axis=1, keepdims=True)
        hit = e[rows, mine]
        np.exp(e, out=e)
        total = e @ ones
        out[a:a + block] = hit - np.log(total)
        if dh is not None:
            e *= (scale / total)[:, None]
            e[rows, mine] -= scale
            dm += (e.T @ own).T
            dh[a:a + block] += e @ m[:-1].T
    return out, dm


def sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of ``values`` by their number ``at``, below ``n``."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    order = np.argsort(at.astype(np.uint16) if n <= 1 << 16 else at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    out[at[first]] = np.add.reduceat(np.take(values, order, axis=0), first, axis=0)
    return out


def step(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Next state. ``x``: inputs of the update, reset and candidate gates side by side; ``u``: state to the same."""
    k = h.shape[1]
    g = h @ u
    zr = x[:, :2 * k] + g[:, :2 * k]
    np.negative(zr, out=zr)
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    g = g[:, 2 * k:]
    g *= zr[:, k:]
    g += x[:, 2 * k:]
    np.tanh(g, out=g)
    return g + zr[:, :k] * (h - g)


def unrolled(x: np.ndarray, h: np.ndarray, u: np.ndarray, fresh: np.ndarray | None = None):
    """States after each step of ``x`` (steps, rows, gates), and what :func:`backward` needs.

    ``fresh`` (steps, rows): rows that forget their state before the step.
    """
    k = h.shape[1]
    states, cache = [], []
    for t, xt in enumerate(x):
        if fresh is not None and fresh[t].any():
            h = np.where(fresh[t][:, None], np.float32(0), h)
        g = h @ u
        zr = xt[:, :2 * k] + g[:, :2 * k]
        np.minimum(zr, 30, out=zr)
        np.maximum(zr, -30, out=zr)
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r, gn = zr[:, :k], zr[:, k:], g[:, 2 * k:]
        n = r * gn
        n += xt[:, 2 * k:]
        np.tanh(n, out=n)
        cache.append((h, z, r, n, gn))
        h = n + z * (h - n)
        states.append(h)
    return np.stack(states), cache


def backward(d_states: np.ndarray, cache: list, u: np.ndarray, fresh: np.ndarray | None = None
             ) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of ``u`` from those of the states, back through the steps to where a row was fresh."""
    k = u.shape[0]
    dx, du, dh = np.empty((len(cache), d_states.shape[1], 3 * k), np.float32), np.zeros_like(u), 0
    for t in range(len(cache) - 1, -1, -1):
        h, z, r, n, gn = cache[t]
        dh = dh + d_states[t]
        rest = 1 - z
        dn = n * n
        np.subtract(1, dn, out=dn)
        dn *= dh * rest
        dg = np.empty((len(dn), 3 * k), dn.dtype)
        dz, dr = dg[:, :k], dg[:, k:2 * k]
        np.subtract(h, n, out=dz)
        dz *= dh
        dz *= z
        dz *= rest
        np.multiply(dn, gn, out=dr)
        dr *= r
        dr *= 1 - r
        np.multiply(dn, r, out=dg[:, 2 * k:])
        dx[t, :, :2 * k] = dg[:, :2 * k]
        dx[t, :, 2 * k:] = dn
        du += h.T @ dg
        dh = dh * z + dg @ u.T
        if fresh is not None and fresh[t].any():
            dh = np.where(fresh[t][:, None], np.float32(0), dh)
    return dx, du


class Adam:
    """``kind``: the type of the last step's arithmetic. :meth:`update` changes the gradients that it is given."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, kind: type = np.float64):
        self.params, self.rate, self.kind, self.t = params, rate, kind, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}
        self.room = {k: np.empty_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray], limit: float = 5.0) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float(np.multiply(g, g, out=self.room[k]).sum()) for k, g in grads.items())))
        scale = min(1.0, limit / (norm + 1e-12))
        rate = self.kind(self.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t))
        for k, g in grads.items():
            m, v, room = self.m[k], self.v[k], self.room[k]
            g *= scale
            np.subtract(g, m, out=room)
            room *= 0.1
            m += room
            np.multiply(g, g, out=room)
            room -= v
            room *= 0.001
            v += room
            np.sqrt(v, out=room)
            room += 1e-8
            self.params[k] -= rate * m / room
