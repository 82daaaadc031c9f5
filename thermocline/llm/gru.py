"""Bidirectional gated recurrent networks in numpy, trained by backpropagation through time.

Gates use the hard sigmoid. Inputs are rows of tables (one per direction) that hold the three gates' shares, so a step costs a
lookup and one small product.
"""

from __future__ import annotations

import numpy as np


class Direction:
    """Parameters of one direction: U (H x 3H) and bias; inputs come in as (T, N, 3H)."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.U = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.b = np.zeros(3 * hidden, dtype=np.float32)

    def run(self, x: np.ndarray, keep: bool = False):
        """States (T, N, H) for inputs (T, N, 3H); with ``keep`` also what the backward pass needs."""
        steps, n, h = x.shape[0], x.shape[1], self.h
        out = np.empty((steps, n, h), dtype=np.float32)
        state, kept = np.zeros((n, h), dtype=np.float32), []
        for t in range(steps):
            a = state @ self.U
            gates = x[t, :, : 2 * h] + a[:, : 2 * h]
            gates *= 0.25
            gates += 0.5
            raw = gates.copy() if keep else None
            np.clip(gates, 0.0, 1.0, out=gates)
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[t, :, 2 * h :] + r * a[:, 2 * h :])
            if keep:
                kept.append((state, a[:, 2 * h :], raw, z, r, new))
            state = new + z * (state - new)
            out[t] = state
        return (out, kept) if keep else out

    def back(self, grad: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the inputs (T, N, 3H) and of U, from those of the states."""
        steps, n, h = grad.shape
        gx, gu = np.empty((steps, n, 3 * h), dtype=np.float32), np.zeros_like(self.U)
        carry = np.zeros((n, h), dtype=np.float32)
        for t in range(steps - 1, -1, -1):
            state, an, raw, z, r, new = kept[t]
            d = grad[t] + carry
            dn = d * (1 - z) * (1 - new * new)
            open_gates = ((raw > 0) & (raw < 1)) * np.float32(0.25)
            dz = d * (state - new) * open_gates[:, :h]
            dr = dn * an * open_gates[:, h:]
            gx[t] = np.concatenate([dz, dr, dn], axis=1)
            ga = np.concatenate([dz, dr, dn * r], axis=1)
            gu += state.T @ ga
            carry = d * z + ga @ self.U.T
        return gx, gu


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.k = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.k += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for p, m, v, g in zip(self.params, self.m, self.v, grads):
            g = g * np.float32(scale)
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.001) * (g * g - v)
            p -= np.float32(self.rate) * (m / np.float32(1 - 0.9**self.k)) / (np.sqrt(v / np.float32(1 - 0.999**self.k)) + np.float32(1e-8))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
