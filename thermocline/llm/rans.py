"""Static range asymmetric numeral system over token ids, interleaved and vectorised with numpy.

A stream of ids is cut into blocks of ``BLOCK`` ids. A block has ``LANES`` coder states that take turns, all with one
shared frequency table; renormalisation words of all lanes go to one sequence of 32-bit words in the order in which the
decoder wants them. Each block starts from its own states, so it is a checkpoint: blocks decode independently.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 32768
LANES = 128
SCALE_BITS = 20
LOWEST = np.uint64(1 << 31)
WORD_BITS = np.uint64(32)
TOGETHER = 64  # blocks that are coded side by side


def scaled_frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE_BITS; every id that occurs keeps a frequency of at least 1."""
    counts = np.asarray(counts, dtype=np.float64)
    total, whole = counts.sum(), 1 << SCALE_BITS
    if total == 0:
        return np.zeros(len(counts), dtype=np.uint32)
    seen = counts > 0
    if int(seen.sum()) > whole:
        raise ValueError("More ids than the frequency table has places.")
    scaled = np.where(seen, np.maximum(1, np.floor(counts / total * whole)), 0).astype(np.int64)
    while (over := int(scaled.sum()) - whole) != 0:
        order = np.argsort(-scaled, kind="stable")
        if over < 0:
            scaled[order[0]] -= over
        else:  # small counts were raised to 1: the largest pay for it
            cut = np.minimum(scaled[order] // 2, over)
            scaled[order] -= np.diff(np.concatenate([[0], np.minimum(np.cumsum(cut), over)]))
    return scaled.astype(np.uint32)


class Coder:
    """Encoder and decoder for one shared frequency table."""

    def __init__(self, frequencies: np.ndarray):
        self.freq = frequencies.astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.owner = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies) if self.freq.sum() else None

    def encode(self, ids: np.ndarray) -> list[tuple[int, bytes, int]]:
        """(ids, payload, CRC of the payload) for each block of ``ids``."""
        blocks = []
        for at in range(0, len(ids), BLOCK * TOGETHER):
            part = ids[at : at + BLOCK * TOGETHER]
            full = len(part) // BLOCK
            if full:
                blocks += self._encode(part[: full * BLOCK].reshape(full, BLOCK))
            if len(part) % BLOCK:
                blocks += self._encode(part[full * BLOCK :][None, :])
        return blocks

    def _encode(self, ids: np.ndarray) -> list[tuple[int, bytes, int]]:
        n, length = ids.shape
        steps = -(-length // LANES)
        state = np.full((n, LANES), LOWEST, dtype=np.uint64)
        words, rows = [], []
        limit_shift, scale = np.uint64(63 - SCALE_BITS), np.uint64(SCALE_BITS)
        for k in range(steps - 1, -1, -1):
            part = ids[:, k * LANES : (k + 1) * LANES]
            s = state[:, : part.shape[1]]
            freq, first = self.freq[part], self.first[part]
            if not freq.all():
                raise ValueError("An id has no place in the frequency table.")
            out = s >= (freq << limit_shift)
            # Read backwards by the decoder: lanes of a step are emitted from the last to the first.
            flipped = out[:, ::-1]
            words.append((s[:, ::-1][flipped] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            rows.append(flipped.sum(axis=1))
            s = np.where(out, s >> WORD_BITS, s)
            whole = s // freq
            state[:, : part.shape[1]] = (whole << scale) + (s - whole * freq) + first
        counts = np.array(rows)
        owner = np.concatenate([np.repeat(np.arange(n), c) for c in counts]) if len(counts) else np.zeros(0, int)
        every = np.concatenate(words) if words else np.zeros(0, "<u4")
        order = np.argsort(owner, kind="stable")
        every, ends = every[order], np.cumsum(counts.sum(axis=0))
        blocks = []
        for b in range(n):
            mine = every[ends[b] - counts[:, b].sum() : ends[b]][::-1]
            payload = state[b].astype("<u8").tobytes() + mine.tobytes()
            blocks.append((length, payload, zlib.crc32(payload)))
        return blocks

    def decode(self, blocks: list[tuple[int, bytes, int]]) -> np.ndarray:
        """All ids of the blocks, in order; raises if a checksum does not match."""
        parts: list[np.ndarray | None] = [None] * len(blocks)
        lengths = np.array([b[0] for b in blocks], dtype=np.int64)
        for length in np.unique(lengths):
            alike = np.flatnonzero(lengths == length)
            for at in range(0, len(alike), TOGETHER):
                chosen = alike[at : at + TOGETHER]
                for k, ids in zip(chosen, self._decode([blocks[k] for k in chosen], int(length))):
                    parts[k] = ids
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)

    def _decode(self, blocks: list[tuple[int, bytes, int]], length: int) -> np.ndarray:
        for _, payload, crc in blocks:
            if zlib.crc32(payload) != crc:
                raise ValueError("A block does not match its checksum.")
        n, steps = len(blocks), -(-length // LANES)
        state = np.stack([np.frombuffer(p, "<u8", LANES) for _, p, _ in blocks]).astype(np.uint64)
        words = [np.frombuffer(p, "<u4", offset=8 * LANES) for _, p, _ in blocks]
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])[:-1]]).astype(np.int64)
        every = np.concatenate([*words, np.zeros(1, "<u4")]).astype(np.uint64)
        ids = np.empty((n, length), dtype=np.uint32)
        mask, scale = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
        for k in range(steps):
            width = min(LANES, length - k * LANES)
            s = state[:, :width]
            slot = s & mask
            found = self.owner[slot]
            ids[:, k * LANES : k * LANES + width] = found
            s = self.freq[found] * (s >> scale) + slot - self.first[found]
            low = s < LOWEST
            place = at[:, None] + np.cumsum(low, axis=1) - 1
            state[:, :width] = np.where(low, (s << WORD_BITS) | every[np.where(low, place, 0)], s)
            at += low.sum(axis=1)
        return ids
