"""A linear-chain conditional random field with two states, trained and decoded on flat arrays.

An item (a block or line) has hashed features with values; its score for
state 1 against state 0 is the weighted sum of them.  Transitions have four
weights, starts and ends two each.  All sequences of a batch go through the
recursions together, padded to the longest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments, which may be empty."""
    total = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


@dataclass
class Sequences:
    """Items of many sequences.

    Item i has the features ``ids[bounds[i]:bounds[i + 1]]`` with value 1 and
    ``words[word_bounds[i]:word_bounds[i + 1]]`` with value ``scale[i]``;
    ``ends`` cuts the items into sequences.
    """

    ids: np.ndarray
    bounds: np.ndarray
    words: np.ndarray
    word_bounds: np.ndarray
    scale: np.ndarray
    ends: np.ndarray

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return _sums(weights[self.ids], self.bounds) + self.scale * _sums(weights[self.words], self.word_bounds)

    def spread(self, off: np.ndarray, size: int) -> np.ndarray:
        """What a deviation of each item adds to each feature: the transpose of :meth:`scores`."""
        one = np.repeat(off, np.diff(self.bounds))
        two = np.repeat(off * self.scale, np.diff(self.word_bounds))
        return np.bincount(self.ids, weights=one, minlength=size) + np.bincount(self.words, weights=two, minlength=size)


def _padded(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of sequences by position, mask)."""
    lengths = np.diff(ends)
    mask = np.arange(lengths.max(initial=1))[None, :] < lengths[:, None]
    out = np.zeros(mask.shape)
    out[mask] = flat
    return out, mask


class Chain:
    """Weights of the field: ``w`` of the features, ``trans[a, b]``, ``start[a]`` and ``end[a]``."""

    def __init__(self, size: int):
        self.w = np.zeros(size)
        self.trans, self.start, self.end = np.zeros((2, 2)), np.zeros(2), np.zeros(2)

    def decode(self, data: Sequences) -> np.ndarray:
        """The likeliest states (Viterbi), one for each item; ties go to state 0."""
        flat = data.scores(self.w)
        lengths = np.diff(data.ends)
        out = np.zeros(len(flat), bool)
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        for at in range(0, len(order), 256):  # sequences of like length together
            part = order[at : at + 256]
            spans = [np.arange(data.ends[s], data.ends[s + 1]) for s in part]
            score, mask = _padded(flat[np.concatenate(spans)], np.concatenate([[0], np.cumsum(lengths[part])]))
            out[np.concatenate(spans)] = self._viterbi(score, mask)[mask]
        return out

    def _viterbi(self, score: np.ndarray, mask: np.ndarray) -> np.ndarray:
        n, t = score.shape
        last = mask.sum(1) - 1
        best = np.stack([np.full(n, self.start[0]), self.start[1] + score[:, 0]], axis=1)
        back = np.zeros((n, t, 2), np.int8)
        final = np.zeros((n, 2))
        final[last == 0] = best[last == 0]
        for k in range(1, t):
            paths = best[:, :, None] + self.trans[None]
            back[:, k] = paths[:, 1] > paths[:, 0]
            best = paths.max(1)
            best[:, 1] += score[:, k]
            final[last == k] = best[last == k]
        state = ((final + self.end)[:, 1] > (final + self.end)[:, 0]).astype(np.int8)
        states = np.zeros((n, t), bool)
        rows = np.arange(n)
        for k in range(t - 1, -1, -1):
            live = k <= last
            states[live, k] = state[live] == 1
            state = np.where(live, back[rows, k, state], state) if k else state
        return states

    def fit(self, data: Sequences, truth: np.ndarray, rounds: int = 120, rate: float = 0.15, penalty: float = 0.02) -> "Chain":
        """Maximum likelihood with an L2 penalty, by full-batch Adam."""
        labels, mask = _padded(truth.astype(float), data.ends)
        labels = labels.astype(int)
        n = len(labels)
        last = mask.sum(1) - 1
        rows = np.arange(n)
        params = [self.w, self.trans, self.start, self.end]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        seen = np.zeros_like(self.trans)
        both = mask[:, 1:]
        np.add.at(seen, (labels[:, :-1][both], labels[:, 1:][both]), 1)
        for step in range(1, rounds + 1):
            score, _ = _padded(data.scores(self.w), data.ends)
            p1, pair = self._marginals(score, mask, last)
            off = (labels - p1)[mask]
            grads = [
                data.spread(off, len(self.w)) / n,
                (seen - pair) / n,
                np.array([np.mean(labels[:, 0] == a) - np.mean(p1[:, 0] if a else 1 - p1[:, 0]) for a in (0, 1)]),
                np.array([np.mean(labels[rows, last] == a) - np.mean(p1[rows, last] if a else 1 - p1[rows, last]) for a in (0, 1)]),
            ]
            for i, (p, g) in enumerate(zip(params, grads)):
                g = g - penalty * p / max(1.0, n**0.5)
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                p += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8) * min(1.0, 3.0 * (1 - step / (rounds + 1)))
        return self

    def _marginals(self, score: np.ndarray, mask: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of state 1 by position, expected transition counts)."""
        n, t = score.shape
        emit = np.stack([np.zeros_like(score), score], axis=2)
        fwd, bwd = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        fwd[:, 0] = self.start + emit[:, 0]
        for k in range(1, t):
            fwd[:, k] = np.logaddexp(fwd[:, k - 1, 0, None] + self.trans[0], fwd[:, k - 1, 1, None] + self.trans[1]) + emit[:, k]
        rows = np.arange(n)
        total = np.logaddexp(*(fwd[rows, last] + self.end).T)
        for k in range(t - 1, -1, -1):
            if k + 1 < t:
                nxt = bwd[:, k + 1] + emit[:, k + 1]
                bwd[:, k] = np.logaddexp(self.trans[:, 0] + nxt[:, 0, None], self.trans[:, 1] + nxt[:, 1, None])
            bwd[last == k, k] = self.end
        p1 = np.exp(np.clip(fwd[:, :, 1] + bwd[:, :, 1] - total[:, None], -700, 0)) * mask
        pair = np.zeros((2, 2))
        both = mask[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                joint = fwd[:, :-1, a] + self.trans[a, b] + emit[:, 1:, b] + bwd[:, 1:, b] - total[:, None]
                pair[a, b] = np.exp(np.clip(joint[both], -700, 0)).sum()
        return p1, pair
