"""A linear-chain conditional random field in numpy: trained by gradient, decoded by Viterbi, both in batches.

Emission scores are sums of weight rows selected by hashed features (an integer matrix, one row for each position);
transitions are a full matrix with a start row.  Training maximises the penalised log-likelihood with AdaGrad over
mini-batches of sequences of similar length; it is deterministic.
"""

from __future__ import annotations

import numpy as np

#: Weight rows; features are hashed into them.
ROWS = 1 << 17


def _intern(values: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values below a bound, and the array of their places."""
    there = np.zeros(bound, bool)
    there[values] = True
    used = np.flatnonzero(there)
    place = np.zeros(bound, np.int32)
    place[used] = np.arange(len(used))
    return used, place[values]


class Crf:
    def __init__(self, labels: int, rows: int = ROWS) -> None:
        self.labels, self.rows = labels, rows
        self.weights = np.zeros((rows, labels), np.float32)
        self.moves = np.zeros((labels + 1, labels), np.float32)  # the last row starts a sequence

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """(positions, labels) for an integer matrix (positions, templates)."""
        out = np.zeros((len(features), self.labels), np.float32)
        for column in features.T:
            out += self.weights[column]
        return out

    @staticmethod
    def _pad(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, fill: float) -> np.ndarray:
        """(sequences, longest, ...) from rows that lie one sequence after the other."""
        longest = int(lengths.max())
        at = starts[:, None] + np.arange(longest)[None, :]
        inside = np.arange(longest)[None, :] < lengths[:, None]
        out = flat[np.where(inside, at, 0)]
        out[~inside] = fill
        return out

    def certain(self, emissions: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which sequences have label 0 everywhere as their best path, by a bound on every other path.

        Leaving the path of zeros costs or gains, at each position with another label, at most the difference of the
        emissions plus the best moves into that label and back; where no position can gain, no path can.
        """
        stay = self.moves[0, 0]
        into = np.maximum(self.moves[:-1].max(0) - stay, self.moves[-1] - self.moves[-1, 0])
        gain = emissions[:, 1:] - emissions[:, :1] + into[1:] + max(float(into[0]), 0.0)
        return np.maximum.reduceat(gain.max(1), starts) <= 0

    def decode(self, emissions: np.ndarray, lengths: np.ndarray, cells: int = 200_000) -> np.ndarray:
        """The best label of every position; ``emissions`` holds the sequences one after the other.

        Sequences are decoded together in order of length, as many at once as give ``cells`` positions after padding.
        """
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        best = np.zeros(len(emissions), np.int8)
        order = np.flatnonzero(lengths > 0)
        if not len(order):
            return best
        order = order[~self.certain(emissions, starts[order])]
        order = order[np.argsort(lengths[order], kind="stable")]
        moves = self.moves[:-1].T[None]  # to x from
        at = 0
        while at < len(order):
            size = 1
            while at + size < len(order) and (size + 1) * int(lengths[order[at + size]]) <= cells:
                size += 1
            rows, at = order[at : at + size], at + size
            own, long = lengths[rows], int(lengths[rows].max())
            scores = self._pad(emissions, starts[rows], own, 0.0)
            value = scores[:, 0] + self.moves[-1]
            back = np.zeros((long, len(rows), self.labels), np.int8)
            last = np.where(own == 1, value.argmax(1), 0)
            for t in range(1, long):
                steps = value[:, None, :] + moves
                back[t] = steps.argmax(2)
                value = steps.max(2) + scores[:, t]
                ends = own == t + 1
                if ends.any():
                    last[ends] = value[ends].argmax(1)
            label = last.copy()
            for t in range(long - 1, -1, -1):
                active = own > t
                best[starts[rows[active]] + t] = label[active]
                if t:
                    label = np.where(active, back[t, np.arange(len(rows)), label], label)
        return best

    def _gradient(self, features: np.ndarray, gold: np.ndarray, starts: np.ndarray, lengths: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the log-likelihood by position and by move of one batch."""
        long, n, size = int(lengths.max()), len(lengths), self.labels
        flat = self.emissions(features[positions]).astype(np.float64)
        flat = np.exp(flat - flat.max(1, keepdims=True))
        inner = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        weight = self._pad(flat, inner, lengths, 1.0)
        moves, start = np.exp(self.moves[:-1].astype(np.float64)), np.exp(self.moves[-1].astype(np.float64))
        # Scaled forward and backward probabilities; a sequence that has ended keeps its last ones.
        alpha, beta, scale = np.zeros((long, n, size)), np.ones((long, n, size)), np.ones((long, n))
        for t in range(long):
            x = weight[:, 0] * start if t == 0 else (alpha[t - 1] @ moves) * weight[:, t]
            total, going = x.sum(1), lengths > t
            scale[t] = np.where(going, total, 1.0)
            alpha[t] = np.where(going[:, None], x / total[:, None], alpha[t - 1] if t else x)
        for t in range(long - 2, -1, -1):
            x = ((beta[t + 1] * weight[:, t + 1]) @ moves.T) / scale[t + 1][:, None]
            beta[t] = np.where((lengths > t + 1)[:, None], x, 1.0)
        by_move, by_position = np.zeros_like(self.moves, np.float64), np.zeros((len(positions), size))
        for t in range(long):
            active = np.flatnonzero(lengths > t)
            marginal = alpha[t][active] * beta[t][active]
            at, truth = inner[active] + t, gold[starts[active] + t]
            by_position[at] -= marginal
            by_position[at, truth] += 1
            if t == 0:
                by_move[-1] += np.bincount(truth, minlength=size) - marginal.sum(0)
            else:
                right = weight[active, t] * beta[t][active] / scale[t][active][:, None]
                by_move[:-1] -= (alpha[t - 1][active].T @ right) * moves
                by_move[:-1] += np.bincount(gold[starts[active] + t - 1] * size + truth, minlength=size * size).reshape(size, size)
        return by_position, by_move

    def fit(self, features: np.ndarray, gold: np.ndarray, lengths: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.25, penalty: float = 2e-4, seed: int = 5) -> None:
        """Features are interned first, so a step only touches the rows that occur."""
        rows, compact = _intern(features, self.rows)
        full, self.weights = self.weights, np.zeros((len(rows), self.labels), np.float32)
        squares, move_squares = np.full(self.weights.shape, 1e-3, np.float32), np.full(self.moves.shape, 1e-3)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        order, rng = np.argsort(lengths, kind="stable"), np.random.default_rng(seed)
        batches = [order[i : i + batch] for i in range(0, len(order), batch)]
        rows_of = []  # the weight rows of each batch, which no epoch changes
        for at in batches:
            positions = np.concatenate([np.arange(s, s + k) for s, k in zip(starts[at], lengths[at], strict=True)])
            rows_of.append((positions, *_intern(compact[positions], len(rows))))
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                at = batches[k]
                positions, used, inverse = rows_of[k]
                by_position, by_move = self._gradient(compact, gold, starts[at], lengths[at], positions)
                grad = np.zeros((len(used), self.labels))
                flat, wide = inverse.ravel(), inverse.shape[1]
                for c in range(self.labels):
                    grad[:, c] = np.bincount(flat, np.repeat(by_position[:, c], wide), len(used))
                grad /= len(at)
                grad -= penalty * self.weights[used]
                squares[used] += grad**2
                self.weights[used] += rate * grad / np.sqrt(squares[used])
                by_move = by_move / len(at) - penalty * self.moves
                move_squares += by_move**2
                self.moves += (rate * by_move / np.sqrt(move_squares)).astype(np.float32)
        full[rows] = self.weights
        self.weights = full
