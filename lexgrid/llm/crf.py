"""Linear-chain conditional random fields over units with feature ids."""

from __future__ import annotations

import numpy as np


class LinearChain:
    """Emissions are sums of feature weights; transitions are learned.

    ``weights``: (features, labels); ``trans``: (labels, labels)."""

    def __init__(self, n_features: int, n_labels: int):
        self.weights = np.zeros((n_features, n_labels), np.float32)
        self.trans = np.zeros((n_labels, n_labels), np.float32)

    def emissions(self, units: np.ndarray) -> np.ndarray:
        """units: (n, f) feature ids, those under 0 are none."""
        w = np.vstack([self.weights, np.zeros((1, self.weights.shape[1]), np.float32)])
        return w[units].sum(1)

    @staticmethod
    def padded(emit: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(time, sequences, labels) and its mask from the sequences' rows one after another."""
        top, n = int(lengths.max()), len(lengths)
        seq = np.repeat(np.arange(n), lengths)
        time = np.arange(len(seq)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out = np.zeros((top, n, emit.shape[1]), np.float32)
        mask = np.zeros((top, n), bool)
        out[time, seq], mask[time, seq] = emit, True
        return out, mask

    def long_marginals(self, emit: np.ndarray, lengths: np.ndarray, step: int = 32) -> np.ndarray:
        """:meth:`marginals` of sequences of any length, and exactly these. A sequence is cut into spans of ``step`` units; each span's
        transfer matrix is made for all spans at once, messages go from span to span by these matrices, and each span
        is then solved between the messages that reach it."""
        counts = -(-lengths // step)
        spans = np.full(int(counts.sum()), step)
        last = np.cumsum(counts) - 1
        spans[last] = lengths - (counts - 1) * step
        if len(spans) == len(lengths):
            return self.marginals(emit, lengths)
        k = len(self.trans)
        e, mask = self.padded(emit, spans)
        e = np.exp((e - e.max(2, keepdims=True)).astype(np.float64))
        a = np.exp((self.trans - self.trans.max()).astype(np.float64))
        over = np.eye(k)[None] * e[0][:, None, :]
        for t in range(1, len(e)):
            x = (over @ a) * e[t][:, None, :]
            x /= x.sum((1, 2), keepdims=True) + 1e-300
            over = np.where(mask[t][:, None, None], x, over)
        before, after = np.ones((len(spans), k)), np.ones((len(spans), k))
        first = last - counts + 1
        for j in range(1, int(counts.max())):
            live = counts > j
            at = first[live] + j
            x = (before[at - 1][:, None, :] @ over[at - 1])[:, 0] @ a
            before[at] = x / (x.sum(1, keepdims=True) + 1e-300)
            at = last[live] - j
            x = (over[at + 1] @ after[at + 1][:, :, None])[:, :, 0] @ a.T
            after[at] = x / (x.sum(1, keepdims=True) + 1e-300)
        return self.marginals(emit, spans, before=before, after=after)

    def marginals(self, emit: np.ndarray, lengths: np.ndarray, pairs: bool = False, before: np.ndarray | None = None, after: np.ndarray | None = None):
        """Forward-backward over all sequences at once: label probabilities of each row,
        and with ``pairs`` the expected transitions. ``before`` and ``after`` are the messages that reach a sequence's ends."""
        e, mask = self.padded(emit, lengths)
        top, n, k = e.shape
        e = np.exp(e - e.max(2, keepdims=True))
        a = np.exp(self.trans - self.trans.max())
        fwd = np.empty_like(e)
        fwd[0] = e[0] if before is None else e[0] * before
        fwd[0] /= fwd[0].sum(1, keepdims=True)
        for t in range(1, top):
            x = (fwd[t - 1] @ a) * e[t]
            x /= x.sum(1, keepdims=True) + 1e-30
            fwd[t] = np.where(mask[t][:, None], x, fwd[t - 1])
        bwd = np.ones((n, k), np.float32) if after is None else after.astype(np.float32)
        prob = np.empty_like(e)
        both = np.zeros((k, k))
        for t in range(top - 1, -1, -1):
            x = fwd[t] * bwd
            prob[t] = x / (x.sum(1, keepdims=True) + 1e-30)
            if t:
                right = e[t] * bwd
                if pairs:
                    z = ((fwd[t - 1] @ a) * right).sum(1)
                    live = mask[t] & (z > 0)
                    both += a * ((fwd[t - 1][live] / z[live, None]).T @ right[live])
                x = right @ a.T
                x /= x.sum(1, keepdims=True) + 1e-30
                bwd = np.where(mask[t][:, None], x, bwd).astype(np.float32)
        seq = np.repeat(np.arange(n), lengths)
        time = np.arange(len(seq)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        flat = prob[time, seq]
        return (flat, both) if pairs else flat

    def viterbi(self, emit: np.ndarray) -> np.ndarray:
        """The best label sequence of one chain; ties go to the smaller label."""
        n, k = emit.shape
        if k == 2:  # two labels need no arrays
            (aa, ab), (ba, bb) = self.trans.tolist()
            rows = emit.tolist()
            x, y = rows[0]
            back = []
            for p, q in rows[1:]:
                fa, fb = x + aa >= y + ba, x + ab >= y + bb
                back.append((fa, fb))
                x, y = (x + aa if fa else y + ba) + p, (x + ab if fb else y + bb) + q
            path = [0 if x >= y else 1]
            for fa, fb in reversed(back):
                path.append(0 if (fb if path[-1] else fa) else 1)
            return np.array(path[::-1])
        best, back = emit[0], np.zeros((n, k), int)
        for t in range(1, n):
            s = best[:, None] + self.trans
            back[t] = s.argmax(0)
            best = s.max(0) + emit[t]
        path = [int(best.argmax())]
        for t in range(n - 1, 0, -1):
            path.append(int(back[t, path[-1]]))
        return np.array(path[::-1])

    def fit(self, units: np.ndarray, rows: np.ndarray, labels: np.ndarray, lengths: np.ndarray, rounds: int = 40, rate: float = 0.2, l2: float = 1e-4) -> "LinearChain":
        """Maximum likelihood by AdaGrad on the whole sample; a round that makes the rows' own labels less likely is taken back and
        the rate halved. ``rows`` are the sequences' units
        one after another, ``labels`` theirs; ``units`` (n, f) has each unit's feature ids."""
        k, total = self.trans.shape[0], max(1, len(rows))
        starts = np.cumsum(lengths) - lengths
        inner = np.ones(len(rows), bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        seen = np.zeros((k, k))
        np.add.at(seen, (labels[at - 1], labels[at]), 1)
        gold = np.zeros((len(units), k))
        np.add.at(gold, (rows, labels), 1)
        n_features = len(self.weights)
        ids = np.where(units < 0, n_features, units).ravel()
        width = units.shape[1]
        sum_w, sum_t = np.full(self.weights.shape, 1e-8), np.full((k, k), 1e-8)
        best, kept = -np.inf, None
        for n in range(rounds + 1):
            prob, both = self.marginals(self.emissions(units)[rows], lengths, pairs=True)
            likely = float(np.log(prob[np.arange(len(rows)), labels] + 1e-9).mean()) if len(rows) else 0.0
            if likely < best:
                self.weights, self.trans, prob, both = kept[0].copy(), kept[1].copy(), kept[2], kept[3]
                rate /= 2
            else:
                best, kept = likely, (self.weights.copy(), self.trans.copy(), prob, both)
            if n == rounds or rate < 1e-3:
                break
            diff = gold.copy()
            for c in range(k):
                diff[:, c] -= np.bincount(rows, prob[:, c], minlength=len(units))
            grad = np.stack([np.bincount(ids, np.repeat(diff[:, c], width), minlength=n_features + 1)[:-1] for c in range(k)], 1) / total - l2 * self.weights
            step = (seen - both) / total - l2 * self.trans
            sum_w += grad**2
            sum_t += step**2
            self.weights += (rate * grad / np.sqrt(sum_w)).astype(np.float32)
            self.trans += (rate * step / np.sqrt(sum_t)).astype(np.float32)
        return self
