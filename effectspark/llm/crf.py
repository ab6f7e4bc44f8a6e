"""Linear-chain conditional random field with two labels, over many sequences at once.

The sequences of a batch are laid end to end; where one begins, the transition
forgets what came before. The odds of label 1 then follow a chain of 2x2 transfer
matrices. The chain is cut into blocks that are worked on side by side: matrices
are multiplied within each block, the blocks are chained, and the odds are filled
in. This needs about 2 sqrt(n) steps of array arithmetic for n tokens, exactly and
without cutting a long sequence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LIMIT = 30.0  # emissions are kept within exp(+-LIMIT)


@dataclass
class Chain:
    """Log potentials: ``start[j]`` and ``move[i, j]``; a token's emission counts for label 1."""

    start: np.ndarray
    move: np.ndarray

    def marginals(self, emission: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(label 1) of each token; ``first`` marks the tokens that begin a sequence."""
        forward, backward, _ = self._odds(emission, first)
        return 1.0 / (1.0 + 1.0 / np.maximum(forward * backward, 1e-300))

    def expectations(self, emission: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals, and for each token the probabilities of the pair (label before, label)."""
        forward, backward, moves = self._odds(emission, first)
        marginal = 1.0 / (1.0 + 1.0 / np.maximum(forward * backward, 1e-300))
        before = np.concatenate([[1.0], forward[:-1]])
        pairs = moves * np.stack([np.stack([np.ones_like(before), backward]), np.stack([before, before * backward])])
        return marginal, pairs / pairs.sum((0, 1))

    def _odds(self, emission: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward odds including the token, backward odds excluding it, and the transfer matrices [i, j, token]."""
        moves = np.empty((2, 2, len(emission)))
        seen = np.exp(np.clip(emission, -LIMIT, LIMIT))
        for i in range(2):
            for j in range(2):
                moves[i, j] = np.where(first, np.exp(self.start[j]), np.exp(self.move[i, j]))
                if j:
                    moves[i, j] *= seen
        forward = _chain(moves)
        # the odds of what follows a token: the same chain, transposed and read from the end
        after = np.concatenate([moves[:, :, 1:], np.ones((2, 2, 1))], axis=2)
        backward = _chain(after.transpose(1, 0, 2)[:, :, ::-1])[::-1]
        return forward, backward, moves


def _chain(moves: np.ndarray) -> np.ndarray:
    """Odds r_t = v_t[1] / v_t[0] of the row vectors v_t = v_(t-1) M_t, from v_0 = (1, 1)."""
    n = moves.shape[2]
    if not n:
        return np.zeros(0)
    length = max(1, int(np.sqrt(n)))
    blocks = -(-n // length)
    padded = np.zeros((2, 2, blocks * length))
    padded[0, 0, n:] = padded[1, 1, n:] = 1.0
    padded[:, :, :n] = moves
    m = np.ascontiguousarray(padded.reshape(2, 2, blocks, length).transpose(3, 0, 1, 2))  # step, i, j, block
    a, b, c, d = (m[0, i, j].copy() for i in range(2) for j in range(2))
    for t in range(1, length):
        (p, q), (r, s) = m[t]
        a, b, c, d = a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s
        scale = 1.0 / (a + b + c + d)
        a, b, c, d = a * scale, b * scale, c * scale, d * scale
    odds, enter = 1.0, np.empty(blocks)
    for k, (w, x, y, z) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        enter[k] = odds
        odds = min(max((x + odds * z) / max(w + odds * y, 1e-300), 1e-300), 1e300)
    out, r = np.empty((length, blocks)), enter
    for t in range(length):
        r = (m[t, 0, 1] + r * m[t, 1, 1]) / (m[t, 0, 0] + r * m[t, 1, 0])
        out[t] = r
    return out.T.reshape(-1)[:n]
