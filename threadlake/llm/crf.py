"""A linear-chain conditional random field over two labels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Rounds and step of the optimiser, and the penalty on squared weights.
ROUNDS, RATE, RIDGE = 250, 0.1, 2e-4


@dataclass(frozen=True)
class Chain:
    """Weights in favour of label 1 by feature; steps[a][b] from label a to label b."""

    weights: dict[str, float]
    steps: tuple[tuple[float, float], tuple[float, float]]
    start: float
    bias: float

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi: the best labels for blocks with these summed weights; ties prefer 0."""
        (stay0, up), (down, stay1) = self.steps
        back: list[tuple[int, int]] = []
        zero = one = 0.0
        for place, score in enumerate(scores):
            score += self.bias
            if place == 0:
                zero, one = 0.0, score + self.start
                continue
            from0, from1 = zero + stay0 >= one + down, zero + up >= one + stay1
            back.append((0 if from0 else 1, 0 if from1 else 1))
            zero, one = max(zero + stay0, one + down), max(zero + up, one + stay1) + score
        if not scores:
            return []
        label = int(one > zero)
        labels = [label]
        for origin in reversed(back):
            label = origin[label]
            labels.append(label)
        return labels[::-1]


def train(chains: list[list[list[str]]], labels: list[list[int]]) -> Chain:
    """Maximise the penalised likelihood of labelled chains of feature lists."""
    names = sorted({f for chain in chains for block in chain for f in block})
    number = {f: i for i, f in enumerate(names)}
    most = max(map(len, chains))
    shape = (len(chains), most)
    feature, cell = (
        np.array(v)
        for v in zip(
            *[(number[f], i * most + t) for i, chain in enumerate(chains) for t, block in enumerate(chain) for f in block]
        )
    )
    real = np.array([[t < len(chain) for t in range(most)] for chain in chains])
    gold = np.array([[y[t] if t < len(y) else 0 for t in range(most)] for y in labels], float)
    pairs = real[:, 1:] & real[:, :-1]
    gold_steps = np.array(
        [[(pairs & (gold[:, :-1] == a) & (gold[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float
    )
    size = len(names)
    theta = np.zeros(size + 6)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, ROUNDS + 1):
        unary = np.bincount(cell, theta[feature], minlength=shape[0] * most).reshape(shape) + theta[size]
        unary[:, 0] += theta[size + 1]
        steps = theta[size + 2 :].reshape(2, 2)
        emit = np.stack([np.zeros(shape), unary], axis=2)
        ahead = np.zeros((*shape, 2))
        ahead[:, 0] = emit[:, 0]
        for t in range(1, most):
            moved = np.logaddexp.reduce(ahead[:, t - 1, :, None] + steps, axis=1) + emit[:, t]
            ahead[:, t] = np.where(real[:, t, None], moved, ahead[:, t - 1])
        behind = np.zeros((*shape, 2))
        for t in range(most - 2, -1, -1):
            moved = np.logaddexp.reduce(steps + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(real[:, t + 1, None], moved, behind[:, t + 1])
        whole = np.logaddexp.reduce(ahead[:, -1], axis=1)
        on = np.exp(ahead[:, :, 1] + behind[:, :, 1] - whole[:, None]) * real
        both = np.exp(
            ahead[:, :-1, :, None] + steps + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        ) * pairs[:, :, None, None]
        off = (on - gold * real).ravel()
        gradient = np.concatenate(
            [
                np.bincount(feature, off[cell], minlength=size),
                [off.sum(), (on - gold)[:, 0].sum()],
                (both.sum(axis=(0, 1)) - gold_steps).ravel(),
            ]
        ) / len(chains) + RIDGE * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta = theta - RATE * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    steps = theta[size + 2 :]
    return Chain(
        dict(zip(names, map(float, theta[:size]))),
        ((float(steps[0]), float(steps[1])), (float(steps[2]), float(steps[3]))),
        float(theta[size + 1]),
        float(theta[size]),
    )
