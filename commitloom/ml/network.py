"""A small feed-forward network in numpy for windows of bounded size (a window's rows fit in memory by design)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def one_hot(y: np.ndarray) -> np.ndarray:
    """Columns ``1 - y, y`` of a binary label."""
    y = np.asarray(y, float)
    return np.stack([1 - y, y], axis=1)


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def stats(predicted: np.ndarray, truth: np.ndarray, eps: float = 1e-5) -> dict[str, float]:
    """Counts, precision, recall, F1 and accuracy; ``eps`` keeps the denominators above zero."""
    p, t = np.asarray(predicted, bool), np.asarray(truth, bool)
    tp, fp, fn, tn = (p & t).sum(), (p & ~t).sum(), (~p & t).sum(), (~p & ~t).sum()
    precision, recall = tp / (tp + fp + eps), tp / (tp + fn + eps)
    return {"tp": int(tp), "fp": int(fp), "fn": int(fn), "tn": int(tn), "precision": float(precision), "recall": float(recall), "f1": float(2 * precision * recall / (precision + recall + eps)), "accuracy": float((tp + tn) / max(1, len(p)))}


@dataclass
class Network:
    """Weights, one matrix per layer, and how to train them."""

    sizes: list[int]
    rate: float = 0.001
    drop_input: float = 0.2
    drop_hidden: float = 0.5
    class_weights: tuple[float, float] = (0.2, 1.0)
    update: str = "rmsprop"
    seed: int = 0
    weights: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.rng = np.random.default_rng(self.seed)
        self.weights = [self.rng.normal(scale=0.01, size=(a, b)) for a, b in zip(self.sizes, self.sizes[1:])]
        self.memory = [np.zeros_like(w) for w in self.weights]

    def forward(self, x: np.ndarray, drop: bool = False) -> list[np.ndarray]:
        layers = [self._drop(x, self.drop_input) if drop else x]
        for i, w in enumerate(self.weights):
            z = layers[-1] @ w
            if i == len(self.weights) - 1:
                layers.append(softmax(z))
            else:
                layers.append(self._drop(relu(z), self.drop_hidden) if drop else relu(z))
        return layers

    def _drop(self, x: np.ndarray, p: float) -> np.ndarray:
        return x * (self.rng.random(x.shape) >= p) / (1 - p) if p > 0 else x

    def step(self, x: np.ndarray, t: np.ndarray) -> None:
        """One update by the weighted cross-entropy of a batch."""
        layers = self.forward(x, drop=True)
        k = np.asarray(self.class_weights)
        own = (t * k).sum(axis=1, keepdims=True)
        delta = (layers[-1] - t) * own / len(x)
        for i in range(len(self.weights) - 1, -1, -1):
            g = layers[i].T @ delta
            if i:
                delta = (delta @ self.weights[i].T) * (layers[i] > 0)
            if self.update == "rmsprop":
                self.memory[i] = 0.9 * self.memory[i] + 0.1 * g * g
                g = g / np.sqrt(self.memory[i] + 1e-6)
            self.weights[i] -= self.rate * g

    def predict(self, x: np.ndarray, bias: float = 0.0) -> np.ndarray:
        """Net probability of the positive class above ``bias``."""
        p = self.forward(x)[-1]
        return p[:, 1] - p[:, 0] > bias


def train(net: Network, x: np.ndarray, y: np.ndarray, x_test: np.ndarray, y_test: np.ndarray, rounds: int = 6, batch: int = 512, least_rate: float | None = None, patience: int = 10, bias: float = 0.0) -> dict[str, float]:
    """Trains in batches, keeps the weights with the best F1, cuts the rate to a tenth when stale and stops below ``least_rate``."""
    best, kept, stale = {"f1": -1.0}, [w.copy() for w in net.weights], 0
    t = one_hot(y)
    for _ in range(rounds):
        order = net.rng.permutation(len(x))
        for a in range(0, len(x), batch):
            net.step(x[order[a : a + batch]], t[order[a : a + batch]])
        now = stats(net.predict(x_test, bias), y_test)
        if now["f1"] > best["f1"]:
            best, kept, stale = now, [w.copy() for w in net.weights], 0
        else:
            stale += 1
        if stale >= patience:
            net.rate, stale = net.rate / 10, 0
            if least_rate and net.rate < least_rate:
                break
    net.weights = kept
    return best


def bias_sweep(net: Network, x: np.ndarray, y: np.ndarray, low: float = -0.2, high: float = 0.05, points: int = 10) -> list[dict[str, float]]:
    """Statistics at biases between two ends."""
    return [{"bias": float(b), **stats(net.predict(x, float(b)), y)} for b in np.linspace(low, high, points)]
