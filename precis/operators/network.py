"""The importance network's forward pass (M7, M12) as one column.

A :class:`Network` is a few small matrices: those of a trained model, or weights made
elsewhere and read from JSON (the original's 5-64-32-1 network, relu and sigmoid, has
the same form).  ``apply`` turns it into an Arrow UDF over the feature columns: the
matrices travel with the function, and a batch of rows passes a layer at once.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

ACTIVATIONS = ("relu", "sigmoid", "linear")


@dataclass(frozen=True)
class Layer:
    weights: tuple  # one tuple of input weights for each unit
    bias: tuple
    activation: str

    def __post_init__(self):
        if self.activation not in ACTIVATIONS:
            raise ValueError(f"unknown activation {self.activation!r}")
        if not self.weights or len(self.weights) != len(self.bias) or len({len(w) for w in self.weights}) != 1:
            raise ValueError("a layer needs one row of input weights and one bias for each unit")


CHUNK = 1 << 10  # rows that pass the layers together


def _through(x: np.ndarray, missing: np.ndarray, layers) -> tuple[np.ndarray, np.ndarray]:
    """(values, missing) of the last layer's first unit for features ``x`` (one row of it each).

    A unit adds to its bias input after input, so equal features have equal scores
    wherever they stand.  A missing feature makes every unit's sum missing, and relu turns
    that into 0 (as SQL's ``greatest`` does).
    """
    for weights, bias, kind in layers:
        z = np.repeat(bias[:, None], x.shape[1], axis=1)
        for j in range(len(x)):
            z += x[j] * weights[:, j:j + 1]
        if kind == "relu":
            z = np.where(missing, 0.0, np.maximum(z, 0.0))
            missing = np.zeros_like(missing)
        elif kind == "sigmoid":
            with np.errstate(over="ignore"):
                z = 1.0 / (1.0 + np.exp(-z))
        x = z
    return x[0], missing


@dataclass(frozen=True)
class Network:
    layers: tuple[Layer, ...]

    def __post_init__(self):
        for a, b in zip(self.layers, self.layers[1:]):
            if len(a.bias) != len(b.weights[0]):
                raise ValueError(f"a layer of {len(a.bias)} units cannot feed one of {len(b.weights[0])} inputs")

    @property
    def inputs(self) -> int:
        return len(self.layers[0].weights[0])

    def apply(self, *features: Column) -> Column:
        """The first unit of the last layer for the feature columns."""
        if len(features) != self.inputs:
            raise ValueError(f"the network takes {self.inputs} features, got {len(features)}")

        layers = [(np.array(lay.weights, np.float64), np.array(lay.bias, np.float64), lay.activation) for lay in self.layers]

        def run(*cols: pa.Array) -> pa.Array:
            # a missing value is 0 in the sums, which are then not used
            x = np.array([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in cols])
            missing = np.any([c.is_null().to_numpy(zero_copy_only=False) for c in cols], axis=0)
            parts = [_through(x[:, a:a + CHUNK], missing[a:a + CHUNK], layers) for a in range(0, x.shape[1], CHUNK)]
            if not parts:
                return pa.array([], pa.float64())
            return pa.array(np.concatenate([p[0] for p in parts]), pa.float64(), mask=np.concatenate([p[1] for p in parts]))

        return F.arrow_udf(run, "double")(*[f.cast("double") for f in features])

    def score(self, features) -> float:
        """The same forward pass for one row in plain Python."""
        x = [float(f) for f in features]
        for layer in self.layers:
            z = [math.fsum(a * w for a, w in zip(x, row)) + b for row, b in zip(layer.weights, layer.bias)]
            x = [max(v, 0.0) if layer.activation == "relu" else 1 / (1 + math.exp(-v)) if layer.activation == "sigmoid" else v for v in z]
        return x[0]

    # --- other forms -----------------------------------------------------------
    @staticmethod
    def from_mlp(mlp) -> "Network":
        """The network of a fitted ``MultilayerPerceptronClassificationModel`` of two classes.

        Its two softmax outputs become one sigmoid unit, the probability of class 1.
        """
        sizes = mlp.getLayers()
        if sizes[-1] != 2:
            raise ValueError(f"expected two classes, the model has {sizes[-1]}")
        flat, at, layers = mlp.weights.toArray().tolist(), 0, []
        for i, (n_in, n_out) in enumerate(zip(sizes, sizes[1:])):
            w = [tuple(flat[at + n_out * j + u] for j in range(n_in)) for u in range(n_out)]  # column by column
            at += n_in * n_out
            b = flat[at:at + n_out]
            at += n_out
            if i == len(sizes) - 2:
                w, b = [tuple(p - q for p, q in zip(w[1], w[0]))], [b[1] - b[0]]
            layers.append(Layer(tuple(w), tuple(b), "sigmoid"))
        return Network(tuple(layers))

    def to_json(self) -> str:
        return json.dumps([{"weights": lay.weights, "bias": lay.bias, "activation": lay.activation} for lay in self.layers])

    @staticmethod
    def from_json(text: str) -> "Network":
        return Network(tuple(
            Layer(tuple(tuple(map(float, w)) for w in lay["weights"]), tuple(map(float, lay["bias"])), lay["activation"])
            for lay in json.loads(text)))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([self.to_json()], "string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Network":
        return Network.from_json("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def fixed_network(sizes=(5, 64, 32, 1)) -> Network:
    """A network of the original's form with weights by a rule, the same everywhere: for checks, not for good summaries."""
    layers = []
    for n, (n_in, n_out) in enumerate(zip(sizes, sizes[1:])):
        spread = math.sqrt(3.0 / n_in)
        w = tuple(tuple(round(spread * math.sin(1 + 17 * n + 3 * u + 7 * j + 0.1 * u * j), 6) for j in range(n_in)) for u in range(n_out))
        b = tuple(round(0.1 * math.cos(2 + n + 5 * u), 6) for u in range(n_out))
        layers.append(Layer(w, b, "relu" if n < len(sizes) - 2 else "sigmoid"))
    return Network(tuple(layers))
