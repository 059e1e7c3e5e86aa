"""Batch inference with a convolutional encoder and decoder whose weights are given."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol
from functools import reduce as fold
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixframe.functions import arrow

# Weights are parameters like the mixture's; the bound keeps what each task holds at 256 MB.
MAX_WEIGHTS = 32_000_000
WEIGHT_SCHEMA = "name string, shape array<int>, vals array<double>"


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.0)


def elu(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, np.expm1(np.minimum(x, 0.0)))


ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"RELU": relu, "ELU": elu}


@dataclass(frozen=True, eq=False)
class CoderSpec:
    """Shape of the network: frame (height, width, channels), filters, kernel sizes, strides and code length."""

    frame: tuple[int, int, int]
    filters: tuple[int, ...]
    kernels: tuple[int, ...]
    strides: tuple[int, ...]
    code: int
    activation: str = "RELU"
    activate_output: bool = True

    def __post_init__(self) -> None:
        if not self.filters:
            raise ValueError("at least one convolution is needed")
        if len(self.kernels) != len(self.filters) or len(self.strides) != len(self.filters):
            raise ValueError("filters, kernels and strides must have equal length")
        if self.activation not in ACTIVATIONS:
            raise ValueError(f"unknown activation {self.activation!r}")

    @property
    def last_same(self) -> bool:
        """The innermost convolution pads only when both sides are divisible by the product of the strides."""
        scale = fold(mul, self.strides, 1)
        return self.frame[0] % scale == 0 and self.frame[1] % scale == 0

    def same(self, layer: int) -> bool:
        return self.last_same if layer == len(self.filters) - 1 else True

    def encoded_shape(self) -> tuple[int, int, int]:
        h, w = self.frame[:2]
        for i, (k, s) in enumerate(zip(self.kernels, self.strides, strict=True)):
            h, w = (conv_length(n, k, s, self.same(i)) for n in (h, w))
        return h, w, self.filters[-1]

    def weight_shapes(self) -> dict[str, tuple[int, ...]]:
        """Name and shape of every weight; convolutions are (height, width, in, out), transposed ones (.., out, in)."""
        shapes: dict[str, tuple[int, ...]] = {}
        channels = self.frame[2]
        for i, (f, k) in enumerate(zip(self.filters, self.kernels, strict=True)):
            shapes[f"conv{i}_kernel"], shapes[f"conv{i}_bias"] = (k, k, channels, f), (f,)
            channels = f
        flat = int(np.prod(self.encoded_shape()))
        for head in ("mu", "sigma"):
            shapes[f"{head}_kernel"], shapes[f"{head}_bias"] = (flat, self.code), (self.code,)
        shapes["dense_kernel"], shapes["dense_bias"] = (self.code, flat), (flat,)
        outputs = (self.frame[2], *self.filters[:-1])
        for i in range(len(self.filters)):
            shapes[f"deconv{i}_kernel"] = (self.kernels[i], self.kernels[i], outputs[i], self.filters[i])
            shapes[f"deconv{i}_bias"] = (outputs[i],)
        return shapes


def conv_length(n: int, kernel: int, stride: int, same: bool) -> int:
    return -(-n // stride) if same else -(-(n - kernel + 1) // stride)


def _windows(x: np.ndarray, kernel: int, stride: int, same: bool) -> np.ndarray:
    """Patches under the kernel: (rows, out height, out width, channels, kernel, kernel)."""
    if same:
        pads = []
        for n in x.shape[1:3]:
            total = max((conv_length(n, kernel, stride, True) - 1) * stride + kernel - n, 0)
            pads.append((total // 2, total - total // 2))
        x = np.pad(x, ((0, 0), *pads, (0, 0)))
    return np.lib.stride_tricks.sliding_window_view(x, (kernel, kernel), axis=(1, 2))[:, ::stride, ::stride]


def convolve(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray, stride: int, same: bool) -> np.ndarray:
    return np.einsum("nhwcab,abcf->nhwf", _windows(x, kernel.shape[0], stride, same), kernel, optimize=True) + bias


def deconvolve(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray, stride: int, same: bool) -> np.ndarray:
    """Transposed convolution: every input pixel adds its kernel to the output."""
    size = kernel.shape[0]
    rows, h, w, _ = x.shape
    full = np.zeros((rows, (h - 1) * stride + max(size, stride), (w - 1) * stride + max(size, stride), kernel.shape[2]))
    for a in range(size):
        for b in range(size):
            spread = np.einsum("nhwf,cf->nhwc", x, kernel[a, b], optimize=True)
            full[:, a : a + (h - 1) * stride + 1 : stride, b : b + (w - 1) * stride + 1 : stride] += spread
    if same:
        cut = max(size - stride, 0) // 2
        full = full[:, cut : cut + h * stride, cut : cut + w * stride]
    return full + bias


@dataclass(frozen=True, eq=False)
class Coder:
    """A network with its weights; small enough to be shipped to every task."""

    spec: CoderSpec
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        shapes = self.spec.weight_shapes()
        if sum(int(np.prod(s)) for s in shapes.values()) > MAX_WEIGHTS:
            raise ValueError(f"more than {MAX_WEIGHTS} weights")
        for name, shape in shapes.items():
            if name not in self.weights:
                raise ValueError(f"missing weight {name}")
            if tuple(np.shape(self.weights[name])) != shape:
                raise ValueError(f"weight {name} must have shape {shape}")

    @classmethod
    def from_table(cls, spec: CoderSpec, table: DataFrame) -> Coder:
        """Read a weight table ``(name, shape, vals)``; its size is checked before it reaches the driver."""
        wanted = table.filter(F.col("name").isin(list(spec.weight_shapes())))
        if (wanted.agg(F.sum(F.size("vals"))).first()[0] or 0) > MAX_WEIGHTS:
            raise ValueError(f"more than {MAX_WEIGHTS} weights")
        return cls(spec, {r["name"]: np.array(r["vals"]).reshape(r["shape"]) for r in wanted.collect()})

    @classmethod
    def from_npz(cls, spec: CoderSpec, path: str) -> Coder:
        with np.load(path) as stored:
            return cls(spec, {name: stored[name] for name in spec.weight_shapes()})

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, list(w.shape), [float(v) for v in w.ravel()]) for n, w in self.weights.items()]
        return spark.createDataFrame(rows, WEIGHT_SCHEMA)

    @property
    def frame(self) -> tuple[int, int, int]:
        return self.spec.frame

    @property
    def inputs(self) -> int:
        return int(np.prod(self.spec.frame))

    @property
    def code(self) -> int:
        return self.spec.code

    @property
    def working(self) -> int:
        """Numbers that a row takes while it is coded."""
        return self.inputs * max(max(self.spec.kernels) ** 2, *self.spec.filters)

    def encode_rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        activate = ACTIVATIONS[self.spec.activation]
        h = x.reshape(len(x), *self.spec.frame)
        for i, stride in enumerate(self.spec.strides):
            w, b = self.weights[f"conv{i}_kernel"], self.weights[f"conv{i}_bias"]
            h = activate(convolve(h, w, b, stride, self.spec.same(i)))
        flat = h.reshape(len(x), self.weights["mu_kernel"].shape[0])
        return tuple(flat @ self.weights[f"{n}_kernel"] + self.weights[f"{n}_bias"] for n in ("mu", "sigma"))

    def decode_rows(self, code: np.ndarray) -> np.ndarray:
        activate = ACTIVATIONS[self.spec.activation]
        h = activate(code @ self.weights["dense_kernel"] + self.weights["dense_bias"])
        h = h.reshape(len(code), *self.spec.encoded_shape())
        for i in reversed(range(len(self.spec.filters))):
            w, b = self.weights[f"deconv{i}_kernel"], self.weights[f"deconv{i}_bias"]
            h = deconvolve(h, w, b, self.spec.strides[i], self.spec.same(i))
            if i > 0 or self.spec.activate_output:
                h = activate(h)
        return h.reshape(len(code), int(np.prod(h.shape[1:])))


class AnyCoder(Protocol):
    """What a network must offer to encode and decode rows: shapes, and two functions of whole matrices."""

    frame: tuple[int, int, int]
    inputs: int
    code: int
    working: int

    def encode_rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]: ...

    def decode_rows(self, code: np.ndarray) -> np.ndarray: ...


def encode(df: DataFrame, coder: AnyCoder, frame: str = "x") -> DataFrame:
    """``df`` with ``z_mu`` and ``z_sigma``; a narrow pass over Arrow batches."""
    inputs, width, working = coder.inputs, coder.code, coder.working

    def both(values: pa.Array) -> pa.Array:
        x = arrow.matrix(values, inputs)
        mu, sigma = np.empty((len(x), width)), np.empty((len(x), width))
        for part in arrow.blocks(len(x), working):
            mu[part], sigma[part] = coder.encode_rows(x[part])
        return pa.StructArray.from_arrays([arrow.lists(mu), arrow.lists(sigma)], names=["z_mu", "z_sigma"])

    latent = arrow.row_function(both, "struct<z_mu: array<double>, z_sigma: array<double>>")(F.col(frame))
    kept = [c for c in df.columns if c not in ("z_mu", "z_sigma")]
    return df.withColumn("__latent", latent).select(*kept, "__latent.z_mu", "__latent.z_sigma")


def decode(df: DataFrame, coder: AnyCoder, code: str = "z_mu", out: str = "xhat") -> DataFrame:
    """``df`` with the reconstruction of the chosen code column.

    Warm-up and initialisation decode ``z_mu``; afterwards the drawn ``z`` is decoded.
    """
    outputs, width, working = coder.inputs, coder.code, coder.working

    def reconstruct(values: pa.Array) -> pa.Array:
        z = arrow.matrix(values, width)
        x = np.empty((len(z), outputs))
        for part in arrow.blocks(len(z), working):
            x[part] = coder.decode_rows(z[part])
        return arrow.lists(x)

    return df.withColumn(out, arrow.row_function(reconstruct, "array<double>")(F.col(code)))
