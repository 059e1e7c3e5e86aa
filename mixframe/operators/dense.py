"""A dense encoder and decoder, as ``fit_latent`` trains them, in the place of a convolutional one."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from mixframe.operators.network import MAX_WEIGHTS, elu

#: Layers of the network: names of their kernels and biases.
LAYERS = ("enc", "mean", "logvar", "dec", "out")


@dataclass(frozen=True, eq=False)
class DenseCoder:
    """One hidden layer on each side; ``frame`` is the shape (height, width, channels) that the input has for the metrics."""

    weights: dict[str, np.ndarray]
    frame: tuple[int, int, int]

    def __post_init__(self) -> None:
        for layer in LAYERS:
            kernel, bias = (self.weights.get(f"{layer}_{part}") for part in "wb")
            if kernel is None or bias is None:
                raise ValueError(f"missing weights of layer {layer}")
            if np.ndim(kernel) != 2 or np.shape(bias) != (np.shape(kernel)[1],):
                raise ValueError(f"layer {layer} has a kernel of shape {np.shape(kernel)} and a bias of {np.shape(bias)}")
        if sum(np.size(w) for w in self.weights.values()) > MAX_WEIGHTS:
            raise ValueError(f"more than {MAX_WEIGHTS} weights")
        if int(np.prod(self.frame)) != self.inputs:
            raise ValueError(f"a frame of shape {self.frame} does not hold {self.inputs} numbers")

    @property
    def inputs(self) -> int:
        return int(np.shape(self.weights["enc_w"])[0])

    @property
    def code(self) -> int:
        return int(np.shape(self.weights["mean_w"])[1])

    @property
    def working(self) -> int:
        """Numbers that a row takes while it is coded."""
        return self.inputs + 2 * int(np.shape(self.weights["enc_w"])[1])

    def encode_rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights
        h = elu(x @ w["enc_w"] + w["enc_b"])
        return h @ w["mean_w"] + w["mean_b"], h @ w["logvar_w"] + w["logvar_b"]

    def decode_rows(self, code: np.ndarray) -> np.ndarray:
        w = self.weights
        return elu(code @ w["dec_w"] + w["dec_b"]) @ w["out_w"] + w["out_b"]
