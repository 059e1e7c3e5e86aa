"""Training schedule as columns over a step table."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults of an undeclared schedule, and the names of the training phases.
DEFAULT_LEARNING_RATE = 0.01
PHASES = ("start", "gamma", "gmm_init", "beta", "static")


@dataclass(frozen=True)
class Schedule:
    """Step counts of the phases; ``init_steps`` may be a fraction and then counts as one whole step."""

    gamma_steps: int
    init_steps: float
    beta_steps: int
    static_steps: int
    max_steps: int
    gamma: float

    @property
    def warmup(self) -> int:
        return self.gamma_steps + math.ceil(self.init_steps)

    @property
    def period(self) -> int:
        return self.beta_steps + self.static_steps

    def phase(self, step: str | Column) -> Column:
        s = F.col(step) if isinstance(step, str) else step
        offset = s - F.lit(self.warmup)
        within = F.pmod(offset, F.lit(self.period))
        start, gamma, init, beta, static = PHASES
        return (
            F.when(s == 0, start)
            .when(offset.cast("double") <= -float(self.init_steps), gamma)
            .when(offset <= 0, init)
            .when(within.between(1, self.beta_steps), beta)
            .otherwise(static)
        )

    def cycle(self, step: str | Column) -> Column:
        """Number of the anneal cycle, from 1; null before the first one."""
        s = F.col(step) if isinstance(step, str) else step
        offset = s - F.lit(self.warmup)
        return F.when((s > 0) & (offset > 0), F.floor(offset / F.lit(self.period)) + 1).cast("bigint")

    def anneal_factor(self, step: str | Column) -> Column:
        """Weight of the mixture loss: a cubic ramp from gamma to 1 + gamma in every cycle."""
        s = F.col(step) if isinstance(step, str) else step
        offset = F.least(F.greatest(s - F.lit(self.warmup), F.lit(0)), F.lit(self.max_steps))
        within = F.pmod(offset, F.lit(self.period))
        ramp = F.least(within, F.lit(self.beta_steps)) / F.lit(float(self.beta_steps))
        return F.pow(ramp, F.lit(3.0)) + F.lit(float(self.gamma))


def momentum(anneal_factor: str | Column) -> Column:
    """Weight of freshly fitted mixture parameters."""
    a = F.col(anneal_factor) if isinstance(anneal_factor, str) else anneal_factor
    return F.pow(F.lit(1.0) - a, F.lit(3.0))


def learning_rate(
    step: str | Column,
    rate: float | None = None,
    decay: str | None = None,
    decay_params: tuple[int, float] | None = None,
    minimum: float | None = None,
) -> Column:
    """Learning rate of a step: constant, or continuous exponential decay, with an optional floor."""
    s = F.col(step) if isinstance(step, str) else step
    if rate is None:
        return F.lit(DEFAULT_LEARNING_RATE)
    if decay == "Exponential":
        if decay_params is None or len(decay_params) != 2:
            raise ValueError("exponential decay needs (decay steps, decay rate)")
        every, factor = decay_params
        if not isinstance(every, int) or not isinstance(factor, float):
            raise ValueError("exponential decay needs an int and a float")
        value = F.lit(float(rate)) * F.pow(F.lit(factor), s / F.lit(float(every)))
    elif decay == "Constant":
        value = F.lit(float(rate))
    else:
        return F.lit(float(rate))
    return F.greatest(value, F.lit(minimum)) if isinstance(minimum, float) else value
