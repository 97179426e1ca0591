"""Learning-rate multipliers as functions of a step column."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of the final decay.
SHAPES = ("linear", "sqrt", "lowered_linear")


def _cosine(progress: Column) -> Column:
    return (F.cos(progress * pi) + 1.0) * 0.5


def _whole(x: float) -> int:
    """The integer part of a product of doubles, as all ratios are counted."""
    return int(x)


def cosine(step: Column, warmup: int, total: int, floor: float = 0.1) -> Column:
    """Linear warm-up to 1, then half a cosine down to `floor`, where it stays."""
    progress = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, total - warmup))))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(_cosine(progress) * (1.0 - floor) + floor)


def decayed(progress: Column, shape: str, alpha: float) -> Column:
    """1 at the start of the decay, 0 at its end."""
    if shape not in SHAPES:
        raise ValueError(f"unknown decay shape {shape!r}; known: {', '.join(SHAPES)}")
    return {"linear": 1.0 - progress, "sqrt": F.sqrt(1.0 - progress), "lowered_linear": 1.0 - F.pow(progress, F.lit(alpha))}[shape]


def _check_wsd(total: int, stable: float, decay: float, floor: float, shape: str, alpha: float) -> None:
    if total <= 0:
        raise ValueError("the number of steps must be positive")
    if not (0 <= stable <= 1 and 0 <= decay <= 1 and stable + decay <= 1 + 1e-12):
        raise ValueError("stable and decay are fractions with a sum of at most 1")
    if not 0 <= floor <= 1:
        raise ValueError("the floor must be between 0 and 1")
    if shape not in SHAPES or alpha <= 0:
        raise ValueError("unknown decay shape, or alpha is not positive")


def wsd(step: Column, warmup: int, total: int, stable: float = 0.7, decay: float = 0.2, shape: str = "sqrt", floor: float = 0.0, alpha: float = 0.7) -> Column:
    """Warm-up, a stretch at 1, a decay of the given shape, then `floor`."""
    _check_wsd(total, stable, decay, floor, shape, alpha)
    start = max(0, warmup)
    hold = start + _whole(total * stable)
    length = max(1, _whole(total * decay))
    progress = (step - hold) / F.lit(float(length))
    return (
        F.when(step < start, step / F.lit(float(max(1, start))))
        .when(step < hold, 1.0)
        .when(step < hold + length, decayed(progress, shape, alpha) * (1.0 - floor) + floor)
        .otherwise(floor)
    )


def resumed(step: Column, total: int, start: float, hold: int, ramp: int, **later) -> Column:
    """`start` for `hold` steps, a line to 1 over `ramp` steps, then `wsd` without warm-up over the rest."""
    if total <= 0 or hold < 0 or ramp < 0 or start < 0 or hold + ramp >= total:
        raise ValueError("hold and ramp must fit into the steps, and nothing may be negative")
    climbing = F.least(F.lit(1.0), (step - hold + 1) / F.lit(float(max(1, ramp))))
    rest = wsd(step - (hold + ramp), 0, total - hold - ramp, **later)
    return F.when(step < hold, F.lit(float(start))).when(step < hold + ramp, climbing * (1.0 - start) + start).otherwise(rest)


def restarts(step: Column, total: int, cycles: int = 4, floor: float = 0.05, shrink: float = 0.8) -> Column:
    """Cosine cycles; the peak of each is `shrink` times that of the one before."""
    if cycles < 1 or not 0 <= floor < 1 or not 0 < shrink <= 1:
        raise ValueError("at least one cycle, a floor below 1 and a shrinkage of at most 1")
    length = max(1, total // cycles)
    cycle = F.least(F.floor(step / length), F.lit(cycles - 1))
    progress = F.least(F.lit(1.0), (step - cycle * length) / F.lit(float(length)))
    return _cosine(progress) * (F.pow(F.lit(shrink), cycle) - floor) + floor


def precision_at(step: Column, intervals: list[tuple[int, int, str]], default: str | None = None) -> Column:
    """The first entry of (start, end, name) with start <= step < end; an end of -1 is open."""
    out = F.lit(default)
    for start, end, name in reversed(intervals):
        out = F.when((step >= start) & (F.lit(end == -1) | (step < end)), name).otherwise(out)
    return out


def effective_batch(batch: int, accumulation: int, context: int = 1, devices: int = 1) -> int:
    """Sequences (with `context`, tokens) in one optimizer step."""
    return batch * accumulation * context * devices
