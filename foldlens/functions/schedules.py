"""Learning rates by step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def learning_rate(step: Column, warmup: int, total: int, base: float) -> Column:
    """Linear warm-up, then half a cosine down to 0 at ``total``."""
    step = step.cast("double")
    progress = F.least(F.lit(1.0), (step - warmup) / max(1, total - warmup))
    return F.when(step < warmup, base * step / max(1, warmup)).otherwise(base * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress)))
