"""Arithmetic of batches and steps."""

from __future__ import annotations

import math


def generation_batch(per_device: int, devices: int, accumulation: int, group: int) -> int:
    """Completions of one step; raises if they don't divide into groups."""
    total = per_device * devices * accumulation
    if group < 1 or total % group:
        raise ValueError(f"{total} completions do not divide into groups of {group}")
    return total


def schedule(rows: int, per_device: int, devices: int, accumulation: int, epochs: float, warmup: float = 0.03) -> dict[str, int]:
    """Global batch, steps an epoch (rounded up), total steps, and warm-up steps (at least 1)."""
    batch = per_device * devices * accumulation
    if batch < 1:
        raise ValueError("the batch is empty")
    each = max(1, math.ceil(rows / batch))
    total = max(1, math.ceil(each * epochs))
    return {"global_batch": batch, "steps_per_epoch": each, "total_steps": total, "warmup_steps": max(1, int(total * warmup))}
