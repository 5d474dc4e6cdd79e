import pytest

from trailmill.functions.arithmetic import generation_batch, schedule


def test_batches():
    assert generation_batch(2, 4, 3, 8) == 24
    with pytest.raises(ValueError):
        generation_batch(1, 3, 1, 2)
    assert schedule(225, 1, 8, 2, 2) == {"global_batch": 16, "steps_per_epoch": 15, "total_steps": 30, "warmup_steps": 1}
    assert schedule(0, 1, 1, 1, 1)["total_steps"] == 1
