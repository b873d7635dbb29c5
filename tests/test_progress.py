import pytest

from coppice.plans.progress import STAGES, Progress, Reporter, even_split


@pytest.mark.parametrize(("units", "workers", "expected"), [(12, 4, [3, 3, 3, 3]), (10, 4, [3, 3, 2, 2]), (3, 5, [1, 1, 1, 0, 0]), (3, 0, [])])
def test_even_split(units, workers, expected):
    assert even_split(units, workers) == expected


def test_fractions():
    assert Progress(1, STAGES[0]).fraction == 0
    assert Progress(3, STAGES[2], substep=1, substeps=2).fraction == pytest.approx(2.5 / 8)
    assert Progress(9, "x", substep=1, substeps=1).fraction == 1
    assert Progress(1, "x", total_steps=0).fraction == 0


def test_tracker_reports_by_hundredths():
    seen = []
    tracker = Reporter(seen.append).parallel(Progress(6, STAGES[5], "work"), 1000, 3, "units")
    for i in range(1000):
        tracker.advance(1, i % 3)
    tracker.finish()
    assert len(seen) == 101
    assert seen[-1].workers == ((1, 334, 334), (2, 333, 333), (3, 333, 333))
    assert seen[0].detail == "work (10/1000) units"
