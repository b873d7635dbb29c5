"""Progress of a run: eight stages, substeps, and shares of parallel work."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

#: The stages of a run, in order.
STAGES = (
    "Validating column mapping",
    "Building incident records",
    "Extracting text features",
    "Building similarity graph",
    "Building primary clusters",
    "Generating summaries and subgroups",
    "Assigning unclustered incidents",
    "Finalizing analysis",
)


def share(done: int, total: int) -> float:
    return done / total if total else 0.0


def even_split(units: int, workers: int) -> list[int]:
    """Units a worker; the first workers take what doesn't divide."""
    return [units // workers + (i < units % workers) for i in range(workers)]


@dataclass(frozen=True)
class Progress:
    """One event: a stage, and how far inside it."""

    step: int
    stage: str
    detail: str = ""
    total_steps: int = len(STAGES)
    substep: int = 0
    substeps: int = 0
    substep_label: str = ""
    workers: tuple[tuple[int, int, int], ...] = field(default=())  # (worker from 1, completed, total)

    @property
    def fraction(self) -> float:
        if not self.total_steps:
            return 0.0
        return min(max((max(self.step - 1, 0) + share(self.substep, self.substeps)) / self.total_steps, 0.0), 1.0)


class Reporter:
    """Sends events to a callback and names Spark's jobs after them."""

    def __init__(self, listen: Callable[[Progress], None] | None = None, spark=None) -> None:
        self.listen, self.spark = listen, spark

    def emit(self, event: Progress) -> None:
        if self.spark is not None:
            self.spark.sparkContext.setJobDescription(f"{event.stage}: {event.substep_label or event.detail}")
        if self.listen is not None:
            self.listen(event)

    def stage(self, step: int, detail: str = "") -> None:
        self.emit(Progress(step, STAGES[step - 1], detail))

    def substep(self, step: int, current: int, total: int, label: str, detail: str = "") -> None:
        self.emit(Progress(step, STAGES[step - 1], detail, substep=current, substeps=total, substep_label=label))

    def parallel(self, event: Progress, units: int, workers: int, unit_label: str = "") -> Tracker:
        return Tracker(self, event, units, workers, unit_label)


class Tracker:
    """Counts units of parallel work and reports whenever another hundredth is done."""

    def __init__(self, reporter: Reporter, event: Progress, units: int, workers: int, unit_label: str = "") -> None:
        self.reporter, self.event, self.units, self.unit_label = reporter, event, units, unit_label
        self.totals = even_split(units, workers) if workers else []
        self.done = [0] * len(self.totals)
        self.completed = self.bucket = 0

    def advance(self, units: int, worker: int = 0) -> None:
        if not units or not self.units:
            return
        if self.done:
            self.done[min(worker, len(self.done) - 1)] += units
        self.completed += units
        bucket = min(self.completed, self.units) * 100 // self.units
        if bucket > self.bucket:
            self.bucket = bucket
            self.report(min(self.completed, self.units))

    def finish(self) -> None:
        self.report(self.units)

    def report(self, completed: int) -> None:
        parts = zip(self.done, self.totals, strict=True)
        shares = tuple((i, min(d, t), t) for i, (d, t) in enumerate(parts, 1) if t)
        detail = f"{self.event.detail} ({completed}/{self.units}) {self.unit_label}"
        self.reporter.emit(replace(self.event, detail=detail, workers=shares))
