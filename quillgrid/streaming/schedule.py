"""Cycles of named steps: ingest, learn, calibrate, index, each when it is due."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class Step:
    """A step of a cycle. ``day`` is the day of the month on which it runs, None for every cycle."""

    name: str
    run: Callable[[], object]
    day: int | None = None


def run_cycle(steps: list[Step], today: date) -> list[tuple[str, str, str]]:
    """Run the steps that are due, in order; (name, 'done' | 'failed' | 'not_due', message). A step that fails doesn't stop the next."""
    log = []
    for step in steps:
        if step.day is not None and today.day != step.day:
            log.append((step.name, "not_due", ""))
            continue
        try:
            step.run()
            log.append((step.name, "done", ""))
        except Exception as e:
            log.append((step.name, "failed", f"{type(e).__name__}: {e}"))
    return log
