"""What a calculation returns, and the budget that it runs under."""

from __future__ import annotations

import time
from dataclasses import dataclass, field


@dataclass
class Outcome:
    """An index with its status; a proven minimum only if none of the three flags is set."""

    index: int = -1
    runtime_limit_reached: bool = False
    enumeration_limit_reached: bool = False
    upper_bound_only: bool = False
    #: (kept, copy) pairs: intervals (offset, length) of a string, edge masks of a graph.
    steps: list = field(default_factory=list)
    #: (cpu nanoseconds, index) at each improvement.
    history: list[tuple[int, int]] = field(default_factory=list)
    states: int = 0

    @property
    def proven(self) -> bool:
        return not (self.runtime_limit_reached or self.enumeration_limit_reached or self.upper_bound_only)


class OutOfBudget(Exception):
    pass


class Budget:
    """Cooperative CPU budget; None never ends."""

    def __init__(self, cpu_ns: int | None):
        self.began = time.process_time_ns()
        self.until = None if cpu_ns is None else self.began + cpu_ns
        self.calls = 0

    def spent(self) -> int:
        return time.process_time_ns() - self.began

    def check(self) -> None:
        self.calls += 1
        if self.until is not None and self.calls % 64 == 1 and time.process_time_ns() >= self.until:
            raise OutOfBudget
