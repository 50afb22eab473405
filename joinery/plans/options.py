"""Query parameters, and the combinations that are refused."""

from __future__ import annotations

from dataclasses import dataclass

from joinery.kernels.graph_search import ENUMERATION_LIMIT


class OptionError(ValueError):
    pass


@dataclass(frozen=True)
class _Options:
    algorithm: str = "exact"
    cpu_budget_ns: int | None = None
    with_pathway: bool = False
    with_history: bool = False

    def __post_init__(self) -> None:
        if self.algorithm not in ("exact", "repair"):
            raise OptionError("algorithm is exact or repair")
        if self.cpu_budget_ns is not None and self.cpu_budget_ns < 0:
            raise OptionError("a CPU budget is not negative")
        if self.algorithm == "repair" and self.cpu_budget_ns is not None:
            raise OptionError("repair takes no CPU budget")
        if self.algorithm == "repair" and self.with_history:
            raise OptionError("repair has no history of improvements")


@dataclass(frozen=True)
class StringOptions(_Options):
    accept_reversed: bool = False
    #: Stop at the first pathway of this index.
    target_index: int | None = None


@dataclass(frozen=True)
class GraphOptions(_Options):
    remove_hydrogens: bool = True
    compensate_disjoint: bool = False
    enumeration_limit: int = ENUMERATION_LIMIT

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.enumeration_limit < 1:
            raise OptionError("an enumeration limit is at least 1")
        if self.algorithm == "repair" and self.enumeration_limit != ENUMERATION_LIMIT:
            raise OptionError("repair takes no enumeration limit")
