"""Settings of a semantic window."""

from __future__ import annotations

from dataclasses import dataclass

from tripletide.operators.window import POLICIES


@dataclass(frozen=True)
class WindowSpec:
    """A window of ``size`` graphs of ``n_triples`` triples that loses ``evict`` graphs a step.

    ``evictions`` bounds the number of steps; None runs to the end of the stream.
    """

    size: int
    evict: int
    policy: str
    query_class: str
    explain_class: str
    n_triples: int = 1
    evictions: int | None = None
    regime: str = "restriction"

    def __post_init__(self) -> None:
        if self.policy not in POLICIES:
            raise ValueError(f"policy must be one of {POLICIES}")
        if not 1 <= self.evict <= self.size:
            raise ValueError("evict must lie between 1 and size")
