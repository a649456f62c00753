"""Settings of the analyzer, the graph and columns."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AnalyzerOptions:
    dims: int = 512
    identity: float = 0.9


@dataclass(frozen=True)
class GraphOptions:
    """Cosines from ``identical`` less ``precision`` on are identical; those above ``fold`` go left."""

    identical: float = 0.99
    fold: float = 0.55
    precision: float = 0.01


@dataclass(frozen=True)
class ColumnOptions:
    """``page_size`` in keys limits what a column holds, old keys and new ones, where it is set: from 0 to what an array may be long."""

    page_size: int | None = None

    def __post_init__(self) -> None:
        if self.page_size is not None and not 0 <= self.page_size <= 0x7FFFFFC7:
            raise ValueError(f"a page can't hold {self.page_size} keys")
