"""Engine settings, by the stage that reads them; the numbers are fixed values of the retrieval method."""

from __future__ import annotations

from dataclasses import dataclass, field

AGGREGATIONS = ("weighted_mean", "max", "mean", "lse")
BOOSTS = ("mean", "max", "mode")
SCOPES = ("per_call", "per_query")


def _check(fine: bool, what: str) -> None:
    if not fine:
        raise ValueError(what)


@dataclass(frozen=True)
class Retrieval:
    """What regions and queries are compared with."""

    top_k: int = 20
    #: Regions of an image that are looked at, in the order of their ids; None looks at all.
    most_proposals: int | None = 180
    #: Regions see the candidates of their own query only, not the whole bank.
    own_candidates_only: bool = False

    def __post_init__(self) -> None:
        _check(self.top_k > 0, "top_k must be positive")


@dataclass(frozen=True)
class Evidence:
    """How hits become the score of a label."""

    method: str = "weighted_mean"
    best: int = 5
    temperature: float = 0.06
    margin_guard: float = 1e-6
    support_above: float = 0.0
    #: Share of the query's best similarity that a label needs, and the least similarity.
    label_ratio: float = 0.6
    label_floor: float = 0.35
    boost_weight: float = 0.2

    def __post_init__(self) -> None:
        _check(self.method in AGGREGATIONS, f"method must be one of {AGGREGATIONS}")
        _check(self.best > 0, "best must be positive")


@dataclass(frozen=True)
class Suppression:
    """Which boxes stay."""

    least: float = 0.15
    overlap: float = 0.5
    #: Boxes of one call suppress each other, or those of one query.
    scope: str = "per_call"

    def __post_init__(self) -> None:
        _check(self.scope in SCOPES, f"scope must be one of {SCOPES}")


@dataclass(frozen=True)
class EngineConfig:
    retrieval: Retrieval = field(default_factory=Retrieval)
    evidence: Evidence = field(default_factory=Evidence)
    suppression: Suppression = field(default_factory=Suppression)
