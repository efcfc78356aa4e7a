"""Plain values that operators share."""

from __future__ import annotations

from dataclasses import dataclass

#: The five forms of the objective, by their number on the command line.
MODES = {1: "kmeans", 2: "nog", 3: "nokk2m", 4: "nophi", 5: "gaverage"}
PHIS = ("cosine", "pearson", "sigmoid")
ALGORITHMS = ("MGA", "BGD")
#: What is reported as the number of bins where there are none.
CONSTANT_BINS = 5


@dataclass(frozen=True)
class Anchors:
    """The calibrated curve g(d): sorted centers and the mean similarity at each."""

    centers: tuple[float, ...] = ()
    means: tuple[float, ...] = ()

    @property
    def midpoints(self) -> list[float]:
        return [0.5 * (a + b) for a, b in zip(self.centers, self.centers[1:])]


@dataclass(frozen=True)
class Totals:
    """Scalars of a reweighted graph."""

    two_m: float
    two_m_w: float
    g_average: float


@dataclass(frozen=True)
class Objective:
    """What a penalty needs besides the rows: mode, resolution, totals and the curve."""

    mode: str
    gamma: float
    totals: Totals
    anchors: Anchors = Anchors()

    @property
    def constant_g(self) -> float | None:
        """The value of g where it does not depend on distance."""
        return {"nog": 1.0, "gaverage": self.totals.g_average}.get(self.mode)

    @property
    def by_degree(self) -> bool:
        """Whether the expected weight of a pair is scaled by its degrees."""
        return self.mode != "nokk2m"


@dataclass(frozen=True)
class Config:
    """One run. Everything is validated before any work is done."""

    algorithm: str = "MGA"
    phi: str = "cosine"
    gamma: float = 1.0
    sampling: float = 0.3
    g: int = 1
    seed: int = 42
    seeding: str = "quantile"
    solver: str = "auto"
    consider_initial: bool = False
    max_bgd_nodes: int | None = None

    def __post_init__(self) -> None:
        for value, allowed, name in ((self.algorithm, ALGORITHMS, "algorithm"), (self.phi, PHIS, "phi"), (self.g, tuple(MODES), "g"), (self.seeding, ("quantile", "plusplus"), "seeding"), (self.solver, ("auto", "component", "bulk"), "solver")):
            if value not in allowed:
                raise ValueError(f"{name} is {value!r}; it can be {', '.join(map(str, allowed))}")
        if not self.sampling > 0:
            raise ValueError("sampling must be positive")

    @property
    def mode(self) -> str:
        return MODES[self.g]
