"""Immutable engine settings."""

from __future__ import annotations

from dataclasses import dataclass

#: fixed values: bands by survey mode, and the places of those used in the joint shape fit
BANDS = {"ogle": ("V", "I"), "gaia": ("g", "bp", "rp"), "ztf": ("zg", "zr", "zi")}
ACTIVATED = {"ogle": (1,), "gaia": (0, 1, 2), "ztf": (0, 1, 2)}
#: fixed values: Gaia zero points and their errors
ZERO_POINT = {"g": 25.6874, "bp": 25.3385, "rp": 24.7479}
ZERO_POINT_ERROR = {"g": 0.0028, "bp": 0.0028, "rp": 0.0028}


@dataclass(frozen=True)
class EngineConfig:
    """All knobs in one object; nothing is global."""

    mode: str = "gaia"
    m_min: int = 3
    m_max: int = 15
    m_pad: int = 2
    n_grid: int = 50
    err_floor: float = 0.001
    bic_tol_weight: float = 0.1
    corr_weight: float = 3.0
    amp: tuple[float, float] = (0.05, 2.0)
    #: largest coefficient or, in ``AQ`` mode, amplitude of a harmonic: one number, or one for each order
    amp_harmonic: float | tuple[float, ...] = 1.5
    coef_mode: str = "ab"
    #: whether the fit frees the period, within a tenth
    period_fit: bool = False
    tie_breaker: str = "minimum"
    pmin: float = 0.2
    pmax: float = 300.0
    n0: int = 2
    peaks: int = 5
    snr: float = 5.0
    harmonics: int = 1
    lam: tuple[float, float, float] = (1e-2, 1e-4, 5e-2)
    lam_spike: float = 0.1
    lam_harmonic: float = 10.0
    lam_slope: float = 0.03
    power: float = 4.0
    refit_sigma: float = 3.0
    refit_rounds: int = 3
    opt_method: str = "lasso"
    use_optim: bool = True
    branch_error: float = 0.03
    branch_bins: int = 5
    branch_points: int = 5
    huber_delta: float = 2.5
    period_tol: float = 1e-4

    def __post_init__(self) -> None:
        if self.mode not in BANDS:
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.coef_mode not in ("ab", "AQ") or self.tie_breaker not in ("minimum", "M_trunc"):
            raise ValueError(f"unknown coef_mode {self.coef_mode!r} or tie_breaker {self.tie_breaker!r}")
        if isinstance(self.amp_harmonic, tuple) and len(self.amp_harmonic) < self.m_max:
            raise ValueError("amp_harmonic needs a bound for each order")

    @property
    def bands(self) -> tuple[str, ...]:
        return BANDS[self.mode]

    @property
    def activated(self) -> tuple[str, ...]:
        return tuple(self.bands[i] for i in ACTIVATED[self.mode])
