"""Model, prior, schedule and study settings. Numbers here are fixed values of the domain."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace  # noqa: F401

DAY = 86_400.0
#: Width of a time chunk in seconds. Ordered operators split every market into
#: chunks of this width, so no task ever holds more than one market-hour of trades.
CHUNK_SECONDS = 3_600

MIN_STD = 1e-12
PRICE_EPS = 1e-6
SIZE_SCALE_FLOOR = 1e-8
DENOM_FLOOR = 0.1
LOG_LIK_FLOOR = -500.0
FIRST_TRADE_LOG_P = -500.0
PROB_FLOOR = 1e-300
VAR_FLOOR = 1e-6
Q_CLIP = 1e-6
EULER_GAMMA = 0.5772156649015329


@dataclass(frozen=True)
class ModelParams:
    """Switching state-space model parameters."""

    sigma2_0: float = 0.1
    sigma2_1: float = 1.0
    q_01: float = 0.05
    q_10: float = 0.50
    beta_S: float = 0.0
    beta_Z: float = 0.0
    tau2_0: float = 1.0
    tau2_1: float = 0.01
    a: float = 1.0
    b: float = 19.0
    gamma: float = 1.0
    s0_2: float = 1.0
    anonymous: bool = False
    alpha: float = 0.0

    @property
    def prior_mean(self) -> float:
        return self.a / (self.a + self.b)

    @classmethod
    def from_variance(cls, var_y: float, anonymous: bool = False) -> "ModelParams":
        """Moment-matched starting point from the pooled variance of the logit price."""
        base = cls(
            sigma2_0=0.1 * var_y,
            sigma2_1=var_y,
            tau2_0=var_y,
            tau2_1=0.01 * var_y,
            anonymous=anonymous,
        )
        if anonymous:
            base = replace(base, alpha=math.log(base.a / base.b))
        return base


@dataclass(frozen=True)
class Prior:
    """Prior hyper-parameters of the M-step."""

    sigma2_a: float = 2.0
    sigma2_b: float = 1.0
    tau2_a: float = 1e-9
    tau2_b: float = 1e-9
    q_a: float = 1.0
    q_b: float = 1.0
    beta_scale: float = 2.5
    alpha_scale: float = 10.0


@dataclass(frozen=True)
class OnlineConfig:
    """Forgetting schedule of the online scorer."""

    forgetting: float = 0.98
    n_refresh: int | None = None
    schedule: str = "fixed"
    rho_alpha: float = 0.6
    rho_t0: float = 50.0
    beta_window: int | None = None

    def __post_init__(self) -> None:
        if not 0.0 < self.forgetting <= 1.0:
            raise ValueError("forgetting must be in (0, 1]")
        if self.schedule not in ("fixed", "robbins_monro"):
            raise ValueError("schedule must be 'fixed' or 'robbins_monro'")
        if not 0.5 < self.rho_alpha <= 1.0:
            raise ValueError("rho_alpha must be in (0.5, 1]")
        if self.rho_t0 < 2.0:
            raise ValueError("rho_t0 must be >= 2")
        if self.beta_window is not None and self.beta_window < 2:
            raise ValueError("beta_window must be >= 2")

    @property
    def effective_window(self) -> float:
        return min(1.0 / (1.0 - self.forgetting + 1e-12), 1e6)

    @property
    def frozen(self) -> bool:
        """Whether no trade moves a parameter or a wallet's counts."""
        return self.schedule == "fixed" and self.forgetting == 1.0 and not (self.n_refresh and self.n_refresh > 0)

    def rho(self, t: int) -> float:
        if self.schedule == "fixed":
            return 1.0 - self.forgetting
        return (t + self.rho_t0) ** -self.rho_alpha


@dataclass(frozen=True)
class CostModel:
    """Spread and taker-fee model of one contract."""

    spread: float = 0.02
    fee_rate: float = 0.07

    def __post_init__(self) -> None:
        if self.spread < 0.0 or self.fee_rate < 0.0:
            raise ValueError("spread and fee_rate must be non-negative")


@dataclass(frozen=True)
class WindowSpec:
    """Event window ``[close - before, close - embargo)``."""

    before: float = 5.0 * DAY
    embargo: float = 1.0 * DAY

    def __post_init__(self) -> None:
        if not 0.0 <= self.embargo < self.before:
            raise ValueError("need 0 <= embargo < before")

    @property
    def locked(self) -> bool:
        return self.before == 5.0 * DAY and self.embargo == 1.0 * DAY


#: Entry thresholds of the costed backtest: 0.50 to 0.90 in steps of 0.05.
THRESHOLDS = tuple(round(0.50 + 0.05 * k, 2) for k in range(9))
N_SPLITS = 4
EMBARGO_S = DAY
