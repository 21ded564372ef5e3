"""Numeric column expressions. All are JVM expressions; no Python runs per row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fillwatch.config import DENOM_FLOOR, PRICE_EPS


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def null_if_nan(x) -> Column:
    """Undefined statistics are NULL in this library, never NaN."""
    x = _c(x)
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def logit(p, eps: float = PRICE_EPS) -> Column:
    c = F.greatest(F.least(_c(p), F.lit(1.0 - eps)), F.lit(eps))
    return F.log(c / (1.0 - c))


def sigmoid(x) -> Column:
    x = _c(x)
    grown = F.exp(F.least(x, F.lit(0.0)))
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-F.greatest(x, F.lit(0.0))))).otherwise(grown / (1.0 + grown))


def log1pexp(x) -> Column:
    x = _c(x)
    return F.when(x > 35.0, x).otherwise(F.log1p(F.exp(F.least(x, F.lit(35.0)))))


def horner(x: Column, coeffs) -> Column:
    """Polynomial with ``coeffs`` from the highest power down."""
    out = F.lit(float(coeffs[0]))
    for c in coeffs[1:]:
        out = out * x + F.lit(float(c))
    return out


# Hart's rational approximation of the normal CDF in West's (2005) form.
WEST_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376)
WEST_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)

# Wichura's (1988) AS241 rational approximation of the normal quantile.
AS241_CENTRE_NUM = (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4,
                    4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3,
                    1.3314166789178437745e2, 3.3871328727963666080e0)
AS241_CENTRE_DEN = (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4,
                    2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2,
                    4.2313330701600911252e1, 1.0)
AS241_MIDDLE_NUM = (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
                    1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0,
                    4.63033784615654529590e0, 1.42343711074968357734e0)
AS241_MIDDLE_DEN = (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
                    1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0,
                    2.05319162663775882187e0, 1.0)
AS241_TAIL_NUM = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
                  2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0,
                  5.46378491116411436990e0, 6.65790464350110377720e0)
AS241_TAIL_DEN = (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
                  7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
                  5.99832206555887937690e-1, 1.0)


def norm_sf(x) -> Column:
    """Upper tail of the standard normal."""
    x = _c(x)
    z = F.abs(x)
    gauss = F.exp(-z * z / 2.0)
    near = gauss * horner(z, WEST_NUM) / horner(z, WEST_DEN)
    frac = z + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        frac = z + F.lit(k) / frac
    tail = F.when(z > 37.0, 0.0).when(z < 7.07106781186547, near).otherwise(
        gauss / frac / 2.506628274631)
    return F.when(x >= 0, tail).otherwise(1.0 - tail)


def norm_cdf(x) -> Column:
    return norm_sf(-_c(x))


def norm_ppf(p) -> Column:
    """Normal quantile; NULL outside (0, 1)."""
    p = _c(p)
    q = p - 0.5
    r = F.lit(0.180625) - q * q
    centre = q * horner(r, AS241_CENTRE_NUM) / horner(r, AS241_CENTRE_DEN)
    t = F.sqrt(-F.log(F.least(p, 1.0 - p)))
    u, v = t - 1.6, t - 5.0
    size = F.when(t <= 5.0, horner(u, AS241_MIDDLE_NUM) / horner(u, AS241_MIDDLE_DEN)).otherwise(
        horner(v, AS241_TAIL_NUM) / horner(v, AS241_TAIL_DEN))
    return F.when(F.abs(q) <= 0.425, centre).when((p > 0) & (p < 1), F.signum(q) * size)


def chi2_sf_even(x, dof) -> Column:
    """Upper tail of chi-square for an even number of degrees of freedom."""
    half = _c(x) / 2.0
    terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest((_c(dof) / 2 - 1).cast("int"), F.lit(1))),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("acc")),
        lambda s, k: F.struct((s["term"] * half / k).alias("term"),
                              (s["acc"] + s["term"] * half / k).alias("acc")),
        lambda s: s["acc"],
    )
    return F.exp(-half) * F.when(_c(dof) <= 2, F.lit(1.0)).otherwise(terms)


def process_variance(v, delta, sigma2_0, sigma2_1) -> Column:
    return F.when(_c(v) == 0, _c(sigma2_0)).otherwise(_c(sigma2_1)) * _c(delta)


def size_denominator(log_size_ratio, gamma=1.0) -> Column:
    return F.greatest(1.0 + _c(gamma) * _c(log_size_ratio), F.lit(DENOM_FLOOR))


def obs_variance(z, log_size_ratio, tau2_0, tau2_1, gamma=1.0) -> Column:
    return F.when(_c(z) == 0, _c(tau2_0)).otherwise(_c(tau2_1)) / size_denominator(log_size_ratio, gamma)


def taker_fee(price, fee_rate) -> Column:
    p = _c(price)
    return _c(fee_rate) * p * (1.0 - p)


def billed_fee(price, contracts, fee_rate) -> Column:
    """Fee in dollars, rounded up to the cent after removing representation noise."""
    p = _c(price)
    cents = _c(fee_rate) * _c(contracts) * p * (1.0 - p) * 100.0
    return F.ceil(F.round(cents, 9)) / 100.0


def entry_cost(price, side, spread, fee_rate) -> Column:
    """All-in cost of one contract; an unknown side gives NULL."""
    p = _c(price)
    mid = F.when(_c(side) == "yes", p).when(_c(side) == "no", 1.0 - p)
    return mid + _c(spread) / 2.0 + taker_fee(p, fee_rate)


def log_invgamma(x, a: float, b: float) -> Column:
    x = _c(x)
    return F.lit(a * math.log(b) - math.lgamma(a)) - (a + 1.0) * F.log(x) - b / x


def log_beta(x, a: float, b: float) -> Column:
    x = _c(x)
    const = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    return (a - 1.0) * F.log(x) + (b - 1.0) * F.log1p(-x) - F.lit(const)


def log_cauchy(x, scale: float) -> Column:
    return F.lit(-math.log(math.pi * scale)) - F.log1p((_c(x) / scale) * (_c(x) / scale))


def learning_rate(t, schedule: str, forgetting: float, rho_alpha: float, rho_t0: float) -> Column:
    if schedule == "fixed":
        return F.lit(1.0 - forgetting)
    return F.pow(_c(t) + rho_t0, F.lit(-rho_alpha))


def effective_window(forgetting) -> Column:
    return F.least(1.0 / (1.0 - _c(forgetting) + 1e-12), F.lit(1e6))


def wilson(hits, n, z=None, level: float = 0.95):
    """Wilson score bounds; ``(0, 1)`` when there is no trial. ``z`` overrides the level's quantile."""
    z = norm_ppf(F.lit(0.5 + level / 2.0)) if z is None else _c(z)
    n_, k = _c(n).cast("double"), _c(hits).cast("double")
    safe = F.when(n_ > 0, n_)
    p = k / safe
    shrink = 1.0 + z * z / safe
    mid = (p + z * z / (2.0 * safe)) / shrink
    half = z / shrink * F.sqrt(p * (1.0 - p) / safe + z * z / (4.0 * safe * safe))
    return (F.coalesce(F.greatest(mid - half, F.lit(0.0)), F.lit(0.0)),
            F.coalesce(F.least(mid + half, F.lit(1.0)), F.lit(1.0)))
