"""Scalar functions as column expressions, with the same formula as SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational approximation 7.1.26 of the error function (Abramowitz and Stegun).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """Error function, absolute error below 1.5e-7."""
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function."""
    return 0.5 * (1 + erf(x / 2**0.5))


def norm_cdf_sql(x: str) -> str:
    """The same as SQL."""
    z = f"({x} / {2**0.5!r})"
    t = f"(1 / (1 + {ERF_P} * abs({z})))"
    poly = "0.0"
    for a in reversed(ERF_A):
        poly = f"(({poly} + {a}) * {t})"
    return f"(0.5 * (1 + sign({z}) * (1 - {poly} * exp(-{z} * {z}))))"


def sigmoid(x: Column) -> Column:
    """Logistic function of an argument held within +-50."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x))))


def logit(p: Column, eps: float = 1e-7) -> Column:
    """Log odds of a probability held within eps of 0 and 1."""
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.log(q / (1 - q))


def t_cdf_5(x: Column) -> Column:
    """Student t distribution function with 5 degrees of freedom, in closed form."""
    th = F.atan(x / 5**0.5)
    c = F.cos(th)
    return 0.5 + (th + F.sin(th) * (c + 2.0 / 3.0 * c * c * c)) / 3.141592653589793


def business_days(a: Column, b: Column) -> Column:
    """Weekdays in [a, b), by counting weekdays since a fixed Monday."""

    def since(d: Column) -> Column:
        n = F.datediff(d, F.lit("1970-01-05").cast("date"))
        return F.floor(n / 7) * 5 + F.least(n - F.floor(n / 7) * 7, F.lit(5))

    return (since(b) - since(a)).cast("int")


def forecast_id(ticker: Column, dt: Column, horizon: Column, version: Column) -> Column:
    """Deterministic id: 16 hex digits of the SHA-256 of ticker:date:H<h>:version."""
    return F.substring(F.sha2(F.concat(ticker, F.lit(":"), dt.cast("string"), F.lit(":H"), horizon.cast("string"), F.lit(":"), version).cast("binary"), 256), 1, 16)
