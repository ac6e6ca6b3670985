"""Normal and beta distribution functions in numpy, and the small-sample factor of an SD."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NORMAL = NormalDist()


def upper_quantile(p: float) -> float:
    """z with upper tail p; infinite at 0 and 1."""
    if p <= 0:
        return math.inf
    if p >= 1:
        return -math.inf
    return -_NORMAL.inv_cdf(p)


def upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def stouffer(ps) -> float:
    """Upper-tail combination; NaN where a p of 0 meets a p of 1."""
    z = np.array([upper_quantile(float(p)) for p in ps])
    with np.errstate(invalid="ignore"):
        total = z.sum() / math.sqrt(len(z))
    return math.nan if math.isnan(total) else upper_tail(total)


def _continued_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _continued_fraction(a, b, x) / a
    return 1 - front * _continued_fraction(b, a, 1 - x) / b


def beta_quantile(p: float, a: float, b: float) -> float:
    if b <= 0:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        if beta_cdf(a, b, mid) < p:
            low = mid
        else:
            high = mid
        if high - low < 1e-16:
            break
    return (low + high) / 2


def clopper_pearson_upper(k: int, m: int, level: float = 0.975) -> float:
    """Upper bound of a proportion with k of m; the closed form at k = 0."""
    return 1 - (1 - level) ** (1 / m) if k == 0 else beta_quantile(level, k + 1, max(m - k, 0))


@F.pandas_udf(DoubleType())
def clopper_pearson(k: pd.Series, m: pd.Series) -> pd.Series:
    memo: dict = {}
    return pd.Series([memo[x] if x in memo else memo.setdefault(x, clopper_pearson_upper(*x)) for x in zip(k.astype(int).tolist(), m.astype(int).tolist())])


# Published rational approximations of the normal quantile (algorithm AS 241, centre, middle and tail) and of erfc (Cody 1969,
# centre, middle and tail); numerators and denominators with the constant first.
QUANTILE = (
    ((3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
     (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)),
    ((1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
     (1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    ((6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
     (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)),
)
ERFC = (
    ((3.20937758913846947e3, 3.77485237685302021e2, 1.13864154151050156e2, 3.16112374387056560, 1.85777706184603153e-1), (2.84423683343917062e3, 1.28261652607737228e3, 2.44024637934444173e2, 2.36012909523441209e1, 1.0)),
    ((1.23033935479799725e3, 2.05107837782607147e3, 1.71204761263407058e3, 8.81952221241769090e2, 2.98635138197400131e2, 6.61191906371416295e1, 8.88314979438837594, 5.64188496988670089e-1, 2.15311535474403846e-8),
     (1.23033935480374942e3, 3.43936767414372164e3, 4.36261909014324716e3, 3.29079923573345963e3, 1.62138957456669019e3, 5.37181101862021150e2, 1.17693950891312499e2, 1.57449261107098347e1, 1.0)),
    ((6.58749161529837803e-4, 1.60837851487422766e-2, 1.25781726111229246e-1, 3.60344899949804439e-1, 3.05326634961232344e-1, 1.63153871373020978e-2), (2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1, 1.87295284992346725, 2.56852019228982242, 1.0)),
)


def ratio_sql(pair, x: str) -> str:
    """A rational function of x as SQL that Spark and other engines share."""
    def poly(cs) -> str:
        out = repr(cs[-1]) + "e0" if "e" not in repr(cs[-1]) else repr(cs[-1])
        for c in cs[-2::-1]:
            out = f"({out}) * {x} + " + (repr(c) if "e" in repr(c) else repr(c) + "e0")
        return out

    return f"(({poly(pair[0])}) / ({poly(pair[1])}))"


def z_sql(p: str) -> str:
    """The z with upper tail p, infinite at 0 and 1, as SQL."""
    centre = f"((0.5e0 - {p}) * {ratio_sql(QUANTILE[0], f'(0.180625e0 - ({p} - 0.5e0) * ({p} - 0.5e0))')})"
    r = f"sqrt(-ln(least({p}, 1e0 - {p})))"
    outer = f"(CASE WHEN {p} < 0.5e0 THEN 1e0 ELSE -1e0 END * CASE WHEN {r} <= 5e0 THEN {ratio_sql(QUANTILE[1], f'({r} - 1.6e0)')} ELSE {ratio_sql(QUANTILE[2], f'({r} - 5e0)')} END)"
    return f"(CASE WHEN {p} <= 0e0 THEN CAST('Infinity' AS DOUBLE) WHEN {p} >= 1e0 THEN CAST('-Infinity' AS DOUBLE) WHEN abs({p} - 0.5e0) <= 0.425e0 THEN {centre} ELSE {outer} END)"


def tail_sql(z: str) -> str:
    """The upper tail at z as SQL; z is no NaN."""
    y, s = f"(abs({z}) / sqrt(2e0))", f"(({z}) * ({z}) / 2e0)"
    near = f"(1e0 - {y} * {ratio_sql(ERFC[0], s)})"
    middle = f"(exp(-{s}) * {ratio_sql(ERFC[1], y)})"
    far = f"(exp(-{s}) / {y} * (0.56418958354775628695e0 - {ratio_sql(ERFC[2], f'(1e0 / {s})')} / {s}))"
    erfc = f"(CASE WHEN {y} <= 0.46875e0 THEN {near} WHEN {y} <= 4e0 THEN {middle} WHEN {y} > 27e0 THEN 0e0 ELSE {far} END)"
    return f"(CASE WHEN {z} >= 0e0 THEN {erfc} / 2e0 ELSE 1e0 - {erfc} / 2e0 END)"


def _on(x: Column | str, body) -> Column:
    """body(x) with x computed once."""
    return F.get(F.transform(F.array(F.col(x) if isinstance(x, str) else x), body), F.lit(0))


def _ratio(pair, x: Column) -> Column:
    def poly(cs) -> Column:
        out = F.lit(cs[-1])
        for c in cs[-2::-1]:
            out = out * x + F.lit(c)
        return out

    return poly(pair[0]) / poly(pair[1])


def _z(p: Column) -> Column:
    r = F.sqrt(-F.log(F.least(p, 1.0 - p)))
    outer = F.when(p < 0.5, 1.0).otherwise(-1.0) * F.when(r <= 5, _ratio(QUANTILE[1], r - 1.6)).otherwise(_ratio(QUANTILE[2], r - 5.0))
    centre = (0.5 - p) * _ratio(QUANTILE[0], 0.180625 - (p - 0.5) * (p - 0.5))
    return F.when(p <= 0, F.lit(math.inf)).when(p >= 1, F.lit(-math.inf)).when(F.abs(p - 0.5) <= 0.425, centre).otherwise(outer)


def _tail(z: Column) -> Column:
    y, s = F.abs(z) / math.sqrt(2), z * z / 2
    far = F.exp(-s) / y * (0.56418958354775628695 - _ratio(ERFC[2], 1.0 / s) / s)
    erfc = F.when(y <= 0.46875, 1.0 - y * _ratio(ERFC[0], s)).when(y <= 4, F.exp(-s) * _ratio(ERFC[1], y)).when(y > 27, 0.0).otherwise(far)
    return F.when(z >= 0, erfc / 2).otherwise(1.0 - erfc / 2)


def z_of(p: Column | str) -> Column:
    """The z with upper tail p; infinite at 0 and 1."""
    return _on(p, _z)


def tail_of(z: Column | str) -> Column:
    """The upper tail at z; NaN stays."""
    return _on(z, lambda v: F.when(F.isnan(v), v).otherwise(_tail(v)))


def unbias_factor(n: int) -> float:
    """Factor that removes the small-sample bias of an SD over n values."""
    return math.sqrt((n - 1) / 2) * math.exp(math.lgamma((n - 1) / 2) - math.lgamma(n / 2))


def unbiased_sd(sd: Column, total: Column, below: int) -> Column:
    """sd, corrected where 2 <= total < below."""
    factors = F.create_map(*[x for n in range(2, below) for x in (F.lit(n), F.lit(unbias_factor(n)))])
    return F.when((total >= 2) & (total < below), sd * F.try_element_at(factors, total.cast("int"))).otherwise(sd)


def signif(x: Column, digits: int) -> Column:
    """x to so many significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when((x == 0) | x.isNull() | F.isnan(x), x).otherwise(F.floor(x * scale + 0.5) / scale)
