"""Summary statistics: the normal distribution and the rules that derive one column from others.

Missing is null. Where a formula has no finite value the result is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Z975 = 1.959963984540054

# Coefficients of Wichura's AS 241 (PPND16), lowest power first.
AS241 = (
    ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
     (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)),
    ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
     (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
     (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)),
)
# Coefficients of Hart's approximation of the normal tail, highest power first.
HART = (
    (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376),
    (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752),
)


def _poly(x: str, low_first) -> str:
    out = repr(low_first[-1])
    for c in reversed(low_first[:-1]):
        out = f"(({out}) * {x} + {c!r})"
    return out


def tail_sql(p: str) -> str:
    """SQL text of the argument that the tails of the quantile are polynomials of."""
    return f"sqrt(-ln(CASE WHEN ({p}) < 0.5e0 THEN ({p}) ELSE 1e0 - ({p}) END))"


def qnorm_sql(p: str, tail: str | None = None) -> str:
    """SQL text of the standard normal quantile, the same for Spark and DuckDB; null outside (0, 1). ``tail``: where its argument is at hand."""
    q = f"(({p}) - 0.5e0)"
    r0 = f"(0.180625e0 - {q} * {q})"
    tail = tail or tail_sql(p)
    mid, far = f"({tail} - 1.6e0)", f"({tail} - 5e0)"
    ratio = lambda k, x: f"({_poly(x, AS241[k][0])}) / ({_poly(x, AS241[k][1])})"
    side = f"(CASE WHEN {q} < 0 THEN -1e0 ELSE 1e0 END)"
    return f"CASE WHEN ({p}) > 0 AND ({p}) < 1 THEN CASE WHEN abs({q}) <= 0.425e0 THEN {q} * {ratio(0, r0)} WHEN {tail} <= 5e0 THEN {side} * {ratio(1, mid)} ELSE {side} * {ratio(2, far)} END END"


def pnorm_tail_sql(x: str) -> str:
    """SQL text of P(Z > |x|)."""
    a = f"abs({x})"
    top, bottom = _poly(a, HART[0][::-1]), _poly(a, HART[1][::-1])
    far = f"({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / ({a} + 4e0 / ({a} + 0.65e0)))))"
    density = f"exp(-{a} * {a} / 2e0)"
    return f"CASE WHEN {a} > 37e0 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN {density} * ({top}) / ({bottom}) ELSE {density} / ({far} * 2.506628274631e0) END"


def _bound(value: str, body: Callable[[str], str]) -> Column:
    """``body`` of a value that stands in the plan once, however often the text uses it."""
    return F.expr(f"get(transform(array({value}), v -> {body('v')}), 0)")


def _quantile(value: str) -> Column:
    """The normal quantile of a value; the value and the root of its logarithm are computed once."""
    both = f"transform(array({value}), v -> named_struct('p', v, 't', CASE WHEN v > 0 AND v < 1 THEN {tail_sql('v')} END))"
    return F.expr(f"get(transform({both}, s -> {qnorm_sql('s.p', 's.t')}), 0)")


def _name(c: Column | str) -> str:
    if not isinstance(c, str):
        raise TypeError("give the name of a column")
    return c


def qnorm(name: str) -> Column:
    """The standard normal quantile of a column of probabilities; -Inf and Inf at 0 and 1."""
    n = _name(name)
    return F.when(F.col(n) == 0, float("-inf")).when(F.col(n) == 1, float("inf")).otherwise(_quantile(n))


def pnorm(name: str) -> Column:
    """The standard normal distribution function of a column."""
    n = _name(name)
    return F.expr(f"CASE WHEN {n} > 0 THEN 1e0 - ({pnorm_tail_sql(n)}) ELSE {pnorm_tail_sql(n)} END")


def _over(a: Column, b: Column) -> Column:
    """a / b as IEEE has it, but null for 0 / 0."""
    inf = F.lit(float("inf"))
    return F.when(b != 0, a / b).when((b == 0) & (a > 0), inf).when((b == 0) & (a < 0), -inf)


def _c(name: str) -> Column:
    return F.col(name)


def z_from_p_beta(p: str, beta: str) -> Column:
    sign = F.signum(_c(beta))
    half = F.abs(_quantile(f"{p} / 2e0"))
    return F.when(_c(p) == 0, F.when(sign != 0, sign * F.lit(float("inf")))).otherwise(sign * half)


def z_from_beta_se(beta: str, se: str) -> Column:
    return _over(_c(beta), _c(se))


def p_from_z(z: str) -> Column:
    return 2.0 * _bound(z, pnorm_tail_sql)


def beta_from_z_se(z: str, se: str) -> Column:
    return _c(z) * _c(se)


def _spread(n: str, z: str, af: str) -> Column:
    return 2.0 * _c(af) * (1.0 - _c(af)) * (_c(n) + _c(z) * _c(z))


def beta_from_z_n_af(z: str, n: str, af: str) -> Column:
    return _over(_c(z), F.sqrt(_spread(n, z, af)))


def se_from_z_n_af(z: str, n: str, af: str) -> Column:
    return _over(F.lit(1.0), F.sqrt(_spread(n, z, af)))


def se_from_z_beta(z: str, beta: str) -> Column:
    return _over(_c(beta), _c(z))


def n_from_z_beta_af(z: str, beta: str, af: str) -> Column:
    z2 = _c(z) * _c(z)
    return _over(z2, 2.0 * _c(af) * (1.0 - _c(af)) * _c(beta) * _c(beta)) - z2


def beta_from_or(odds: str) -> Column:
    return F.log(_c(odds))


def se_from_or_ci(upper: str, lower: str) -> Column:
    return (F.log(_c(upper)) - F.log(_c(lower))) / (2.0 * Z975)


def neff(cases: str, controls: str) -> Column:
    inverse = _over(F.lit(1.0), _c(cases)) + _over(F.lit(1.0), _c(controls))
    return _over(F.lit(4.0), inverse)


def af_from_case_control(case_af: str, control_af: str, cases: str, controls: str) -> Column:
    return _over(_c(case_af) * _c(cases) + _c(control_af) * _c(controls), _c(cases) + _c(controls))


def no_nan(c: Column) -> Column:
    """NaN is missing; infinities stay until the last check of ranges."""
    return F.when(~F.isnan(c), c)


def in_range(name: str, c: Column) -> Column:
    """The value of a column where it is finite and one that the statistic can have."""
    finite = ~F.isnan(c) & (F.abs(c) != float("inf"))
    if name == "SE" or name in ("OR", "ORL95", "ORU95"):
        finite = finite & (c > 0)
    elif name in ("P", "EAF", "OAF", "CaseEAF", "CaseOAF", "ControlEAF", "ControlOAF"):
        finite = finite & c.between(0, 1)
    elif name in ("N", "CaseN", "ControlN", "INFO"):
        finite = finite & (c >= 0)
    return F.when(finite, c)


def numeric(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def is_missing_token(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin("", "nan", "none")
