"""Normal distribution as SQL text that Spark and any ANSI engine evaluate alike."""

from __future__ import annotations

# fixed values: Hart's rational approximation of the normal distribution function
_CDF_NUM = [220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 3.52624965998911e-02]
_CDF_DEN = [440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-02]
# fixed values: Wichura's AS 241 for the normal quantile
_A = [3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727]
_B = [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610]
_C = [1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4]
_D = [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9]
_E = [6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7]
_F = [1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]


def _poly(coefficients: list[float], x: str) -> str:
    out = f"{coefficients[-1]!r}e0" if "e" not in repr(coefficients[-1]) else repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        lit = f"{c!r}e0" if "e" not in repr(c) else repr(c)
        out = f"({out} * {x} + {lit})"
    return out


def normal_cdf(x: str) -> str:
    """SQL for the standard normal distribution function of a column or plain expression."""
    a = f"abs({x})"
    tail = f"exp(-{a} * {a} / 2e0) * {_poly(_CDF_NUM, a)} / {_poly(_CDF_DEN, a)}"
    return f"(CASE WHEN {a} > 7e0 THEN CASE WHEN {x} > 0 THEN 1e0 ELSE 0e0 END WHEN {x} > 0 THEN 1e0 - {tail} ELSE {tail} END)"


def normal_ppf(p: str) -> str:
    """SQL for the standard normal quantile, 0 < p < 1."""
    q = f"({p} - 5e-1)"
    r0 = f"(1.80625e-1 - {q} * {q})"
    r = f"sqrt(-ln(CASE WHEN {q} < 0 THEN {p} ELSE 1e0 - {p} END))"
    near = f"({_poly(_C, f'({r} - 1.6e0)')} / {_poly(_D, f'({r} - 1.6e0)')})"
    far = f"({_poly(_E, f'({r} - 5e0)')} / {_poly(_F, f'({r} - 5e0)')})"
    return f"(CASE WHEN abs({q}) <= 4.25e-1 THEN {q} * {_poly(_A, r0)} / {_poly(_B, r0)} ELSE CASE WHEN {q} < 0 THEN -1e0 ELSE 1e0 END * CASE WHEN {r} <= 5e0 THEN {near} ELSE {far} END END)"


def parkinson(high: str = "high", low: str = "low") -> str:
    """SQL for the range-based variance of a bar; null for prices that are not positive."""
    return f"(CASE WHEN {high} > 0 AND {low} > 0 THEN ln({high} / {low}) * ln({high} / {low}) / (4e0 * ln(2e0)) END)"


def clamp(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {low!r}e0), {high!r}e0)"
