"""The standard normal quantile as an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeweft.functions.arrays import bound

# fixed values: the coefficients of algorithm AS 241 (Wichura 1988) for the normal quantile, highest power first, with 1 last
# in the denominators; the branch beyond r = 5 is for probabilities under 1e-11, which
# ranks of fewer than 10^10 draws don't have
NEAR_TOP = (
    "2.5090809287301226727e+3", "3.3430575583588128105e+4", "6.7265770927008700853e+4", "4.5921953931549871457e+4",
    "1.3731693765509461125e+4", "1.9715909503065514427e+3", "1.3314166789178437745e+2", "3.3871328727963666080e+0",
)
NEAR_BOTTOM = (
    "5.2264952788528545610e+3", "2.8729085735721942674e+4", "3.9307895800092710610e+4", "2.1213794301586595867e+4",
    "5.3941960214247511077e+3", "6.8718700749205790830e+2", "4.2313330701600911252e+1",
)
FAR_TOP = (
    "7.74545014278341407640e-4", "2.27238449892691845833e-2", "2.41780725177450611770e-1", "1.27045825245236838258e+0",
    "3.64784832476320460504e+0", "5.76949722146069140550e+0", "4.63033784615654529590e+0", "1.42343711074968357734e+0",
)
FAR_BOTTOM = (
    "1.05075007164441684324e-9", "5.47593808499534494600e-4", "1.51986665636164571966e-2", "1.48103976427480074590e-1",
    "6.89767334985100004550e-1", "1.67638483018380384940e+0", "2.05319162663775882187e+0",
)


def polynomial(coefficients: tuple[str, ...], x: Column) -> Column:
    value = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        value = value * x + F.lit(float(c))
    return value


def normal_quantile(p: Column) -> Column:
    q = p - 0.5
    inside = bound(F.lit(0.180625) - q * q, lambda x: polynomial(NEAR_TOP, x) / polynomial((*NEAR_BOTTOM, "1.0"), x))
    far = F.sqrt(-F.ln(F.least(p, 1 - p))) - 1.6
    outside = bound(far, lambda x: polynomial(FAR_TOP, x) / polynomial((*FAR_BOTTOM, "1.0"), x))
    return F.when(F.abs(q) <= 0.425, q * inside).otherwise(F.signum(q) * outside)
