"""The error function as a Column: rational approximations of the public fdlibm, below one unit in the last place
but for the tail, where the squared argument isn't split (absolute error below 2e-16)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .linalg import lit

# Coefficients of fdlibm's s_erf.c, constant terms first.
PP = (1.28379167095512558561e-01, -3.25042107247001499370e-01, -2.84817495755985104766e-02, -5.77027029648944159157e-03, -2.37630166566501626084e-05)
QQ = (1.0, 3.97917223959155352819e-01, 6.50222499887672944485e-02, 5.08130628187576562776e-03, 1.32494738004321644526e-04, -3.96022827877536812320e-06)
ERX = 8.45062911510467529297e-01
PA = (-2.36211856075265944077e-03, 4.14856118683748331666e-01, -3.72207876035701323847e-01, 3.18346619901161753674e-01, -1.10894694282396677476e-01, 3.54783043256182359371e-02, -2.16637559486879084300e-03)
QA = (1.0, 1.06420880400844228286e-01, 5.40397917702171048937e-01, 7.18286544141962662868e-02, 1.26171219808761642112e-01, 1.36370839120290507362e-02, 1.19844998467991074170e-02)
RA = (-9.86494403484714822705e-03, -6.93858572707181764372e-01, -1.05586262253232909814e01, -6.23753324503260060396e01, -1.62396669462573470355e02, -1.84605092906711035994e02, -8.12874355063065934246e01, -9.81432934416914548592e00)
SA = (1.0, 1.96512716674392571292e01, 1.37657754143519042600e02, 4.34565877475229228821e02, 6.45387271733267880336e02, 4.29008140027567833386e02, 1.08635005541779435134e02, 6.57024977031928170135e00, -6.04244152148580987438e-02)
RB = (-9.86494292470009928597e-03, -7.99283237680523006574e-01, -1.77579549177547519889e01, -1.60636384855821916062e02, -6.37566443368389627722e02, -1.02509513161107724954e03, -4.83519191608651397019e02)
SB = (1.0, 3.03380607434824582924e01, 3.25792512996573918826e02, 1.53672958608443695994e03, 3.19985821950859553908e03, 2.55305040643316442583e03, 4.74528541206955367215e02, -2.24409524465858183362e01)


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def erf(x) -> Column:
    x = lit(x)
    a = F.abs(x)
    z, t, s = a * a, a - 1, 1 / F.when(a == 0, F.lit(1.0)).otherwise(a * a)
    near = a + a * _poly(z, PP) / _poly(z, QQ)
    middle = F.lit(ERX) + _poly(t, PA) / _poly(t, QA)
    tail = lambda r, d: 1 - F.exp(-z - 0.5625 + _poly(s, r) / _poly(s, d)) / F.when(a == 0, F.lit(1.0)).otherwise(a)
    size = F.when(a < 0.84375, near).when(a < 1.25, middle).when(a < 1 / 0.35, tail(RA, SA)).when(a < 6, tail(RB, SB)).otherwise(F.lit(1.0))
    return F.when(F.isnan(x), x).when(x < 0, -size).otherwise(size)
