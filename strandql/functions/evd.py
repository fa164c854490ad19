"""Extreme-value statistics of scores as column expressions."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published weights of the regression nets over (length of query, of target, Neff of query, of target);
# for each hidden unit its four input weights, its bias and its output weight.
LAMBDA_NET = [
    ((-0.52356, -3.37650, 1.12984, -0.46796), -0.73195, 2.45630),
    ((-4.71361, 0.14166, 1.66807, 0.16383), -1.43792, 3.02905),
    ((-0.94895, -1.24358, -1.20293, 0.95434), -1.18839, 2.53803),
    ((-0.00318, 0.53022, -0.04914, -0.77046), -3.01141, 2.64379),
]
MU_NET = [
    ((1.96172, 1.07181, -7.41256, 0.26471), -4.25264, -1.26036),
    ((0.84643, 1.46777, -1.04800, -0.51425), -3.63484, 1.52812),
    ((1.42697, 1.99927, 0.64647, 0.27834), -5.86653, 1.58413),
    ((1.34216, 1.64064, 0.35538, -8.08311), -4.78472, -1.90409),
    ((2.30046, 1.31700, -0.46435, -0.46803), -2.76356, 0.92803),
    ((0.90090, -3.53067, 0.59212, 1.47503), -2.21580, -0.66871),
]
MU_SCALE = 20.0
#: (a squared, b, c squared, d) of the probability curve, by (local, with structure).
PROBABILITY = {(True, True): (6000.0, 5.0, 0.12, 64.0), (True, False): (4000.0, 5.0, 0.15, 68.0), (False, True): (4000.0, 6.0, 0.13, 68.0), (False, False): (6000.0, 5.0, 0.10, 74.0)}


def net(weights: list, inputs: list[Column]) -> Column:
    """One hidden layer of logistic units, linear output."""
    out = F.lit(0.0)
    for w, bias, scale in weights:
        z = F.lit(bias)
        for x, v in zip(inputs, w):
            z = z + x * v
        out = out + F.lit(scale) / (1 + F.exp(-z))
    return out


def scaled(length: Column, neff: Column) -> tuple[Column, Column]:
    """Inputs of the nets: logarithm of the length by that of 1000, a tenth of Neff."""
    return F.log(length) / log(1000.0), neff / 10.0


def evd_lambda(q_len: Column, t_len: Column, q_neff: Column, t_neff: Column) -> Column:
    (lq, nq), (lt, nt) = scaled(q_len, q_neff), scaled(t_len, t_neff)
    return net(LAMBDA_NET, [lq, lt, nq, nt])


def evd_mu(q_len: Column, t_len: Column, q_neff: Column, t_neff: Column) -> Column:
    (lq, nq), (lt, nt) = scaled(q_len, q_neff), scaled(t_len, t_neff)
    return MU_SCALE * net(MU_NET, [lq, lt, nq, nt])


def p_value(score: Column, lam: Column, mu: Column) -> Column:
    h = lam * (score - mu)
    return F.when(h > 10, F.exp(-h)).otherwise(1.0 - F.exp(-F.exp(-h)))


def log_p_value(score: Column, lam: Column, mu: Column) -> Column:
    h = lam * (score - mu)
    return F.when(h > 10, -h).when(h < -2.5, -F.exp(-F.exp(-h))).otherwise(F.log(1.0 - F.exp(-F.exp(-h))))


def score_of_p(log_p: Column, p: Column, lam: Column, score: Column, score_ss: Column) -> Column:
    """The score in bits that hits are ranked by; the lower the better."""
    # The logarithm of zero is null here: a P of one is the worst score there is.
    base = F.when(log_p < -10.0, log_p).when(p >= 1.0, float("inf")).otherwise(F.log(-F.log(1 - p)))
    return base / 0.45 - F.least(lam * score_ss, F.greatest(F.lit(0.0), 0.2 * (score - 8.0))) / 0.45 - 3.0


def probability(score_aass: Column, local: bool = True, structure: bool = False) -> Column:
    """Probability in percent that a hit is true."""
    a2, b, c2, d = PROBABILITY[local, structure]
    s = -score_aass
    t = a2**0.5 * F.exp(-s / b) + c2**0.5 * F.exp(-s / d)
    return F.when(s > 200, 100.0).otherwise(100.0 / (1.0 + t * t))


def composite_alpha(q_neff: Column, t_neff: Column, a: float, b: float, c: float) -> Column:
    return a + b * (t_neff - 1) * (1 - c * (q_neff - 1))
