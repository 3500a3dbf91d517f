"""Radiometry on colour columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import _c, guard, u8_trunc

# Encoding exponent, luminance weights of linear colour, luma weights of encoded colour, and the
# constant of the first spherical-harmonics band.
GAMMA = 2.2
LUMINANCE = (0.2126, 0.7152, 0.0722)
LUMA = (0.299, 0.587, 0.114)
SH_BAND0 = 0.28209479177387814


def to_linear(c) -> Column:
    return F.pow(F.greatest(_c(c), F.lit(0.0)), F.lit(GAMMA))


def to_srgb(c) -> Column:
    return F.pow(F.greatest(_c(c), F.lit(0.0)), F.lit(1.0 / GAMMA))


def _weighted(weights, r, g, b) -> Column:
    return _c(r) * weights[0] + _c(g) * weights[1] + _c(b) * weights[2]


def luminance(r="r", g="g", b="b") -> Column:
    return _weighted(LUMINANCE, r, g, b)


def luma(r="r", g="g", b="b") -> Column:
    return _weighted(LUMA, r, g, b)


def f0_of_ior(ior) -> Column:
    """Reflectance at normal incidence."""
    return F.pow((_c(ior) - 1.0) / (_c(ior) + 1.0), F.lit(2.0))


def grazing_reflectance(f0, roughness) -> Column:
    """Largest reflectance of the roughness-capped lobe, reached at grazing incidence."""
    return F.greatest(F.lit(1.0) - _c(roughness), _c(f0))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def sh_to_u8(coefficient) -> Column:
    """First-band coefficient to an 8-bit channel."""
    return u8_trunc(F.lit(0.5) + F.lit(SH_BAND0) * _c(coefficient))


def jitter_contrast(x, contrast, brightness) -> Column:
    return (_c(x) - 0.5) * _c(contrast) + 0.5 + _c(brightness)


def safe_ratio(num, den, weak, otherwise, floor: float = 0.05) -> Column:
    """num / den, or `otherwise` where `weak` marks the denominator as unreliable."""
    return F.when(_c(weak), _c(otherwise)).otherwise(_c(num) / guard(den, floor))


__all__ = ["GAMMA", "LUMINANCE", "LUMA", "SH_BAND0", "to_linear", "to_srgb", "luminance", "luma", "f0_of_ior",
           "grazing_reflectance", "sigmoid", "sh_to_u8", "jitter_contrast", "safe_ratio"]
