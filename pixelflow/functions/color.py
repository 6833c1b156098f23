"""Colour and score expressions; every function maps columns to a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gray(r="r", g="g", b="b") -> Column:
    """8-bit gray in fixed point, weights .299 .587 .114 at 14 bits."""
    return F.floor((F.col(r) * 4899 + F.col(g) * 9617 + F.col(b) * 1868 + 8192) / 16384).cast("long")


def gray_float(r="r", g="g", b="b") -> Column:
    """Gray in 0..1 with weights .2125 .7154 .0721."""
    return (F.col(r) * F.lit(0.2125) + F.col(g) * F.lit(0.7154) + F.col(b) * F.lit(0.0721)) / F.lit(255.0)


def luma(r="r", g="g", b="b") -> Column:
    """1000 times the luma, in integers."""
    return F.col(r) * 299 + F.col(g) * 587 + F.col(b) * 114


def lab(r="r", g="g", b="b") -> tuple[Column, Column, Column]:
    """sRGB to CIE L*a*b* under D65."""
    linear = []
    for c in (r, g, b):
        v = F.col(c) / F.lit(255.0)
        linear.append(F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92))
    lr, lg, lb = linear
    xyz = ((lr * 0.412453 + lg * 0.35758 + lb * 0.180423) / 0.95047, lr * 0.212671 + lg * 0.71516 + lb * 0.072169, (lr * 0.019334 + lg * 0.119193 + lb * 0.950227) / 1.08883)
    fx, fy, fz = (F.when(c > 0.008856, F.cbrt(c)).otherwise(c * 7.787 + 16.0 / 116.0) for c in xyz)
    return fy * 116 - 16, (fx - fy) * 500, (fy - fz) * 200


def lab8(r="r", g="g", b="b") -> tuple[Column, Column, Column]:
    """L*a*b* in 8 bits: L * 255 / 100, a + 128, b + 128, rounded."""
    l_, a_, b_ = lab(r, g, b)
    return tuple(clip(F.floor(c + 0.5), 0, 255).cast("long") for c in (l_ * 2.55, a_ + 128, b_ + 128))


def from_lab8(l_="l", a="a", b="b") -> tuple[Column, Column, Column]:
    """8-bit L*a*b* back to 8-bit sRGB under D65."""
    fy = (F.col(l_) * (100.0 / 255.0) + 16) / 116
    whole = lambda f: F.when(f > 0.206893, F.pow(f, F.lit(3.0))).otherwise((f - 16.0 / 116.0) / 7.787)
    x, y, z = whole(fy + (F.col(a) - 128) / 500) * 0.95047, whole(fy), whole(fy - (F.col(b) - 128) / 200) * 1.08883
    linear = (x * 3.240479 - y * 1.53715 - z * 0.498535, x * -0.969256 + y * 1.875991 + z * 0.041556, x * 0.055648 - y * 0.204043 + z * 1.057311)
    curved = (F.when(c > 0.0031308, F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055).otherwise(c * 12.92) for c in linear)
    return tuple(clip(F.floor(c * 255 + 0.5), 0, 255).cast("long") for c in curved)


def clip(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def split_window(size: Column) -> Column:
    """ceil(ceil(log10 size) * ln size)."""
    return F.ceil(F.ceil(F.log10(size)) * F.log(size))


def sigmoid_segments(score: Column, window: Column) -> Column:
    """max(1, ceil(window / (1 + exp(-12 (score - .5)))))."""
    return F.greatest(F.lit(1), F.ceil(window / (F.exp((score - 0.5) * -12) + 1)))


def optimal_segments(score: Column, area: Column, low: int = 5, high: int = 50) -> Column:
    return clip(F.floor(score * F.sqrt(area)), low, high)


def psnr(mse: Column) -> Column:
    """Peak 255; infinite where the error is 0."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(F.log10(F.lit(65025.0) / mse) * 10)


def rating(psnr_: Column) -> Column:
    """Four levels, at 40, 30 and 20 dB."""
    return F.when(psnr_ > 40, "excellent").when(psnr_ > 30, "good").when(psnr_ > 20, "acceptable").otherwise("poor")


def rating_five(psnr_: Column) -> Column:
    """Five levels, at 40, 35, 30 and 25 dB."""
    return F.when(psnr_ > 40, "excellent").when(psnr_ > 35, "very good").when(psnr_ > 30, "good").when(psnr_ > 25, "acceptable").otherwise("poor")


def rating_ssim(ssim: Column) -> Column:
    return F.when(ssim > 0.95, "excellent").when(ssim > 0.85, "good").when(ssim > 0.7, "acceptable").otherwise("poor")


def index_dtype(top: Column) -> Column:
    """The narrowest unsigned type that holds indices up to `top`."""
    return F.when(top < 256, "uint8").when(top < 65536, "uint16").otherwise("uint32")
