"""Spectral indices and background-relative features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..refdata import BAND_NM

#: Place of the near infrared between red and short-wave infrared.
# The indices' published slope and epsilons.
SLOPE = (BAND_NM["B8"] - BAND_NM["B4"]) / (BAND_NM["B11"] - BAND_NM["B4"])
BANDS = ("B1", "B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B11", "B12")


def ratio(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return (a - b) / (a + b + eps)


def steady_ratio(a: Column, b: Column, eps: float = 1e-3) -> Column:
    return (a - b) / (F.abs(a) + F.abs(b) + eps)


def debris_index(b6: Column, b8: Column, b11: Column) -> Column:
    return b8 - (b6 + (b11 - b6) * F.lit(SLOPE) * 10)


def algae_index(b4: Column, b8: Column, b11: Column) -> Column:
    return b8 - (b4 + (b11 - b4) * F.lit(SLOPE))


def indices(band=F.col) -> dict[str, Column]:
    b = lambda k: band(k)
    return {"NDVI": ratio(b("B8"), b("B4")), "FDI": debris_index(b("B6"), b("B8"), b("B11")), "FAI": algae_index(b("B4"), b("B8"), b("B11")), "NDWI": ratio(b("B3"), b("B8"))}


def relative(bands: tuple[str, ...] = BANDS, background: str = "bg_{}") -> dict[str, Column]:
    """dBand for each band and the indices of the differences; needs columns of the bands and of their backgrounds."""
    d = {k: F.col(k) - F.col(background.format(k)) for k in bands}
    out = {f"d{k}": v for k, v in d.items()}
    return out | {"dFDI": debris_index(d["B6"], d["B8"], d["B11"]), "dFAI": algae_index(d["B4"], d["B8"], d["B11"]), "dNDVI": steady_ratio(d["B8"], d["B4"]), "dNDWI": steady_ratio(d["B3"], d["B8"])}


def stretched(x: Column, full: float = 0.12, gamma: float = 2.2) -> Column:
    """Reflectance to display brightness, 0 to 1."""
    return F.least(F.greatest(F.pow(F.greatest(x, F.lit(0.0)) / full, F.lit(1 / gamma)), F.lit(0.0)), F.lit(1.0))


def scaled(dn: Column, scale: float, offset: float) -> Column:
    """Digital numbers to reflectance; 0 is missing."""
    return F.when(dn != 0, dn * scale + offset)
