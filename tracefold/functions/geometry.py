"""Survey grids as column expressions, and small header functions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTSIDE = -2_147_483_645  # fixed value of cells outside a grid


@dataclass(frozen=True)
class Grid:
    """A rotated rectangle of cells: corner A, the direction of inlines towards B, of crosslines towards C."""

    ax: float
    ay: float
    cos: float
    sin: float
    wb: float
    wc: float
    nb: int
    nc: int
    hand: int  # 1 if C lies to the left of A -> B, else -1

    @classmethod
    def from_corners(cls, a: tuple[float, float], b: tuple[float, float], c: tuple[float, float], wb: float, wc: float) -> Grid:
        """Corners are cell centres; C is only needed for its side and distance from the line A -> B."""
        if wb <= 0 or wc <= 0:
            raise ValueError("cell widths must be positive")
        length = math.hypot(b[0] - a[0], b[1] - a[1])
        if length == 0:
            raise ValueError("corners A and B coincide")
        cos, sin = (b[0] - a[0]) / length, (b[1] - a[1]) / length
        across = -(c[0] - a[0]) * sin + (c[1] - a[1]) * cos
        return cls(a[0], a[1], cos, sin, wb, wc, 1 + round(length / wb), 1 + round(abs(across) / wc), 1 if across >= 0 else -1)

    def to_grid(self, x: Column, y: Column) -> tuple[Column, Column]:
        dx, dy = x - self.ax, y - self.ay
        return dx * self.cos + dy * self.sin, (dy * self.cos - dx * self.sin) * self.hand

    def to_raw(self, gx: Column, gy: Column) -> tuple[Column, Column]:
        return self.ax + gx * self.cos - gy * self.hand * self.sin, self.ay + gx * self.sin + gy * self.hand * self.cos

    def cell(self, x: Column, y: Column) -> tuple[Column, Column, Column]:
        """(cdp, inline, crossline) of raw coordinates, numbered from 1."""
        gx, gy = self.to_grid(x, y)
        ib, ic = F.floor(gx / self.wb + 0.5) + 1, F.floor(gy / self.wc + 0.5) + 1
        inside = ib.between(1, self.nb) & ic.between(1, self.nc)
        out = lambda v: F.when(inside, v).otherwise(F.lit(OUTSIDE)).cast("long")
        return out(ib + (ic - 1) * self.nb), out(ib), out(ic)

    def cdp(self, ib: Column, ic: Column) -> Column:
        inside = ib.between(1, self.nb) & ic.between(1, self.nc)
        return F.when(inside, ib + (ic - 1) * self.nb).otherwise(F.lit(OUTSIDE)).cast("long")

    def cell_of_cdp(self, cdp: Column) -> tuple[Column, Column]:
        inside = cdp.between(1, self.nb * self.nc)
        out = lambda v: F.when(inside, v).otherwise(F.lit(OUTSIDE)).cast("long")
        return out(F.pmod(cdp - 1, F.lit(self.nb)) + 1), out(F.floor((cdp - 1) / self.nb) + 1)

    def centre(self, ib: Column, ic: Column) -> tuple[Column, Column]:
        return self.to_raw((ib - 1) * self.wb, (ic - 1) * self.wc)


def is_seismic(trid: Column) -> Column:
    """Whether a trace identification code is one of recorded seismic data (or unset)."""
    return (trid == 0) | (trid == 1)


def before_comma(s: Column) -> Column:
    return F.substring_index(s, ",", 1)


def offset_function(kind: int, offset: Column, intercept: float = 0.0, depth: float = 1.0) -> Column:
    """Moveout g(x) of x = offset - intercept: 1 x², 2 √(z²+x²), 3 x, 4 |x|, 5 √(z²+x²) - z, else 0."""
    x = offset - intercept
    root = F.sqrt(depth * depth + x * x)
    return {1: x * x, 2: root, 3: x, 4: F.abs(x), 5: root - depth}.get(kind, F.lit(0.0)).cast("double")


def ramp_weight(f: Column, f1: float, f2: float) -> Column:
    """1 up to f1, 0 from f2 on, a line between."""
    return F.when(f <= f1, 1.0).when(f >= f2, 0.0).otherwise((f2 - f) / (f2 - f1))


# --- transversely isotropic media ---------------------------------------------


def thomsen_to_stiffness(vp: Column, vs: Column, eps: Column, delta: Column, gamma: Column) -> dict[str, Column]:
    """Density-normalised stiffnesses of a vertical axis from Thomsen parameters."""
    c33, c44 = vp * vp, vs * vs
    c11, c66 = c33 * (1 + 2 * eps), c44 * (1 + 2 * gamma)
    c13 = F.sqrt(2 * delta * c33 * (c33 - c44) + (c33 - c44) * (c33 - c44)) - c44
    return {"c11": c11, "c33": c33, "c13": c13, "c44": c44, "c66": c66}


def stiffness_to_thomsen(c: dict[str, Column]) -> dict[str, Column]:
    d = c["c33"] - c["c44"]
    s = c["c13"] + c["c44"]
    return {"vp": F.sqrt(c["c33"]), "vs": F.sqrt(c["c44"]), "eps": (c["c11"] - c["c33"]) / (2 * c["c33"]), "delta": (s * s - d * d) / (2 * c["c33"] * d), "gamma": (c["c66"] - c["c44"]) / (2 * c["c44"])}


def phase_velocity(c: dict[str, Column], sine: Column, mode: str = "P") -> Column:
    """Phase velocity at an angle from the axis, of the P, SV or SH wave."""
    s2 = sine * sine
    k2 = 1 - s2
    if mode == "SH":
        return F.sqrt(c["c66"] * s2 + c["c44"] * k2)
    a, b = c["c11"] * s2 + c["c44"] * k2, c["c44"] * s2 + c["c33"] * k2
    root = F.sqrt((a - b) * (a - b) + 4 * (c["c13"] + c["c44"]) * (c["c13"] + c["c44"]) * s2 * k2)
    return F.sqrt((a + b + (root if mode == "P" else -root)) / 2)


def reflection_pp(vp1: Column, vs1: Column, rho1: Column, vp2: Column, vs2: Column, rho2: Column, sine: Column) -> Column:
    """Exact plane-wave P to P reflection coefficient between isotropic halves; null beyond a critical angle."""
    p = sine / vp1
    cosine = lambda v: F.when(p * v <= 1, F.sqrt(1 - p * p * v * v))
    ci1, ci2, cj1, cj2 = cosine(vp1), cosine(vp2), cosine(vs1), cosine(vs2)
    k1, k2 = 1 - 2 * vs1 * vs1 * p * p, 1 - 2 * vs2 * vs2 * p * p
    a = rho2 * k2 - rho1 * k1
    b = rho2 * k2 + 2 * rho1 * vs1 * vs1 * p * p
    c = rho1 * k1 + 2 * rho2 * vs2 * vs2 * p * p
    d = 2 * (rho2 * vs2 * vs2 - rho1 * vs1 * vs1)
    e, f = b * ci1 / vp1 + c * ci2 / vp2, b * cj1 / vs1 + c * cj2 / vs2
    g, h = a - d * ci1 / vp1 * cj2 / vs2, a - d * ci2 / vp2 * cj1 / vs1
    det = e * f + g * h * p * p
    return ((b * ci1 / vp1 - c * ci2 / vp2) * f - (a + d * ci1 / vp1 * cj2 / vs2) * h * p * p) / det
