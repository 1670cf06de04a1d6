"""Units to base dimensions."""

from __future__ import annotations

import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = ("m", "kg", "s", "A", "K", "mol", "cd")
#: SI prefixes as powers of ten.
PREFIXES = {"Y": 24, "Z": 21, "E": 18, "P": 15, "T": 12, "G": 9, "M": 6, "k": 3, "h": 2, "da": 1, "d": -1, "c": -2, "m": -3, "u": -6, "µ": -6, "n": -9, "p": -12, "f": -15, "a": -18}
#: Named units as (factor, exponents of BASE).
NAMED = {
    "m": (1.0, {"m": 1}), "g": (1e-3, {"kg": 1}), "s": (1.0, {"s": 1}), "A": (1.0, {"A": 1}), "K": (1.0, {"K": 1}), "mol": (1.0, {"mol": 1}), "cd": (1.0, {"cd": 1}),
    "Hz": (1.0, {"s": -1}), "N": (1.0, {"kg": 1, "m": 1, "s": -2}), "Pa": (1.0, {"kg": 1, "m": -1, "s": -2}), "J": (1.0, {"kg": 1, "m": 2, "s": -2}), "W": (1.0, {"kg": 1, "m": 2, "s": -3}),
    "C": (1.0, {"A": 1, "s": 1}), "V": (1.0, {"kg": 1, "m": 2, "s": -3, "A": -1}), "F": (1.0, {"kg": -1, "m": -2, "s": 4, "A": 2}), "ohm": (1.0, {"kg": 1, "m": 2, "s": -3, "A": -2}), "Ω": (1.0, {"kg": 1, "m": 2, "s": -3, "A": -2}), "T": (1.0, {"kg": 1, "s": -2, "A": -1}),
    "min": (60.0, {"s": 1}), "h": (3600.0, {"s": 1}), "bar": (1e5, {"kg": 1, "m": -1, "s": -2}), "eV": (1.602176634e-19, {"kg": 1, "m": 2, "s": -2}), "L": (1e-3, {"m": 3}), "percent": (1e-2, {}), "%": (1e-2, {}), "ppm": (1e-6, {}), "rpm": (1 / 60, {"s": -1}), "rad": (1.0, {}),
}
_FACTOR = re.compile(r"([A-Za-zµΩ%]+)(?:\^?([-+]?\d+(?:/\d+)?))?$")


def parse_unit(text: str) -> tuple[float, tuple[Fraction, ...]] | None:
    """(factor to base units, exponents of BASE) of products and quotients such as `kN m^2 / s`; None where a part is unknown. After a slash every factor up to the next blank or dot divides."""
    factor, dims = 1.0, dict.fromkeys(BASE, Fraction(0))
    for k, side in enumerate(re.split(r"\s*/\s*", text.strip())):
        parts = [p for p in re.split(r"[\s*·.]+", side) if p and p != "1"]
        for j, part in enumerate(parts):
            m = _FACTOR.match(part)
            if not m:
                return None
            name, power = m[1], Fraction(m[2] or 1) * (-1 if k and j == 0 else 1)
            scale = 0
            if name not in NAMED:
                pre = next((p for p in sorted(PREFIXES, key=len, reverse=True) if name.startswith(p) and name[len(p) :] in NAMED), None)
                if pre is None:
                    return None
                scale, name = PREFIXES[pre], name[len(pre) :]
            f, d = NAMED[name]
            factor *= (f * 10.0**scale) ** float(power)
            for b, e in d.items():
                dims[b] += e * power
    return factor, tuple(dims[b] for b in BASE)


def _units(units: pd.Series) -> pd.DataFrame:
    known = {u: parse_unit(u) for u in units.dropna().unique()}
    rows = [known.get(u) if isinstance(u, str) else None for u in units]
    text = lambda d: " ".join(f"{b}^{e}" for b, e in zip(BASE, d, strict=True) if e) or "1"
    return pd.DataFrame({"factor": [r[0] if r else None for r in rows], "dimension": [text(r[1]) if r else None for r in rows]})


def unit(column: Column) -> Column:
    """struct(factor, dimension) of a unit's text, each distinct unit of a batch parsed once; null where it is unknown. Units of equal dimension can be compared after multiplying by their factors."""
    return F.pandas_udf(_units, "struct<factor:double,dimension:string>")(column)
