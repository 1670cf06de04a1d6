"""Exact rational algebra for small certified problems: a system per group, numbers as text a/b."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Matrix = list[list[Fraction]]


def reduced(rows: Matrix) -> tuple[Matrix, list[int]]:
    """The reduced row echelon form and its pivot columns."""
    m, pivots, at = [list(map(Fraction, r)) for r in rows], [], 0
    for col in range(len(m[0]) if m else 0):
        hit = next((r for r in range(at, len(m)) if m[r][col]), None)
        if hit is None:
            continue
        m[at], m[hit] = m[hit], m[at]
        lead = m[at][col]
        m[at] = [x / lead for x in m[at]]
        for r in range(len(m)):
            if r != at and m[r][col]:
                f = m[r][col]
                m[r] = [x - f * y for x, y in zip(m[r], m[at], strict=True)]
        pivots.append(col)
        at += 1
    return m, pivots


def rank(rows: Matrix) -> int:
    return len(reduced(rows)[1])


def null_space(rows: Matrix) -> Matrix:
    m, pivots = reduced(rows)
    width = len(rows[0]) if rows else 0
    out = []
    for free in (c for c in range(width) if c not in pivots):
        v = [Fraction(0)] * width
        v[free] = Fraction(1)
        for r, p in enumerate(pivots):
            v[p] = -m[r][free]
        out.append(v)
    return out


def solve(rows: Matrix, right: list[Fraction]) -> list[Fraction] | None:
    """One solution, free variables 0; None where there is none."""
    if not rows:
        return []
    m, pivots = reduced([[*r, b] for r, b in zip(rows, right, strict=True)])
    width = len(rows[0])
    if width in pivots:
        return None
    out = [Fraction(0)] * width
    for r, p in enumerate(pivots):
        out[p] = m[r][width]
    return out


def answerable(kept: Matrix, query: list[Fraction]) -> tuple[bool, list[Fraction] | None]:
    """Whether a linear query lies in the span of the kept rows; the weights if so, else a state that the kept rows cannot see and the query can."""
    if not kept:
        return not any(query), [] if not any(query) else [Fraction(bool(x)) for x in query]
    weights = solve([list(c) for c in zip(*kept, strict=True)], query)
    if weights is not None:
        return True, weights
    return False, next(v for v in null_space(kept) if sum(a * b for a, b in zip(v, query, strict=True)))


def port_resistance(links: list[tuple[str, str, Fraction]], a: str, b: str) -> Fraction | None:
    """Exact effective resistance between two nodes of a network of conductances; None where they are apart."""
    if a == b:
        return Fraction(0)
    near: dict[str, dict[str, Fraction]] = {}
    for u, v, w in links:
        if u != v and w > 0:
            near.setdefault(u, {})[v] = near.get(u, {}).get(v, Fraction(0)) + w
            near.setdefault(v, {})[u] = near.get(v, {}).get(u, Fraction(0)) + w
    seen, work = {a}, [a]
    while work:
        for v in near.get(work.pop(), {}):
            if v not in seen:
                seen.add(v)
                work.append(v)
    if b not in seen:
        return None
    ids = sorted(seen - {b})
    rows = [[sum(near[u].values()) if u == v else -near[u].get(v, Fraction(0)) for v in ids] for u in ids]
    return solve(rows, [Fraction(u == a) for u in ids])[ids.index(a)]


def verdict(low: Fraction, high: Fraction, threshold: Fraction) -> str:
    return "above" if low > threshold else "below" if high < threshold else "undecided"


def certified_ports(links: DataFrame, ports: DataFrame, key: str, at_most: int = 2_000) -> DataFrame:
    """(key, a, b, resistance text, verdict): exact port resistances of small networks, one per key: links (key, src, dst, w text), ports (key, a, b, threshold text). A network of more than at_most links gets the verdict `too_large`: exact solves are
    for small certificates; resistance.hole_field is for large graphs."""
    kind = dict(links.dtypes)[key]
    sized = links.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    small = links.join(sized.filter(F.col("_n") <= at_most).select(key), key, "left_semi")
    schema = f"{key} {kind}, a string, b string, resistance string, verdict string"

    def run(k: tuple, net: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        edges = [(u, v, Fraction(w)) for u, v, w in zip(net["src"], net["dst"], net["w"], strict=True)] if len(net) else []
        out = []
        for a, b, t in zip(asked["a"], asked["b"], asked["threshold"], strict=True) if len(asked) else []:
            r = port_resistance(edges, a, b)
            out.append((k[0], a, b, None if r is None else str(r), "apart" if r is None else verdict(r, r, Fraction(t))))
        return pd.DataFrame(out, columns=[key, "a", "b", "resistance", "verdict"])

    done = small.groupBy(key).cogroup(ports.join(sized.filter(F.col("_n") > at_most).select(key), key, "left_anti").groupBy(key)).applyInPandas(run, schema)
    large = ports.join(sized.filter(F.col("_n") > at_most).select(key), key, "left_semi").select(key, "a", "b", F.lit(None).cast("string").alias("resistance"), F.lit("too_large").alias("verdict"))
    return done.unionByName(large)
