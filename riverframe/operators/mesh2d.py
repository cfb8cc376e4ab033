"""Shallow water on triangles: a finite-volume kernel per scenario.

Mesh tables are broadcastable only in so far as one scenario's mesh is one group: (scenario, tri, x1..y3, z)
with initial depth h; each scenario runs in one task, scenarios run side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.river import G
from .hydraulics import hll


def edges_of(xy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right or -1, normals out of the left cell, lengths) of triangles (n, 3, 2); corners are matched by position."""
    n = len(xy)
    a, b = xy.reshape(-1, 2), np.roll(xy, -1, axis=1).reshape(-1, 2)
    owner = np.repeat(np.arange(n), 3)
    corners, number = np.unique(np.round(np.concatenate((a, b)), 6), axis=0, return_inverse=True)
    number = number.ravel()
    pair = np.sort(np.column_stack((number[: 3 * n], number[3 * n :])), axis=1)
    _, first, inverse = np.unique(pair, axis=0, return_index=True, return_inverse=True)
    inverse = inverse.ravel()
    right = np.full(len(first), -1)
    others = np.setdiff1d(np.arange(3 * n), first)
    right[inverse[others]] = owner[others]
    left = owner[first]
    d = b[first] - a[first]
    length = np.hypot(d[:, 0], d[:, 1])
    normal = np.column_stack((d[:, 1], -d[:, 0])) / length[:, None]
    centre = xy.mean(axis=1)
    out = np.einsum("ij,ij->i", normal, (a[first] + b[first]) / 2 - centre[left]) < 0
    normal[out] *= -1
    return left, right, normal, length


def run(xy: np.ndarray, z: np.ndarray, h: np.ndarray, seconds: float, n: float = 0.03, cfl: float = 0.4, frames: int = 5):
    """Yields (t, h, qx, qy). Walls all round; hydrostatic reconstruction keeps still water still; friction is implicit."""
    left, right, normal, length = edges_of(xy)
    area = np.abs((xy[:, 1, 0] - xy[:, 0, 0]) * (xy[:, 2, 1] - xy[:, 0, 1]) - (xy[:, 1, 1] - xy[:, 0, 1]) * (xy[:, 2, 0] - xy[:, 0, 0])) / 2
    size = np.full(len(area), np.inf)
    for side in (left, right):
        ok = side >= 0
        np.minimum.at(size, side[ok], 2 * area[side[ok]] / length[ok])
    h, q = h.astype(float).copy(), np.zeros((len(h), 2))
    inner = right >= 0
    other = np.where(inner, right, left)
    t, upcoming = 0.0, 0.0
    while True:
        if t >= upcoming - 1e-9:
            yield t, h.copy(), q[:, 0].copy(), q[:, 1].copy()
            upcoming += seconds / frames
        if t >= seconds - 1e-9:
            return
        u = np.where(h[:, None] > 1e-6, q / np.maximum(h, 1e-6)[:, None], 0.0)
        speed = np.hypot(u[:, 0], u[:, 1]) + np.sqrt(G * h)
        dt = min(cfl * float((size / np.maximum(speed, 1e-9)).min()), upcoming - t, seconds - t)
        ul, ur = np.einsum("ij,ij->i", u[left], normal), np.einsum("ij,ij->i", u[other], normal)
        tl, tr = u[left, 1] * normal[:, 0] - u[left, 0] * normal[:, 1], u[other, 1] * normal[:, 0] - u[other, 0] * normal[:, 1]
        ur = np.where(inner, ur, -ul)
        top = np.maximum(z[left], z[other])
        hl, hr = np.maximum(0, h[left] + z[left] - top), np.maximum(0, h[other] + z[other] - top)
        f = hll(hl, ul, hr, ur)
        across = np.where(f[0] >= 0, tl, tr) * f[0]
        change, push = np.zeros(len(h)), np.zeros((len(h), 2))
        for side, sign, hs, mask in ((left, 1.0, hl, np.ones(len(left), bool)), (other, -1.0, hr, inner)):
            into = f[1] + G / 2 * (h[side] ** 2 - hs**2)
            flow = np.column_stack((into * normal[:, 0] - across * normal[:, 1], into * normal[:, 1] + across * normal[:, 0]))
            np.add.at(change, side[mask], sign * (f[0] * length)[mask])
            np.add.at(push, side[mask], sign * (flow * length[:, None])[mask])
        h = np.maximum(0.0, h - dt * change / area)
        q = q - dt * push / area[:, None]
        drag = 1 + dt * G * n * n * np.hypot(q[:, 0], q[:, 1]) / np.maximum(h, 1e-6) ** (7 / 3)
        q = np.where((h > 1e-6)[:, None], q / drag[:, None], 0.0)
        t += dt


def simulate(mesh: DataFrame, scenario: str, seconds: float, n: float = 0.03, frames: int = 5) -> DataFrame:
    """Frames (scenario, t, tri, h, v) of each scenario's mesh."""
    kinds = {f.name: f.dataType.simpleString() for f in mesh.schema}

    def go(part: pd.DataFrame) -> pd.DataFrame:
        xy = part[["x1", "y1", "x2", "y2", "x3", "y3"]].to_numpy(float).reshape(-1, 3, 2)
        out = []
        for t, h, qx, qy in run(xy, part["z"].to_numpy(float), part["h"].to_numpy(float), seconds, n, frames=frames):
            v = np.where(h > 1e-6, np.hypot(qx, qy) / np.maximum(h, 1e-6), 0.0)
            out.append(pd.DataFrame({scenario: part[scenario].iloc[0], "t": round(t, 6), "tri": part["tri"].to_numpy(), "h": h, "v": v}))
        return pd.concat(out)

    return mesh.groupBy(scenario).applyInPandas(go, f"{scenario} {kinds[scenario]}, t double, tri {kinds['tri']}, h double, v double")
