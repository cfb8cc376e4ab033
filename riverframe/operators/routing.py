"""Recurrences over time: flood routing, reservoirs, snow and soil buckets, hydrographs.

A recurrence is sequential within a series, so the parallel unit is the series: rows are grouped by the
series' key and a small numpy function runs over each, ordered by step. A group holds one series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import river
from ..tables import cut, drop


def per_series(df: DataFrame, keys: Sequence[str], step: str, columns: str, f: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> DataFrame:
    """Rows (keys, step, columns): f maps a series' ordered rows to arrays of the same or another length."""
    names = [c.split()[0] for c in columns.split(",")]
    kinds = {k.name: k.dataType.simpleString() for k in df.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{step} bigint", columns])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(step, kind="stable")
        out = f(part)
        n = len(next(iter(out.values())))
        first = int(part[step].iloc[0])
        steps = part[step].to_numpy() if n == len(part) else np.arange(first, first + n)
        return pd.DataFrame({**{k: [part[k].iloc[0]] * n for k in keys}, step: steps, **out})[[*keys, step, *names]]

    return df.groupBy(*keys).applyInPandas(run, schema)


def muskingum_weights(k: float, x: float, dt: float) -> tuple[float, float, float]:
    d = k - k * x + 0.5 * dt
    return (0.5 * dt - k * x) / d, (0.5 * dt + k * x) / d, (k - k * x - 0.5 * dt) / d


def route(inflow: np.ndarray, k: float, x: float, dt: float, first: float | None = None) -> np.ndarray:
    c0, c1, c2 = muskingum_weights(k, x, dt)
    own = np.empty(len(inflow))
    own[:1] = inflow[:1] if first is None else first
    own[1:] = c0 * inflow[1:] + c1 * inflow[:-1]
    return decay(own, c2)


def decay(own: np.ndarray, keep: float) -> np.ndarray:
    """y[i] = own[i] + keep * y[i - 1], in log2(n) passes over the whole series: after k of them y[i] holds the last 2^k terms."""
    y, step = np.array(own, float), 1
    while step < len(y) and keep:
        y[step:] += keep * y[:-step].copy()
        keep, step = keep * keep, 2 * step
    return y


def muskingum(series: DataFrame, keys: Sequence[str], k: float, x: float, dt: float, step: str = "step", flow: str = "q") -> DataFrame:
    return per_series(series, keys, step, "inflow double, outflow double", lambda p: {"inflow": p[flow].to_numpy(float), "outflow": route(p[flow].to_numpy(float), k, x, dt)})


def cunge_parameters(flow: float, length: float, slope: float, n: float, width: float) -> tuple[float, float]:
    """(K, x) of a wide rectangular reach at a reference flow."""
    y = (flow * n / (width * np.sqrt(slope))) ** 0.6
    celerity = 5 / 3 * flow / (width * y)
    return length / celerity, 0.5 * (1 - flow / (width * slope * celerity * length))


def muskingum_cunge(series: DataFrame, keys: Sequence[str], length: float, slope: float, n: float, width: float, dt: float, step: str = "step", flow: str = "q") -> DataFrame:
    def f(p: pd.DataFrame) -> dict[str, np.ndarray]:
        q = p[flow].to_numpy(float)
        k, x = cunge_parameters(max(q.max(), 0) or 1.0, length, slope, n, width)
        return {"inflow": q, "outflow": route(q, k, x, dt)}

    return per_series(series, keys, step, "inflow double, outflow double", f)


def routing_metrics(routed: DataFrame, keys: Sequence[str], dt: float, step: str = "step") -> DataFrame:
    """Peaks, attenuation and lag; the first step of equal peaks counts."""
    peak = lambda c: F.min(F.struct((-F.col(c)).alias("q"), F.col(step).alias("s")))
    p = routed.groupBy(*keys).agg(peak("inflow").alias("i"), peak("outflow").alias("o"))
    i, o = -F.col("i.q"), -F.col("o.q")
    return p.select(*keys, i.alias("peak_in"), o.alias("peak_out"), F.when(i > 0, (i - o) / F.when(i > 0, i)).otherwise(0.0).alias("attenuation"), ((F.col("o.s") - F.col("i.s")) * dt / 3600).alias("lag_h"))


def linear_reservoir(series: DataFrame, keys: Sequence[str], hours: float, dt: float, step: str = "step", flow: str = "q") -> DataFrame:
    def f(p: pd.DataFrame) -> dict[str, np.ndarray]:
        q = p[flow].to_numpy(float)
        a = dt / (hours * 3600 + 0.5 * dt)
        return {"inflow": q, "outflow": decay(np.where(np.arange(len(q)) > 0, a * q, 0.0), 1 - a)}

    return per_series(series, keys, step, "inflow double, outflow double", f)


DEFAULT_BUCKET = {"area": 300.0, "t_snow": 0.0, "melt": 4.0, "s_max": 100.0, "k_perc": 0.06, "k_base": 0.03, "pet": 2.0, "s0": 40.0, "swe0": 0.0}


def bucket(rain: np.ndarray, temp: np.ndarray, area: float, t_snow: float, melt: float, s_max: float, k_perc: float, k_base: float, pet: float, s0: float, swe0: float) -> dict[str, np.ndarray]:
    """Degree-day snow, a soil bucket that spills, and a linear groundwater store; unrounded."""
    swe, soil, ground = swe0, s0, 0.0
    out = np.empty((len(rain), 3))
    for i, (p, t) in enumerate(zip(rain, temp)):
        melted = min(swe, melt * (t - t_snow)) if t > t_snow else 0.0
        swe += (p if t <= t_snow else 0.0) - melted
        soil += (p if t > t_snow else 0.0) + melted
        soil -= min(soil, pet * max(0.0, t) / 10)
        percolated = k_perc * soil
        soil -= percolated
        ground += percolated
        spilled = max(0.0, soil - s_max)
        soil -= spilled
        base = k_base * ground
        ground -= base
        out[i] = swe, melted, (spilled + base) * area / 86.4
    return {"swe": out[:, 0], "melt": out[:, 1], "q": out[:, 2]}


def simulate(forcing: DataFrame, keys: Sequence[str], step: str = "day", rounded: bool = True, **parameters: float) -> DataFrame:
    """Daily (swe, melt, q) per basin from columns p and temp; rounded as reports have them (0.1, 0.01, 0.01)."""
    use = DEFAULT_BUCKET | parameters
    out = per_series(forcing, keys, step, "swe double, melt double, q double", lambda x: bucket(x["p"].to_numpy(float), x["temp"].to_numpy(float), **use))
    return out.withColumns({"swe": F.round("swe", 1), "melt": F.round("melt", 2), "q": F.round("q", 2)}) if rounded else out


def score(observed: DataFrame, simulated: DataFrame, keys: Sequence[str], step: str = "step") -> DataFrame:
    """Nash-Sutcliffe efficiency and root mean square error over common steps (columns obs, sim)."""
    rows = observed.join(simulated, [*keys, step])
    mean = rows.groupBy(*keys).agg(F.avg("obs").alias("m"))
    e, v = F.sum(F.pow(F.col("obs") - F.col("sim"), F.lit(2.0))), F.sum(F.pow(F.col("obs") - F.col("m"), F.lit(2.0)))
    return rows.join(mean, list(keys)).groupBy(*keys).agg(F.when(v > 0, 1 - e / F.when(v > 0, v)).alias("nse"), F.sqrt(e / F.count(F.lit(1))).alias("rmse"))


BOUNDS = {"melt": (0.5, 12.0), "s_max": (10.0, 500.0), "k_perc": (0.001, 0.5), "k_base": (0.001, 0.5), "pet": (0.0, 10.0)}
#: Candidates a round, rounds, and what is left of the searched box after each.
CANDIDATES, ROUNDS, NARROWER = 96, 16, 0.75


def spread(n: int, bases: Sequence[int]) -> np.ndarray:
    """n points that fill the unit box evenly: digits of 1, 2, 3 ... mirrored at the point, in one base for each axis."""
    out = np.zeros((n, len(bases)))
    for axis, base in enumerate(bases):
        for i in range(n):
            k, scale = i + 1, 1.0 / base
            while k:
                out[i, axis] += scale * (k % base)
                k, scale = k // base, scale / base
    return out


def calibrate(forcing: DataFrame, keys: Sequence[str], observed: str = "obs", step: str = "day", bounds: dict[str, tuple[float, float]] = BOUNDS, candidates: int = CANDIDATES, rounds: int = ROUNDS, **fixed: float) -> DataFrame:
    """(keys, the names of bounds, nse0, nse, rounds): each basin's parameters of most Nash-Sutcliffe efficiency by a narrowing search, and the efficiency before.

    A round lays candidates evenly over boxes around each basin's best so far, within the bounds; every candidate of
    every basin is a row and is simulated where it lies. The best of each basin is the next boxes' middle, and boxes
    narrow from round to round. A basin's series is one row; ties go to the first candidate. A basin whose observed
    flow does not vary keeps its loss of squares unscaled, as its efficiency is not defined."""
    names, start = list(bounds), {**DEFAULT_BUCKET, **fixed}
    low, high = np.array([bounds[n][0] for n in names]), np.array([bounds[n][1] for n in names])
    places = spread(candidates * rounds, (2, 3, 5, 7, 11, 13, 17, 19)[: len(names)]) - 0.5
    day = F.struct(F.col(step).alias("step"), *[F.col(c).cast("double").alias(n) for n, c in (("p", "p"), ("temp", "temp"), ("obs", observed))])
    series = forcing.groupBy(*keys).agg(F.array_sort(F.collect_list(day)).alias("s"))
    series = cut(series.select(*keys, *[F.col(f"s.{c}").alias(f"__{c}") for c in ("p", "temp", "obs")]))
    kinds = dict(series.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "__i int", *(f"{n} double" for n in names), "loss double"])

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rain, temp, obs, values in zip(batch["__p"], batch["__temp"], batch["__obs"], batch[names].to_numpy()):
                q = np.round(bucket(rain, temp, **{**start, **dict(zip(names, values))})["q"], 2)
                out.append(float(np.sum((obs - q) ** 2)) / (float(np.sum((obs - obs.mean()) ** 2)) or 1.0))
            yield batch[[*keys, "__i", *names]].assign(loss=out)

    def tried(middles: DataFrame, offsets: np.ndarray) -> DataFrame:
        rows = series.join(middles, list(keys)).withColumn("__o", F.explode(F.lit(np.round(offsets, 12).tolist())))
        values = [F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.col(n) + F.col("__o")[i])).alias(n) for i, (n, lo, hi) in enumerate(zip(names, low, high))]
        found = rows.select(*keys, "__p", "__temp", "__obs", F.col("__o")[len(names)].cast("int").alias("__i"), *values).mapInPandas(losses, schema)
        return found.groupBy(*keys).agg(F.min(F.struct("loss", "__i", *names)).alias("b"))

    # The best so far comes first, with the number 0, so that no round ends worse than it began.
    none = np.zeros((1, len(names) + 1))
    start_at = series.select(*keys, *[F.lit(float(start[n])).alias(n) for n in names])
    state = cut(tried(start_at, none).select(*keys, *[F.col(f"b.{n}").alias(n) for n in names], "b.loss", F.col("b.loss").alias("loss0")))
    width = high - low
    for turn in range(rounds):
        # Half of them in the box, a quarter close to its middle, and a quarter all over.
        reach = np.resize([1.0, 1.0, 0.25, NARROWER**-turn], candidates)[:, None]
        around = np.column_stack((places[turn * candidates : (turn + 1) * candidates] * width * reach, np.arange(1, candidates + 1)))
        found = tried(state.select(*keys, *names), np.vstack((none, around))).join(state.select(*keys, "loss0"), list(keys))
        better = cut(found.select(*keys, *[F.col(f"b.{n}").alias(n) for n in names], "b.loss", "loss0"))
        drop(state)
        state, width = better, width * NARROWER
    clipped = [F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.col(n))).alias(n) for n, lo, hi in zip(names, low, high)]
    return state.select(*keys, *clipped, (1 - F.col("loss0")).alias("nse0"), (1 - F.col("loss")).alias("nse"), F.lit(rounds).cast("bigint").alias("rounds"))


def storage_route(inflow: np.ndarray, level: np.ndarray, volume: np.ndarray, crest: float, length: float, cd: float, dt: float, tail: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
    """Level-pool routing over a spillway: continuity by bisection on the level at each step."""
    n = int(np.ceil(len(inflow) * tail))
    inflow = np.concatenate((inflow, np.zeros(n - len(inflow))))
    spill = lambda z: cd * length * max(0.0, z - crest) ** 1.5

    def held(z: float) -> float:
        if z <= level[-1]:
            return float(np.interp(z, level, volume))
        slope = (volume[-1] - volume[-2]) / (level[-1] - level[-2])
        return float(volume[-1] + (z - level[-1]) * slope)

    z, out, levels = crest, np.zeros(n), np.full(n, crest)
    for i in range(1, n):
        known = held(z) + dt * (inflow[i - 1] + inflow[i]) / 2 - dt * spill(z) / 2
        lo, hi = float(level[0]), float(level[-1]) + 8
        for _ in range(50):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if held(mid) + dt * spill(mid) / 2 < known else (lo, mid)
        z = (lo + hi) / 2
        out[i], levels[i] = spill(z), z
    return out, levels


def reservoir(series: DataFrame, keys: Sequence[str], curve: Sequence[tuple[float, float]], crest: float, length: float, cd: float = 2.0, dt: float = 3600.0, step: str = "step", flow: str = "q") -> DataFrame:
    level, volume = (np.array([c[i] for c in curve], float) for i in (0, 1))

    def f(p: pd.DataFrame) -> dict[str, np.ndarray]:
        q = p[flow].to_numpy(float)
        out, z = storage_route(q, level, volume, crest, length, cd, dt)
        return {"inflow": np.concatenate((q, np.zeros(len(out) - len(q)))), "outflow": out, "level": z}

    return per_series(series, keys, step, "inflow double, outflow double, level double", f)


# --- relational hydrographs -----------------------------------------------------------------------------


def scs_increments(rain: DataFrame, keys: Sequence[str], cn: float | Column, step: str = "step", depth: str = "p") -> DataFrame:
    """Effective rain per block: runoff of the accumulated rain, differenced."""
    w = Window.partitionBy(*keys).orderBy(step)
    total = rain.withColumn("p_acc", F.sum(depth).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    acc = total.withColumn("pe_acc", river.scs_runoff(F.col("p_acc"), F.lit(cn) if not isinstance(cn, Column) else cn))
    return acc.withColumn("pe", F.greatest(F.lit(0.0), F.col("pe_acc") - F.coalesce(F.lag("pe_acc").over(w), F.lit(0.0))))


def convolve(rain: DataFrame, unit: DataFrame, keys: Sequence[str], step: str = "step", pe: str = "pe") -> DataFrame:
    """q(i) = sum of pe(j) u(i - j): the unit ordinates (k, u) are few and broadcast, sums are pre-aggregated."""
    return rain.join(F.broadcast(unit)).groupBy(*keys, (F.col(step) + F.col("k")).alias(step)).agg(F.sum(F.col(pe) * F.col("u")).alias("q"))


def alternating_blocks(blocks: DataFrame, keys: Sequence[str], n: str = "n", step: str = "i", depth: str = "mm", peak: float = 0.5) -> DataFrame:
    """Blocks in falling order go right, left, right ... of the peak, and what is left to where there is room.

    Position j is the (2 |j - p| - [j > p])-th nearest to the peak p; both sides are ranked and joined by rank."""
    w = Window.partitionBy(*keys)
    p = F.floor(F.lit(0.5) + F.lit(peak) * (F.col(n) - 1))
    rank = F.row_number().over(w.orderBy(F.col(depth).desc(), step))
    place = F.row_number().over(w.orderBy(2 * F.abs(F.col(step) - p) - (F.col(step) > p).cast("int")))
    falling = blocks.select(*keys, rank.alias("__r"), F.col(depth).alias(depth))
    return blocks.select(*keys, step, place.alias("__r")).join(falling, [*keys, "__r"]).drop("__r")


def network(nodes: DataFrame, flows: DataFrame, network_id: str = "network_id", dt: float = 3600.0) -> DataFrame:
    """Hydrographs through networks of subbasins, reaches, junctions and outlets.

    nodes (network_id, id, kind, downstream, k, x), flows (network_id, id, step, q) of subbasins. A network
    is one group; its size is that of a basin's schematic. Cycles and unknown downstream ids raise."""
    kind = {f.name: f.dataType.simpleString() for f in nodes.schema}[network_id]

    def run(key: tuple, n: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        steps = int(f["step"].max()) + 1 if len(f) else 0
        steps = max(10, int(np.ceil(1.6 * steps)))
        own = {i: np.zeros(steps) for i in n["id"]}
        for i, s, q in zip(f["id"], f["step"], f["q"]):
            own[i][int(s)] += q
        rows = n.set_index("id")
        waits = {i: 0 for i in rows.index}
        for d in rows["downstream"].dropna():
            waits[d] += 1
        ready, out, into = sorted(i for i, k in waits.items() if not k), {}, {i: np.zeros(steps) for i in rows.index}
        while ready:
            i = ready.pop(0)
            r = rows.loc[i]
            total = own[i] + into[i]
            out[i] = route(total, r["k"], r["x"], dt) if r["kind"] == "reach" else total
            d = r["downstream"]
            if isinstance(d, str):
                into[d] += out[i]
                waits[d] -= 1
                if not waits[d]:
                    ready.append(d)
        if len(out) < len(rows):
            raise ValueError(f"network {key[0]} has a cycle")
        return pd.DataFrame([(key[0], i, s, v) for i, q in out.items() for s, v in enumerate(q)], columns=[network_id, "id", "step", "q"])

    return nodes.groupBy(network_id).cogroup(flows.groupBy(network_id)).applyInPandas(run, f"{network_id} {kind}, id string, step bigint, q double")


def breach_hydrograph(dams: DataFrame, keys: Sequence[str], points: int = 200) -> DataFrame:
    """Linear rise and fall that hold the stored volume (columns volume, height, head, piping): (keys, t, q)."""
    b = river.breach(*[F.col(c) for c in ("volume", "height", "head", "piping")])
    rows = dams.select(*keys, "volume", b["peak_froehlich"].alias("peak"), b["formation_s"].alias("tf0"))
    fall = 2 * F.col("volume") / F.col("peak") - F.col("tf0")
    rows = rows.withColumn("tf", F.when(fall > 0, F.col("tf0")).otherwise(F.col("volume") / F.col("peak"))).withColumn("td", F.when(fall > 0, fall).otherwise(F.col("tf")))
    rows = rows.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: (F.col("tf") + F.col("td")) * i / points)))
    q = F.when(F.col("t") <= F.col("tf"), F.col("peak") * F.col("t") / F.col("tf")).otherwise(F.greatest(F.lit(0.0), F.col("peak") * (1 - (F.col("t") - F.col("tf")) / F.col("td"))))
    return rows.select(*keys, "t", q.alias("q"))


def time_area(n: int) -> np.ndarray:
    """Increments of the synthetic time-area curve over n bands."""
    tau = np.arange(1, n + 1) / n
    acc = np.minimum(1.0, np.where(tau <= 0.5, 1.414 * tau**1.5, 1 - 1.414 * (1 - tau) ** 1.5))
    return np.maximum(0.0, np.diff(acc, prepend=0.0))


def modclark(rain: DataFrame, keys: Sequence[str], tc_h: float, r_h: float, area: float, dt: float, bias: float = 0.0, step: str = "step", pe: str = "pe") -> DataFrame:
    """Effective rain over time-area bands, then a linear reservoir: (keys, step, inflow, outflow).

    bias tilts the bands from 1 + bias at the outlet to 1 - bias at the head; such a ramp has the mean 1 as it is.
    Flow is followed until six steps after the last band."""
    bands = max(2, int(np.floor(tc_h * 3600 / dt + 0.5)))
    tilt = np.linspace(1 + bias, 1 - bias, bands).clip(0)
    unit = time_area(bands) * tilt * area * 1e3 / dt
    share = dt / (r_h * 3600 + 0.5 * dt)

    def f(p: pd.DataFrame) -> dict[str, np.ndarray]:
        inflow = np.pad(np.convolve(p[pe].to_numpy(float), unit), (0, 6))
        held = share * inflow
        held[:1] = 0.0
        return {"inflow": inflow, "outflow": decay(held, 1 - share)}

    return per_series(rain, keys, step, "inflow double, outflow double", f)
