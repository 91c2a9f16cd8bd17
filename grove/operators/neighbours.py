"""Distance self-joins: rows go to the cells around pivots, and from there only where their balls reach."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grove.storage import stored

#: So many pivots at most (their vectors go to every task), and so many rings around each.
PIVOTS, RINGS = 512, 64
#: Rows of a unit where balls reach few of them; where they reach nearly all, about so many units, whatever the number of rows.
BLOCK, UNITS = 2000, 12
#: So many distances at a time.
AT_ONCE = 4_000_000


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x to all rows of y."""
    return np.sqrt(np.stack([((y - row) ** 2).sum(axis=1) for row in x])) if len(x) and len(y) else np.zeros((len(x), len(y)))


def rough(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same by one product of matrices; used to route only, with ``slack`` for its rounding."""
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * x @ y.T, 0))


def _roughly(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, float, float]]:
    """For some rows of x at a time: the first one's place, their squared distances to all rows of y less their own squares,
    these squares, the unit of length, and how far a value may be off. The products are of 32 bits, around y's mean."""
    mid = y.mean(axis=0)
    u, v = x - mid, y - mid
    scale = float(np.sqrt(max((u**2).sum(axis=1).max(), (v**2).sum(axis=1).max()))) or 1.0
    u, v = u / scale, v / scale
    right, off = np.c_[v, (v**2).sum(axis=1)].astype(np.float32).T.copy(), 8 * (x.shape[1] + 8) * 2.0**-24
    step = max(1, AT_ONCE // len(y))
    for a in range(0, len(x), step):
        some = u[a : a + step]
        yield a, np.c_[-2 * some, np.ones(len(some))].astype(np.float32) @ right, (some**2).sum(axis=1), scale, off


def within(x: np.ndarray, y: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``i, j, d``: rows of x and y that are at most ``reach[i]`` apart, for some rows of x at a time.

    What is surely farther is left out by a rough product, all others are measured as ``apart`` does.
    """
    for a, got, own, scale, off in _roughly(x, y):
        top = (reach[a : a + len(got)] / scale) ** 2 - own + off
        i, j = np.nonzero(got <= top[:, None].astype(np.float32))
        i, cut = i + a, range(0, len(i), 100_000)
        d = np.concatenate([np.zeros(0), *(np.sqrt(((y[j[c : c + 100_000]] - x[i[c : c + 100_000]]) ** 2).sum(axis=1)) for c in cut)])
        keep = d <= reach[i]
        yield i[keep], j[keep], d[keep]


class Cells:
    """Units of about ``block`` rows: a pivot's nearest rows, cut into rings of distances from it, large rings by hash.

    For a row x nearest to pivot p and a row y nearest to pivot q that are at most e apart, d(x, q) <= d(x, p) + 2e, and
    d(x, q) differs from d(y, q) by e at most. So x asks only the rings of q that both allow.
    """

    def __init__(self, rows: DataFrame, block: int, pivots: int = PIVOTS):
        mark = F.col("mark") if "mark" in rows.columns else F.lit(0)
        self.rows = rows.select("row_id", F.transform("features", lambda v: v.cast("double")).alias("x"), mark.cast("int").alias("mark"))
        self.n = n = rows.count()
        some = self.rows.orderBy(F.xxhash64("row_id"), "row_id").limit(max(1, min(pivots, -(-n // block)))).collect()
        self.pivots = np.unique(np.array([r["x"] for r in some], float), axis=0)
        self.slack = 1e-6 * (1 + float(np.abs(self.pivots).max(initial=0)))
        pivots = self.pivots

        def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    d = rough(np.stack(f["x"].to_numpy()), pivots)
                    cell = d.argmin(axis=1)
                    yield f.assign(cell=cell.astype(np.int32), d=d[np.arange(len(f)), cell])

        self.placed = stored(self.rows.mapInPandas(near, "row_id long, x array<double>, mark int, cell int, d double")) if n else None
        if not n:
            return
        spans = {r["cell"]: (r["lo"], r["hi"]) for r in self.placed.groupBy("cell").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).collect()}
        bounds = rows.sparkSession.createDataFrame([(c, lo, (hi - lo) / RINGS or 1.0) for c, (lo, hi) in spans.items()], "cell int, lo double, width double")
        ringed = self.placed.join(F.broadcast(bounds), "cell").withColumn("ring", F.least(F.floor((F.col("d") - F.col("lo")) / F.col("width")), F.lit(RINGS - 1)).cast("int"))
        rings = sorted(tuple(r) for r in ringed.groupBy("cell", "ring").agg(F.count("*"), F.min("d"), F.max("d")).collect())
        self.units, named = [], []  # (first unit, parts, cell, least and largest distance, rows)
        for cell, ring, count, lo, hi in rings:
            last = self.units[-1] if self.units else None
            if last and last[2] == cell and last[5] + count <= block:
                self.units[-1] = (*last[:4], hi, last[5] + count)
            else:
                first = last[0] + last[1] if last else 0
                self.units.append((first, -(-count // block), cell, lo, hi, count))
            named.append((cell, ring, *self.units[-1][:2]))
        names = rows.sparkSession.createDataFrame(named, "cell int, ring int, first int, parts int")
        unit = F.col("first") + F.pmod(F.xxhash64("row_id", F.lit(7)), F.col("parts")).cast("int")
        self.members = stored(ringed.join(F.broadcast(names), ["cell", "ring"]).select("row_id", "x", "mark", "cell", "d", unit.alias("unit")))

    def count(self) -> int:
        return self.units[-1][0] + self.units[-1][1]

    def _routed(self, rows: DataFrame, half: bool, out: Callable, kind: str) -> DataFrame:
        """What ``out`` makes of each unit (with ``half`` none before their own) and the rows (``x, d, unit, reach``) whose balls may reach it."""
        pivots, slack = self.pivots, self.slack
        units: dict[int, list[tuple]] = {}
        for first, parts, cell, lo, hi, _ in self.units:
            units.setdefault(cell, []).append((first, parts, lo, hi))

        def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for a in range(0, len(f), 2000):
                    g = f.iloc[a : a + 2000]
                    far, reach = rough(np.stack(g["x"].to_numpy()), pivots), g["reach"].to_numpy() + slack
                    own, home = g["d"].to_numpy(), g["unit"].to_numpy()
                    for cell, of in units.items():
                        d = far[:, cell]
                        some = np.flatnonzero(d <= own + 2 * reach)
                        for first, parts, lo, hi in of if len(some) else ():
                            hit = some[(d[some] >= lo - reach[some]) & (d[some] <= hi + reach[some])]
                            for part in range(first, first + parts if len(hit) else first):
                                asks = hit[home[hit] <= part] if half else hit
                                if len(asks):
                                    yield out(g, asks, part)

        return rows.mapInPandas(route, kind)

    def asked(self, rows: DataFrame, half: bool = False) -> DataFrame:
        """``row_id, x, mark, reach, unit, other``: each row (``row_id, x, mark, d, unit, reach``) for every unit that its ball may reach."""

        def out(g: pd.DataFrame, asks: np.ndarray, unit: int) -> pd.DataFrame:
            return g[["row_id", "x", "mark", "reach", "unit"]].iloc[asks].assign(other=np.int32(unit))

        return self._routed(rows, half, out, "row_id long, x array<double>, mark int, reach double, unit int, other int")

    def meetings(self, rows: DataFrame, half: bool = False) -> list[tuple[int, int, int]]:
        """Units that meet, and how many rows of the first one ask the other."""

        def out(g: pd.DataFrame, asks: np.ndarray, unit: int) -> pd.DataFrame:
            of, n = np.unique(g["unit"].to_numpy()[asks], return_counts=True)
            return pd.DataFrame({"unit": of, "other": np.int32(unit), "n": n})

        made = self._routed(rows, half, out, "unit int, other int, n long")
        return [tuple(r) for r in made.groupBy("unit", "other").agg(F.sum("n")).collect()]

    def bounded(self, k: int) -> DataFrame:
        """Members with ``reach``, not below the distance of the k-th nearest other row: what the own unit and the cells' extents say."""
        ends: dict[int, list[float]] = {}
        for *_, cell, _, hi, count in self.units:
            was = ends.get(cell, [0.0, 0])
            ends[cell] = [max(was[0], hi), was[1] + count]
        cells, pivots, slack = list(ends), self.pivots, self.slack
        radius, size = (np.array([ends[c][i] for c in cells]) for i in (0, 1))

        def bound(f: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(f["x"].to_numpy())
            most = rough(x, pivots[cells]) + radius + slack  # every row of a cell is nearer
            order = np.argsort(most, axis=1)
            enough = np.cumsum(size[order], axis=1) > k
            reach = np.where(enough.any(axis=1), np.take_along_axis(most, order, axis=1)[np.arange(len(x)), enough.argmax(axis=1)], np.inf)
            for a, got, own, scale, off in _roughly(x, x) if len(x) > k else ():
                kth = np.partition(got, k, axis=1)[:, k].astype(float)  # itself is among them
                part = slice(a, a + len(got))
                reach[part] = np.minimum(reach[part], scale * np.sqrt(np.maximum(kth + own + off, 0)))
            return f[["row_id", "x", "mark", "d", "unit"]].assign(reach=reach)

        return self.members.groupBy("unit").applyInPandas(bound, "row_id long, x array<double>, mark int, d double, unit int, reach double")


def _placed(rows: DataFrame, eps: float | None, k: int | None, block: int | None, half: bool = False) -> tuple[Cells, DataFrame | None, list[tuple[int, int, int]]]:
    """Cells, their members with what each may reach, and the units that meet.

    Small units spare comparisons where balls reach few of them. Where a row would go to more than UNITS units, the rows
    are cut into about so many instead: then copies grow with the rows and not with their square, only comparisons do.
    """
    cells = Cells(rows, block or BLOCK)
    while cells.placed is not None:
        asks = cells.members.withColumn("reach", F.lit(float(eps))) if eps is not None else stored(cells.bounded(k))
        met = cells.meetings(asks, half)
        if block or cells.count() <= 2 * UNITS or sum(n for *_, n in met) <= UNITS * cells.n:
            return cells, asks, met
        block = -(-cells.n // UNITS)
        cells = Cells(rows, block, pivots=1)
    return cells, None, []


def share_of_pairs(rows: DataFrame, eps: float | None = None, k: int | None = None, block: int = 2000) -> float:
    """Which part of all pairs of rows a join compares."""
    cells, _, met = _placed(rows, eps, k, block)
    sizes = {r["unit"]: r["count"] for r in cells.members.groupBy("unit").count().collect()}
    return sum(n * sizes.get(other, 0) for _, other, n in met) / cells.n**2


def _paired(rows: DataFrame, pair: Callable[..., pd.DataFrame], schema: str, eps: float | None, k: int | None, block: int | None, half: bool) -> DataFrame:
    """``pair`` of the rows of one unit that ask another one and that one's rows; with ``half`` once for both ways round."""
    cells, asks, met = _placed(rows, eps, k, block, half)
    if cells.placed is None:
        return rows.sparkSession.createDataFrame([], schema)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        x, y = (np.stack(f["x"].to_numpy()) for f in (a, b))
        return pair(a.drop(columns="x"), b.drop(columns="x"), x, y, bool(a["unit"].iloc[0] == a["other"].iloc[0]))

    to = rows.sparkSession.createDataFrame([(a, b) for a, b, _ in met], "`from` int, `to` int")
    members = cells.members.select("row_id", "x", "mark", F.col("unit").alias("to")).join(F.broadcast(to), "to")
    return cells.asked(asks, half).groupBy("unit", "other").cogroup(members.groupBy("from", "to")).applyInPandas(run, schema)


def distances(rows: DataFrame, eps: float | None = None, k: int | None = None, block: int | None = None) -> DataFrame:
    """``a, b, d`` between rows at most ``eps`` apart (a row with itself too), or between each row and its ``k`` nearest others.

    Of equal distances the smaller ids are nearer. The result is exact: rows are sent by the triangle inequality, for the
    nearest ones within a bound on the k-th distance found first. Units meet in pairs, so a task holds two at a time,
    and only what is asked for leaves it. Where nothing can be left out (many columns, no clusters) all units meet.
    """

    def close(a, b, x, y, same):
        p, q = a["row_id"].to_numpy(), b["row_id"].to_numpy()
        i, j, d = (np.concatenate(v) for v in zip(*within(x, y, a["reach"].to_numpy()), strict=True))
        both = (np.r_[p[i], q[j]], np.r_[q[j], p[i]], np.r_[d, d]) if not same else (p[i], q[j], d)
        return pd.DataFrame(dict(zip("abd", both, strict=True)))

    def nearest(a, b, x, y, same):
        p, q, out = a["row_id"].to_numpy(), b["row_id"].to_numpy(), []
        for i, j, d in within(x, y, a["reach"].to_numpy()):
            other = p[i] != q[j]
            i, j, d = i[other], j[other], d[other]
            order = np.lexsort((q[j], d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.r_[0, np.flatnonzero(np.diff(i)) + 1] if len(i) else np.zeros(0, int)
            keep = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k
            out.append(pd.DataFrame({"a": p[i[keep]], "b": q[j[keep]], "d": d[keep]}))
        return pd.concat(out)

    out = _paired(rows, close if k is None else nearest, "a long, b long, d double", eps, k, block, k is None)
    return out if k is None else out.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("rank") <= k)


def counted(rows: DataFrame, eps: float, block: int | None = None) -> DataFrame:
    """``row_id, near``: how many rows are at most ``eps`` away, itself included. Tasks count, pairs don't leave them."""

    def count(a, b, x, y, same):
        p, q, n, m = a["row_id"].to_numpy(), b["row_id"].to_numpy(), np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        for i, j, _ in within(x, y, a["reach"].to_numpy()):
            n += np.bincount(i, minlength=len(n))
            m += np.bincount(j, minlength=len(m))
        return pd.DataFrame({"row_id": p, "near": n} if same else {"row_id": np.r_[p, q], "near": np.r_[n, m]})

    return _paired(rows, count, "row_id long, near long", eps, None, block, True).groupBy("row_id").agg(F.sum("near").alias("near"))


def linked(rows: DataFrame, eps: float, block: int | None = None) -> DataFrame:
    """``a, b, core``: what joins rows at most ``eps`` apart, of which those with ``mark`` 1 are core rows.

    Between core rows a task gives each one's link to the smallest that it hangs together with there, which joins the
    same rows as all pairs do; other rows have all their links to core rows.
    """

    def join(a, b, x, y, same):
        ids, at = np.unique(np.r_[a["row_id"].to_numpy(), b["row_id"].to_numpy()], return_inverse=True)
        left, right, out = at[: len(a)], at[len(a) :], []
        core, root = np.zeros(len(ids), bool), np.arange(len(ids))
        core[left], core[right] = a["mark"].to_numpy() == 1, b["mark"].to_numpy() == 1
        for i, j, _ in within(x, y, a["reach"].to_numpy()):
            p, q = left[i], right[j]
            for s, t in ((p, q), (q, p)):
                edge = ~core[s] & core[t]
                out.append(np.c_[ids[s[edge]], ids[t[edge]]])
            p, q = p[core[p] & core[q]], q[core[p] & core[q]]
            while len(apart := np.flatnonzero(root[p] != root[q])):
                p, q = p[apart], q[apart]
                np.minimum.at(root, np.maximum(root[p], root[q]), np.minimum(root[p], root[q]))
                while (up := root[root] != root).any():
                    root[up] = root[root[up]]
        loose, hung = np.concatenate([np.zeros((0, 2), ids.dtype), *out]), np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"a": np.r_[loose[:, 0], ids[hung]], "b": np.r_[loose[:, 1], ids[root[hung]]], "core": np.r_[np.zeros(len(loose), bool), np.ones(len(hung), bool)]})

    return _paired(rows, join, "a long, b long, core boolean", eps, None, block, True)
