"""K-means with many starts and several k at once: every start's centres meet a block of rows in one matrix product.

All starts of all k share the passes over the data: seeding by k-means|| (Bahmani et al., 2012), then rounds that move every
start's centres together until each stands still. Tasks return sums per centre; only centres and candidates, whose number
the parameters bound, reach the driver. Draws are hashes of the vectors, so results don't depend on the cluster."""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import discard, stored

#: Rows of one matrix product, rounds of oversampling, and candidates a round and start as a multiple of the largest k.
BLOCK, SEEDING, OVERSAMPLING = 4096, 2, 2


def _uniform(h: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in [0, 1) of 64-bit hashes and a salt (splitmix64)."""
    x = h.astype(np.uint64)
    for s in salt:
        x = x + np.uint64(0x9E3779B97F4A7C15 * (int(s) + 1) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) / 2**53


def _squares(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((v * v).sum(1)[:, None] - 2 * v @ centres.T + (centres * centres).sum(1), 0)


def _blocks(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            part = batch.slice(i, BLOCK)
            yield part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), part.column("h").to_numpy()


def _pass(data: DataFrame, fn: Callable[[Iterator], list[tuple]]) -> DataFrame:
    """(i, j, x) of a function of a task's blocks."""

    def task(batches):
        rows = fn(_blocks(batches))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.list_(pa.float64())), strict=True)], ["i", "j", "x"])

    return data.mapInArrow(task, "i int, j int, x array<double>")


def _summed(found: DataFrame, size: int) -> dict[int, np.ndarray]:
    """Sums by i of arrays of a size."""
    each = found.select("i", F.posexplode("x").alias("p", "x")).groupBy("i", "p").agg(F.sum("x").alias("x")).collect()
    out: dict[int, np.ndarray] = {}
    for i, p, x in each:
        out.setdefault(i, np.zeros(size))[p] = x
    return out


def _first(data: DataFrame, n_init: int, seed: int) -> list[np.ndarray]:
    """A row drawn for each start: that of the smallest draw."""

    def fn(blocks):
        best: dict = {}
        for v, h in blocks:
            for s in range(n_init):
                u = _uniform(h, seed, s)
                k = int(u.argmin())
                if s not in best or u[k] < best[s][0]:
                    best[s] = (u[k], v[k])
        return [(s, 0, [u, *v]) for s, (u, v) in best.items()]

    rows = _pass(data, fn).groupBy("i").agg(F.min("x").alias("x")).collect()
    return [np.array([r["x"][1:]]) for r in sorted(rows, key=lambda r: r["i"])]


def _seeds(data: DataFrame, ks: Sequence[int], n_init: int, seed: int) -> list[np.ndarray]:
    """Centres of every k and start: k-means|| candidates of the start, weighted by their rows, thinned by k-means++."""
    found = _first(data, n_init, seed)
    starts = lambda: np.concatenate(([0], np.cumsum([len(c) for c in found])))[:-1]
    for turn in range(SEEDING):
        everything, at = np.concatenate(found), starts()

        def costs(blocks, everything=everything, at=at):
            total = np.zeros(len(at))
            for v, _ in blocks:
                total += np.minimum.reduceat(_squares(v, everything), at, 1).sum(0)
            return [(0, 0, total.tolist())]

        cost = _summed(_pass(data, costs), n_init)[0]

        def draws(blocks, everything=everything, at=at, cost=cost, turn=turn):
            out = []
            for v, h in blocks:
                near = np.minimum.reduceat(_squares(v, everything), at, 1)
                for s in np.flatnonzero(cost > 0):
                    out += [(int(s), 0, x.tolist()) for x in v[_uniform(h, seed, s, turn + 1) < OVERSAMPLING * max(ks) * near[:, s] / cost[s]]]
            return out

        for r in _pass(data, draws).distinct().orderBy("i", "x").collect():
            found[r["i"]] = np.vstack([found[r["i"]], [r["x"]]])
    everything, at = np.concatenate(found), starts()

    def weights(blocks):
        n = np.zeros(len(everything))
        for v, _ in blocks:
            d = _squares(v, everything)
            for a, b in zip(at, [*at[1:], len(everything)], strict=True):
                n[a:b] += np.bincount(d[:, a:b].argmin(1), minlength=b - a)
        return [(0, 0, n.tolist())]

    weight = _summed(_pass(data, weights), len(everything))[0]
    return [_thinned(found[s], weight[a : a + len(found[s])], k, np.random.default_rng([seed, s, k])) for k in ks for s, a in enumerate(at)]


def _thinned(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k weighted draws, each by its squared distance from those before; fewer where there are fewer distinct points."""
    near, picked = np.ones(len(points)), []
    for _ in range(k):
        p = weight * near
        if not p.sum():
            break
        picked.append(int(rng.choice(len(points), p=p / p.sum())))
        near = _squares(points, points[picked]).min(1)
        near[picked] = 0
    return points[picked]


def _moved(data: DataFrame, centres: list[np.ndarray], rounds: int, limit: float) -> np.ndarray:
    """Moves each set of centres to its members' means until none shifts by more than `limit` (squared); their costs."""
    width = centres[0].shape[1]
    live, cost = list(range(len(centres))), np.full(len(centres), np.inf)
    for turn in range(rounds + 1):
        used = np.concatenate([centres[i] for i in live])
        at = np.cumsum([0, *(len(centres[i]) for i in live)])

        def move(blocks, used=used, at=at):
            sums, n, total = np.zeros_like(used), np.zeros(len(used)), np.zeros(len(used))
            for v, _ in blocks:
                d = _squares(v, used)
                for a, b in zip(at[:-1], at[1:], strict=True):
                    own = d[:, a:b].argmin(1)
                    member = own[:, None] == np.arange(b - a)
                    sums[a:b] += member.T @ v
                    n[a:b] += member.sum(0)
                    total[a:b] += np.where(member, d[:, a:b], 0).sum(0)
            return [(c, 0, [*s.tolist(), n[c], total[c]]) for c, s in enumerate(sums) if n[c]]

        found = _summed(_pass(data, move), width + 2)
        still = []
        for i, a, b in zip(live, at[:-1], at[1:], strict=True):
            new = np.array([found[c][:-2] / found[c][-2] if c in found else used[c] for c in range(a, b)])
            cost[i] = sum(found[c][-1] for c in range(a, b) if c in found)
            if turn < rounds and ((new - centres[i]) ** 2).sum(1).max() > limit:
                centres[i] = new
                still.append(i)
        live = still
        if not live:
            break
    return cost


def fit(rows: DataFrame, ks: Sequence[int], n_init: int = 50, seed: int = 0, rounds: int = 100, tol: float = 1e-4) -> dict[int, tuple[np.ndarray, float]]:
    """{k: (centres, cost)} of the start with the least cost; rows have `features`. Without rows, no centres and cost 0.

    All starts move until their centres shift by less than a thousandth of the rows' spread (squared); the best of each k then
    goes on until it shifts by less than `tol`."""
    vector = vector_to_array("features")
    data = stored(rows.select(vector.alias("v"), F.xxhash64(vector).alias("h")), "vectors")
    if data.isEmpty():
        return {k: (np.zeros((0, 0)), 0.0) for k in ks}
    centres = _seeds(data, ks, n_init, seed)
    each = data.select(F.posexplode("v").alias("p", "x")).groupBy("p").agg(F.var_pop("x").alias("s")).agg(F.sum("s")).first()[0]
    cost = _moved(data, centres, rounds, max(1e-3 * each, tol * tol))
    best = [min(range(j * n_init, (j + 1) * n_init), key=lambda i: cost[i]) for j in range(len(ks))]
    chosen = [centres[i] for i in best]
    final = _moved(data, chosen, rounds, tol * tol)
    discard(data)
    return {k: (c, float(x)) for k, c, x in zip(ks, chosen, final, strict=True)}


def labelled(rows: DataFrame, centres: np.ndarray, out: str = "cluster") -> DataFrame:
    """rows with the number of the nearest centre, the first on ties."""

    def nearest(v: pa.Array) -> pa.Array:
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        return pa.array(np.concatenate([_squares(x[i : i + BLOCK], centres).argmin(1) for i in range(0, max(len(x), 1), BLOCK)]) if len(x) else [], pa.int32())

    return rows.withColumn(out, F.arrow_udf(nearest, "int")(vector_to_array("features")))
