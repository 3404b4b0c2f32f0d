"""The k most similar vectors of every vector: an inverted file with product-quantised residuals and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revsift.common import cut, dataset, partitions, qualified, shared_dir, small

#: Vectors in a region of the index, about. Each region has lists of its own, so their number grows with the vectors, and
#: each is fitted in one task. A vector is looked for in so many regions at least.
REGION_ROWS, REGIONS = 100_000, 8
#: Vectors that the regions of one length are fitted on at most; vectors that the lists of a region are fitted on, as a
#: share of its vectors, at least and at most.
SAMPLE, LIST_SHARE, LIST_LEAST, LIST_MOST = 20_000, 0.2, 2_000, 40_000
#: Vectors in a list of the inverted file, about.
LIST_ROWS = 100
#: Lists looked into for a vector; sub-quantisers and their codes: a vector's table has as many entries as both multiplied.
PROBES, PARTS, CODES = 48, 16, 256
#: The lists that a vector's k best are first looked for in, to know from which estimate on others can surpass them.
FIRST = 6
#: Vectors that a task searches for at once; pairs found beyond which those that others surpass are dropped.
HELD_ROWS, HELD_PAIRS = 40_000, 1_000_000
#: Deviations of the estimates' error by which an estimate may fall short for its pair to be computed exactly.
DEVIATIONS = 4


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(b @ c.T - 0.5 * (c * c).sum(axis=1), axis=1) for b in np.array_split(x, max(1, len(x) * k // 4_000_000))])
        order = np.argsort(near, kind="stable")
        n = np.bincount(near, minlength=k)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        full = np.flatnonzero(n)
        c[full] = np.add.reduceat(x[order], starts[full], axis=0) / n[full, None]
    return c


def fit(sample: np.ndarray, lists: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(unit centroids, codebooks parts x codes x width, deviation of estimates) of unit vectors.

    The deviation is that of x.e less its expected part (x.y)(y.e) over pairs of the sample, e being what the codes miss of y.
    """
    c = _kmeans(sample, lists, 8, seed)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    near = np.argmax(sample @ c.T, axis=1)
    rest = sample - c[near]
    parts = next(p for p in (PARTS, PARTS // 2, PARTS // 4, 1) if sample.shape[1] % p == 0)
    books = [_kmeans(np.ascontiguousarray(p), CODES, 6, seed + i) for i, p in enumerate(np.split(rest, parts, axis=1))]
    codes = max(map(len, books))
    books = np.stack([np.vstack([b, np.repeat(b[-1:], codes - len(b), axis=0)]) for b in books])
    some = sample[:: max(1, len(sample) // 1000)]
    at = c[_near(some, c, 1)[:, 0]]
    missed = some - at - _rest(_encode(some - at, books), books)
    error = some @ missed.T - (some @ some.T) * np.einsum("ij,ij->i", some, missed)
    return c, books, float(error.std()) if len(some) > 1 else 0.0


def _rest(code: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The residuals that codes stand for."""
    return books[np.arange(len(books)), code.astype(np.intp)].reshape(len(code), -1)


def _near(x: np.ndarray, c: np.ndarray, ways: int) -> np.ndarray:
    """The nearest lists of each vector, in order."""
    ways = min(ways, len(c))
    score = x @ c.T
    near = np.argpartition(-score, ways - 1, axis=1)[:, :ways]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, 1), axis=1, kind="stable"), 1)


def _encode(rest: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The code of each residual."""
    return np.stack([np.argmax(p @ b.T - 0.5 * (b * b).sum(axis=1), axis=1) for p, b in zip(np.split(rest, len(books), axis=1), books)], axis=1).astype(np.uint8)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    y /= np.maximum(np.abs(y).max(axis=1, keepdims=True), 1e-300)
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, v) to (id, width, v as bytes, way): the way is a digest of the direction rounded to 5 decimals, so that copies
    of any length share it. A batch's repeated rows are dropped."""
    for b in batches:
        ids, v = b.column("id").to_numpy(zero_copy_only=False), b.column("v")
        n = pc.list_value_length(v).to_numpy(zero_copy_only=False)
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        ends = np.cumsum(n)
        for w in np.unique(n):
            rows = np.flatnonzero(n == w)
            x = flat[(ends[rows] - w)[:, None] + np.arange(w)]
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x, rows = x[good], rows[good]
            if not len(rows):
                continue
            rounded = np.round(_unit(x) * 1e5).astype(np.int32)
            way = [blake2b(r.tobytes(), digest_size=16).digest() for r in rounded]
            seen = list({(i, y): j for j, (i, y) in reversed(list(enumerate(zip(ids[rows].tolist(), way))))}.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[rows][seen]), pa.array(np.full(len(seen), w, np.int32)), pa.array([x[j].tobytes() for j in seen], pa.binary()), pa.array([way[j] for j in seen], pa.binary())], names=["id", "width", "v", "way"]
            )


def _placed(centers: dict[int, np.ndarray]):
    """Adds the region of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths, region = b.column("width").to_numpy(), np.zeros(b.num_rows, np.int32)
            for w in np.unique(widths).tolist():
                if w in centers:
                    m = widths == w
                    region[m] = np.argmax(_unit(_matrix(b.column("v").filter(pa.array(m)), w)).astype(np.float32) @ centers[w].T, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region)], names=[*b.schema.names, "region"])

    return run


_MODEL = "width int, region int, lists int, centroids binary, books binary, parts int, deviation double"


def _fitted(p: pd.DataFrame) -> pd.DataFrame:
    w = int(p["width"].iloc[0])
    x = _unit(np.frombuffer(b"".join(p["v"]), np.float32).reshape(-1, w)).astype(np.float32)
    c, books, deviation = fit(x[np.lexsort(x.T[::-1])], max(1, int(p["lists"].iloc[0])))
    return pd.DataFrame([(w, p["region"].iloc[0], len(c), c.tobytes(), books.astype(np.float32).tobytes(), len(books), deviation)], columns=["width", "region", "lists", "centroids", "books", "parts", "deviation"])


class _Models:
    """Centroids and codebooks of regions, read where they are needed; some are remembered."""

    def __init__(self, uri: str) -> None:
        self.data, self.known = dataset(uri), {}

    def get(self, width: int, region: int) -> tuple[np.ndarray, np.ndarray, float]:
        if (width, region) not in self.known:
            if len(self.known) >= 64:
                self.known.clear()
            r = self.data.to_table(filter=(pc.field("width") == width) & (pc.field("region") == region), use_threads=False).to_pylist()[0]
            c, books = (np.frombuffer(r[k], np.float32) for k in ("centroids", "books"))
            self.known[width, region] = c.reshape(-1, width), books.reshape(r["parts"], -1, width // r["parts"]), r["deviation"]
        return self.known[width, region]


def _listed(uri: str, centers: dict[int, np.ndarray], ways: int):
    """Each vector in its lists: adds their key and whether the list is the nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _Models(uri)
        for b in _placed(centers)(batches):
            widths, regions = b.column("width").to_numpy(), b.column("region").to_numpy()
            for w, r in sorted(set(zip(widths.tolist(), regions.tolist()))):
                t = b.filter(pa.array((widths == w) & (regions == r))).select(["width", "way", "ids", "v"])
                near = _near(_unit(_matrix(t.column("v"), w)).astype(np.float32), models.get(w, r)[0], ways)
                for i in range(near.shape[1]):
                    key = (np.int64(r) << 32) + near[:, i].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([*t.columns, pa.array(key), pa.array(np.full(len(key), i == 0))], names=[*t.schema.names, "key", "nearest"])

    return run


def _coded(uri: str):
    """Adds the code of the residual to the list, and what the code misses along the vector. Rows keep their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _Models(uri)
        for b in batches:
            widths, key = b.column("width").to_numpy(), b.column("key").to_numpy()
            region = key >> 32
            cuts = np.flatnonzero((widths[1:] != widths[:-1]) | (region[1:] != region[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if hi > lo:
                    t, w = b.slice(lo, hi - lo), int(widths[lo])
                    c, books, _ = models.get(w, int(region[lo]))
                    x, at = _unit(_matrix(t.column("v"), w)).astype(np.float32), key[lo:hi] & 0xFFFFFFFF
                    code = _encode(x - c[at], books)
                    missed = np.einsum("ij,ij->i", x, x - c[at] - _rest(code, books))
                    yield pa.RecordBatch.from_arrays([*t.columns, pa.array([y.tobytes() for y in code], pa.binary()), pa.array(missed.astype(np.float32))], names=[*t.schema.names, "code", "missed"])

    return run


def _padded(column: pa.Array, k: int) -> np.ndarray:
    ids = np.full((len(column), k + 1), -1, np.int64)
    n = pc.list_value_length(column).to_numpy()
    rows = np.repeat(np.arange(len(n)), n)
    ids[rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)] = column.flatten().to_numpy()
    return ids


def _best(i: np.ndarray, ids: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that may still be among a row's k best, each once: its own vector, k others, and all as near as the last of them."""
    order = np.lexsort((ids[:, 0], -cos, i))
    i, ids, cos = i[order], ids[order], cos[order]
    new = np.ones(len(i), bool)  # a vector in several lists is found several times
    new[1:] = (i[1:] != i[:-1]) | (ids[1:, 0] != ids[:-1, 0])
    i, ids, cos = i[new], ids[new], cos[new]
    start = np.searchsorted(i, i)
    last = np.minimum(start + k, np.searchsorted(i, i, side="right") - 1)
    keep = cos >= cos[last]
    return i[keep], ids[keep], cos[keep]


class _Found:
    """Pairs found so far: (row, padded ids, rounded cosine)."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.held = k, ([], [], []), 0

    def add(self, *new: np.ndarray) -> None:
        for o, y in zip(self.parts, new):
            o.append(y)
        self.held += len(new[0])
        if self.held > HELD_PAIRS:
            self.all()

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts[0]:
            return np.zeros(0, int), np.zeros((0, self.k + 1), np.int64), np.zeros(0)
        best = _best(*map(np.concatenate, self.parts), self.k)
        self.parts, self.held = tuple([x] for x in best), len(best[0])
        return best


def _probed(x: np.ndarray, width: int, centers: np.ndarray | None, models: _Models, probes: int, share: float, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys of the lists they look into, the nearest first): so many of all `lists`, or that share if it is more, in
    the nearest regions."""
    n = 1 if centers is None else len(centers)
    wide = min(n, max(REGIONS, int(np.ceil(2 * share * n))))
    want = max(probes, int(np.ceil(share * lists)))
    out = []
    for lo in range(0, len(x), 1024):
        b = x[lo : lo + 1024]
        near = np.zeros((len(b), 1), int) if centers is None else np.argpartition(-(b @ centers.T), wide - 1, axis=1)[:, :wide]
        used = np.unique(near)
        score, keys = [], []
        for r in used.tolist():
            c = models.get(width, r)[0]
            s = b @ c.T
            s[~(near == r).any(axis=1)] = -np.inf
            score.append(s)
            keys.append((np.int64(r) << 32) + np.arange(len(c), dtype=np.int64))
        score, keys = np.hstack(score), np.concatenate(keys)
        p = min(want, len(keys))
        at = np.argpartition(-score, p - 1, axis=1)[:, :p]
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(score, at, 1), axis=1, kind="stable"), 1)
        chosen = np.where(np.isfinite(np.take_along_axis(score, at, 1)), keys[at], -1)
        out.append(np.pad(chosen, ((0, 0), (0, want - p)), constant_values=-1) if p < want else chosen)
    return np.repeat(np.arange(len(x)), want), np.concatenate(out).ravel()


def _scan(data: ds.Dataset, models: _Models, unit: np.ndarray, who: np.ndarray, keys: np.ndarray, floor: np.ndarray | None, k: int, least: float | None, found: _Found) -> None:
    """Looks into the lists `keys` for the rows `who`. floor: the cosine that a row's pairs need; None: each list's best."""
    width = unit.shape[1]
    x = unit.astype(np.float32)
    real = keys >= 0
    who, keys = who[real], keys[real]
    order = np.argsort(keys, kind="stable")
    who, keys = who[order], keys[order]
    needed, first = np.unique(keys, return_index=True)
    ours = dict(zip(needed.tolist(), np.split(who, first[1:])))
    goal = np.zeros(len(x), np.float32) if floor is None else floor.astype(np.float32)
    tables: dict[int, np.ndarray] = {}
    # lists come some rows at a time, so memory depends neither on their number nor on their length
    for t in data.scanner(columns=["key", "ids", "code", "missed", "v"], filter=pc.field("key").isin(needed), batch_size=32_768, use_threads=False).to_batches():
        if not t.num_rows:
            continue
        key = t.column("key").to_numpy()
        codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        missed, vectors, ids = t.column("missed").to_numpy(), _matrix(t.column("v"), width), _padded(t.column("ids"), k)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            mine, region, cell = ours[int(key[a])], int(key[a] >> 32), int(key[a] & 0xFFFFFFFF)
            c, books, deviation = models.get(width, region)
            exact = None
            for lo in range(a, z, 4096):
                hi = min(lo + 4096, z)
                entries = books.shape[0] * books.shape[1]
                if entries < width:
                    # a row's table is its product with every code of every part; a code's places in it make one product look up and add all
                    if region not in tables:
                        tables[region] = np.hstack([np.ascontiguousarray(s) @ b.T for s, b in zip(np.split(x, len(books), axis=1), books)])
                    left, right = tables[region], np.zeros((hi - lo, entries + 1), np.float32)
                    right[np.arange(hi - lo)[:, None], codes[lo:hi].astype(np.intp) + np.arange(len(books)) * books.shape[1]] = 1
                    own = x @ c[cell]
                else:
                    # the same sums in another order of the factors: (row x codebooks) x places = row x (codebooks x places)
                    left, right = x, np.empty((hi - lo, width + 1), np.float32)
                    right[:, :-1] = _rest(codes[lo:hi], books) + c[cell]
                    own = None
                right[:, -1] = missed[lo:hi]
                for qa in range(0, len(mine), 2048):
                    rows = mine[qa : qa + 2048]
                    guess = np.hstack([left[rows], goal[rows, None]]) @ right.T
                    if own is not None:
                        guess += own[rows, None]
                    if floor is None:
                        best = min(k + 1, hi - lo)
                        bound = np.partition(guess, hi - lo - best, axis=1)[:, hi - lo - best]
                    else:
                        bound = goal[rows] - DEVIATIONS * deviation * np.sqrt(np.maximum(1 - goal[rows] ** 2, 0.01))
                    i, j = np.nonzero(guess >= bound[:, None])
                    if not len(i):
                        continue
                    exact = _unit(vectors[a:z]) if exact is None else exact
                    i, j = rows[i], j + lo
                    cos = np.round(np.concatenate([np.einsum("ij,ij->i", unit[i[s : s + 65536]], exact[j[s : s + 65536] - a]) for s in range(0, len(i), 65536)]), 6)
                    keep = cos >= (-2 if floor is None else floor[i] if least is None else least)
                    found.add(i[keep], ids[j[keep]], cos[keep])


def _pairs(q: np.ndarray, k: int, least: float | None, probes: int, share: float, lists: int, data: ds.Dataset, models: _Models, centers: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, padded ids, rounded cosine) of the vectors that may belong to a result, the rows' own among them."""
    unit, found = _unit(q), _Found(k)
    who, keys = _probed(unit.astype(np.float32), q.shape[1], centers, models, probes, share, lists)
    if least is not None:
        _scan(data, models, unit, who, keys, np.full(len(q), least), k, least, found)
        return found.all()
    place = np.arange(len(keys)) % max(1, len(keys) // max(1, len(q)))
    near = place < FIRST
    _scan(data, models, unit, who[near], keys[near], None, k, None, found)
    i, _, cos = found.all()
    floor = np.full(len(q), -1.0)  # from here on only what is as near as the k-th other found so far
    at = np.searchsorted(i, np.arange(len(q)))
    some = np.searchsorted(i, np.arange(len(q)), side="right") - at > k
    floor[some] = cos[at[some] + k]
    _scan(data, models, unit, who[~near], keys[~near], floor, k, None, found)
    return found.all()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of one width, as long as HELD_ROWS."""
    held, rows = [], 0
    for b in batches:
        if held and (rows + b.num_rows > HELD_ROWS):
            yield pa.Table.from_batches(held)
            held, rows = [], 0
        held.append(b)
        rows += b.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def _search(lists_uri: str, models_uri: str, centers: dict[int, np.ndarray], lists: dict[int, int], k: int, least: float | None, probes: int, share: float):
    """For the index's rows: for each id of a row, its k most similar others. A row with rest set holds, under the row's
    smallest id, the result of any further id of its direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data: dict[int, ds.Dataset] = {}
        models = _Models(models_uri)
        for b in _gathered(batches):
            widths = b.column("width").to_numpy()
            for w in np.unique(widths).tolist():
                t = b.filter(pa.array(widths == w)).combine_chunks()
                data.setdefault(w, dataset(f"{lists_uri}/width={w}"))
                own = t.column("ids").to_pylist()
                lead = np.array([o[0] for o in own])
                i, ids, cos = _pairs(_matrix(t.column("v").combine_chunks(), w), k, least, probes, share, lists[w], data[w], models, centers.get(w))
                other = ids[:, 0] != lead[i]
                i, ids, cos = i[other], ids[other], cos[other]
                real = ids >= 0
                i, cos, ids = np.repeat(i, real.sum(axis=1)), np.repeat(cos, real.sum(axis=1)), ids[real]
                order = np.lexsort((ids, -cos, i))
                i, cos, ids = i[order], cos[order], ids[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, cos, ids = i[place < k], cos[place < k], ids[place < k]
                alone = np.array([len(o) == 1 for o in own])
                single = alone[i]
                left, right, value, rest = [lead[i[single]]], [ids[single]], [cos[single]], [np.zeros(int(single.sum()), bool)]
                for r in np.flatnonzero(~alone).tolist():
                    a, z = np.searchsorted(i, r), np.searchsorted(i, r, side="right")
                    all_ = sorted([*((-1.0, n) for n in own[r]), *zip((-cos[a:z]).tolist(), ids[a:z].tolist())])
                    for me in [*own[r], *[None] * (len(own[r]) == k + 1)]:
                        best = [e for e in all_ if e[1] != me][:k]
                        left.append(np.full(len(best), own[r][0] if me is None else me))
                        right.append(np.array([n for _, n in best], np.int64))
                        value.append(np.array([-s for s, _ in best], float))
                        rest.append(np.full(len(best), me is None))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in (left, right, value, rest)], names=["id", "neighbour_id", "cosine", "rest"])

    return run


def nearest(rows: DataFrame, id_: str, vector: str, k: int = 5, least: float | None = None, probes: int = PROBES, share: float = 0.0, ways: int = 1, region_rows: int = REGION_ROWS) -> DataFrame:
    """(id, neighbour_id, cosine): of every vector its k most similar others of equal length, by cosine rounded to 6
    decimals and then by id. With `least`, only neighbours of at least that cosine are looked for. Each vector probes so
    many lists, or that share of all lists if it is more, and is itself in the `ways` lists nearest to it.

    Vectors that are null, empty, all zeros or hold a null, NaN or infinity take no part. An id counts once; if its rows
    hold several directions, the one with the smallest digest. Vectors of one direction (equal after rounding to 5
    decimals) are indexed once, with their k + 1 smallest ids: those are each other's best neighbours, and all further
    ids of the direction share one result, so copies cost next to nothing however many there are.

    Vectors of a length are divided into regions, and those into lists; regions and lists grow in proportion to the vectors.
    Regions are fitted on a bounded sample, the lists and codebooks of a region in a task of its own on a sample of it
    (constants of this module). Every vector's residual is coded, and the lists are written to the shared folder, sorted.
    A task then takes a run of neighbouring vectors, reads just the lists that they probe, estimates cosines from their
    tables and computes those exactly that may belong to the result: estimates add what a code misses along its own
    vector, and may fall short by DEVIATIONS of the error measured when the region was fitted.
    """
    spark = rows.sparkSession
    x = rows.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("id is not null and size(v) > 0 and not exists(v, e -> e is null)")
    x = cut(x.mapInArrow(_packed, "id long, width int, v binary, way binary"), "vectors")
    twice = x.groupBy("id").agg(F.min(F.struct("way", "width")).alias("a"), F.max(F.struct("way", "width")).alias("z")).where("a <> z").select("id", F.col("a.way").alias("keep"))
    twice = cut(twice, "twice")
    if not twice.isEmpty():
        x = x.join(twice, "id", "left").where("keep is null or keep = way").drop("keep")
    # a row for each length; only lengths of more than one region are looked at by the driver
    n_of = {r[0]: r[1] for r in x.groupBy("width").agg(F.approx_count_distinct("way").alias("n")).collect()}
    if not n_of:
        return x.select("id", F.col("id").alias("neighbour_id"), F.lit(1.0).alias("cosine")).where("false")
    part = F.expr("pmod(xxhash64(way, 13), 1000000007) / 1000000007D")
    centers = {}
    for w in sorted(w for w, n in n_of.items() if n > region_rows):
        s = x.where((F.col("width") == w) & (part < 1.5 * SAMPLE / n_of[w])).groupBy("way").agg(F.min("v").alias("v")).orderBy(F.xxhash64("way", F.lit(17))).limit(SAMPLE).collect()
        c = _kmeans(_unit(np.frombuffer(b"".join(r["v"] for r in s), np.float32).reshape(-1, w)).astype(np.float32), -(-n_of[w] // region_rows), 8, 5)
        centers[w] = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)

    seen = x.select("width", "v", "way", F.expr("pmod(xxhash64(way, 29), 1000000007) / 1000000007D").alias("h")).mapInArrow(_placed(centers), "width int, v binary, way binary, h double, region int")
    n = F.col("n")
    sizes = seen.groupBy("width", "region").agg(F.approx_count_distinct("way").alias("n")) if centers else spark.createDataFrame([(w, 0, c) for w, c in n_of.items()], "width int, region int, n long")
    sizes = small(cut(sizes, "regions"))
    wanted = seen.join(sizes, ["width", "region"]).where(F.col("h") < F.least(F.greatest(F.lit(LIST_SHARE), LIST_LEAST / n), LIST_MOST / n))
    wanted = wanted.groupBy("width", "region", "way").agg(F.min("v").alias("v"), F.max(F.floor(n / LIST_ROWS)).alias("lists"))
    # a region without a vector in its sample would have no model: every region has its vector of the smallest digest too
    one = seen.groupBy("width", "region").agg(F.min(F.struct("way", "v")).alias("o")).join(sizes, ["width", "region"]).select("width", "region", "o.way", "o.v", F.floor(n / LIST_ROWS).alias("lists")) if centers else None
    models_path = qualified(spark, f"{shared_dir(spark)}/revsift-models-{uuid4().hex}")
    (wanted.unionByName(one).dropDuplicates(["width", "region", "way"]) if one is not None else wanted).groupBy("width", "region").applyInPandas(_fitted, _MODEL).write.parquet(models_path)
    lists = {r[0]: r[1] for r in spark.read.parquet(models_path).groupBy("width").agg(F.sum("lists")).collect()}

    first = Window.partitionBy("width", "way").orderBy("id")
    reps = x.withColumn("_n", F.dense_rank().over(first)).where(F.col("_n") <= k + 1)
    reps = reps.groupBy("width", "way").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.min_by("v", F.struct("id", "v")).alias("v"))
    columns = "width int, way binary, ids array<long>, v binary, key long, nearest boolean"
    reps = reps.mapInArrow(_listed(models_path, centers, ways), columns)
    path = qualified(spark, f"{shared_dir(spark)}/revsift-lists-{uuid4().hex}")
    order = [F.col("width"), F.col("key"), F.col("ids")[0]]
    reps.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_coded(models_path), f"{columns}, code binary, missed float").write.partitionBy("width").parquet(path)
    index = spark.read.parquet(path).where("nearest")
    found = cut(index.select("width", "ids", "v").mapInArrow(_search(path, models_path, centers, lists, k, least, probes, share), "id long, neighbour_id long, cosine double, rest boolean"), "neighbours")
    full = index.where(F.size("ids") == k + 1).select("width", "way", F.col("ids")[0].alias("first_id"), F.element_at("ids", -1).alias("top"))
    more = x.select("width", "way", "id").join(small(full), ["width", "way"]).where("id > top").select("id", "first_id").distinct()
    more = more.join(small(found.where("rest").select(F.col("id").alias("first_id"), "neighbour_id", "cosine")), "first_id").select("id", "neighbour_id", "cosine")
    return found.where("not rest").select("id", "neighbour_id", "cosine").unionByName(more)


def similar_comparisons(comparisons: DataFrame, k: int = 5, least: float | None = None, probes: int = PROBES, share: float = 0.0, ways: int = 1) -> DataFrame:
    """nearest over the candidate vectors of embedding comparisons, or where that is null the baseline vectors."""
    x = comparisons.select("comparison_id", F.coalesce("candidate_raw_vector", "baseline_raw_vector").alias("vector"))
    return nearest(x, "comparison_id", "vector", k, least, probes, share, ways)
