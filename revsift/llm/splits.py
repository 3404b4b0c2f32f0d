"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revsift.common import cut, partitions, small
from revsift.functions.text import commit_key
from revsift.operators.graph import components

#: Components with more than this share of all rows are placed one by one, first: there are at most 1 / HEAVY of them.
HEAVY = 1 / 2000
#: Components in a block that is annealed on its own, about; steps for each of them; chains, of which the best is kept.
BLOCK, STEPS, CHAINS = 4_000, 30, 3
#: The rows below that share, as so many equal parts, stand for them while the large components are placed.
GRAINS = 200
#: Labels that are balanced one by one; all others are balanced together, as one more.
LABELS, NO_LABEL = 30, ""


def _deviation(mass: np.ndarray, want: np.ndarray) -> float:
    """mass, want: splits x (rows, then rows by label)."""
    return float(np.abs(mass - want).sum(axis=0) @ np.append(1.0, np.full(mass.shape[1] - 1, 0.5)))


def anneal(sizes: np.ndarray, share: np.ndarray, start: np.ndarray, seed: int, steps: int) -> np.ndarray:
    """The split of each component. sizes: components x (rows, then rows by label). Starts as given; moves a component or
    exchanges two, always where that lessens the deviation and else with a probability that falls; keeps the best seen."""
    n, k = len(sizes), len(share)
    if n == 0 or k < 2:
        return start
    rng = np.random.default_rng(seed)
    at = start.copy()
    want = np.outer(share, sizes.sum(axis=0))
    mass = np.zeros_like(want)
    np.add.at(mass, at, sizes)
    weight = np.append(1.0, np.full(sizes.shape[1] - 1, 0.5))
    now = _deviation(mass, want)
    best, best_at, heat = now, at.copy(), max(1.0, float(sizes[:, 0].mean()))
    picks, others, target, luck, swap = rng.integers(0, n, steps), rng.integers(0, n, steps), rng.integers(0, k, steps), rng.random(steps), rng.random(steps) < 0.5
    for t in range(steps):
        i = picks[t]
        a = at[i]
        if swap[t]:
            j = others[t]
            b = at[j]
            moved = sizes[i] - sizes[j]
        else:
            j, b = -1, target[t]
            moved = sizes[i]
        if a == b:
            continue
        new = now + float((np.abs(mass[a] - moved - want[a]) - np.abs(mass[a] - want[a]) + np.abs(mass[b] + moved - want[b]) - np.abs(mass[b] - want[b])) @ weight)
        if new < now or luck[t] < np.exp((now - new) / (heat * (1 - t / steps) + 1e-9)):
            mass[a] -= moved
            mass[b] += moved
            at[i] = b
            if j >= 0:
                at[j] = a
            now = new
            if now < best - 1e-9:
                best, best_at = now, at.copy()
    return best_at


def _hashed(key: np.ndarray, share: np.ndarray) -> np.ndarray:
    """A split for each component by its hash, in the given shares."""
    u = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(float) / 2**53
    return np.minimum(np.searchsorted(np.cumsum(share), u, side="right"), len(share) - 1)


def _chain(sizes: np.ndarray, key: np.ndarray, share: np.ndarray, chain: int) -> tuple[np.ndarray, float]:
    """(the splits that one chain of annealing ends with, how far they are off)."""
    at = anneal(sizes, share, _hashed(key + np.int64(7919 * chain), share), chain, STEPS * len(sizes) + 2000)
    want = np.outer(share, sizes.sum(axis=0))
    mass = np.zeros_like(want)
    np.add.at(mass, at, sizes)
    return at, _deviation(mass, want)


def _annealed(group: DataFrame, cols: list[str], share: np.ndarray, blocks: int, grain: np.ndarray | None = None) -> DataFrame:
    """(g, at): the split of each group (g, h, block, cols), each of so many blocks by its best chain. Chains are tasks of their own.

    grain: sizes of each of GRAINS further groups that have no rows here."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["h", "g"])
        sizes, key = p[cols].to_numpy(float), p["h"].to_numpy(np.int64)
        if grain is not None:
            sizes, key = np.vstack([sizes, np.tile(grain, (GRAINS, 1))]), np.concatenate([key, np.arange(GRAINS) * 2654435761])
        at, off = _chain(sizes, key, share, int(p["chain"].iloc[0]))
        return pd.DataFrame({"block": p["block"], "chain": p["chain"], "g": p["g"], "at": at[: len(p)].astype(np.int32), "off": off})

    tried = group.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(CHAINS - 1)))).repartition(min(blocks * CHAINS, 64 * partitions(group.sparkSession)), "block", "chain").groupBy("block", "chain").applyInPandas(run, "block long, chain int, g string, at int, off double")
    return cut(tried, "chains").groupBy("g").agg(F.min_by("at", F.struct("off", "chain")).alias("at"))


def grouped_splits(rows: DataFrame, targets: DataFrame, row_id: str = "row_id", ties: tuple[str, ...] = ("commit_before", "commit_after"), label: str | None = None) -> DataFrame:
    """(row_id, group_row_id, split_name): every row id with the smallest of its group and the group's split.

    Rows are tied if they name the same commit in any of the columns `ties`, and ties are handed on; values that name no
    commit (also null, empty and all zeros) tie nothing, so a row without any is a group of its own. Groups are placed so
    that the splits have the wanted shares of the rows, and nearly the same shares of the rows of each label (the LABELS
    most frequent values of a column, and all others together).

    Groups above a fixed share of all rows come first (their number is bounded), then the others in blocks by hash, each
    annealed on its own towards what the large ones left: hashed assignment, then moves and exchanges of whole groups in
    several chains, each a task of its own, the best kept. Repeated rows count once; the ties of all rows of one id hold.
    Shares need not add up to 1; null or negative ones count as 0. Without usable targets split_name is null. A null row_id
    is dropped. The table of targets, a row for each split, is read by the driver.
    """
    spark = rows.sparkSession
    wanted = targets.select("split_name", F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("s")).where("split_name is not null").groupBy("split_name").agg(F.max("s").alias("s")).orderBy("split_name").collect()
    names, share = [r[0] for r in wanted], np.array([r[1] for r in wanted], float)
    share = share / share.sum() if share.sum() > 0 else share

    lab = F.coalesce(F.col(label).cast("string"), F.lit(NO_LABEL)) if label else F.lit(NO_LABEL)
    keys = [f"k{i}" for i in range(len(ties))]
    x = rows.select(F.col(row_id).alias("r"), lab.alias("label"), *[commit_key(F.col(t)).alias(k) for k, t in zip(keys, ties)]).where("r is not null")
    x = x.withColumn("k", F.coalesce(*keys))
    ids = cut(x.groupBy("r").agg(F.min("label").alias("label"), F.min("k").alias("k"), F.max("k").alias("z")), "ids")
    # a row ties its own commits; rows of one id that begin with different ones are tied by the id
    own = x.select("k", F.explode(F.array_compact(F.array(*keys))).alias("v"))
    twice = ids.where("k < z").select("r", F.col("k").alias("v"))
    apart = x.where("k is not null").select("r", "k").join(small(cut(twice, "twice")), "r").select("k", "v")
    edges = own.unionByName(apart).where("k <> v").select(F.greatest("k", "v").alias("u"), F.least("k", "v").alias("v")).distinct()
    comp = small(components(edges))
    rooted = ids.join(comp.withColumnRenamed("node", "k"), "k", "left").select("r", "label", F.coalesce("root", "k").alias("root"))
    # a group is known by its commit, or by its row if it has none
    known = F.coalesce(F.concat(F.lit("c"), "root"), F.concat(F.lit("r"), F.col("r").cast("string")))
    rooted = cut(rooted.select("r", "label", known.alias("g")), "rooted")
    kinds = [r[0] for r in rooted.groupBy("label").count().orderBy(F.desc("count"), "label").limit(LABELS).collect()] if label else []
    held = [F.col("label") == v for v in kinds] + ([~F.col("label").isin(kinds)] if kinds else [])
    group = rooted.groupBy("g").agg(F.min("r").alias("group_row_id"), F.count("*").alias("n"), *[F.count_if(v).alias(f"l{i}") for i, v in enumerate(held)])
    group = cut(group.withColumn("h", F.xxhash64("g")), "groups")
    cols = ["n", *[f"l{i}" for i in range(len(held))]]
    if names and share.sum() > 0:
        total = group.agg(F.count("*"), *[F.sum(c) for c in cols]).first()
        all_ = np.array([float(v or 0) for v in total[1:]])
        heavy = F.col("n") > HEAVY * float(all_[0])
        big = group.where(heavy)
        mass = np.array([float(v or 0) for v in big.agg(*[F.sum(c) for c in cols]).first()])
        # the light groups fill what is left, so the heavy ones need only stay below their shares
        first = cut(_annealed(big.select("g", "h", F.lit(-1).cast("long").alias("block"), *cols), cols, share, 1, (all_ - mass) / GRAINS), "heavy")
        taken = np.zeros(len(share))
        for r in first.join(big, "g").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row for each split
            taken[r["at"]] = r["n"]
        left = np.maximum(share * all_[0] - taken, 0)
        left = left / left.sum() if left.sum() > 0 else share
        blocks = max(1, -(-int(total[0]) // BLOCK))
        rest = _annealed(group.where(~heavy).select("g", "h", F.expr(f"pmod(h, {blocks})").alias("block"), *cols), cols, left, blocks)
        name = F.element_at(F.array(*[F.lit(v) for v in names]), F.col("at") + 1)
        placed = group.join(first.unionByName(rest), "g").select("g", "group_row_id", name.alias("split_name"))
    else:
        placed = group.select("g", "group_row_id", F.lit(None).cast("string").alias("split_name"))
    return rooted.join(small(cut(placed, "placed")), "g").select(F.col("r").alias(row_id), "group_row_id", "split_name")
