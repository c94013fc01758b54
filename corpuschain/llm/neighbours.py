"""The k most similar vectors of every vector, by an inverted multi-index.

The two halves of the vectors are quantised separately, with K centroids each, so that
K^2 cells cost only 2K centroids.  For each vector the cells are traversed in the order of
the summed distances of its halves to their centroids, with a heap, as far as a margin
beyond the nearest cell; all entries of those cells are then compared exactly.

The margin is measured, not set: for a bounded sample of vectors the true neighbours are
found among all entries, in one pass, and the margin is the least that reaches the cells of
the wanted share of them.  Dense topics make it wider, at any size, so that the recall
holds as the collection grows; ``recall`` checks it on vectors that had no part in it.

Equal vectors are one entry of the index with their ids: of a group of any size only the
k + 1 smallest ids can be anyone's neighbours, as ties go to the smaller id.

Distribution: neighbouring cells form blocks of a bounded number of entries.  A cell that
is fuller than a block is spread over several, so no dense topic meets one task.  A vector
travels once to each block of which it visits a cell, and the visitors of a block are split
over tasks by count; there, each cell is compared with its visitors by one matrix product.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuschain.runtime import Scratch


@dataclass(frozen=True)
class Settings:
    """``share``: the share of the sampled vectors' true neighbours that the margin must reach.
    ``asked`` and ``sample``: vectors that measure the margin and, for each centroid, train the
    centroids (20,000 at least), both bounds.  ``block`` and ``visitors``: entries of a block and
    visitors of a task.  ``max_centroids``: bound of K, and so of the K^2 cell counts that tasks hold."""

    share: float = 1.0
    asked: int = 512
    sample: int = 32
    block: int = 16_384
    visitors: int = 8_192
    max_centroids: int = 4096
    seed: int = 7


def prepare(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors of the most frequent dimension as packed float32, without those that are null, zero, or hold a null, NaN or infinity."""
    v = F.col(vector)
    fine = df.select(F.col(key).cast("bigint").alias("id"), v.cast("array<float>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0)
    )
    dims = fine.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    fine = fine.where(F.size("v") == (dims[0]["d"] if dims else 0))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "v": [np.asarray(x, dtype="<f4").tobytes() for x in b["v"]]})

    return fine.mapInPandas(pack, "id bigint, v binary")


def unpack(column: pd.Series) -> np.ndarray:
    """Rows of unit length in float64."""
    raw = np.frombuffer(b"".join(column), dtype="<f4").reshape(len(column), -1).astype(np.float64)
    raw /= np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def centroids(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means from k different rows; empty clusters restart at the row farthest from its centroid."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    c = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        own, far = nearest(x, c)
        n = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if (empty := np.flatnonzero(n == 0)).size:
            c[empty] = x[np.argsort(-far, kind="stable")[: empty.size]]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1), 0)


def nearest(x: np.ndarray, c: np.ndarray, step: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its squared distance, some rows at a time."""
    own, far = np.empty(len(x), dtype=np.int32), np.empty(len(x))
    for i in range(0, len(x), step):
        d = distances(x[i : i + step], c)
        own[i : i + step], far[i : i + step] = d.argmin(axis=1), d.min(axis=1)
    return own, far


class Index:
    """Centroids of both halves, the number of entries of each cell, the blocks that hold it, and the margin of the traversal."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        self.counts = np.zeros((len(first), len(second)), dtype=np.int32)
        self.block_of = np.zeros((len(first), len(second)), dtype=np.int32)
        #: Cells fuller than a block: their number of blocks, from ``block_of`` on.
        self.spread: dict[int, int] = {}
        self.margin = 0.0

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        x = x if x.shape[1] > h else np.hstack([x, np.zeros((len(x), 1))])
        return x[:, :h], x[:, h:]

    def group(self, size: int) -> None:
        """Blocks of about ``size`` entries, of cells in the order of their centroids' main directions."""
        a, b = main_order(self.first), main_order(self.second)
        n = self.counts[np.ix_(a, b)].ravel().astype(np.int64)
        upto = np.cumsum(n)
        start = (upto - n) // size
        self.block_of[np.repeat(a, len(b)), np.tile(b, len(a))] = start
        for i in np.flatnonzero(n > size):  # at most entries / size cells
            self.spread[int(a[i // len(b)]) * len(b) + int(b[i % len(b)])] = int((upto[i] - 1) // size - start[i] + 1)


def main_order(c: np.ndarray) -> np.ndarray:
    """The rows along the direction in which they differ most."""
    off = c - c.mean(axis=0)
    return np.argsort(off @ np.linalg.svd(off, full_matrices=False)[2][0], kind="stable")


def traverse(d1: np.ndarray, d2: np.ndarray, counts, least: int, margin: float = math.inf) -> list[tuple[int, int]]:
    """Non-empty cells in the order of summed distance: the multi-sequence algorithm with a heap.

    It ends at the first cell farther than ``margin`` beyond the nearest one that is not empty, but not before ``least`` entries.
    ``counts`` is indexed by (first, second).
    """
    r1, r2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    o1, o2, s1, s2 = r1.tolist(), r2.tolist(), d1[r1].tolist(), d2[r2].tolist()
    n1, n2 = len(o1), len(o2)
    heap, upto = [(s1[0] + s2[0], 0, 0)], [0] * n1
    out, held, limit = [], 0, math.inf
    while heap:
        far, a, b = heapq.heappop(heap)
        if held >= least and far > limit:
            break
        if n := counts[o1[a], o2[b]]:
            if not out:
                limit = far + margin
            out.append((o1[a], o2[b]))
            held += n
        # (a, b+1) once (a-1, b+1) was taken, and (a+1, b) once (a+1, b-1) was: each pair enters once
        upto[a] = b + 1
        if b + 1 < n2 and (a == 0 or upto[a - 1] > b + 1):
            heapq.heappush(heap, (s1[a] + s2[b + 1], a, b + 1))
        if a + 1 < n1 and upto[a + 1] == b:
            heapq.heappush(heap, (s1[a + 1] + s2[b], a + 1, b))
    return out


def compare(entries: pd.DataFrame, visitors: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each visitor of a block, the k + 1 best ids among the entries of its cells: (q, ids, cos)."""
    if not len(entries) or not len(visitors):
        return pd.DataFrame({"q": np.empty(0, dtype=np.int64), "ids": [], "cos": []})
    entries = entries.sort_values(["cell", "id"], kind="stable").reset_index(drop=True)
    e, q = unpack(entries["v"]), unpack(visitors["v"])
    e4, q4 = e.astype(np.float32), q.astype(np.float32)
    cells, starts = np.unique(entries["cell"].to_numpy(), return_index=True)
    ends = np.append(starts[1:], len(entries))
    lengths = visitors["cells"].map(len).to_numpy()
    visited = np.concatenate([np.asarray(c, dtype=np.int64) for c in visitors["cells"]])
    who = np.repeat(np.arange(len(visitors)), lengths)
    order = np.argsort(visited, kind="stable")
    visited, who = visited[order], who[order]
    keep = k + 12
    best = np.full((len(visitors), keep), -9.0, dtype=np.float32)
    at = np.full((len(visitors), keep), -1, dtype=np.int64)
    for cell, x, y in zip(cells, starts, ends, strict=True):
        guests = who[np.searchsorted(visited, cell, "left") : np.searchsorted(visited, cell, "right")]
        step = max(1, 500_000 // (y - x))
        for g in range(0, len(guests), step):
            rows = guests[g : g + step]
            score = q4[rows] @ e4[x:y].T
            place = np.broadcast_to(np.arange(x, y), score.shape)
            if score.shape[1] > keep:
                np.negative(score, out=score)
                top = np.argpartition(score, keep - 1, axis=1)[:, :keep]
                score, place = -np.take_along_axis(score, top, axis=1), top + x
            both, where = np.concatenate([best[rows], score], axis=1), np.concatenate([at[rows], place], axis=1)
            top = np.argpartition(-both, keep - 1, axis=1)[:, :keep]
            best[rows], at[rows] = np.take_along_axis(both, top, axis=1), np.take_along_axis(where, top, axis=1)
    # exact cosines of what is left, and of each entry its smallest ids
    n, slot = np.nonzero(at >= 0)
    place = at[n, slot]
    cos = np.einsum("ij,ij->i", q[n], e[place])
    ids = entries["ids"].to_numpy()
    many = np.array([len(i) for i in ids])[place]
    who, cos = np.repeat(n, many), np.round(np.repeat(cos, many), 9)
    near = np.concatenate([np.asarray(ids[p], dtype=np.int64) for p in place]) if len(place) else np.empty(0, dtype=np.int64)
    order = np.lexsort((near, -cos, who))
    who, cos, near = who[order], cos[order], near[order]
    bounds = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.empty(0, dtype=np.int64)
    ends = np.minimum(np.append(bounds[1:], len(who)), bounds + k + 1)
    own = visitors["id"].to_numpy()[who[bounds]] if len(who) else np.empty(0, dtype=np.int64)
    return pd.DataFrame({"q": own, "ids": [near[i:j] for i, j in zip(bounds, ends, strict=True)], "cos": [cos[i:j] for i, j in zip(bounds, ends, strict=True)]})


Rows = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def closest(own: np.ndarray, q: np.ndarray, rows: Rows, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(cosines, ids, tags) of the k closest rows to each row of q, but for itself, from batches of (ids, vectors, tags); ties by smaller id."""
    best = [(np.empty(0), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)) for _ in own]
    for ids, x, tags in rows:
        cos = np.round(q @ x.T, 9)
        cos[own[:, None] == ids[None, :]] = -9.0
        floor = -np.partition(-cos, k - 1, axis=1)[:, k - 1] if cos.shape[1] > k else np.full(len(own), -8.0)
        held = np.array([b[0][-1] if len(b[0]) == k else -8.0 for b in best])
        for n in np.flatnonzero(cos.max(axis=1) >= held):
            mine = np.flatnonzero(cos[n] >= max(floor[n], held[n], -8.0))  # what ties with the k-th stays
            c, i, t = (np.append(old, new[mine]) for old, new in zip(best[n], (cos[n], ids, tags), strict=True))
            order = np.lexsort((i, -c))[:k]
            best[n] = c[order], i[order], t[order]
    return best


def pieces(batches: Iterator[pd.DataFrame], step: int = 4096) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i in range(0, len(b), step):
            yield b.iloc[i : i + step]


def margin(placed: DataFrame, coarse: Broadcast, asked: pd.DataFrame, k: int, share: float) -> float:
    """How far beyond its nearest cell a vector must look: the least margin that reaches ``share`` of the true k nearest
    entries of the vectors asked.  Each is compared with all entries, in one pass; a task gives k rows for each."""
    sent = placed.sparkSession.sparkContext.broadcast((asked["id"].to_numpy(), unpack(asked["v"])))

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (own, x), index = sent.value, coarse.value
        width = len(index.second)
        rows = ((b["id"].to_numpy(), unpack(b["v"]), b["first"].to_numpy().astype(np.int64) * width + b["second"].to_numpy()) for b in pieces(batches))
        h1, h2 = index.halves(x)
        d1, d2 = distances(h1, index.first), distances(h2, index.second)
        for n, (cos, ids, cells) in enumerate(closest(own, x, rows, k)):
            beyond = d1[n][cells // width] + d2[n][cells % width] - d1[n].min() - d2[n].min()
            yield pd.DataFrame({"q": own[n], "cos": cos, "id": ids, "beyond": beyond})

    order = F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("order"), "id", "beyond")))
    true = placed.mapInPandas(brute, "q bigint, cos double, id bigint, beyond double").groupBy("q").agg(F.slice(order, 1, k).alias("near"))
    gaps = true.select(F.explode("near.beyond").alias("gap")).toPandas()["gap"].to_numpy()  # asked x k rows
    return float(np.quantile(gaps, share, method="higher")) * (1 + 1e-9) + 1e-12 if len(gaps) else 0.0


def neighbours(df: DataFrame, key: str, vector: str, k: int = 5, settings: Settings = Settings()) -> DataFrame:
    """(id, neighbour, cos, rank): the k most similar other vectors of each, or all where there are fewer.

    Cosines are rounded to 9 decimals, and equal ones rank by the smaller id.  Vectors that
    ``prepare`` leaves out have no row and are nobody's neighbour.  Ids must be unique.
    Other columns are ignored.  An empty table gives no rows.
    """
    s, spark = settings, df.sparkSession
    scratch = Scratch(spark, "neighbours")
    packed = scratch.cut(prepare(df, key, vector), "packed")
    # Equal vectors: salted, so that the ids of a large group are cut to k + 1 in many tasks before they meet.
    keyed = packed.select("id", F.sha2("v", 256).alias("h"))
    first_ids = lambda c: F.slice(F.sort_array(c), 1, k + 1)
    salted = keyed.groupBy("h", F.pmod(F.xxhash64("id"), F.lit(256)).alias("salt")).agg(first_ids(F.collect_list("id")).alias("ids"))
    groups = scratch.cut(salted.groupBy("h").agg(first_ids(F.flatten(F.collect_list("ids"))).alias("ids")).select(F.col("ids")[0].alias("id"), "ids", "h"), "groups")
    entries = packed.join(groups.select("id", "ids"), "id")

    n = groups.count()
    if not n:
        return spark.createDataFrame([], "id bigint, neighbour bigint, cos double, rank int")
    wanted = 2 ** round(math.log2(max(4.0, math.sqrt(n) / 5)))
    width = min(wanted, s.max_centroids)
    some = packed.join(groups.select("id"), "id").orderBy(F.xxhash64("id", F.lit(s.seed))).limit(max(20_000, s.sample * width)).orderBy("id").toPandas()
    x = unpack(some["v"])
    half = x.shape[1] // 2 or 1
    second = x[:, half:] if x.shape[1] > half else np.zeros((len(x), 1))
    index = Index(centroids(x[:, :half], width, s.seed), centroids(second, width, s.seed + 1))
    coarse = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i = coarse.value
        for b in batches:
            if len(b):
                h1, h2 = i.halves(unpack(b["v"]))
                b["first"], b["second"] = nearest(h1, i.first)[0], nearest(h2, i.second)[0]
                yield b

    placed = scratch.cut(entries.mapInPandas(assign, "id bigint, v binary, ids array<bigint>, first int, second int"), "placed")
    filled = placed.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n")).toPandas()  # K^2 rows at most
    index.counts[filled["first"], filled["second"]] = filled["n"]
    asked = some.iloc[np.random.default_rng(s.seed).permutation(len(some))[: s.asked]]
    index.margin = margin(placed, coarse, asked, k, s.share)
    index.group(s.block)
    full = spark.sparkContext.broadcast(index)
    columns = len(index.second)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i = full.value
        counts, block_of = memoryview(i.counts), memoryview(i.block_of)
        for b in pieces(batches):
            h1, h2 = i.halves(unpack(b["v"]))
            d1, d2 = distances(h1, i.first), distances(h2, i.second)
            out = []
            for n, (key_, v) in enumerate(zip(b["id"], b["v"], strict=True)):
                stops: dict[int, list[int]] = {}
                for a, c in traverse(d1[n], d2[n], counts, k + 1, i.margin):
                    cell = a * columns + c
                    for block in range(at := block_of[a, c], at + i.spread.get(cell, 1)):
                        stops.setdefault(block, []).append(cell)
                out += [(block, key_, v, cells) for block, cells in stops.items()]
            yield pd.DataFrame(out, columns=["block", "id", "v", "cells"])

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i = full.value
        for b in batches:
            cell = b["first"].to_numpy().astype(np.int64) * columns + b["second"].to_numpy()
            block = i.block_of[b["first"].to_numpy(), b["second"].to_numpy()]
            if i.spread:
                block = block + np.array([h % i.spread.get(c, 1) for h, c in zip(b["h"].tolist(), cell.tolist(), strict=True)], dtype=np.int32)
            yield pd.DataFrame({"block": block, "cell": cell, "id": b["id"], "v": b["v"], "ids": b["ids"]})

    routed = scratch.cut(placed.select("id", "v").mapInPandas(route, "block int, id bigint, v binary, cells array<bigint>"), "routed")
    # shares of equal work, over all cores where there are few visitors
    tasks = 3 * spark.sparkContext.defaultParallelism
    most = max(256, min(s.visitors, -(-routed.count() // tasks)))
    shares = scratch.cut(routed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("shares")), "shares")
    tasks = max(tasks, shares.agg(F.sum("shares")).first()[0] or 1)
    settled = placed.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 31)))
    settled = settled.mapInPandas(settle, "block int, cell bigint, id bigint, v binary, ids array<bigint>")
    spread = settled.join(shares, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "id", "v", "ids", "cell")
    guests = routed.join(shares, "block").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")).select("block", "share", "id", "v", "cells")
    spread, guests = spread.repartition(tasks, "block", "share"), guests.repartition(tasks, "block", "share")
    pairs = spread.groupBy("block", "share").cogroup(guests.groupBy("block", "share")).applyInPandas(lambda e, q: compare(e, q, k), "q bigint, ids array<bigint>, cos array<double>")
    # a vector has k + 1 ids from each block that it visited
    each = F.transform(F.arrays_zip("ids", "cos"), lambda p: F.struct((-p["cos"]).alias("order"), p["ids"].alias("neighbour")))
    ranked = pairs.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list(each))), 1, k + 1).alias("near"))
    found = scratch.cut(ranked, "found")
    per_group = groups.join(found, F.col("id") == F.col("q")).select("h", "near")
    members = keyed.join(per_group, "h")
    others = F.slice(F.filter("near", lambda p: p["neighbour"] != F.col("id")), 1, k)
    return members.select("id", F.posexplode(others)).select(
        "id", F.col("col.neighbour").alias("neighbour"), (-F.col("col.order")).alias("cos"), (F.col("pos") + 1).alias("rank")
    )


def unordered_pairs(near: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller id first, where at least one is among the neighbours of the other."""
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def recall(df: DataFrame, near: DataFrame, key: str, vector: str, k: int = 5, every: int = 20) -> DataFrame:
    """One row (n_asked, n_true, n_found): the vectors whose id is divisible by ``every``, their true k neighbours by comparison with all rows, and how many of those ``near`` has."""
    packed = prepare(df, key, vector)
    queries = packed.where(F.col("id") % every == 0)
    asked = queries.orderBy("id").toPandas()
    sent = df.sparkSession.sparkContext.broadcast((asked["id"].to_numpy(), unpack(asked["v"]) if len(asked) else None))

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, x = sent.value
        if len(own):
            rows = ((b["id"].to_numpy(), unpack(b["v"]), b["id"].to_numpy()) for b in pieces(batches))
            for n, (cos, ids, _) in enumerate(closest(own, x, rows, k)):
                yield pd.DataFrame({"id": own[n], "neighbour": ids, "cos": cos})

    order = F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("order"), "neighbour")))
    true = packed.mapInPandas(brute, "id bigint, neighbour bigint, cos double").groupBy("id").agg(F.slice(order, 1, k).alias("near"))
    hits = near.select("id", "neighbour", F.lit(1).alias("hit"))
    joined = true.select("id", F.explode("near.neighbour").alias("neighbour")).join(hits, ["id", "neighbour"], "left")
    return joined.agg(F.countDistinct("id").alias("n_asked"), F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"))
