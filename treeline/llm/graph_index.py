"""Approximate nearest neighbours on robust-pruned directed graphs (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.session import cut

#: Different vectors of a shard, which one task builds and one task searches: about 1 KB each.
ROWS_PER_SHARD = 8192
DEGREE = 32
BEAM = 64
#: A candidate goes when a chosen neighbour is this many times nearer to it than the node is.
RELAX = 1.2
#: Nodes that are inserted, or queries that are searched, together.
TOGETHER = 512


def distances(points: np.ndarray, ids: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances from each centre to its row of ``ids``; below 0 an id is none and infinitely far."""
    gap = points[ids] - centres[:, None, :]
    found = np.einsum("qrd,qrd->qr", gap, gap)
    found[ids < 0] = np.inf
    return found


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes found for each query, nearest first, and their squared distances; -1 fills up.

    All queries go in step: each opens its nearest unopened node, and the node's neighbours compete for the beam.
    """
    n = len(queries)
    ids, far = np.full((n, beam), -1, np.int64), np.full((n, beam), np.inf, np.float32)
    opened = np.zeros((n, beam), bool)
    ids[:, 0] = entry
    far[:, 0] = distances(points, ids[:, :1], queries)[:, 0]
    live = np.arange(n)
    while len(live):
        waiting = np.where(opened[live], np.inf, far[live])
        best = waiting.argmin(axis=1)
        more = np.isfinite(waiting[np.arange(len(live)), best])
        live, best = live[more], best[more]
        if not len(live):
            break
        opened[live, best] = True
        near = graph[ids[live, best]].astype(np.int64)
        near[(near[:, :, None] == ids[live][:, None, :]).any(axis=2)] = -1
        every = np.concatenate([ids[live], near], axis=1)
        away = np.concatenate([far[live], distances(points, near, queries[live])], axis=1)
        done = np.concatenate([opened[live], np.zeros(near.shape, bool)], axis=1)
        order = np.argsort(away, axis=1, kind="stable")[:, :beam]
        ids[live], far[live], opened[live] = (np.take_along_axis(x, order, axis=1) for x in (every, away, done))
    ids[~np.isfinite(far)] = -1
    return ids, far


def robust_prune(points: np.ndarray, nodes: np.ndarray, near: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each node out of its candidates ``near`` (-1 is none).

    The nearest candidate is chosen, and those go to which it is nearer, by the factor ``relax``, than the node is; and so on.
    """
    near = np.where(near == nodes[:, None], -1, near)
    sorted_ids = np.sort(near, axis=1)
    sorted_ids[:, 1:][sorted_ids[:, 1:] == sorted_ids[:, :-1]] = -1
    far = distances(points, sorted_ids, points[nodes])
    order = np.argsort(far, axis=1, kind="stable")
    near, far = np.take_along_axis(sorted_ids, order, axis=1), np.take_along_axis(far, order, axis=1)
    width = max(1, int(np.isfinite(far).sum(axis=1).max(initial=0)))
    near, far = near[:, :width], far[:, :width]
    spots = points[near]
    square = np.einsum("pcd,pcd->pc", spots, spots)
    between = square[:, :, None] + square[:, None, :] - 2 * (spots @ spots.transpose(0, 2, 1))
    alive, rows = np.isfinite(far), np.arange(len(nodes))
    chosen = np.full((len(nodes), degree), -1, np.int32)
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        chosen[some, k] = near[some, first[some]]
        alive &= relax * relax * between[rows, first] > far
        alive[rows, first] = False
    return chosen


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX) -> tuple[np.ndarray, int]:
    """Out-neighbours ``(n, 2 * degree)`` of every point, -1 where there are fewer, and the entry point.

    Points come in growing lots. A lot's greedy searches over the graph so far propose neighbours, pruning keeps diverse
    ones, and every chosen neighbour gets an edge back; a node with more than twice ``degree`` edges is pruned again.
    """
    n = len(points)
    graph = np.full((n, 2 * degree), -1, np.int32)
    if n == 0:
        return graph, 0
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(0).permutation(n)
    order = np.r_[entry, order[order != entry]]
    at = 1
    while at < n:
        lot = order[at : at + min(TOGETHER, max(1, at))]
        proposed, _ = beam_search(points, graph, entry, points[lot], beam)
        among = order[at : at + len(lot)]
        if len(among) > 1:  # members of a lot do not find each other in the graph
            gap = ((points[among] ** 2).sum(axis=1)[None, :] - 2 * points[among] @ points[among].T).astype(np.float32)
            nearest = np.argsort(gap, axis=1, kind="stable")[:, : degree // 2 + 1]
            proposed = np.concatenate([proposed, among[nearest]], axis=1)
        graph[lot, :degree] = robust_prune(points, lot, proposed, degree, relax)
        _edges_back(points, graph, lot, degree, relax)
        at += len(lot)
    return graph, entry


def _edges_back(points: np.ndarray, graph: np.ndarray, lot: np.ndarray, degree: int, relax: float) -> None:
    target, source = graph[lot, :degree].ravel(), np.repeat(lot, degree)
    target, source = target[target >= 0].astype(np.int64), source[target >= 0]
    order = np.argsort(target, kind="stable")
    nodes, first, count = np.unique(target[order], return_index=True, return_counts=True)
    for part in range(0, len(nodes), TOGETHER):
        own, begin, n = nodes[part : part + TOGETHER], first[part : part + TOGETHER], count[part : part + TOGETHER]
        back = np.full((len(own), int(n.max())), -1, np.int64)
        back[np.repeat(np.arange(len(own)), n), np.concatenate([np.arange(x) for x in n])] = source[order][np.concatenate([np.arange(b, b + x) for b, x in zip(begin, n, strict=True)])]
        every = np.concatenate([graph[own].astype(np.int64), back], axis=1)
        every = np.sort(every, axis=1)[:, ::-1]
        every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
        every = np.sort(every, axis=1)[:, ::-1]
        full = (every >= 0).sum(axis=1) > 2 * degree
        width = min(every.shape[1], 2 * degree)
        graph[own[~full], :width] = every[~full, :width]
        if full.any():
            graph[own[full], degree:] = -1
            graph[own[full], :degree] = robust_prune(points, own[full], every[full], degree, relax)


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and every component finite."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~broken & F.exists(vector, lambda x: x != 0)


INDEX = "shard int, dim int, vec_ids array<bigint>, vector array<float>, lift float, neighbours array<int>, entry boolean"


def build_index(vectors: DataFrame, most_ids: int, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """One row per different vector of ``vectors(vec_id, vector)``: its shard, its smallest ``most_ids`` ids, its neighbours in the shard.

    Neighbours are numbered as rows of the shard are, by smallest id. Inner products become distances by lifting: a further
    component makes all vectors as long as the longest.
    """
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = vectors.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most_ids)
    classes = cut(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("vec_ids")))
    n, longest = classes.agg(F.count("*"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()
    shards = max(1, -(-n // rows_per_shard))

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(_first=[x[0] for x in frame["vec_ids"]]).sort_values("_first").drop(columns="_first")
        flat = np.stack(frame["vector"].tolist()).astype(np.float32)
        lift = np.sqrt(np.maximum(longest - (flat.astype(np.float64) ** 2).sum(axis=1), 0)).astype(np.float32)
        graph, entry = build_graph(np.c_[flat, lift])
        return frame.assign(lift=lift, neighbours=[g[g >= 0] for g in graph], entry=np.arange(len(frame)) == entry)[INDEX_COLUMNS]

    parted = classes.select(F.pmod(F.xxhash64(F.col("vec_ids")[0]), F.lit(shards)).cast("int").alias("shard"), F.size("vector").alias("dim"), "vec_ids", "vector")
    return parted.groupBy("shard", "dim").applyInPandas(build, INDEX)


INDEX_COLUMNS = ["shard", "dim", "vec_ids", "vector", "lift", "neighbours", "entry"]
FOUND = "query_id bigint, vec_id bigint, score double"


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each of ``queries(query_id, vector)`` the ``k`` nearest found, by inner product.

    Every shard is read by one task, its graph first and then the queries in batches; queries of another dimension than a shard's
    are not put to it. Each shard gives its ``k`` nearest, the nearest of all shards are the result. Scores are inner products of the given vectors in double precision.
    """
    spread = index.select("shard", "dim").distinct()
    asked = queries.select("query_id", "vector", F.size("vector").alias("dim")).join(F.broadcast(spread), "dim")  # a row per shard
    empty = lambda kind: F.lit(None).cast(kind)
    rows = index.select("shard", "dim", F.lit(0).alias("kind"), F.col("vec_ids")[0].alias("id"), "vec_ids", "vector", "neighbours", "entry").unionByName(
        asked.select("shard", "dim", F.lit(1).alias("kind"), F.col("query_id").alias("id"), empty("array<bigint>").alias("vec_ids"), "vector", empty("array<int>").alias("neighbours"), empty("boolean").alias("entry"))
    )
    parts = max(1, spread.count())
    dealt = rows.repartition(parts, "shard", "dim").sortWithinPartitions("shard", "dim", "kind", "id")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, ready = None, [], None
        for frame in frames:
            for key, part in frame.groupby(["shard", "dim", "kind"], sort=False):
                if key[:2] != shard:
                    shard, held, ready = key[:2], [], None
                if key[2] == 0:
                    held.append(part)
                    continue
                ready = ready or _loaded(pd.concat(held))
                held = []
                for at in range(0, len(part), TOGETHER):
                    yield _nearest(ready, part.iloc[at : at + TOGETHER], k, beam)

    found = dealt.mapInPandas(walk, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _loaded(rows: pd.DataFrame) -> tuple:
    flat = np.stack(rows["vector"].tolist()).astype(np.float32)
    graph = np.full((len(rows), max(1, max(map(len, rows["neighbours"])))), -1, np.int32)
    for i, near in enumerate(rows["neighbours"]):
        graph[i, : len(near)] = near
    length = (flat.astype(np.float64) ** 2).sum(axis=1)
    lift = np.sqrt(length.max() - length).astype(np.float32)
    return flat, np.c_[flat, lift], graph, int(np.flatnonzero(rows["entry"].to_numpy(bool))[0]), rows["vec_ids"].tolist()


def _nearest(ready: tuple, asked: pd.DataFrame, k: int, beam: int) -> pd.DataFrame:
    flat, points, graph, entry, ids = ready
    vectors = np.stack(asked["vector"].tolist()).astype(np.float32)
    # a query needs no lift: it adds the same to all of its distances, and longer queries only scale products
    scale = np.sqrt((points.astype(np.float64) ** 2).sum(axis=1).max()) / np.linalg.norm(vectors.astype(np.float64), axis=1)
    found, _ = beam_search(points, graph, entry, np.c_[(vectors * scale[:, None]).astype(np.float32), np.zeros(len(vectors), np.float32)], beam)
    out: list[tuple] = []
    for query, vector, near in zip(asked["id"], vectors, found, strict=True):
        near = near[near >= 0]
        scores = flat[near].astype(np.float64) @ vector.astype(np.float64)
        hits = [(-score, i) for at, score in zip(near, scores, strict=True) for i in ids[at] if i != query]
        out += [(query, i, -score) for score, i in sorted(hits)[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, rows_per_shard: int = ROWS_PER_SHARD, beam: int = BEAM) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the rows of ``vectors(vec_id, embedding)`` for which ``is_query`` holds.

    Candidates are all rows but the query's own. Vectors that are null, empty or zero or hold a null or a non-finite component
    take no part, nor do null ids. Equal vectors are one node that holds the smallest ``k + 1`` of their ids, which is all that a list of ``k`` can show; ties go to smaller ids.
    A repeated ``vec_id`` counts once, with its smallest vector. Queries only meet vectors of their own dimension. An empty table gives no rows; other columns are ignored.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("vector"))
    rows = cut(rows.select("vec_id", F.col("vector").cast("array<float>").alias("vector")))
    index = cut(build_index(rows, k + 1, rows_per_shard))
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vector")
    return search(index, queries, k, beam)
