"""Approximate nearest neighbours by a robust-pruned directed graph in every shard.

Distinct vectors are dealt over shards of bounded size. In a shard points join the graph one after
the other: a greedy search proposes neighbours, pruning keeps those that no kept neighbour is closer
to by a relaxed distance, and edges go both ways under a bound on the degree. A query walks every
shard's graph with a beam; the best of all shards are ranked by exact distances.
"""

from __future__ import annotations

import heapq
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import staged

SHARD_ROWS = 2_000  # distinct vectors in a shard, about
DEGREE = 24  # edges out of a point
BUILD_BEAM = 40
RELAX = 1.2  # a candidate is dropped where a kept neighbour is this much closer to it
BEAM = 96  # search list of a query in one shard
QUERY_BLOCK = 256  # queries that visit a shard together

SHARDS = "shard long, dim int, n int, degree int, start int, ids array<array<long>>, vectors binary, edges binary"


def usable(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (id, v) whose vector is not null, not empty, not all zero and holds finite numbers only."""
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))


def distinct_vectors(rows: DataFrame, copies: int) -> DataFrame:
    """One row (v, ids) for each distinct vector with the smallest ``copies`` ids that hold it.

    No answer needs more of them, as equal distances go by id. Spark keeps that many of a vector in every
    task before it shuffles, so a vector that stands in a third of all rows stays small.
    """
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return (
        rows.dropDuplicates(["id", "v"]).withColumn("nth", first).where(F.col("nth") <= copies)
        .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )


class Graph:
    """A shard's points with their edges; row k of ``edges`` holds the neighbours of point k, filled with -1."""

    def __init__(self, points: np.ndarray, edges: np.ndarray, start: int):
        self.points, self.edges, self.start = points, edges, start

    @classmethod
    def build(cls, points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> Graph:
        n = len(points)
        full = degree + degree // 3  # pruned back to degree when full
        out = cls(points, np.full((n, full), -1, np.int32), 0)
        counts = np.zeros(n, np.int32)
        if not n:
            return out
        middle = points.mean(axis=0)
        out.start = int(((points - middle) ** 2).sum(axis=1).argmin())
        order = np.random.default_rng(n).permutation(n)
        for p in [out.start, *[int(k) for k in order if k != out.start]]:
            if p == out.start:
                continue
            seen = out.visited(points[p], beam)
            chosen = out._prune(p, seen, degree, relax)
            out.edges[p, : len(chosen)] = chosen
            counts[p] = len(chosen)
            for q in chosen:
                if counts[q] < full:
                    out.edges[q, counts[q]] = p
                    counts[q] += 1
                else:
                    kept = out._prune(q, np.append(out.edges[q], p), degree, relax)
                    out.edges[q, : len(kept)] = kept
                    out.edges[q, len(kept) :] = -1
                    counts[q] = len(kept)
        return out

    def _prune(self, p: int, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
        candidates = candidates[candidates != p]
        near = self.points[candidates]
        d = ((near - self.points[p]) ** 2).sum(axis=1)
        order = np.argsort(d, kind="stable")
        candidates, near, d = candidates[order], near[order], d[order]
        norms = (near * near).sum(axis=1)
        between = norms[:, None] + norms[None, :] - 2 * near @ near.T
        alive, kept = np.ones(len(candidates), bool), []
        for k in range(len(candidates)):
            if alive[k]:
                kept.append(k)
                if len(kept) == degree:
                    break
                alive &= relax * relax * between[k] > d
        return candidates[kept]

    def _walk(self, q: np.ndarray, beam: int) -> tuple[list[tuple[float, int]], list[int]]:
        """The best ``beam`` points met, nearest first, and the points whose edges were followed."""
        points, edges = self.points, self.edges
        known = np.zeros(len(points), bool)
        known[self.start] = True
        first = float(((points[self.start] - q) ** 2).sum())
        todo, best, followed = [(first, self.start)], [(-first, -self.start)], []
        while todo:
            d, p = heapq.heappop(todo)
            if len(best) == beam and d > -best[0][0]:
                break
            followed.append(p)
            near = edges[p]
            near = near[near >= 0]
            near = near[~known[near]]
            if not len(near):
                continue
            known[near] = True
            gap = points[near] - q
            for e, k in zip(np.einsum("ij,ij->i", gap, gap).tolist(), near.tolist()):
                if len(best) < beam:
                    heapq.heappush(best, (-e, -k))
                    heapq.heappush(todo, (e, k))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, -k))
                    heapq.heappush(todo, (e, k))
        return sorted((-e, -k) for e, k in best), followed

    def visited(self, q: np.ndarray, beam: int) -> np.ndarray:
        best, followed = self._walk(q, beam)
        return np.unique(np.array([k for _, k in best] + followed, np.int64))

    def nearest(self, q: np.ndarray, beam: int) -> list[int]:
        return [k for _, k in self._walk(q, beam)[0]]


def build_index(rows: DataFrame, copies: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard, staged in the shared folder: points, the ids that hold them, and edges.

    Vectors of different lengths go to different shards. Shards are drawn by the vector's hash, about
    ``shard_rows`` each, so their number grows with the table and their size doesn't.
    """
    points = staged(distinct_vectors(rows, copies), "ann-points")
    shards = max(1, -(-points.count() // shard_rows))
    at = F.pmod(F.xxhash64("v"), F.lit(shards)) * 100_000 + F.size("v")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id").reset_index(drop=True)
        vectors = np.array(part["v"].tolist(), np.float64)
        graph = Graph.build(vectors)
        return pd.DataFrame(
            {
                "shard": [part["shard"][0]], "dim": [vectors.shape[1]], "n": [len(part)], "degree": [graph.edges.shape[1]], "start": [graph.start],
                "ids": [part["ids"].tolist()], "vectors": [vectors.tobytes()], "edges": [graph.edges.tobytes()],
            }
        )

    grouped = points.select(at.alias("shard"), F.get("ids", F.lit(0)).alias("id"), "ids", "v")
    return staged(grouped.groupBy("shard").applyInPandas(build, SHARDS), "ann-shards")


def search(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest found, itself left out; score is the distance.

    Every block of queries visits every shard; each visit yields its k best only. Equal distances go to
    the smaller id, and so do copies of one vector.
    """
    block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries.count() // QUERY_BLOCK))))
    asked = queries.select(F.size("v").alias("dim"), block.alias("block"), "id", "v")
    there = index.join(asked.select("dim", "block").distinct(), "dim")
    here = asked.join(index.select("dim", "shard"), "dim")

    def visit(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in shard.itertuples(index=False):
            points = np.frombuffer(row.vectors, np.float64).reshape(row.n, row.dim)
            graph = Graph(points, np.frombuffer(row.edges, np.int32).reshape(row.n, row.degree), row.start)
            for own, v in zip(block["id"], block["v"]):
                q = np.array(v, np.float64)
                found = graph.nearest(q, max(beam, k + 1))
                hits = [(float(e), int(i)) for e, at in zip(distances(points[found], q), found) for i in row.ids[at] if i != own]
                out += [(own, i, e) for e, i in heapq.nsmallest(k, hits)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    there, here = (df.toDF(*df.columns) for df in (there, here))  # columns of their own: both hold parts of the index
    meet = there.groupBy("shard", "block").cogroup(here.groupBy("shard", "block"))
    hits = meet.applyInPandas(visit, "query_id long, vec_id long, score double")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def distances(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = points - q
    return np.sqrt((gap * gap).sum(axis=1))


def nearest_neighbours(vectors: DataFrame, asked: Column, k: int = 10, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Index all usable rows, then search for the rows where ``asked`` holds.

    Vectors that are null, empty, all zero or hold a null or non-finite number take no part, nor do rows
    with a null key. Rows that repeat a key and vector count once; a query with several vectors uses the
    smallest. An empty table gives no row.
    """
    rows = usable(vectors, key, embedding)
    index = build_index(rows, k + 1)
    queries = usable(vectors.where(asked), key, embedding).groupBy("id").agg(F.min("v").alias("v"))
    return search(index, queries, k)
