"""Approximate nearest neighbours (operator 5): one hierarchical navigable small-world graph per shard.

Vectors are dealt to shards of about ``shard_rows`` rows by a hash of their id.  Within a shard equal vectors
are one node that holds all their ids, so a vector that a third of all rows share is one node in each shard.
Nodes get geometric levels from a hash; each level links a node to its nearest nodes of that level, chosen so
that links point in different directions, and back.  Links are flat arrays (CSR), one row a shard in a table
in the shared folder.

Queries are packed in blocks; each block meets each shard once (a stated query set against all rows): a shard's
graph goes to a task, BLOCKS_A_TASK blocks follow it there, and further blocks of the shard are a task of their own
with another copy.  A search walks greedily down the levels and then widens to ``ef`` candidates on
the lowest; found nodes are scored again in double precision on the original vectors.  Shard results are
merged by a window over at most k rows a shard.

Defined results: vectors that are null, empty, zero, of another length than the most frequent one, or that
hold null or non-finite components take no part, neither as queries nor as candidates; a query without
candidates gives no rows; ties go to the smaller vec_id; rows that share a vec_id are candidates each, but
never for a query of the same id; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GOLDEN, mixed, stored

SHARD_ROWS = 16_384
QUERY_BLOCK, BLOCKS_A_TASK = 256, 8
LINKS, EF, FAN = 16, 64, 16


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def nearest_lists(unit: np.ndarray, k: int) -> np.ndarray:
    """For each row the k nearest other rows by cosine, nearest first, in blocks of bounded size."""
    n = len(unit)
    k = min(k, n - 1)
    out = np.empty((n, k), np.int32)
    for a in range(0, n, 1024):
        s = unit[a : a + 1024] @ unit.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        part = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < n - 1 else np.tile(np.arange(n), (len(s), 1))
        order = np.argsort(-np.take_along_axis(s, part, 1), axis=1, kind="stable")[:, :k]
        out[a : a + 1024] = np.take_along_axis(part, order, 1)
    return out


def diverse(unit: np.ndarray, near: np.ndarray, links: int) -> np.ndarray:
    """Of each row's list those that are nearer to the row than to any link chosen before; -1 where none is left."""
    n, k = near.shape
    out = np.full((n, links), -1, np.int32)
    for a in range(0, n, 512):
        rows = near[a : a + 512]
        v = unit[rows]
        to_row = np.einsum("nkd,nd->nk", v, unit[a : a + 512])
        between = np.einsum("nid,njd->nij", v, v)
        chosen = np.zeros(rows.shape, bool)
        covered = np.zeros(rows.shape, bool)
        for j in range(k):
            take = ~covered[:, j] & (chosen.sum(1) < links)
            chosen[:, j] = take
            covered |= take[:, None] & (between[:, j, :] > to_row)
        # What is left of the links goes to the nearest of the others.
        rank = np.where(chosen, 0, 1) * k + np.arange(k)
        order = np.argsort(rank, axis=1, kind="stable")[:, :links]
        out[a : a + 512, : order.shape[1]] = np.take_along_axis(rows, order, 1)
    return out


def graph_level(unit: np.ndarray, links: int) -> tuple[np.ndarray, np.ndarray]:
    """CSR offsets and neighbours of one level, links in both directions."""
    n = len(unit)
    if n < 2:
        return np.zeros(n + 1, np.int32), np.zeros(0, np.int32)
    forward = diverse(unit, nearest_lists(unit, 2 * links), links)
    src = np.repeat(np.arange(n, dtype=np.int64), forward.shape[1])
    dst = forward.reshape(-1).astype(np.int64)
    src, dst = src[dst >= 0], dst[dst >= 0]
    code = np.unique(np.concatenate((src * n + dst, dst * n + src)))
    return np.concatenate(([0], np.cumsum(np.bincount(code // n, minlength=n)))).astype(np.int32), (code % n).astype(np.int32)


def build(ids: np.ndarray, vectors: np.ndarray, links: int = LINKS, fan: int = FAN) -> dict:
    """The index of one shard as flat arrays."""
    order = np.argsort(ids, kind="stable")
    distinct, of = np.unique(vectors[order], axis=0, return_inverse=True)
    of = of.reshape(-1)
    by_node = np.argsort(of, kind="stable")
    unit = distinct.astype(np.float32)
    unit /= np.linalg.norm(distinct.astype(np.float64), axis=1, keepdims=True).astype(np.float32)
    n = len(distinct)
    hashed = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(GOLDEN)).astype(np.float64) / 2.0**64
    level = np.floor(-np.log(np.maximum(hashed, 1e-18)) / np.log(fan)).astype(np.int64)
    level[0] = max(level.max(), 1) if n else 0
    members, offsets, neighbours = [], [], []
    for at in range(int(level.max()) + 1):
        own = np.flatnonzero(level >= at)
        o, nb = graph_level(unit[own], links * 2 if at == 0 else links)
        members.append(own.astype(np.int32))
        offsets.append(o)
        neighbours.append(nb)
    return {
        "dim": vectors.shape[1],
        "ids": ids[order][by_node],
        "node_ends": np.cumsum(np.bincount(of, minlength=n)).astype(np.int64),
        "vectors": distinct.astype(np.float64),
        "level_nodes": np.array([len(m) for m in members], np.int32),
        "level_links": np.array([len(x) for x in neighbours], np.int32),
        "members": np.concatenate(members),
        "offsets": np.concatenate(offsets),
        "neighbours": np.concatenate(neighbours),
    }


ARRAYS = {"ids": np.int64, "node_ends": np.int64, "vectors": np.float64, "level_nodes": np.int32, "level_links": np.int32, "members": np.int32, "offsets": np.int32, "neighbours": np.int32}
INDEX = "shard int, dim int, " + ", ".join(f"{k} binary" for k in ARRAYS)


class Searcher:
    def __init__(self, row: dict):
        a = {k: np.frombuffer(row[k], kind) for k, kind in ARRAYS.items()}
        self.ids, self.ends = a["ids"], a["node_ends"]
        self.vectors = a["vectors"].reshape(-1, int(row["dim"]))
        self.norms = np.linalg.norm(self.vectors, axis=1)
        self.unit = (self.vectors / self.norms[:, None]).astype(np.float32)
        self.levels = []
        m = o = k = 0
        for nodes, links in zip(a["level_nodes"].tolist(), a["level_links"].tolist(), strict=True):
            self.levels.append((a["members"][m : m + nodes], a["offsets"][o : o + nodes + 1], a["neighbours"][k : k + links]))
            m, o, k = m + nodes, o + nodes + 1, k + links

    def down(self, q: np.ndarray) -> int:
        """Greedy walk through the upper levels; the node from which the lowest level is searched."""
        node = 0
        for members, offsets, neighbours in self.levels[:0:-1]:
            at = int(np.searchsorted(members, node))
            best = float(self.unit[node] @ q)
            while True:
                around = neighbours[offsets[at] : offsets[at + 1]]
                if not len(around):
                    break
                s = self.unit[members[around]] @ q
                k = int(s.argmax())
                if s[k] <= best:
                    break
                best, at = float(s[k]), int(around[k])
            node = int(members[at])
        return node

    def wide(self, q: np.ndarray, start: int, ef: int) -> list[int]:
        """The ``ef`` best nodes that a best-first walk on the lowest level finds."""
        _, offsets, neighbours = self.levels[0]
        seen = np.zeros(len(self.unit), bool)
        seen[start] = True
        s = float(self.unit[start] @ q)
        todo, best = [(-s, start)], [(s, start)]
        while todo:
            s, node = heapq.heappop(todo)
            if -s < best[0][0] and len(best) >= ef:
                break
            around = neighbours[offsets[node] : offsets[node + 1]]
            around = around[~seen[around]]
            if not len(around):
                continue
            seen[around] = True
            scores = self.unit[around] @ q
            if len(best) >= ef:
                keep = scores > best[0][0]
                around, scores = around[keep], scores[keep]
            for x, n in zip(scores.tolist(), around.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (x, n))
                elif x > best[0][0]:
                    heapq.heapreplace(best, (x, n))
                else:
                    continue
                heapq.heappush(todo, (-x, n))
        return [n for _, n in best]

    def nearest(self, query_id: int, vector: np.ndarray, k: int, ef: int) -> list[tuple[int, float]]:
        """(vec_id, cosine in double precision) of the k nearest found, without the query's own id."""
        norm = float(np.linalg.norm(vector))
        q = (vector / norm).astype(np.float32)
        nodes = np.array(self.wide(q, self.down(q), ef))
        scores = np.array([float(np.dot(self.vectors[n], vector)) / (float(self.norms[n]) * norm) for n in nodes.tolist()])
        out: list[tuple[float, int]] = []
        for at in np.argsort(-scores, kind="stable").tolist():
            if len(out) >= k and scores[at] < -out[-1][0]:
                break
            node = int(nodes[at])
            own = self.ids[self.ends[node - 1] if node else 0 : self.ends[node]]  # ascending
            own = own[: k + 1 + int((own[: k + 1] == query_id).sum())]
            out += [(-float(scores[at]), int(i)) for i in own.tolist() if i != query_id]
            out = sorted(out)[:k]
        return [(i, -s) for s, i in out]


def build_index(embeddings: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The table of shard graphs, in the shared folder, and the number of shards."""
    rows = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    total = rows.count()
    shards = max(1, -(-total // shard_rows))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("vec_id"))
        vectors = np.array(table.column("embedding").to_pylist(), np.float64)
        index = build(ids, vectors)
        return pa.table([[key[0].as_py()], [index["dim"]], *([index[k].astype(kind).tobytes()] for k, kind in ARRAYS.items())], pa.schema([pa.field("shard", pa.int32()), pa.field("dim", pa.int32()), *(pa.field(k, pa.binary()) for k in ARRAYS)]))

    dim = F.size("embedding")
    most = rows.groupBy(dim.alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    length = most["d"] if most else 0
    dealt = rows.where(dim == length).select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return stored(dealt.groupBy("shard").applyInArrow(run, INDEX)), shards


def search(embeddings: DataFrame, is_query: Column, k: int = 5, ef: int = EF, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which ``is_query`` holds."""
    index, shards = build_index(embeddings, shard_rows)
    dims = index.agg(F.max("dim")).first()[0] or 0
    queries = embeddings.where(is_query & F.col("vec_id").isNotNull() & usable(F.col("embedding")) & (F.size("embedding") == dims))
    queries = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    blocks = max(1, -(-queries.count() // query_block))
    # Block by a hash of the id: blocks of about query_block rows.
    packed = queries.groupBy(F.pmod(F.xxhash64(F.lit("q"), "query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "q")).alias("queries"))
    slices = max(1, -(-blocks // BLOCKS_A_TASK))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    graphs = index.withColumn("slice", numbers(slices)).withColumn("block", F.lit(-1).cast("long"))
    asked = packed.withColumn("shard", numbers(shards)).withColumn("slice", F.pmod("block", F.lit(slices)).cast("int"))
    met = graphs.unionByName(asked, allowMissingColumns=True).repartition(shards * slices, "shard", "slice").sortWithinPartitions("shard", "slice", "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a shard and slice stand together, its graph first."""
        graph: Searcher | None = None
        for pdf in batches:
            for row in pdf.to_dict("records"):
                if row["block"] < 0:
                    graph = Searcher(row)
                    continue
                found = [(x["query_id"], i, s) for x in row["queries"] for i, s in graph.nearest(x["query_id"], np.asarray(x["q"], np.float64), k, ef)]
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    hits = met.mapInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
