"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard.

Equal vectors form a class, of which the graph holds one node. Classes are hashed to shards of
bounded size; each shard's hierarchical graph is built in one task and stored as flat neighbour
arrays. Every query searches every shard, in blocks of queries, and the shards' results are
merged. Largest inner product becomes nearest neighbour by one more component that brings all
of a shard's vectors to the same length; returned scores are inner products of the original
vectors in double precision.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Classes in a shard, on average, and queries in a block: both bound what a task holds.
SHARD, QUERIES = 8192, 4096
#: Links a node keeps on the upper layers (twice as many on the lowest), and the breadth of the
#: search while building and while answering.
LINKS, BUILD, BREADTH = 16, 72, 128
#: Nodes that a query expands in one step, and queries that step together.
AHEAD, TOGETHER = 4, 256


@dataclass
class Graph:
    """Flat arrays. vectors: the nodes' original vectors. low: neighbours on layer 0, a row a node,
    -1 for none. high: rows of layer, node and neighbours for the layers above."""

    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    entry: int

    def __post_init__(self):
        self.near = [None] + [{} for _ in range(int(self.high[:, 0].max(initial=0)))]
        for row in self.high:
            self.near[row[0]][int(row[1])] = row[2:][row[2:] >= 0]
        self.space = self.vectors.astype(np.float32)

    def search(self, queries: np.ndarray, breadth: int = BREADTH) -> np.ndarray:
        """A row a query of the nodes found near it, -1 for none. The queries go down the upper layers one by one and search the lowest
        together: in each step every query expands its AHEAD best nodes not yet expanded."""
        n, m = len(self.vectors), len(queries)
        asked = queries.astype(np.float32)
        start = np.full(m, self.entry)
        for layer in range(len(self.near) - 1, 0, -1):
            start = np.array([_climb(self.space, q, int(at), self.near[layer].get) for q, at in zip(asked, start, strict=True)])
        node = np.full((m, breadth), -1)
        score = np.full((m, breadth), -np.inf, np.float32)
        fresh = np.zeros((m, breadth), bool)
        node[:, 0], score[:, 0], fresh[:, 0] = start, np.einsum("ij,ij->i", self.space[start], asked), True
        seen = np.zeros((m, n), bool)
        seen[np.arange(m), start] = True
        active = np.arange(m)
        while True:
            rank = np.where(fresh[active], score[active], -np.inf)
            best = np.argpartition(-rank, AHEAD - 1, axis=1)[:, :AHEAD]
            some = np.take_along_axis(rank, best, axis=1) > -np.inf
            going = some.any(axis=1)
            active, best, some = active[going], best[going], some[going]
            if not len(active):
                return node
            row, column = np.nonzero(some)
            at = active[row], best[row, column]
            fresh[at] = False
            others = self.low[node[at]]
            row, others = np.repeat(row, others.shape[1]), others.reshape(-1)
            new = (others >= 0) & ~seen[active[row], others]
            pair = np.unique(row[new] * n + others[new])
            row, others = pair // n, pair % n
            seen[active[row], others] = True
            met = np.einsum("ij,ij->i", self.space[others], asked[active[row]])
            count = np.bincount(row, minlength=len(active))
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            more = np.full((len(active), count.max(initial=0)), -1)
            value = np.full(more.shape, -np.inf, np.float32)
            more[row, place], value[row, place] = others, met
            all_score = np.concatenate([score[active], value], axis=1)
            top = np.argpartition(-all_score, breadth - 1, axis=1)[:, :breadth]
            score[active] = np.take_along_axis(all_score, top, axis=1)
            node[active] = np.take_along_axis(np.concatenate([node[active], more], axis=1), top, axis=1)
            fresh[active] = np.take_along_axis(np.concatenate([fresh[active], value > -np.inf], axis=1), top, axis=1)


def _climb(space: np.ndarray, q: np.ndarray, at: int, near) -> int:
    best = float(space[at] @ q)
    while True:
        others = near(at)
        if others is None or not len(others):
            return at
        score = space[others] @ q
        top = int(score.argmax())
        if score[top] <= best:
            return at
        best, at = float(score[top]), int(others[top])


def _beam(space: np.ndarray, q: np.ndarray, start: list[int], breadth: int, near, seen: np.ndarray) -> list[tuple[float, int]]:
    """The best nodes met by best-first search, as a list of (score, node)."""
    first = (space[start] @ q).tolist()
    seen[start] = True
    best = list(zip(first, start, strict=True))
    heapq.heapify(best)
    ahead = [(-s, node) for s, node in best]
    heapq.heapify(ahead)
    while ahead:
        score, node = heapq.heappop(ahead)
        if len(best) >= breadth and -score < best[0][0]:
            break
        others = near(node)
        others = others[~seen[others]]
        if not len(others):
            continue
        seen[others] = True
        for s, other in zip((space[others] @ q).tolist(), others.tolist(), strict=True):
            if len(best) < breadth:
                heapq.heappush(best, (s, other))
            elif s > best[0][0]:
                heapq.heapreplace(best, (s, other))
            else:
                continue
            heapq.heappush(ahead, (-s, other))
    return best


def _spread(space: np.ndarray, node: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of candidates for a node's links those that are nearer to it than to a link chosen before
    them, then the nearest of the rest."""
    order = np.argsort(-score, kind="stable")
    node, score = node[order], score[order]
    between = space[node] @ space[node].T
    open_, chosen, rest = np.ones(len(node), bool), [], []
    for k in range(len(node)):
        if len(chosen) == most:
            break
        if open_[k]:
            chosen.append(k)
            open_ &= between[k] < score
        else:
            rest.append(k)
    return node[chosen + rest[: most - len(chosen)]]


def build_graph(vectors: np.ndarray, ids: np.ndarray) -> Graph:
    """Inserts the vectors in the order given. A node's top layer is drawn from a hash of its id,
    so that a repeated task builds the same graph."""
    n = len(vectors)
    length = np.einsum("ij,ij->i", vectors, vectors)
    space = np.concatenate([vectors, np.sqrt(np.maximum(length.max() - length, 0))[:, None]], axis=1).astype(np.float32)
    draw = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) / 2.0**53
    top = np.minimum(-np.log(np.maximum(draw, 1e-12)) / math.log(LINKS), 12).astype(int)
    # twice the room on every layer, so that a full list is thinned once in many links
    low, used = np.full((n, 4 * LINKS), -1, np.int32), np.zeros(n, np.int64)
    near: list[dict[int, np.ndarray]] = [{} for _ in range(top.max() + 1)]
    entry, height = 0, top[0]
    for layer in range(1, height + 1):
        near[layer][0] = np.empty(0, np.int64)
    seen = np.zeros(n, bool)
    for x in range(1, n):
        q, at = space[x], entry
        for layer in range(height, top[x], -1):
            at = _climb(space, q, at, near[layer].get)
        start = [at]
        for layer in range(min(top[x], height), -1, -1):
            neighbours = (lambda node: low[node, : used[node]]) if layer == 0 else near[layer].__getitem__
            seen[:] = False
            found = _beam(space, q, start, BUILD, neighbours, seen)
            node, score = np.array([f[1] for f in found]), np.array([f[0] for f in found], np.float32)
            links = _spread(space, node, score, LINKS)
            start = node.tolist()
            if layer:
                near[layer][x] = links
                for y in links.tolist():
                    both = np.append(near[layer][y], x)
                    near[layer][y] = both if len(both) <= 2 * LINKS else _spread(space, both, space[both] @ space[y], LINKS)
                continue
            low[x, : len(links)], used[x] = links, len(links)
            for y in links.tolist():
                if used[y] == low.shape[1]:
                    kept = _spread(space, low[y], space[low[y]] @ space[y], 2 * LINKS)
                    low[y], used[y] = -1, len(kept)
                    low[y, : len(kept)] = kept
                low[y, used[y]] = x
                used[y] += 1
        for layer in range(height + 1, top[x] + 1):
            near[layer][x] = np.empty(0, np.int64)
        if top[x] > height:
            entry, height = x, top[x]
    rows = [[layer, node, *links, *[-1] * (2 * LINKS - len(links))] for layer in range(1, len(near)) for node, links in near[layer].items()]
    return Graph(vectors, low, np.array(rows, np.int32).reshape(-1, 2 + 2 * LINKS), entry)


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) with neither null, no null or non-finite component, not all zero, and of the
    commonest length (of equally common ones the least). Repeated rows become one."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    fine = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vector", lambda c: c != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    size = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("vector") == (size["size"] if size else 0)).distinct()


def build_index(vectors: DataFrame, k: int) -> DataFrame:
    """One row a shard: shard int, ids (members of each node's class: the k+1 least, flat with
    counts), vectors and the graph's arrays. Further members of a class could never be among the
    k nearest of any query, since equal scores go to lesser ids."""
    order = Window.partitionBy("vector").orderBy("id")
    members = vectors.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    classes = members.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("members"))
    classes = materialise(classes, "vector-classes")
    shards = max(1, math.ceil(classes.count() / SHARD))
    schema = "shard int, counts binary, members binary, vectors binary, width int, low binary, high binary, entry int"

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("first")
        data = np.stack(rows["vector"].to_numpy()).astype(np.float64)
        graph = build_graph(data, rows["first"].to_numpy())
        counts = np.array([len(m) for m in rows["members"]], np.int32)
        flat = np.concatenate(rows["members"].to_numpy()).astype(np.int64)
        return pd.DataFrame([[int(rows["shard"].iloc[0]), counts.tobytes(), flat.tobytes(), data.tobytes(), data.shape[1], graph.low.tobytes(), graph.high.tobytes(), graph.entry]], columns=[c.split(" ")[0] for c in schema.split(", ")])

    first = F.element_at("members", 1)
    dealt = classes.withColumn("first", first).withColumn("shard", F.pmod(F.xxhash64(first), F.lit(shards)).cast("int"))
    return materialise(dealt.groupBy("shard").applyInPandas(build, schema), "ann-index")


def _graph(row) -> tuple[Graph, np.ndarray, np.ndarray]:
    data = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["width"])
    graph = Graph(data, np.frombuffer(row["low"], np.int32).reshape(len(data), -1), np.frombuffer(row["high"], np.int32).reshape(-1, 2 + 2 * LINKS), int(row["entry"]))
    counts = np.frombuffer(row["counts"], np.int32)
    return graph, np.concatenate([[0], np.cumsum(counts)]), np.frombuffer(row["members"], np.int64)


def _best(graph: Graph, starts: np.ndarray, members: np.ndarray, query_id: int, vector: np.ndarray, nodes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best members of the nodes' classes but the query's own id."""
    score = graph.vectors[nodes] @ vector
    kept = score >= -np.partition(-score, min(k, len(score) - 1))[min(k, len(score) - 1)]  # k + 1: one may be the query
    nodes, score = nodes[kept], score[kept]
    ids = np.concatenate([members[starts[c] : starts[c + 1]] for c in nodes])
    score = np.repeat(score, starts[nodes + 1] - starts[nodes])
    ids, score = ids[ids != query_id], score[ids != query_id]
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


def search_index(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (query_id, vector) but the
    row with its own id. Queries of one id with different vectors are answered each."""
    last = index.agg(F.max("shard")).first()[0]
    blocks = max(1, math.ceil(queries.count() / QUERIES))
    shards = F.sequence(F.lit(0), F.lit(last)) if last is not None else F.array().cast("array<int>")
    asked = queries.withColumns({"query_key": F.xxhash64("vector"), "block": F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"), "shard": F.explode(shards)})
    offered = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            graph, starts, members = _graph(right.iloc[0])
            for begin in range(0, len(left), TOGETHER):
                now = left.iloc[begin : begin + TOGETHER]
                asked = np.stack(now["vector"].to_numpy()).astype(np.float64)
                for query_id, key, vector, nodes in zip(now["query_id"].to_numpy(), now["query_key"].to_numpy(), asked, graph.search(asked), strict=True):
                    out.append((query_id, key, *_best(graph, starts, members, query_id, vector, nodes[nodes >= 0], k)))
        return pd.DataFrame(out, columns=["query_id", "query_key", "ids", "scores"])

    found = asked.groupBy("shard", "block").cogroup(offered.groupBy("shard", "block")).applyInPandas(search, "query_id long, query_key long, ids array<long>, scores array<double>")
    pairs = found.select("query_id", "query_key", F.explode(F.arrays_zip("ids", "scores")).alias("p")).select("query_id", "query_key", F.col("p.ids").alias("vec_id"), F.col("p.scores").alias("score"))
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest by inner product of every row whose id is divisible by `every`: query_id long,
    rank int, vec_id long, score double; nearest first, equal scores by lesser id.

    Rows with a null id, and vectors that are null, zero, of another length than most, or with
    null or non-finite components take no part. Rows repeated with the same id and vector count
    once; rows of one id with different vectors are candidates and queries each, under that id.
    Fewer candidates than k are all returned; an empty table gives an empty result; other columns
    are ignored, whatever their names.
    """
    vectors = materialise(valid_vectors(table, id_col, vector_col), "vectors")
    queries = vectors.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vector")
    return search_index(build_index(vectors, k), queries, k)
