"""Hard negatives by threshold joins over inverted indexes with suffix-norm bounds.

Rows are hashed into blocks of bounded size, anchors into groups; each group meets each block in
one task. A block's index holds a row's components of the dimensions with most weight first, and
omits the suffix whose norm is too short to reach any anchor's threshold. Partial scores are
accumulated by dimensions and pruned by the norms that remain; survivors get their exact score.
Anchors whose windows aren't full yet go again with a lower threshold, down to the score that
ends their windows, so that no row of a window is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

#: Rows of a block and anchors of a group, on average: both bound what a task holds.
BLOCK, GROUP = 8192, 512
#: Anchors whose scores with a block are held at once, dimensions between two prunings, and the
#: share of pairs below which the rest is scored pair by pair.
TOGETHER, SLAB, FEW = 64, 8, 0.05
#: Thresholds of positives as parts of the largest score that norms allow; then any score does.
LOWERED = (0.7, 0.5, 0.35, 0.2)
#: Thresholds of negatives between the top (0) and the end (1) of an anchor's windows.
STEPS = (0.1, 0.3, 0.6, 1.0)


@dataclass
class Index:
    """An inverted index of rows: component lists by dimension, of the rows whose cut lies behind it."""

    vectors: np.ndarray  # whole rows of integers, by falling cut
    row: np.ndarray  # their places in what was indexed
    axes: np.ndarray  # dimensions, most weight first
    cut: np.ndarray  # how many of a row's dimensions are indexed
    lists: list[np.ndarray]  # a slab of dimensions each: columns of the rows that have a part in it
    suffix: np.ndarray  # norm of each row's dimensions from each on

    @staticmethod
    def build(vectors: np.ndarray, least: float) -> Index:
        """least: the smallest threshold divided by the norm of its query. What is shorter than
        that can't reach a threshold by itself, so that a row's last dimensions up to such a norm
        aren't indexed; a row that is shorter as a whole has no list at all."""
        real = vectors.astype(np.float64)
        axes = np.argsort(-(real * real).sum(axis=0), kind="stable")
        real = real[:, axes]
        suffix = np.sqrt(np.concatenate([np.cumsum((real * real)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(real), 1))], axis=1))
        cut = (suffix * (1 + 1e-9) >= least).sum(axis=1) if least > 0 else np.full(len(real), len(axes))
        order = np.argsort(-cut, kind="stable")
        real, cut = real[order], cut[order]
        real[np.arange(len(axes)) >= cut[:, None]] = 0
        lists = [np.ascontiguousarray(real[: np.searchsorted(-cut, -d), d : d + SLAB].T) for d in range(0, len(axes), SLAB)]
        return Index(vectors[order], order, axes, cut, lists, suffix[order])

    def reach(self, queries: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and exact score of all pairs whose score is at least the query's threshold."""
        real = queries.astype(np.float64)[:, self.axes]
        rest = np.sqrt(np.concatenate([np.cumsum((real * real)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(real), 1))], axis=1))
        slack = 1e-9 * rest[:, :1] * self.suffix[:, 0] + 1e-6
        partial = np.zeros((len(queries), len(self.vectors)))
        done, alive = np.zeros(len(self.vectors), np.int64), None
        for k, part in enumerate(self.lists):
            if part.shape[1]:
                partial[:, : part.shape[1]] += real[:, k * SLAB : k * SLAB + len(part)] @ part
            done = np.minimum(self.cut, k * SLAB + len(part))
            bound = rest[:, done] * self.suffix[np.arange(len(done)), done] + slack
            alive = partial + bound >= threshold[:, None]
            if alive.mean() < FEW:
                break
        q, row = np.nonzero(alive) if alive is not None else (np.repeat(np.arange(len(queries)), len(self.vectors)), np.tile(np.arange(len(self.vectors)), len(queries)))
        score = np.empty(len(q), np.int64)
        for at in range(0, len(q), 1 << 16):
            part = slice(at, at + (1 << 16))
            score[part] = np.einsum("ij,ij->i", queries[q[part]], self.vectors[row[part]])
        kept = score >= threshold[q]
        return q[kept], self.row[row[kept]], score[kept]


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))


def best_of_label(ids: np.ndarray, vectors: np.ndarray, anchor_ids: np.ndarray, anchors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each anchor ids and scores of the k rows with another id whose score is largest, ties by
    smaller id; all if there are fewer."""
    out: list = [None] * len(anchors)
    norm, longest = _norms(anchors), _norms(vectors).max(initial=0)
    for part in LOWERED + (-math.inf,):
        left = np.flatnonzero([x is None for x in out])
        if not len(left):
            break
        index = Index.build(vectors, max(part, 0) * longest)
        for at in range(0, len(left), TOGETHER):
            some = left[at : at + TOGETHER]
            threshold = part * longest * norm[some] if part > 0 else np.full(len(some), -math.inf)
            q, row, score = index.reach(anchors[some], threshold)
            other = ids[row] != anchor_ids[some][q]
            q, row, score = q[other], row[other], score[other]
            order = np.lexsort((ids[row], -score, q))
            ends = np.searchsorted(q[order], np.arange(len(some) + 1))
            for j, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if b - a >= k or part < 0:
                    best = order[a : min(b, a + k)]
                    out[some[j]] = ids[row[best]], score[best]
    return out


def fill_windows(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, anchor_labels: np.ndarray, anchors: np.ndarray, window: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window (of the anchor `window`, scores low to high) its number, and ids and scores
    of the k rows of another label in it whose score is largest, ties by smaller id."""
    by_anchor = np.argsort(window, kind="stable")
    first = np.searchsorted(window[by_anchor], np.arange(len(anchors) + 1))
    most, least = np.full(len(anchors), np.inf), np.full(len(anchors), np.inf)
    np.minimum.at(most, window, high)
    np.minimum.at(least, window, low)
    left, norm = np.flatnonzero(np.diff(first)), _norms(anchors)
    for step in STEPS:
        if not len(left):
            break
        threshold = most + step * (np.minimum(least, most) - most)
        scaled = threshold[left] / np.maximum(norm[left], 1e-300)
        index, again = Index.build(vectors, float(scaled.min())), []
        for at in range(0, len(left), TOGETHER):
            some = left[at : at + TOGETHER]
            q, row, score = index.reach(anchors[some], threshold[some])
            other = labels[row] != anchor_labels[some][q]
            q, row, score = q[other], row[other], score[other]
            order = np.lexsort((ids[row], -score, q))
            ends = np.searchsorted(q[order], np.arange(len(some) + 1))
            for j, anchor in enumerate(some):
                mine = order[ends[j] : ends[j + 1]]
                falling, full, found = -score[mine], True, []
                for w in by_anchor[first[anchor] : first[anchor + 1]]:
                    a, b = np.searchsorted(falling, -high[w]), np.searchsorted(falling, -low[w], side="right")
                    full &= b - a >= k or threshold[anchor] <= low[w]
                    found.append((int(w), mine[a : min(b, a + k)]))
                if full:
                    yield from ((w, ids[row[best]], score[best]) for w, best in found if len(best))
                else:
                    again.append(anchor)
        left = np.array(again, np.int64)


# --- Spark -------------------------------------------------------------------------------------


def integer_rows(rows: DataFrame, label: Column, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, label, vector of integers floor(scale * component), of the rows that take part: those
    with a null id, label, vector or component, or a component that isn't finite, don't. Of rows
    that share an id the first by label and vector takes part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    vector = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & label.isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False)))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.where(usable).select(F.col(id_col).cast("long").alias("id"), F.struct(label.cast("long").alias("label"), whole.alias("vector")).alias("row")).groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.vector")


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """One row for each value of key: ids, labels and vectors as arrays of eight-byte integers;
    vectors are filled with zeros up to the longest."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        ids, labels = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
        listed = table.column("vector").chunk(0)
        length = np.diff(listed.offsets.to_numpy())
        vectors = np.zeros((len(ids), int(length.max(initial=0))), np.int64)
        vectors[np.arange(vectors.shape[1]) < length[:, None]] = listed.flatten().to_numpy()
        return pa.table({key: table.column(key).slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary()), "labels": pa.array([labels.tobytes()], pa.binary()), "vectors": pa.array([vectors.tobytes()], pa.binary())})

    return rows.select(key, "id", "label", "vector").groupBy(key).applyInArrow(run, f"{key} long, ids binary, labels binary, vectors binary")


def _unpacked(ids: bytes, labels: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(labels, np.int64), np.frombuffer(vectors, np.int64).reshape(len(ids), -1)


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def _meet(groups: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Every group of anchors with every block of rows: a stated set of queries against all rows."""
    sent = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    sent = sent.select("block", *(F.col(c).alias(f"a_{c}") for c in groups.columns))
    return sent.repartition(2 * n_blocks, "block").join(blocks.repartition(2 * n_blocks, "block").hint("merge"), "block")


def mine_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: id, label and vector of integers (as of integer_rows); anchors: a predicate over them. A
    score is the integer inner product with the anchor. An anchor's positives are the first
    `positives` other rows of its label, by falling score and rising id; for each of them the
    first `negatives` rows of other labels with low * p <= 100 * n <= high * p are returned, p and n
    being the positive's and the negative's score. Where there are fewer, all are. An anchor
    without positives, or a window without rows, has no row; a window of a negative p is empty.

    Nulls are left to integer_rows; equal vectors tie by id; shorter vectors count as filled with
    zeros; other columns are ignored; an empty table gives an empty result. Scores are 64-bit
    integers, which holds while components are below 2**28 and there are 64 of them.
    """
    spark = rows.sparkSession
    rows = materialise(rows.select("id", "label", "vector").withColumn("anchor", F.coalesce(anchors, F.lit(False))), "integer_rows")
    counts = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).first()
    n_blocks, n_groups = max(1, math.ceil(counts.n / BLOCK)), max(1, math.ceil(counts.anchors / GROUP))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    with small_batches(spark):
        blocks = materialise(_packed(rows.withColumn("block", place("id", n_blocks)), "block"), "vector_blocks")
        groups = materialise(_packed(rows.where("anchor").withColumn("group", place("id", n_groups)), "group"), "anchor_groups")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, vectors = _unpacked(row["ids"], row["labels"], row["vectors"])
                anchor_ids, anchor_labels, anchor_vectors = _unpacked(row["a_ids"], row["a_labels"], row["a_vectors"])
                vectors, anchor_vectors = _same_width(vectors, anchor_vectors)
                for label in np.unique(anchor_labels):
                    of, asked = np.flatnonzero(labels == label), np.flatnonzero(anchor_labels == label)
                    if not len(of):
                        continue
                    found = best_of_label(ids[of], vectors[of], anchor_ids[asked], anchor_vectors[asked], positives)
                    size = [len(x) for x, _ in found]
                    if sum(size):
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(anchor_ids[asked], size)), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([s for _, s in found]))], names=["anchor_id", "positive_id", "positive_score"])

    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), F.asc("positive_id"))
    met = _meet(groups, blocks, n_blocks).select("a_ids", "a_labels", "a_vectors", "ids", "labels", "vectors").mapInArrow(nearest, "anchor_id long, positive_id long, positive_score long")
    best = materialise(met, "block_positives")
    chosen = materialise(best.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives).drop("place"), "positives")

    # the same groups again, each with the windows of its anchors
    bounds = chosen.select(place("anchor_id", n_groups).alias("group"), F.struct("anchor_id", "positive_id", "positive_score").alias("w"))
    windows = bounds.groupBy("group").agg(F.sort_array(F.collect_list("w")).alias("windows"))  # positives times the group's anchors
    asked = groups.join(windows, "group")

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = {c: batch.column(c)[k] for c in batch.schema.names}
                ids, labels, vectors = _unpacked(*(part[c].as_py() for c in ("ids", "labels", "vectors")))
                anchor_ids, anchor_labels, anchor_vectors = _unpacked(*(part[c].as_py() for c in ("a_ids", "a_labels", "a_vectors")))
                vectors, anchor_vectors = _same_width(vectors, anchor_vectors)
                wanted = part["a_windows"].values
                anchor, positive, score = (wanted.field(c).to_numpy() for c in ("anchor_id", "positive_id", "positive_score"))
                # integer bounds: low * p <= 100 * n <= high * p
                least, most = -(-low * score // 100), high * score // 100
                open_ = np.flatnonzero(least <= most)
                number = np.searchsorted(anchor_ids, anchor[open_])
                filled = list(fill_windows(ids, labels, vectors, anchor_labels, anchor_vectors, number, least[open_], most[open_], negatives))
                if filled:
                    of, size = open_[[w for w, _, _ in filled]], [len(x) for _, x, _ in filled]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c[of], size)) for c in (anchor, positive, score)] + [pa.array(np.concatenate([x[j] for x in filled])) for j in (1, 2)], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    met = _meet(asked, blocks, n_blocks).select("a_ids", "a_labels", "a_vectors", "a_windows", "ids", "labels", "vectors").mapInArrow(between, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), F.asc("negative_id"))
    return materialise(met, "block_negatives").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
