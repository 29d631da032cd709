"""Exact top-k inner products with an impact-ordered index, score at a time.

Candidates are dealt over blocks of bounded size by the hash of their ids. A task takes a block, builds its index once, and
then streams all queries through it. A block's index has a posting segment for each dimension and quantised value: the candidates whose
component lies in that range. A query processes segments by descending impact (the most that a segment can add to a score)
and adds impacts to accumulators. Whatever a candidate has not met yet adds at most the next impact for each missing
dimension, so accumulator + missing * next is an upper bound of its score. The exact scores of the k best accumulators give
a threshold; processing stops only when few candidates reach it by their upper bounds, and exactly these are rescored.

Defined results: vectors that are null or empty, or hold null or non-finite components, take no part, nor do rows with null ids;
vectors of different dimensions do not score each other; rows with the query's own id are not its candidates; ties go
to the smaller id; repeated rows count once, and rows of one id with different vectors count as one whose score is the best of
theirs; vectors with a component beyond ``WIDE`` are scored by arithmetic of any width, and a score beyond 64 bits becomes the
largest or smallest long; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHIFT = 6
BLOCK_ROWS = 4096
LEAST_BLOCKS = 16
#: Scaled components up to which doubles and 64 bits hold the sums of up to 2**13 dimensions exactly.
WIDE = 1 << 20
#: Parts of all postings after which the bounds are looked at.
LOOKS = (0.3, 0.45, 0.6, 0.8, 1.0)
#: Rescoring begins when at most this part of a block may still be among the best.
FEW = 1 / 32
SCHEMA = "query_id long, vec_id long, score long"


class BlockIndex:
    """Impact segments of one block of integer vectors."""

    def __init__(self, values: np.ndarray):
        self.values = values
        rows, dims = values.shape
        level = values >> SHIFT
        order = np.argsort(level, axis=0, kind="stable").T
        ranked = np.take_along_axis(level.T, order, 1)
        opens = np.ones(ranked.shape, bool)
        opens[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
        self.postings = order.ravel()
        self.start = np.flatnonzero(opens.ravel())
        self.size = np.diff(np.append(self.start, rows * dims))
        self.dim = self.start // max(rows, 1)
        self.low = ranked.ravel()[self.start] << SHIFT
        self.high = self.low + (1 << SHIFT) - 1

    def best(self, query: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of every candidate that may be among the k best; ``skip``: rows that are none."""
        rows, dims = self.values.shape
        q = query[self.dim]
        impact = np.maximum(q * self.low, q * self.high)
        order = np.argsort(-impact, kind="stable")
        behind = np.cumsum(self.size[order])
        upper, met = np.zeros(rows), np.zeros(rows)
        done, total = 0, rows * dims
        for look in LOOKS:
            stop = int(np.searchsorted(behind, look * total, "left")) + 1 if look < 1 else len(order)
            stop = min(max(stop, done), len(order))
            part = order[done:stop]
            at = np.arange(int(self.size[part].sum())) + np.repeat(self.start[part] - np.cumsum(self.size[part]) + self.size[part], self.size[part])
            docs = self.postings[at]
            upper += np.bincount(docs, np.repeat(impact[part], self.size[part]), rows)
            met += np.bincount(docs, minlength=rows)
            done = stop
            bound = upper + (dims - met) * (impact[order[done]] if done < len(order) else 0)
            bound[skip] = -np.inf
            live = rows - len(skip)
            if live <= k:
                break
            top = np.argpartition(-bound, k - 1)[:k]
            threshold = (self.values[top] @ query).min()
            if (bound >= threshold).sum() <= max(4 * k, FEW * rows):
                may = np.flatnonzero(bound >= threshold)
                return may, self.values[may] @ query
        may = np.setdiff1d(np.arange(rows), skip) if rows - len(skip) <= k else np.flatnonzero(bound >= threshold)
        return may, self.values[may] @ query


def floors(column: pa.Array, scale: float) -> list[np.ndarray]:
    """floor(scale * x) of each vector; as Python's integers where 64 bits might not hold a product's sum."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * flat)
    cuts = np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))])
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if np.abs(scaled[a:b]).max() <= WIDE:
            out.append(scaled[a:b].astype(np.int64))
        else:
            out.append(np.array([math.floor(int(scale) * int(x)) if abs(x) > 1 << 53 else math.floor(scale * x) for x in flat[a:b].tolist()], object))
    return out


class Block:
    """The candidates of one block and one number of dimensions: an index of those whose sums 64 bits hold, and the others."""

    def __init__(self, ids: list[int], vectors: list[np.ndarray]):
        once = {(i, v.tobytes() if v.dtype != object else tuple(v)): v for i, v in zip(ids, vectors, strict=True)}
        narrow = [(i, v) for (i, _), v in once.items() if v.dtype != object]
        self.wide = [(i, v) for (i, _), v in once.items() if v.dtype == object]
        self.ids = np.array([i for i, _ in narrow], np.int64)
        self.index = BlockIndex(np.stack([v for _, v in narrow])) if narrow else None
        #: Rows whose id another row has too; so many more rows are asked for.
        self.again = len(once) - len({i for i, _ in once})

    def best(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) of different ids."""
        found: dict[int, int] = {}

        def add(i: int, score: int) -> None:
            found[i] = max(score, found.get(i, score))

        if self.index is not None and query.dtype != object:
            may, scores = self.index.best(query, k + self.again, np.flatnonzero(self.ids == query_id))
            order = np.lexsort((self.ids[may], -scores))[: k + self.again]
            for i, score in zip(self.ids[may][order].tolist(), scores[order].tolist(), strict=True):
                add(i, score)
        elif self.index is not None:
            for i, score in zip(self.ids.tolist(), (self.index.values.astype(object) @ query).tolist(), strict=True):
                add(i, score)
        for i, v in self.wide:
            add(i, int(v @ query))
        found.pop(query_id, None)
        limit = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
        return sorted(((limit(s), i) for i, s in found.items()), key=lambda x: (-x[0], x[1]))[:k]


def top_k(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` holds, against all rows; scores are integers."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine)
    values = F.transform(vector_col, lambda x: x.cast("double"))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), values.alias("v"), is_query.alias("asks")).where(F.size("v") > 0)
    blocks = max(LEAST_BLOCKS, -(-rows.count() // BLOCK_ROWS))
    held = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    asked = rows.where("asks").select(every.alias("block"), "asks", "vec_id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, asking, found = None, None, {}
        held: dict[int, tuple[list, list]] = {}
        built: dict[int, Block] = {}

        def answers() -> list[tuple[int, int, int]]:
            best = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]
            return [(asking, i, score) for i, score in best]

        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for block, asks, i, v in zip(*(batch.column(c).to_pylist() for c in range(3)), floors(batch.column(3), float(scale)), strict=True):
                if asking is not None and (not asks or i != asking):
                    out += answers()
                    asking, found = None, {}
                if block != place:
                    place, held, built = block, {}, {}
                if not asks:
                    ids, vectors = held.setdefault(len(v), ([], []))
                    ids.append(i)
                    vectors.append(v)
                    continue
                asking = i
                if len(v) not in held:
                    continue
                if len(v) not in built:
                    built[len(v)] = Block(*held[len(v)])
                for score, j in built[len(v)].best(i, v, k):
                    found[j] = max(score, found.get(j, score))
            yield _answered(out)
        if asking is not None:
            yield _answered(answers())

    # Within a task the candidates of a block come before its queries, and rows of one query follow each other.
    dealt = held.unionByName(asked).repartition("block").sortWithinPartitions("block", "asks", "vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return dealt.mapInArrow(search, SCHEMA).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answered(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])
