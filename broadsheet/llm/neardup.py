"""Near-duplicate embeddings by product quantisation: inverted lists, residual codes, table lookups, exact rerank.

Equal vectors are one class, and its smallest id stands for it. Vectors are scaled to length 1, so that a cosine of at
least ``least`` is a distance of at most ``reach = sqrt(2 - 2 * least)``. Coarse centroids divide the vectors into inverted lists; a
vector's residual is coded by the nearest of 256 codes in each subspace, and the error of that is kept.

Nothing that links can be lost:
* A query probes a list unless the bisector between the list's centroid and another centroid proves that the
  list's cell is farther than ``reach`` from it.
* Of two vectors, the inner product of the parts on the sample's ``SCREEN`` main axes plus the product of the lengths of what is left
  is at least their cosine (Cauchy and Schwarz); pairs whose sum stays below ``least`` are not looked up. One matrix product does that.
* The distance from a query to a coded vector comes from lookup tables (query against codes, uncompressed); a pair goes on
  unless that distance less the vector's coding error is above ``reach``.
* What goes on is decided by the exact cosine in double precision.

Centroids and codes are fitted on ``SAMPLE`` vectors at most (those with the smallest hashed ids); every vector is indexed. Lists are
dealt over groups of about ``GROUP_ROWS`` vectors: small lists share one, a larger list is divided by the hash of the ids. A query
goes once to each group that holds a part of a list that it probes, and only to the half of the lists that follow its own in a
circle, as a pair is found from one side and all groups get the same share. Vectors travel packed, many to a row; a group is
indexed once, and its queries stream through it.

Lengths of vectors fall into classes by powers of two, at most 31; within a class the shorter ones are filled up with zeros, which changes
no cosine, and only pairs of equal lengths count.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are
kept, as are rows with null ids; vectors of different lengths do not link; rows with equal ids are rows each; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm import common, wordhash
from broadsheet.llm.components import components

#: Vectors that centroids and codes are fitted on, at most.
SAMPLE = 16_384
MOST_LISTS = 4096
SUBSPACES = 8
CODES = 256
GROUP_ROWS = 32_768
#: Bytes of a group's vectors, at most.
GROUP_BYTES = 64 << 20
LEAST_GROUPS = 12
ROUNDS = 8
#: Main axes that pairs are screened on; queries and vectors of a block; vectors dealt at once; pairs looked up at once; links kept until they are united.
SCREEN = 16
TILE, BLOCK = 512, 1024
CHUNK = 2048
PAIRS = 65_536
MOST_KEPT = 1 << 20
EPS = 1e-6
#: More than single precision can err in a screened sum.
SLACK = 1e-5


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norms = (centres**2).sum(1)
    return np.concatenate([np.argmin(norms - 2 * (x[i : i + 4096] @ centres.T), 1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres; empty ones are drawn anew from the points."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        at = _nearest(x, centres)
        order = np.argsort(at, kind="stable")
        counts = np.bincount(at, minlength=len(centres))
        has = np.flatnonzero(counts)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(counts[has])[:-1]]))
        centres[has] = sums / counts[has][:, None]
        lost = np.flatnonzero(counts == 0)
        centres[lost] = x[rng.integers(0, len(x), len(lost))]
    return centres


class Quantiser:
    """Centroids of the lists and codes of the subspaces, fitted on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, least: float):
        self.least = least
        self.reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + EPS
        self.axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, :SCREEN]
        centres = kmeans(sample, min(lists, len(sample)), 1)
        # Lists that are near each other get near numbers, and so fall into the same group.
        axis = np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0]
        self.centres = centres[np.argsort(centres @ axis, kind="stable")]
        self.gaps = np.sqrt(np.maximum(((self.centres[:, None, :] - self.centres[None, :, :]) ** 2).sum(-1) if len(centres) <= 512 else self._gaps(), 0))
        rest = sample - self.centres[_nearest(sample, self.centres)]
        cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.codes = [kmeans(rest[:, p], min(CODES, len(rest)), 2 + i) for i, p in enumerate(self.parts)]

    def _gaps(self) -> np.ndarray:
        n = (self.centres**2).sum(1)
        return n[:, None] + n[None, :] - 2 * self.centres @ self.centres.T

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of vectors of the lists ``at``, coding error, and the part of the distance that does not depend on a query."""
        rest = x - self.centres[at]
        codes = np.stack([_nearest(rest[:, p], c) for p, c in zip(self.parts, self.codes, strict=True)], 1).astype(np.uint8)
        coded = np.concatenate([c[codes[:, i]] for i, c in enumerate(self.codes)], 1) if len(x) else rest
        error = np.sqrt(((rest - coded) ** 2).sum(1))
        return codes, error, 2 * (self.centres[at] * coded).sum(1) + (coded**2).sum(1)

    def probes(self, x: np.ndarray) -> np.ndarray:
        """Which lists (columns) each vector must look into."""
        d = np.maximum((x**2).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * x @ self.centres.T, 0)
        must = np.ones(d.shape, bool)
        near = np.argpartition(d, 3, axis=1)[:, :4] if d.shape[1] > 4 else np.tile(np.arange(d.shape[1]), (len(x), 1))
        for k in range(near.shape[1]):
            other = near[:, k]
            gap = self.gaps[other]
            beyond = (d - d[np.arange(len(x)), other][:, None]) / np.where(gap > 0, 2 * gap, 1)
            must &= ~((gap > 0) & (beyond > self.reach))
        return must

    def screen(self, x: np.ndarray) -> np.ndarray:
        """Places on the main axes, and the length of the rest."""
        s = x @ self.axes
        return np.concatenate([s, np.sqrt(np.maximum(1 - (s * s).sum(1), 0))[:, None]], 1).astype(np.float32)

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Inner products of queries with all codes: (subspace, code, query)."""
        out = np.zeros((len(self.parts), max(map(len, self.codes)), len(x)), np.float32)
        for i, (p, c) in enumerate(zip(self.parts, self.codes, strict=True)):
            out[i, : len(c)] = c @ x[:, p].T
        return out


def _matrix(column, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors filled up with zeros to ``dims``, and their lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    if len(flat) == len(sizes) * dims:
        return flat.reshape(-1, dims), sizes
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), wordhash.ragged(np.zeros(len(sizes), np.int64), sizes)] = flat
    return out, sizes


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale  # keeps squares in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after links a-b; every entry points to the smallest of its component."""
    while True:
        x, y = root[a], root[b]
        if not (open_ := x != y).any():
            return root
        np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (root[root] != root).any():
            root = root[root]


def layout(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of each list, so that a group holds about ``most`` vectors."""
    parts = np.maximum(1, -(-sizes // most))
    first, at, load = np.zeros(len(sizes), np.int64), 0, 0
    for c, n in enumerate(sizes.tolist()):
        if load and load + n > most:
            at, load = at + 1, 0
        first[c] = at
        at, load = (at + int(parts[c]), 0) if parts[c] > 1 else (at, load + n)
    return first, parts


def _follows(a: np.ndarray, b: np.ndarray, lists: int) -> np.ndarray:
    """Whether list b is in the half of the circle that begins at list a; of two lists one at least follows the other."""
    return (b - a) % lists <= lists // 2


def _packed(place: int, asks: bool, ids: np.ndarray, own: np.ndarray, many: np.ndarray, sizes: np.ndarray, raw: np.ndarray) -> tuple:
    """Vectors as one row of PACKED; in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        short = raw.astype(np.float32)
    narrow = bool((short == raw).all())
    return (place, asks, narrow, *(np.ascontiguousarray(c).tobytes() for c in (ids, own, many, sizes, short if narrow else raw)))


PACKED = "place int, asks boolean, narrow boolean, ids binary, own binary, many binary, sizes binary, v binary"


def _unpacked(batch: pa.RecordBatch, i: int, dims: int) -> tuple[np.ndarray, ...]:
    got = [np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in range(3, 7)]
    return (*got, np.frombuffer(batch.column(7)[i].as_buffer(), np.float32 if batch.column(2)[i].as_py() else np.float64).reshape(-1, dims))


class _Group:
    """The vectors of a group, indexed; ``ask`` finds the links of queries with them."""

    def __init__(self, q: Quantiser, held: list[tuple[np.ndarray, ...]]):
        ids, own, many, sizes, raw = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(own, kind="stable")
        self.q, self.ids, self.own, self.many, self.sizes, self.raw = q, ids[order], own[order], many[order], sizes[order], raw[order]
        self.lists, self.at = np.unique(self.own, return_inverse=True)
        self.screened = np.zeros((len(ids), q.axes.shape[1] + 1), np.float32)
        self.codes, self.error, self.fixed = np.zeros((len(ids), len(q.parts)), np.uint8), np.zeros(len(ids)), np.zeros(len(ids))
        for i in range(0, len(ids), CHUNK):
            at, x = slice(i, i + CHUNK), _unit(self.raw[i : i + CHUNK].astype(np.float64))
            self.screened[at] = q.screen(x)
            self.codes[at], self.error[at], self.fixed[at] = q.encode(x, self.own[at])
        self.root, self.k = np.arange(len(ids)), np.zeros(len(ids), np.int64)

    def ask(self, ids: np.ndarray, own: np.ndarray, many: np.ndarray, sizes: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
        """Queries that link, as (id, k, other); what their links mean for the group's own vectors is kept for ``end``."""
        order = np.argsort(own, kind="stable")
        ids, own, many, sizes, raw = ids[order], own[order], many[order], sizes[order], raw[order].astype(np.float64)
        n, q, lists = len(self.ids), self.q, len(self.q.centres)
        # Nodes: the group's vectors, then the queries.
        root, k = np.concatenate([self.root, n + np.arange(len(ids))]), np.zeros(len(ids), np.int64)
        kept, n_kept = [], 0
        for i in range(0, len(ids), TILE):
            x, at = _unit(raw[i : i + TILE]), own[i : i + TILE]
            far = np.maximum((x**2).sum(1)[:, None] + (q.centres[self.lists] ** 2).sum(1) - 2 * x @ q.centres[self.lists].T, 0)
            home = ((x - q.centres[at]) ** 2).sum(1)
            gap = q.gaps[at[:, None], self.lists]
            must = _follows(at[:, None], self.lists, lists) & ~((gap > 0) & (far - home[:, None] > 2 * gap * q.reach))
            some = must.any(0)
            if not some.any():
                continue
            members = np.arange(n) if some.all() else np.flatnonzero(some[self.at])
            screened, tables = q.screen(x), q.tables(x)
            for j in range(0, len(members), BLOCK):
                block = members[j : j + BLOCK]
                row, col = np.divmod(np.flatnonzero(screened @ self.screened[block].T >= q.least - SLACK), len(block))
                for p in range(0, len(row), PAIRS):
                    a, b = row[p : p + PAIRS], block[col[p : p + PAIRS]]
                    go = must[a, self.at[b]] & (sizes[i + a] == self.sizes[b]) & (~_follows(self.own[b], at[a], lists) | (ids[i + a] < self.ids[b]))
                    a, b = a[go], b[go]
                    dot = sum(tables[s][self.codes[b, s], a] for s in range(len(q.parts)))
                    go = far[a, self.at[b]] - 2 * dot + self.fixed[b] <= (q.reach + self.error[b]) ** 2 + 1e-4
                    a, b = i + a[go], b[go]
                    go = _cosines(raw[a], self.raw[b].astype(np.float64)) >= q.least
                    a, b = a[go], b[go]
                    np.add.at(k, a, self.many[b])
                    np.add.at(self.k, b, many[a])
                    kept.append((a + n, b))
                    n_kept += len(a)
                    if n_kept > MOST_KEPT:
                        root, kept, n_kept = _unite(root, *map(np.concatenate, zip(*kept, strict=True))), [], 0
        if n_kept:
            root = _unite(root, *map(np.concatenate, zip(*kept, strict=True)))
        # A vector of the group has a smaller number than any query, and so is the root of what it links with.
        self.root = root[:n]
        some = np.flatnonzero(k)
        return self._rows(ids[some], k[some], root[n + some])

    def _rows(self, ids: np.ndarray, k: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "k": pa.array(k, pa.int64()), "other": pa.array(self.ids[root], pa.int64())})

    def end(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.k)
        return self._rows(self.ids[some], self.k[some], self.root[some])


def _links(classes: DataFrame, dims: int, least: float) -> DataFrame:
    """(id, k, other) for classes (id, v, m) of vectors of at most ``dims`` components.

    k: vectors linked with id in a group; other: a class linked with it. A group sums its links and keeps a tree of each
    component, so its rows do not grow with the square of a component.
    """
    spark = classes.sparkSession
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    lists = int(min(MOST_LISTS, max(16, round(n**0.5))))
    quantiser = Quantiser(_unit(_matrix(sample.column("v"), dims)[0]), lists, least)
    lists = len(quantiser.centres)
    fitted = spark.sparkContext.broadcast(quantiser)

    def count_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(lists, np.int64)
        for batch in batches:
            total += np.bincount(_nearest(_unit(_matrix(batch.column(0), dims)[0]), fitted.value.centres), minlength=lists) if batch.num_rows else 0
        yield pa.RecordBatch.from_pydict({"list": pa.array(np.arange(lists), pa.int32()), "k": pa.array(total, pa.int64())})

    held_by = np.zeros(lists, np.int64)
    for r in classes.select("v").mapInArrow(count_lists, "list int, k long").groupBy("list").agg(F.sum("k").alias("k")).collect():  # a row a list
        held_by[r.list] = r.k
    first, parts = layout(held_by, max(256, min(GROUP_ROWS, GROUP_BYTES // (8 * dims), -(-n // LEAST_GROUPS))))
    places = int((first + parts).max())
    sent = spark.sparkContext.broadcast((first, parts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, (first, parts) = fitted.value, sent.value
        # Lists that share their first group are neighbours; its probes go to as many groups as the largest of them has.
        starts = np.flatnonzero(np.diff(first, prepend=-1))
        widths = np.maximum.reduceat(parts, starts)
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                part = batch.slice(i, CHUNK)
                raw, sizes = _matrix(part.column(1), dims)
                x = _unit(raw)
                at = _nearest(x, q.centres)
                ids, many = (part.column(c).to_numpy().astype(np.int64) for c in (0, 2))
                drawn = (wordhash.mix(ids.view(np.uint64)) >> np.uint64(33)).astype(np.int64)
                own = first[at] + drawn % parts[at]
                must = np.logical_or.reduceat(q.probes(x) & _follows(at[:, None], np.arange(lists), lists), starts, axis=1)
                held = [(p, False, np.flatnonzero(own == p)) for p in np.unique(own).tolist()]
                asked = [(f + w, True, np.flatnonzero(must[:, g])) for g, (f, k) in enumerate(zip(first[starts].tolist(), widths.tolist(), strict=True)) for w in range(k)]
                for place, asks, rows in held + asked:
                    if len(rows):
                        row = _packed(place, asks, ids[rows], at[rows], many[rows], sizes[rows], raw[rows])
                        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, [pa.int32(), pa.bool_(), pa.bool_(), *[pa.binary()] * 5], strict=True)], names=[f.split()[0] for f in PACKED.split(", ")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, group = None, [], None
        for batch in batches:
            for i, (p, asks) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if p != place:
                    if group:
                        yield group.end()
                    place, held, group = p, [], None
                rows = _unpacked(batch, i, dims)
                if not asks:
                    held.append(tuple(c.copy() for c in rows))
                elif held or group:
                    if group is None:
                        group, held = _Group(fitted.value, held), []
                    yield group.ask(*rows)
        if group:
            yield group.end()

    dealt = classes.select("id", "v", "m").mapInArrow(deal, PACKED)
    return dealt.repartitionById(places, "place").sortWithinPartitions("place", "asks").mapInArrow(search, "id long, k long, other long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept (the smallest id of its component)."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    doubles = F.transform(v, lambda x: x.cast("double") + F.lit(0.0))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.when(fine, doubles).alias("v"))
    # Two independent keys: the hash of a first column is the seed for the next.
    rows = rows.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v"))
    good = rows.where("v IS NOT NULL AND id IS NOT NULL")
    classes = common.scratch(good.groupBy("k1", "k2").agg(F.min_by(F.struct("id", "v"), "id").alias("one"), F.count("*").alias("m")).select("k1", "k2", "m", "one.*"), "neardup-classes")
    power = F.ceil(F.log2(F.size("v"))).cast("int")
    longest = {r.p: r.d for r in classes.groupBy(power.alias("p")).agg(F.max(F.size("v")).alias("d")).collect()}  # at most 31 rows
    links = df.sparkSession.createDataFrame([], "id long, k long, other long")
    for p, d in sorted(longest.items()):
        links = links.unionByName(_links(classes.where(power == p), d, least))
    links = common.scratch(links, "neardup-links")
    names = components(links, "id", "other")
    linked = links.groupBy(F.col("id").alias("a")).agg(F.sum("k").alias("k"))
    named = (
        classes.drop("v")
        .join(names, F.col("id") == F.col("node"), "left")
        .join(linked, F.col("id") == F.col("a"), "left")
        .select("k1", "k2", (F.col("m") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    found = good.select("id", "k1", "k2").join(named, ["k1", "k2"]).select("id", "n_links", "component_id")
    alone = rows.where("v IS NULL OR id IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = found.unionByName(alone)
    return every.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
