"""N-gram Jaccard join by a grouped prefix join, to classes and connected components.

Texts become sets of hashed word shingles. Documents with equal sets are one class, and only its smallest id goes on.

1. Survivors. In one order of all shingles (their hash), two sets that are similar enough share ``1 + size // 16`` or so of
   their first ``size - need(size) + 1 + size // 16`` shingles. Shingles of these prefixes are counted over all documents (buckets of
   the hash space; what recurs within a batch is known there and goes out once, so a frequent shingle costs a row
   per batch); documents with too few recurring ones have no partner and are done. Nearly all documents end here.
2. Order. Over the survivors' whole sets, shingles are counted again and every set is ordered rarest first. A set needs
   ``need(size)`` recurring shingles; the prefix is the first ``size - need(size) + 1``.
3. Blocks. Survivors whose smallest recurring hash is equal meet in blocks of bounded size, where each is compared with the leaders
   so far; leaders of a divided block meet again. This finds most links of large groups at linear cost.
4. Stars. Components that share a prefix shingle with a larger one try a few pairs with it, as many as are linear in the
   postings, so that the components of a large group grow together.
5. Grouped prefix join. Documents with identical prefixes and size are one group; group pairs that share a
   prefix shingle are filtered by size, by position, and by lying in different components already; what is left is
   expanded to members and verified on the whole sets. Only pairs whose link would change no component are passed over.
   A shingle that too many documents still share is not joined: its documents are compared with one typical document
   (the pivot), and their sets are ordered anew with the shingles that the pivot lacks first. Any order that both
   sides use finds all similar pairs, so they meet again by prefixes in that order, where a family of edited copies shares
   little. What is still too frequent gets a new pivot, in ``LEVELS_OF_PIVOTS`` levels; the last level joins whatever is left.

Nothing is capped: every pair that could join two components is verified.

Defined results: null and empty texts have no shingles and link with nothing; shorter texts are one shingle; rows with
equal ids count as one document; rows with null ids count as one document for each text, and the component's id is the smallest
that is not null (null if all are); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm import blobs, common, wordhash
from broadsheet.llm.components import components

WORDS = 5
#: Similarity, in hundredths.
LEAST = 75
BUCKET_TOKENS = 2_000_000
LEAST_BUCKETS = 32
BLOCK_ROWS = 256
#: Bytes of sets that a worker orders at once.
STEP_BYTES = 8 << 20
LEVELS = 3
#: Rounds of step 4, and pairs of two components that each tries.
STAR_ROUNDS = 2
TRIES = 6
#: Documents of a shingle up to which its groups are paired at once, and levels of pivots.
PAIRED = 16
LEVELS_OF_PIVOTS = 4
#: Sets of pivots are broadcast up to so many bytes together; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Up to so many ids (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000

HEADS = "id long, n long, c1 long, c2 long, prefix binary, named boolean"


def document_key(id_col: str, text_col: str) -> Column:
    """The id of a document; in place of a null one a hash of the text from 2^62 to 2^63, so that ids stay 64-bit integers."""
    made = F.xxhash64(F.col(text_col).cast("string")).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(F.col(id_col).cast("long"), made)


def need(n, least: int):
    """The least overlap that a set of n has with any similar set."""
    return -((-least * n) // 100)


def shingle_sets(texts: wordhash.Texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their bounds."""
    hashes = texts.words(lower=True)
    n_docs = len(texts.n_words)
    inside = texts.inside(words)
    shingles, doc = wordhash.window_hashes(hashes, words)[inside], texts.doc[: len(inside)][inside]
    cuts = np.searchsorted(doc, np.arange(n_docs + 1))
    few = np.flatnonzero((texts.n_words > 0) & (texts.n_words < words))
    whole = wordhash.range_hashes(hashes, texts.first[few], texts.first[few + 1], wordhash._BASES[0]) if len(few) else np.zeros(0, np.uint64)
    short = dict(zip(few.tolist(), whole, strict=True))
    sets = [np.array([short[i]]) if i in short else np.unique(shingles[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))]
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)).astype(np.uint64), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _bucket(tokens: np.ndarray, n: int) -> np.ndarray:
    return ((wordhash.mix(tokens) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def document_heads(docs: DataFrame, id_col: str, text_col: str, words: int, least: int) -> DataFrame:
    """id (document_key), size of the set, two hashes of the set, the prefix in hash order, and whether the row has an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in wordhash.steps(batch.column(1)):
                values, bounds = shingle_sets(texts, words)
                n = np.diff(bounds)
                c1, c2 = (wordhash.range_hashes(values, bounds[:-1], bounds[1:], wordhash._BASES[k]).view(np.int64) for k in (0, 1))
                length = np.where(n > 0, np.minimum(n, n - need(n, least) + 1 + n // 16), 0)
                prefix = values[wordhash.ragged(bounds[:-1], length)]
                ids, named = (batch.column(c).slice(row, len(n)) for c in (0, 2))
                yield blobs.table({"id": ids, "n": n, "c1": c1, "c2": c2, "prefix": blobs.to_blobs(prefix, np.concatenate([[0], np.cumsum(length)])), "named": named}, HEADS)

    rows = docs.select(document_key(id_col, text_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").isNotNull().alias("named"))
    return rows.mapInArrow(run, HEADS)


def recurring_in_prefix(heads: DataFrame, buckets: int) -> DataFrame:
    """(id, shared): how many of a prefix's shingles occur in another document's prefix; ids with none are left out."""
    sent = "bucket int, single binary, owner binary, multi binary, direct binary, counts binary"
    coarse = min(buckets, blobs.MOST_BUCKETS)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, batch in enumerate(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tokens, bounds = blobs.from_blobs(batch.column(1), "<u8")
            row = np.repeat(np.arange(len(ids)), np.diff(bounds))
            unique, back, count = np.unique(tokens, return_inverse=True, return_counts=True)
            again = count[back] > 1
            shared = np.bincount(row[again], minlength=len(ids))
            some = np.flatnonzero(shared)
            single, owner, multi = tokens[~again], ids[row[~again]], unique[count > 1]
            order, cuts = blobs.split(_bucket(single, buckets) % coarse, coarse)
            m_order, m_cuts = blobs.split(_bucket(multi, buckets) % coarse, coarse)
            here = np.zeros(coarse + 1, np.int64)
            here[(turn * 7919 + int(tokens[0] % 1009 if len(tokens) else 0)) % coarse + 1 :] = len(some)
            rows = blobs.table(
                {
                    "bucket": np.arange(coarse), "single": blobs.to_blobs(single[order], cuts), "owner": blobs.to_blobs(owner[order], cuts),
                    "multi": blobs.to_blobs(multi[m_order], m_cuts), "direct": blobs.to_blobs(ids[some], here), "counts": blobs.to_blobs(shared[some], here),
                },
                sent,
            )
            yield blobs.filled(rows, "single", "multi", "direct")

    def count(table: pa.Table) -> pa.Table:
        single, owner, multi, direct, counts = (blobs.from_blobs(table.column(c), k)[0] for c, k in (("single", "<u8"), ("owner", "<i8"), ("multi", "<u8"), ("direct", "<i8"), ("counts", "<i8")))
        unique, back, n = np.unique(single, return_inverse=True, return_counts=True)
        again = (n > 1) | np.isin(unique, multi)
        owners, shared = np.unique(owner[again[back]], return_counts=True)
        return pa.table({"id": pa.array(np.concatenate([owners, direct]), pa.int64()), "shared": pa.array(np.concatenate([shared, counts]), pa.int64())})

    found = heads.where("n > 0").select("id", "prefix").mapInArrow(emit, sent)
    if buckets > coarse:
        found = blobs.refined(found, sent, lambda tokens: _bucket(tokens, buckets), [("single:<u8", "owner:<i8"), ("multi:<u8",)], ("direct:<i8", "counts:<i8"))
    found = found.groupBy("bucket").applyInArrow(count, "id long, shared long")
    return found.groupBy("id").agg(F.sum("shared").alias("shared"))


def whole_sets(docs: DataFrame, ids: DataFrame, n_ids: int, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, tokens) of the documents in ``ids`` (column id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in wordhash.steps(batch.column(1)):
                values, bounds = shingle_sets(texts, words)
                yield blobs.table({"id": batch.column(0).slice(row, len(bounds) - 1), "tokens": blobs.to_blobs(values, bounds)}, "id long, tokens binary")

    rows = docs.select(document_key(id_col, text_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kept = rows.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, "id", "left_semi")
    return kept.mapInArrow(run, "id long, tokens binary")


def recurring_prefix(ordered: np.ndarray, n: int, least: int) -> np.ndarray:
    """The recurring shingles of the prefix of a set of n whose recurring ones are ``ordered``; the others stand before them."""
    return ordered[: max(0, len(ordered) - need(n, least) + 1)]


def group_key(head: np.ndarray, n: int, recurring: int, own: int) -> int:
    """Equal for sets of equal prefixes and sizes only; a prefix with a shingle that does not recur is equal to no other."""
    key = np.append(head, np.array([n, own if recurring < n else -1], np.int64).view(np.uint64))
    return int(wordhash.range_hashes(key, np.array([0]), np.array([len(key)]), wordhash._BASES[0]).view(np.int64)[0])


MEMBERS = "id long, n long, gkey long, bkey long, typical double, tokens binary, prefix binary"


def ordered_members(sets: DataFrame, chunks: int, buckets: int, least: int) -> DataFrame:
    """MEMBERS: the sets that can have a partner, with the recurring shingles of their prefixes, rarest first.

    gkey: hash of the whole prefix and the size; bkey: the smallest recurring hash; typical: how frequent its shingles are (mean
    logarithm); tokens: the recurring shingles in order. Those that do not recur come before them all.
    """
    sent = "bucket int, chunk binary, size binary, tokens binary, df binary"
    answer = "chunk int, tokens binary, df binary"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blobs.pieces(whole, 1, STEP_BYTES)):
            chunk = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            tokens, bounds = blobs.from_blobs(batch.column(1), "<u8")
            of = np.repeat(chunk, np.diff(bounds))
            place = _bucket(tokens, buckets) * chunks + of
            order = np.lexsort((tokens, place))
            tokens, place = tokens[order], place[order]
            new = np.ones(len(tokens), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (place[1:] != place[:-1])
            at = np.flatnonzero(new)
            df = np.diff(np.append(at, len(tokens))).astype(np.uint32)
            tokens, place = tokens[at], place[at]
            keys, size = np.unique(place, return_counts=True)
            key_cuts = np.searchsorted(keys // chunks, np.arange(buckets + 1))
            cuts = np.searchsorted(place // chunks, np.arange(buckets + 1))
            rows = blobs.table(
                {
                    "bucket": np.arange(buckets), "chunk": blobs.to_blobs((keys % chunks).astype(np.int32), key_cuts), "size": blobs.to_blobs(size.astype(np.int32), key_cuts),
                    "tokens": blobs.to_blobs(tokens, cuts), "df": blobs.to_blobs(df, cuts),
                },
                sent,
            )
            yield blobs.filled(rows, "tokens")

    def count(table: pa.Table) -> pa.Table:
        chunk, size, tokens, df = (blobs.from_blobs(table.column(c), k)[0] for c, k in (("chunk", "<i4"), ("size", "<i4"), ("tokens", "<u8"), ("df", "<u4")))
        of = np.repeat(chunk, size)
        unique, back = np.unique(tokens, return_inverse=True)
        total = np.bincount(back, df, len(unique)).astype(np.int64)[back]
        often = total > 1
        tokens, of, total = tokens[often], of[often], np.minimum(total[often], 2**32 - 1).astype(np.uint32)
        order = np.lexsort((tokens, of))
        tokens, of, total = tokens[order], of[order], total[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (of[1:] != of[:-1])
        tokens, of, total = tokens[new], of[new], total[new]
        asked = np.unique(of)
        cuts = np.append(np.searchsorted(of, asked), len(of))
        return pa.Table.from_batches([blobs.table({"chunk": asked, "tokens": blobs.to_blobs(tokens, cuts), "df": blobs.to_blobs(total, cuts)}, answer)])

    def order(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("id").to_numpy()
        tokens, bounds = blobs.from_blobs(left.column("tokens"), "<u8")
        known, df = blobs.from_blobs(right.column("tokens"), "<u8")[0], blobs.from_blobs(right.column("df"), "<u4")[0]
        by = np.argsort(known, kind="stable")
        known, df = known[by], df[by]
        at = np.minimum(np.searchsorted(known, tokens), max(len(known) - 1, 0))
        often = known[at] == tokens if len(known) else np.zeros(len(tokens), bool)
        count = np.where(often, df[at], 1) if len(known) else np.ones(len(tokens), np.int64)
        out: list[tuple] = []
        kept, heads = [], []
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            n, mine, recurs = b - a, tokens[a:b], often[a:b]
            if n == 0 or recurs.sum() < need(n, least):
                continue
            by = np.lexsort((mine, count[a:b]))
            ordered = mine[by[n - recurs.sum() :]]
            head = recurring_prefix(ordered, n, least)
            out.append((ids[i], n, group_key(head, n, len(ordered), ids[i]), ordered.min().astype(np.int64), np.log2(count[a:b]).sum() / n))
            kept.append(ordered)
            heads.append(head)
        columns = list(zip(*out, strict=True)) or [[]] * 5
        cat = lambda x: (np.concatenate(x) if x else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(v) for v in x])]).astype(np.int64))
        values = {"id": columns[0], "n": columns[1], "gkey": columns[2], "bkey": columns[3], "tokens": blobs.to_blobs(*cat(kept)), "prefix": blobs.to_blobs(*cat(heads))}
        values = {k: np.array(v, np.int64) if isinstance(v, (list, tuple)) else v for k, v in values.items()}
        return pa.Table.from_batches([blobs.table(values | {"typical": np.array(columns[4], np.float64)}, MEMBERS)])

    rows = sets.select(F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"), "id", "tokens")
    answers = rows.select("chunk", "tokens").mapInArrow(emit, sent).groupBy("bucket").applyInArrow(count, answer)
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(order, MEMBERS)


def similar(o: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, least: int):
    return 100 * o >= least * (a + b - o)


def leader_links(members: DataFrame, blocks: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between members and leaders of their block, and the leaders of the divided blocks (as members)."""
    schema = "kind int, a long, b long, n long, bkey long, tokens binary"

    def run(table: pa.Table) -> pa.Table:
        ids, n, bkey, part, divided = (table.column(c).to_numpy() for c in ("id", "n", "bkey", "part", "divided"))
        tokens, bounds = blobs.from_blobs(table.column("tokens"), "<u8")
        links, again = [], []
        order = np.lexsort((ids, n, part, bkey))
        key, leaders = None, []
        for i in order.tolist():
            if (bkey[i], part[i]) != key:
                key, leaders = (bkey[i], part[i]), []
            mine = set(tokens[bounds[i] : bounds[i + 1]].tolist())
            for j, other in leaders:
                if 100 * n[j] >= least * n[i] and similar(len(mine & other), n[i], n[j], least):
                    links.append((ids[j], ids[i]))
                    break
            else:
                leaders.append((i, mine))
                if divided[i]:
                    again.append(i)
        again = np.array(again, np.int64)
        values, cuts = blobs.rows_of(tokens, bounds, again)
        k, m = len(links), len(again)
        a, b = (np.array(x, np.int64) for x in (zip(*links, strict=True) if links else ([], [])))
        empty = np.concatenate([np.zeros(k, np.int64), cuts])
        return pa.Table.from_batches(
            [
                blobs.table(
                    {
                        "kind": np.repeat([0, 1], [k, m]), "a": np.concatenate([a, ids[again]]), "b": np.concatenate([b, ids[again]]),
                        "n": np.concatenate([np.zeros(k, np.int64), n[again]]), "bkey": np.concatenate([np.zeros(k, np.int64), bkey[again]]),
                        "tokens": blobs.to_blobs(values, empty),
                    },
                    schema,
                )
            ]
        )

    counts = members.groupBy("bkey").count()
    sizes = common.scratch(counts.where("count > 1"), "jaccard-blocks")
    many = sizes.count()
    joined = members.join(F.broadcast(sizes) if many <= BROADCAST_IDS else sizes, "bkey")
    parts = F.ceil(F.col("count") / BLOCK_ROWS)
    placed = joined.select(
        "id", "n", "bkey", "tokens", F.pmod(F.xxhash64("id", F.lit(3)), parts).alias("part"), (parts > 1).alias("divided")
    ).withColumn("place", F.pmod(F.xxhash64("bkey", "part"), F.lit(blocks)))
    found = common.scratch(placed.groupBy("place").applyInArrow(run, schema), "jaccard-leaders")
    return found.where("kind = 0").select("a", "b"), found.where("kind = 1").select(F.col("a").alias("id"), "n", "bkey", "tokens")


#: A member in an order: ``key`` is the pivot of the order (0: the order of all), ``at`` the number of its shingles that do not recur.
ORDERED = "key long, id long, n long, at long, typical double, gkey long, prefix binary"
POSTINGS = "key long, gkey long, n long, component long, id long, w long, typical double, token long, place long"


def with_components(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """ORDERED rows with their components so far."""
    named = rows.join(labels, rows.id == labels.node, "left")
    return named.select(*[c.split()[0] for c in ORDERED.split(", ")], F.coalesce("component", "id").alias("component"))


def named_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members in the order of all, without their sets, with their components so far."""
    rows = members.select(F.lit(0).cast("long").alias("key"), "id", "n", (F.col("n") - F.length("tokens") / 8).cast("long").alias("at"), "typical", "gkey", "prefix")
    return common.scratch(with_components(rows, labels), "jaccard-named")


def posted(rows: DataFrame) -> DataFrame:
    """POSTINGS of the recurring shingles of the prefixes; rows: ORDERED, component, w."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, bounds = blobs.from_blobs(batch.column(8), "<u8")
            size = np.diff(bounds)
            row = np.repeat(np.arange(batch.num_rows), size)
            columns = {c: batch.column(i).to_numpy(zero_copy_only=False)[row] for i, c in enumerate(("key", "gkey", "n", "component", "id", "w", "typical"))}
            place = batch.column(7).to_numpy(zero_copy_only=False)[row] + wordhash.ragged(np.ones(len(size), np.int64), size)
            yield blobs.table(columns | {"token": tokens.view(np.int64), "place": place}, POSTINGS)

    return rows.select("key", "gkey", "n", "component", "id", "w", "typical", "at", "prefix").mapInArrow(spread, POSTINGS)


def star_pairs(named: DataFrame, least: int, seed: int) -> DataFrame:
    """A few pairs (a, b) for each component that shares a prefix shingle with a larger one.

    Per shingle, one member stands for each component, and is paired with the one of the component that has the most
    documents there; of the pairs of two components, ``TRIES`` are kept. So the number of pairs is linear in the postings.
    """
    rows = posted(named.withColumn("w", F.lit(1).cast("long")))
    drawn = F.xxhash64("id", "token", F.lit(seed))
    here = rows.groupBy("token", "component").agg(F.count("*").alias("k"), F.min_by(F.struct("id", "n"), drawn).alias("one"))
    here = common.scratch(here, "jaccard-stars")
    hub = here.groupBy("token").agg(F.max_by(F.struct("component", "one"), F.struct("k", F.xxhash64("component", F.lit(seed)))).alias("hub"), F.count("*").alias("m"))
    met = here.join(hub.where("m > 1"), "token").where(F.col("hub.component") != F.col("component"))
    met = met.where(100 * F.least("one.n", "hub.one.n") >= least * F.greatest("one.n", "hub.one.n"))
    a, b = F.col("one.id"), F.col("hub.one.id")
    tries = F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64(a, b).alias("h"), a.alias("a"), b.alias("b")))), 1, TRIES)
    chosen = met.groupBy("component", F.col("hub.component").alias("other")).agg(tries.alias("tries"))
    return chosen.select(F.explode("tries").alias("t")).select("t.a", "t.b")


def meetings(rows: DataFrame, least: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """One level of the grouped prefix join over ``rows`` (ORDERED, component).

    Pairs (a, b) of members of different components that the filters let through, and (id, pivot): the members of shingles
    that too many share, with the pivots that they are to be ordered by (None: there are no such shingles).

    The larger set looks with its whole prefix; of the smaller only the first ``n - overlap(n, n) + 1`` are held, as the two share
    ``overlap(n, n)`` shingles at least. So a shingle of ``held`` documents makes ``held`` pairs a posting at most.
    """
    group = ["key", "gkey", "n", "component"]
    heads = rows.groupBy(*group).agg(F.min_by(F.struct("id", "at", "typical", "prefix"), "id").alias("one"), F.count("*").alias("w")).select(*group, "one.*", "w")
    postings = common.scratch(posted(heads), "jaccard-postings")
    overlap = lambda n, m: F.ceil(F.lit(least) * (n + m) / (100 + least))
    n, w = F.col("n"), F.col("w")
    held = F.col("place") <= n - overlap(n, n) + 1
    by_component = postings.groupBy("key", "token", "component").agg(
        F.sum(F.when(held, w).otherwise(0)).alias("held"), F.min(F.when(held, n)).alias("smallest"), F.max(F.struct("typical", "id")).alias("best")
    )
    spans = by_component.groupBy("key", "token").agg(
        (F.sum("held") > PAIRED).alias("often"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("smallest").alias("smallest"),
        F.max_by("component", F.struct("held", "component")).alias("hub"), F.max("best").alias("best"),
    ).where("lo < hi AND smallest IS NOT NULL").drop("lo", "hi")
    # Sizes of smaller sets that may be similar and share this shingle as the first one.
    low = F.ceil(F.lit(least) * n / 100)
    top = F.least(n, F.floor((n - F.col("place") + 1) * (100 + least) / F.lit(least)) - n)
    opened = postings.join(spans, ["key", "token"]).withColumns({"held": held, "low": low, "top": top, "in_hub": F.col("component") == F.col("hub")})
    opened = common.scratch(opened.where(F.col("held") | (F.col("smallest") <= F.col("top"))), "jaccard-open")
    common.drop(postings)

    # Frequent shingles: how many pairs of different components they would make, by sizes; the largest component (hub) makes none with itself.
    hot, sized = None, None
    frequent = opened.where("often")
    if frequent.limit(1).count():
        sizes = frequent.where("held").groupBy("key", "token", "n").agg(F.sum("w").alias("every"), F.sum(F.when(F.col("in_hub"), 0).otherwise(w)).alias("others"))
        sizes = sizes.groupBy("key", "token").agg(F.collect_list(F.struct("n", "every", "others")).alias("sizes"))
        others = F.col("in_hub")
        met_by = F.filter("sizes", lambda s: (s.n >= F.col("low")) & (s.n <= F.col("top")) & (~others | (s.others > 0)))
        made = F.aggregate(met_by, F.lit(0).cast("long"), lambda x, s: x + F.when(others, s.others).otherwise(s.every))
        sized = common.scratch(frequent.join(sizes, ["key", "token"]).withColumns({"y_sizes": F.transform(met_by, lambda s: s.n), "made": made}).drop("sizes"), "jaccard-sized")
        busy = sized.groupBy("key", "token").agg(F.sum(F.col("made") * w).alias("pairs"), F.sum(w).alias("k"), F.first("best").alias("best"))
        hot = common.scratch(busy.where(F.col("pairs") > (F.lit(1 << 62) if last else PAIRED * F.col("k"))).select("key", "token", "best"), "jaccard-hot")
    columns = ["gkey", "n", "component", "place"]
    asking = lambda t, *more: t.select("key", "token", *[F.col(c).alias(f"x_{c}") for c in columns], *more)
    holding = lambda t: t.where("held").select(F.col("key").alias("y_key"), F.col("token").alias("y_token"), *[F.col(c).alias(f"y_{c}") for c in columns])
    left = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place")) + 1
    fit = (
        (F.col("x_component") != F.col("y_component"))
        & ((F.col("x_n") > F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_component") < F.col("y_component"))))
        & (100 * F.col("y_n") >= least * F.col("x_n"))
        & (left >= overlap(F.col("x_n"), F.col("y_n")))
    )
    same = (F.col("key") == F.col("y_key")) & (F.col("token") == F.col("y_token"))
    rare = opened.where("NOT often")
    met = asking(rare).join(holding(rare), same & fit)
    if hot is not None:
        cold = sized.join(hot.select("key", "token"), ["key", "token"], "left_anti")
        for ask, hold in ((F.lit(True), ~F.col("in_hub")), (~F.col("in_hub"), F.col("in_hub"))):
            looking = asking(cold.where(ask), F.explode("y_sizes").alias("of_size"))
            met = met.unionByName(looking.join(holding(cold.where(hold)), same & (F.col("of_size") == F.col("y_n")) & fit).drop("of_size"))
    group_pairs = met.select("key", *[f"{k}_{c}" for k in "xy" for c in columns[:3]]).distinct()
    members = rows.select("key", "gkey", "n", "component", "id")
    first, second = (members.select("key", *[F.col(c).alias(f"{k}_{c}") for c in (*columns[:3], "id")]) for k in "xy")
    expanded = group_pairs.join(first, ["key", "x_gkey", "x_n", "x_component"]).join(second, ["key", "y_gkey", "y_n", "y_component"])
    pairs = common.scratch(expanded.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct(), "jaccard-pairs")
    if hot is None or not hot.limit(1).count():
        return pairs, None

    # Shingles of one family should have one pivot: a pivot gives way to the best pivot of its own shingles, twice.
    carried = opened.select(*group, "id", "token").join(hot, ["key", "token"])
    better = common.scratch(carried.groupBy("key", "id").agg(F.max("best").alias("better")), "jaccard-better")
    jump = lambda t: t.join(better, (t.key == better.key) & (t.best.id == better.id), "left").select(t.key, "token", F.coalesce("better", "best").alias("best"))
    pivots = jump(jump(hot)).select("key", "token", F.col("best.id").alias("pivot"))
    asked = opened.select(*group, "token").join(pivots, ["key", "token"]).select(*group, "pivot").distinct()
    asks = asked.join(members, group).where("id <> pivot").select("id", "pivot").distinct()
    return pairs, common.scratch(asks, "jaccard-asks")


def ordered_by_pivots(asks: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """ORDERED rows of the members in asks (id, pivot): what the pivot lacks comes first; and whether they are linked with it."""
    schema = ORDERED + ", linked boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, ids, n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            (p, pb), (x, xb) = (blobs.from_blobs(batch.column(c), "<u8") for c in (5, 6))
            keys, linked, heads = [], [], []
            for i in range(batch.num_rows):
                mine = x[xb[i] : xb[i + 1]]
                inside = np.isin(mine, p[pb[i] : pb[i + 1]])
                head = recurring_prefix(np.concatenate([mine[~inside], mine[inside]]), int(n[i]), least)
                heads.append(head)
                linked.append(similar(int(inside.sum()), int(n[i]), int(m[i]), least))
                keys.append(group_key(head, int(n[i]), len(mine), int(ids[i])))
            bounds = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int64)
            prefix = blobs.to_blobs(np.concatenate(heads) if heads else np.zeros(0, np.uint64), bounds)
            yield blobs.table({"key": pivot, "id": ids, "n": n, "at": n - np.diff(xb), "typical": batch.column(4), "gkey": np.array(keys, np.int64), "prefix": prefix, "linked": np.array(linked, bool)}, schema)

    chosen = asks.select("pivot").distinct()
    sets = members.select(F.col("id").alias("pivot"), F.col("n").alias("m"), F.col("tokens").alias("p_tokens")).join(chosen, "pivot", "left_semi")
    sets = common.scratch(sets, "jaccard-pivots")
    size = sets.agg(F.coalesce(F.sum(F.length("p_tokens") + 64), F.lit(0)).alias("b")).first().b
    rows = asks.join(members.select("id", "n", "typical", "tokens"), "id").join(F.broadcast(sets) if size <= BROADCAST_BYTES else sets, "pivot")
    return rows.select("pivot", "id", "n", "m", "typical", "p_tokens", "tokens").mapInArrow(run, schema)


def verified(pairs: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, xb), (y, yb) = (blobs.from_blobs(batch.column(c), "<u8") for c in (4, 5))
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            o = np.array([len(np.intersect1d(x[xb[i] : xb[i + 1]], y[yb[i] : yb[i + 1]], assume_unique=True)) for i in range(batch.num_rows)], np.int64)
            ok = np.flatnonzero(similar(o, n, m, least))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(ok)) for c in (0, 1)], names=["a", "b"])

    left = members.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("tokens").alias("at"))
    right = members.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("tokens").alias("bt"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "an", "bn", "at", "bt").mapInArrow(run, "a long, b long")


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components."""
    name = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    named = pairs.join(name("a"), "a", "left").join(name("b"), "b", "left")
    return named.where(F.coalesce("a_component", "a") != F.coalesce("b_component", "b")).select("a", "b").distinct()


def component_links(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (a, b) as links between the components of their ends."""
    name = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    named = links.join(name("a"), "a", "left").join(name("b"), "b", "left")
    return named.select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b")).where("a <> b").distinct()


def merged_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after links between components."""
    merged = common.scratch(components(links), "jaccard-merged")
    new = merged.select(F.col("node").alias("component"), F.col("component").alias("root"))
    moved = labels.join(new, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    alone = merged.join(labels.select("node"), "node", "left_anti").select("node", "component")
    return moved.unionByName(alone)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: int = LEAST) -> DataFrame:
    """(id, n_shingles, component_id) per input row; least: similarity in hundredths."""
    found = document_components(docs, id_col, text_col, words, least)
    return found.select(F.when(F.col("named"), F.col("key")).alias(id_col), "n_shingles", F.when(F.col("has_id"), F.col("root")).alias("component_id"))


def document_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: int = LEAST) -> DataFrame:
    """(key, named, n_shingles, root, has_id) per input row: its document_key, whether it has an id, and the key that names its component, which
    is the smallest id in it (has_id) or else the smallest key.
    """
    heads = common.scratch(document_heads(docs, id_col, text_col, words, least), "jaccard-heads")
    sums = heads.agg(F.coalesce(F.sum(F.length("prefix")), F.lit(0)).alias("b"), F.count_if(~F.col("named")).alias("nameless")).first()
    total = sums.b // 8
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_TOKENS))
    shared = recurring_in_prefix(heads, buckets)
    small = heads.select("id", "n", "c1", "c2", "named")
    enough = F.col("shared") >= 1 + F.floor(F.ceil(F.lit(least) * F.col("n") / 100) / 16)
    survivors = small.join(shared, "id").where(enough)
    reps = common.scratch(survivors.groupBy("c1", "c2").agg(F.min("id").alias("id"), F.first("n").alias("n")), "jaccard-survivors")
    counts = reps.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    once = docs
    if sums.nameless:
        has_id = F.col(id_col).cast("long").isNotNull()
        once = docs.where(has_id).unionByName(docs.where(~has_id).dropDuplicates([text_col]))
    sets = common.scratch(whole_sets(once, reps.select("id"), counts.k, id_col, text_col, words), "jaccard-sets")
    parts = max(LEAST_BUCKETS, -(-counts.n // BUCKET_TOKENS))
    members = common.scratch(ordered_members(sets, parts, parts, least), "jaccard-members")
    common.drop(sets)
    links, rest = None, members.select("id", "n", "bkey", "tokens")
    for _ in range(LEVELS):
        found, rest = leader_links(rest, 4 * parts, least)
        links = found if links is None else links.unionByName(found)
        if not rest.limit(1).count():
            break
    labels = common.scratch(components(links), "jaccard-components")
    for seed in range(STAR_ROUNDS):
        named = named_members(members, labels)
        new = common.scratch(component_links(verified(star_pairs(named, least, seed), members, least), labels), "jaccard-new")
        if not new.limit(1).count():
            break
        labels = common.scratch(merged_labels(labels, new), "jaccard-components")
        common.drop(named)
    else:
        named = named_members(members, labels)
    pairs = None
    for level in range(LEVELS_OF_PIVOTS):
        met, asks = meetings(named, least, level == LEVELS_OF_PIVOTS - 1)
        pairs = met if pairs is None else pairs.unionByName(met)
        if asks is None:
            break
        ordered = common.scratch(ordered_by_pivots(asks, members, least), "jaccard-ordered")
        new = common.scratch(component_links(ordered.where("linked").select(F.col("id").alias("a"), F.col("key").alias("b")), labels), "jaccard-new")
        labels = common.scratch(merged_labels(labels, new), "jaccard-components")
        common.drop(named)
        named = common.scratch(with_components(ordered, labels), "jaccard-named")
    pairs = apart(pairs, labels)
    roots = merged_labels(labels, component_links(verified(pairs, members, least), labels)).withColumnRenamed("component", "root")
    classes = small.where("n > 0").groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.count("*").alias("k"))
    named = classes.join(roots, classes.rep == roots.node, "left").where("k > 1 OR root IS NOT NULL")
    named = named.select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.coalesce("root", "rep").alias("root"))
    out = small.join(named, (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")) & (F.col("n") > 0), "left")
    out = out.select(F.col("id").alias("key"), "named", F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("root"))
    if not sums.nameless:
        return out.withColumn("has_id", F.lit(True))
    out = common.scratch(out, "jaccard-out")
    # Components are named by their smallest id, if there is one; the keys in place of null ids may be smaller.
    first = out.where("named").groupBy("root").agg(F.min("key").alias("first_id"))
    return out.join(first, "root", "left").select("key", "named", "n_shingles", F.coalesce("first_id", "root").alias("root"), F.col("first_id").isNotNull().alias("has_id"))
