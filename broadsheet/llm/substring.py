"""Substring deduplication with repeated-phrase automata.

A window is ``window`` consecutive words of one document; a window is repeated if its words also start earlier (smaller id, or
same document, earlier start). Words that a repeated window covers are removed; windows are judged on the input.

1. Recurring phrases. Of the ``phrase``-word runs inside each window, the one with the smallest hash is its anchor; equal windows
   have equal anchors. Anchors are counted over all documents in buckets of the hash space; what recurs within a
   batch is known there and goes out once, so a very common passage costs a row per batch.
2. Automata. Documents with recurring phrases are dealt over ranges of their ids. Each range is a shard: its phrases are
   compiled to Aho-Corasick automata, and all its documents are streamed through them to find every occurrence.
   Windows with an occurrence are candidates; within the shard, all but the first of equal ones are repeated.
3. First occurrences. Each shard sends one hash per distinct candidate window; the smallest shard that has it keeps it,
   in all others it is repeated (ranges are ascending, so this is document order). A window thus costs a row per shard.
4. The words that repeated windows cover are taken out.

Windows are compared by 64-bit hashes of their words after the automaton has confirmed the phrase within the shard.

Shards are cut by the number of rows; their bounds come from percentiles of percentiles, one id for ``SHARD_BYTES`` of text.

Defined results: null text has no words; rows with null ids come first (among ids below ``NULL_ID`` + 2^56, by place); rows with equal ids are ordered by text, and
equal rows count as following each other; texts of fewer words than a window are kept; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm import blobs, common, wordhash

WINDOW = 20
PHRASE = 8
SHARD_BYTES = 8 << 20
LEAST_SHARDS = 64
#: Phrases of one automaton; a shard with more streams its documents through several, one after another, so that memory is bounded.
PHRASES_AT_ONCE = 25_000
BUCKET_ANCHORS = 1_000_000
#: Bytes of text for an anchor, roughly; only sizes the buckets.
BYTES_PER_ANCHOR = 40
BROADCAST_IDS = 500_000
#: Bytes of ids that a worker makes distinct at once.
STEP_BYTES = 8 << 20
#: Rows with null ids are dealt from here on, by the first bytes of their texts.
NULL_ID = -(1 << 63)
NULL_BYTES = 7
ANSWER = "shard int, owner binary, place binary"


def anchors(texts: wordhash.Texts, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Word number (in the batch) and hash of each window's anchor, every anchor once."""
    words = texts.words()
    runs = wordhash.window_hashes(words, phrase)
    valid = texts.inside(window)
    n, span = len(valid), window - phrase + 1
    if not n or not valid.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, width = runs, 1
    while 2 * width <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width : span - width + n])
    at = np.zeros(n, np.int64)
    for j in reversed(range(span)):  # the first of equal ones
        hit = runs[j : j + n] == least
        at[hit] = j
    at = np.unique((at + np.arange(n))[valid])
    return at, runs[at]


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((wordhash.mix(hashes) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def document_order(id_col: str, text_col: str) -> Column:
    """The id; in place of a null one a number from NULL_ID on that rises with the text, so that such rows need not lie in one shard."""
    head = F.hex(F.substring(F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8"), 1, NULL_BYTES))
    made = F.lit(NULL_ID) + F.conv(F.rpad(head, 2 * NULL_BYTES, "0"), 16, 10).cast("long")
    return F.coalesce(F.col(id_col).cast("long"), made)


def shard_bounds(rows: DataFrame, shards: int) -> np.ndarray:
    """Keys that begin the shards 1, 2, ...: percentiles within ranges that are percentiles themselves, so no plan or task holds more than a root of them."""
    parts = lambda n: [i / n for i in range(1, n)]
    outer = math.isqrt(shards)
    cuts = rows.agg(F.percentile_approx("key", parts(outer), 100 * outer).alias("c")).first().c
    first = np.unique(np.array(cuts or [], np.int64))
    inner = -(-shards // outer)
    sent = rows.sparkSession.sparkContext.broadcast(first)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_pydict({"range": pa.array(np.searchsorted(sent.value, key, "right"), pa.int32()), "key": batch.column(0)})

    within = rows.select("key").mapInArrow(ranges, "range int, key long").groupBy("range").agg(F.percentile_approx("key", parts(inner), 100 * inner).alias("c"))
    return np.unique(np.concatenate([first, *(np.array(r.c, np.int64) for r in within.select("c").toLocalIterator())]))


def recurring_anchors(rows: DataFrame, bounds: Broadcast, buckets: int, window: int, phrase: int) -> DataFrame:
    """ANSWER rows: by shard, the ids and word places of anchors that occur again somewhere."""
    sent = "bucket int, single binary, owner binary, place binary, multi binary, again_owner binary, again_place binary"
    coarse = min(buckets, blobs.MOST_BUCKETS)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found = []
            for row, texts in wordhash.steps(batch.column(1)):
                at, hashes = anchors(texts, window, phrase)
                doc = texts.doc[at]
                found.append((ids[row + doc], (at - texts.first[doc]).astype(np.int32), hashes))
            owner, place, hashes = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64))
            unique, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
            again = count[back] > 1
            multi = unique[count > 1]
            order, cuts = blobs.split(_bucket(hashes[~again], buckets) % coarse, coarse)
            a_order, a_cuts = blobs.split(_bucket(hashes[again], buckets) % coarse, coarse)
            m_order, m_cuts = blobs.split(_bucket(multi, buckets) % coarse, coarse)
            rows = blobs.table(
                {
                    "bucket": np.arange(coarse), "single": blobs.to_blobs(hashes[~again][order], cuts), "owner": blobs.to_blobs(owner[~again][order], cuts),
                    "place": blobs.to_blobs(place[~again][order], cuts), "multi": blobs.to_blobs(multi[m_order], m_cuts),
                    "again_owner": blobs.to_blobs(owner[again][a_order], a_cuts), "again_place": blobs.to_blobs(place[again][a_order], a_cuts),
                },
                sent,
            )
            yield blobs.filled(rows, "single", "multi", "again_owner")

    def count(table: pa.Table) -> pa.Table:
        single, multi = (blobs.from_blobs(table.column(c), "<u8")[0] for c in ("single", "multi"))
        owner, more_owner = (blobs.from_blobs(table.column(c), "<i8")[0] for c in ("owner", "again_owner"))
        place, more_place = (blobs.from_blobs(table.column(c), "<i4")[0] for c in ("place", "again_place"))
        unique, back, n = np.unique(single, return_inverse=True, return_counts=True)
        again = ((n > 1) | np.isin(unique, multi))[back]
        owner, place = np.concatenate([owner[again], more_owner]), np.concatenate([place[again], more_place])
        shard = np.searchsorted(bounds.value, owner, "right")
        order = np.lexsort((place, owner, shard))
        shards = np.unique(shard)
        cuts = np.append(np.searchsorted(shard[order], shards), len(shard))
        return pa.Table.from_batches([blobs.table({"shard": shards, "owner": blobs.to_blobs(owner[order], cuts), "place": blobs.to_blobs(place[order], cuts)}, ANSWER)])

    found = rows.select("key", "text").mapInArrow(emit, sent)
    if buckets > coarse:
        hashed = [("single:<u8", "owner:<i8", "place:<i4"), ("multi:<u8",)]
        found = blobs.refined(found, sent, lambda hashes: _bucket(hashes, buckets), hashed, ("again_owner:<i8", "again_place:<i4"))
    return found.groupBy("bucket").applyInArrow(count, ANSWER)


def normal_form(text: bytes) -> tuple[str, np.ndarray]:
    """The words with one blank around each, and at which character each word begins."""
    spaced = b" " + b" ".join(text.split()) + b" "
    raw = np.frombuffer(spaced, np.uint8)
    starts = np.flatnonzero(raw[:-1] == 32) + 1
    if (raw < 128).all():
        return spaced.decode(), starts
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    return spaced.decode(), character[starts]


def shard_automaton(phrases: list[str]):
    """An automaton over phrases (words with one blank around each); its values are their lengths."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for p in phrases:
        automaton.add_word(p, len(p))
    automaton.make_automaton()
    return automaton


def occurrences(automaton, text: str, starts: np.ndarray) -> np.ndarray:
    """Word numbers at which the automaton's phrases begin in a normal form."""
    begins = np.fromiter((end - length + 2 for end, length in automaton.iter(text)), np.int64)
    return np.searchsorted(starts, begins)


def _sorted_docs(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table, [("key", "ascending"), ("text", "ascending")]))


def located(docs: DataFrame, answers: DataFrame, buckets: int, window: int, phrase: int, keep: list[str]) -> DataFrame:
    """kind 0: the documents of each shard in order; 1: hashes and places of distinct candidate windows; 2: places of repeated ones."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = "kind int, shard int, bucket int, hash binary, place binary, key long, at long, text string" + "".join(f", `{c}` {fields[c]}" for c in keep)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty(left)
        docs = _sorted_docs(left)
        keys = docs.column("key").to_numpy()
        shard = left.column("shard")[0].as_py()
        owner, place = blobs.from_blobs(right.column("owner"), "<i8")[0], blobs.from_blobs(right.column("place"), "<i4")[0]
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
        texts = [t if t is not None else "" for t in docs.column("text").to_pylist()]
        forms = [normal_form(t.encode()) for t in texts]
        phrases = set()
        lo, hi = np.searchsorted(owner, keys, "left"), np.searchsorted(owner, keys, "right")
        for (text, starts), a, b in zip(forms, lo.tolist(), hi.tolist(), strict=True):
            ends = np.append(starts, len(text))
            p = place[a:b]
            p = p[p + phrase <= len(starts)]
            phrases.update(text[s - 1 : e] for s, e in zip(starts[p].tolist(), ends[p + phrase].tolist(), strict=True))
        n_words = np.array([len(s) if len(t) > 2 else 0 for t, s in forms], np.int64)
        first = np.concatenate([[0], np.cumsum(n_words)])
        ordered = sorted(phrases)
        del phrases
        begins: list[list[np.ndarray]] = [[] for _ in forms]
        for k in range(0, len(ordered), PHRASES_AT_ONCE):
            automaton = shard_automaton(ordered[k : k + PHRASES_AT_ONCE])
            for i in np.flatnonzero(n_words >= window).tolist():
                if len(p := occurrences(automaton, *forms[i])):
                    begins[i].append(p.astype(np.int32))
            del automaton
        windows = []
        for i, found in enumerate(begins):
            if not found:
                continue
            p = np.concatenate(found).astype(np.int64)
            marks = np.zeros(n_words[i] - window + 2, np.int32)
            np.add.at(marks, np.maximum(p - (window - phrase), 0), 1)
            np.add.at(marks, np.minimum(p + 1, len(marks) - 1), -1)
            windows.append(first[i] + np.flatnonzero(np.cumsum(marks)[:-1] > 0))
        del begins
        at = np.concatenate(windows) if windows else np.zeros(0, np.int64)
        hashes, base = np.zeros(len(at), np.uint64), 0
        for _, step in wordhash.steps(pa.array(texts, pa.large_string())):
            a, b = np.searchsorted(at, [base, base + len(step.starts)])
            if b > a:
                hashes[a:b] = wordhash.window_hashes(step.words(), window)[at[a:b] - base]
            base += len(step.starts)
        unique, opens = np.unique(hashes, return_index=True)
        again = np.ones(len(at), bool)
        again[opens] = False
        b_order, cuts = blobs.split(_bucket(unique, buckets), buckets)
        used = np.flatnonzero(np.diff(cuts))
        cuts = np.append(cuts[used], cuts[-1])
        sent = {"kind": np.ones(len(used)), "bucket": used, "hash": blobs.to_blobs(unique[b_order], cuts), "place": blobs.to_blobs(at[opens][b_order].astype(np.int32), cuts)}
        local = {"kind": np.array([2]), "bucket": np.array([-1]), "hash": pa.array([b""]), "place": pa.array([at[again].astype(np.int32).tobytes()])}
        parts = [pa.table({"kind": pa.array(p["kind"], pa.int32()), "bucket": pa.array(p["bucket"], pa.int32()), "hash": p["hash"], "place": p["place"]}) for p in (sent, local)]
        own = docs.append_column("kind", pa.array(np.zeros(len(keys)), pa.int32())).append_column("at", pa.array(np.arange(len(keys)), pa.int64())).drop_columns(["shard"])
        out = pa.concat_tables([*parts, own], promote_options="default")
        out = out.append_column("shard", pa.array(np.full(out.num_rows, shard), pa.int32()))
        return out.select(names)

    names = ["kind", "shard", "bucket", "hash", "place", "key", "at", "text", *keep]

    def empty(left: pa.Table) -> pa.Table:
        base = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("bucket", pa.int32()), ("hash", pa.binary()), ("place", pa.binary()), ("key", pa.int64()), ("at", pa.int64()), ("text", pa.string())])
        return pa.schema([*base, *(left.schema.field(c) for c in keep)]).empty_table()

    return docs.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(run, schema)


def later_windows(found: DataFrame) -> DataFrame:
    """(shard, place): candidate windows that a smaller shard has too."""

    def run(table: pa.Table) -> pa.Table:
        hashes, bounds = blobs.from_blobs(table.column("hash"), "<u8")
        place = blobs.from_blobs(table.column("place"), "<i4")[0]
        shard = np.repeat(table.column("shard").to_numpy(), np.diff(bounds))
        order = np.lexsort((shard, hashes))
        hashes, place, shard = hashes[order], place[order], shard[order]
        later = np.zeros(len(hashes), bool)
        later[1:] = hashes[1:] == hashes[:-1]
        place, shard = place[later], shard[later]
        order = np.argsort(shard, kind="stable")
        shards = np.unique(shard)
        cuts = np.append(np.searchsorted(shard[order], shards), len(shard))
        return pa.Table.from_batches([blobs.table({"shard": shards, "place": blobs.to_blobs(place[order], cuts)}, "shard int, place binary")])

    return found.where("kind = 1").select("bucket", "shard", "hash", "place").groupBy("bucket").applyInArrow(run, "shard int, place binary")


def dedup_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE, keep: list[str] | None = None, with_text: bool = False
) -> DataFrame:
    """One row per input row: id, ``keep`` columns, n_words, n_removed, kept_sha256 (kept words joined by one blank).

    ``with_text`` adds kept_text: the text itself where nothing is removed, else the kept words joined by one blank.
    """
    keep = keep or []
    named = {c: f"keep_{i}" for i, c in enumerate(keep)}
    rows = docs.select(F.col(id_col).alias("keep_id"), document_order(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(n) for c, n in named.items()])
    held = ["keep_id", *named.values()]
    sums = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count_if(F.col("keep_id").isNull()).alias("nameless")).first()
    total = sums.b
    shards = max(LEAST_SHARDS, -(-total // SHARD_BYTES))
    keys = rows.select("key") if sums.nameless else docs.select(F.col(id_col).cast("long").alias("key"))  # ids alone need no texts
    bounds = docs.sparkSession.sparkContext.broadcast(shard_bounds(keys, shards))
    buckets = max(32, -(-total // (BYTES_PER_ANCHOR * BUCKET_ANCHORS)))
    answers = common.scratch(recurring_anchors(rows, bounds, buckets, window, phrase), "substring-anchors")

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blobs.pieces(whole, 1, STEP_BYTES)):
            owner, at = blobs.from_blobs(batch.column(1), "<i8")
            shard = np.repeat(batch.column(0).to_numpy(), np.diff(at))
            order = np.lexsort((owner, shard))
            owner, shard = owner[order], shard[order]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (shard[1:] != shard[:-1])
            yield blobs.table({"shard": shard[new], "c_key": owner[new]}, "shard int, c_key long")

    ids = common.scratch(answers.select("shard", "owner").mapInArrow(owners, "shard int, c_key long").distinct(), "substring-ids")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    hit = rows.join(few, F.col("key") == F.col("c_key")).drop("c_key")
    rest = rows.join(few, F.col("key") == F.col("c_key"), "left_anti")
    found = common.scratch(located(hit, answers, buckets, window, phrase, held), "substring-windows")
    taken = later_windows(found).unionByName(found.where("kind = 2").select("shard", "place"))

    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in held] + ["n_words long", "n_removed long", "kept_sha256 string"] + ["kept_text string"] * with_text)

    def result(table: pa.Table, first: np.ndarray | None = None, stays: np.ndarray | None = None) -> pa.Table:
        """The rows of the result; stays: for each word of the table whether it is kept. One text's words are held at a time."""
        n_words, removed, hashes, kept_texts = [], [], [], []
        for i, text in enumerate(table.column("text")):
            words = (text.as_py() or "").encode().split()
            gone = 0
            if stays is not None:
                mine = stays[first[i] : first[i + 1]]
                gone = len(words) - int(mine.sum())
                if gone:
                    n = len(words)
                    words = list(compress(words, mine.tolist()))
            kept = b" ".join(words)
            n_words.append(n if gone else len(words))
            removed.append(gone)
            hashes.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_texts.append(kept.decode() if gone else text.as_py())
        out = table.select(held)
        out = out.append_column("n_words", pa.array(n_words, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))
        out = out.append_column("kept_sha256", pa.array(hashes, pa.string()))
        return out.append_column("kept_text", pa.array(kept_texts, pa.string())) if with_text else out

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = left.take(pc.sort_indices(left, [("at", "ascending")]))
        counts = [len((t.as_py() or "").encode().split()) for t in docs.column("text")]
        first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        place = blobs.from_blobs(right.column("place"), "<i4")[0].astype(np.int64)
        marks = np.zeros(first[-1] + 1, np.int32)
        np.add.at(marks, place, 1)
        np.add.at(marks, place + window, -1)
        return result(docs, first, np.cumsum(marks)[:-1] == 0)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                yield from result(pa.Table.from_batches([batch.slice(i, 1024)])).combine_chunks().to_batches()

    final = found.where("kind = 0").select("shard", "at", "text", *held).groupBy("shard").cogroup(taken.groupBy("shard")).applyInArrow(cut, schema)
    final = final.unionByName(rest.select("text", *held).mapInArrow(plain, schema))
    return final.select(F.col("keep_id").alias(id_col), *[F.col(n).alias(c) for c, n in named.items()], "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text)
