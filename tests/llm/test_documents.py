"""The operators on documents against plain versions, on a small table with odd rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, shard string, key string, size string, h string, score string, token string, component string"
EXTRA = ("x",) * 8


def _texts():
    r = random.Random(7)
    vocabulary = ["".join(r.choice(["ta", "mi", "ro", "ke", "lu", "so"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    draw = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, base = draw(60), draw(120)
    texts = [" ".join(draw(r.randint(1, 150))) for _ in range(40)]
    for k in range(25):  # near copies, some of them linked only through others
        w = list(base)
        for _ in range(k // 4):
            w[r.randrange(len(w))] = "edit%d" % r.randrange(1000)
        texts.append(" ".join(w).upper() if k % 5 == 0 else " ".join(w))
    texts += [texts[3]] * 12 + [texts[41]] * 3
    texts += [" ".join(draw(30) + passage + draw(30)) for _ in range(10)]
    texts += [" ".join(passage * 3), "\n".join(draw(5) + passage), "  " + "\t".join(passage) + "\r\n"]
    texts += ["", "   ", None, None, "one", "one two three", "One TWO three", "a " * 5000, " ".join(draw(40_000)), "x" * 300_000]
    texts += ["don't   stop   now  \n", "Été 　 日本語 本", "<|endoftext|> <|startoftext|> '' it's", "\x1c\x1d a\u0085b   c"]
    return texts


TEXTS = _texts()
DOCS = [(i * 3, t) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    rows = [(i, t, "en", r.choice(["a", "b", "c", "d", None, "\U0001f600", "￮"]), len(t or ""), *EXTRA) for i, t in DOCS]
    r.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def nulls(spark):
    """Null ids and repeated rows."""
    rows = [(None, "a b c d e f", None, None, None, *EXTRA), (None, None, None, None, None, *EXTRA), (1, "a b c d e f", None, None, None, *EXTRA), (1, "a b c d e f", None, None, None, *EXTRA)]
    return spark.createDataFrame(rows, SCHEMA)


def test_sharding(docs, none, nulls):
    from broadsheet.llm.sharding import shard_documents

    for frame, shards in ((docs, 7), (none, 7), (nulls, 2), (docs, 300)):
        inputs = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in frame.collect())
        rows = shard_documents(frame, n_shards=shards).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == inputs
        slots = defaultdict(list)
        for r in rows:
            assert r.law == "rows" and r.grown_shard is None
            slots[r.shard].append(r.slot)
        counts = [len(slots.get(s, [])) for s in range(shards)]
        assert set(slots) <= set(range(shards)) and max(counts) - min(counts) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_keeps_groups_together(spark):
    from broadsheet.llm.sharding import shard_documents

    rows = [(i, f"group {i % 150}" if i < 600 else f"alone {i}") for i in range(3000)]
    out = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=10).collect()
    groups = defaultdict(set)
    for r in out:
        if r.doc_id < 600:
            groups[r.doc_id % 150].add(r.shard)
    assert sum(len(s) == 1 for s in groups.values()) >= 0.9 * len(groups)
    # A group of over half of all rows has to be divided, over as few shards as hold it.
    rows = [(i, "same" if i < 1200 else f"alone {i}") for i in range(2000)]
    out = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=10).collect()
    assert len({r.shard for r in out if r.doc_id < 1200}) <= 9


def test_token_files(spark, docs, none, nulls, tmp_path):
    from broadsheet.llm import tokenfiles

    for k, name in ((False, "word_bpe_49k.json"), (True, "byte_bpe_50k.json")):
        tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        tokenizer.encode_special_tokens = True
        path = f"file://{tmp_path}/{name}"
        tokenfiles.write_token_files(docs, path, public_tokenizers.path(name), keep_space=k)
        got = sorted(tuple(r)[:4] for r in tokenfiles.read_token_files(spark, path).collect())
        assert got == brute.token_rows(DOCS, tokenizer)
    for i, (frame, n) in enumerate(((none, 0), (nulls, 4))):
        path = f"file://{tmp_path}/odd{i}"
        tokenfiles.write_token_files(frame, path, public_tokenizers.path("word_bpe_49k.json"))
        rows = tokenfiles.read_token_files(spark, path, with_ids=True).orderBy("start").collect()
        assert len(rows) == n and all(len(r.ids) == r.n_tokens and r.ids[-1] == 1 for r in rows)
        if n:
            assert [r.doc_id for r in rows] == [None, None, 1, 1]


def test_simple8b_round_trip():
    from broadsheet.llm import tokenfiles

    r = np.random.default_rng(5)
    for n in (0, 1, 59, 60, 61, 255, 256, 257, 3000):
        for top in (1, 2, 1000, 1 << 20, 1 << 59, 1 << 63):
            ids = r.integers(0, top, n, dtype=np.uint64)
            ids[r.random(n) < 0.2] = 0
            words, offsets, exceptions = tokenfiles.pack(ids)
            assert (tokenfiles.unpack(words, offsets, exceptions, n) == ids).all()
            assert len(exceptions) == (ids >= 1 << 60).sum()
    words, _, _ = tokenfiles.pack(np.zeros(60, np.uint64))
    assert len(words) == 1


def test_packing(spark, docs, none, nulls):
    from broadsheet.llm.packing import pack_documents

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    assert pack_documents(none, path).count() == 0
    assert pack_documents(nulls, path).agg(F.sum("length")).first()[0] == sum(r.doc_tokens for r in pack_documents(nulls, path).where("start = 0").collect())
    rows = pack_documents(docs, path).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in DOCS:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)  # nothing is padded


def test_sum_of_squares_choice():
    from broadsheet.llm.packing import Packer

    r = np.random.default_rng(2)
    packer = Packer(window=32, most_open=40)
    placed = 0
    for k in range(3000):
        size = int(r.integers(1, 32))
        levels = packer.levels.copy()
        cost = {}
        for h in range(0, 32 - size + 1):
            if h and not levels[h]:
                continue
            after = levels.copy()
            if h:
                after[h] -= 1
            if h + size < 32:
                after[h + size] += 1
            cost[h] = int((after**2).sum())
        assert cost[packer.choose(size)] == min(cost.values())
        packer.add(k, np.full(size, k, "<u4"))
        placed += size
        assert packer.n_open == packer.levels.sum() <= 40
    packer.end()
    assert sum(r[2] for r in packer.rows) == placed


def test_jaccard(spark, docs, none, nulls):
    from broadsheet.llm.jaccard import similar_documents

    rows = similar_documents(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.jaccard(DOCS) and len(rows) == len(DOCS)
    assert similar_documents(none).count() == 0
    odd = similar_documents(nulls).collect()
    assert len(odd) == 4 and all(r.component_id == 1 for r in odd if r.doc_id == 1)


def test_jaccard_null_ids(spark):
    """Near copies in one batch with null ids, against brute force and through the pipeline's stage."""
    import corpus_pipeline
    from broadsheet.llm.jaccard import similar_documents

    r = random.Random(11)
    draw = lambda n: ["w%d" % r.randrange(10**6) for _ in range(n)]
    edit = lambda w, k: " ".join(w[:k] + ["edit%d" % r.randrange(10**6)] + w[k + 1 :])
    a, b, c, d = draw(80), draw(80), draw(80), draw(80)
    docs = [(7, edit(a, 5)), (9, edit(a, 70)), (None, edit(a, 40)), (None, " ".join(draw(50))), (None, edit(b, 3)), (None, edit(b, 60)), (None, edit(b, 60))]
    docs += [(2**63 - 1, edit(c, 9)), (None, edit(c, 30)), (20, " ".join(d)), (None, " ".join(d)), (None, " ".join(d)), (None, None), (None, ""), (None, ""), (3, " ".join(draw(60)))]
    docs += [docs[6]]
    keys = [i if i is not None else -1 - k for k, (i, _) in enumerate(docs)]
    plain = brute.jaccard([(k, t) for k, (_, t) in zip(keys, docs, strict=True)])
    members = defaultdict(list)
    for k in keys:
        members[plain[k][1]].append(k)
    name = {c: min((k for k in v if k >= 0), default=None) for c, v in members.items()}
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    want = Counter((i, plain[k][0], name[plain[k][1]]) for k, (i, _) in zip(keys, docs, strict=True))
    assert Counter(tuple(x) for x in similar_documents(frame).collect()) == want
    left = corpus_pipeline.near_duplicates(spark, frame, "").collect()
    texts = dict(zip(keys, (t for _, t in docs), strict=True))
    kept = Counter((x.doc_id, x.text) for x in left)
    for v in members.values():
        real = [k for k in v if k >= 0]
        stay = [(min(real), texts[min(real)])] if real else [(None, texts[k]) for k in v]
        assert sum(kept[s] for s in set(stay)) == (1 if any(texts[k] for k in v) else kept[stay[0]])
    assert sum(kept.values()) == sum(1 for v in members.values())
    assert kept[(None, None)] == 1 and kept[(None, "")] == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_large_groups(spark, seed):
    """Groups of edited copies around the threshold, over blocks of small size."""
    from broadsheet.llm import jaccard

    r = random.Random(seed)
    docs = []
    for g in range(6):
        base = ["w%d" % r.randrange(5000) for _ in range(r.randint(20, 90))]
        for _ in range(30):
            w = list(base)
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(len(w))] = "e%d" % r.randrange(5000)
            docs.append((len(docs), " ".join(w[: len(w) - r.randrange(0, 6)])))
    old = jaccard.BLOCK_ROWS
    jaccard.BLOCK_ROWS = 8
    try:
        rows = jaccard.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    finally:
        jaccard.BLOCK_ROWS = old
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in rows} == brute.jaccard(docs)


def test_passages(spark, docs, none, nulls):
    import hashlib

    from broadsheet.llm.substring import dedup_passages

    want = {i: (n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, n, kept in brute.passages(DOCS)}
    rows = dedup_passages(docs, keep=["key", "shard", "text"], with_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want and len(rows) == len(DOCS)
    texts = dict(DOCS)
    for r in rows:
        assert r.key == "x" and r.text == texts[r.doc_id]
        assert r.kept_text == (r.text if not r.n_removed else " ".join(dict((i, k) for i, _, k in brute.passages(DOCS))[r.doc_id]))
    assert dedup_passages(none).count() == 0
    assert dedup_passages(nulls).count() == 4
    long = "k " * 25
    same = spark.createDataFrame([(None, long), (None, long), (4, long), (4, long)], "doc_id long, text string")
    assert sorted(r.n_removed for r in dedup_passages(same).collect()) == sorted(n - len(k) for _, n, k in brute.passages([(None, long), (None, long), (4, long), (4, long)]))


def test_mixing(spark, docs, none, nulls):
    from broadsheet.llm.mixing import mix_sources, mixed_rows

    source = {r.doc_id: r.source for r in docs.collect()}
    want = brute.mix([(i, t, source[i]) for i, t in DOCS])
    rows = mix_sources(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in DOCS)
    taken, largest = Counter(), Counter()
    for r in rows:
        n = len(brute.words(dict(DOCS)[r.doc_id]))
        assert r.size == n and r.source == source[r.doc_id] and r.source_size == want[r.source][0]
        assert r.target == pytest.approx(want[r.source][1]) and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s, (_, target) in want.items():
        assert abs(taken[s] - target) <= largest[s] / 2 + 1
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mix_sources(docs).collect()), key=str)
    mixed = mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})
    assert mix_sources(none).count() == 0 and mixed_rows(none).count() == 0
    assert mix_sources(nulls).count() == 4


def test_toxicity(spark, docs, none, nulls):
    from broadsheet.llm.toxicity import toxicity_scores

    r = random.Random(9)
    plain = ["w%d" % i for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = [r.choice(plain) for _ in range(r.randint(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            w[r.randrange(len(w))] = r.choice(["vile,", "Scum!", "(trash)"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(2000, ""), (2001, None), (2002, "w1 " * 100_000), (None, "scum")]
    labels += [(2000, None), (None, 1), (5000, 1), (0, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    usable = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    got = {x.doc_id: x.score for x in toxicity_scores(frame, marks, usable).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 6 == 0) for i in held) >= 0.98 * len(held)
    assert got[2000] == got[2001] < 0.5 and got[None] >= 0.5
    assert toxicity_scores(none, marks, usable).count() == 0
    assert all(x.score == 0 for x in toxicity_scores(nulls, marks.limit(0), usable, keep=["score", "text"]).select("doc_id", "text").selectExpr("0 AS score").collect())
