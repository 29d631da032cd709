"""The stages of the corpus pipeline, each on odd rows, and the whole of it, against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from broadsheet.llm import toxicity

from . import brute
from .test_edges import _plain_features

#: Columns with the names that the stages use inside.
CLASH = ("key", "root", "row", "gone_id", "again_id", "label", "label_id", "score", "shard", "size", "h", "token", "component", "copies", "s_source", "id", "node", "named", "order")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in CLASH)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", *CLASH]


def _rows():
    r = random.Random(17)
    draw = lambda n: [f"w{r.randrange(900)}" for _ in range(n)]
    passage, base = draw(70), draw(90)
    texts = [" ".join(draw(r.randint(5, 60))) for _ in range(60)]
    texts += [" ".join(w) for w in ([*base[:k], "edit%d" % k, *base[k + 1 :]] for k in range(0, 80, 9))]
    texts += [" ".join(draw(12) + passage + draw(r.randint(0, 9))) for _ in range(6)]
    texts += [texts[2]] * 3 + ["", "   ", None, None, "one", "One", "a " * 400, " ".join(draw(30_000)), "été 日本 \x1c x"]
    bad = [" ".join([*draw(15), r.choice(["vile,", "Scum!"]), *draw(15)]) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts + bad)]
    rows += [(None, texts[2]), (None, texts[61]), (None, "alone without an id " * 3), (None, None), (5, texts[5]), (5, texts[5]), (5, "another text of the same id"), (None, bad[0])]
    return [(i, t, "en", r.choice(["a", "b", "c", None]), len(t) if t is not None else None, *CLASH) for i, t in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents and labels as tables; labels of every third document, some of them null, repeated or of no document."""
    path = tmp_path_factory.mktemp("pipeline")
    rows = _rows()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    toxic = lambda t: int(any(w in (t or "") for w in ("vile,", "Scum!")))
    labels = [(r[0], 1, toxic(r[1])) for k, r in enumerate(rows) if k % 3 and r[0] is not None] + [(0, 1, None), (1, 0, 0), (9999, 1, 1), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def _counted(frame):
    assert frame.columns == COLUMNS
    return Counter(tuple(r) for r in frame.collect())


def plain_toxicity(spark, rows, labels):
    usable = {}
    for i, _, t in labels:
        if i is not None and t is not None and zlib.crc32(str(i).encode()) % 5:
            usable[i] = max(t, usable.get(i, 0))
    texts = defaultdict(set)
    for r in rows:
        if r[0] in usable:
            texts[r[0]].add(r[1])
    hashed = spark.createDataFrame([(i, t) for i, v in texts.items() for t in v], "i long, t string").select("i", "t", F.xxhash64("i").alias("a"), F.xxhash64("t").alias("b")).collect()
    one = {}
    for x in sorted(hashed, key=lambda x: -x.b):
        one[x.i] = (x.a, x.t)
    z, n = defaultdict(float), defaultdict(float)
    bias = 1 << toxicity.BITS

    def weight(i):
        l1 = 0 if i == bias else toxicity.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    seen = {t: [*_plain_features(t)] for t in {r[1] for r in rows}}
    chance = lambda t: 1 / (1 + math.exp(-sum(weight(i) for i in [*seen[t], bias])))
    for _ in range(toxicity.EPOCHS):
        for i, (_, t) in sorted(one.items(), key=lambda x: x[1][0]):
            g = chance(t) - usable[i]
            for f, w in [(f, weight(f)) for f in [*seen[t], bias]]:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * w
                n[f] += g * g
    return [r for r in rows if chance(r[1]) < pipeline.TOXIC]


def plain_near(rows):
    """Rows by component; see the stage for those without ids."""
    keys = [("id", r[0]) if r[0] is not None else ("text", r[1]) for r in rows]
    words = {k: brute.shingles(r[1]) for k, r in zip(keys, rows, strict=True)}
    sets = [(k, brute.shingles(r[1])) for k, r in zip(keys, rows, strict=True)]
    names = {k: n for n, k in enumerate(dict.fromkeys(keys))}
    links = [(names[a], names[b]) for x, (a, s) in enumerate(sets) for b, t in sets[x + 1 :] if s and t and 100 * len(s & t) >= 75 * len(s | t)]
    root = brute.components(range(len(names)), links)
    members = defaultdict(set)
    for k, n in names.items():
        members[root[n]].add(k)
    stay = {}
    for c, v in members.items():
        ids = sorted(i for kind, i in v if kind == "id")
        stay[c] = ("id", ids[0]) if ids else None  # None: any one of them
    out, seen, free = [], set(), set()
    for k, r in zip(keys, rows, strict=True):
        c = root[names[k]]
        if k[0] == "text" and not words[k]:
            out.append(r)
        elif stay[c] is None:
            if c not in free:
                free.add(c)
                out.append(r)
        elif stay[c] == k and (k, r[1]) not in seen:
            seen.add((k, r[1]))
            out.append(r)
    return out


def plain_passages(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][1] or ""))
    out = []
    for k, (_, n, kept) in zip(order, brute.passages([(rows[k][0], rows[k][1]) for k in order]), strict=True):
        r = rows[k]
        out.append(r if len(kept) == n else (r[0], " ".join(kept), *r[2:4], len(" ".join(kept)), *r[5:]))
    return out


def plain_mix(rows):
    want = brute.mix([(r[0], r[1], r[3]) for r in rows])
    hash_of = lambda i: int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:12], 16)
    words = defaultdict(Counter)
    for r in rows:
        words[r[3]][hash_of(r[0])] += len(brute.words(r[1]))
    out = Counter()
    for s, (size, target) in want.items():
        base = math.floor(target / size) if size else 0
        budget, before = target - base * size, 0
        more = set()
        for h, n in sorted(words[s].items()):
            if budget > 0 and (before + n <= budget or (before <= budget and budget - before >= n / 2)):
                more.add(h)
            before += n
        for r in rows:
            if r[3] == s and (k := base + (hash_of(r[0]) in more)):
                out[r] += k
    return out


def test_toxicity_stage(spark, folder, docs):
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    rows = [tuple(r) for r in docs.collect()]
    kept = plain_toxicity(spark, rows, labels)
    assert _counted(pipeline.toxicity(spark, docs, folder)) == Counter(kept)
    assert sum("Scum!" in (r[1] or "") or "vile," in (r[1] or "") for r in kept) <= 4 and len(kept) >= len(rows) - 45


def test_near_duplicates_stage(spark, folder, docs):
    plain = plain_near([tuple(r) for r in docs.collect()])
    got = _counted(pipeline.near_duplicates(spark, docs, folder))
    free = lambda rows: Counter(r[:2] for r in rows if r[0] is not None or not brute.words(r[1]))
    assert free(got.elements()) == free(plain) and sum(got.values()) == len(plain)


def test_passages_stage(spark, folder, docs):
    rows = [tuple(r) for r in docs.collect()]
    got = _counted(pipeline.passages(spark, docs, folder))
    # Rows of equal id and text can't be told apart but by what is left of them.
    assert Counter(r[:2] + r[4:5] for r in got.elements()) == Counter(r[:2] + r[4:5] for r in plain_passages(rows))


def test_mix_stage(spark, folder, docs):
    assert _counted(pipeline.mix(spark, docs, folder)) == plain_mix([tuple(r) for r in docs.collect()])


def _pieces(rows):
    """Number of documents by (id, tokens); every id of a document lies in one piece, no sequence overflows or is padded."""
    documents, sequences = Counter(), defaultdict(list)
    pieces = Counter()
    for r in rows:
        pieces[r.doc_id, r.doc_tokens] += r.length
        documents[r.doc_id, r.doc_tokens] += r.start == 0
        sequences[r.sequence_id].append(r)
    assert all(n == documents[k] * k[1] for k, n in pieces.items())
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or (at < 2048 and at & (at - 1) == 0)
    return documents


def _tokens(text, made={}):
    if not made:
        made[0] = Tokenizer.from_file(public_tokenizers.path(pipeline.TOKENIZER))
        made[0].encode_special_tokens = True
    return len(made[0].encode(text or "", add_special_tokens=False).ids) + 1


def test_pack_stage(spark, folder, docs):
    want = Counter((r.doc_id, _tokens(r.text)) for r in docs.select("doc_id", "text").collect())
    assert _pieces(pipeline.pack(spark, docs, folder).collect()) == want


def test_whole_pipeline(spark, folder, docs):
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    rows = plain_near(plain_toxicity(spark, [r for r in map(tuple, docs.collect()) if r[0] is not None], labels))
    rows = plain_mix(plain_passages(rows))
    with_ids = docs.where("doc_id IS NOT NULL")
    path = f"{folder}/ids"
    with_ids.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    want = Counter()
    for r, k in rows.items():
        want[r[0], _tokens(r[1])] += k
    assert _pieces(pipeline.run(spark, path).collect()) == want


def test_empty_tables(spark, folder, docs):
    none = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "passages", "mix", "pack"]
    assert np.isclose(pipeline.TOXIC, 0.5)


def test_workers_give_small_blocks_back():
    """What a stage has freed between blocks that stay goes back after a batch of texts."""
    import ctypes
    import subprocess
    import sys
    from pathlib import Path

    if not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("the C library has no malloc_trim")
    code = """
import re
import numpy as np, pyarrow as pa
from broadsheet.llm import wordhash
held = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024
blocks = [np.ones(4096) for _ in range(4000)]
kept = blocks[::50] + blocks[-1:]
del blocks
before = held()
list(wordhash.steps(pa.array(["a text", "another"])))
print(before - held())
"""
    root = Path(__file__).resolve().parents[2]
    got = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=60, check=True)
    assert int(got.stdout) > 60, got.stdout  # of 122 MB
