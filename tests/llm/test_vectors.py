"""Near-duplicate and top-k search on vectors, and chat formatting, against plain versions."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import brute

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, values string"


def _vectors(n=400, dims=16, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims))
    for i in range(0, n // 2, 5):  # chains of near copies
        for j in range(1, 5):
            x[i + j] = x[i + j - 1] + r.normal(size=dims) * 0.2
    x[n // 2 : n // 2 + 60] = x[0]
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


def _odd():
    nan, inf = float("nan"), float("inf")
    return [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [nan] * 16), (1004, [1.0, None] + [0.0] * 14), (1005, [inf] * 16), (1006, [1.0, 2.0, 3.0]), (1007, [2.0, 4.0, 6.0]), (1008, [1e-30] * 16), (1009, [1e30] * 16)]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in _vectors() + _odd()], SCHEMA).repartition(3)


def _usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def test_near_duplicates(spark, vectors):
    from broadsheet.llm.neardup import near_duplicates

    rows = _vectors() + _odd()
    good = [(i, np.array([float(np.float32(c)) for c in v])) for i, v in rows if _usable(v) and any(v)]
    links = []
    for k, (i, a) in enumerate(good):
        for j, b in good[k + 1 :]:
            if len(a) == len(b):
                a1, b1 = a / np.abs(a).max(), b / np.abs(b).max()
                if a1 @ b1 / math.sqrt((a1 @ a1) * (b1 @ b1)) >= 0.95:
                    links.append((i, j))
    names = brute.components([i for i, _ in rows], links)
    got = near_duplicates(vectors).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.component_id, r.kept) for r in got} == {i: (c, i == c) for i, c in names.items()}
    count = {i: 0 for i, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert {r.vec_id: r.n_links for r in got} == count
    assert near_duplicates(vectors.limit(0)).count() == 0


def test_top_k(spark, vectors):
    from broadsheet.llm.topk import top_k

    rows = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in _vectors() + [(i, v) for i, v in _odd() if i < 1009] if _usable(v)]
    want = []
    for q, x in rows:
        if q % 7 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q and len(y) == len(x)))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    got = top_k(vectors.where("vec_id < 1009"), F.col("vec_id") % 7 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert top_k(vectors.limit(0), F.col("vec_id") % 7 == 0).count() == 0


def test_top_k_stops_only_on_proof():
    from broadsheet.llm.topk import BlockIndex

    r = np.random.default_rng(4)
    for dims in (1, 3, 32):
        x = r.integers(-900, 900, size=(700, dims))
        x[:200] = x[0]
        index = BlockIndex(x)
        for q in x[::90]:
            may, scores = index.best(q, 10, np.array([5]))
            exact = x @ q
            assert (exact[may] == scores).all() and 5 not in may
            tenth = np.sort(np.delete(exact, 5))[-10]
            assert set(np.flatnonzero(exact >= tenth)) - {5} <= set(may)


def test_chat_escapes_are_reversible():
    from broadsheet.llm import chat

    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice(["<", "|", "\\", "im_end", "|>", "<|", "a", "\n", "é"]) for _ in range(r.randrange(12)))
        assert chat.unescape(chat.escape(text)) == text and chat.unescape_role(chat.escape_role(text)) == text
        piece, a, b = chat.format_turn("assistant", text)
        assert chat.parse_turn(piece) == ("assistant", text) and chat.unescape(piece[a:b]) == text
        assert piece.count(chat.END) == piece.count(chat.START) == 1


def test_chat_digests(spark):
    from broadsheet.llm import chat

    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\nok"), (1, 1, "assistant", "<|im_end|>\nok"), (2, 5, None, None), (2, 3, "a\nb\\", ""), (None, 0, "assistant", "x"), (None, None, "user", "first"), (3, 0, "assistant", "y" * 500_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    record = F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"})
    got = chat.digest(chat.format_turns(chat.map_records(frame.withColumn("record", record), turn_col="turn"))).collect()
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        body = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        total = sum(len(chat.format_turn(r, x)[0]) for _, _, r, x in turns)
        want[conv] = (len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), total)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want
    assert chat.digest(chat.format_turns(chat.map_records(frame.withColumn("record", record).limit(0), turn_col="turn"))).count() == 0


def test_chat_layouts(spark):
    from broadsheet.llm import chat

    records = [
        {"messages": [{"role": "human", "content": "a"}, {"role": "gpt", "content": "b"}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"instruction": "a", "input": "", "output": "b"},
        {"instruction": "a", "output": "b"},
        {"system": "s", "instruction": "a", "input": "c", "output": "b"},
        {"prompt": "a", "completion": "b"},
        {"prompt": "a", "response": "b"},
        {"question": "a", "answer": "b"},
        {"data": {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}},
        {"messages": []},
    ]
    plain = [("user", "a"), ("assistant", "b")]
    want = [plain] * 4 + [[("system", "s"), ("user", "a\n\nc"), ("assistant", "b")]] + [plain] * 4 + [[]]
    known = chat.registry()
    assert [chat.canonical_turns(r, known)[1] for r in records] == want
    assert all(chat.canonical_turns(r, known)[0] for r in records)
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, '{"other": 1}'), (91, "broken"), (92, None)]
    got = chat.map_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()
    assert sorted(r.conv_id for r in got if r.layout is None) == [90, 91, 92]
    assert [(r.role, r.text) for r in sorted((r for r in got if r.conv_id == 4), key=lambda r: r.piece)] == want[4]
