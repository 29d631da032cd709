"""Registered queries on small tables against plain versions."""

import re

import pytest

from broadsheet.plans import catalog


@pytest.fixture
def made(spark, tmp_path):
    """Writes documents (id, text, source), without events, and returns their folder."""

    def write(rows):
        frame = spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string")
        frame.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([], "event_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
        return str(tmp_path)

    return write


def _greedy(rows):
    seen, kept = set(), []
    for i, text, source in sorted(rows):
        title, _, rest = text.partition("\n")
        keys = {("title", source, re.sub("[^a-z0-9]+", " ", title.lower()).strip()), ("text", source, rest if rest.strip(" ") else title)}
        if not keys & seen:
            kept.append(i)
            seen |= keys
    return kept


def test_two_key_queries_use_whole_keys(spark, made):
    body = "The council met on Tuesday evening and "
    rows = [
        (1, f"Council votes on the budget\n{body}agreed", "a"),
        (2, f"Council votes on the bridge\n{body}differed", "a"),
        (3, f"COUNCIL votes, on the budget!\n{body}left", "a"),
        (4, f"Another title\n{body}differed", "b"),
        (5, f"Council votes on the bridge\n{body}slept", "b"),
        (6, "Only a title that is long enough", "b"),
        (7, "Only a title that is long enough to differ", "b"),
    ]
    d = made(rows)
    assert sorted(r.ord for r in catalog.greedy_dedup(spark, d).collect()) == _greedy([(i, t, "") for i, t, _ in rows]) == [1, 2, 6, 7]
    assert sorted(r.ord for r in catalog.source_dedup(spark, d).collect()) == _greedy(rows) == [1, 2, 4, 5, 6, 7]


def test_tag_dedup_takes_every_word(spark, made):
    texts = [" ".join(f"{'Word' if k % 3 else 'wORD'}{k % 700}" for k in range(5000)), "one\n two ONE  Two three", "", " \n ", " ".join(f"x{k}" for k in range(25)) + " X3 last"]

    def plain(text):
        seen = {}
        for w in re.split("[ \n]+", text):
            seen.setdefault(w.lower(), w)
        return "|".join(w for w in seen.values() if w)

    d = made([(i, t, "a") for i, t in enumerate(texts)])
    assert {r.doc_id: r.tags for r in catalog.tag_dedup(spark, d).collect()} == {i: plain(t) for i, t in enumerate(texts)}


def test_any_entity_pairs_takes_every_entity(spark, made):
    texts = ["education\nmentioned parliamentary", "Education\nnothing new", "settlement\nlegislature parliamentary", "settlement\nof the education act", "a short one\nno more"]
    sets = [set(re.findall("[a-z]{9,}", t.lower())) for t in texts]
    want = set()
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if both := sets[a] & sets[b]:
                want.add((a, b, ",".join(sorted(both)), len(both) / min(len(sets[a]), len(sets[b]))))
    assert {tuple(r) for r in catalog.any_entity_pairs(spark, made([(i, t, "a") for i, t in enumerate(texts)])).collect()} == want


def test_valid_items_counts_every_line(spark, made):
    rows = [(i, "text", "a" if i % 3 else "b") for i in range(1, 120)] + [(7 * 11 * k, "text", "c") for k in range(2, 5)]
    want = {}
    for i, _, s in rows:
        valid, last, invalid = want.get(s, (0, None, 0))
        want[s] = (valid + 1, max(last or 0, i), invalid) if i % 11 and i % 13 and i % 7 else (valid, last, invalid + 1)
    assert {r.source_id: (r.valid_count, r.last_line, r.invalid_count) for r in catalog.valid_items(spark, made(rows)).collect()} == want
