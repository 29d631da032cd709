"""Edge cases of the scalar functions."""

import base64
import html
import re
from urllib.parse import parse_qsl, urlencode, urlsplit

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from broadsheet.functions import text as T


def values(spark, column, rows, kind="string"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in frame.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


URLS = [
    "HTTPS://Example.COM", " http://a.b/x?utm_source=1&b=2&a=1#f ", "http://a.b/?fbclid=1", "http://a.b/p?b=2&a=3&a=1", "http://a.b/?q=a+b&z=%7e*", "http://a.b/?flag&x=", "http://a.b/?&&c=d",
    "http://a.b/?UTM_x=1&GCLID=2&keep=3", "http://a.b/?k=a;b", "not a url", "", "/relative?x=1", "http://a.b/?n=caf%C3%A9&m=é", "http://a.b?x=1=2", "mailto:x@y.z",
]


def test_canonical_url(spark):
    def plain(u):
        p = urlsplit(u.strip())
        if not p.scheme or not p.netloc:
            return u.strip()
        kept = sorted((k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k.lower() not in ("fbclid", "gclid", "mc_cid", "mc_eid") and not k.lower().startswith("utm_"))
        query = urlencode(kept)
        return f"{p.scheme.lower()}://{p.netloc.lower()}{p.path or '/'}" + (f"?{query}" if query else "")

    assert values(spark, T.canonical_url, URLS) == [plain(u) for u in URLS]
    assert values(spark, T.canonical_url, [None]) == [""]


def test_title_key(spark):
    rows = ["Tom &amp; Jerry!", "  A--B  ", "日本語", "Élan vital", "", None, "100% sure"]
    assert values(spark, T.title_key, rows) == [re.sub(r"[^a-z0-9]+", " ", html.unescape(r or "").lower()).strip() for r in rows]


def test_html_to_text(spark):
    rows = ["<p>a<b>b</b></p>", "x &lt;i&gt;y&lt;/i&gt;", "by AT&T", "<script>s()</script>z", None, "a  b", "&amp;amp;"]
    assert values(spark, T.html_to_text, rows) == ["a b", "x y", "by AT&T", "s() z", "", "a b", "&"]
    assert values(spark, T.html_to_text_strict, ["by AT&T", "by A"]) == ["", "by A"]
    assert values(spark, T.clean_text, ["a &amp; b  c "]) == ["a & b c"]


def test_normal_datetime(spark):
    rows = ["Thu, 28 May 2026 10:20:30 +0530", "Thu, 28 May 2026 10:20:30 GMT", "28 May 2026 10:20:30", "2026-05-28T10:20:30Z", "2026-05-28T10:20:30+05:30", "2026-05-28", "soon", "", None]
    want = ["2026-05-28T04:50:30+00:00", "2026-05-28T10:20:30+00:00", "2026-05-28T10:20:30+00:00", "2026-05-28T10:20:30+00:00", "2026-05-28T04:50:30+00:00", "2026-05-28T00:00:00+00:00", "soon", "", ""]
    assert values(spark, T.normal_datetime, rows) == want
    assert [str(v) for v in values(spark, lambda x: T.order_time(x).cast("string"), ["2026-05-28T10:20:30+00:00", "junk"])] == ["2026-05-28 10:20:30", "0001-01-01 00:00:00"]


def test_display_dates(spark):
    assert values(spark, T.edition_date_text, ["2026-07-06", "soon"]) == ["06 July 2026", "soon"]
    assert values(spark, T.published_text, ["2026-05-28T20:00:00+00:00", "soon"]) == ["29 May · 01:30 IST", "soon"]
    assert values(spark, T.pretty_date, ["2026-05-28T20:05:00+00:00", "soon", None]) == ["28 May 2026 · 20:05", "soon", ""]


def test_entities(spark):
    raw = '{"entities": [{"text": "A  b", "canonical_name": "A b", "type": "person", "role": "PRIMARY"}, {"text": "x", "canonical_name": "", "role": "odd"}, {"text": "a B", "canonical_name": "a B", "type": "PERSON"}, {"text": " "}]}'
    got = values(spark, T.parse_entities, [raw, "broken", None])
    assert [(e.canonical_name, e.type, e.role) for e in got[0]] == [("A b", "PERSON", "primary"), ("x", "OTHER", "secondary")]
    assert got[1:] == [[], []]


def test_tags_and_rewrites(spark):
    assert values(spark, T.distinct_tags, [["A", " a ", "b", "", "B", "c"], None], "array<string>") == [["A", "b", "c"], []]
    assert values(spark, T.safe_tags, ['["a", "b"]', "junk", None]) == [["a", "b"], [], []]
    ok, bad, worse = values(spark, T.parse_rewrite, ['{"headline": " h ", "summary": "s", "section": "World"}', '{"headline": "h", "summary": "s", "section": "Odd"}', "x"])
    assert tuple(ok) == ("h", "s", "World") and bad is None and worse is None


@pytest.mark.parametrize("mail, ok", [("a@b.c", True), ("a b@c.d", False), ("a@b", False), ("x" * 250 + "@b.cd", False)])
def test_email(spark, mail, ok):
    assert values(spark, T.valid_email, [mail]) == [ok]


def test_scores(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c", "d"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r.o for r in rows.select(T.overlap(F.col("a"), F.col("b")).alias("o")).collect()] == [0.5, 0.0]
    assert values(spark, T.clamp, [-1.0, 0.4, 7.0], "double") == [0.0, 0.4, 1.0]
    assert values(spark, T.html_escape, ["<a href=\"x\">'&"]) == [html.escape("<a href=\"x\">'&", quote=True)]


def test_data_uri_is_one_line(spark):
    rows = ["x" * n for n in (0, 56, 57, 58, 300)]
    assert values(spark, lambda c: T.data_uri(F.encode(c, "UTF-8")), rows) == ["data:image/png;base64," + base64.b64encode(x.encode()).decode() for x in rows]


def test_few_pages_are_strings_at_once(monkeypatch):
    told = T._tokenised
    monkeypatch.setattr(T, "PAGES_AT_ONCE", 3)
    monkeypatch.setattr(T.memory, "trim", lambda: trims.append(1))
    trims = []
    pages = [f"<p>a{i} &amp; <b>b</b>" if i % 5 else None for i in range(10)]
    got = list(T._texts(iter([pa.array(pages), pa.array([], pa.string())]), True))
    assert [x.to_pylist() for x in got] == [[told(v, True) for v in pages], []] and len(trims) == 2
