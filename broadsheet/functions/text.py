"""Scalar functions as column expressions; pandas functions only where HTML has to be tokenised.

The numbers in brackets are the survey's ids of the functions.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from broadsheet import memory, schemas

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_SPACES = r"(?U)\s+"


def squeeze(x: Column) -> Column:
    """Unicode white space runs to one blank, stripped. [FN-06]"""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), _SPACES, " "))


@F.pandas_udf(StringType())
def unescape(x: pd.Series) -> pd.Series:
    """HTML character references to characters."""
    return x.map(lambda v: v if v is None or "&" not in v else html.unescape(v))


def clean_text(x: Column) -> Column:
    """Unescaped and squeezed. [FN-05]"""
    return squeeze(unescape(F.coalesce(x, F.lit(""))))


class _Pieces(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)


def _tokenised(value: str | None, keep_tail: bool) -> str:
    parser = _Pieces()
    parser.feed(html.unescape(value or ""))
    if keep_tail:
        parser.close()
    return " ".join(html.unescape(" ".join(parser.pieces)).split())


#: Pages that are Python strings at once.
PAGES_AT_ONCE = 256


def _texts(batches: Iterator[pa.Array], keep_tail: bool) -> Iterator[pa.Array]:
    """A batch's pages are taken a few at a time, and what they needed is given back after it."""
    for batch in batches:
        parts = [pa.array([_tokenised(v, keep_tail) for v in batch[i : i + PAGES_AT_ONCE].to_pylist()], pa.string()) for i in range(0, len(batch), PAGES_AT_ONCE)]
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())
        del batch, parts
        memory.trim()


@F.arrow_udf(StringType())
def html_to_text(x: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Text of HTML; a tail that ends in an unfinished character reference is kept. [FN-04]"""
    return _texts(x, True)


@F.arrow_udf(StringType())
def html_to_text_strict(x: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """As html_to_text, but such a tail is lost. [FN-04, strict]"""
    return _texts(x, False)


def html_to_text_sql(x: Column) -> Column:
    """Text of HTML by patterns alone: tags to blanks, the five common references resolved. [FN-04, SQL variant]"""
    text = F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def _encode(x: Column) -> Column:
    """Form encoding that leaves only letters, digits and _.-~ as they are."""
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _decode(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, tracking keys out, parameters sorted, no fragment; what is no URL is stripped. [FN-01]"""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?U)^\s+|\s+$", "")
    scheme, host, path, query = (F.regexp_extract(u, _URL, i) for i in (1, 2, 3, 4))
    segments = F.filter(F.split(query, "&"), lambda s: s != "")
    pairs = F.transform(
        segments,
        lambda s: F.struct(
            _decode(F.substring_index(s, "=", 1)).alias("k"),
            F.when(F.instr(s, "=") > 0, _decode(F.regexp_replace(s, "^[^=]*=", ""))).otherwise("").alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~F.lower(p.k).isin(*schemas.TRACKING_KEYS) & ~F.startswith(F.lower(p.k), F.lit("utm_")))
    encoded = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(_encode(p.k), F.lit("="), _encode(p.v))), "&")
    full = F.concat(
        F.lower(scheme), F.lit("://"), F.lower(host), F.when(path == "", "/").otherwise(path), F.when(encoded == "", "").otherwise(F.concat(F.lit("?"), encoded))
    )
    return F.when((scheme != "") & (host != ""), full).otherwise(u)


def title_key(title: Column, unescaped: bool = False) -> Column:
    """Runs of anything but a-z and 0-9 to a blank, in lower case. [FN-02]"""
    x = F.coalesce(title, F.lit(""))
    return F.trim(F.regexp_replace(F.lower(x if unescaped else unescape(x)), "[^a-z0-9]+", " "))


def article_id(url: Column) -> Column:
    """[FN-03]"""
    return F.concat(F.lit("article-"), F.substring(F.sha2(url, 256), 1, 24))


def normal_datetime(value: Column) -> Column:
    """RFC 822 or ISO to UTC ISO with +00:00; other text as it is. [FN-07]"""
    text = squeeze(value)
    mail = F.regexp_replace(text, r"^[A-Za-z]{3,9},?\s+", "")
    mail = F.regexp_replace(mail, r"\s*\(.*\)$", "")
    mail = F.regexp_replace(mail, r" (UT|UTC|GMT|Z)$", " +0000")
    zoned = F.coalesce(
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm Z")),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss")),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm")),
    )
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"), F.try_to_timestamp(text))
    ts = F.coalesce(zoned, iso)
    micros = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(text == "", "").when(ts.isNull(), text).otherwise(F.replace(micros, F.lit(".000000"), F.lit("")))


def order_time(value: Column) -> Column:
    """The time of an ISO text for ordering; year 1 where it is none. [FN-08]"""
    return F.coalesce(F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(value)), F.lit("0001-01-01 00:00:00").cast("timestamp"))


def casefold(x: Column) -> Column:
    """Full case folding: capitals first, so that ß and ligatures become letters, then small ones; ı stays, ς is σ."""
    capitals = F.upper(F.translate(x, "ı", "\ue000"))
    # The replacement between also keeps the optimiser from leaving the capitals out.
    return F.translate(F.lower(F.replace(capitals, F.lit("ẞ"), F.lit("SS"))), "ς\ue000", "σı")


def entity_set(entities: Column, primary: bool = False, distinctive: bool = False) -> Column:
    """Distinct case-folded canonical names, of primary role or distinctive type if asked. [FN-11]"""
    chosen = entities
    if primary:
        chosen = F.filter(chosen, lambda e: e.role == "primary")
    if distinctive:
        chosen = F.filter(chosen, lambda e: e["type"].isin(*schemas.DISTINCTIVE_TYPES))
    return F.array_sort(F.array_distinct(F.transform(chosen, lambda e: casefold(e.canonical_name))))


def overlap(a: Column, b: Column) -> Column:
    """Shared part of the smaller of two sets; 0 if one is empty. [FN-12]"""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def clamp(x: Column) -> Column:
    """To 0..1; NaN to 1. [FN-13]"""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def weighted_score(entity: Column, lexical: Column, entity_weight: float = 0.5, lexical_weight: float = 0.5) -> Column:
    """[FN-14]"""
    return F.lit(entity_weight) * entity + F.lit(lexical_weight) * lexical


def input_fingerprint(title: Column, description: Column) -> Column:
    """[FN-15]"""
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit(""))), 256)


def story_fingerprint(*fields: str) -> Column:
    """Hash of JSON with sorted keys. [FN-16]"""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def entities_error(raw: Column) -> Column:
    """What is wrong with a model's answer: it must be a JSON object with a list ``entities``; null if nothing is. [FN-17, UDF-05]"""
    v = F.try_parse_json(raw)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT<")), F.lit(False))
    listed = F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get(v, "$.entities", "variant")), F.lit("ARRAY<")), F.lit(False))
    return F.when(raw.isNull() | v.isNull(), "the answer is no JSON").when(~(is_object & listed), "the answer has no list of entities")


def parse_entities(raw: Column) -> Column:
    """Entities of a model's JSON answer: type defaults to OTHER, unknown roles are secondary, those without a text go, as does
    what is no object. [FN-17, ORD-08]"""
    got = F.try_variant_get(F.try_parse_json(raw), "$.entities", "array<variant>")
    objects = F.filter(F.coalesce(got, F.array().cast("array<variant>")), lambda e: F.startswith(F.schema_of_variant(e), F.lit("OBJECT<")))
    field = lambda e, name: squeeze(F.try_variant_get(e, f"$.{name}", "string"))
    filled = F.transform(
        objects,
        lambda e: F.struct(
            field(e, "text").alias("text"),
            F.coalesce(F.nullif(field(e, "canonical_name"), F.lit("")), field(e, "text")).alias("canonical_name"),
            F.coalesce(F.nullif(F.upper(field(e, "type")), F.lit("")), F.lit("OTHER")).alias("type"),
            F.when(F.lower(field(e, "role")) == "primary", "primary").otherwise("secondary").alias("role"),
        ),
    )
    return first_by(F.filter(filled, lambda e: e.text != ""), lambda e: F.concat(casefold(e.canonical_name), F.lit("\x00"), e["type"]))


def first_by(items: Column, key) -> Column:
    """Items of an array whose key has not occurred before, in order. [ORD-07, ORD-08]"""
    # One sort by key and place; arrays are bound to a lambda's variable, as they would be made again for every item.
    bind = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)

    def firsts(xs: Column) -> Column:
        ordered = F.sort_array(F.transform(xs, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))
        new = lambda s: F.filter(s, lambda e, j: e["k"].isNotNull() & ((j == 0) | ~F.get(s, j - 1)["k"].eqNullSafe(e["k"])))
        places = F.sort_array(F.transform(bind(ordered, new), lambda e: e["i"]))
        return F.transform(places, lambda i: F.get(xs, i))

    return bind(items, firsts)


def distinct_tags(tags: Column) -> Column:
    """Squeezed tags, the first of each in either case, blank ones out. [ORD-07]"""
    clean = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), squeeze), lambda t: t != "")
    return first_by(clean, F.lower)


def parse_rewrite(raw: Column) -> Column:
    """headline, summary and section of a model's JSON answer; null unless all are there and the section is known. [FN-18]"""
    got = F.from_json(raw, "headline STRING, summary STRING, section STRING")
    clean = F.struct(squeeze(got.headline).alias("headline"), squeeze(got.summary).alias("summary"), squeeze(got.section).alias("section"))
    return F.when((squeeze(got.headline) != "") & (squeeze(got.summary) != "") & squeeze(got.section).isin(*schemas.SECTIONS), clean)


def fallback_rewrite(title: Column, description: Column, article: Column | None = None) -> Column:
    """Title and description of a story in section Other; what it lacks comes from its representative article (title, description). [FN-19]"""
    article = F.lit(None).cast("struct<title: string, description: string>") if article is None else article
    some = lambda *values: F.coalesce(*[F.nullif(squeeze(v), F.lit("")) for v in values[:-1]], F.lit(values[-1]))
    return F.struct(
        some(title, article.title, "Untitled story").alias("headline"),
        some(description, article.description, "No description available.").alias("summary"),
        F.lit("Other").alias("section"),
    )


def edition_date_text(value: Column) -> Column:
    """dd Month yyyy; other text as it is. [FN-20]"""
    d = F.when(value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(value, F.lit("yyyy-M-d")))
    return F.coalesce(F.date_format(d, "dd MMMM yyyy"), value)


def published_text(value: Column) -> Column:
    """dd Mon · HH:MM IST; other text as it is. [FN-20]"""
    ts = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(value))
    return F.coalesce(F.concat(F.date_format(F.from_utc_timestamp(ts, "Asia/Kolkata"), "dd MMM · HH:mm"), F.lit(" IST")), value)


def pretty_date(value: Column) -> Column:
    """dd Mon yyyy · HH:MM as written, without a change of zone. [FN-21]"""
    local = F.try_to_timestamp(F.regexp_replace(F.substring(value, 1, 19), "T", " "))
    return F.coalesce(F.date_format(F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), local), "dd MMM yyyy · HH:mm"), value, F.lit(""))


def default_edition_date() -> Column:
    """Today in Kolkata. [FN-22]"""
    return F.to_date(F.from_utc_timestamp(F.current_timestamp(), "Asia/Kolkata"))


def utc_now() -> Column:
    """[FN-23]"""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssxxx")


def run_id() -> Column:
    """[FN-23]"""
    return F.date_format(F.current_timestamp(), "yyyyMMdd'T'HHmmss'Z'")


def html_escape(x: Column) -> Column:
    """[FN-24]"""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(char), F.lit(name))
    return x


def data_uri(payload: Column) -> Column:
    """[FN-24]"""
    # Spark breaks base64 into lines of 76 characters.
    return F.concat(F.lit("data:image/png;base64,"), F.replace(F.base64(payload), F.lit("\r\n"), F.lit("")))


def safe_tags(tags_json: Column) -> Column:
    """A JSON list of strings, empty if it is none. [FN-25, PRJ-05]"""
    return F.coalesce(F.from_json(tags_json, "array<string>"), F.array().cast("array<string>"))


def normal_email(x: Column) -> Column:
    """[FN-27]"""
    return F.lower(F.trim(x))


def valid_email(x: Column) -> Column:
    """At most 254 characters, one @ and a dot behind it. [FLT-15]"""
    return (F.length(x) <= 254) & x.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def article_text(title: Column, description: Column) -> Column:
    """[PRJ-07]"""
    return F.concat(F.lit("Title: "), title, F.lit("\nDescription: "), description)


def story_prompt(story_id: Column, articles: Column) -> Column:
    """The story's id and numbered records, titles cut to 240 characters and descriptions to 500. [PRJ-08]"""
    cut = lambda x, n: F.substring(F.coalesce(x, F.lit("")), 1, n)
    records = F.transform(
        articles,
        lambda a, i: F.concat(
            (i + 1).cast("string"), F.lit(". Publisher: "), F.coalesce(a.source_name, a.source_id, F.lit("")),
            F.lit("\nTitle: "), cut(a.title, 240), F.lit("\nDescription: "), cut(squeeze(a.description), 500),
        ),
    )
    return F.concat_ws("\n\n", F.concat(F.lit("Story ID: "), F.coalesce(story_id, F.lit(""))), F.lit("Contributing RSS records:"), records)
