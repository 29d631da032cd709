"""Sinks: JSON, exports, editions as HTML and text, mail behind a protocol, an append-only delivery ledger."""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import schemas
from broadsheet.functions import text as T
from broadsheet.operators.selection import by_section, source_list
from broadsheet.session import cut

#: The columns of an annotation export.
EXPORT_COLUMNS = (
    "run_id", "article_id_a", "article_id_b", "title_a", "title_b", "reference_article_id", "label", "notes", "annotator_id", "updated_at",
)


def relative_path(path: str, root: str) -> str:
    """A path below a root, or as it is elsewhere. [FN-26]"""
    root = root.rstrip("/") + "/"
    return path.removeprefix(root)


def write_payloads(payloads: DataFrame, path: str) -> None:
    """Raw bytes as a binary column. [SNK-01]"""
    payloads.write.mode("overwrite").parquet(path)


def write_document(df: DataFrame, path: str) -> None:
    """A frame of one row as indented JSON; characters beyond ASCII stay as they are. [SNK-02]"""
    df.coalesce(1).select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_json_lines(df: DataFrame, path: str, *partitions: str) -> None:
    """JSON lines; with partitions only those that occur are replaced. [SNK-03, SNK-04]"""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partitions) if partitions else writer).json(path)


def write_run(path: str, **artifacts: DataFrame) -> None:
    """Each artifact of a run as a table below its path. [SNK-05]"""
    for name, df in artifacts.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def export_annotations(annotations: DataFrame, articles: DataFrame, path: str, run: DataFrame | None = None) -> DataFrame:
    """Ordered JSON lines, CSV and a summary, which is returned too (one row). run: one row of annotation runs. [SNK-06, SRT-07, AGG-07]"""
    from broadsheet.operators.annotate import label_counts, saved_annotations

    path = path.rstrip("/")
    rows = saved_annotations(annotations, articles).select(*EXPORT_COLUMNS).orderBy("article_id_a", "article_id_b", "annotator_id")
    rows.write.mode("overwrite").json(f"{path}/jsonl")
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    counts = label_counts(annotations).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_counts"))
    summary = articles.agg(F.count("*").alias("article_count")).crossJoin(rows.agg(F.count("*").alias("pair_count"))).crossJoin(counts)  # one row each
    summary = summary.withColumns({"exported_at": T.utc_now(), "files": F.array(F.lit("jsonl"), F.lit("csv"))})
    known = ("manifest_id", "manifest_path", "tool_version", "schema_version")
    summary = run.select(*known).limit(1).crossJoin(summary) if run is not None else summary
    summary = cut(summary)
    write_document(summary, f"{path}/summary")
    return summary


def edition_lines(selected: DataFrame) -> DataFrame:
    """(section_rank, position, headline, summary, byline, url) in the order of the edition. [SNK-08, FLT-18]"""
    byline = F.concat(F.coalesce("source_name", F.lit("")), F.lit(" · "), T.published_text(F.coalesce("published_at", F.lit(""))))
    return by_section(selected).select("section_rank", "section", "position", "headline", "summary", byline.alias("byline"), "url")


def _joined(rows: DataFrame, block: Column, head: Column, separator: str) -> Column:
    return F.concat(head, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", block.alias("b")))), lambda x: x.b), separator))


def edition_text(selected: DataFrame, title: str, date: str, farewell: str) -> DataFrame:
    """One row: the plain text of an edition. [SNK-08]"""
    block = F.concat_ws("\n", "headline", "summary", "byline", "url", F.lit(""))
    head = F.concat(F.upper(F.first("section")), F.lit("\n"), F.repeat(F.lit("="), F.length(F.first("section"))), F.lit("\n"))
    parts = edition_lines(selected).groupBy("section_rank").agg(_joined(selected, block, head, "\n").alias("part"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_rank", "part"))), lambda x: x.part), "\n")
    shown = T.edition_date_text(F.lit(date))
    return parts.agg(F.concat_ws("\n", F.lit(title.upper()), shown, F.lit(""), body, F.lit(farewell), F.lit("")).alias("text"))


def edition_html(selected: DataFrame, title: str, date: str, logo: str | None = None, unsubscribe: str = "Reply to this email to unsubscribe.") -> DataFrame:
    """One row: a plain HTML page of an edition; every text is escaped. [SNK-07, FN-24, AGG-15, AGG-19]

    It has the numbers of stories and publishers, each section's number of stories, each story's number of reports, the list of sources, and
    the logo, if there is one (an address or data URI).
    """
    for name, kind in (("source_id", "string"), ("article_count", "long"), ("url", "string")):
        selected = selected if name in selected.columns else selected.withColumn(name, F.lit(None).cast(kind))
    e = lambda c: T.html_escape(F.coalesce(F.col(c), F.lit("")))
    some = lambda n, one, many: F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))
    reports = F.greatest(F.coalesce(F.col("article_count"), F.lit(1)), F.lit(1))
    rows = edition_lines(selected).join(selected.select("position", reports.alias("reports")), "position")
    block = F.concat(
        F.lit("<article><h3><a href=\""), e("url"), F.lit("\">"), e("headline"), F.lit("</a></h3><p>"), e("summary"), F.lit("</p><p>"), e("byline"), F.lit(" · "),
        some(F.col("reports"), "report", "reports"), F.lit("</p></article>"),
    )
    head = F.concat(F.lit("<section><h2>"), T.html_escape(F.first("section")), F.lit("</h2><p>"), some(F.count("*"), "story", "stories"), F.lit("</p>\n"))
    parts = rows.groupBy("section_rank").agg(F.concat(_joined(selected, block, head, "\n"), F.lit("\n</section>")).alias("part"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_rank", "part"))), lambda x: x.part), "\n")
    page = parts.agg(F.coalesce(F.nullif(body, F.lit("")), F.lit("<p>No stories were selected for this edition.</p>")).alias("body"))
    publishers = F.count_distinct(F.nullif("source_id", F.lit("")))
    meta = F.when(F.count("*") > 0, F.concat(some(F.count("*"), "story", "stories"), F.lit(" · "), some(publishers, "publisher", "publishers")))
    counts = selected.agg(F.coalesce(meta, F.lit("A focused daily edition")).alias("meta"))
    named = F.when(F.col("url") != "", F.concat(F.lit("<a href=\""), e("url"), F.lit("\">"), e("label"), F.lit("</a>"))).otherwise(e("label"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("<li>"), named, F.lit("</li>")).alias("li")))), lambda x: x.li)
    sources = source_list(selected, with_url=True).agg(F.when(F.count("*") > 0, F.concat(F.lit("<h2>Sources in this edition</h2><ul>"), F.array_join(listed, ""), F.lit("</ul>\n"))).otherwise("").alias("sources"))
    mark = F.concat(F.lit("<img alt=\"\" src=\""), T.html_escape(F.lit(logo)), F.lit("\">")) if logo else F.lit("")
    shown, name = T.html_escape(T.edition_date_text(F.lit(date))), T.html_escape(F.lit(title))
    return page.crossJoin(counts).crossJoin(sources).select(  # one row each
        F.concat(
            F.lit("<!doctype html><title>"), name, F.lit("</title>"), mark, F.lit("<h1>"), name, F.lit("</h1><p>"), shown, F.lit("</p><p>"), F.col("meta"), F.lit("</p>\n"),
            F.col("body"), F.lit("\n"), F.col("sources"), F.lit("<p>"), T.html_escape(F.lit(unsubscribe)), F.lit("</p>\n"),
        ).alias("html")
    )


class MailSender(Protocol):
    """Sends an edition and returns the number of recipients; lives in the driver only. [UDF-04, SNK-09]"""

    def send(self, edition: dict, html: str, text: str) -> int: ...


def post_json(url: str, user: str, password: str, data: dict, timeout: float = 30) -> tuple[int, str]:
    """Status and text of the answer to JSON that is posted with basic authentication."""
    token = base64.b64encode(f"{user}:{password}".encode()).decode()
    request = urllib.request.Request(url, json.dumps(data).encode(), {"Content-Type": "application/json", "Authorization": f"Basic {token}"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as got:
            return got.status, got.read().decode(errors="replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")


class HttpMailSender:
    """Posts an edition to a mail service, one message for all recipients; any status but 200 raises. [SNK-09, UDF-04]

    settings: url, key, secret, sender, sender_name, recipients (list), reply_to (may be missing); post: see post_json.
    """

    def __init__(self, settings: dict, logo: bytes | None = None, post: Callable[[str, str, str, dict], tuple[int, str]] = post_json):
        if missing := [k for k in ("url", "key", "secret", "sender", "recipients") if not settings.get(k)]:
            raise ValueError(f"missing mail settings: {', '.join(missing)}")
        self.settings, self.logo, self.post = settings, logo, post

    def send(self, edition: dict, html: str, text: str) -> int:
        s = self.settings
        # The field names of the service.
        message = {
            "From": {"Email": s["sender"], "Name": s.get("sender_name", "")}, "To": [{"Email": r} for r in s["recipients"]], "Subject": f"Daily Briefing — {edition['edition_date']}",
            "TextPart": text, "HTMLPart": html, "CustomID": f"edition-{edition['edition_date']}",
        }
        if s.get("reply_to"):
            message["ReplyTo"] = {"Email": s["reply_to"]}
        if self.logo:
            message["InlinedAttachments"] = [{"ContentType": "image/png", "Filename": "logo.png", "ContentID": "logo.png", "Base64Content": base64.b64encode(self.logo).decode()}]
        status, answer = self.post(s["url"], s["key"], s["secret"], {"Messages": [message]})
        if status != 200:
            raise RuntimeError(f"mail was not sent ({status}): {answer}")
        return len(s["recipients"])


def may_send(ledger: DataFrame, edition_date: str, story_run_id: str, force: bool = False) -> bool:
    """Whether the ledger has no ``sent`` mark of this edition. [SNK-10]"""
    if force:
        return True
    sent = ledger.where((F.col("edition_date") == edition_date) & (F.col("story_run_id") == story_run_id) & (F.col("status") == "sent"))
    return sent.limit(1).count() == 0


def deliver(ledger: DataFrame, ledger_path: str, edition: dict, html: str, text: str, sender: MailSender | None, minimum_items: int = 5, force: bool = False) -> str:
    """Hold, preview or send an edition, and append the outcome to the ledger; a sent mark is never lost. [SNK-09, SNK-10, FLT-12]"""
    date, run = edition["edition_date"], edition["story_run_id"]
    count = 0
    if len(edition["stories"]) < minimum_items:
        status = "held"
    elif sender is None:
        status = "preview"
    elif not may_send(ledger, date, run, force):
        status = "refused"
    else:
        count, status = sender.send(edition, html, text), "sent"
    spark = ledger.sparkSession
    row = spark.createDataFrame([(date, run, status, count)], "edition_date string, story_run_id string, status string, recipients bigint").withColumn("at", T.utc_now())
    row.write.mode("append").parquet(ledger_path)
    return status
