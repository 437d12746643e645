"""Digest rendering: one row holds one digest, its articles already ranked.

``articles`` is an array of structs with title, url, quality_score and summary.
A digest is a top-n, so that array is bounded by n and one row is a fair unit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.binding import bind
from feedloom.functions.text import digest_date, escape_html

# Byte limits of a chunk before a new block and before the footer.
BLOCK_LIMIT = 3500
FOOTER_LIMIT = 3900


@dataclass(frozen=True)
class Style:
    """Wording of a digest. Titles and footer are inserted as they are, unescaped."""

    title: str = "DAILY DIGEST"
    markdown_title: str = "Daily Digest"
    footer: str = "<i>Clean, ranked & delivered</i> 🤖"
    empty: str = "No new high-quality articles processed today. Check back tomorrow!\n"
    markdown_empty: str = "No new high-quality articles processed today.\n"


def header(date: Column, style: Style) -> Column:
    return F.concat(F.lit(f"🚀 <b>{style.title}</b>\n<i>"), digest_date(date), F.lit("</i>\n\n"))


def article_block(rank: Column, article: Column) -> Column:
    # Fixed wording of one digest entry.
    return F.format_string(
        '<b>#%d: <a href="%s">%s</a></b>\n'
        "⭐ <b>Quality Score:</b> %d/10\n"
        "📝 <b>Summary:</b>\n%s\n\n"
        "─────────────────────\n\n",
        rank,
        escape_html(article["url"]),
        escape_html(article["title"]),
        article["quality_score"],
        escape_html(article["summary"]),
    )


def html_chunks(date: Column, articles: Column, style: Style = Style()) -> Column:
    """Greedy packing of whole blocks by bytes, as an array of messages."""

    def pack(head: Column) -> Column:
        def add(state: Column, block: Column) -> Column:
            full = (F.octet_length(state["open"]) + F.octet_length(block) > BLOCK_LIMIT) & (
                F.octet_length(state["open"]) > F.octet_length(head)
            )
            return F.struct(
                F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"),
                F.when(full, block).otherwise(F.concat(state["open"], block)).alias("open"),
            )

        def finish(state: Column) -> Column:
            foot = F.lit(style.footer)
            apart = F.octet_length(state["open"]) + F.octet_length(foot) > FOOTER_LIMIT
            return F.concat(
                state["done"],
                F.when(apart, F.array(state["open"], foot)).otherwise(F.array(F.concat(state["open"], foot))),
            )

        blocks = F.transform(articles, lambda a, i: article_block(i + 1, a))
        start = F.struct(F.array().cast("array<string>").alias("done"), head.alias("open"))
        return F.aggregate(blocks, start, add, finish)

    empty = F.coalesce(F.size(articles), F.lit(0)) <= 0
    return bind(
        header(date, style),
        lambda head: F.when(empty, F.array(F.concat(head, F.lit(style.empty)))).otherwise(pack(head)),
    )


def html_text(chunks: Column) -> Column:
    return F.array_join(chunks, "\n\n")


def markdown_text(date: Column, articles: Column, style: Style = Style()) -> Column:
    # Fixed wording of the Markdown form; nothing is escaped in it.
    def entry(a: Column, i: Column) -> Column:
        return F.format_string(
            "### %d. [%s](%s)\n**Quality Score:** %d/10\n\n%s\n\n---\n\n",
            i + 1, a["title"], a["url"], a["quality_score"], a["summary"],
        )

    top = F.concat(F.lit(f"# 🚀 {style.markdown_title}\n*"), digest_date(date), F.lit("*\n\n"))
    empty = F.coalesce(F.size(articles), F.lit(0)) <= 0
    body = F.when(empty, F.lit(style.markdown_empty)).otherwise(F.array_join(F.transform(articles, entry), ""))
    return F.concat(top, body)
