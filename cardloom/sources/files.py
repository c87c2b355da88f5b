"""Readers and writers: CSV, JSON, NDJSON, manifests, HTML checklists, images and nested feeds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions.expr import normalize_text
from cardloom.operators.tables import latest


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, blank lines dropped, quotes doubled inside quoted cells, cells trimmed, short rows filled with ''."""
    rows = spark.read.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("mode", "PERMISSIVE").csv(path)
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿").strip()) for c in rows.columns])


def header_line(spark: SparkSession, path: str, names: list[str], first: int = 20, enough: int = 3) -> int:
    """Which of the first lines of a file is its header: the first with enough of the names, else the one with most."""
    lines = [row["value"] for row in spark.read.text(path).limit(first).collect()]
    wanted = {n.lower() for n in names}
    counts = [len(wanted & {cell.strip().strip('"').lower() for cell in line.split(",")}) for line in lines]
    return next((i for i, n in enumerate(counts) if n >= enough), counts.index(max(counts)) if counts else 0)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """One CSV folder in the given column order; cells with commas, quotes or line ends are quoted, rows end with CRLF."""
    rows.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\r\n").csv(path)


def read_records(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ("data", "cards", "checklist")) -> DataFrame:
    """Rows of a JSON array, or of the array under one of the keys of a JSON object."""
    whole = spark.read.option("wholetext", True).text(path)
    lists = [F.from_json("value", f"array<struct<{schema}>>")] + [F.from_json(F.get_json_object("value", f"$.{k}"), f"array<struct<{schema}>>") for k in keys]
    flat = F.when(F.trim("value").startswith("["), lists[0]).otherwise(F.coalesce(*lists[1:]))
    return whole.select(F.inline(flat))


def read_ndjson(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parsed rows, and the lines that are no JSON objects."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.withColumn("_row", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = parsed.filter("_row._bad IS NULL").select("_row.*").drop("_bad")
    return good, parsed.filter("_row._bad IS NOT NULL").select("value")


def read_manifest(spark: SparkSession, path: str, schema: str, state: str = "authorization_state") -> DataFrame:
    """Manifest rows whose use is not prohibited."""
    return spark.read.schema(schema).json(path).filter(~F.coalesce(F.col(state).isin("PROHIBITED", "QUARANTINED"), F.lit(False)))


def union_tables(tables: list[DataFrame], key: str, order: str = "_at") -> DataFrame:
    """All rows by column name; of rows that share a key those of the first table stay."""
    out = None
    for at, rows in enumerate(tables):
        part = rows.withColumn(order, F.lit(at))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return latest(out, [key], order).drop(order)


def html_text(html: Column) -> Column:
    """The visible text of a page: scripts and styles out, block tags as line ends, entities decoded, blanks trimmed."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<(br|/?p|/?div|/?li|/?tr|/?h[1-6]|/?td|/?ul|/?article|/?nav)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, letter in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(letter))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t\x0B\f\r]+", " "), r" ?\n[ \n]*", "\n"))


def html_checklist(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, card_number, subject: lines of a page that read number, separator, subject; the first of each number."""
    lines = pages.select(key, F.posexplode(F.split(html_text(F.col(html)), "\n")).alias("at", "line"))
    found = lines.withColumns({"card_number": F.regexp_extract("line", r"^#?([A-Za-z]{0,5}-?\d{1,4}[A-Za-z]?)\s*(?:[-.:|]|\s)\s*(\S.*)$", 1), "subject": F.trim(F.regexp_extract("line", r"^#?([A-Za-z]{0,5}-?\d{1,4}[A-Za-z]?)\s*(?:[-.:|]|\s)\s*(\S.*)$", 2))})
    kept = found.filter((F.col("card_number") != "") & ~F.col("subject").rlike(r"(?i)\b(packs?|box(es)?|odds|cards per)\b"))
    return latest(kept, [key, "card_number"], "at").select(key, "card_number", "subject")


def explode_prints(cards: DataFrame) -> DataFrame:
    """One row for each print of a card with nested sets; cards without sets stay with null ones."""
    return cards.select("id", "name", F.explode_outer("card_sets").alias("s")).select(
        F.concat_ws(":", "id", F.coalesce("s.set_code", F.lit("none"))).alias("print_id"), "name", F.col("s.set_name").alias("set_name"), F.col("s.set_code").alias("card_number"), F.col("s.set_rarity").alias("parallel")
    )


def explode_orders(orders: DataFrame) -> DataFrame:
    """One sale for each line of a seller's order, its raw id from the line, else from order and sku."""
    lines = orders.select("order_id", "created", F.explode("lines").alias("l"))
    raw = F.coalesce(F.nullif("l.line_id", F.lit("")), F.concat_ws(":", "order_id", "l.sku"))
    return lines.select(raw.alias("raw_id"), "l.title", F.col("l.total").alias("price"), F.col("created").alias("sold_at"))


def flatten_messages(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row for each message and each change of a webhook payload, with the reason where one is ignored."""
    schema = "entry array<struct<id:string,messaging:array<struct<sender:struct<id:string>,timestamp:bigint,message:struct<mid:string,text:string,is_echo:boolean>>>,changes:array<struct<field:string,value:struct<id:string,text:string>>>>>"
    entries = payloads.select(F.explode(F.from_json(body, schema)["entry"]).alias("e")).select("e.*")
    messages = entries.select("id", F.explode("messaging").alias("m")).select(
        F.lit("message").alias("kind"), F.col("id").alias("account"), F.col("m.message.mid").alias("event_id"), F.col("m.sender.id").alias("sender"), F.col("m.message.text").alias("text"),
        F.when(F.col("m.message.mid").isNull(), "missing_id").when(F.coalesce("m.message.is_echo", F.lit(False)), "echo").alias("ignored"),
    )
    changes = entries.select("id", F.explode("changes").alias("c")).select(
        F.lit("comment").alias("kind"), F.col("id").alias("account"), F.col("c.value.id").alias("event_id"), F.lit(None).cast("string").alias("sender"), F.col("c.value.text").alias("text"),
        F.when(F.col("c.value.id").isNull(), "missing_id").when(~F.col("c.field").isin("comments", "feed"), "unsupported_field").alias("ignored"),
    )
    return messages.unionByName(changes)


def image_sizes(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg,webp}") -> DataFrame:
    """path, kind, width, height of image files, from their headers; null for what is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)

    @F.pandas_udf("kind string, width int, height int")
    def size(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([header_size(content) for content in batch], columns=["kind", "width", "height"])

    return files.select("path", size("content").alias("s")).select("path", "s.*")


def header_size(data: bytes) -> tuple[str | None, int | None, int | None]:
    """Kind and pixels of a PNG, JPEG or lossy WebP file by its published header layout."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "png", int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8 " and len(data) >= 30:
        return "webp", int.from_bytes(data[26:28], "little") & 0x3FFF, int.from_bytes(data[28:30], "little") & 0x3FFF
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            if data[at + 1] in (0xC0, 0xC1, 0xC2, 0xC3):
                return "jpeg", int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None, None, None


def resolve_images(cards: DataFrame, overrides: DataFrame, sale_images: DataFrame, placeholder: str = "/assets/card-placeholder.svg") -> DataFrame:
    """card_id, image, origin: an override, the card's own image, the newest image of its sales, or the placeholder."""
    newest = sale_images.groupBy("card_id").agg(F.max_by("image", F.struct("sold_at", "image")).alias("_sale"))
    joined = cards.select("card_id", "image").join(overrides.select("card_id", F.col("image").alias("_over")), "card_id", "left").join(newest, "card_id", "left")
    choice = F.coalesce(F.nullif("_over", F.lit("")), F.nullif("image", F.lit("")), "_sale", F.lit(placeholder))
    origin = F.when(F.nullif("_over", F.lit("")).isNotNull(), "override").when(F.nullif("image", F.lit("")).isNotNull(), "card").when(F.col("_sale").isNotNull(), "sale").otherwise("placeholder")
    return joined.select("card_id", choice.alias("image"), origin.alias("origin"))


def page_words(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Words of a page's visible text, normalised."""
    return pages.select(key, F.size(F.filter(F.split(normalize_text(html_text(F.col(html))), " "), lambda w: w != "")).cast("long").alias("words"))
