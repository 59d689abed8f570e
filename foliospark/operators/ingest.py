"""Ingest: uploads routed by extension, elements gathered to one guarded text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as t
from foliospark.functions import wording as w
from foliospark.operators.enrich import Providers, call


#: Message of a file that its reader gave nothing for.
UNREAD = "the file could not be read"


def accept(files: DataFrame) -> DataFrame:
    """``files(name, …)`` with ext and route; names with other extensions are left out."""
    return files.withColumn("ext", t.extension(F.col("name"))).withColumn("route", t.route(F.col("name"))).where("route is not null")


def element_block(kind, text, html):
    """The block that an element of a document adds, null for none."""
    table = F.when(F.coalesce(html, F.lit("")) != "", F.concat(F.lit(f"\n{w.TABLE_CAPTION}\n"), html, F.lit("\n"))).otherwise(F.concat(F.lit(f"\n{w.PLAIN_TABLE_CAPTION}\n"), F.coalesce(text, F.lit("")), F.lit("\n")))
    return F.when(kind == "Table", table).when(kind.isin("Title", "NarrativeText", "Text", "ListItem"), text)


def media_blocks(files: DataFrame, providers: Providers) -> DataFrame:
    """(file, pos, block, n_elements, error) of accepted images and videos, through their providers.

    A text is captioned and counts as one element; a failure leaves its own block, counts as none and is no error.
    """
    read = F.when(F.col("route") == "image", call(providers.read_image, "string", F.col("content"))).when(F.col("route") == "video", call(providers.read_speech, "string", F.col("content")))
    rows = files.where("route in ('image', 'video')").withColumn("__text", read)
    caption = F.when(F.col("route") == "image", F.lit(w.OCR_CAPTION)).otherwise(F.lit(w.SPEECH_CAPTION))
    failed = F.when(F.col("route") == "image", t.fill(w.OCR_FAILED, F.lit("no text"))).otherwise(t.fill(w.SPEECH_FAILED, F.lit("no text")))
    block = F.when(F.col("__text").isNull(), F.concat(F.lit("\n"), failed, F.lit("\n"))).otherwise(F.concat(F.lit("\n"), caption, F.lit("\n"), F.col("__text"), F.lit("\n")))
    return rows.select(F.col("name").alias("file"), F.lit(0).alias("pos"), block.alias("block"), F.when(F.col("__text").isNull(), 0).otherwise(1).alias("n_elements"), F.lit(None).cast("string").alias("error"))


def document_blocks(files: DataFrame, providers: Providers) -> DataFrame:
    """(file, pos, block, n_elements, error) of accepted documents through the partition provider; all elements count.

    A file without elements gives one row without a block, one that the provider could not read a row with
    an error, so that no file is lost.
    """
    rows = files.where("route = 'document'").select(F.col("name").alias("file"), call(providers.partition, "array<struct<kind:string,text:string,html:string>>", F.col("content")).alias("parts"))
    rows = rows.select("file", F.when(F.col("parts").isNull(), F.lit(UNREAD)).alias("error"), F.posexplode_outer("parts").alias("pos", "e"))
    return rows.select("file", F.coalesce("pos", F.lit(0)).alias("pos"), element_block(F.col("e.kind"), F.col("e.text"), F.col("e.html")).alias("block"), F.when(F.col("e").isNull(), 0).otherwise(1).alias("n_elements"), "error")


def office_blocks(rows: DataFrame) -> DataFrame:
    """(file, pos, block, n_elements, error) from the ``office`` source's rows, without a provider.

    Word documents and decks give a block an element, workbooks one a sheet; a file that could not be read
    one row with its error.
    """
    cells = workbook_blocks(rows.where("kind = 'Cell'")).withColumn("error", F.lit(None).cast("string"))
    rest = rows.where("kind <> 'Cell'")
    failed = F.col("kind") == "Error"
    rest = rest.select("file", "pos", element_block(F.col("kind"), F.col("text"), F.lit(None).cast("string")).alias("block"), F.when(failed, 0).otherwise(1).alias("n_elements"), F.when(failed, F.coalesce("text", F.lit(UNREAD))).alias("error"))
    return cells.unionByName(rest)


def sheet_row(*cells):
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(c.cast("string"), F.lit("")) for c in cells)), F.lit(" |"))


def sheet_text(rows: DataFrame, columns: list[str], order: str, sheet: str = "sheet") -> DataFrame:
    """(sheet, markdown, n_rows): each sheet's rows as a captioned pipe table with a header."""
    head = "| " + " | ".join(columns) + " |\n|" + "|".join(" --- " for _ in columns) + "|\n"
    body = t.join_in_order(sheet_row(*(F.col(c) for c in columns)), F.col(order), "\n")
    made = rows.groupBy(sheet).agg(body.alias("body"), F.count("*").alias("n_rows"))
    return made.select(sheet, F.concat(F.lit("\n"), t.fill(w.SHEET_CAPTION, F.col(sheet)), F.lit("\n" + head), "body", F.lit("\n")).alias("markdown"), "n_rows")


def workbook_blocks(cells: DataFrame) -> DataFrame:
    """(file, pos, block, n_elements) from a workbook's cells (file, sheet, row, col, text), a block a sheet.

    Row 0 is the header; missing cells are empty, and rows below it count as elements.
    """
    sheet = ["file", "sheet"]
    wide = cells.groupBy(*sheet).agg((F.max("col") + 1).alias("width"), F.min("pos").alias("pos"))
    rows = cells.groupBy(*sheet, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("text")))).alias("by_col"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.coalesce(F.try_element_at("by_col", k), F.lit(""))), " | ")
    rule = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("width")))
    text = F.concat(F.lit("| "), line, F.lit(" |"), F.when(F.col("row") == 0, rule).otherwise(F.lit("")))
    made = rows.join(wide, sheet).groupBy(*sheet, "pos").agg(t.join_in_order(text, F.col("row"), "\n").alias("body"), F.count_if(F.col("row") > 0).alias("n_elements"))
    return made.select("file", "pos", F.concat(F.lit("\n"), t.fill(w.SHEET_CAPTION, F.col("sheet")), F.lit("\n"), "body", F.lit("\n")).alias("block"), F.col("n_elements").cast("int").alias("n_elements"))


def parse_results(blocks: DataFrame, limit: int = w.MAX_CHARS) -> DataFrame:
    """(file, pos, block, n_elements[, error]) -> (file, status, text, element_count, char_count, message).

    Blocks in order with a blank line between, the placeholder if nothing is left, cut at ``limit``
    with a notice. The count holds elements whose block is null as well. A file with an error has that
    status, its message, and neither text nor counts.
    """
    error = F.max("error") if "error" in blocks.columns else F.lit(None).cast("string")
    joined = blocks.groupBy("file").agg(t.join_in_order(F.col("block"), F.col("pos"), "\n\n").alias("text"), F.sum("n_elements").cast("long").alias("element_count"), error.alias("message"))
    read = F.col("message").isNull()
    done = joined.withColumn("text", F.when(read, t.guard(t.or_placeholder(F.col("text")), limit)))
    return done.select("file", F.when(read, "success").otherwise("error").alias("status"), "text", F.when(read, F.col("element_count")).alias("element_count"), F.length("text").cast("long").alias("char_count"), "message")


def response(results: DataFrame) -> DataFrame:
    """What a caller sees of a parse result."""
    return results.select("status", F.col("file").alias("file_name"), "char_count", F.col("text").alias("extracted_text"))
