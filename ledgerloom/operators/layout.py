"""Page layout: boxes of a page to its text in reading order, by sweeps over intervals.

One step serves four times: boxes sorted along an axis begin a new island where none before reaches. Islands of x are text
columns, islands of y within a column are lines, of lines paragraphs, and islands of y within a table are its rows. All are
windows over a page or a part of one, so a page's boxes, which its paper bounds, are the largest group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.sources.files import image_coverage

# The gap that makes a text column, and below how many boxes a page is one column.
COLUMN_GAP, LEAST_BOXES = 20.0, 4
#: How far two boxes may overlap and still be of two lines or rows, and the gap between lines that ends a paragraph.
LINE_OVERLAP, PARAGRAPH_GAP = 2.0, 6.0
CELL_SEPARATOR = " | "
PAGE = ["path", "page"]


def islands(rows: DataFrame, keys: list[str], low: str, high: str, gap: float, name: str, ties: list[str] | None = None) -> DataFrame:
    """rows with name: the number, from 0, of the island of [low, high] that each is in. A new one begins where low is more
    than gap beyond all before (a negative gap lets islands overlap by so much)."""
    order = Window.partitionBy(*keys).orderBy(low, high, *(ties or []))
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col(low) > reach + gap, F.lit(False)).cast("int")
    return rows.withColumn("_begins", begins).withColumn(name, F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")


def _in_order(what: Column, *order: Column, separator: str) -> Column:
    """what of a group's rows, in order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], what.alias("text")))), lambda x: x["text"]), separator)


def in_columns(boxes: DataFrame, gap: float = COLUMN_GAP, least: int = LEAST_BOXES) -> DataFrame:
    """boxes with text_column; a page of few boxes has one column."""
    rows = islands(boxes, PAGE, "x0", "x1", gap, "text_column")
    few = F.count("*").over(Window.partitionBy(*PAGE)) < least
    return rows.withColumn("text_column", F.when(few, 0).otherwise(F.col("text_column")))


def lines(words: DataFrame) -> DataFrame:
    """path, page, text_column, line, y0, y1, x0, text of words that are in columns: those level with one another, from
    left to right."""
    rows = islands(words, [*PAGE, "text_column"], "y0", "y1", -LINE_OVERLAP, "line", ["x0", "text"])
    return rows.groupBy(*PAGE, "text_column", "line").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), _in_order(F.col("text"), F.col("x0"), F.col("text"), separator=" ").alias("text"))


def table_rows(cells: DataFrame) -> DataFrame:
    """path, page, table_no, row, text of table cells: a line for each row, cells from left to right."""
    rows = islands(cells, [*PAGE, "table_no"], "y0", "y1", -LINE_OVERLAP, "row", ["x0", "text"])
    return rows.groupBy(*PAGE, "table_no", "row").agg(_in_order(F.col("text"), F.col("x0"), F.col("text"), separator=CELL_SEPARATOR).alias("text"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """path, page, block_index, kind, text_column, text: the blocks of each page in the order they are read.

    boxes has path, page, kind, x0, y0, x1, y1, text, table_no. Boxes of kind block are read as they are, words are put
    together to lines and lines to paragraphs, cells to one block for each table, a line for each row; tables come last,
    beside the prose that they stand in. Columns are read one after the other, from top to bottom; blocks that stand
    level are read from left to right. Blank or null texts and other kinds (images) are no blocks; edges of a box may come
    in either order. A box that comes twice is read twice.
    """
    edge = lambda a, b, of: of(F.col(a), F.col(b)).cast("double")
    clean = boxes.select(*PAGE, "kind", edge("x0", "x1", F.least).alias("x0"), edge("y0", "y1", F.least).alias("y0"), edge("x0", "x1", F.greatest).alias("x1"), edge("y0", "y1", F.greatest).alias("y1"), F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("text"), F.coalesce("table_no", F.lit(0)).cast("int").alias("table_no")).where("text <> ''")
    prose = in_columns(clean.where("kind in ('block', 'word')"))
    blocks = prose.where("kind = 'block'").select(*PAGE, "kind", "text_column", "y0", "x0", "text")
    parts = islands(lines(prose.where("kind = 'word'")), [*PAGE, "text_column"], "y0", "y1", PARAGRAPH_GAP, "part", ["line"])
    paragraphs = parts.groupBy(*PAGE, "text_column", "part").agg(F.min("y0").alias("y0"), F.min("x0").alias("x0"), _in_order(F.col("text"), F.col("line"), separator="\n").alias("text"))
    tables = table_rows(clean.where("kind = 'cell'")).groupBy(*PAGE, "table_no").agg(_in_order(F.col("text"), F.col("row"), separator="\n").alias("text"))
    none = F.lit(None).cast("int")
    rows = blocks.withColumn("table_no", none).unionByName(paragraphs.select(*PAGE, F.lit("paragraph").alias("kind"), "text_column", "y0", "x0", "text", none.alias("table_no")))
    rows = rows.unionByName(tables.select(*PAGE, F.lit("table").alias("kind"), F.lit(None).cast("long").alias("text_column"), F.lit(None).cast("double").alias("y0"), F.lit(None).cast("double").alias("x0"), "text", "table_no"))
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.col("table_no").asc_nulls_first(), "text_column", F.bround("y0", 1), "x0", "text"))
    return rows.select(*PAGE, (place - 1).alias("block_index"), "kind", F.col("text_column").cast("int").alias("text_column"), "text")


def pages_of(boxes: DataFrame) -> DataFrame:
    """path, page, text, has_table, image_share of each page from its boxes (with page_area): what read_pages() takes,
    once it has the page's image. A page without blocks has no text."""
    blocks = reading_order(boxes)
    texts = blocks.groupBy(*PAGE).agg(_in_order(F.col("text"), F.col("block_index"), separator="\n\n").alias("text"), F.bool_or(F.col("kind") == "table").alias("has_table"))
    share = image_coverage(boxes)
    return share.join(texts, PAGE, "left").select(*PAGE, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("has_table", F.lit(False)).alias("has_table"), "image_share")
