"""The order-dependent line stages as windows: one exchange by document, everything else sorts and streams.

The row-local kernels do the same without a shuffle; this form is for line tables that exist already, and keeps every
stage in SQL. A document's lines are its window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import text as X

BLOCK_LINES, EDGE_LINES, LEAST_BLOCKS, LEAST_KEY, MOST_KEY, PRESENCE = 12, 2, 6, 12, 160, 0.8


def exploded(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, line_idx, line), a row per line."""
    return df.select(id_col, F.posexplode(X.lines_of(F.col(text_col))).alias("line_idx", "line"))


def rejoined(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of a line table, in the order of its indices."""
    pairs = F.array_sort(F.collect_list(F.struct("line_idx", "line")))
    return lines.groupBy(id_col).agg(F.array_join(F.transform(pairs, lambda p: p["line"]), "\n").alias("text"))


Keys = str | list[str]


def _keys(id_col: Keys) -> list[str]:
    """The columns whose lines belong together: the document, or document and stage (then dead lines are apart)."""
    return [id_col] if isinstance(id_col, str) else id_col


def _order(id_col: Keys) -> Window:
    return Window.partitionBy(*_keys(id_col)).orderBy("line_idx")


#: Bytes of input, by Spark's estimate, whose lines one task sorts.
TASK_BYTES = 8 << 20


def together(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A document's lines in one partition, and as many partitions as the input's size asks for: the windows of a stage each hold a partition, so it mustn't grow with the table."""
    size = int(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = size < 1 << 50  # rows that don't come from files have no size
    return lines.repartition(max(least, min(20_000, -(-size // TASK_BYTES))) if known else least, id_col)


def noise_runs(lines: DataFrame, id_col: Keys = "doc_id") -> DataFrame:
    """lines with kind (single, axis or other), run, run_length and noise (8 single-character lines or 4 axis lines in a row)."""
    order = _order(id_col)
    kind = F.when(X.is_single(F.col("line")), "single").when(X.is_axis(F.col("line")), "axis").otherwise("other")
    out = lines.withColumn("kind", kind)
    out = out.withColumn("run", F.sum(F.coalesce((F.lag("kind").over(order) != F.col("kind")).cast("int"), F.lit(0))).over(order))
    out = out.withColumn("run_length", F.count(F.lit(1)).over(Window.partitionBy(*_keys(id_col), "run")))
    noise = ((F.col("kind") == "single") & (F.col("run_length") >= 8)) | ((F.col("kind") == "axis") & (F.col("run_length") >= 4))
    return out.withColumn("noise", noise)


def blocks(lines: DataFrame, id_col: Keys = "doc_id") -> DataFrame:
    """lines with block (0-based; null outside). A page marker opens a block, a separator or a second blank line ends it."""
    order = _order(id_col)
    line = F.col("line")
    out = lines.withColumn("blank", X.stripped(line) == "")
    out = out.withColumn("ends", X.is_separator(line) | (F.col("blank") & F.coalesce(F.lag("blank").over(order), F.lit(False))))
    out = out.withColumn("island", F.sum((F.col("ends") | X.is_page_marker(line)).cast("int")).over(order))
    filled = (~F.col("blank") & ~F.col("ends")).cast("int")
    island = Window.partitionBy(*_keys(id_col), "island")
    out = out.withColumn("n", F.sum(filled).over(island)).withColumn("before", F.sum(filled).over(island.orderBy("line_idx")))
    inside = ~F.col("ends") & (F.col("before") > 0) & (F.col("n") >= BLOCK_LINES)
    out = out.withColumn("at", F.when(inside, F.col("island")))
    opens = F.col("at").isNotNull() & (F.row_number().over(Window.partitionBy(*_keys(id_col), "at").orderBy("line_idx")) == 1)
    out = out.withColumn("opens", opens.cast("int")).withColumn("block", F.when(F.col("at").isNotNull(), F.sum("opens").over(order) - 1))
    return out.select(*lines.columns, "blank", F.col("block").cast("int").alias("block"))


def header_footer(lines: DataFrame, id_col: Keys = "doc_id") -> DataFrame:
    """lines with block, repeat_count, edge_hit_ratio and running (a header or footer that repeats over the blocks)."""
    held = blocks(lines, id_col)
    key = X.key_of(F.col("line"))
    used = F.col("block").isNotNull() & ~F.col("blank")
    held = held.withColumn("used", used).withColumn("key", F.when(used, key))
    page = Window.partitionBy(*_keys(id_col), "block", "used")
    held = held.withColumn("top", F.row_number().over(page.orderBy("line_idx"))).withColumn("bottom", F.row_number().over(page.orderBy(F.col("line_idx").desc())))
    fits = F.length("key").between(LEAST_KEY, MOST_KEY) & ~X.matches(F.col("key"), X.S.CAPTION, True) & ~X.is_guarded(F.col("key")) & ~X.is_navigation(F.col("key"))
    edge = F.col("used") & ((F.col("top") <= EDGE_LINES) | (F.col("bottom") <= EDGE_LINES)) & fits
    held = held.withColumn("edge", F.coalesce(edge, F.lit(False)))
    same = Window.partitionBy(*_keys(id_col), "key")
    held = held.withColumn("everywhere", F.size(F.collect_set(F.when(F.col("used"), F.col("block"))).over(same)))
    held = held.withColumn("edges", F.size(F.collect_set(F.when(F.col("edge"), F.col("block"))).over(same)))
    held = held.withColumn("blocks", F.max("block").over(Window.partitionBy(*_keys(id_col))) + 1)
    share = F.col("edges") / F.col("blocks")
    running = F.col("edge") & (F.col("blocks") >= 2) & (F.col("edges") >= LEAST_BLOCKS) & (F.col("edges") == F.col("everywhere")) & (share >= PRESENCE)
    held = held.withColumn("running", F.coalesce(running, F.lit(False)))
    return held.select(*lines.columns, "block", "running", F.when(F.col("running"), F.col("everywhere")).alias("repeat_count"), F.when(F.col("running"), share).alias("edge_hit_ratio"))


def references_cut(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """lines with in_references: the first references header and all lines after it."""
    head = X.is_reference_head(F.col("line")).cast("int")
    return lines.withColumn("in_references", F.max(head).over(_order(id_col)) == 1)


def decided(lines: DataFrame, id_col: str = "doc_id", bullet: str = "•") -> DataFrame:
    """lines with action, category and out (the kept line), all stages switched on; each stage sees what the one before left.

    Lines that are out already are in window partitions of their own, so no stage needs a join: one exchange in all.
    """
    line = F.col("line")
    columns = [*lines.columns, "category", "live"]

    def dropped(rows: DataFrame, hit: Column, category: str) -> DataFrame:
        rows = rows.withColumn("category", F.when(F.col("live") & hit, category).otherwise(F.col("category")))
        return rows.withColumn("live", F.col("category") == "other").select(*columns)

    rows = together(lines, id_col).withColumn("category", F.lit("other")).withColumn("live", F.lit(True))
    rows = dropped(rows, X.is_boilerplate(line), "boilerplate")
    rows = dropped(noise_runs(rows, [id_col, "live"]), F.col("noise"), "layout_noise")
    rows = dropped(rows, X.is_navigation(line), "toc_navigation")
    rows = dropped(header_footer(rows, [id_col, "live"]), F.col("running"), "header_footer")
    rows = dropped(rows.withColumn("tail", F.max(X.is_reference_head(line).cast("int")).over(_order([id_col, "live"]))), F.col("tail") == 1, "references_section")
    rows = dropped(rows, X.is_dotted(line), "toc")
    return rows.select(*lines.columns, F.when(F.col("live"), "keep").otherwise("drop").alias("action"), "category", F.when(F.col("live"), X.bullets(line, bullet)).alias("out"))


def counters(decisions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Dropped lines per category and document."""
    names = ("boilerplate", "layout_noise", "toc_navigation", "header_footer", "references_section", "toc")
    return decisions.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_lines"), *(F.count_if(F.col("category") == c).alias(f"n_{c}") for c in names))


def section_markers(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, line_idx, part, line): a marker (part 0) before each title line (part 1), unless the line before is that marker."""
    marker = F.concat(F.lit("## SECTION: "), X.stripped(F.col("line")))
    before = F.lag("line").over(_order(id_col))
    wanted = X.is_title(F.col("line")) & (before.isNull() | (X.stripped(before) != marker))
    parts = F.when(wanted, F.array(F.struct(F.lit(0).alias("part"), marker.alias("line")), F.struct(F.lit(1).alias("part"), F.col("line").alias("line"))))
    parts = F.coalesce(parts, F.array(F.struct(F.lit(1).alias("part"), F.col("line").alias("line"))))
    return lines.withColumn("parts", parts).select(id_col, "line_idx", F.explode("parts").alias("p")).select(id_col, "line_idx", "p.part", "p.line")


def references_start(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, at): the line before which ## REFERENCES goes; documents without references have no row."""
    last = F.max("line_idx").over(Window.partitionBy(id_col))
    rows = lines.withColumn("named", X.is_reference_name(F.col("line"))).withColumn("entry", X.is_reference_entry(F.col("line")) & (F.col("line_idx") > last - 50))
    found = rows.groupBy(id_col).agg(F.min(F.when(F.col("named"), F.col("line_idx"))).alias("name_at"), F.count_if("entry").alias("entries"), F.min(F.when(F.col("entry"), F.col("line_idx"))).alias("entry_at"))
    at = F.coalesce("name_at", F.when(F.col("entries") >= 5, F.col("entry_at")))
    return found.select(id_col, at.alias("at")).filter("at IS NOT NULL")
