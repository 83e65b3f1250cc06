"""Sources and sinks: whole texts, page arrays, JSON lines, CSV, spreadsheets, vector tables."""

from __future__ import annotations

import math
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from pathlib import Path
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions import text as X

QA_SCHEMA = "qid string, question string, expected_doc_id string, expected_answer_snippet string"
PAGE_SEPARATOR = "\n\n\n"


def read_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(doc_id, text), a row per file, whole. Raises FileNotFoundError if no file matches."""
    rows = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), "([^/]+)$", 1)
    out = rows.select(F.url_decode(name).alias("doc_id"), F.col("value").alias("text"))
    if out.isEmpty():
        raise FileNotFoundError(f"no file {pattern} in {path}")
    return out


def spread(table: DataFrame) -> DataFrame:
    """A table as it is read, in as many partitions as there are cores, if its files have fewer splits: what is done a row at a time then runs on all."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if not table.isStreaming and table.rdd.getNumPartitions() < cores else table


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QA_SCHEMA).json(path)


def joined_pages(pages: Column, separator: str = PAGE_SEPARATOR) -> Column:
    """The text of a document from its pages; a null page is empty."""
    return F.array_join(F.transform(pages, lambda p: F.coalesce(p, F.lit(""))), separator)


def doc_id_of(url: Column) -> Column:
    """Word characters of the URL with _ between, the last 60."""
    return F.right(F.btrim(F.regexp_replace(url, "(?U)\\W+", "_"), F.lit("_")), F.lit(60))


class _Strings(HTMLParser):
    """Text pieces outside script, style and noscript."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.muted = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.muted += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "noscript") and self.muted:
            self.muted -= 1

    def handle_data(self, data: str) -> None:
        if not self.muted:
            self.pieces.append(data)


def html_strings(page: str) -> str:
    parser = _Strings()
    parser.feed(page)
    parser.close()
    text = "\n".join(parser.pieces)
    return re.sub("[ \t]{2,}", " ", re.sub("\n{3,}", "\n\n", text)).strip()


def html_text(html: Column | str) -> Column:
    """All text of a page, a line per piece; scripts and styles are left out."""

    @F.arrow_udf(T.StringType())
    def run(values: pa.Array) -> pa.Array:
        parts = [pa.array([None if v is None else html_strings(v) for v in values.slice(lo, 64).to_pylist()], pa.string()) for lo in range(0, len(values), 64)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return run(html)


def drop_lines(text: Column, patterns: list[str]) -> Column:
    """The text without the lines that, stripped, match a pattern from their beginning; case is ignored."""
    any_of = "|".join(f"(?:{p})" for p in patterns)
    return F.array_join(F.filter(X.lines_of(text), lambda x: ~X.matches(X.stripped(x), f"^(?:{any_of})", True)), "\n")


def write_decisions(decisions: DataFrame, path: str, dropped_only: bool = False) -> None:
    """JSON lines, nulls included."""
    rows = decisions.filter("action = 'drop'") if dropped_only else decisions
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """With a header, in the given order; nulls are empty."""
    rows.select(*columns).write.mode("overwrite").option("header", "true").option("emptyValue", "").option("nullValue", "").csv(path)


def write_variants(rows: DataFrame, path: str) -> None:
    """JSON lines in a folder per variant."""
    rows.write.mode("overwrite").partitionBy("variant").json(path)


def write_index(vectors: DataFrame, path: str) -> None:
    """Replaces the table of vectors, sorted by dimension within files so that a lookup prunes."""
    vectors.repartition("dim").sortWithinPartitions("dim").write.mode("overwrite").parquet(path)


def column_name(number: int) -> str:
    """A, B, .. Z, AA for 1, 2, .. 26, 27."""
    out = ""
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(at: str, value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int) or (isinstance(value, float) and math.isfinite(value)):
        return f'<c r="{at}"><v>{value}</v></c>'
    text = "" if isinstance(value, float) else escape(str(value))
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def _row(number: int, values: tuple) -> str:
    cells = [_cell(f"{column_name(i)}{number}", v) for i, v in enumerate(values, 1)]
    return f'<row r="{number}">{"".join(cells)}</row>'


def _sheet(rows: Iterator[tuple], columns: list[str]) -> Iterator[str]:
    yield '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + _row(1, tuple(columns))
    number = 1
    for values in rows:
        number += 1
        yield _row(number, values)
    yield "</sheetData></worksheet>"


def write_xlsx(path: str | Path, sheets: dict[str, DataFrame]) -> None:
    """A spreadsheet of small result tables, a sheet each; rows are streamed through the driver."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
    package = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        for i, df in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                for part in _sheet((tuple(r) for r in df.toLocalIterator()), df.columns):
                    out.write(part.encode())


def write_texts(texts: DataFrame, path: str, text_col: str = "text") -> None:
    """A text after another, as they are."""
    texts.select(text_col).write.mode("overwrite").option("lineSep", "\n").text(path)


def index_rows(chunks: DataFrame, field: str, id_col: str = "doc_id") -> DataFrame:
    """Chunks with the id under which an index holds them: document, field and number."""
    return chunks.withColumn("index_id", F.concat_ws("__", F.col(id_col).cast("string"), F.lit(field), F.col("chunk_index").cast("string")))


def snippet(chunk: Column, most: int = 180) -> Column:
    """The beginning of a chunk on one line."""
    return F.translate(F.substring(chunk, 1, most), "\n", " ")
