"""Refinement as DataFrame operations: row-local Arrow kernels, so they need no shuffle and run on streams unchanged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.config import RefineConfig, resolve
from textmill.functions import kernels
from textmill.functions.text import codepoints

DECISION = (
    "struct<doc_id:string,page_idx:int,line_idx:int,raw_text:string,normalized_text:string,action:string,category:string,confidence:double,"
    "repeat_count:int,edge_hit_ratio:double,caps_ratio:double,digit_ratio:double,punctuation_ratio:double,codepoints:array<string>>"
)
COUNTERS = ("removed_toc_lines", "removed_layout_noise_lines", "removed_header_footer_lines", "removed_repeated_lines", "removed_boilerplate_lines", "removed_references_lines")
REPORT = f"struct<input_len:int,output_len:int,{','.join(f'{c}:int' for c in COUNTERS)},normalized_extracted:boolean,text_profile:string,detail_enabled:boolean,decisions:array<{DECISION}>>"


#: Texts that a kernel has in Python at a time; Arrow batches are of 10000 rows.
SLICE = 64


def _text_kernel(f: Callable[[str], str]):
    """An Arrow UDF of one string column; null stays null."""

    @F.arrow_udf(T.StringType())
    def run(values: pa.Array) -> pa.Array:
        parts = [pa.array([None if v is None else f(v) for v in values.slice(lo, SLICE).to_pylist()], pa.string()) for lo in range(0, len(values), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return run


def html_unescape(text: Column | str) -> Column:
    """Character references decoded as HTML5 says, also without semicolon and with numeric fix-ups."""
    import html

    return _text_kernel(html.unescape)(text)


def unicode_normalize(text: Column | str, form: str = "NFKC") -> Column:
    import unicodedata

    return _text_kernel(lambda v: unicodedata.normalize(form, v))(text)


def strip_artifacts(text: Column | str) -> Column:
    return _text_kernel(kernels.without_artifacts)(text)


def detect_profile(text: Column | str) -> Column:
    """Exact profile by Python's Unicode tables; functions.text.profile is the native one."""
    return _text_kernel(lambda v: kernels.text_profile(v) if v else "unknown")(text)


def refine(text: Column | str, preset: str = "safe", **overrides: object) -> Column:
    """The refined text; preset "raw" is the text itself. The config is resolved on the driver."""
    if preset == "raw":
        return F.col(text) if isinstance(text, str) else text
    cfg = resolve(preset, **overrides)
    return _text_kernel(lambda v: kernels.refine(v, cfg)[0])(text)


def _decision(d: kernels.Decision, doc_id: str | None, codepoints: bool, ratios: bool = True) -> dict:
    caps, digits, punctuation = kernels.ratios(d.normalized_text) if ratios else (None, None, None)
    points = [f"U+{ord(c):04X}" for c in d.raw_text] if codepoints else None
    return vars(d) | {"doc_id": doc_id, "caps_ratio": caps, "digit_ratio": digits, "punctuation_ratio": punctuation, "codepoints": points}


def _free(df: DataFrame, wanted: str) -> str:
    """wanted, lengthened until df has no column of that name in any case."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def _refined(value: str | None, cfg: RefineConfig | None, decisions: bool, detail: bool) -> tuple[str | None, kernels.Report]:
    if cfg is None:
        n = len(value or "")
        return value, kernels.Report(input_len=n, output_len=n, detail_enabled=detail)
    return kernels.refine(value, cfg, decisions, detail)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time, so that what a worker holds doesn't grow with its input."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            yield batch.slice(lo, SLICE)


def with_report(df: DataFrame, text_col: str = "text", id_col: str | None = None, preset: str = "safe", decisions: bool = False, detail: bool = False, out_col: str = "refined", report_col: str = "report", codepoints: bool = True, **overrides: object) -> DataFrame:
    """df with the refined text and its report (names in use are lengthened); decisions, and the code points of their lines, are only made when asked for."""
    cfg: RefineConfig | None = None if preset == "raw" else resolve(preset, **overrides)
    extra = T._parse_datatype_string(f"a string, b {REPORT}").fields
    schema = T.StructType([*df.schema.fields, T.StructField(_free(df, out_col), extra[0].dataType), T.StructField(_free(df, report_col), extra[1].dataType)])
    at, id_at = df.columns.index(text_col), None if id_col is None else df.columns.index(id_col)
    if cfg is None:  # the text as it is needs no kernel
        n = F.coalesce(F.length(df[text_col]), F.lit(0))
        plain = {"input_len": n, "output_len": n, "normalized_extracted": F.lit(False), "text_profile": F.lit("unknown"), "detail_enabled": F.lit(detail), "decisions": F.array()} | {c: F.lit(0) for c in COUNTERS}
        report = F.struct(*(plain[f.name].cast(f.dataType).alias(f.name) for f in extra[1].dataType.fields))
        return df.select("*", df[text_col].alias(schema[-2].name), report.alias(schema[-1].name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(extra[1].dataType)
        for batch in _sliced(batches):
            texts, reports = [], []
            ids = [None] * batch.num_rows if id_at is None else [None if v is None else str(v) for v in batch.column(id_at).to_pylist()]
            for doc_id, value in zip(ids, batch.column(at).to_pylist(), strict=True):
                out, report = _refined(value, cfg, decisions, detail)
                texts.append(out)
                reports.append(vars(report) | {"decisions": [_decision(d, doc_id, codepoints) for d in report.decisions]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(reports, kind)], names=schema.names)

    return df.mapInArrow(run, schema)


def line_decisions(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", preset: str = "safe", **overrides: object) -> DataFrame:
    """A row per decision: all lines in order, then the structural events. Code points are made from the exploded rows, only if they are selected."""
    only = df.select(id_col, text_col)
    reported = with_report(only, text_col, id_col, preset, decisions=True, codepoints=False, **overrides)
    rows = reported.select(F.posexplode(F.col(f"`{reported.columns[-1]}`.decisions")).alias("seq", "d"))
    fields = [f.name for f in rows.schema["d"].dataType.fields if f.name != "codepoints"]
    return rows.select("seq", *(F.col(f"d.{f}").alias(f) for f in fields), codepoints(F.col("d.raw_text")).alias("codepoints"))


def variants(df: DataFrame, settings: dict[str, tuple[str, dict]], text_col: str = "text", id_col: str = "doc_id", decisions: bool = False, measures: bool = True) -> DataFrame:
    """Long form (id, variant, text, report): each document in each variant, in one pass over the documents. measures: whether decisions have the ratios and code points of their lines."""
    cfgs = {name: None if preset == "raw" else resolve(preset, **overrides) for name, (preset, overrides) in settings.items()}
    schema = T.StructType([df.schema[id_col], T.StructField("variant", T.StringType()), T.StructField(text_col, T.StringType()), T.StructField("report", T._parse_datatype_string(REPORT))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema["report"].dataType)
        for batch in _sliced(batches):
            ids, values = [None if v is None else str(v) for v in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            for name, cfg in cfgs.items():
                found = [_refined(v, cfg, decisions, False) for v in values]
                reports = [vars(report) | {"decisions": [_decision(d, doc_id, measures, measures) for d in report.decisions]} for doc_id, (_, report) in zip(ids, found, strict=True)]
                columns = [batch.column(0), pa.array([name] * len(values), pa.string()), pa.array([out for out, _ in found], pa.string()), pa.array(reports, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)
