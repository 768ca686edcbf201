"""Answer sheets: reading, validation, de-duplication and the load report.

A *sheet row* table holds ``sheet_ordinal, sheet_name, row_ordinal, stimulus, transcription,
human_score`` as text.  ``row_ordinal`` must be unique inside a sheet: it stands for the row
order that Spark does not keep.
"""

from __future__ import annotations

import csv
import hashlib
import io
import logging
import operator
import os
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubrica.config import IngestConfig
from rubrica.functions.numeric import parse_number
from rubrica.functions.text import SPACE, strip
from rubrica.session import materialize
from rubrica.sources import sheet_cache
from rubrica.sources.headers import map_headers

logger = logging.getLogger(__name__)

# A sheet whose name contains one of these holds no answers.
IGNORED_SHEETS = (
    "info",
    "instruction",
    "instructions",
    "stimuli",
    "key",
    "rubric",
    "scores",
    "participant information",
    "metadata",
)

SHEET_ROW_SCHEMA = T.StructType(
    [
        T.StructField("sheet_ordinal", T.IntegerType()),
        T.StructField("sheet_name", T.StringType()),
        T.StructField("row_ordinal", T.LongType()),
        T.StructField("stimulus", T.StringType()),
        T.StructField("transcription", T.StringType()),
        T.StructField("human_score", T.StringType()),
    ]
)
PAIR_SCHEMA = T.StructType(
    [
        T.StructField("participant_id", T.StringType()),
        T.StructField("sheet_ordinal", T.IntegerType()),
        T.StructField("sheet_name", T.StringType()),
        T.StructField("row_ordinal", T.LongType()),
        T.StructField("stimulus", T.StringType()),
        T.StructField("transcription", T.StringType()),
        T.StructField("human_score", T.DoubleType()),
    ]
)
# Column that names the file of a row while sheets are read: its address, as Spark's readers spell it.
SOURCE = "_source"
REPORT_SCHEMA = T.StructType(
    [
        T.StructField("sheet_name", T.StringType()),
        *(
            T.StructField(name, T.LongType())
            for name in (
                "rows_read", "dropped_missing", "dropped_blank", "invalid_scores", "out_of_range",
                "kept", "deduplicated", "missing_scores", "final_rows",
            )
        ),
    ]
)
DEDUP_KEY = ["participant_id", "sheet_name", "stimulus", "transcription"]

# Sheet name to its frame, in workbook order.
Codec = Callable[[str, bytes], dict[str, pd.DataFrame]]


# --- column expressions -------------------------------------------------------------------


def is_ignored_sheet(sheet_name: Column) -> Column:
    name = F.lower(sheet_name)
    return reduce(operator.or_, [name.contains(token) for token in IGNORED_SHEETS])


def participant_id(sheet_name: Column) -> Column:
    """``P`` and the first digit run of the name, else the name with ``_`` for white space."""
    name = strip(sheet_name)
    return F.coalesce(
        F.concat(F.lit("P"), F.regexp_substr(sheet_name, F.lit(r"\p{Nd}+"))),
        F.when(name != "", F.regexp_replace(name, rf"(?U)[{SPACE}]+", "_")),
        F.lit("unknown_participant"),
    )


def strip_item_suffix(stimulus: Column) -> Column:
    """Remove one trailing count: ``Quiero cortarme el pelo (7)``."""
    text = strip(F.coalesce(stimulus.cast("string"), F.lit("")))
    return strip(F.regexp_replace(text, r"\(\p{Nd}+\)$", ""))


# --- readers ------------------------------------------------------------------------------


def _stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


def workbook_codec(path: str, content: bytes) -> dict[str, pd.DataFrame]:
    """All sheets of an ``.xlsx`` workbook; needs ``openpyxl`` on the executors."""
    return pd.read_excel(io.BytesIO(content), sheet_name=None, engine="openpyxl")


SHEET_LIST_SCHEMA = "path string, sheet_ordinal int, sheet_name string, status string, n_rows long"

# Cell texts that stand for a missing cell.
MISSING_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


# Files whose heads are read at the same time.
HEADS_AT_A_TIME = 16


def _files(spark: SparkSession, path: str, missing_ok: bool) -> list[str]:
    """Paths of the files under ``path`` (a file, folder or glob); their contents are not read."""
    try:
        files = spark.read.format("binaryFile").load(path).select(sheet_cache.plain_path(F.col("path")).alias("path"))
        found = files.collect()  # one row per sheet file
    except AnalysisException as missing:
        if missing_ok:
            logger.warning("nothing to read at %s", path)
            return []
        raise FileNotFoundError(f"nothing to read at {path}") from missing
    return sorted(r["path"] for r in found)


def _split_by_kind(files: list[str]) -> tuple[list[str], list[str], list[str]]:
    """CSV, Parquet and workbook files; a file is CSV where its name says nothing else."""
    kinds: dict[str, list[str]] = {"csv": [], "parquet": [], "book": []}
    for file in files:
        ending = os.path.splitext(file)[1].lower()
        kinds[{".parquet": "parquet", ".xlsx": "book", ".xlsm": "book"}.get(ending, "csv")].append(file)
    return kinds["csv"], kinds["parquet"], kinds["book"]


def _check_names(files: list[str]) -> None:
    """Rows are told apart by sheet, so a name may not come from two files."""
    names = Counter(_stem(f) for f in files)
    twice = sorted(n for n, k in names.items() if k > 1)
    if twice:
        raise ValueError(f"sheet names that occur in several files: {twice[:5]}")


def _named(file: Column) -> Column:
    """Sheet name of a file: its name without the ending."""
    return F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", "")


def _address() -> Column:
    return F.col("_metadata.file_path").alias(SOURCE)


def _path(address: Column) -> Column:
    """A file as the listing of files spells it, from its encoded address."""
    return sheet_cache.plain_path(F.url_decode(F.replace(address, F.lit("+"), F.lit("%2B"))))


def _file() -> Column:
    """The file of a row, as the listing of files spells it."""
    return _path(F.col("_metadata.file_path"))


def sheet_files(rows: DataFrame) -> DataFrame:
    """(sheet_name, path) of the files that rows with their source come from; paths are worked out once per file and
    sheet, not once per row."""
    return rows.select("sheet_name", SOURCE).distinct().select("sheet_name", _path(F.col(SOURCE)).alias("path"))


def _by_head(files: list[str], head: Callable[[str], tuple | None]) -> dict[tuple, list[str]]:
    """Files by what stands at their head; one small read per file, some at a time."""
    found: dict[tuple, list[str]] = {}
    with ThreadPoolExecutor(HEADS_AT_A_TIME) as pool:
        for file, cells in zip(files, pool.map(head, files)):
            if cells is not None:
                found.setdefault(cells, []).append(file)
    return found


def _csv_headers(spark: SparkSession, files: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by their header cells."""

    def head(file: str) -> tuple[str, ...] | None:
        line = spark.read.text(file).head(1)
        return tuple(next(csv.reader([line[0]["value"].removeprefix("\ufeff")]), [])) if line else None

    return _by_head(files, head)


def _read_csv(spark: SparkSession, cells: tuple[str, ...], files: list[str], multi_line: bool) -> DataFrame:
    """Files of one header, all cells as text, with their file and the order of their rows.

    Blocks of a file start a megabyte apart or more, and Spark numbers the rows of a task.
    """
    schema = ", ".join(f"c{i} string" for i in range(len(cells)))
    read = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", multi_line)
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    block = F.shiftright(F.col("_metadata.file_block_start"), 20)
    return read.csv(files).select(
        "*", _file().alias("file"), _address(), (F.shiftleft(block, 33) + within).alias("row_ordinal")
    )


def _present(cell: Column) -> Column:
    return F.when(~cell.isin(*MISSING_CELLS), cell)


def _csv_rows(spark: SparkSession, files: list[str], multi_line: bool) -> list[DataFrame]:
    """One table per header set that names both texts."""
    tables = []
    for cells, group in sorted(_csv_headers(spark, files).items()):
        fields = map_headers(cells)
        if not {"stimulus", "transcription"} <= fields.keys():
            continue
        place = {field: cells.index(header) for field, header in fields.items()}
        read = _read_csv(spark, cells, group, multi_line)
        texts = [
            (_present(F.col(f"c{place[f]}")) if f in place else F.lit(None)).cast("string").alias(f)
            for f in ("stimulus", "transcription", "human_score")
        ]
        place_of = [F.lit(0).alias("sheet_ordinal"), _named(F.col("file")).alias("sheet_name"), "row_ordinal"]
        rows = read.select(*place_of, *texts, SOURCE)
        tables.append(rows.filter(~is_ignored_sheet(F.col("sheet_name"))))
    return tables


def _parquet_schemas(spark: SparkSession, files: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by their column names and types, from their footers."""
    return _by_head(files, lambda file: tuple(f"`{n}` {t}" for n, t in spark.read.parquet(file).dtypes))


def _has_sheet_column(table: DataFrame) -> bool:
    if "sheet_name" in table.columns and "row_ordinal" not in table.columns:
        raise ValueError("a table with a sheet column needs a row_ordinal column")
    return "sheet_name" in table.columns


def _parquet_rows(spark: SparkSession, groups: list[list[str]]) -> list[DataFrame]:
    """One table per schema: its own sheet column, or a sheet per file in row order."""
    tables = []
    for files in groups:
        table = spark.read.parquet(*files)
        own = [] if _has_sheet_column(table) else ["_metadata.row_index"]
        table = table.select(
            "*",
            _address(),
            *(F.col(c).alias("row_ordinal") for c in own),
            *(_named(_file()).alias("sheet_name") for _ in own),
        )
        known = map_headers(c for c in table.columns if c not in ("sheet_name", "row_ordinal", SOURCE)).keys()
        if {"stimulus", "transcription"} <= known:
            tables.append(sheet_rows_from_table(table))
    return tables


def _check_tables(tables: list[DataFrame], files: list[str]) -> None:
    """A sheet named by a column may not also be a file, nor come from two tables."""
    sheets = reduce(DataFrame.unionByName, [sheet_files(t) for t in tables])
    named = sheets.sparkSession.createDataFrame([(f,) for f in files], "path string")
    named = named.select(_named(F.col("path")).alias("sheet_name"), "path")
    units = sheets.unionByName(named).groupBy("sheet_name").agg(F.countDistinct(sheet_cache.unit()).alias("n"))
    twice = [r["sheet_name"] for r in units.filter("n > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"sheet names that occur in several files: {twice}")


def _sheets_in(
    batches: Iterator[pd.DataFrame], codec: Codec, skip_unreadable: bool
) -> Iterator[tuple[str, int, str, pd.DataFrame | None]]:
    """Every sheet of every workbook in the batches; one that is skipped has no frame."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            try:
                sheets = codec(path, bytes(content))
            except Exception:
                if not skip_unreadable:
                    raise
                logger.exception("could not read %s", path)
                yield path, 0, "", None
                continue
            for ordinal, (name, frame) in enumerate(sheets.items()):
                yield path, ordinal, name, frame


def _status(name: str, frame: pd.DataFrame | None) -> str:
    if frame is None:
        return "unreadable"
    if any(token in name.lower().strip() for token in IGNORED_SHEETS):
        return "ignored"
    mapped = {"stimulus", "transcription"} <= map_headers(frame.columns).keys()
    return "read" if mapped else "no_text_columns"


def _sheet_rows(name: str, ordinal: int, frame: pd.DataFrame) -> pd.DataFrame:
    fields = map_headers(frame.columns)
    out = pd.DataFrame({"row_ordinal": range(len(frame))}, dtype="int64")
    for field in ("stimulus", "transcription", "human_score"):
        if field in fields:
            column = frame.loc[:, frame.columns == fields[field]].iloc[:, 0].astype(object)
            out[field] = [None if pd.isna(v) else str(v) for v in column]
        else:
            out[field] = None
    return out.assign(sheet_name=name, sheet_ordinal=ordinal)[SHEET_ROW_SCHEMA.names]


def _workbooks(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(files).select("path", "content", _address())


def read_sheets(
    spark: SparkSession,
    path: str,
    codec: Codec | None = None,
    missing_ok: bool = False,
    skip_unreadable: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """Sheet rows of every file under ``path`` (a file, folder or glob).

    CSV and Parquet files go through Spark's readers, with headers mapped once per set of headers (from the first line
    or the footer of each file); only the columns in use are read.  ``multi_line=False`` also splits single CSV files among tasks, for files
    without line feeds inside cells.  Workbooks, or all files if a ``codec`` is given, are parsed file by file.
    Sheets that are ignored or lack a text column yield no rows.  A missing path and an unreadable workbook
    are errors unless ``missing_ok`` or ``skip_unreadable`` says otherwise; :func:`list_sheets` names the rejected.
    """
    files = _files(spark, path, missing_ok)
    return read_files(spark, files, codec, skip_unreadable, multi_line)


def read_files(
    spark: SparkSession,
    files: list[str],
    codec: Codec | None = None,
    skip_unreadable: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """Sheet rows of the given files; see :func:`read_sheets`."""
    return rows_with_source(spark, files, codec, skip_unreadable, multi_line).drop(SOURCE)


def rows_with_source(
    spark: SparkSession,
    files: list[str],
    codec: Codec | None = None,
    skip_unreadable: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """Sheet rows with the address of the file of each; see :func:`sheet_files`."""
    texts, tables, books = ([], [], files) if codec else _split_by_kind(files)
    schemas = sorted(_parquet_schemas(spark, tables).items())
    named = [f for names, group in schemas if not any(n.startswith("`sheet_name` ") for n in names) for f in group]
    _check_names([*texts, *named])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            address = dict(zip(batch["path"], batch[SOURCE]))
            for path, ordinal, name, frame in _sheets_in(iter([batch]), codec or workbook_codec, skip_unreadable):
                if _status(name, frame) == "read":
                    yield _sheet_rows(name, ordinal, frame).assign(**{SOURCE: address[path]})

    parts = _csv_rows(spark, texts, multi_line) if texts else []
    columnar = _parquet_rows(spark, [group for _, group in schemas])
    if len(named) < len(tables):
        _check_tables(columnar, texts)
    schema = T.StructType([*SHEET_ROW_SCHEMA.fields, T.StructField(SOURCE, T.StringType())])
    parts += columnar
    if books:
        parts.append(_workbooks(spark, books).mapInPandas(read, schema))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def list_sheets(
    spark: SparkSession, path: str, codec: Codec | None = None, missing_ok: bool = False, multi_line: bool = True
) -> DataFrame:
    """One row per sheet under ``path``: its place, name, row count and whether it is read."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for file, ordinal, name, frame in _sheets_in(batches, codec or workbook_codec, skip_unreadable=True):
            n_rows = 0 if frame is None else len(frame)
            row = (file, ordinal, name, _status(name, frame), n_rows)
            yield pd.DataFrame([row], columns=["path", "sheet_ordinal", "sheet_name", "status", "n_rows"])

    files = _files(spark, path, missing_ok)
    texts, tables, books = ([], [], files) if codec else _split_by_kind(files)

    def counted(rows: DataFrame, columns: Iterable[str]) -> DataFrame:
        mapped = {"stimulus", "transcription"} <= map_headers(columns).keys()
        name = _named(F.col("file"))
        status = F.when(is_ignored_sheet(name), "ignored").otherwise("read" if mapped else "no_text_columns")
        counts = rows.groupBy("file").agg(F.count("*").alias("n_rows"))
        return counts.select(
            F.col("file").alias("path"),
            F.lit(0).alias("sheet_ordinal"),
            name.alias("sheet_name"),
            status.alias("status"),
            "n_rows",
        )

    parts = []
    if texts:
        for cells, group in sorted(_csv_headers(spark, texts).items()):
            every = spark.createDataFrame([(f,) for f in group], "file string")
            read = _read_csv(spark, cells, group, multi_line).select("file")
            listed = counted(read, cells).drop("sheet_name", "status", "sheet_ordinal")
            empty = counted(every, cells).drop("n_rows")
            parts.append(empty.join(listed, "path", "left").fillna(0, subset=["n_rows"]))
    for _, group in sorted(_parquet_schemas(spark, tables).items()):
        table = spark.read.parquet(*group)
        parts.append(counted(table.select(_file().alias("file")), table.columns))
    if books:
        parts.append(_workbooks(spark, books).mapInPandas(describe, SHEET_LIST_SCHEMA))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SHEET_LIST_SCHEMA)


def sheet_rows_from_table(df: DataFrame, sheet: str = "sheet_name") -> DataFrame:
    """Sheet rows of a table that already has a sheet column and free-form headers."""
    keep = {sheet, "sheet_ordinal", "row_ordinal", SOURCE}
    fields = map_headers(c for c in df.columns if c not in keep)
    missing = {"stimulus", "transcription"} - fields.keys()
    if missing:
        raise ValueError(f"missing required columns: {sorted(missing)}")
    ordinal = F.col("sheet_ordinal") if "sheet_ordinal" in df.columns else F.lit(0)
    score = F.col(fields["human_score"]) if "human_score" in fields else F.lit(None)
    return df.filter(~is_ignored_sheet(F.col(sheet))).select(
        ordinal.cast("int").alias("sheet_ordinal"),
        F.col(sheet).alias("sheet_name"),
        F.col("row_ordinal").cast("long").alias("row_ordinal"),
        F.col(fields["stimulus"]).cast("string").alias("stimulus"),
        F.col(fields["transcription"]).cast("string").alias("transcription"),
        score.cast("string").alias("human_score"),
        *(c for c in df.columns if c == SOURCE),
    )


# --- validation ---------------------------------------------------------------------------


def flag_rows(rows: DataFrame, role: str, cfg: IngestConfig = IngestConfig()) -> DataFrame:
    """Clean every sheet row and say why it would be dropped (``drop_reason`` null: kept).

    Order of the checks: missing text, blank text, then (tuning only) score out of range.
    The item suffix goes after the blank check, so ``(7)`` survives as an empty stimulus.
    """
    low, high = cfg.allowed_score_range
    stim, resp = (F.col(c).cast("string") for c in ("stimulus", "transcription"))
    score = parse_number(F.col("human_score"))
    has_text = rf"(?U)[^{SPACE}]"
    # On the raw texts, so that a filter on the reason does not repeat the cleaning.
    reason = F.when(stim.isNull() | resp.isNull(), "missing").when(
        ~(stim.rlike(has_text) & resp.rlike(has_text)), "blank"
    )
    if role == "tuning":
        reason = reason.when(~score.between(low, high), "out_of_range")
    return rows.select(
        participant_id(F.col("sheet_name")).alias("participant_id"),
        "sheet_ordinal",
        "sheet_name",
        "row_ordinal",
        strip_item_suffix(stim).alias("stimulus"),
        strip(resp).alias("transcription"),
        score.alias("human_score"),
        reason.alias("drop_reason"),
    )


def standardize(rows: DataFrame, role: str, cfg: IngestConfig = IngestConfig()) -> DataFrame:
    """Valid rows of all sheets in :data:`PAIR_SCHEMA`, before de-duplication."""
    return flag_rows(rows, role, cfg).filter(F.col("drop_reason").isNull()).drop("drop_reason")


def deduplicate(pairs: DataFrame) -> DataFrame:
    """Keep the first row of each (participant, sheet, stimulus, transcription).

    The key holds the sheet, so "first" is the smallest row ordinal.  Written as an aggregate
    on fixed-width values: copies collapse before the shuffle, however many there are of one.
    """
    first = pairs.groupBy(*DEDUP_KEY).agg(
        F.min("sheet_ordinal").alias("sheet_ordinal"),
        F.min_by("human_score", "row_ordinal").alias("human_score"),
        F.min("row_ordinal").alias("row_ordinal"),
    )
    return first.select(*PAIR_SCHEMA.names)


def load_pairs(rows: DataFrame, role: str, cfg: IngestConfig = IngestConfig()) -> DataFrame:
    """Validated, de-duplicated pairs; tuning rows without a score go after de-duplication,
    so an unscored first copy also takes its scored later copies away."""
    pairs = deduplicate(standardize(rows, role, cfg))
    return pairs.filter(F.col("human_score").isNotNull()) if role == "tuning" else pairs


def _copies(rows: DataFrame, role: str, cfg: IngestConfig) -> DataFrame:
    """A row per (copy key, drop reason): what both the pairs and the report are made of.

    The participant follows from the sheet, so it is no part of the key and is added to the groups.
    """
    key = [c for c in DEDUP_KEY if c != "participant_id"]
    groups = flag_rows(rows, role, cfg).groupBy(*key, "drop_reason").agg(
        F.min("sheet_ordinal").alias("sheet_ordinal"),
        F.count("*").alias("n"),
        F.count_if(F.col("human_score").isNull()).alias("invalid"),
        F.min_by("human_score", "row_ordinal").alias("human_score"),
        F.min("row_ordinal").alias("row_ordinal"),
    )
    return groups.withColumn("participant_id", participant_id(F.col("sheet_name")))


def _report(groups: DataFrame, role: str) -> DataFrame:
    n, reason = F.col("n"), F.col("drop_reason")
    kept = reason.isNull()
    typed = kept | (reason == "out_of_range")
    unscored = kept & F.col("human_score").isNull() if role == "tuning" else F.lit(False)

    def total(condition: Column, value: Column = n) -> Column:
        return F.sum(F.when(condition, value).otherwise(0))

    return groups.groupBy("sheet_name").agg(
        F.sum(n).alias("rows_read"),
        total(reason == "missing").alias("dropped_missing"),
        total(reason == "blank").alias("dropped_blank"),
        total(typed, F.col("invalid")).alias("invalid_scores"),
        total(reason == "out_of_range").alias("out_of_range"),
        total(kept).alias("kept"),
        total(kept, n - 1).alias("deduplicated"),
        F.count_if(unscored).alias("missing_scores"),
        F.count_if(kept & ~unscored).alias("final_rows"),
    )


def load_report(rows: DataFrame, role: str, cfg: IngestConfig = IngestConfig()) -> DataFrame:
    """Per sheet: rows read, dropped by reason, invalid scores, copies removed, rows left."""
    return _report(_copies(rows, role, cfg), role)


def load_with_report(
    rows: DataFrame, role: str, cfg: IngestConfig = IngestConfig()
) -> tuple[DataFrame, DataFrame]:
    """Pairs and load report of the same rows, which are cleaned, shuffled and read once for both."""
    groups = materialize(_copies(rows, role, cfg), "copies")
    pairs = groups.filter(F.col("drop_reason").isNull()).select(*PAIR_SCHEMA.names)
    pairs = pairs.filter(F.col("human_score").isNotNull()) if role == "tuning" else pairs
    return pairs, _report(groups, role)


def load_summary(report: DataFrame, all_sheets: DataFrame) -> DataFrame:
    """One row: sheets in all, skipped and valid, with the totals of a load report.

    ``all_sheets`` has one ``sheet_name`` per sheet, ignored ones included.
    """
    sums = ("kept", "deduplicated", "missing_scores", "final_rows")
    sheets = all_sheets.select(F.count("*").alias("sheets_total"))
    totals = report.agg(
        F.count_if(F.col("kept") > 0).alias("sheets_valid"), *[F.sum(c).alias(c) for c in sums]
    )
    skipped = F.col("sheets_total") - F.col("sheets_valid")
    return totals.select(sheets.scalar().alias("sheets_total"), "*").select(
        "sheets_total", skipped.alias("sheets_skipped"), "sheets_valid", *sums
    )


# --- roles and cache ----------------------------------------------------------------------


def is_cache_valid(spark: SparkSession, source: str, cache: str, force_reload: bool = False) -> bool:
    """True when the cached table was made from just these files, none changed, added or gone since."""
    if force_reload:
        return False
    kept = sheet_cache.current(spark, cache)
    if kept is None:
        return False
    changed, gone = sheet_cache.differences(sheet_cache.listing(spark, source), kept.manifest)
    return changed.isEmpty() and gone.isEmpty()


def cache_path(cfg: IngestConfig, path: str, role: str) -> str:
    """Where the standardised table of a source is kept: named by the whole path, the role and the settings."""
    settings = repr((path, role, cfg.allowed_score_range, cfg.skip_unreadable))
    return f"{cfg.cache_dir.rstrip('/')}/{role}-{hashlib.sha256(settings.encode()).hexdigest()[:24]}"


def _usable(rows: DataFrame, path: str, role: str) -> DataFrame:
    """``rows``; raises if they are tuning rows without any score."""
    if role == "tuning" and not rows.isEmpty():
        if rows.filter(F.col("human_score").isNotNull()).isEmpty():
            raise ValueError(f"tuning data at {path} has no usable score column")
    return rows


def load_role_with_report(
    spark: SparkSession,
    path: str | None,
    role: str,
    cfg: IngestConfig = IngestConfig(),
    codec: Codec | None = None,
    table: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Pairs and load report of one data set: a table of the catalog, or files.

    With a cache folder only files that changed since the last load are read again.
    """
    if table is not None:
        return load_with_report(_usable(sheet_rows_from_table(spark.table(table)), table, role), role, cfg)
    if not cfg.cache_dir:
        # Stored once, so that the tests below and the load do not parse the files again.
        rows = materialize(read_sheets(spark, path, codec, cfg.missing_ok, cfg.skip_unreadable), "sheet-rows")
        return load_with_report(_usable(rows, path, role), role, cfg)

    def tables_of(files: list[str], others_kept: bool) -> tuple[dict[str, DataFrame], DataFrame]:
        rows = rows_with_source(spark, files, codec, cfg.skip_unreadable)
        if codec or any(not f.lower().endswith(".parquet") for f in files):
            rows = materialize(rows, "sheet-rows")  # parsed once; Parquet files are read for their columns
        sheets = sheet_files(rows)
        pairs, report = load_with_report(rows if others_kept else _usable(rows, path, role), role, cfg)
        return {"pairs": pairs, "report": report}, sheets

    _files(spark, path, cfg.missing_ok)  # raises where there is nothing to read
    cache = cache_path(cfg, path, role)
    schemas = {"pairs": PAIR_SCHEMA, "report": REPORT_SCHEMA}
    version = sheet_cache.refreshed(spark, path, cache, tables_of, schemas, cfg.force_reload)
    pairs, report = (sheet_cache.read(spark, cache, version, kind, schema) for kind, schema in schemas.items())
    return pairs, report


def load_role(
    spark: SparkSession,
    path: str | None,
    role: str,
    cfg: IngestConfig = IngestConfig(),
    codec: Codec | None = None,
) -> DataFrame:
    """One data set without its report."""
    return load_role_with_report(spark, path, role, cfg, codec)[0]


def load_data_with_reports(
    spark: SparkSession, cfg: IngestConfig, codec: Codec | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tuning and holdout pairs, and the load report of both by ``role`` and sheet."""
    tuning, first = load_role_with_report(spark, cfg.tuning_path, "tuning", cfg, codec, cfg.tuning_table)
    holdout, second = load_role_with_report(spark, cfg.holdout_path, "holdout", cfg, codec, cfg.holdout_table)
    reports = [r.select(F.lit(role).alias("role"), "*") for role, r in (("tuning", first), ("holdout", second))]
    return tuning, holdout, reports[0].unionByName(reports[1])


def load_data(
    spark: SparkSession, cfg: IngestConfig, codec: Codec | None = None
) -> tuple[DataFrame, DataFrame]:
    """Tuning and holdout pairs."""
    return load_data_with_reports(spark, cfg, codec)[:2]
