"""Delimited report files."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adplan.functions.schema import ADS_ALIASES, VENDOR_ALIASES
from adplan.operators.ingest import classify_reports, normalise_columns, parse_ads, parse_vendor, vendor_period_to_date

#: What a file is read as when its bytes are no UTF-8: every byte is a character then.
FALLBACK = "ISO-8859-1"
BOM = "\ufeff"


class FileGroup(NamedTuple):
    """Files of one encoding and one header line."""

    encoding: str
    files: list[str]


def _csv(spark: SparkSession, group: FileGroup, multiline: bool) -> DataFrame:
    return (spark.read.option("header", True).option("inferSchema", False)
            .option("encoding", group.encoding).option("multiLine", multiline)
            .option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(group.files))


def files_by_header(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> list[FileGroup]:
    """The files of ``path``, those of one encoding and header line together; empty files are left out.

    One job over the files' lines keeps one row per file: its header and whether all of its bytes are valid
    UTF-8. A file that is not is read byte by character. No line is decoded for that, and none of a large file
    stands whole in memory. With ``encoding`` all files are of that one. Only names of files reach the driver.
    """
    # The path comes percent-encoded, with a literal plus sign.
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.text(path).select(
        file.alias("file"), F.col("_metadata.file_block_start").alias("start"),
        "value", F.monotonically_increasing_id().alias("at"))
    if encoding is not None:
        lines, found = lines.filter("start = 0"), F.lit(encoding)
    else:
        found = F.when(F.bool_and(F.is_valid_utf8("value")), "UTF-8").otherwise(FALLBACK)
    # The position of the first line: blocks of a file are numbered in their order.
    per = lines.groupBy("file").agg(found.alias("encoding"), F.min_by("value", F.struct("start", "at")).alias("header"))
    groups = per.groupBy("encoding", F.ltrim(F.col("header"), F.lit(BOM)).alias("header")).agg(F.sort_array(F.collect_list("file")).alias("files"))
    return sorted(FileGroup(r.encoding, list(r.files)) for r in groups.select("encoding", "files").collect())


def _stack(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _groups(spark: SparkSession, path: str | list[str], encoding: str | None) -> list[FileGroup]:
    """One group per distinct header, so that cells are read under their own file's headers."""
    return files_by_header(spark, path, encoding) or [FileGroup(encoding or "UTF-8", [path] if isinstance(path, str) else list(path))]


def read_raw(spark: SparkSession, path: str | list[str], encoding: str | None = None, multiline: bool = False) -> DataFrame:
    """All columns as text under the files' own headers; files may order their columns differently.

    Each file is read in its own encoding unless one is given. ``multiline`` allows line breaks inside quoted
    cells; such files cannot be split, so it is off unless asked for.
    """
    return _stack([_csv(spark, g, multiline) for g in _groups(spark, path, encoding)])


def _parsed(frames: list[DataFrame], kind: str, infer: bool) -> DataFrame:
    """Frames of differing headers, stacked as text by canonical name and typed together."""
    if kind == "ads":
        return parse_ads(_stack([normalise_columns(f, ADS_ALIASES, True) for f in frames]), infer)
    return parse_vendor(_stack([vendor_period_to_date(normalise_columns(f, VENDOR_ALIASES, True)) for f in frames]), infer)


def read_report(spark: SparkSession, path: str | list[str], kind: str = "ads", encoding: str | None = None,
                multiline: bool = False, infer: bool = True) -> DataFrame:
    """Read and canonicalise an advertising or vendor report of one or many files.

    Headers and encodings may differ between files: each distinct header is read once, cells are stacked
    as text by canonical name (null where a file lacks the column), and types are decided
    over all files together. Without ``encoding`` a file is read as UTF-8 (with or without a byte order mark)
    if all of its bytes are that, else as Latin-1.
    """
    return _parsed([_csv(spark, g, multiline) for g in _groups(spark, path, encoding)], kind, infer)


def read_reports(spark: SparkSession, paths: list[str], kind: str = "ads", **options) -> DataFrame:
    """Stack reports whose headers may differ; missing columns become null."""
    return read_report(spark, paths, kind, **options)


class Routed(NamedTuple):
    """The advertising and the vendor table of a set of files (None without such a file), and one row
    per file: file, slot it was given in, kind it is, moved."""

    ads: DataFrame | None
    vendor: DataFrame | None
    files: DataFrame


def route_reports(spark: SparkSession, ads: str | list[str] | None = None, vendor: str | list[str] | None = None,
                  encoding: str | None = None, multiline: bool = False, infer: bool = True) -> Routed:
    """Read files of both kinds, each as what its header shows, whichever slot it was given in.

    A slot may hold any number of files and folders of both kinds. Every distinct header is classified once
    and read once; all files of a kind make up one table. Files in the wrong slot are put right and
    marked as moved; where no file is of a kind, its table is None.
    """
    found = [(slot, g) for slot, path in (("ads", ads), ("vendor", vendor)) if path for g in files_by_header(spark, path, encoding)]
    frames = [_csv(spark, g, multiline) for _, g in found]
    shown = spark.createDataFrame([(i, [c.lstrip(BOM) for c in f.columns]) for i, f in enumerate(frames)], "i int, headers array<string>")
    kinds = {r.i: r.kind for r in classify_reports(shown).collect()}  # one row per distinct header
    tables = {k: [f for i, f in enumerate(frames) if kinds[i] == k] for k in ("ads", "vendor")}
    rows = [(f, slot, kinds[i], slot != kinds[i]) for i, (slot, g) in enumerate(found) for f in g.files]
    parsed = {k: _parsed(fs, k, infer) if fs else None for k, fs in tables.items()}
    return Routed(parsed["ads"], parsed["vendor"], spark.createDataFrame(rows, "file string, slot string, kind string, moved boolean"))


def report_headers(spark: SparkSession, paths: list[str], encoding: str | None = None) -> DataFrame:
    """One row per file with its header texts, for ``classify_reports``. Cells are not parsed."""
    rows = []
    for group in files_by_header(spark, paths, encoding):
        columns = [c.lstrip(BOM) for c in _csv(spark, FileGroup(group.encoding, group.files[:1]), False).columns]
        rows += [(f, columns) for f in group.files]
    return spark.createDataFrame(rows, "file string, headers array<string>")


def headers_for(canonical: list[str]) -> list[str]:
    """A report header for each canonical advertising column."""
    back: dict[str, str] = {}
    for header, name in ADS_ALIASES.items():
        back.setdefault(name, header)
    return [back.get(c, c) for c in canonical]
