"""CSV exports of a crawler: separator, encoding and header detection, canonical columns."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import py_strip, text

LINK_COLUMNS = ("source", "destination", "anchor", "origin", "path", "link_type")

SNIFF_CHARS = 2048
SEPARATORS = "\t,;"
#: Bytes that hold as many characters.
_HEAD_BYTES = 4 * SNIFF_CHARS


def separator_of(tabs: int, commas: int, semicolons: int) -> str:
    """Separator by how often each occurs in the head of a file."""
    if tabs > commas and tabs > semicolons:
        return "\t"
    return ";" if semicolons > commas else ","


def sniff_separator(sample: str, simple: bool = False) -> str:
    """Separator of the head of a file; the simple form knows tab and comma only."""
    tabs, commas, semicolons = (sample.count(c) for c in SEPARATORS)
    return separator_of(tabs, commas, 0 if simple else semicolons)


def clean_header(name: str) -> str:
    return name.strip().strip("\ufeff\"'").strip()


@dataclass(frozen=True)
class FileForm:
    """How the files of one group are written; files of a group also have one header line.

    ``header`` is a digest of the first line that is not blank. A header that may run over a line end has its file's
    path instead, so no other file is read by it.
    """

    sep: str
    encoding: str
    multi_line: bool
    header: str


def _literal_path(uri: str) -> str:
    """A path as Spark's readers take it, from the URI in the metadata of a row."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def _opens_a_field(sep: str) -> Column:
    """Whether a quote at the beginning of a field of the line is not closed in the line; lines without quotes are not searched."""
    return F.col("value").contains('"') & F.col("value").rlike(rf'(?:^|{re.escape(sep)})"(?:[^"]++|"")*+$')


_FORMS = (
    "file string, block long, tabs long, commas long, semicolons long, header string, runs_on boolean, utf8 boolean, open array<boolean>"
)


def _splits_of_files(batches):
    """A row for each file of a task: separators in its first ``SNIFF_CHARS`` characters, a digest of its header, and what holds of any line."""
    current: dict | None = None

    def row(split: dict) -> pa.RecordBatch:
        sample = "\n".join(line.decode(errors="replace") for line in split["lines"])[:SNIFF_CHARS]
        header = split["lines"][0] if split["lines"] else None
        columns = {
            "file": [split["key"][0]], "block": [split["key"][1]], **{n: [sample.count(c)] for n, c in zip(("tabs", "commas", "semicolons"), SEPARATORS)},
            "header": pa.array([header and hashlib.sha256(header + split["rest"].encode()).hexdigest()], pa.string()),
            "runs_on": [bool(header and (split["rest"] or header.count(b'"') % 2))],
            "utf8": [bool(split["utf8"])], "open": pa.array([split["open"].tolist()], pa.list_(pa.bool_())),
        }
        return pa.RecordBatch.from_pydict(columns)

    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
        places = files.indices.to_numpy()
        edges = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]) | (blocks[1:] != blocks[:-1])]).tolist()
        utf8 = batch.column("utf8").to_numpy(zero_copy_only=False)
        opened = np.column_stack([batch.column(f"open_{i}").to_numpy(zero_copy_only=False) for i in range(len(batch.schema.names) - 6)])
        for low, high in zip(edges, [*edges[1:], batch.num_rows]):
            key = files.dictionary[int(places[low])].as_py(), int(blocks[low])
            if current is None or current["key"] != key:
                if current is not None:
                    yield row(current)
                current = {"key": key, "lines": [], "size": 0, "rest": "", "utf8": True, "open": np.zeros(opened.shape[1], bool)}
            current["utf8"] &= utf8[low:high].all()
            current["open"] |= opened[low:high].any(axis=0)
            at = low
            while at < high and current["size"] < _HEAD_BYTES and len(current["lines"]) < 50:
                if batch.column("written")[at].as_py():
                    if not current["lines"]:
                        current["rest"] = batch.column("rest")[at].as_py()
                    current["lines"].append(batch.column("value")[at].as_py())
                    current["size"] += len(current["lines"][-1]) + 1
                at += 1
    if current is not None:
        yield row(current)


def file_forms(
    spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, multi_line: bool | None = None
) -> dict[FileForm, list[str]]:
    """The files under a path by their form; files without text are left out.

    One pass over the bytes: each task describes its part of a file in one row, and the first part with any text gives separator and header.
    The driver holds one row per file: its path, three counts, a digest of the header and three flags.
    """
    separators = [sep] if sep else list(SEPARATORS)
    value = F.col("value")
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.substring(value.cast("binary"), 1, _HEAD_BYTES).alias("value"),
        F.when(F.octet_length(value) > _HEAD_BYTES, F.sha2(value.cast("binary"), 256)).otherwise("").alias("rest"),
        value.rlike(r"[^\x00-\x20]").alias("written"),  # blank lines are those that the CSV reader skips before a header
        F.is_valid_utf8("value").alias("utf8"),
        *(_opens_a_field(c).alias(f"open_{i}") for i, c in enumerate(separators)),
    )
    first = F.struct("tabs", "commas", "semicolons", "header", "runs_on")
    opened = [F.max(F.col("open")[i]).alias(f"open_{i}") for i in range(len(separators))]
    found = lines.mapInArrow(_splits_of_files, _FORMS).groupBy("file")
    found = found.agg(F.min_by(first, F.when(F.col("header").isNotNull(), F.col("block"))).alias("first"), F.min("utf8").alias("utf8"), *opened)
    groups: dict[FileForm, list[str]] = {}
    for r in found.where("first IS NOT NULL").select("file", "first.*", "utf8", *(f"open_{i}" for i in range(len(separators)))).toLocalIterator():
        own = sep or separator_of(r.tabs, r.commas, r.semicolons)
        whole = r[f"open_{separators.index(own)}"] if multi_line is None else multi_line
        form = FileForm(own, encoding or ("UTF-8" if r.utf8 else "ISO-8859-1"), whole, r.file if whole and r.runs_on else r.header)
        groups.setdefault(form, []).append(_literal_path(r.file))
    return dict(sorted(groups.items(), key=lambda g: min(g[1])))


def _read_group(spark: SparkSession, form: FileForm, files: list[str], with_order: bool) -> DataFrame:
    raw = (
        spark.read.option("header", True)
        .option("sep", form.sep)
        .option("encoding", form.encoding)
        .option("multiLine", form.multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .csv(files)
    )
    columns = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(name) for c, name in zip(raw.columns, _unique(raw.columns))]
    if with_order:
        columns.append(
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias("ord")
        )
    return raw.select(*columns)


def read_csv_groups(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    encoding: str | None = None,
    multi_line: bool | None = None,
    with_order: bool = False,
) -> list[DataFrame]:
    """The CSV exports under a path, one table for all files of the same form and header line."""
    groups = file_forms(spark, path, sep, encoding, multi_line)
    return [_read_group(spark, form, files, with_order) for form, files in groups.items()]


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """CSV exports as text columns with cleaned header names; missing cells are empty text.

    Each file is read in its own form: the separator comes from its head, the encoding (UTF-8, else
    Latin-1) and whether fields run over line ends from its bytes; only files with line breaks inside quotes are read unsplit.
    ``sep``, ``encoding`` and ``multi_line`` name them for all files. Columns of files with unlike headers meet by
    name. Without any text the table has no columns. ``with_order`` adds ``ord``, which sorts the rows of a file as they stand in it.
    """
    groups = read_csv_groups(spark, path, **options)
    if not groups:
        return spark.createDataFrame([], "struct<>")
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), groups)
    if len(groups) == 1:
        return table
    return table.select(*(c if c == "ord" else F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in table.columns))


def _unique(headers: list[str]) -> list[str]:
    names: list[str] = []
    for header in headers:
        name = clean_header(header) or "_blank"
        while name.lower() in (n.lower() for n in names):
            name += "_"
        names.append(name)
    return names


def find_column(columns: list[str], *fragments: str, skip: tuple[str, ...] = ()) -> str | None:
    """First header containing the earliest fragment that any header contains."""
    for fragment in fragments:
        for column in columns:
            if fragment in column.lower() and column not in skip:
                return column
    return None


def map_link_columns(columns: list[str]) -> dict[str, str | None]:
    """Header -> role, by fragments of the header in French or English.

    The named fragments win over the loose ones (``text``, ``type``, ``path``), so an alt-text
    column does not pass for the anchor and a type column does not pass for the origin.
    """
    role: dict[str, str | None] = {}
    taken: tuple[str, ...] = ()
    for name, fragments in (
        ("source", ("source",)),
        ("destination", ("destination", "target", "dest")),
        ("origin", ("origin",)),
        ("path", ("xpath", "chemin", "path")),
        ("alt_text", ("alt text", "texte alt", "alt_text")),
        ("anchor", ("anchor", "ancrage", "link text", "text")),
    ):
        role[name] = find_column(columns, *fragments, skip=taken)
        taken += (role[name],) if role[name] else ()
    role["link_type"] = next(
        (c for c in columns if c not in taken and "type" in c.lower() and "link" in c.lower()), None
    )
    if not role["origin"]:
        role["origin"] = next(
            (c for c in columns if c not in taken and c != role["link_type"] and "type" in c.lower()), None
        )
    return role


def canonical_links(df: DataFrame, roles: dict[str, str | None] | None = None, alt_text: bool = False) -> DataFrame:
    """The six link columns as non-null text; URLs without surrounding blanks.

    With ``alt_text`` also the alternative text of image links, which stands for an empty anchor where labels are matched.
    """
    roles = roles or map_link_columns(df.columns)
    if not roles.get("source") or not roles.get("destination"):
        raise ValueError(f"no source or destination column among {df.columns}")

    def column(role: str) -> Column:
        header = roles.get(role)
        value = text(F.col(f"`{header}`").cast("string")) if header else F.lit("")
        return py_strip(value) if role in ("source", "destination") else value

    return df.select(*(column(r).alias(r) for r in (*LINK_COLUMNS, *["alt_text"] * alt_text)))


def read_links_csv(spark: SparkSession, path: str, alt_text: bool = False, **options) -> DataFrame:
    """Link exports as a canonical link table; the columns of each file are found by its own header."""
    groups = read_csv_groups(spark, path, **options)
    if not groups:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in (*LINK_COLUMNS, *["alt_text"] * alt_text)))
    return reduce(DataFrame.unionByName, [canonical_links(g, alt_text=alt_text) for g in groups])


def read_url_table(
    spark: SparkSession, path: str, values: dict[str, tuple[str, ...]], **options
) -> DataFrame:
    """A page export as ``url`` plus the named value columns, each found by header fragments."""
    groups = [_url_columns(raw, values) for raw in read_csv_groups(spark, path, **options)]
    if not groups:
        raise ValueError(f"no table in {path}")
    return reduce(DataFrame.unionByName, groups)


def _url_columns(raw: DataFrame, values: dict[str, tuple[str, ...]]) -> DataFrame:
    data = [c for c in raw.columns if c != "ord"]
    url = find_column(data, "address", "adresse", "url", "source")
    if not url:
        raise ValueError(f"no URL column among {data}")
    picked = [py_strip(F.col(f"`{url}`")).alias("url")]
    for name, fragments in values.items():
        header = find_column(data, *fragments, skip=(url,))
        if header is None:
            raise ValueError(f"no column for {name} among {data}")
        picked.append(F.col(f"`{header}`").alias(name))
    if "ord" in raw.columns:
        picked.append(F.col("ord"))
    return raw.select(*picked)

