"""Text files with a header, each read by its own column names: one scan per layout.

The header index has a row per file, made of its first line alone. Files with the same header are a layout and read
by one column-pruned scan; the scans are united by name, so no line ever looks for its header.
"""

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files whose first line is read at a time, by threads that only wait for the store.
READERS = 32


@dataclass(frozen=True)
class Layout:
    """A header and the files that begin with it."""

    names: tuple[str, ...]
    paths: tuple[str, ...]

    def cell(self, name: str) -> Column:
        """The text under a column name, the first of that name; null where it is blank or the layout has none."""
        if name not in self.names:
            return F.lit(None).cast("string")
        found = F.trim(f"c{self.names.index(name)}")
        return F.when(found != "", found)

    def scan(self, spark: SparkSession) -> DataFrame:
        """Lines below the header as text columns c0, c1, ..., of which only those used later are parsed."""
        schema = ", ".join(f"c{i} string" for i in range(len(self.names)))
        reader = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True)
        return reader.csv([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in self.paths])


def file_paths(spark: SparkSession, paths: list[str], **options) -> list[str]:
    """The files below some paths; contents are not read."""
    return sorted(r[0] for r in spark.read.format("binaryFile").options(**options).load(paths).select("path").collect())


def _first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a file that is not blank; no more of the file is read than its first blocks."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = reader.readLine()
        while line is not None and not line.lstrip("﻿").strip():
            line = reader.readLine()
        return line
    finally:
        stream.close()


def header_index(spark: SparkSession, paths: list[str], **options) -> list[tuple[str, str]]:
    """(path, header) of each file that has a line, in order of path: as long as the list of files that Spark keeps."""
    files = file_paths(spark, paths, **options)
    with ThreadPoolExecutor(READERS) as pool:
        lines = pool.map(lambda p: _first_line(spark, p), files)
    return [(p, line.lstrip("﻿")) for p, line in zip(files, lines) if line is not None]


def _names_of(spark: SparkSession, headers: list[str]) -> dict[str, tuple[str, ...]]:
    """The column names of some header lines, which may be quoted."""
    width = max(h.count(",") for h in headers) + 1
    rows = spark.createDataFrame([(h,) for h in headers], "header string")
    parsed = F.from_csv("header", ", ".join(f"c{i} string" for i in range(width)))
    cells = rows.select("header", F.array(*[F.trim(parsed[f"c{i}"]) for i in range(width)])).collect()
    return {h: tuple((n or "") for n in names[: h.count(",") + 1]) for h, names in cells}


def layouts(spark: SparkSession, paths: list[str], **options) -> list[Layout]:
    """The layouts of all files below some paths, each with its files."""
    by_header: dict[str, list[str]] = {}
    for path, header in header_index(spark, paths, **options):
        by_header.setdefault(header, []).append(path)
    if not by_header:
        return []
    names = _names_of(spark, list(by_header))
    return [Layout(names[h], tuple(own)) for h, own in sorted(by_header.items())]


def _plain(name: str) -> Column:
    """A path or file name of a scan without its escapes."""
    return F.url_decode(F.replace(F.col(name), F.lit("+"), F.lit("%2B")))


def read_layouts(spark: SparkSession, found: list[Layout], columns: Callable[..., dict[str, Column]], schema: str) -> DataFrame:
    """The rows of all layouts, as the columns that `columns(layout, cell)` makes of the cells it asks for by name.

    file_path and file_name tell a line's file. Lines that repeat the header (their first cell asked for is its own
    name) are left out, blank ones too; short lines end in empty cells. Cells cannot hold line ends. Without layouts the table is empty and has `schema`.
    """
    parts = []
    for layout in found:
        asked: dict[str, Column] = {}

        def cell(name: str, layout=layout, asked=asked) -> Column:
            return asked.setdefault(name, layout.cell(name))

        made = columns(layout, cell)
        rows = layout.scan(spark).withColumns({n: _plain(f"_metadata.{n}") for n in ("file_path", "file_name")})
        known = [n for n in asked if n in layout.names]
        if known:  # one column tells, so that the others need not be parsed for it
            rows = rows.filter(~asked[known[0]].eqNullSafe(F.lit(known[0])))
        parts.append(rows.select(*[c.alias(n) for n, c in made.items()]))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
