"""File trees as DataFrames.

Spark's file readers skip names that start with ``_`` or ``.``; a tree has to be
read whole, so a Python data source lists it and reads batches of files.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import scalars

FILES_PER_TASK = 64
BYTES_PER_TASK = 64 << 20
# The folders, from the tree's root, whose files are read, and what they hold.
FOLDERS = {"events": "events", "common/national_focus": "national_focus", "common/technologies": "technologies"}
ROUTES = ("localisation", *FOLDERS)


class WalkFailed(OSError):
    """A part of the tree can't be listed, or a name in it is not UTF-8."""


def _utf8(name: str) -> bool:
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def check_walk(root: str) -> None:
    """Raises ``WalkFailed`` unless every folder below ``root`` can be listed and every name is UTF-8."""

    def failed(e: OSError) -> None:
        raise WalkFailed(f"{e.filename}: {e.strerror}") from e

    for at, folders, names in os.walk(root, onerror=failed):
        for name in (*folders, *names):
            if not _utf8(name):
                raise WalkFailed(f"{at!r}: {os.fsencode(name)!r} is not UTF-8")


class _Batch(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.within = [x for x in options.get("within", "").split(",") if x]
        self.only = set(json.loads(options["only"])) if "only" in options else None

    def _folder(self, path: str) -> str:
        """The folder of a file, from the root; empty for the root itself."""
        at = os.path.relpath(os.path.dirname(path), self.root).replace(os.sep, "/")
        return "" if at == "." else at

    def _wanted(self, path: str) -> bool:
        """Pruning before any file is opened: folders of the tree, or names that mark a language."""
        if not _utf8(path) or (self.only is not None and path not in self.only):
            return False
        return not self.within or self._folder(path) in self.within or ("l_" in os.path.basename(path) and "localisation" in self.within)

    def partitions(self) -> list[_Batch]:
        found = sorted(os.path.join(at, name) for at, _, names in os.walk(self.root) for name in names)
        batches: list[list[str]] = []
        size = 0
        for path in filter(self._wanted, found):
            try:
                own = os.path.getsize(path)
            except OSError:
                continue
            if not batches or len(batches[-1]) >= FILES_PER_TASK or size + own > BYTES_PER_TASK:
                batches.append([])
                size = 0
            batches[-1].append(path)
            size += own
        # Spark takes no partition at all for one without a value.
        return [_Batch(b) for b in batches or [[]]]

    def read(self, partition: _Batch) -> Iterator[tuple[str, str, bytes]]:
        for path in partition.paths:
            try:
                with open(path, "rb") as f:
                    yield path, self._folder(path), f.read()
            except OSError:
                continue


class TreeSource(DataSource):
    """``spark.read.format("script_tree").load(root)``; ``within`` names folders to keep, ``only`` is a JSON list of paths."""

    @classmethod
    def name(cls) -> str:
        return "script_tree"

    def schema(self) -> str:
        return "path string, folder string, content binary"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


def read_tree(spark: SparkSession, root: str, within: tuple[str, ...] = (), only: list[str] | None = None) -> DataFrame:
    """files(path, folder, name, prefix, text) of all valid UTF-8 files below ``root``."""
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    spark.dataSource.register(TreeSource)
    found = spark.read.format("script_tree").option("within", ",".join(within))
    if only is not None:
        found = found.option("only", json.dumps(only))
    found = found.load(root).filter(F.is_valid_utf8(F.col("content").cast("string")))
    return with_names(found.withColumn("text", F.col("content").cast("string"))).select("path", "folder", "name", "prefix", "text")


def with_names(files: DataFrame) -> DataFrame:
    """Adds ``name`` and ``prefix``, and ``folder`` where paths begin at the root."""
    if "folder" not in files.columns:
        files = files.withColumn("folder", F.regexp_extract("path", r"^(?s:(.*))/[^/]*$", 1))
    return files.withColumn("name", scalars.file_name(F.col("path"))).withColumn("prefix", scalars.file_prefix(F.col("name")))


def languages(spark: SparkSession) -> DataFrame:
    """languages(ord, cli_name, file_code)."""
    return spark.createDataFrame([(i, cli, code) for i, (cli, code) in enumerate(scalars.LANGUAGES)], "ord int, cli_name string, file_code string")


def routed(files: DataFrame) -> DataFrame:
    """Adds ``route`` and ``lang``; a language mark in the name goes before any folder."""
    codes = [code for _, code in scalars.LANGUAGES]
    marked = scalars.after_last_marker(F.col("prefix"))
    lang = F.when(marked.isin(codes), marked)
    by_folder = F.element_at(F.create_map(*(F.lit(x) for pair in FOLDERS.items() for x in pair)), F.col("folder"))
    return files.withColumn("lang", lang).withColumn("route", F.when(F.col("lang").isNotNull(), F.lit("localisation")).otherwise(by_folder))


def load_keys(files: DataFrame) -> DataFrame:
    """loc_keys(lang, key): each line but the first, up to its first colon.

    A line without a colon keeps its line break, as the whole line is its key.
    """
    own = routed(files).filter(F.col("route") == "localisation")
    lines = own.select("lang", F.posexplode(F.split("text", r"(?<=\n)", -1)).alias("at", "line")).filter("at > 0")
    return lines.select("lang", scalars.line_key(F.col("line")).alias("key")).filter(F.col("key") != "").distinct()


def active(spark: SparkSession, chosen: list[str] | None = None, every: bool = False) -> DataFrame:
    """(ord, lang) of the languages that count, by their command-line names: English if none is named."""
    known = languages(spark)
    if not every:
        known = known.filter(F.col("cli_name").isin(*(chosen or ["english"])))
    return known.select("ord", F.col("file_code").alias("lang"))


def active_files(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """``files`` without those of other languages, so that only active ones are split into keys."""
    return routed(files).join(F.broadcast(chosen.select("lang")), "lang", "left_semi").select(*files.columns)
