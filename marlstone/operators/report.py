"""Missing keys: references times dimension, less what is there, as an ordered report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import scalars

SHOWN = 10


def first_refs(refs: DataFrame) -> DataFrame:
    """One (path, offset) for each key: the least."""
    return refs.groupBy("key").agg(F.min(F.struct("path", "offset")).alias("at")).select("key", "at.path", "at.offset")


def missing(refs: DataFrame, dimension: DataFrame, present: DataFrame) -> DataFrame:
    """(key, absent): of each key the names (ordered by ``ord``) that it lacks.

    ``refs`` has distinct ``key``; ``dimension`` (ord, lang) is a closed list of
    few rows and so is sent to all tasks; ``present`` has (lang, key).  Keys that
    lack nothing are left out.  Names without any key count as lacking all.
    """
    wanted = refs.select("key").crossJoin(F.broadcast(dimension))
    gone = wanted.join(present.select("lang", "key"), ["lang", "key"], "left_anti")
    return gone.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "lang"))), lambda x: x["lang"]).alias("langs")).select("key", F.array_join("langs", ", ").alias("absent"))


def top(gone: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The first rows in byte order of the key, with their rank."""
    cut = gone.orderBy("key").limit(shown)
    return cut.withColumn("rank", F.row_number().over(Window.orderBy("key")))


def summary(refs: DataFrame, gone: DataFrame, shown: int = SHOWN) -> DataFrame:
    """One row: missing, total, hidden and the closing line."""
    counts = gone.agg(F.count("*").alias("missing")).crossJoin(refs.agg(F.count_distinct("key").alias("total")))
    line = F.concat(F.lit("Found "), scalars.with_commas(F.col("missing")), F.lit("/"), scalars.with_commas(F.col("total")))
    return counts.select("missing", "total", F.greatest(F.col("missing") - shown, F.lit(0)).cast("long").alias("hidden"), line.alias("line"))


def nth_of(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``nth``: 1 for a key's first row, more for its repeats."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def rendered(severity: str, message: str, label: str, path: str, text: str, offset: int, length: int) -> str:
    """A diagnostic with its line of source and the span marked; offset and length are in bytes."""
    data = text.encode()
    start = data.rfind(b"\n", 0, offset) + 1
    end = data.find(b"\n", offset)
    line = data[start : len(data) if end < 0 else end].decode(errors="replace").rstrip("\r").expandtabs(4)
    before = len(data[start:offset].decode(errors="replace").expandtabs(4))
    width = max(1, len(data[offset : offset + length].decode(errors="replace")))
    number = str(data.count(b"\n", 0, offset) + 1)
    pad = " " * len(number)
    column = len(data[start:offset].decode(errors="replace")) + 1
    return f"{severity}: {message}\n{pad}--> {path}:{number}:{column}\n{pad} |\n{number} | {line}\n{pad} | {' ' * before}{'^' * width} {label}"
