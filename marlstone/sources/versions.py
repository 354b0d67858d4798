"""Version data: key-values text to JSON, a JSON cache with an age limit, and version names.

The text comes from outside: nothing is downloaded and no process is started.
"""

from __future__ import annotations

import json
import os
import re
import time

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars

# The app whose branches are versions, and a cache's age limit in seconds.
APP = "394360"
MAX_AGE = 86_400
_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|([{}])|//[^\n]*|([^\s{}"]+)')


def slice_output(text: str, app: str = APP, end: str = "Unloading Steam API") -> str | None:
    """The part of a tool's output from the quoted app to the last closing line."""
    start, stop = text.find(f'"{app}"'), text.rfind(end)
    return text[start:stop] if 0 <= start < stop else None


def key_values_to_json(text: str) -> dict:
    """Key-values as JSON: a repeated key becomes a list, a single one its bare value."""
    stack: list[dict[str, list]] = [{}]
    names: list[str] = []
    key: str | None = None

    def plain(pairs: dict[str, list]) -> dict:
        return {k: v[0] if len(v) == 1 else v for k, v in pairs.items()}

    for m in _TOKEN.finditer(text):
        word = m[1] if m[1] is not None else m[3]
        if m[2] == "{":
            if key is None:
                raise ValueError("an object without a key")
            names.append(key)
            stack.append({})
            key = None
        elif m[2] == "}":
            if len(stack) == 1:
                raise ValueError("a stray closing brace")
            done = stack.pop()
            stack[-1].setdefault(names.pop(), []).append(plain(done))
        elif word is not None:
            if key is None:
                key = word
            else:
                stack[-1].setdefault(key, []).append(word)
                key = None
    if len(stack) > 1 or key is not None:
        raise ValueError("the text ends early")
    return plain(stack[0])


def folded_values(rows: DataFrame) -> DataFrame:
    """The same rule over rows (parent, key, value): (parent, key, json), a list only if repeated."""
    grouped = rows.groupBy("parent", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]).alias("values"))
    wrapped = F.to_json(F.struct(F.col("values").alias("v")))
    single = F.to_json(F.struct(F.get("values", F.lit(0)).alias("v")))
    return grouped.select("parent", "key", F.when(F.size("values") == 1, single).otherwise(wrapped).alias("json"))


def as_json(text: Column) -> Column:
    """Key-values text as JSON; null where it can't be read."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(None if t is None else json.dumps(key_values_to_json(t), separators=(",", ":"), ensure_ascii=False))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(text)


def cache_path(folder: str | None = None) -> str:
    """The cache's place: in the folder given, or that of ``MARLSTONE_CACHE_DIR``, or else ``.marlstone-cache``."""
    return os.path.join(folder or os.environ.get("MARLSTONE_CACHE_DIR") or ".marlstone-cache", "versions")


def cached(spark: SparkSession, path: str, text: str | None = None, now: float | None = None) -> DataFrame | None:
    """(name) of the versions in captured ``text``, which goes to the cache, or else in a fresh cache; None without either.

    The cache is a convenience: if it can't be read or written it is as if there were none.
    """
    if text is not None:
        data = key_values_to_json(slice_output(text) or text)
        try:
            write_cache(spark, path, data, now)
        except Exception:  # noqa: BLE001
            pass
        return version_names(spark.createDataFrame([(json.dumps(data),)], "data string"))
    if not os.path.exists(path):
        return None
    try:
        rows = read_cache(spark, path, now).collect()
    except Exception:  # noqa: BLE001
        return None
    return version_names(spark.createDataFrame(rows[:1], "fetched_at long, data string")) if rows else None


def read_cache(spark: SparkSession, path: str, now: float | None = None) -> DataFrame:
    """Cached rows (fetched_at, data) younger than a day; stamps from the future count as fresh."""
    rows = spark.read.schema("fetched_at long, data string").json(path)
    return rows.filter(F.greatest(F.lit(int(now if now is not None else time.time())) - F.col("fetched_at"), F.lit(0)) < MAX_AGE)


def write_cache(spark: SparkSession, path: str, data: dict, now: float | None = None) -> None:
    spark.createDataFrame([(int(now if now is not None else time.time()), json.dumps(data))], "fetched_at long, data string").coalesce(1).write.mode("overwrite").json(path)


def version_names(data: DataFrame, column: str = "data", app: str = APP) -> DataFrame:
    """(name) of each branch of the app; a missing level gives no rows."""
    branches = scalars.nested(F.col(column), app, "depots", "branches")
    return data.select(F.explode(F.json_object_keys(branches)).alias("name"))


def latest(names: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The largest readable version as text, or null, of each group; one row without ``by``."""
    best = names.groupBy(*by).agg(F.max(scalars.version_parts(F.col("name"))).alias("v"))
    pre = F.when(F.col("v.pre") != "", F.concat(F.lit("-"), F.col("v.pre"))).otherwise(F.lit(""))
    text = F.concat(F.concat_ws(".", "v.major", "v.minor", "v.patch"), pre)
    return best.select(*by, F.when(F.col("v").isNotNull(), text).alias("version"))
