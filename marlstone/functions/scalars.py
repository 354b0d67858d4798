"""Scalar functions as Column expressions; all run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest value of a digit run; longer runs saturate.
MAX_NUMBER = 18446744073709551615
_RUNS = re.compile(r"([0-9]+)|([^0-9]+)")
# Languages by declaration order, with their command-line names and file codes.
LANGUAGES = (
    ("brazilian_portuguese", "braz_por"),
    ("chinese", "simp_chinese"),
    ("english", "english"),
    ("french", "french"),
    ("german", "german"),
    ("japanese", "japanese"),
    ("korean", "korean"),
    ("polish", "polish"),
    ("russian", "russian"),
    ("spanish", "spanish"),
)


def natural_key(value: Column) -> Column:
    """An orderable array: digit runs as numbers, before all else as text."""
    runs = F.regexp_extract_all(value, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    top = F.lit(str(MAX_NUMBER)).cast("decimal(20,0)")

    def part(p: Column) -> Column:
        is_number = p.rlike(r"^[0-9]")
        digits = F.regexp_replace(p, r"^0+(?=[0-9])", "")
        # 20 digits fit; more are beyond the top whatever they are.
        number = F.when(F.length(digits) > 20, top).otherwise(F.least(digits.try_cast("decimal(20,0)"), top))
        return F.struct(
            F.when(is_number, 0).otherwise(1).alias("k"),
            F.when(is_number, number).otherwise(F.lit(0).cast("decimal(20,0)")).alias("n"),
            F.when(is_number, F.lit("")).otherwise(p).alias("t"),
        )

    return F.transform(runs, part)


def natural_parts(value: str) -> list[tuple[int, int, str]]:
    """``natural_key`` of one Python string."""
    return [(0, min(int(n[:21]), MAX_NUMBER) if (n := digits.lstrip("0")) else 0, "") if digits else (1, 0, text) for digits, text in _RUNS.findall(value)]


def with_commas(number: Column) -> Column:
    return F.format_number(number, 0)


def byte_offset(text: Column, key: Column) -> Column:
    """UTF-8 bytes before the first occurrence of ``key``; 0 if there is none."""
    return F.octet_length(F.substring(text, F.lit(1), F.greatest(F.instr(text, key) - 1, F.lit(0)))).cast("long")


def second_byte_offset(text: Column, key: Column) -> Column:
    """Offset of the occurrence after the first one; that of the first if there is only one, 0 if none."""
    at = F.instr(text, key)
    after = at + F.length(key)
    rest = F.substring(text, after, F.length(text))
    found = (at > 0) & (F.instr(rest, key) > 0)
    skipped = F.octet_length(F.substring(text, F.lit(1), after - 1))
    return F.when(found, skipped + byte_offset(rest, key)).otherwise(byte_offset(text, key)).cast("long")


def file_prefix(name: Column) -> Column:
    """A file name up to its first dot; a leading dot belongs to it."""
    return F.regexp_extract(name, r"^(\.?[^.]*)", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def after_last_marker(prefix: Column, marker: str = "l_") -> Column:
    """The text after the last marker; empty if there is none."""
    return F.regexp_extract(prefix, rf"^(?s:.*){marker}((?s:.*))$", 1)


def line_key(line: Column) -> Column:
    """Left-trimmed text before the first colon; a line without one is its own key."""
    return F.split_part(F.regexp_replace(line, r"(?U)^\s+", ""), F.lit(":"), F.lit(1))


def version_parts(name: Column) -> Column:
    """struct(major, minor, patch); null if the name is no version.

    A fourth number is dropped; a prerelease sorts before its release.
    """
    whole = r"^([0-9]+)\.([0-9]+)\.([0-9]+)(?:\.[0-9]+)?(?:-([0-9A-Za-z.-]+))?$"
    number = lambda g: F.regexp_extract(name, whole, g).try_cast("long")
    pre = F.regexp_extract(name, whole, 4)
    parts = F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), (pre == "").alias("release"), pre.alias("pre"))
    return F.when(number(1).isNotNull() & number(2).isNotNull() & number(3).isNotNull(), parts)


def nested(json: Column, *keys: str) -> Column:
    """The value at a path of keys in JSON text; null if a level is missing."""
    return F.get_json_object(json, "$" + "".join(f"['{k}']" for k in keys))
