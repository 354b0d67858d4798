"""Lint, format and check of a script tree, as DataFrame plans."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import suppress
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import requirements, scalars
from ..operators import blocks, graph, report
from ..sources import files as tree
from ..sources import script, versions

# Block kinds whose fields need localisation.
EVENT_KINDS = ("country_event", "news_event", "operative_leader_event", "state_event", "unit_leader_event")


class NotATree(FileNotFoundError):
    """The folder has no readable descriptor."""


class MissingLocalisations(Exception):
    pass


class FormatDrift(Exception):
    pass


def referenced(found: script.Tree, route: str) -> Iterator[str]:
    """Texts of a file's events, ids of its focuses or names of its technologies."""
    parent, key = found.parent, found.key

    def under(n: int, *keys: str) -> bool:
        """Whether ``keys`` are those from node n up to the first level."""
        for k in keys:
            if n < 0 or key[n] != k:
                return False
            n = parent[n]
        return n < 0

    for up, name, scalar in zip(parent, key, found.scalar, strict=True):
        if route == "technologies":
            if name is not None and not name.startswith("@") and under(up, "technologies"):
                yield name
        elif scalar is None:
            continue
        elif route == "national_focus":
            if name == "id" and under(up, "focus", "focus_tree"):
                yield scalar
        elif name in ("title", "desc", "name"):
            if name == "name":
                up = parent[up] if up >= 0 and key[up] == "option" else -1
            if up >= 0 and parent[up] < 0 and key[up] in EVENT_KINDS:
                yield scalar


def references(files: DataFrame) -> DataFrame:
    """refs(key, path, offset): texts of events, ids of focuses, names of technologies."""

    def rows(text: str, found: script.Tree | None, route: str) -> Iterator[tuple]:
        if found:
            yield from ((x, script.hit(found, x)) for x in dict.fromkeys(referenced(found, route)))

    own = tree.routed(files).filter(F.col("route").isin(*tree.FOLDERS.values()))
    return report.first_refs(script.per_file(own, "key string, offset long", rows, ("route",)).select("key", "path", "offset"))


class Graph(NamedTuple):
    """Ids in order of place, and edges (src, dst) between ids, which may lie outside."""

    ids: list[str]
    edges: list[tuple[str, str]]


def focus_graphs(found: script.Tree) -> dict[int, Graph]:
    """The graph of each focus tree of a file, by its node; a later id, or place relative to another, replaces the one before it."""
    trees: dict[int, list[int]] = {}
    focuses: dict[int, dict[str, str]] = {}
    needs: dict[int, int] = {}
    needed: dict[int, list[str]] = {}
    for n, (parent, key, scalar) in enumerate(zip(found.parent, found.key, found.scalar, strict=True)):
        if scalar is None:
            if parent < 0:
                if key == "focus_tree":
                    trees[n] = []
            elif parent in trees and key == "focus":
                trees[parent].append(n)
                focuses[n] = {}
                needed[n] = []
            elif parent in focuses and key == "prerequisite":
                needs[n] = parent
        elif parent in focuses:
            if key in ("id", "relative_position_id"):
                focuses[parent][key] = scalar
        elif parent in needs and key == "focus":
            needed[needs[parent]].append(scalar)
    out = {}
    for n, own in trees.items():
        named = [(focuses[k]["id"], k) for k in own if "id" in focuses[k]]
        anchors = [(focuses[k]["relative_position_id"], x) for x, k in named if "relative_position_id" in focuses[k]]
        out[n] = Graph([x for x, _ in named], anchors + [(src, x) for x, k in named for src in needed[k]])
    return out


def event_graph(found: script.Tree) -> Graph:
    """The same for the events of a file, whose places are their natural order."""
    root: dict[int, int] = {}
    ids: dict[int, str] = {}
    # A trigger is an event kind at any depth, but not within another trigger.
    triggers: set[int] = set()
    within: set[int] = set()
    edges: list[tuple[int, str]] = []
    for n, (parent, key, scalar) in enumerate(zip(found.parent, found.key, found.scalar, strict=True)):
        if parent < 0:
            if scalar is None and key in EVENT_KINDS:
                root[n] = n
            continue
        event = root.get(parent)
        if event is None:
            continue
        if scalar is None:
            root[n] = event
            if parent in within:
                within.add(n)
            elif key in EVENT_KINDS:
                within.add(n)
                triggers.add(n)
        elif key == "id":
            if parent == event:
                ids[event] = scalar
            elif parent in triggers:
                edges.append((event, scalar))
        elif key in EVENT_KINDS and parent not in within:
            edges.append((event, scalar))
    place = sorted(ids, key=lambda n: (scalars.natural_parts(ids[n]), n))
    return Graph([ids[n] for n in place], [(ids[n], dst) for n, dst in edges if n in ids])


def event_edges(files: DataFrame) -> DataFrame:
    """(path, src, dst, src_at, dst_at): triggers between events of a file, with the natural place of both ends."""

    def rows(text: str, found: script.Tree | None) -> Iterator[tuple]:
        graph_ = event_graph(found) if found else Graph([], [])
        at: dict[str, list[int]] = {}
        for k, x in enumerate(graph_.ids):
            at.setdefault(x, []).append(k + 1)
        for src, dst in graph_.edges:
            yield from ((src, dst, a, b) for a in at[src] for b in at.get(dst, ()))

    return script.per_file(files.filter("folder = 'events'"), "src string, dst string, src_at int, dst_at int", rows)


def focus_edges(files: DataFrame) -> DataFrame:
    """(path, tree, src, dst): edges between focuses of a tree, whose number is its node."""

    def rows(text: str, found: script.Tree | None) -> Iterator[tuple]:
        for n, own in (focus_graphs(found) if found else {}).items():
            ids = set(own.ids)
            yield from ((n, src, dst) for src, dst in own.edges if src in ids)

    return script.per_file(files.filter("folder = 'common/national_focus'"), "tree int, src string, dst string", rows)


def rewrites(files: DataFrame) -> DataFrame:
    """rewrites(path, kind, text, new_text, changed) of all focus and event files.

    A graph lies within one file, so a file is parsed, ordered and rewritten in one turn.
    """

    def rows(text: str, found: script.Tree | None, folder: str) -> Iterator[tuple]:
        ids: list[str] = []
        if folder == "events":
            kind, keywords, graphs = "events", EVENT_KINDS, [event_graph(found)] if found else []
        else:
            kind, keywords, graphs = "focus", ("focus",), focus_graphs(found).values() if found else []
        for own in graphs:
            ids += graph.order_ids(*own) or []
        new = blocks.in_order(text, found, ids, keywords)
        yield kind, text, new, new != text

    own = files.filter(F.col("folder").isin("common/national_focus", "events"))
    out = script.per_file(own, "kind string, text string, new_text string, changed boolean", rows, ("folder",))
    return out.drop("folder")


def write(changes: DataFrame) -> None:
    """Overwrites the changed files, each at once; files that can't be written stay as they are."""

    def put(rows) -> None:  # noqa: ANN001
        for r in rows:
            beside = f"{r['path']}.new"
            try:
                with open(beside, "w", encoding="utf-8", newline="") as f:
                    f.write(r["new_text"])
                os.replace(beside, r["path"])
            except OSError:
                # What is left would be read as a file of the tree.
                with suppress(OSError):
                    os.remove(beside)

    changes.filter("changed").select("path", "new_text").foreachPartition(put)


class Lint(NamedTuple):
    diagnostics: DataFrame
    summary: DataFrame
    #: What is persisted for both.
    kept: tuple[DataFrame, ...] = ()


def lint(spark: SparkSession, root: str, langs: list[str] | None = None, every: bool = False, version_data: DataFrame | None = None) -> Lint:
    """Missing keys of the active languages (English if none is named), and what is wrong with the descriptor."""
    descriptor = os.path.join(root, "descriptor.mod")
    try:
        with open(descriptor, encoding="utf-8", newline="") as f:
            text = f.read()
    except (OSError, UnicodeDecodeError) as e:
        raise NotATree(descriptor) from e
    tree.check_walk(root)
    chosen = tree.active(spark, langs, every)
    files = tree.read_tree(spark, root, within=tree.ROUTES)
    keys = tree.load_keys(tree.active_files(files, chosen))
    # Three results come from both, so the tree is read and parsed once.
    refs = references(files).persist()
    gone = report.missing(refs, chosen, keys).persist()
    shown = report.top(gone).join(refs, "key").select(F.lit("missing_localisation").alias("kind"), F.lit("warning").alias("severity"), "key", F.col("absent").alias("detail"), "path", "offset", F.octet_length("key").cast("long").alias("length"), "rank")
    own = spark.createDataFrame([(descriptor, text)], "path string, text string")
    return Lint(shown.unionByName(check_descriptor(own, version_data)), report.summary(refs, gone), (refs, gone))


# What a diagnostic says, and the label of its span.
MESSAGES = {
    "missing_localisation": ('"{key}" not localised in: {detail}.', "missing localisation"),
    "duplicate_key": ('duplicate key "{key}" in descriptor.mod.', "duplicate key"),
    "version_mismatch": ('descriptor.mod supported_version "{key}" does not match the latest version {detail}.', "unsupported version"),
}


def rendered(spark: SparkSession, root: str, rows: list) -> list[str]:
    """The diagnostics with their lines of source; only their files are read."""
    paths = sorted({r["path"] for r in rows})
    texts = {r["path"]: r["text"] for r in tree.read_tree(spark, root, only=paths).collect()} if paths else {}
    out = []
    for r in rows:
        message, label = MESSAGES[r["kind"]]
        out.append(report.rendered(r["severity"], message.format(key=r["key"], detail=r["detail"]), label, r["path"], texts.get(r["path"], ""), r["offset"], r["length"]))
    return out


def check_descriptor(descriptor: DataFrame, version_data: DataFrame | None = None) -> DataFrame:
    """Repeated keys, whether or not there is version data, and a requirement that the latest version misses."""

    def rows(text: str, found: script.Tree | None) -> Iterator[tuple]:
        # Of each key its place after the first one, which is that of all its repeats; looked for once.
        again: dict[str, int | None] = {}
        for n, (parent, key, scalar) in enumerate(zip(found.parent, found.key, found.scalar, strict=True) if found else ()):
            if parent >= 0 or key is None:
                continue
            if key not in again:
                again[key] = None
                if key == "supported_version" and scalar is not None:
                    yield "version_mismatch", scalar, script.hit(found, scalar), n
            elif key != "replace_path":
                if again[key] is None:
                    again[key] = script.hit(found, key, second=True)
                yield "duplicate_key", key, again[key], n

    fields = script.per_file(descriptor, "kind string, key string, offset long, rank int", rows)
    columns = ["kind", F.lit("warning").alias("severity"), "key", F.col("detail"), "path", "offset", F.octet_length("key").cast("long").alias("length"), "rank"]
    out = fields.filter("kind = 'duplicate_key'").withColumn("detail", F.lit("")).select(*columns)
    if version_data is not None:
        latest = versions.latest(version_data).filter("version is not null").withColumnRenamed("version", "detail")
        wanted = fields.filter("kind = 'version_mismatch'").crossJoin(F.broadcast(latest))
        out = out.unionByName(wanted.filter(~requirements.requirement_matches(F.col("key"), F.col("detail"))).select(*columns))
    return out


def run(spark: SparkSession, root: str = ".", do_lint: bool = False, do_format: bool = False, do_check: bool = False, langs: list[str] | None = None, every: bool = False, version_data: DataFrame | None = None, show=print) -> None:
    """All that was asked for, in the order format, check, lint; lint alone if nothing was.

    A lint error comes first and hides drift.
    """
    if not (do_lint or do_format or do_check):
        do_lint = True
    drift = False
    if do_format or do_check:
        changes = rewrites(tree.read_tree(spark, root, within=("common/national_focus", "events")))
        if do_format:
            write(changes)
            changes = rewrites(tree.read_tree(spark, root, within=("common/national_focus", "events")))
        if do_check:
            drift = bool(changes.agg(F.coalesce(F.bool_or("changed"), F.lit(False))).first()[0])
    if do_lint:
        found = lint(spark, root, langs, every, version_data)
        rows = found.diagnostics.orderBy("kind", "rank").collect()
        s = found.summary.first()
        for x in found.kept:
            x.unpersist()
        for x in rendered(spark, root, rows):
            show(x)
        if s["hidden"]:
            show(f"... and {s['hidden']} more")
        show(s["line"])
        if s["missing"]:
            raise MissingLocalisations(s["line"])
    if drift:
        raise FormatDrift(root)
