"""``python -m marlstone [--lint] [--format] [--check] [--lang NAME]... [--all] [--versions FILE] [--cache FOLDER] [PATH]``."""

from __future__ import annotations

import argparse
import sys
import time

from .functions.scalars import LANGUAGES


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="marlstone", description="Checks and normalises trees of nested key/value scripts.")
    p.add_argument("--lint", action="store_true", help="report keys without localisation (the default action)")
    p.add_argument("--format", action="store_true", help="rewrite files with their blocks in order")
    p.add_argument("--check", action="store_true", help="fail if --format would change a file")
    which = p.add_mutually_exclusive_group()
    which.add_argument("--lang", action="append", choices=[cli for cli, _ in LANGUAGES], help="a language to check; English if none is given")
    which.add_argument("--all", action="store_true", help="check all languages")
    p.add_argument("--versions", help="captured key-values text with the app's branches")
    p.add_argument("--cache", help="folder of the version cache, which is used for a day; MARLSTONE_CACHE_DIR if not given")
    p.add_argument("path", nargs="?", default=".")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from .plans import trees
    from .sources import versions
    from .sources.files import WalkFailed

    args = arguments(sys.argv[1:] if argv is None else argv)
    began = time.monotonic()
    spark = SparkSession.builder.appName("marlstone").getOrCreate()
    text = None
    if args.versions:
        with open(args.versions, encoding="utf-8") as f:
            text = f.read()
    names = versions.cached(spark, versions.cache_path(args.cache), text)
    try:
        trees.run(spark, args.path, args.lint, args.format, args.check, args.lang, args.all, names)
    except (trees.MissingLocalisations, trees.FormatDrift, trees.NotATree, WalkFailed) as e:
        print(f"error: {type(e).__name__}: {e}", file=sys.stderr)
        return 1
    print(f"done in {time.monotonic() - began:.2f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
