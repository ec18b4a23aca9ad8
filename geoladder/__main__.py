"""Command line: ``python -m geoladder convert SRC DST``; the summary goes to standard output as JSON, the log to standard error."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
import sys

from geoladder.options import LayoutOptions


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="geoladder")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    c = p.add_subparsers(dest="command", required=True).add_parser("convert", help="write the layout of a table of geometries")
    c.add_argument("src")
    c.add_argument("dst")
    c.add_argument("--single-file", metavar="FILE", help="also export one interoperable Parquet file")
    for f in dataclasses.fields(LayoutOptions):
        flag = "--" + f.name.replace("_", "-")
        if f.name in ("native_geo", "bbox", "thin"):
            c.add_argument(flag, action=argparse.BooleanOptionalAction, default=f.default)
        elif f.name == "band_fractions":
            c.add_argument(flag, type=lambda s: tuple(float(x) for x in s.split(",")), default=None)
        else:
            kind = {"overview_grid": float, "importance_column": str}.get(f.name, type(f.default))
            c.add_argument(flag, type=kind, default=f.default)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.DEBUG if a.verbose else logging.ERROR if a.quiet else logging.INFO)
    options = LayoutOptions(**{f.name: getattr(a, f.name) for f in dataclasses.fields(LayoutOptions)})
    try:
        options.validate()
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    from geoladder.convert import convert
    from geoladder.session import local_session
    from geoladder.sources.writer import export_file

    spark = local_session()
    summary = convert(spark, a.src, a.dst, options)
    if a.single_file:
        export_file(spark, a.dst, a.single_file, options, native=options.native_geo)
    print(json.dumps(summary))
    return 0


if __name__ == "__main__":
    sys.exit(main())
