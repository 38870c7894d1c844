"""python -m treeloom.cli {manifest,diff,verify,copy,sync}. Exit codes: 0 ok, 1 error, 2 content differs."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from treeloom import __version__, api, report
from treeloom.functions.chunking import Options as ChunkOptions
from treeloom.functions.units import parse_size
from treeloom.manifests import build
from treeloom.plans.delta import Options
from treeloom.sources.codec import parse_encoding
from treeloom.sources.endpoints import parse_endpoint

ATOMIC = {"": "file", "file": "file", "model": "model", "dir": "model", "all": "model"}


def parse_atomic(name: str) -> str:
    try:
        return ATOMIC[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown atomic mode {name!r}") from None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="treeloom")
    p.add_argument("--version", action="version", version=f"treeloom {__version__}")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--quiet", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def shared(c, build_too: bool) -> None:
        c.add_argument("--json", action="store_true")
        if build_too:
            for k in ("chunk-size", "min-chunk", "max-chunk"):
                c.add_argument(f"--{k}", default="")
            c.add_argument("--exclude", action="append", default=[])
            c.add_argument("--hidden", action="store_true")
            c.add_argument("--no-follow-symlinks", action="store_true")
            c.add_argument("--name")

    for name in ("copy", "sync"):
        c = sub.add_parser(name)
        c.add_argument("source")
        c.add_argument("dest")
        shared(c, True)
        for flag in ("fast", "dry-run", "no-dedupe", "no-resume", "no-preserve-times", "no-verify", "no-progress"):
            c.add_argument(f"--{flag}", action="store_true")
        c.add_argument("--manifest", help="write the source's manifest to this file")
        c.add_argument("--manifest-format", type=parse_encoding, default="auto")
        c.add_argument("--jobs", type=int, default=0, help="tasks at once, of a session that this command starts")
        c.add_argument("--atomic", type=parse_atomic, default="file")
        if name == "sync":
            c.add_argument("--delete", action=argparse.BooleanOptionalAction, default=True)
    c = sub.add_parser("verify")
    c.add_argument("dir")
    c.add_argument("--manifest")
    c.add_argument("--quick", action="store_true")
    c.add_argument("--extra", action="store_true")
    c.add_argument("--limit", type=int, default=report.LIMIT)
    shared(c, False)
    c = sub.add_parser("manifest")
    c.add_argument("dir")
    c.add_argument("-o", "--output", default="-")
    c.add_argument("--format", type=parse_encoding, default="auto")
    c.add_argument("--summary", action="store_true")
    shared(c, True)
    c = sub.add_parser("diff")
    c.add_argument("old")
    c.add_argument("new")
    c.add_argument("--limit", type=int, default=report.LIMIT)
    c.add_argument("--exit-code", action="store_true")
    shared(c, False)
    return p


def _build_options(a, warnings: list[str]) -> dict:
    size = lambda s: parse_size(s) if s else 0
    pin = ChunkOptions(size(a.chunk_size), size(a.min_chunk), size(a.max_chunk))
    return {"pin": pin.normalized().validate() if pin.avg_size else None, "hidden": a.hidden, "follow": not a.no_follow_symlinks, "exclude": a.exclude, "name": a.name, "warnings": warnings}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    warnings: list[str] = []
    try:
        if spark is None:
            builder = SparkSession.builder.appName("treeloom")
            if getattr(a, "jobs", 0) > 0:
                builder = builder.master(f"local[{a.jobs}]")
            if a.quiet or getattr(a, "no_progress", False):
                builder = builder.config("spark.ui.showConsoleProgress", "false")
            spark = builder.getOrCreate()
        return _run(a, spark, warnings)
    except (OSError, ValueError) as x:
        print(f"error: {x}", file=sys.stderr)
        return 1
    finally:
        if a.verbose:
            for w in warnings:
                print(f"warning: {w}", file=sys.stderr)


def _run(a, spark: SparkSession, warnings: list[str]) -> int:
    say = (lambda x: None) if a.quiet else print
    if a.command == "manifest":
        m = build(spark, a.dir, **_build_options(a, warnings))
        if a.summary:
            from treeloom.operators.manifest import manifest_summary

            say(report.as_json(manifest_summary(m.files, m.chunks).first()))
        else:
            api.save_manifest(m, a.output, a.format)
        return 0
    if a.command == "diff":
        rows, totals = api.diff(api.load_manifest(spark, a.old).validate(), api.load_manifest(spark, a.new).validate())
        t = totals.first()
        say(report.as_json({"totals": t, "files": rows}) if a.json else report.diff_text(a.old, a.new, rows, t, a.limit))
        return 2 if a.exit_code and not t["identical"] else 0
    if a.command == "verify":
        got = api.verify(spark, a.dir, api.load_manifest(spark, a.manifest) if a.manifest else None, quick=a.quick, extra=a.extra)
        say(report.as_json(got) if a.json else report.verify_text(got, a.limit))
        return 2 if got["problems"].head() or got["extra"].head() else 0
    source, dest = parse_endpoint(a.source).local_path, parse_endpoint(a.dest).local_path
    options = Options(dedupe=not a.no_dedupe, fast=a.fast, atomic=a.atomic, resume=not a.no_resume, delete=getattr(a, "delete", False))
    began = time.time()
    got = api.copy(spark, source, dest, options, manifest=a.manifest, manifest_format=a.manifest_format, preserve_times=not a.no_preserve_times, dry_run=a.dry_run, verify=not a.no_verify, **_build_options(a, warnings))
    warnings += got["warnings"]
    say(report.as_json(got) if a.json else report.transfer_text(got, time.time() - began))
    for path, error in got["errors"].items():
        print(f"error: {path}: {error}", file=sys.stderr)
    return 2 if got["errors"] else 0


if __name__ == "__main__":
    sys.exit(main())
