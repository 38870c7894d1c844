"""Results as text and JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from treeloom.functions.units import format_bytes, format_duration, format_percent, format_rate, truncate_left

LIMIT, RANGES = 20, 5


def plain(value):
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, DataFrame):
        return [plain(r) for r in value.toLocalIterator()]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def as_json(value) -> str:
    return json.dumps(plain(value), indent=2, ensure_ascii=False)


def diff_text(old: str, new: str, rows: DataFrame, totals: Row, limit: int = LIMIT) -> str:
    from treeloom.operators.diff import top_changed

    if totals["identical"]:
        return f"{old} and {new} are identical"
    counts = ", ".join(f"{totals[k]} {k}" for k in ("added", "modified", "removed", "unchanged"))
    out = [f"{old} -> {new}: {counts}", f"to transfer {format_bytes(totals['transfer_bytes'])}, reusable {format_bytes(totals['reusable_bytes'])} ({100 * totals['similarity']:.1f}% similar)"]
    changed = rows.filter("change <> 'unchanged'").count()
    out += [f"  {r['change']:9} {format_bytes(r['new_bytes']):>10}  {truncate_left(r['path'], 60)}" for r in top_changed(rows, limit).collect()]
    return "\n".join(out + ([f"  ... and {changed - limit} more"] if limit and changed > limit else []))


def plan_text(files: DataFrame, totals: Row, limit: int = LIMIT) -> str:
    out = [f"{format_bytes(totals['need_bytes'])} of {format_bytes(totals['total_bytes'])} to send ({100 * totals['savings']:.1f}% saved)"]
    top = files.filter("action <> 'skip'").orderBy(F.col("need_bytes").desc(), "path")
    rows = (top.limit(limit) if limit else top).collect()
    return "\n".join(out + [f"  {r['action']:6} {format_bytes(r['need_bytes']):>10} of {format_bytes(r['size']):>10}  {truncate_left(r['path'], 60)}" for r in rows])


def transfer_text(result: dict, seconds: float) -> str:
    total, got = result["total_bytes"], result.get("received_bytes", 0)
    rate = format_rate(total / seconds) if seconds > 0 else format_rate(0)
    return f"{result.get('written_files', 0)} written, {result['skip_files']} skipped, {result.get('deleted_files', 0)} deleted; {format_bytes(got)} of {format_bytes(total)} sent ({format_percent(total - got, total)} saved) in {format_duration(seconds)}, {rate}"


def shown_ranges(bad: DataFrame, each: int = RANGES) -> DataFrame:
    """The first ranges of each path."""
    own = Window.partitionBy("path").orderBy("chunk_idx")
    return bad.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= each).drop("_n")


def verify_text(result: dict[str, DataFrame], limit: int = LIMIT) -> str:
    problems, extra = result["problems"], result["extra"]
    n, m = problems.count(), extra.count()
    totals = result["totals"].first()
    out = [f"{totals['files_ok']} of {totals['files']} files ok, {format_bytes(totals['bytes_checked'])} checked"]
    if n:
        out.append(f"{n} problem file(s):")
    rows = (problems.limit(limit) if limit else problems).collect()
    ranges: dict[str, list[Row]] = {}
    shown = result["bad_chunks"].filter(F.col("path").isin([r["path"] for r in rows])) if rows else result["bad_chunks"].limit(0)
    for r in shown_ranges(shown).collect():
        ranges.setdefault(r["path"], []).append(r)
    for r in rows:
        out.append(f"  {r['problem']:15} {r['path']}")
        out += [f"    bytes {c['offset']}..{c['offset'] + c['length']} damaged" for c in ranges.get(r["path"], [])]
    if limit and n > limit:
        out.append(f"  ... and {n - limit} more")
    if m:
        out.append(f"{m} extra file(s):")
        out += [f"  {r['path']}" for r in (extra.limit(limit) if limit else extra).collect()]
    return "\n".join(out)
