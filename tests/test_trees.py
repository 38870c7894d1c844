import json
import os
import random
import shutil
from pathlib import Path

import pytest

from treeloom import api, cli, report
from treeloom.functions.chunking import Options as ChunkOptions
from treeloom.manifests import build, from_dict
from treeloom.plans.apply import stage_root
from treeloom.plans.delta import Options
from treeloom.sources import codec, tree
from treeloom.sources.endpoints import parse_endpoint

PIN = ChunkOptions(4096, 1024, 16384)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def source(tmp_path):
    r = random.Random(1)
    root = tmp_path / "src"
    root.mkdir()
    (root / "config.json").write_text('{"a": 1}')
    (root / "model.safetensors.index.json").write_text("{}" * 50)
    for i in (1, 2):
        (root / f"model-0000{i}-of-00002.safetensors").write_bytes(r.randbytes(150_000))
    (root / "empty.txt").write_bytes(b"")
    (root / "a" / "b").mkdir(parents=True)
    (root / "a" / "b" / "deep.safetensors").write_bytes(r.randbytes(9000))
    return root


def same(a: Path, b: Path) -> bool:
    names = lambda d: sorted(str(p.relative_to(d)) for p in d.rglob("*") if p.is_file() and ".treeloom" not in p.parts)
    return names(a) == names(b) and all((a / n).read_bytes() == (b / n).read_bytes() for n in names(a))


def test_scan(spark, tmp_path):
    for name in ("x.bin", "_under", ".hidden", "d/.treeloom/m", "d/e/y.tmp", "skip/z", "d/.h/q", "keep/skip.bin"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"12")
    (tmp_path / "zero").write_bytes(b"")
    os.symlink(tmp_path / "x.bin", tmp_path / "link")
    os.symlink(tmp_path / "d", tmp_path / "dirlink")
    os.symlink(tmp_path / "none", tmp_path / "broken")
    os.utime(tmp_path / "x.bin", ns=(5, 1_234_567_890_123_456_789))
    got = {r.path: r for r in tree.scan(spark, str(tmp_path), exclude=["*.tmp", "skip", "["]).collect()}
    assert {p for p, r in got.items() if r.warning is None} == {"x.bin", "_under", "zero", "link", "keep/skip.bin"}
    assert {p for p, r in got.items() if r.warning} == {"dirlink", "broken"}
    assert got["x.bin"].mtime_ns == 1_234_567_890_123_456_789 and got["zero"].size == 0
    every = {r.path for r in tree.entries(tree.scan(spark, str(tmp_path), hidden=True, follow=False)).collect()}
    assert every == {"x.bin", "_under", "zero", ".hidden", "d/e/y.tmp", "skip/z", "d/.h/q", "keep/skip.bin"}
    with pytest.raises(Exception, match="NotADirectory|not a directory|x.bin"):
        tree.scan(spark, str(tmp_path / "x.bin")).collect()


def test_build_and_codecs(spark, source, tmp_path):
    m = build(spark, str(source), pin=PIN).validate()
    assert m.model["kind"] == "huggingface" and m.model["files"] == 6 and m.model["weight_files"] == 3
    assert [(s["name"], len(s["parts"]), s["total"]) for s in m.model["shards"]] == [("model.safetensors", 2, 2)]
    d = m.as_dict()
    for path in ("m.json", "m.mmm"):
        api.save_manifest(m, str(tmp_path / path))
        again = api.load_manifest(spark, str(tmp_path / path)).validate()
        assert rows(again.files) == rows(m.files) and rows(again.chunks) == rows(m.chunks)
        assert again.header["created_ns"] == m.header["created_ns"] and again.model["digest"] == m.model["digest"]
    assert os.path.getsize(tmp_path / "m.mmm") < os.path.getsize(tmp_path / "m.json") / 2
    data = codec.encode_binary(d)
    for bad in (b"", data[:-1], data[:100], b"XXXX" + data[4:], data[:5] + b"\x09" + data[6:], data[:60] + bytes([data[60] ^ 1]) + data[61:]):
        with pytest.raises(ValueError):
            codec.decode_binary(bad)
    assert codec.decode(data)["files"] == d["files"]
    from treeloom.sources.manifest_table import read_json_manifests, read_manifests

    cols = ["path", "size", "chunk_idx", "offset", "length", "digest"]
    both = read_manifests(spark, str(tmp_path / "m.*"))
    assert both.select("manifest").distinct().count() == 2 and both.count() == 2 * (m.chunks.count() + 1)
    assert rows(read_json_manifests(spark, str(tmp_path / "m.json")).select(cols).filter("chunk_idx is not null")) == rows(both.filter("manifest like '%.mmm' and chunk_idx is not null").select(cols))
    sha = build(spark, str(source), pin=PIN, algorithm="sha256").validate()
    with pytest.raises(ValueError):
        api.save_manifest(sha, str(tmp_path / "sha.mmm"))
    assert sha.chunks.count() == m.chunks.count() and sha.model["digest"] != m.model["digest"]


CORRUPTIONS = {
    "format": lambda m: m.update(format="other"), "version": lambda m: m.update(version=9), "hash": lambda m: m.update(hash="md5"),
    "duplicate": lambda m: m["files"].append(m["files"][0]), "negative": lambda m: m["files"][0].update(size=-1), "chunker": lambda m: m["files"][0]["chunker"].update(algorithm="x"),
    "gap": lambda m: m["files"][0]["chunks"][0].update(offset=1), "zero": lambda m: m["files"][0]["chunks"].append({"offset": m["files"][0]["size"], "length": 0, "digest": "00" * 32}),
    "cover": lambda m: m["files"][0].update(size=10**6), "path": lambda m: m["files"][0].update(path="../x"),
}


@pytest.mark.parametrize("what", CORRUPTIONS)
def test_validation(spark, what):
    sizes = {"algorithm": "gear-lowbits-seeded", "avg_size": 256, "min_size": 64, "max_size": 1024}
    m = {"format": "treeloom-manifest", "version": 1, "tool": "", "created_ns": 0, "hash": "blake3-256", "chunker": sizes, "model": {}, "files": [{"path": "a", "size": 10, "mode": 420, "mtime_ns": 1, "role": "other", "digest": "01" * 32, "chunker": dict(sizes), "chunks": [{"offset": 0, "length": 10, "digest": "02" * 32}]}]}
    from_dict(spark, m).validate()
    CORRUPTIONS[what](m)
    with pytest.raises(ValueError):
        from_dict(spark, m).validate()


def test_diff(spark, source):
    old = build(spark, str(source), pin=PIN)
    f = source / "model-00001-of-00002.safetensors"
    data = bytearray(f.read_bytes())
    data[70_000:70_064] = b"x" * 64
    f.write_bytes(data)
    (source / "copy.bin").write_bytes((source / "model-00002-of-00002.safetensors").read_bytes())
    (source / "config.json").unlink()
    files, totals = api.diff(old, build(spark, str(source), pin=PIN))
    t = totals.first()
    assert (t["added"], t["removed"], t["modified"], t["unchanged"]) == (1, 1, 1, 4)
    assert 0 < t["transfer_bytes"] <= 40_000 and not t["identical"]
    assert "..." not in report.diff_text("a", "b", files, t) and "copy.bin" in report.diff_text("a", "b", files, t)
    none = api.diff(None, old)[1].first()
    assert none["added"] == 6 and none["similarity"] == 0 and api.diff(old, old)[1].first()["identical"]


def test_copy_sync_verify(spark, source, tmp_path):
    dest = tmp_path / "dst"
    options = {"pin": PIN}
    dry = api.copy(spark, str(source), str(dest), dry_run=True, **options)
    assert dry["copy_files"] == 6 and not dest.exists()
    first = api.copy(spark, str(source), str(dest), **options)
    assert same(source, dest) and first["received_bytes"] + first["reused_bytes"] == first["total_bytes"] and not first["errors"]
    assert all((source / p).stat().st_mtime_ns == (dest / p).stat().st_mtime_ns for p in ("config.json", "a/b/deep.safetensors"))
    again = api.copy(spark, str(source), str(dest), **options)
    assert again["skip_files"] == 6 and again["need_bytes"] == 0 and again["savings"] == 1
    f = source / "model-00001-of-00002.safetensors"
    data = bytearray(f.read_bytes())
    data[70_000:70_007] = b"x" * 7
    f.write_bytes(data)
    shutil.move(source / "model-00002-of-00002.safetensors", source / "renamed.safetensors")
    (dest / ".dot").write_text("x")
    got = api.sync(spark, str(source), str(dest), **options)
    assert same(source, dest) and got["need_bytes"] <= got["total_bytes"] / 4 and got["deleted_files"] == 2 and not (dest / ".dot").exists()
    fine = api.verify(spark, str(dest), extra=True)
    assert fine["problems"].count() == 0 and fine["extra"].count() == 0 and fine["totals"].first()["files_ok"] == 6
    bad = bytearray((dest / "renamed.safetensors").read_bytes())
    bad[100_000:100_032] = b"!" * 32
    (dest / "renamed.safetensors").write_bytes(bad)
    (dest / "config.json").write_text("{}")
    (dest / "empty.txt").unlink()
    (dest / "more").write_text("x")
    found = api.verify(spark, str(dest), extra=True)
    assert [(r.path, r.problem) for r in found["problems"].collect()] == [("config.json", "size-mismatch"), ("empty.txt", "missing"), ("renamed.safetensors", "digest-mismatch")]
    ranges = found["bad_chunks"].collect()
    assert len(ranges) == 1 and ranges[0].offset <= 100_000 < ranges[0].offset + ranges[0].length
    assert [r.path for r in found["extra"].collect()] == ["more"] and "damaged" in report.verify_text(found)
    assert api.verify(spark, str(dest), quick=True)["bad_chunks"].count() == 0
    api.sync(spark, str(source), str(dest), Options(delete=True, atomic="model"), **options)
    assert same(source, dest) and api.verify(spark, str(dest), extra=True)["problems"].count() == 0


def test_rename_needs_dedupe(spark, source, tmp_path):
    dest = tmp_path / "dst"
    dest.mkdir()
    shutil.copy(source / "model-00001-of-00002.safetensors", dest / "old-name")
    with_it = api.copy(spark, str(source), str(dest), pin=PIN, dry_run=True)
    without = api.copy(spark, str(source), str(dest), Options(dedupe=False), pin=PIN, dry_run=True)
    assert without["need_bytes"] - with_it["need_bytes"] == 150_000


def test_fast_and_resume(spark, source, tmp_path):
    dest = tmp_path / "dst"
    api.copy(spark, str(source), str(dest), pin=PIN)
    fast = api.copy(spark, str(source), str(dest), Options(fast=True), pin=PIN, dry_run=True)
    assert fast["skip_files"] == 6 and fast["need_bytes"] == 0
    (dest / "model-00001-of-00002.safetensors").unlink()
    whole = (source / "model-00001-of-00002.safetensors").read_bytes()
    part = Path(stage_root(str(dest)), "model-00001-of-00002.safetensors.part")
    part.parent.mkdir(parents=True, exist_ok=True)
    part.write_bytes(whole[:75_000] + bytes(75_000))
    resumed = api.copy(spark, str(source), str(dest), Options(dedupe=False), pin=PIN, dry_run=True)
    fresh = api.copy(spark, str(source), str(dest), Options(dedupe=False, resume=False), pin=PIN, dry_run=True)
    assert 0 < resumed["need_bytes"] < 95_000 and fresh["need_bytes"] == 150_000
    api.copy(spark, str(source), str(dest), pin=PIN)
    assert same(source, dest)


def test_interrupted_run_is_taken_up(spark, source, tmp_path):
    """A task that was killed leaves an attempt: only what it lacks is sent, and what is left of it goes."""
    dest, name = tmp_path / "dst", "model-00001-of-00002.safetensors"
    whole = (source / name).read_bytes()
    attempt = Path(stage_root(str(dest)), f"{name}.{'0af' * 10}00.attempt")
    attempt.parent.mkdir(parents=True)
    attempt.write_bytes(whole[:100_000] + bytes(50_000))
    got = api.copy(spark, str(source), str(dest), pin=PIN)
    assert same(source, dest) and not got["errors"] and got["total_bytes"] - 100_000 <= got["received_bytes"] < got["total_bytes"] - 80_000
    assert not Path(stage_root(str(dest))).exists()


def test_failed_file_is_told_and_kept(spark, source, tmp_path, monkeypatch):
    from treeloom.plans import apply as applying

    dest, f = tmp_path / "dst", source / "model-00002-of-00002.safetensors"
    m = build(spark, str(source), pin=PIN)
    data = f.read_bytes()
    f.write_bytes(data[:120_000] + b"?" * 1000 + data[121_000:])
    got = applying.apply(spark, m, str(source), str(dest), pin=PIN)
    assert list(got["errors"]) == [f.name] and "changed" in got["errors"][f.name] and not (dest / f.name).exists() and (dest / "config.json").exists()
    f.write_bytes(data)
    monkeypatch.setattr(codec, "save", lambda *a: (_ for _ in ()).throw(OSError(28, "No space left on device")))
    got = applying.apply(spark, m, str(source), str(dest), pin=PIN, verify=False)
    assert not got["errors"] and len(got["warnings"]) == 1 and got["received_bytes"] < 60_000 and same(source, dest)


def test_verify_tells_links(spark, source, tmp_path):
    m = build(spark, str(source), pin=PIN)
    os.symlink("loop", source / "loop")  # can't be resolved, for another reason than that it leads nowhere
    os.symlink(source / "config.json", source / "more")
    m.files.createOrReplaceTempView("own_files")
    loop = spark.sql("SELECT replace(path, 'empty.txt', 'loop') AS path, size, mode, mtime_ns, role, digest, chunker FROM own_files WHERE path = 'empty.txt'")
    from treeloom.manifests import Manifest

    got = api.verify(spark, str(source), Manifest(m.header, m.model, m.files.union(loop), m.chunks), extra=True)
    assert [(r.path, r.problem) for r in got["problems"].collect()] == [("loop", "unreadable")] and got["extra"].count() == 0


def test_refusals(spark, source, tmp_path):
    for dest in (source, source / "in", source / ".in", source.parent):
        with pytest.raises(ValueError):
            api.copy(spark, str(source), str(dest))
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        api.copy(spark, str(tmp_path / "none"), str(tmp_path / "d"))


def test_cli(spark, source, tmp_path, capsys):
    run = lambda *a: cli.main(list(a), spark)
    dest = str(tmp_path / "dst")
    assert run("copy", str(source), dest, "--chunk-size", "4K", "--json") == 0
    assert json.loads(capsys.readouterr().out)["copy_files"] == 6
    assert run("sync", str(source), dest, "--chunk-size", "4K", "--no-verify", "--no-progress", "--jobs", "2", "--manifest", str(tmp_path / "sent.json"), "--manifest-format", "json") == 0
    assert api.load_manifest(spark, str(tmp_path / "sent.json")).model["files"] == 6
    with pytest.raises(SystemExit):
        run("--version")
    assert "treeloom" in capsys.readouterr().out
    assert run("verify", dest) == 0 and run("manifest", str(source), "-o", str(tmp_path / "a.json")) == 0
    assert run("diff", str(tmp_path / "a.json"), str(tmp_path / "a.json"), "--exit-code") == 0
    assert "identical" in capsys.readouterr().out
    (Path(dest) / "config.json").write_text("[]")
    assert run("verify", dest) == 2 and run("verify", str(tmp_path / "nowhere")) == 1 and run("manifest", dest, "-o", str(tmp_path / "b.json")) == 0
    assert run("diff", str(tmp_path / "a.json"), str(tmp_path / "b.json"), "--exit-code") == 2


@pytest.mark.parametrize(("text", "want"), [("/a/b", ("file", "/a/b", "", "", 0)), ("./a:b", ("file", "./a:b", "", "", 0)), ("file:///x", ("file", "/x", "", "", 0)), ("h:/p", ("ssh", "/p", "h", "", 0)), ("u@h:p", ("ssh", "p", "h", "u", 0)), ("SSH://u@h:22/p/q", ("ssh", "/p/q", "h", "u", 22)), ("host:", ("file", "host:", "", "", 0)), ("a/b:c", ("file", "a/b:c", "", "", 0))])
def test_endpoints(text, want):
    e = parse_endpoint(text)
    assert (e.scheme, e.path, e.host, e.user, e.port) == want


@pytest.mark.parametrize("text", ["", " ", "ssh://", "ssh://h", "ssh://u@/p", "ssh://h:0/p", "ssh://h:x/p", "ssh://h:99999/p"])
def test_endpoints_rejected(text):
    with pytest.raises(ValueError):
        parse_endpoint(text)
