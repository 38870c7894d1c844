import posixpath
import random
import re

import pytest
from pyspark.sql import functions as F

from treeloom.functions import paths, units
from treeloom.functions.hashing import parse_digest, parse_digest_column


@pytest.mark.parametrize(("text", "want"), [("0", 0), ("4096", 4096), ("64K", 65536), ("64k", 65536), ("1MiB", 1 << 20), ("1mb", 10**6), ("2.5g", 5 << 29), (" 7 kb ", 7000), ("3 b", 3), ("1t", 1 << 40), ("1TB", 10**12), ("0.5k", 512), ("1.9", 1), ("1e3", 1000)])
def test_parse_size(text, want):
    assert units.parse_size(text) == want


@pytest.mark.parametrize("text", ["", "  ", "k", "-1", "x", "1x", "nan", "inf", "9e30", "1 000", "1_0"])
def test_parse_size_rejects(text):
    with pytest.raises(ValueError):
        units.parse_size(text)


def test_size_columns(spark):
    r = random.Random(1)
    texts = ["0", "64K", "1mib", "2.5g", "7 kb", "x", "", "-1", "nan", "1kk", "9e30", ".5k", "5.", "1e3", "12b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", units.parse_size_column(F.col("t"))).collect()
    for t, got in rows:
        try:
            want = units.parse_size(t)
        except ValueError:
            want = None
        assert got == want, t
    numbers = [0, 1, 1023, 1024, 1280, 1536, 102399, 102400, 104857600, -5000, 1 << 50, (1 << 60) + 7, 2621440, *[r.randrange(1 << r.randrange(1, 62)) for _ in range(500)], *[int(k * 51.2) << 10 for k in range(300)]]
    for n, said in spark.createDataFrame([(n,) for n in numbers], "n long").select("n", units.format_bytes_column(F.col("n"))).collect():
        assert said == units.format_bytes(n), n


def test_formats():
    assert [units.format_bytes(n) for n in (0, 1023, 1024, 1536, 102400, 15 << 30, -2048, 412 << 20)] == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "100 KiB", "15.0 GiB", "-2.0 KiB", "412 MiB"]
    assert [units.format_rate(x) for x in (0, -1, float("nan"), float("inf"), 2048)] == ["0 B/s"] * 4 + ["2.0 KiB/s"]
    assert [units.format_duration(x) for x in (-3, 45, 192, 3840)] == ["0s", "45s", "3m12s", "1h04m"]
    assert [units.format_percent(*x) for x in ((1, 0), (1, 2), (0, 5))] == ["100%", "50%", "0%"]
    assert units.truncate_left("abcdefgh", 6) == "...fgh" and units.truncate_left("abc", 6) == "abc"


GOOD = ["a", "a/b.c", "..a", "a/..b", ".hidden/x"]
BAD = ["", "/a", "a\\b", "a//b", "a/", "./a", "a/./b", "a/../b", "..", "../a", ".treeloom", ".treeloom/m", "a\0b", "a/.."]


def test_paths(spark):
    assert all(paths.path_problem(p) is None for p in GOOD) and all(paths.path_problem(p) for p in BAD)
    r = random.Random(2)
    made = ["/".join(r.choice(["a", ".", "..", "", "b.c", "...", ".treeloom", "x\\y"]) for _ in range(r.randrange(1, 5))) for _ in range(1500)]
    rows = spark.createDataFrame([(p,) for p in {*GOOD, *BAD, *made}], "p string").select("p", paths.path_problem_column(F.col("p")), paths.basename(F.col("p")), paths.dirname(F.col("p")), paths.extension(F.col("p"))).collect()
    for p, problem, base, folder, ext in rows:
        assert problem == paths.path_problem(p), p
        assert (folder, base) == (p[: p.rfind("/") + 1], p[p.rfind("/") + 1 :])
        assert ext == (base[base.rfind(".") :] if "." in base else "")
        assert posixpath.join(folder, base) == p


@pytest.mark.parametrize(("glob", "yes", "no"), [("*.bin", ["a.bin"], ["a/b.bin", "a.bin\n"]), ("a?c", ["abc"], ["a/c", "ac"]), ("[a-c]x", ["bx"], ["dx", "-x"]), ("[^a]x", ["bx"], ["ax", "/x"]), ("a\\*", ["a*"], ["ab"]), ("d/*", ["d/x"], ["d/x/y"]), ("[]a]", [], ["x"])])
def test_globs(glob, yes, no):
    rule = paths.glob_regex(glob)
    assert all(re.match(rule, x) for x in yes) and not any(re.match(rule, x) for x in no)


def test_malformed_globs():
    assert paths.glob_regex("[a") is None and paths.glob_regex("a\\") is None


def test_display_names():
    assert [paths.display_name(x) for x in ("/m/models--org--name/", "x/y", ".", "/", "", "C:\\m\\z")] == ["org/name", "y", "", "", "", "z"]


def test_digests(spark):
    assert parse_digest("Ab" * 32) == bytes.fromhex("ab" * 32)
    for bad in ("", "ab", "zz" * 32):
        with pytest.raises(ValueError):
            parse_digest(bad)
    rows = spark.createDataFrame([("ab" * 32,), ("ab",), ("ab" * 32 + "\n",)], "t string").select(parse_digest_column(F.col("t"))).collect()
    assert [r[0] is not None for r in rows] == [True, False, False]
