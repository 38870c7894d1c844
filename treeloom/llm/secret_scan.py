"""Secret scan: three fixed patterns, and a randomness test battery. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.runtime import cut

#: Fixed values of the base scan.
ASSIGN = r"""(?:(?i)(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Runs that may be encoded random bytes.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
#: Match lists are added up in blocks of so many.
BLOCK = 256
#: The battery rejects randomness beyond so many standard deviations in any test.
BATTERY_Z = 3.0
#: Sum of squared symbol frequencies of ordinary identifiers, for small alphabets and for others.
COINCIDENCE_SMALL, COINCIDENCE = 0.11, 0.066
#: Share of false discoveries, least lengths of the classes in which it is controlled, bins a unit of z.
FDR, LENGTHS, BINS, Z_LOW, Z_HIGH = 0.05, (20, 24, 32, 48, 96), 32, -12, 4

HEX16 = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"
BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
BASE64 = BASE62 + "+/"


def _located(df: DataFrame, found: dict[str, str]) -> DataFrame:
    """Adds for each name an array of (s, e, m) of its pattern's matches in column t, in code points.

    The text between matches gives the distances. They are added up in blocks, so the work stays near
    linear in a text with very many matches.
    """
    keep = [c for c in df.columns if c != "t"]
    df = df.select("*", *[F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(f"{k}_m") for k, p in found.items()])
    df = df.select(*keep, *[f"{k}_m" for k in found], *[F.when(F.size(f"{k}_m") > 0, F.split("t", p, -1)).alias(f"{k}_g") for k, p in found.items()])
    steps = "zip_with({k}_m, slice({k}_g, 1, size({k}_m)), (a, b) -> named_struct('g', cast(length(b) AS bigint), 'l', cast(length(a) AS bigint), 'm', a))"
    blocks = f"transform(sequence(0, (size({{k}}_s) - 1) DIV {BLOCK}), b -> slice({{k}}_s, b * {BLOCK} + 1, {BLOCK}))"
    bases = "aggregate(transform({k}_b, k -> aggregate(k, 0L, (s, x) -> s + x.g + x.l)), array(0L), (acc, s) -> concat(acc, array(element_at(acc, -1) + s)))"
    spans = """flatten(zip_with({k}_b, slice({k}_a, 1, size({k}_b)), (k, base) -> aggregate(k,
        named_struct('p', base, 'o', cast(array() AS array<struct<s: bigint, e: bigint, m: string>>)),
        (acc, x) -> named_struct('p', acc.p + x.g + x.l, 'o', concat(acc.o, array(named_struct('s', acc.p + x.g, 'e', acc.p + x.g + x.l, 'm', x.m)))),
        acc -> acc.o)))"""
    for made, out, gone in ((steps, "s", ("m", "g")), (blocks, "b", ("s",)), (bases, "a", ()), (spans, "", ("a", "b"))):
        rest = [c for c in df.columns if not any(c == f"{k}_{g}" for k in found for g in gone)]
        source = {"s": "m", "b": "s", "a": "b", "": "b"}[out]
        df = df.select(*rest, *[F.when(F.size(f"{k}_{source}") > 0, F.expr(made.format(k=k))).alias(f"{k}_{out}" if out else k) for k in found])
    return df.select(*keep, *[F.coalesce(F.col(k), F.expr("cast(array() AS array<struct<s: bigint, e: bigint, m: string>>)")).alias(k) for k in found])


def _battery(df: DataFrame, name: str) -> DataFrame:
    """Replaces the candidates by (s, e, c, b, ok): length class, bin of the ordinary text's z, and whether
    the battery finds no departure from randomness. Every run is tested: one without a digit, or without a
    letter, departs from its alphabet's share of digits if it is long enough to tell."""
    quoted = {k: f"'{v}'" for k, v in {"hex": HEX16, "b32": BASE32, "b36": BASE36, "b62": BASE62, "b64": BASE64}.items()}
    halves = {k: "0" * (len(v) // 2) + "1" * (len(v) - len(v) // 2) for k, v in (("hex", HEX16), ("b32", BASE32), ("b36", BASE36), ("b62", BASE62), ("b64", BASE64))}
    enc = "CASE WHEN c.x rlike '^([0-9a-f]+|[0-9A-F]+)$' THEN 'hex' WHEN c.x rlike '^[A-Z2-7]+$' THEN 'b32' WHEN c.x rlike '^([0-9a-z]+|[0-9A-Z]+)$' THEN 'b36' WHEN c.x rlike '^[0-9A-Za-z]+$' THEN 'b62' ELSE 'b64' END"
    pick = lambda d: "CASE c.t " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in d.items()) + " END"
    digits = {k: f"{sum(x.isdigit() for x in v) / len(v)!r}D" for k, v in (("hex", HEX16), ("b32", BASE32), ("b36", BASE36), ("b62", BASE62), ("b64", BASE64))}
    stage = [
        f"transform({name}, c -> named_struct('s', c.s, 'e', c.e, 'x', regexp_replace(c.m, '=+$', '')))",
        f"transform({name}, c -> named_struct('s', c.s, 'e', c.e, 'x', c.x, 't', {enc}))",
        f"transform({name}, c -> named_struct('s', c.s, 'e', c.e, 'x', CASE WHEN c.t IN ('hex', 'b36') THEN lower(c.x) WHEN c.t = 'b64' THEN translate(c.x, '-_', '+/') ELSE c.x END, 't', c.t, 'alpha', {pick(quoted)}, 'half', {pick({k: f"'{v}'" for k, v in halves.items()})}))",
        f"""transform({name}, c -> named_struct('s', c.s, 'e', c.e, 'n', cast(length(c.x) AS double), 'k', cast(length(c.alpha) AS double),
            'pd', {pick(digits)}, 'nd', cast(length(c.x) - length(translate(c.x, '0123456789', '')) AS double),
            'q', aggregate(array_distinct(filter(split(c.x, ''), h -> h <> '')), 0D, (a, h) -> a + pow(length(c.x) - length(replace(c.x, h, '')), 2)),
            'v', transform(filter(split(c.x, ''), h -> h <> ''), h -> cast(instr(c.alpha, h) - 1 AS double)), 'bits', translate(c.x, c.alpha, c.half)))""",
        f"""transform({name}, c -> named_struct('s', c.s, 'e', c.e, 'n', c.n, 'k', c.k, 'chi', c.k / c.n * c.q - c.n, 'zd', (c.nd - c.n * c.pd) / sqrt(c.n * c.pd * (1 - c.pd)),
            'n1', cast(length(replace(c.bits, '0', '')) AS double), 'runs', cast(length(regexp_replace(c.bits, '0+|1+', 'x')) AS double),
            'ser', aggregate(zip_with(slice(c.v, 1, size(c.v) - 1), slice(c.v, 2, size(c.v) - 1), (a, b) -> (a - (c.k - 1) / 2) * (b - (c.k - 1) / 2)), 0D, (a, x) -> a + x)))""",
        f"""transform({name}, c -> named_struct('s', c.s, 'e', c.e, 'n', c.n, 'chi', c.chi, 'zd', c.zd, 'df', c.k - 1,
            'lam', c.n * (c.k * IF(c.k < 32, {COINCIDENCE_SMALL}D, {COINCIDENCE}D) - 1),
            'mu', 2 * c.n1 * (c.n - c.n1) / c.n + 1, 'runs', c.runs, 'zs', c.ser / sqrt(c.n - 1) / ((c.k * c.k - 1) / 12)))""",
        f"""transform({name}, c -> named_struct('s', c.s, 'e', c.e, 'n', c.n, 'zd', c.zd,
            'zc', (cbrt(c.chi / c.df) - (1 - 2 / (9 * c.df))) / sqrt(2 / (9 * c.df)),
            'zr', (c.runs - c.mu) / sqrt(greatest((c.mu - 1) * (c.mu - 2) / (c.n - 1), 0.25D)), 'zs', c.zs,
            'zo', (c.chi - c.df - c.lam) / sqrt(2 * (c.df + 2 * c.lam))))""",
        f"""transform({name}, c -> named_struct('s', c.s, 'e', c.e, 'c', {' + '.join(f'IF(c.n >= {n}, 1, 0)' for n in LENGTHS)},
            'b', cast(ceil(greatest(least(c.zo, {Z_HIGH}D), {Z_LOW}D) * {BINS}) AS int), 'ok', greatest(c.zc, abs(c.zd), abs(c.zr), abs(c.zs)) <= {BATTERY_Z}D))""",
    ]
    for s in stage:
        df = df.select(*[c for c in df.columns if c != name], F.expr(s).alias(name))
    return df


def thresholds(histogram: list[tuple[int, int, int]], fdr: float = FDR) -> dict[int, int]:
    """Benjamini-Hochberg in each length class over binned p-values (rounded up): class -> last bin taken."""
    out = {}
    for c in {h[0] for h in histogram}:
        bins = sorted((b, n) for k, b, n in histogram if k == c)
        m, below = sum(n for _, n in bins), 0
        for b, n in bins:
            below += n
            if b < Z_HIGH * BINS and 0.5 * math.erfc(-b / BINS / math.sqrt(2)) <= fdr * below / m:
                out[c] = b
    return out


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def scan_secrets(docs: DataFrame, *, text: str = "text", fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for each row of docs.

    Base spans come from the patterns. A random span is a run of 20 or more encoding symbols which, in the
    alphabet inferred for it, pass a chi-squared uniformity test, one of the share of digits, a runs test and a
    serial-correlation test, and whose uniformity is a discovery against ordinary text: the chi-squared
    statistic of ordinary text grows with the length, so short runs need more; discoveries are controlled
    in each length class over all rows. The class histograms have a fixed size and alone reach the driver.

    Null text is empty; an empty table gives an empty result; repeated rows are scanned each and count
    each in the discovery control; other columns are ignored. Nothing is shuffled but the histograms.
    """
    d = _located(docs.select("doc_id", F.coalesce(docs[text], F.lit("")).alias("t")), {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": CANDIDATE})
    d = d.withColumn("assign", F.filter("assign", lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6))
    d = cut(_battery(d, "random").select("doc_id", *[F.transform(k, lambda x: F.struct(x["s"], x["e"])).alias(k) for k in KINDS[:3]], "random"), "secrets")
    found = d.select(F.explode("random").alias("r")).groupBy("r.c", "r.b").count().collect()  # a bounded grid
    last = thresholds([tuple(r) for r in found], fdr)
    taken = F.filter("random", lambda x: x["ok"] & (x["b"] <= F.coalesce(*[F.when(x["c"] == c, F.lit(b)) for c, b in last.items()], F.lit(Z_LOW * BINS - 1))))
    d = d.withColumn("random", taken)
    parts = [F.expr(f"transform({k}, x -> named_struct('s', x.s, 'i', {i}, 'e', x.e, 'kind', '{k}'))") for i, k in enumerate(KINDS)]
    return d.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(F.concat(*parts[:3])).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat(*parts)).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
