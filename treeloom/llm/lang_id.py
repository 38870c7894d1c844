"""Language ID by unigram pieces, summed over all segmentations.

A text is the sequence of its words (runs of letters, lower case, a mark before each). A language gives a
word the sum, over all ways to cut it into pieces of a fixed public vocabulary, of the product of its
piece probabilities; a forward pass adds these up. Piece probabilities are learned by
expectation-maximisation over the same sum.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.runtime import prepare

#: Least reach of the forward pass (it grows with the longest piece), characters after which sums are rescaled,
#: documents a language to learn from, EM rounds, and words (of 32 characters in the mean) that a worker
#: remembers.
PIECE_CHARS, SCALE_CHARS, LEARN_DOCS, EM_ROUNDS, CACHE_WORDS = 8, 16, 300, 3, 400_000
#: Languages at most that are learned: those with the most labelled rows. With the vocabulary's pieces, which
#: number VOCABULARY at most, this bounds the model, which is broadcast.
LANGUAGES, VOCABULARY = 64, 100_000
#: Added to each piece's expected count, and the probability of a character that is no known piece.
SMOOTH, UNKNOWN = 0.05, 1e-7
MARK = "▁"
_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(2)
def vocabulary(path: str) -> frozenset[str]:
    """The pieces of letters, lower case, of a sentencepiece model, and its single letters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    words = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    found = frozenset(w for w in words if w.replace(MARK, "", 1).isalpha())
    if len(found) > VOCABULARY:
        raise ValueError(f"a vocabulary of {len(found)} pieces")
    return found


def reach(pieces) -> int:
    """Characters that the longest piece has, PIECE_CHARS at least."""
    return max(PIECE_CHARS, max(map(len, pieces), default=0))


def words(text: str | None) -> list[str]:
    """Letter runs of the whole text, lower case."""
    return _WORD.findall((text or "").lower())


def forward(word: str, table: dict[str, tuple[float, ...]], unknown: tuple[float, ...], longest: int | None = None) -> list[float]:
    """Log-probability of a word in each language: the sum over its segmentations into pieces of table.

    longest: reach(table), where the caller has it. Sums of long words are rescaled on the way."""
    w = MARK + word
    longest = longest or reach(table)
    n, many = len(w), range(len(unknown))
    alpha, scale = [[1.0] * len(unknown)], [0.0] * len(unknown)
    for j in range(1, n + 1):
        one = alpha[j - 1]
        now = None
        for i in range(max(0, j - longest), j):
            p = table.get(w[i:j])
            if p is not None:
                a = alpha[i]
                now = [a[k] * p[k] for k in many] if now is None else [now[k] + a[k] * p[k] for k in many]
                if i == j - 1:
                    one = None
        if one is not None:  # a character that is no piece itself
            now = [one[k] * unknown[k] for k in many] if now is None else [now[k] + one[k] * unknown[k] for k in many]
        alpha.append(now)
        if not j % SCALE_CHARS:
            low = max(0, j - longest)
            alpha[low:] = [[x / y for x, y in zip(a, now, strict=True)] for a in alpha[low:]]
            alpha[max(0, low - SCALE_CHARS) : low] = [None] * min(low, SCALE_CHARS)
            scale = [s + math.log(y) for s, y in zip(scale, now, strict=True)]
    return [s + math.log(max(a, 1e-300)) for s, a in zip(scale, alpha[n], strict=True)]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def learn_pieces(counts: dict[str, int], pieces: frozenset[str], rounds: int = EM_ROUNDS) -> dict[str, float]:
    """Piece probabilities of one language from its words' counts, by expectation-maximisation."""
    known, longest = {}, reach(pieces)
    for w in counts:
        w = MARK + w
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + longest) + 1):
                if w[i:j] in pieces:
                    known[w[i:j]] = 1.0
    p = dict.fromkeys(known, 1.0 / max(1, len(known)))
    for _ in range(rounds):
        new = dict.fromkeys(known, SMOOTH)
        for word, c in counts.items():
            w = MARK + word
            n = len(w)
            arcs = [(i, j, x, p.get(x, UNKNOWN)) for j in range(1, n + 1) for i in range(max(0, j - longest), j) if (x := w[i:j]) in p or i == j - 1]
            if n > 2 * SCALE_CHARS:  # plain products would vanish
                alpha, beta = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
                for i, j, _x, q in arcs:
                    alpha[j] = _log_add(alpha[j], alpha[i] + math.log(q))
                for i, j, _x, q in reversed(arcs):
                    beta[i] = _log_add(beta[i], beta[j] + math.log(q))
                for i, j, x, q in arcs:
                    if x in new:
                        new[x] += c * math.exp(alpha[i] + math.log(q) + beta[j] - alpha[n])
                continue
            alpha, beta = [1.0] + [0.0] * n, [0.0] * n + [1.0]
            for i, j, _x, q in arcs:
                alpha[j] += alpha[i] * q
            for i, j, _x, q in reversed(arcs):
                beta[i] += beta[j] * q
            for i, j, x, q in arcs:
                if x in new:
                    new[x] += c * alpha[i] * q * beta[j] / alpha[n]
        total = sum(new.values())
        p = {x: v / total for x, v in new.items()}
    return p


def learn(docs: DataFrame, vocabulary_path: str, *, text: str = "text", lang: str = "lang", per_language: int = LEARN_DOCS, languages: int = LANGUAGES) -> dict[str, dict[str, float]]:
    """language -> piece -> probability, from a bounded sample: for each language the per_language documents
    that come first by the crc32 of their doc_id, with their whole texts; of languages those with the most rows.

    Rows with null text, language or doc_id teach nothing. Rows that repeat doc_id, language and text teach once; those
    that repeat a doc_id with another text or language are documents of their own. Without rows the model is
    empty. Other columns are ignored. What reaches the driver is bounded by the vocabulary and languages.
    """
    prepare(docs.sparkSession)
    labelled = docs.select(docs["doc_id"], docs[lang].alias("lang"), docs[text].alias("text")).dropna()
    most = [r["lang"] for r in labelled.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(languages).collect()]
    labelled = labelled.filter(F.col("lang").isin(most)).withColumn("_h", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy("_key", "doc_id", "_h")
    ids = labelled.select("doc_id", "lang", "_h", F.crc32(F.col("doc_id").cast("string")).alias("_key"))
    ids = ids.withColumn("_n", F.dense_rank().over(order)).filter(F.col("_n") <= per_language).select("doc_id", "lang", "_h").distinct()
    # per_language rows for each of so many languages at most: LEARN_DOCS * LANGUAGES rows of three short columns
    taught = labelled.join(F.broadcast(ids), ["doc_id", "lang", "_h"], "left_semi").dropDuplicates(["doc_id", "lang", "_h"]).select("lang", "text")

    def count(batches):
        for b in batches:
            counts: dict[tuple[str, str], int] = {}
            for k, t in zip(b["lang"], b["text"], strict=True):
                for w in words(t):
                    counts[k, w] = counts.get((k, w), 0) + 1
            yield pd.DataFrame({"lang": pd.Series([k for k, _ in counts], dtype="object"), "word": pd.Series([w for _, w in counts], dtype="object"), "n": pd.Series(list(counts.values()), dtype="int64")})

    def fit(key, pdf):
        pdf = pdf.sort_values("word")
        p = learn_pieces(dict(zip(pdf["word"], pdf["n"].tolist(), strict=True)), vocabulary(vocabulary_path))
        return pd.DataFrame({"lang": key[0], "piece": list(p), "p": list(p.values())})

    model: dict[str, dict[str, float]] = {}
    for r in taught.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).groupBy("lang").applyInPandas(fit, "lang string, piece string, p double").collect():
        model.setdefault(r["lang"], {})[r["piece"]] = r["p"]
    return model


class Scorer(dict):
    """word -> row of scores; a bounded cache of forward passes."""

    def __init__(self, model: dict[str, dict[str, float]]):
        super().__init__()
        self.langs = sorted(model)
        pieces = {x for p in model.values() for x in p}
        self.longest, self.chars = reach(pieces), 0
        self.unknown = tuple(UNKNOWN for _ in self.langs)
        least = [min(model[k].values(), default=UNKNOWN) for k in self.langs]
        self.table = {x: tuple(model[k].get(x, q) for k, q in zip(self.langs, least, strict=True)) for x in pieces}
        self.rows = np.empty((CACHE_WORDS + 1, len(self.langs)))

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        if k >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[k] = forward(word, self.table, self.unknown, self.longest)
        self.chars += len(word)
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        w = words(text)
        if not w or not self.langs:
            return "und", 0.0
        if len(self) > CACHE_WORDS or self.chars > 32 * CACHE_WORDS:
            self.clear()
            self.chars = 0
            self.rows = self.rows[: CACHE_WORDS + 1]
        ids = np.fromiter(map(self.__getitem__, w), np.int64, len(w))
        s = sum((self.rows[ids[i : i + 65536]].sum(0) for i in range(0, len(ids), 65536)), np.zeros(len(self.langs)))
        best = int(s.argmax())
        return self.langs[best], float(1 / np.exp(np.minimum(s - s[best], 0)).sum())


_scorers: dict[str, Scorer] = {}


def identify(docs: DataFrame, model: dict[str, dict[str, float]], *, text: str = "text") -> DataFrame:
    """docs with lang_pred and score beside its columns (columns of these names are replaced).

    score is the language's posterior with equal priors. Null text, or one without a letter, gives ``und``
    and 0, and so does a model of no language. Whole texts are scored; ties go to the first language by name.
    Repeated rows and null doc_ids are rows like others; an empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    mark = f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}"

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if mark not in _scorers:
            _scorers.clear()
            _scorers[mark] = Scorer(shared.value)
        return pd.DataFrame([_scorers[mark].predict(t) for t in texts], columns=["lang_pred", "score"])

    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(F.struct(*[docs[c] for c in own]).alias("r"), predict(docs[text]).alias("p"))
    return out.select(*[F.col("r")[c].alias(c) for c in own], F.col("p.lang_pred").alias("lang_pred"), F.col("p.score").alias("score"))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
