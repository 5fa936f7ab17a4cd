"""Language identification by rank-order profiles.

A profile is the ``size`` most frequent letter n-grams (one to three characters, with
``_`` at both ends of a word) in rank order; ties go by the n-gram.  A document's
profile is compared with each language's by the out-of-place distance: for each of
its n-grams the difference of the two ranks, or ``size`` if the language lacks it.
The nearest language is predicted (ties: the first by name); the score is the share of
the worst possible distance that the document stays below.

Profiles are counted over all learned documents: each task counts words by language
and sends n-gram sums, which are added up by n-gram.  What reaches the driver is
``size`` rows for each language.

A text that is null or has no letter is ``und`` with score 0; without any learned
language every text is.  Documents whose lang is null are not learned from, only
predicted.  Very long texts are counted whole, in pieces between words.  Repeated rows get
the same prediction each, and an empty table gives an empty result.  Extra columns pass
through; where one has the name of a result column, the result's stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from credalyt.llm.scratch import Plain

SIZE = 300
#: characters counted at a time, and different n-grams that a task holds before it sends sums
PIECE, FLUSH = 1 << 19, 1 << 20
MARK = ord("_")


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo three, is one: never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of a text and their counts.

    An n-gram is a number: 21 bits for each character, from the left, so numbers sort as
    the strings do.  Words stand between single marks; none of the n-grams has a mark inside.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = np.concatenate([[False], _letters()[points], [False]])
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    x = np.concatenate([[MARK], points, [MARK]])
    x[~letter] = MARK
    x = x[keep]
    inner = x != MARK
    two = x[:-1] << 42 | x[1:] << 21
    three = (two[:-1] | x[2:])[inner[1:-1]]
    return np.unique(np.concatenate([x[inner] << 42, two[: len(two) if len(x) > 2 else 0], three]), return_counts=True)


def gram_text(code: int) -> str:
    return "".join(chr(c) for c in (code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF) if c)


def _cut(text: str) -> Iterator[str]:
    """A text in pieces of about PIECE characters; no word is cut."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end > at and text[end - 1].isalpha():
            end -= 1
        if end == at:  # one word is longer than a piece
            end = at + PIECE
            while end < len(text) and text[end].isalpha():
                end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def _pieces(texts: Iterator[str]) -> Iterator[str]:
    """Texts, cut or joined by spaces to pieces of about PIECE characters."""
    held, size = [], 0
    for t in texts:
        for piece in _cut(t):
            held.append(piece)
            size += len(piece)
            if size > PIECE:
                yield " ".join(held)
                held, size = [], 0
    if held:
        yield " ".join(held)


def counted(texts: Iterator[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """N-grams of all texts and their counts, summed; sums go out early where they are many."""
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for piece in _pieces(texts):
        c, n = grams(piece)
        codes, at = np.unique(np.concatenate([codes, c]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(codes)).astype(np.int64)
        if len(codes) > FLUSH:
            yield codes, counts
            codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    yield codes, counts


def _sums(text: str, lang: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_lang: dict[str, list[str]] = {}
            for t, name in zip(batch.column(batch.schema.get_field_index(text)).to_pylist(), batch.column(batch.schema.get_field_index(lang)).to_pylist()):
                of_lang.setdefault(name, []).append(t)
            for name, texts in of_lang.items():
                for codes, counts in counted(iter(texts)):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"])

    return run


def profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SIZE) -> dict[str, list[int]]:
    """The n-grams of each language in rank order (``gram_text`` makes strings of them)."""
    plain = Plain(df)
    text, lang = plain[text_col], plain[lang_col]
    sums = plain.df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, F.col(lang).cast("string").alias(lang)).mapInArrow(_sums(text, lang), "lang string, gram long, n long")
    by_rank = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = sums.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r.lang, r["rank"])):
        out.setdefault(r.lang, []).append(r.gram)
    return out


class Ranker:
    """Out-of-place distances to every profile at once."""

    def __init__(self, known: dict[str, list[int]], size: int = SIZE):
        self.size, self.names = size, sorted(known)
        self.codes = np.unique(np.array([g for p in known.values() for g in p], np.int64))
        self.rank = np.full((len(self.codes) + 1, len(self.names)), -1, np.int32)
        for k, name in enumerate(self.names):
            self.rank[np.searchsorted(self.codes, known[name]), k] = np.arange(len(known[name]))

    def of(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text or "") if len(text or "") <= PIECE else self._long(text or "")
        if not len(codes) or not self.names:
            return "und", 0.0
        codes = codes[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.searchsorted(self.codes, codes)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != codes] = len(self.codes)
        ranks, place = self.rank[at], np.arange(len(codes))[:, None]
        distance = np.where(ranks < 0, self.size, np.abs(ranks - place)).sum(axis=0)
        best = int(np.argmin(distance))
        return self.names[best], 1 - float(distance[best]) / (self.size * len(codes))


    def _long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of a long text, piece by piece: memory follows its different n-grams."""
        sums = list(counted(iter([text])))
        codes, at = np.unique(np.concatenate([c for c, _ in sums]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([n for _, n in sums]), len(codes)).astype(np.int64)


def predicted(df: DataFrame, known: dict[str, list[int]], text_col: str = "text", keep: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """``df`` (or its columns ``keep``) with lang_pred and score."""
    keep = df.columns if keep is None else keep
    plain = Plain(df)
    text, held = plain[text_col], [plain[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(known, size)
        for batch in batches:
            found = [ranker.of(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
            names, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in held), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*held, "lang_pred", "score"])

    schema = T.StructType([*(plain.df.schema[c] for c in held), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return plain.back(plain.df.select(*dict.fromkeys([*held, text])).mapInArrow(run, schema), keep, ["lang_pred", "score"])
