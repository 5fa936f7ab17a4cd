"""Model calls behind injectable clients, with deterministic offline stand-ins.

A client is any picklable callable over a list of texts; it runs once for each Arrow batch.
Tasks may be retried, so calls are made at least once: results are keyed by the text's MD5.
Errors become fields of the result, never empty successes.
"""

from __future__ import annotations

import hashlib
import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credalyt.functions.text import cache_key

Embedder = Callable[[list[str]], list[list[float]]]
Generator = Callable[[list[str]], list[str]]
ANSWER = T.StructType([T.StructField("text", T.StringType()), T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType()), T.StructField("error", T.StringType())])


#: Characters of texts that the stand-in counts at a time; a longer text is counted on its own
PIECE_CHARACTERS = 1 << 19


@lru_cache(maxsize=1 << 18)
def _part_hash(code: int, n: int) -> int:
    """The hash of a part of n characters, 21 bits each."""
    part = "".join(chr(code >> 21 * (n - 1 - k) & 0x1FFFFF) for k in range(n))
    return int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")


class HashingEmbedder:
    """A stand-in: signed hashes of character pairs and triples, unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out, piece, held = [], [], 0
        for t in texts:
            t = (t or "").lower()
            if piece and held + len(t) > PIECE_CHARACTERS:
                out += self._counted(piece)
                piece, held = [], 0
            piece.append(t)
            held += len(t)
        return out + self._counted(piece)

    def _counted(self, texts: list[str]) -> list[list[float]]:
        """Each distinct part of the texts is hashed once; sums of whole numbers are exact in any order."""
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        total = np.zeros(len(texts) * self.dim)
        for n in (2, 3):
            m = max(len(chars) - n + 1, 0)
            within = text[:m] == text[n - 1 : n - 1 + m]
            codes = sum(chars[k : k + m] << 21 * (n - 1 - k) for k in range(n))[within]
            parts = pa.array(codes).dictionary_encode()
            h = np.array([_part_hash(c, n) for c in parts.dictionary.to_pylist()], np.uint64)
            at, sign = (h % np.uint64(self.dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)
            place = parts.indices.to_numpy()
            total += np.bincount(text[:m][within] * self.dim + at[place], sign[place], len(total))
        out = []
        for v in total.reshape(len(texts), self.dim):
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).tolist())
        return out


class EchoGenerator:
    """A stand-in: an answer in the expected form whose level follows from the prompt's MD5."""

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            n = int(hashlib.md5((p or "").encode()).hexdigest()[:8], 16) % 101
            level, advice = ("低风险", "批准") if n <= 30 else ("中风险", "人工复核") if n <= 70 else ("高风险", "拒绝")
            out.append(f"风险等级：{level}\n风险评分：{n}分\n风险因素：\n1. 收入：收入不稳定\n有利因素：\n1. 储蓄：有储蓄\n审批建议：{advice}\n知识来源：[1] 风险案例")
        return out


def with_retries(client: Callable, tries: int = 3, delay: float = 1.0, factor: float = 2.0, most: float = 30.0) -> Callable:
    """The client, called again after an error, each time later; the last error is raised."""

    def call(texts: list[str]):
        wait = delay
        for i in range(tries):
            try:
                return client(texts)
            except Exception:
                if i == tries - 1:
                    raise
                time.sleep(min(wait, most))
                wait *= factor

    return call


def embed(text: Column, client: Embedder) -> Column:
    """array<float> of each text; where a call fails its texts are asked one by one, and one that fails gives null."""

    def one(t: str):
        try:
            return client([t])[0]
        except Exception:
            return None


    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.fillna("").tolist()
            try:
                found = list(client(texts))
            except Exception:
                found = [one(t) for t in texts]
            yield pd.Series(found, dtype=object)

    return run(text)


def generate(prompt: Column, client: Generator) -> Column:
    """struct<text, input_tokens, output_tokens, error> of each prompt."""

    @F.pandas_udf(ANSWER)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            texts = s.fillna("").tolist()
            try:
                answers, error = client(texts), None
            except Exception as e:
                answers, error = [None] * len(texts), str(e)
            yield pd.DataFrame({"text": answers, "input_tokens": [len(t) // 4 for t in texts], "output_tokens": [len(a or "") // 4 for a in answers], "error": [error] * len(texts)})

    return run(prompt)


TRIED = "text string, attempts int, error string"


def generate_with_attempts(prompt: Column, client: Generator, tries: int = 3, delay: float = 1.0, factor: float = 2.0, most: float = 30.0) -> Column:
    """struct<text, attempts, error>: each prompt on its own, called again after an error, each time later."""

    def one(text: str) -> tuple[str | None, int, str | None]:
        wait = delay
        for attempt in range(1, tries + 1):
            try:
                return client([text])[0], attempt, None
            except Exception as e:
                error = str(e)
            if attempt < tries:
                time.sleep(min(wait, most))
                wait *= factor
        return None, tries, error

    @F.pandas_udf(TRIED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([one(t) for t in s.fillna("")], columns=["text", "attempts", "error"])

    return run(prompt)


class FlakyGenerator:
    """A stand-in that fails for a prompt as often as its MD5 says (0 to 4 times), then answers."""

    def __init__(self) -> None:
        self.calls: Counter = Counter()

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            fails = int(hashlib.md5(p.encode()).hexdigest()[:8], 16) % 5
            self.calls[p] += 1
            if self.calls[p] <= fails:
                raise RuntimeError(f"busy {self.calls[p]}")
            del self.calls[p]
            out.append(f"{len(p)}")
        return out


def embed_with_cache(docs: DataFrame, cache: DataFrame, client: Embedder, text: str = "text", most: int = 8000) -> DataFrame:
    """``docs`` with embedding: from the cache (cache_key, embedding) or the client, one call for each distinct text."""
    cut = F.left(F.coalesce(F.col(text), F.lit("")), F.lit(most))
    keyed = docs.withColumns({"_cut": cut, "cache_key": cache_key(cut)})
    missing = keyed.select("cache_key", "_cut").dropDuplicates(["cache_key"]).join(cache.select("cache_key"), "cache_key", "left_anti")
    fresh = missing.select("cache_key", embed(F.col("_cut"), client).alias("embedding"))
    return keyed.join(cache.select("cache_key", "embedding").unionByName(fresh), "cache_key", "left").drop("_cut")


def rerank(query: Column, content: Column, scorer: Callable[[list[tuple[str, str]]], list[float]], sigmoid: bool = False) -> Column:
    """Cross-encoder scores of pairs."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(scorer(list(zip(a.fillna(""), b.fillna("")))), dtype=float)

    s = run(query, content)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-s)) if sigmoid else s


def mock_prediction(id_col: str, seed: int = 42) -> Column:
    """struct<score, label>: a reproducible noisy score in [0, 1]."""
    from credalyt.operators.prep import uniform

    u, v = uniform(seed, id_col), uniform(seed + 1, id_col)
    gauss = F.sqrt(F.lit(-2.0) * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(F.lit(6.283185307179586) * v)
    score = F.least(F.greatest(F.lit(0.3) + F.lit(0.4) * u + F.lit(0.1) * gauss, F.lit(0.0)), F.lit(1.0))
    return F.struct(score.alias("score"), (score > 0.5).cast("int").alias("label"))
