"""Text expressions: tokenizers, chunks, budgets, hashes.  All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscore of any script (Java's \\w is ASCII only).
WORD = r"[\p{L}\p{N}_]+"
CJK_RUN = r"[\x{4e00}-\x{9fff}]+|[a-zA-Z0-9]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of word characters; a run of CJK is one token."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def cjk_ngram_tokens(text: Column) -> Column:
    """Substrings of two to four characters of each CJK run (start, then length), and lower-cased ASCII words."""
    runs = F.regexp_extract_all(text, F.lit(CJK_RUN), 0)

    def pieces(run: Column) -> Column:
        n = F.length(run)
        starts = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
        grams = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(2), F.greatest(F.least(F.lit(4), n - s + 1), F.lit(2))), lambda k: F.substring(run, s, k))))
        return F.when(run.rlike(r"^[\x{4e00}-\x{9fff}]"), F.when(n > 1, grams).otherwise(F.array().cast("array<string>"))).otherwise(F.array(F.lower(run)))

    return F.flatten(F.transform(runs, pieces))


def space_tokens(text: Column) -> Column:
    """Runs without white space, case kept."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), 0)


TOKENIZERS = {"word": word_tokens, "cjk_ngram": cjk_ngram_tokens, "space": space_tokens}


#: The characters that Unicode calls white space.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def cache_key(text: Column) -> Column:
    """MD5 of the stripped, lower-cased text."""
    return F.md5(F.lower(strip(text)).cast("binary"))


def record_key(*columns: str) -> Column:
    """MD5 of the record as JSON with sorted keys."""
    return F.md5(F.to_json(F.struct(*sorted(columns))).cast("binary"))


def truncate(text: Column, most: int, ellipsis: bool = True) -> Column:
    """At most ``most`` characters, the last three dots if cut (and wanted)."""
    cut = F.concat(F.left(text, F.lit(most - 3)), F.lit("...")) if ellipsis else F.left(text, F.lit(most))
    return F.when(F.length(text) > most, cut).otherwise(text)


def chunks(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """Windows of ``size`` characters that start every ``size - overlap``; the last may be part of the one before."""
    step = size - overlap
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda s: F.substring(text, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def slices(text: Column, size: int = 50) -> Column:
    """Consecutive pieces of ``size`` characters: the pseudo stream of a finished answer."""
    return chunks(text, size, 0)


def token_estimate(text: Column) -> Column:
    """1.5 for each CJK character and a quarter for each other one, rounded down."""
    cjk = F.length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]", ""))
    return F.floor(cjk * F.lit(1.5) + (F.length(text) - cjk) / F.lit(4.0)).cast("long")


def token_count(text: Column) -> Column:
    """A quarter of the characters: the fallback where no tokenizer is at hand."""
    return F.floor(F.length(text) / F.lit(4)).cast("long")


def count_of(text: Column, part: str) -> Column:
    """Occurrences of ``part``, not overlapping."""
    # lengths in bytes are at hand, lengths in characters are counted
    gone = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))
    return F.when(~F.contains(text, F.lit(part)), 0).otherwise(F.call_function("div", gone, F.lit(len(part.encode()))).cast("int"))


def total_count(text: Column, parts: list[str]) -> Column:
    """Occurrences of all ``parts`` together."""
    counts = [count_of(text, p) for p in parts]
    return sum(counts[1:], counts[0])


def present(text: Column, parts: list[str]) -> Column:
    """How many of ``parts`` occur at all."""
    return F.size(F.filter(F.array(*map(F.lit, parts)), lambda p: F.contains(text, p)))


def join_present(separator: str, *parts: Column) -> Column:
    """Non-empty parts joined."""
    return F.concat_ws(separator, *[F.when(p != "", p) for p in parts])
