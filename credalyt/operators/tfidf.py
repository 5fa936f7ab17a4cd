"""TF-IDF with a vocabulary of the most frequent terms, found by mergeable summaries.

Pass one: each task keeps a Misra-Gries summary of its terms, at most ``2 * counters`` at a time;
what it takes off the counters when it makes room is its error.  Summaries add up: a term's total
lies between the sum of its counters and that plus the sum of all errors.  The terms of largest
counters are candidates.

Pass two counts the candidates, and only these, exactly: one row a document with candidate numbers
and frequencies, written as a table.  If a term that is no candidate could still have as large a
total as the last one chosen, the passes run again with more candidates and counters; so the
vocabulary is exact.  Pairs of words that occur once or twice are never shuffled.

Both passes work on pieces of at most ``PIECE_TOKENS`` tokens (or one document).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credalyt.functions.text import TOKENIZERS
from credalyt.operators.pieces import pieces
from credalyt.sources.folders import saved, work_folder

COUNTERS = 200_000


def grams(tokens: pa.ListArray, ngrams: tuple[int, int], least: int = 2) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """(document, number of the term) of each occurrence, and the terms; words shorter than ``least`` are skipped."""
    words = pc.list_flatten(tokens).dictionary_encode()
    doc = np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())
    known = words.dictionary.cast(pa.string())
    code = words.indices.to_numpy().astype(np.int64)
    kept = (pc.utf8_length(known).to_numpy() >= least)[code] if len(code) else np.empty(0, bool)
    doc, code = doc[kept], code[kept]
    docs, codes, terms, first = [], [], [], 0
    run, run_terms, run_doc = code, known, doc  # the runs of n words that start at each place
    for n in range(1, ngrams[1] + 1):
        if n > 1:
            tail = code[n - 1 :]
            whole = run_doc[: len(tail)] == doc[n - 1 :]
            pairs, numbers = np.unique(run[: len(tail)] * max(len(known), 1) + tail, return_inverse=True)
            run_terms = pc.binary_join_element_wise(run_terms.take(pa.array(pairs // max(len(known), 1))), known.take(pa.array(pairs % max(len(known), 1))), " ")
            run, run_doc = numbers, np.where(whole, run_doc[: len(tail)], -1)
        if n >= ngrams[0]:
            there = run_doc >= 0
            docs.append(run_doc[there])
            codes.append(run[there] + first)
            terms.append(run_terms)
            first += len(run_terms)
    return np.concatenate(docs), np.concatenate(codes), terms


def _summaries(ngrams: tuple[int, int], counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, error = pa.table({"term": pa.array([], pa.string()), "n": pa.array([], pa.int64())}), 0
        for b in pieces(batches):
            _, code, terms = grams(b.column(0), ngrams)
            names = pa.concat_arrays(terms)
            n = np.bincount(code, minlength=len(names))
            held = pa.concat_tables([held, pa.table({"term": names, "n": pa.array(n)})]).group_by("term").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["term", "n"])
            if held.num_rows > 2 * counters:
                n = held["n"].to_numpy()
                off = int(np.partition(n, len(n) - counters - 1)[len(n) - counters - 1])
                error += off
                held = held.filter(pa.array(n > off))
                held = held.set_column(1, "n", pc.subtract(held["n"], off))
        yield from held.filter(pc.greater(held["n"], 0)).combine_chunks().to_batches(max_chunksize=50_000)
        yield pa.RecordBatch.from_pydict({"term": pa.array([None], pa.string()), "n": pa.array([error], pa.int64())})

    return run


def _counted(ngrams: tuple[int, int], candidates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(candidates.value, pa.string())
        for b in pieces(batches):
            doc, code, terms = grams(b.column(1), ngrams)
            place = pc.fill_null(pc.index_in(pa.concat_arrays(terms), wanted), -1).to_numpy().astype(np.int64)[code]
            doc, place = doc[place >= 0], place[place >= 0]
            keys, tf = np.unique(doc * len(wanted) + place, return_counts=True)
            ends = np.r_[0, np.cumsum(np.bincount(keys // len(wanted), minlength=b.num_rows))]
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (keys % len(wanted), tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["doc_id", "terms", "tfs"])

    return run


def frequencies(docs: DataFrame, id_col: str, text_col: str, max_features: int, max_df: float, ngrams: tuple[int, int], counters: int = COUNTERS, candidates: int | None = None) -> tuple[DataFrame, list[tuple[str, float, int]]]:
    """(doc_id, terms, tfs) of the candidates as a table, and of each chosen term its text, idf and number there."""
    spark = docs.sparkSession
    tokens = docs.select(F.col(id_col).alias("doc_id"), TOKENIZERS["word"](F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    n_docs, most = docs.count(), candidates or max_features + 1000
    work = work_folder(spark, "tfidf")
    turn = 0
    while True:
        sums = tokens.select("tokens").mapInArrow(_summaries(ngrams, counters), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        sums = saved(sums, f"{work}/{turn}-sums")
        error = (sums.where("term is null").first() or {"n": 0})["n"]
        best = sums.where("term is not null").orderBy(F.desc("n"), "term").limit(most + 1).collect()  # so many terms
        names = [r.term for r in best[:most]]
        rest = (best[most]["n"] if len(best) > most else 0) + error  # no other term has more
        shared = spark.sparkContext.broadcast(names or [""])
        counted = saved(tokens.mapInArrow(_counted(ngrams, shared), f"doc_id {docs.schema[id_col].dataType.simpleString()}, terms array<int>, tfs array<int>"), f"{work}/{turn}-counted")
        exact = counted.select(F.inline(F.arrays_zip("terms", "tfs"))).groupBy("terms").agg(F.count("*").alias("df"), F.sum("tfs").alias("total")).collect()  # a row for each candidate
        chosen = sorted(((-r.total, names[r.terms], r.df, r.terms) for r in exact if r.df <= n_docs * max_df))[:max_features]
        if (len(chosen) == max_features and rest < -chosen[-1][0]) or (len(best) <= most and not error):
            return counted, [(t, float(np.log((1 + n_docs) / (1 + df)) + 1), i) for _, t, df, i in chosen]
        turn, most, counters = turn + 1, 4 * most, 2 * counters if error else counters


def tfidf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_features: int = 1000, max_df: float = 0.95, ngrams: tuple[int, int] = (1, 2), counters: int = COUNTERS, candidates: int | None = None) -> DataFrame:
    """(doc_id, term, weight): smooth idf ln((1 + n) / (1 + df)) + 1, rows of length one.

    Terms are words and pairs of words in at most ``max_df`` of the documents; the most
    frequent ``max_features`` stay (ties by term)."""
    counted, chosen = frequencies(docs, id_col, text_col, max_features, max_df, ngrams, counters, candidates)
    if not chosen:
        return counted.select("doc_id", F.lit("").alias("term"), F.lit(0.0).alias("weight")).where("false")
    known = docs.sparkSession.createDataFrame([(i, t, w) for t, w, i in chosen], "number int, term string, idf double")
    idfs = F.map_from_entries(F.array(*[F.struct(F.lit(i), F.lit(w)) for _, w, i in chosen]))
    kept = F.filter(F.arrays_zip("terms", "tfs"), lambda x: F.element_at(F.col("idfs"), x["terms"]).isNotNull())
    rows = counted.withColumn("idfs", idfs).select("doc_id", F.transform(kept, lambda x: F.struct(x["terms"].alias("number"), (x["tfs"] * F.element_at(F.col("idfs"), x["terms"])).alias("w"))).alias("ws"))
    rows = rows.withColumn("length", F.sqrt(F.aggregate("ws", F.lit(0.0), lambda s, x: s + x["w"] * x["w"])))
    each = rows.select("doc_id", "length", F.inline("ws"))
    return each.join(F.broadcast(known.select("number", "term")), "number").select("doc_id", "term", (F.col("w") / F.col("length")).alias("weight"))
