"""Links between texts whose sets of word shingles are alike: a lossless candidate index and exact checks.

*Sets.*  A shingle is ``shingle`` consecutive words, hashed to 64 bits; a text of fewer words
is one shingle, a text without words the empty set.

*Prefixes.*  In one order of all shingles (by counts over all texts, rare ones first) sets of size n at a Jaccard
similarity of s share one of their first n - ceil(s n) + 1 members, so only these are indexed;
the place in it bounds what two sets can still share, and sizes must allow the similarity.

*Wide fingerprints.*  A set has a bit string of about 2 to 4 bits for each member, each bit the
parity of the members that fall on it.  Two sets that differ in d members differ in at most d
bits, so pairs beyond the bits that the similarity allows go unseen by their texts, and no pair
within it does.

*Long lists.*  The members of short lists meet pair by pair.  Longer ones carry the wide
fingerprints and emit a forest of their likely pairs only, best ones first; it is checked, and
the pairs that the filters leave between different groups are emitted after that.  A list of
more than ``BLOCK`` members is dealt into blocks, and each pair of blocks is a task.

Every link is one of two compared sets; no list, candidate or partner is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credalyt.llm.textkernel import CHUNK_BYTES, LOWER, chunks, mixed, utf8

SEED = 42
#: words that a worker remembers the hash of, and the longest such word
MEMO, MEMO_BYTES = 1 << 16, 64
#: shingles are ordered by how many there are in their bucket, over all texts
BUCKET_BITS = 18
#: lists up to this length emit their pairs; members of a block of longer ones
SHORT, BLOCK = 4, 4096
#: products of a similarity and a whole number are rounded
SLACK = 1e-9
#: words of wide fingerprints, and as many again for each pair, that are compared at a time
AT_ONCE, A_PAIR = 1 << 20, 8


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, SEED)
        if len(self) < MEMO and len(word) <= MEMO_BYTES:
            self[word] = h
        return h


_hash_of = _Memo().__getitem__


def shingle_sets(raw: np.ndarray, offs: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes of each text of a chunk, sorted, and the texts' offsets in them."""
    low = LOWER[raw].tobytes()
    texts = [low[a:b].split() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]  # splits at \x20\x09-\x0D
    n_words = np.fromiter(map(len, texts), np.int64, len(texts))
    w = np.fromiter(map(_hash_of, chain.from_iterable(texts)), np.uint64, int(n_words.sum()))
    first = np.concatenate([[0], np.cumsum(n_words)])
    step = lambda h, x: mixed(h * np.uint64(0xD6E8FEB86659FD93) + x)
    full = np.full(max(0, len(w) - shingle + 1), shingle, np.uint64)
    for j in range(shingle):  # also across texts; these places are not read
        full = step(full, w[j : j + len(full)])
    parts = []
    for a, n in zip(first.tolist(), n_words.tolist()):
        if n >= shingle:
            own = np.sort(full[a : a + n - shingle + 1])
            new = np.ones(len(own), bool)
            new[1:] = own[1:] != own[:-1]
            parts.append(own[new])
        else:
            own = np.full(min(n, 1), n, np.uint64)
            for j in range(n):
                own = step(own, w[a + j : a + j + 1])
            parts.append(own)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)).view(np.int64), ends


def shingle_order(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """Places of the 2**``BUCKET_BITS`` buckets of shingles, those with fewest members first.

    Every text is counted, once for each of its shingles; a bucket's count is at least that of any
    shingle in it, so one that many texts share comes late.  Places order the shingles and decide nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for _, raw, offs in chunks(batches, text):
            total += np.bincount(bucket(shingle_sets(raw, offs, shingle)[0]), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    rows = docs.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row for each bucket
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    total[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    place = np.empty(len(total), np.int32)
    place[np.argsort(total, kind="stable")] = np.arange(len(total), dtype=np.int32)
    return place


def bucket(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def prefixes(h: np.ndarray, offs: np.ndarray, place: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each set (sorted) its first members in the order of all shingles, as many as sets need
    for that similarity to share one, and the sets' offsets in them."""
    rank = place[bucket(h)]  # sets are sorted, so a stable sort breaks ties by the hash
    n = np.diff(offs)
    size = np.minimum(n, n - np.ceil(similarity * n - SLACK).astype(np.int64) + 1)
    parts = [h[a:b][np.argsort(rank[a:b], kind="stable")[:k]] for a, b, k in zip(offs[:-1].tolist(), offs[1:].tolist(), size.tolist())]
    return np.concatenate(parts) if parts else np.empty(0, np.int64), np.concatenate([[0], np.cumsum(size)])


def wide_fingerprint(own: np.ndarray) -> bytes:
    """Parities of a set's members on the bits that their hashes name; the number of bits follows from the set's size."""
    bits = max(64, 1 << (2 * len(own) - 1).bit_length()) if len(own) else 64
    odd = np.bincount(own & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(prints: np.ndarray, words: int) -> np.ndarray:
    """Wide fingerprints (rows of 64-bit words) as they are with ``words`` words."""
    return np.bitwise_xor.reduce(prints.reshape(len(prints), -1, words), axis=1)


def most_bits(nx: np.ndarray, ny: np.ndarray, similarity: float) -> np.ndarray:
    """Members in which two sets of a similarity can differ."""
    return np.floor((1 - similarity) / (1 + similarity) * (nx + ny) + SLACK)


def indexed(docs: DataFrame, text: str, shingle: int, similarity: float, bits_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(key, copies, n, fp, wide, first) of every row of ``docs`` (key, text): copies is a digest
    of the set, n its size, fp a 64-bit fingerprint, wide the wide one, first the prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(shingle_order(docs, text, shingle))  # 2**BUCKET_BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offs in chunks(batches, text):
            h, at = shingle_sets(raw, offs, shingle)
            first, ends = prefixes(h, at, sent.value, similarity)
            own = [h[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            columns = [
                part.column(part.schema.get_field_index("key")),
                pa.array([hashlib.md5(x.tobytes()).digest() for x in own], pa.binary()),
                pa.array(np.diff(at)),
                pa.array(bits_of(h.view(np.uint64), np.diff(at)).view(np.int64)),
                pa.array([wide_fingerprint(x) for x in own], pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(first)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "copies", "n", "fp", "wide", "first"])

    return docs.select("key", text).mapInArrow(run, "key long, copies binary, n long, fp long, wide binary, first array<long>")


def _arrays(batches: list[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    return [np.concatenate([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for b in batches]) for c in names]


def lists(found: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of the possible pairs of short lists, and (h, n, place, node, m) of the members of
    long ones (m in all) that have a possible partner; one row has either.  ``nodes``: the keys
    that stand for their copies."""
    p = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["u", "v", "h", "n", "place", "node", "m"]
    posted = found.join(nodes.select(F.col("node").alias("key")), "key", "left_semi").select(F.posexplode("first").alias("place", "h"), "n", F.col("key").alias("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        h, n, place, node = _arrays(tables, ["h", "n", "place", "node"])
        tables.clear()
        _, of, size = np.unique(h, return_inverse=True, return_counts=True)
        keep = size[of] > 1
        h, n, place, node, m = h[keep], n[keep], place[keep], node[keep], size[of][keep]
        order = np.lexsort((node, h))
        h, n, place, node, m = (x[order] for x in (h, n, place, node, m))
        later, pairs = np.flatnonzero(m <= SHORT), [np.empty((0, 2), np.int64)]
        for d in range(1, SHORT):
            later = later[later >= d]
            later = later[h[later] == h[later - d]]
            ok = later[possible(n[later], n[later - d], place[later], place[later - d], similarity)]
            pairs.append(np.stack([node[ok - d], node[ok]], axis=1))
        uv = np.unique(np.concatenate(pairs), axis=0)
        none = lambda k: pa.nulls(k, pa.int64())
        for a in range(0, len(uv), 50_000):
            x = uv[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy()), *(none(len(x)) for _ in range(5))], names=names)
        long = np.flatnonzero(m > SHORT)
        long = long[partnered(h[long], n[long], place[long], similarity)]
        for a in range(0, len(long), 50_000):
            i = long[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([none(len(i)), none(len(i)), *(pa.array(x[i].astype(np.int64)) for x in (h, n, place, node, m))], names=names)

    return posted.repartition(p, "h").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def possible(nx: np.ndarray, ny: np.ndarray, px: np.ndarray, py: np.ndarray, similarity: float) -> np.ndarray:
    """Sizes, and places of the first shared member, allow the similarity."""
    shared = similarity / (1 + similarity) * (nx + ny) - SLACK
    return (np.minimum(nx, ny) >= similarity * np.maximum(nx, ny) - SLACK) & (np.minimum(nx - px, ny - py) >= shared)


def partnered(h: np.ndarray, n: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """Whether each member has a ``possible`` partner in its list (equal h, side by side).

    Of the partners that its own size and place allow, a range of sizes, the one that allows
    the largest is looked up: doubling maxima over the members in order of their sizes."""
    per = (1 + similarity) / similarity
    top = np.floor(per * (n - place + SLACK)) - n  # the largest partner that size and place allow
    lists = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]])) if len(h) else h
    span = float(n.max() + 2) / similarity * 2 if len(h) else 1.0
    order = np.lexsort((n, lists))
    size, most, of = n[order], top[order], lists[order] * span
    at = np.arange(len(h))
    lo = np.searchsorted(of + size, of + similarity * size - SLACK)
    hi = np.searchsorted(of + size, of + np.minimum(size / similarity, most) + SLACK, "right")
    levels = [most]
    while len(levels[-1]) > 1 << (len(levels) - 1):
        half = 1 << (len(levels) - 1)
        levels.append(np.maximum(levels[-1][:-half], levels[-1][half:]))

    def best(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, some = np.full(len(a), -np.inf), b > a
        k = np.frexp((b - a)[some].astype(float))[1] - 1  # the largest power of two in the range
        u, v, got = a[some], b[some], np.empty(int(some.sum()))
        for j in np.unique(k):
            pick = k == j
            got[pick] = np.maximum(levels[j][u[pick]], levels[j][v[pick] - (1 << int(j))])
        out[some] = got
        return out

    found = np.maximum(best(lo, np.minimum(at, hi)), best(np.maximum(at + 1, lo), hi)) >= size
    out = np.zeros(len(h), bool)
    out[order] = found
    return out


def _likely(t: dict[str, np.ndarray], similarity: float, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (x, y, share of differing bits) of a list's members under different labels that pass all filters.

    Members of two sides meet across only."""
    n, side = t["n"], t["side"]
    across = len(np.unique(side)) > 1 or bool(t["across"][0])
    words = np.array([len(w) // 8 for w in t["wide"]])
    for k in np.unique(words):
        a = np.flatnonzero(words == k)
        b = np.flatnonzero((words == k) | (words == 2 * k))  # others differ too much in size
        b = b[np.argsort(n[b], kind="stable")]
        a = a[np.argsort(n[a], kind="stable")]
        wide_a = np.stack([np.frombuffer(t["wide"][i], np.uint64) for i in a])
        wide_b = np.stack([_folded(np.frombuffer(t["wide"][i], np.uint64)[None, :], k)[0] for i in b])
        step = max(1, AT_ONCE // (len(b) * (int(k) + A_PAIR)))
        for c in range(0, len(a), step):
            x = a[c : c + step]
            lo, hi = np.searchsorted(n[b], similarity * n[x[0]] - SLACK), np.searchsorted(n[b], n[x[-1]] / similarity + SLACK, "right")
            y = b[lo:hi]
            differ = np.bitwise_count(wide_a[c : c + step, None, :] ^ wide_b[None, lo:hi, :]).sum(axis=2, dtype=np.int32)
            ok = (differ <= most_bits(n[x][:, None], n[y][None, :], similarity)) & (label[x][:, None] != label[y][None, :])
            ok &= (words[y] > k)[None, :] | (x[:, None] < y[None, :])  # each pair once
            if across:
                ok &= side[x][:, None] != side[y][None, :]
            i, j = np.nonzero(ok)
            far = differ[i, j] / np.maximum(n[x[i]] + n[y[j]], 1)
            i, j = x[i], y[j]
            fine = possible(n[i], n[j], t["place"][i], t["place"][j], similarity)
            yield i[fine], j[fine], far[fine]


def _joined_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the pairs (i, j) are one: the least of all they reach."""
    names, at = np.unique(label, return_inverse=True)
    u, v, root = at[i], at[j], np.arange(len(names))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            return names[root[at]]
        root = new


def forest(t: dict[str, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Likely pairs that connect what all likely pairs connect: round by round each member's best to another part."""
    label, out = t["root"], []
    while True:
        best = {}
        for i, j, far in _likely(t, similarity, label):
            for x, y in ((i, j), (j, i)):
                order = np.lexsort((y, far, x))
                head = np.flatnonzero(np.concatenate([[True], np.diff(x[order]) != 0])) if len(order) else order
                for k in order[head]:
                    seen = best.get(int(x[k]))
                    if seen is None or (far[k], y[k]) < seen:
                        best[int(x[k])] = (far[k], y[k])
        if not best:
            break
        i, j = np.array(list(best)), np.array([y for _, y in best.values()])
        out.append((i, j))
        label = _joined_labels(label, i, j)
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out))  # type: ignore[return-value]


def long_pairs(members: DataFrame, found: DataFrame, roots: DataFrame | None, similarity: float) -> DataFrame:
    """(u, v) of likely pairs of long lists' members under different roots: a forest of each list
    if no roots are known yet, else all of them."""
    every = roots is not None
    rows = members.withColumn("root", F.col("node")) if roots is None else members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if every:
        several = rows.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("h")
        rows = rows.join(several, "h", "left_semi")
    rows = rows.join(found.select(F.col("key").alias("node"), "wide"), "node")
    blocks = F.ceil(F.col("m") / BLOCK).cast("long")
    rows = rows.withColumn("side", F.pmod(F.xxhash64("node"), blocks))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("h", "n", "place", "node", "root", "wide", "side", (F.col("side") != F.col("other")).alias("across"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))

    def meet(t: pa.Table) -> pa.Table:
        at = {c: t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("n", "place", "node", "root", "side", "across")}
        at["wide"] = t["wide"].to_pylist()
        if every:
            both = [(x, y) for x, y, _ in _likely(at, similarity, at["root"])]
            i, j = (np.concatenate([p[k] for p in both]) if both else np.empty(0, np.int64) for k in (0, 1))
        else:
            i, j = forest(at, similarity)
        x, y = at["node"][i], at["node"][j]
        return pa.table({"u": pa.array(np.minimum(x, y), pa.int64()), "v": pa.array(np.maximum(x, y), pa.int64())})

    return rows.groupBy("h", "i", "j").applyInArrow(meet, "u long, v long").distinct()


def plausible(pairs: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sizes and wide fingerprints allow the similarity."""
    side = lambda c: found.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"w{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nu, nv, wu, wv = (b.column(i) for i in range(2, 6))
            keep = np.zeros(b.num_rows, bool)
            most = most_bits(nu.to_numpy(), nv.to_numpy(), similarity)
            for i in range(b.num_rows):
                x, y = (np.frombuffer(w[i].as_buffer(), np.uint64)[None, :] for w in (wu, wv))
                k = min(x.shape[1], y.shape[1])
                keep[i] = np.bitwise_count(_folded(x, k) ^ _folded(y, k)).sum() <= most[i]
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["u", "v"])

    sized = (F.least("nu", "nv") >= similarity * F.greatest("nu", "nv") - SLACK)
    return pairs.join(side("u"), "u").join(side("v"), "v").where(sized).select("u", "v", "nu", "nv", "wu", "wv").mapInArrow(run, "u long, v long")


def similar(pairs: DataFrame, docs: DataFrame, text: str, shingle: int, similarity: float) -> DataFrame:
    """(u, v, alike): the pairs, and whether their texts' sets have the similarity."""

    def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return shingle_sets(*utf8(column), shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = b.column(0).to_numpy()
            bytes_of = utf8(b.column(2))[1] + utf8(b.column(3))[1]
            a = 0
            while a < b.num_rows:
                z = min(b.num_rows, max(a + 1, int(np.searchsorted(bytes_of, bytes_of[a] + 2 * CHUNK_BYTES, "right")) - 1))
                head = np.concatenate([[True], u[a + 1 : z] != u[a : z - 1]])  # neighbours often share u
                hx, ox = sets(b.column(2).slice(a, z - a).take(pa.array(np.flatnonzero(head))))
                hy, oy = sets(b.column(3).slice(a, z - a))
                alike = np.zeros(z - a, bool)
                for i, k in enumerate((np.cumsum(head) - 1).tolist()):
                    x, y = hx[ox[k] : ox[k + 1]], hy[oy[i] : oy[i + 1]]
                    both = np.sort(np.concatenate([x, y]), kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    alike[i] = shared >= similarity * (len(x) + len(y) - shared) - SLACK
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), b.column(1).slice(a, z - a), pa.array(alike)], names=["u", "v", "alike"])
                a = z

    side = lambda c: docs.select(F.col("key").alias(c), F.col(text).alias(f"t{c}"))
    both = pairs.join(side("v"), "v").join(side("u"), "u").select("u", "v", "tu", "tv")
    return both.mapInArrow(run, "u long, v long, alike boolean")
