"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

1. Document frequencies of five-word shingles are counted over all documents into two rows of `buckets` counters (fixed size, each hashed by
   bits of its own). A counter also holds other shingles: their mean is taken off, and the smaller of the two estimates counts. With m shingles
   in all documents that leaves an error of about sqrt(m / buckets) documents for a rare shingle, and next to none for a frequent one.
   A shingle's weight is tf * 2 in up to c documents, where c is a tenth of all N (1000 at least), and tf * (1 + ln(N / df) / ln(N / c)) beyond:
   what all documents share weighs half. Copies share what only they have, and edits are rare: were the weight to fall from the rarest on, members of a
   large group would be the less alike the more of them there are, and the less the more documents there are.
2. Each distinct text gets bands * rows samples. A sample of a weighted set is the shingle that minimises ln a = ln c - r (t - beta) - r
   with t = floor(ln w / r + beta), and its t; r, c ~ Gamma(2, 1) and beta ~ U(0, 1) are drawn by the shingle's hash.
   Two sets agree on a sample with a probability equal to their weighted Jaccard similarity.
3. Texts that share a band are candidates. In each bucket all are compared with one of them. Where more than a block of its members are then
   outside of its largest class, they are compared with one of those, a few times over: each such round sends a bucket's texts once, and another
   follows only if the last one spared more texts than that.
   Of what is left, the members outside of the largest class (s of n) are compared with all of the bucket, in pairs of blocks, so that
   2 s n / BLOCK texts are sent, one band's wide buckets first, and those of other bands by what is then known: no candidate pair of different classes is left out, a bucket that is one class costs comparisons in proportion to its
   size, and tasks return a forest of links, never pairs. Only texts that share a band and are pairwise unlike make s as large as n.
4. A link is a weighted Jaccard similarity of `least` or more over the whole texts. Classes are the connected components.

Defined cases: texts that are equal are one class at once; a text without a word (null, empty, white space) is in a class of its own; one
of fewer than five words has one shingle of all its words; a class's id is its smallest doc_id (null only if all are); rows that repeat
are in one class; an empty table gives an empty result; extra columns pass through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import grouped, tidy

WORDS, LEAST, BANDS, ROWS, BUCKETS = 5, 0.8, 12, 3, 1 << 20
#: Texts of a block, where a bucket is compared in pairs of blocks, and columns of the matrices that compare them.
BLOCK, COLUMNS = 140, 8192
#: Shingles in up to one of so many documents, or so many of them, weigh alike.
COMMON, FEWEST = 10, 1000
#: Rounds that compare members outside of a bucket's largest class with one of them, and rounds that compare one band's wide buckets as a whole.
ROUNDS = 3
#: Members of a comparison that one task takes; larger groups are dealt to several.
DEALT = 500
TOGETHER = 100_000
U = np.uint64


class Words(dict):
    """Hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


class Shingles:
    """Distinct shingles of some texts: h and tf in order of doc; starts and doc of each text that has any."""

    def __init__(self, texts: list[str | None], table: Words, words: int = WORDS):
        n, all_words = [], []
        for t in texts:
            own = t.encode("utf-8", "surrogatepass").split() if t else []
            n.append(len(own))
            all_words += own
        n = np.array(n, np.int64)
        total = len(all_words)
        w = np.zeros(total + words, U)
        w[:total] = np.fromiter(map(table.__getitem__, all_words), U, total)
        doc = np.repeat(np.arange(len(n)), n)
        end = np.cumsum(n)
        h, factor = np.zeros(total, U), 1
        for j in range(words):
            h += w[j : total + j] * U(factor)
            factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
        valid = np.arange(total) + words <= end[doc]
        for d in np.flatnonzero((n > 0) & (n < words)):
            a, x, factor = end[d] - n[d], int(n[d]), 1
            for v in w[a : end[d]].tolist():
                x = (x + v * factor) % (1 << 64)
                factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
            h[a], valid[a] = U(x), True
        h, doc = mixed(h[valid]), doc[valid]
        g = h ^ (doc.astype(U) * U(0xC2B2AE3D27D4EB4F))
        order = np.argsort(g)
        g = g[order]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
        tf = np.zeros(len(g), np.int64)
        tf[order[first]] = np.diff(np.r_[first, len(g)])
        one = tf > 0
        self.h, self.tf, at = h[one], tf[one], doc[one]
        self.starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        self.doc = at[self.starts]
        self.sizes = np.diff(np.r_[self.starts, len(at)])


def weight(df: np.ndarray, n: int) -> np.ndarray:
    """What a shingle of so many of n documents weighs each time it occurs."""
    n = max(n, 1)
    most = min(max(n / COMMON, FEWEST), n)
    return 1 + np.log(n / np.clip(df, most, n)) / np.log(n / most) if most < n else np.full(np.shape(df), 2.0)


class Idf:
    """Weights by two rows of counters over n documents; the smaller estimate of a frequency is the larger weight."""

    def __init__(self, counts: np.ndarray, n: int):
        others = (counts.sum(1, keepdims=True) - counts) / max(counts.shape[1] - 1, 1)
        self.tables = weight(np.rint(counts - others), n).astype(np.float32)

    def of(self, s: Shingles) -> np.ndarray:
        a, b = places(s.h, self.tables.shape[1])
        return s.tf * np.maximum(self.tables[0][a], self.tables[1][b]).astype(np.float64)


def places(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The counters of a hash in the two rows: bits of their own, for up to 2^22 buckets."""
    return tuple((h >> U(shift)).astype(np.int64) & (buckets - 1) for shift in (17, 41))


class Sampler:
    """r and c are Gamma(2, 1), minus the logarithm of a product of two uniform numbers; all five numbers of a sample come from the bits of two
    hashes of the shingle, so that different shingles have different draws in texts of any length."""

    def __init__(self, samples: int, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.by = draw.integers(1 << 62, (1 << 63) - 1, samples, dtype=np.uint64) * U(2) + U(1)

    @staticmethod
    def uniform(bits: np.ndarray, n: int) -> np.ndarray:
        """Numbers in (0, 1] from n bits."""
        return (bits.astype(np.int64).astype(np.float32) + np.float32(0.5)) * np.float32(0.5**n)

    def draws(self, h: np.ndarray, by: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(r, ln c, beta) of shingles."""
        x = mixed(h * by)
        y = mixed(x * U(0x9FB21C651E98DF25))
        r = -np.log(self.uniform(x >> U(32), 32) * self.uniform(x & U(0xFFFFFFFF), 32))
        c = -np.log(self.uniform(y >> U(43), 21) * self.uniform((y >> U(22)) & U(0x1FFFFF), 21))
        return np.maximum(r, np.float32(1e-6)), np.log(np.maximum(c, np.float32(1e-7))), self.uniform(y & U(0x3FFFFF), 22)

    def samples(self, s: Shingles, w: np.ndarray) -> np.ndarray:
        """(texts, samples): the hash of each text's sampled shingle and t."""
        lw = np.log(w).astype(np.float32)
        out = np.empty((len(s.starts), len(self.by)), U)
        for k, by in enumerate(self.by):
            r, log_c, beta = self.draws(s.h, by)
            t = np.floor(lw / r + beta)
            a = log_c - r * (t - beta + np.float32(1))
            least = np.minimum.reduceat(a, s.starts)
            at = np.flatnonzero(a == np.repeat(least, s.sizes))
            picked = mixed(s.h[at] * U(0x9FB21C651E98DF25) + (t[at].astype(np.int64)).view(U) * by)
            out[:, k] = np.minimum.reduceat(picked, np.searchsorted(at, s.starts))
        return out


def _parts(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") // 6
        if size >= TOGETHER:
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def packed(counts: np.ndarray) -> bytes:
    """Counts below 2^32, compressed: their lowest bytes first, then the next ones, as most counts are small."""
    return pa.compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(part: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(part, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(n)


def frequencies(texts: DataFrame, buckets: int = BUCKETS) -> Idf:
    """Document frequencies. Each task adds up what it reads; blocks of the table are then summed by reducers as they stream in.
    What reaches the driver has a fixed size."""
    blocks = 64
    width = 2 * buckets // blocks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, df, n = Words(), np.zeros((2, buckets), np.int64), 0
        for b in batches:
            for _, part in _parts(b.column(0).to_pylist()):
                s = Shingles(part, table)
                for row, at in zip(df, places(s.h, buckets)):
                    row += np.bincount(at, minlength=buckets)
                n += len(s.starts)
        del table
        tidy()
        if n:
            for k, x in enumerate(df.reshape(blocks, -1)):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([n if k == 0 else 0]), pa.array([packed(x)])], names=["block", "n", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for b in batches:
            for k, m, x in zip(*(c.to_pylist() for c in b.columns)):
                own = total.setdefault(k, np.zeros(width, np.int64))
                own += unpacked(x, width)
                n[k] = n.get(k, 0) + m
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([n[k]]), pa.array([x.tobytes()])], names=["block", "n", "part"])

    kind = "block long, n long, part binary"
    found = texts.select("text").mapInArrow(count, kind).repartition(blocks, "block").mapInArrow(add, kind).collect()
    df, n = np.zeros((blocks, width), np.int64), 0
    for x in found:
        df[x.block] = np.frombuffer(x.part, np.int64)
        n += x.n
    return Idf(df.reshape(2, -1), n)


def signatures(texts: DataFrame, idf, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, fp (the text's digest) and the keys of its bands, for each row whose text has a word."""
    from pyspark.sql import types as T

    kind = T.StructType([texts.schema["doc_id"], T.StructField("fp", T.StringType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sampler, idf_ = Words(), Sampler(bands * rows), idf.value
        for b in batches:
            for begin, part in _parts(b.column("text").to_pylist()):
                s = Shingles(part, table)
                if not len(s.starts):
                    continue
                x = sampler.samples(s, idf_.of(s)).reshape(-1, bands, rows)
                key = x[:, :, 0]
                for j in range(1, rows):
                    key = mixed(key * U(0x9E3779B97F4A7C15) + x[:, :, j])
                flat = pa.array(np.ascontiguousarray(key).view(np.int64).reshape(-1))
                at = pa.array(s.doc + begin)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(s.doc) + 1, bands, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("fp").take(at), lists], names=["doc_id", "fp", "bands"])
        del table, sampler
        tidy()

    return texts.select("doc_id", "text", F.md5("text").alias("fp")).mapInArrow(run, kind)


def verified(pairs: DataFrame, texts: DataFrame, idf, least: float = LEAST) -> DataFrame:
    """(a, b) of the pairs (a, b) whose texts have a weighted Jaccard similarity of at least so much. `texts` has a row per fp.

    The members b of a are dealt over tasks, DEALT or so to each, with a's text once for each; rows stream through, a's first."""
    counted = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(counted, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / DEALT)).cast("int").alias("part"))
    dealt = common.written(dealt, "pairs")
    wanted = dealt.select("a", "part", F.col("b").alias("fp")).union(dealt.select("a", "part", F.col("a").alias("fp")).distinct())
    rows = texts.join(common.if_small(common.written(wanted, "wanted")), "fp")
    rows = rows.select("a", "part", (F.col("fp") != F.col("a")).alias("member"), "fp", "text").repartition("a", "part").sortWithinPartitions("a", "part", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, idf_ = Words(), idf.value
        now = h = w = None
        total = 0.0
        for batch in batches:
            names = batch.column("a").to_pylist()
            group = list(zip(names, batch.column("part").to_pylist()))
            fps = batch.column("fp").to_pylist()
            found: list[tuple[str, str]] = []
            for begin, part in _parts(batch.column("text").to_pylist()):
                s = Shingles(part, table)
                sw = idf_.of(s)
                stop = np.r_[s.starts[1:], len(s.h)]
                sums = np.add.reduceat(sw, s.starts) if len(s.starts) else np.zeros(0)
                k = 0
                while k < len(s.doc):
                    i = begin + int(s.doc[k])
                    if fps[i] == names[i]:
                        o = np.argsort(s.h[s.starts[k] : stop[k]])
                        now, h, w, total = group[i], s.h[s.starts[k] : stop[k]][o], sw[s.starts[k] : stop[k]][o], sums[k]
                        k += 1
                        continue
                    last = k
                    while last < len(s.doc) and group[begin + int(s.doc[last])] == group[i] and fps[begin + int(s.doc[last])] != names[i]:
                        last += 1
                    assert now == group[i]
                    x, xw = s.h[s.starts[k] : stop[last - 1]], sw[s.starts[k] : stop[last - 1]]
                    at = np.minimum(np.searchsorted(h, x), len(h) - 1)
                    both = np.where(h[at] == x, np.minimum(w[at], xw), 0.0)
                    common_ = np.add.reduceat(both, s.starts[k:last] - s.starts[k])
                    near = common_ >= least * (sums[k:last] + total - common_) - 1e-9
                    found += [(names[i], fps[begin + int(s.doc[k + j])]) for j in np.flatnonzero(near)]
                    k = last
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], names=["a", "b"])
        table.clear()
        tidy()

    return rows.mapInArrow(run, "a string, b string")


def overlaps(s: Shingles, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(common weight of each pair, weight of each) of the texts of s. A shingle that a text has tf times counts as tf distinct ones, so the
    smaller of two weights is a sum over what both have; that sum is a matrix product over the shingles that two texts or more have."""
    n = len(s.starts)
    text = np.repeat(np.arange(n), s.sizes)
    again = np.repeat(np.arange(len(s.h)), s.tf)
    nth = np.arange(len(again)) - np.repeat(np.cumsum(s.tf) - s.tf, s.tf)
    key, unit, row = mixed(s.h[again] + nth.astype(U) * U(0x9E3779B97F4A7C15)), (w / s.tf)[again], text[again]
    _, column, count = np.unique(key, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    row, column, unit = row[shared], number[column[shared]], np.sqrt(unit[shared]).astype(np.float32)
    order = np.argsort(column, kind="stable")
    row, column, unit = row[order], column[order], unit[order]
    common_ = np.zeros((n, n), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, total, COLUMNS):
        i, j = np.searchsorted(column, [c, c + COLUMNS])
        x = np.zeros((n, min(COLUMNS, total - c)), np.float32)
        x[row[i:j], column[i:j] - c] = unit[i:j]
        common_ += x @ x.T
    return common_, np.add.reduceat(w, s.starts) if n else np.zeros(0)


def links_across(s: Shingles, w: np.ndarray, group: list, least: float) -> list[tuple[int, int]]:
    """Pairs of texts (places in s) of different groups with the similarity, as a forest over the groups: those that join two groups."""
    common_, total = overlaps(s, w)
    names, of = np.unique(np.array(group), return_inverse=True)
    bound = least * (total[:, None] + total[None, :]) / (1 + least)
    i, j = np.nonzero(np.triu(common_ >= bound * (1 - 1e-4), 1))
    i, j = i[of[i] != of[j]], j[of[i] != of[j]]
    up = list(range(len(names)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    stop = np.r_[s.starts[1:], len(s.h)]
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = find(of[a]), find(of[b])
        if x == y:
            continue
        if common_[a, b] < bound[a, b] * (1 + 1e-4):  # too near to the threshold for single precision
            _, p, q = np.intersect1d(s.h[s.starts[a] : stop[a]], s.h[s.starts[b] : stop[b]], assume_unique=True, return_indices=True)
            both = np.minimum(w[s.starts[a] + p], w[s.starts[b] + q]).sum()
            if both < least * (total[a] + total[b] - both) - 1e-9:
                continue
        up[max(x, y)] = min(x, y)
        out.append((a, b))
    return out


def divided(members: DataFrame) -> DataFrame:
    """members (band, key, fp, component) of the buckets that hold several classes, with n, s (how many are outside of the largest class) and main
    (whether the row is in it). Of buckets with the same members one is taken; a pair that is a bucket of its own has been compared already."""
    by = members.groupBy("band", "key", "component").agg(F.count("*").alias("c"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("h"))
    bucket = by.groupBy("band", "key").agg(F.sum("c").alias("n"), F.sum("h").alias("set"), F.count("*").alias("classes"), F.max(F.struct("c", "component")).alias("top")).where("classes > 1 and n > 2")
    one = bucket.groupBy("n", "set").agg(F.min(F.struct("band", "key", "top")).alias("b")).select("b.band", "b.key", "n", (F.col("n") - F.col("b.top.c")).alias("s"), F.col("b.top.component").alias("top"))
    one = common.if_small(common.written(one, "divided"))
    return members.join(one, ["band", "key"]).withColumn("main", F.col("component") == F.col("top")).drop("top")


def across(rows: DataFrame, texts: DataFrame, idf, least: float = LEAST) -> DataFrame:
    """(a, b): links between different classes within buckets. rows: as `divided` makes them.

    Members outside of a bucket's largest class are dealt in blocks, all members in others; a task has one block of each, so it holds a bounded
    number of texts, and a bucket of any size spreads over tasks."""
    part = lambda n, salt: F.pmod(F.xxhash64("fp", F.lit(salt)), F.ceil(F.col(n) / BLOCK)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / BLOCK) - 1).cast("int")))
    task = ["band", "key", "i", "j"]
    few = rows.where("not main").withColumn("i", part("s", 1)).withColumn("j", every("n"))
    all_ = rows.withColumn("j", part("n", 2)).withColumn("i", every("s"))
    dealt = common.written(few.select(*task, "fp", "component").union(all_.select(*task, "fp", "component")).distinct(), "blocks")
    full = texts.join(common.if_small(dealt), "fp").select(*task, "fp", "component", "text").repartition(*task).sortWithinPartitions(*task)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, idf_ = Words(), idf.value
        for _, block in grouped(batches, task):
            fps, groups = block.column("fp").to_pylist(), block.column("component").to_pylist()
            if len(set(groups)) < 2:
                continue
            s = Shingles(block.column("text").to_pylist(), table)
            found = links_across(s, idf_.of(s), [groups[d] for d in s.doc], least)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([fps[s.doc[k[side]]] for k in found]) for side in (0, 1)], names=["a", "b"])
        table.clear()
        tidy()

    return full.mapInArrow(run, "a string, b string")


def classes(docs: DataFrame, least: float = LEAST, bands: int = BANDS, rows: int = ROWS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, fp, class_id, n): a row for each doc_id and distinct text with a word, its class, and the number of its rows."""
    spark = docs.sparkSession
    common.small_batches(spark, size="8m")
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    idf = spark.sparkContext.broadcast(frequencies(texts, buckets))
    signed = common.written(signatures(texts, idf, bands, rows), "signatures")
    one = common.written(signed.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("bands").alias("bands")), "texts")
    bucket = one.select("fp", F.posexplode("bands").alias("band", "key"))
    shared = bucket.groupBy("band", "key").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = common.written(bucket.join(shared, ["band", "key"]), "buckets")
    # a text of each fp, from the row with its smallest id: a row repeated with its id repeats comparisons and changes no result
    used = common.written(members.select("fp").distinct().join(one.select("fp", F.col("first").alias("_first")), "fp"), "used")
    likely, _ = common.parted(texts, F.md5("text"), used.select("fp"))
    held = likely.withColumn("fp", F.md5("text")).join(common.if_small(used.withColumnRenamed("fp", "_fp")), (F.col("fp") == F.col("_fp")) & common.same(F.col("doc_id"), F.col("_first")))
    held = common.written(held.select("fp", "text"), "texts")
    pairs = members.where("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b")).distinct()
    comp = common.components(verified(pairs, held, idf, least))

    def apart(rows: DataFrame) -> DataFrame:
        """The rows whose buckets still hold several classes; what a round has settled is not looked at again."""
        now = rows.select("band", "key", "fp").join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        return common.written(divided(common.written(now.select("band", "key", "fp", "component"), "members")), "apart")

    rest, before = apart(members), None
    for k in range(ROUNDS):
        wide = rest.where(F.col("s") > BLOCK)
        texts_, left = wide.agg(F.count("*"), F.sum("s") * 2 / BLOCK).first()  # what a round sends, and what pairs of blocks would
        if not texts_ or (before is not None and before - left < texts_):
            break
        before = left
        head = wide.where("not main").groupBy("band", "key").agg(F.min_by(F.struct(F.col("fp").alias("a"), F.col("component").alias("of")), F.xxhash64("fp", F.lit(k))).alias("h"))
        head = common.if_small(common.written(head, "head"))  # a row per bucket: the members of a hot one stay where they are
        pairs = wide.join(head, ["band", "key"]).where("component <> h.of").select("h.a", F.col("fp").alias("b")).distinct()
        comp = common.components(verified(common.written(pairs, "heads"), held, idf, least), comp)
        rest = apart(rest)
    for k in range(ROUNDS):
        # bands have much the same groups: once one band's wide buckets are compared as a whole, little is left of the others'
        by = sorted(rest.where(F.col("s") > BLOCK).groupBy("band").agg((F.sum("s") * 2 / BLOCK).alias("sent")).collect(), key=lambda x: (-x.sent, x.band))  # a row per band
        if len(by) < 2:
            break
        own = (F.col("band") == by[0].band) & (F.col("s") > BLOCK)
        comp = common.components(common.forest(across(rest.where(own), held, idf, least)), comp)
        rest = apart(rest.where(~own))
        left = rest.where(F.col("s") > BLOCK).agg(F.sum("s") * 2 / BLOCK).first()[0] or 0
        if sum(x.sent for x in by[1:]) - left < by[0].sent:
            break
    comp = common.components(common.forest(across(rest, held, idf, least)), comp)
    named = one.select("fp", "first").join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = common.written(named, "named")
    ids = named.groupBy("component").agg(F.min("first").alias("class_id"))
    own = signed.groupBy("doc_id", "fp").agg(F.count("*").alias("n"))
    return own.join(named.join(ids, "component").select("fp", "class_id"), "fp").select("doc_id", "fp", "class_id", "n")


def dedup(docs: DataFrame, **kw) -> DataFrame:
    """docs without near copies: of each class the row with the smallest doc_id stays; texts without a word all stay.

    A text of which each row stays is kept where it lies; only rows of the other texts are joined with what is known of their classes."""
    found = common.written(classes(docs, **kw), "kept")
    # a class whose ids are all null, or whose smallest id has several texts, keeps the one with the smallest digest
    least = found.where(common.same(F.col("doc_id"), F.col("class_id")))
    one = least.groupBy("class_id").agg(F.min("fp").alias("fp"), F.max("n").alias("n"), F.count("*").alias("texts"))
    one = common.written(one.select(F.col("class_id").alias("_id"), F.col("fp").alias("_fp"), F.col("n").alias("_n"), "texts"), "one")
    several = common.if_small(common.written(one.where("texts > 1 or _n > 1").select("_id"), "several"))
    losing = found.where(~common.same(F.col("doc_id"), F.col("class_id"))).select("fp").union(least.join(several, common.same(F.col("class_id"), F.col("_id"))).select("fp"))
    losing = common.written(losing.distinct(), "losing")
    nothing = F.col("text").isNull() | ~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    unsure, sure = common.parted(docs, F.when(~nothing, F.md5("text")), losing)
    among, _ = common.parted(one.drop("texts"), F.col("_fp"), losing)
    kept = common.if_small(common.written(among, "among"))
    rest = unsure.withColumn("_key", F.md5("text")).join(kept, common.same(F.col("doc_id"), F.col("_id")) & (F.col("_key") == F.col("_fp")))
    single = rest.where("_n = 1").select(*docs.columns)
    again = rest.where("_n > 1").dropDuplicates(["_key", "_id"]).select(*docs.columns)
    return single.union(again).union(sure)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = classes(docs)
    nothing = F.col("text").isNull() | ~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    alone = docs.where(nothing).select("doc_id", F.col("doc_id").alias("class_id"))
    rows: Column = F.explode(F.expr("sequence(1, cast(n as int))"))
    every = found.select("doc_id", "class_id", rows.alias("_row")).drop("_row").union(alone)
    return every.withColumn("kept", common.same(F.col("doc_id"), F.col("class_id")))
