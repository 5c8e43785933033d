"""Phrase collocations by suffix sorting.

First all words are counted by language. A phrase that occurs `least` times or more holds only words that do, so texts are cut at all others; at each place
the suffix of up to `longest` words goes, after equal ones of a task are summed, to the partition of its language, first word and following words. Partitions
are ranges in reverse lexicographic order, so a very common first word, or pair, spans as many of them as it needs. A partition's sorted suffixes are
counted by one stack: of all prefixes that end where the next suffix differs. The prefixes that a partition shares with its neighbours meet in a last sum. Parts
of a phrase are phrases themselves: their counts are joined afterwards.

Words are 64-bit hashes on the way; the table of words shows whether two of them share one, and the seed is changed until none do. The words counted
`least` times are known to the tasks by a bitmap of fixed size (a word beyond them that it lets through costs time only).

Defined cases: a null text has no words; a null language is `und`; texts of any length are whole; repeated rows count each time; an empty table gives an
empty result; extra columns are left out; of phrases with equal score and count the first in byte order comes first."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import tidy

LEAST, LONGEST, COVERED, TOP = 30, 4, 80, 2000
SCALE = 2_000_000
UNKNOWN = "und"
#: Characters between pieces, and between the words of a piece.
BREAKS, BLANKS = b".,;:!?\n\v\f\r", b" \t"
#: Bits of the table of frequent words (16 MB), and of a row of it as it is made.
BITS, ROW_BITS = 27, 18
#: Words gathered before equal suffixes are summed; entries of a worker's table of words, and bytes of the longest word kept in it.
BATCH, TABLE, KEPT = 2_000_000, 400_000, 64
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]


def word_hash(word: bytes, seed: int) -> int:
    """64 bits, neither 0 nor the sign alone, which mean an end and nothing."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(word, seed)
    return h if h & ((1 << 63) - 1) else 1


def word_table(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(lang, word, h, f): all words with their hashes (never 0) and counts. Tasks sum what they hold before the shuffle."""
    spark = docs.sparkSession
    common.small_batches(spark)
    to = bytes.maketrans(UPPER + BREAKS + BLANKS, LOWER + b" " * len(BREAKS + BLANKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                words = list(counts)
                hashes = np.fromiter((word_hash(w, seed) for w in words), np.uint64, len(words)).view(np.int64)
                for i in range(0, len(words), 50_000):
                    part = words[i : i + 50_000]
                    cols = [pa.array([lang] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array(hashes[i : i + 50_000]), pa.array([counts[w] for w in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["lang", "word", "h", "f"])
            held.clear()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if text:
                    held.setdefault(lang, Counter()).update(text.translate(to).split())
            if sum(map(len, held.values())) > TABLE:
                yield from out()
        yield from out()
        tidy()

    found = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, word string, h long, f long")
    return found.groupBy("lang", "word", "h").agg(F.sum("f").alias("f"))


def words_of(docs: DataFrame, name: str = "words") -> tuple[DataFrame, int]:
    """The written table of words by a seed under which no two words share a hash, and that seed."""
    for seed in range(8):
        words = common.written(word_table(docs, seed), name)
        twice = words.groupBy("h").agg(F.min("word").alias("a"), F.max("word").alias("b")).where("a <> b")
        if twice.isEmpty():
            return words, seed
    raise RuntimeError("words share hashes under each seed")


def frequent(words: DataFrame, least: int) -> bytes:
    """The bitmap of the words counted so often in some language, compressed: by the top BITS bits of their hashes."""
    places = words.where(F.col("f") >= least).select(F.shiftrightunsigned("h", 64 - BITS).alias("at")).distinct()

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        bits = np.zeros(1 << ROW_BITS, bool)
        bits[rows["at"].to_numpy() & ((1 << ROW_BITS) - 1)] = True
        return pa.table({"row": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    rows = places.withColumn("row", F.shiftright("at", ROW_BITS)).groupBy("row").applyInArrow(pack, "row long, bits binary").collect()  # 512 rows of 32 kB at most
    all_bits = np.zeros(1 << (BITS - 3), np.uint8)
    for r in rows:
        all_bits[r.row << (ROW_BITS - 3) : (r.row + 1) << (ROW_BITS - 3)] = np.frombuffer(r.bits, np.uint8)
    return zlib.compress(all_bits.tobytes(), 1)


def suffixes(docs: DataFrame, seed: int, bitmap: bytes) -> DataFrame:
    """(lang, w1 .. w4, n): the truncated suffixes of two words or more, 0 after their end, equal ones of a batch summed."""
    common.small_batches(docs.sparkSession)
    to = bytes.maketrans(UPPER + BREAKS + BLANKS, LOWER + b"\n" * len(BREAKS) + b" " * len(BLANKS))
    names = WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zlib.decompress(bitmap), np.uint8)

        def hashed(word: bytes) -> int:
            """The word's hash, 0 for one that ends a phrase."""
            h = word_hash(word, seed)
            at = h >> (64 - BITS)
            return (h - (1 << 64) if h >> 63 else h) if bits[at >> 3] >> (7 - (at & 7)) & 1 else 0

        class Table(dict):
            def __missing__(self, word: bytes) -> int:
                h = hashed(word)
                if len(word) <= KEPT and len(self) < TABLE:
                    self[word] = h
                return h

        empty = -(1 << 63)  # of what stands between two blanks
        table = Table({b"\n": 0, b"": empty})
        held: dict[str, list] = {}
        gap = np.zeros(LONGEST, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, runs in held.items():
                flat = np.concatenate([*runs, gap])
                size = len(flat) - LONGEST
                cols = [flat[:size]]
                for i in range(1, LONGEST):
                    cols.append(np.where(cols[-1] != 0, flat[i : size + i], 0))
                there = np.flatnonzero((cols[0] != 0) & (cols[1] != 0))
                cols = [c[there] for c in cols]
                if not len(there):
                    continue
                mix = np.zeros(len(there), np.uint64)
                for c in cols:
                    mix = (mix ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    mix ^= mix >> np.uint64(29)
                order = np.argsort(mix)
                cols = [c[order] for c in cols]
                new = np.ones(len(order), bool)
                new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(order)))
                cols = [c[first] for c in cols]
                for i in range(0, len(first), 100_000):
                    part = [pa.array(c[i : i + 100_000]) for c in cols]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part[0])), *part, pa.array(n[i : i + 100_000], pa.int64())], names=["lang", *names, "n"])
            held.clear()

        total = 0
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if text:
                    tokens = text.translate(to).replace(b"\n", b" \n ").split(b" ")
                    ids = np.fromiter(map(table.__getitem__, tokens), np.int64, len(tokens))
                    held.setdefault(lang, []).extend([ids[ids != empty], gap[:1]])
                    total += len(tokens)
            if total > BATCH:
                yield from out()
                total = 0
        yield from out()
        tidy()

    schema = "lang string, " + ", ".join(f"{w} long" for w in names) + ", n long"
    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def counted(suffix: DataFrame, least: int) -> DataFrame:
    """(lang, w1 .. w4, f): all prefixes of the suffixes that are counted `least` times or more.

    Suffixes are dealt by range and sorted; the stack holds the open prefix of each length with its count so far, and goes on from batch to batch. What a batch closes
    is found for all of its rows at once. The first and the last prefix of each length of a partition may go on in a neighbour: they are handed out whatever their count."""
    order = [F.col(c).desc() for c in ("lang", *WORDS)]
    names = WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # for each length: words, count, whether it is the partition's first
        here = None

        def closed(lang: str, rows: list) -> Iterator[pa.RecordBatch]:
            if rows:
                words = np.array([list(w) + [0] * (LONGEST - len(w)) for w, _ in rows], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), *(pa.array(words[:, i]) for i in range(LONGEST)), pa.array([f for _, f in rows], pa.int64())], names=["lang", *names, "f"])

        def counts(lang: str, cols: list, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal stack, here
            if lang != here:
                yield from closed(here, [(w, f) for w, f, _ in stack if w])
                stack, here = [], lang
            changed = np.zeros(len(n), bool)
            for k in range(2, LONGEST + 1):
                if k == 2:
                    changed[1:] = cols[0][1:] != cols[0][:-1]
                changed[1:] |= cols[k - 1][1:] != cols[k - 1][:-1]
                changed[0] = True
                first = np.flatnonzero(changed)
                sums = np.add.reduceat(n, first)
                there = cols[k - 1][first] != 0
                heads = [c[first] for c in cols[:k]]
                top = stack[k - 2] if len(stack) >= k - 1 else [None, 0, True]
                done = []
                head = tuple(int(h[0]) for h in heads)
                if top[0] == head:
                    sums[0] += top[1]
                elif top[0] is not None and (top[1] >= least or top[2]):
                    done.append((top[0], top[1]))
                goes_on = top[0] is None or (top[0] == head and top[2])  # the first of its length in the partition, as far as is known
                keep = there & (sums >= least)
                keep[-1] = False
                if len(first) > 1 and goes_on and there[0]:
                    keep[0] = True
                at = np.flatnonzero(keep)
                if len(at):
                    tail = [pa.array(h[at]) for h in heads] + [pa.array(np.zeros(len(at), np.int64))] * (LONGEST - k)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), *tail, pa.array(sums[at], pa.int64())], names=["lang", *names, "f"])
                yield from closed(lang, done)
                last = tuple(int(h[-1]) for h in heads)
                new = [last if there[-1] else None, int(sums[-1]), goes_on and len(first) == 1]
                if not there[-1]:  # a shorter suffix: no prefix of this length is open, and the partition's first has been seen
                    new = [(), 0, False]
                stack[k - 2 : k - 1] = [new]

        for b in batches:
            langs = b.column("lang").to_pylist() if b.num_rows and b.column("lang")[0] != b.column("lang")[b.num_rows - 1] else None
            cols, n = [b.column(c).to_numpy() for c in names], b.column("n").to_numpy()
            if not b.num_rows:
                continue
            if langs is None:
                yield from counts(b.column("lang")[0].as_py(), cols, n)
                continue
            cuts = [0, *(i for i in range(1, len(langs)) if langs[i] != langs[i - 1]), len(langs)]
            for i, j in zip(cuts, cuts[1:]):
                yield from counts(langs[i], [c[i:j] for c in cols], n[i:j])
        yield from closed(here, [(w, f) for w, f, _ in stack if w])

    schema = "lang string, " + ", ".join(f"{w} long" for w in names) + ", f long"
    dealt = suffix.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, schema).groupBy("lang", *WORDS).agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def length() -> Column:
    return sum(((F.col(w) != 0).cast("int") for w in WORDS), F.lit(0))


def part(first: int, last: int, prefix: str = "") -> list[Column]:
    """The words of a place up to another as a phrase's columns."""
    return [(F.col(WORDS[first + i]) if first + i < last else F.lit(0).cast("long")).alias(f"{prefix}{w}") for i, w in enumerate(WORDS)]


def phrases(grams: DataFrame, covered: int = COVERED) -> DataFrame:
    """Of (lang, w1 .. w4, f) with phrases of one word as well: candidates that no longer one covers, with a, l, r and score.

    Each candidate looks up its own parts: equi-joins by whole phrase, against a table that is broadcast if its counted rows allow; a part that
    many candidates end with is a hot key that AQE splits."""
    candidates = grams.withColumn("len", length()).where("len > 1")
    inner = [(k, i, i + m) for k in range(3, LONGEST + 1) for m in range(2, k) for i in range(k - m + 1)]
    held = [F.when(F.col("len") == k, F.struct(*part(i, j), F.col("f").alias("longer"))) for k, i, j in inner]
    within = candidates.where("len > 2").select("lang", F.explode(F.array_compact(F.array(*held))).alias("s")).select("lang", "s.*").groupBy("lang", *WORDS).agg(F.max("longer").alias("longer"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    open_ = candidates.join(within, ["lang", *WORDS], "left").where(F.col("longer").isNull() | (100 * big("longer") < covered * big("f"))).drop("longer")

    cuts = [F.when(F.col("len") > k, F.struct(F.lit(k).alias("k"), *(c.alias(f"l{i}") for i, c in enumerate(part(0, k))), *_rest(k))) for k in range(1, LONGEST)]
    cut = open_.select("lang", *WORDS, F.col("f").alias("a"), F.explode(F.array_compact(F.array(*cuts))).alias("c")).select("lang", *WORDS, "a", "c.*")
    table = common.if_small(grams)
    side = lambda p, name: table.select("lang", *(F.col(w).alias(f"{p}{i}") for i, w in enumerate(WORDS)), F.col("f").alias(name))
    keys = lambda p: ["lang", *(f"{p}{i}" for i in range(LONGEST))]
    both = cut.join(side("l", "l"), keys("l")).join(side("r", "r"), keys("r"))
    score = F.expr(f"CAST(a AS decimal(19,0)) * {SCALE} div (CAST(l AS decimal(19,0)) + CAST(r AS decimal(19,0)))")
    best = both.withColumn("score", score).groupBy("lang", *WORDS).agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b"))
    return best.select("lang", *WORDS, "b.a", "b.l", "b.r", "b.score")


def _rest(k: int) -> list[Column]:
    """The words after the first k, up to the phrase's end, as columns r0 .. r3."""
    return [(F.col(WORDS[k + i]) if k + i < LONGEST else F.lit(0).cast("long")).alias(f"r{i}") for i in range(LONGEST)]


def _limits_early(spark: SparkSession, top: int) -> None:
    """Let ranks up to this one be cut before their shuffle."""
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    spark.conf.set(key, max(int(spark.conf.get(key, "1000")), top))


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    words, seed = words_of(docs)
    often = words.where(F.col("f") >= least)
    grams = common.written(counted(suffixes(docs, seed, frequent(words, least)), least), "grams")
    ones = often.select("lang", F.col("h").alias("w1"), *(F.lit(0).cast("long").alias(w) for w in WORDS[1:]), "f")
    found = phrases(common.written(grams.union(ones), "phrases"), covered)
    _limits_early(docs.sparkSession, top)
    # phrases level with the last one stay, as their words decide
    place = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    best = common.written(found.withColumn("place", place).where(F.col("place") <= top).drop("place"), "best")
    used = best.select("lang", F.explode(F.array(*WORDS)).alias("h")).where("h <> 0").distinct()
    names = common.if_small(common.written(often.join(common.if_small(used), ["lang", "h"], "left_semi").select("lang", "h", "word"), "names"))
    for w in WORDS:
        best = best.join(names.select("lang", F.col("h").alias(w), F.col("word").alias(f"_{w}")), ["lang", w], "left")
    best = best.withColumn("phrase", F.concat_ws(" ", *(f"_{w}" for w in WORDS)))
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    ranked = best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return ranked.join(common.if_small(common.written(n, "totals")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, w[i + 1 : i + k] AS words, count(*) AS f FROM (SELECT lang, w, k, unnest(range(len(w) - k + 1)) AS i FROM w CROSS JOIN range(1, 5) t(k) WHERE len(w) >= k) z GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS bigint) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE k > 1 AND f >= 30),
inside AS (SELECT lang, words[i + 1 : i + m] AS words, max(f) AS longer FROM (SELECT lang, words, f, k, m, unnest(range(k - m + 1)) AS i FROM c CROSS JOIN range(2, 4) t(m) WHERE m < k) z GROUP BY ALL),
o AS (SELECT c.* FROM c LEFT JOIN inside i ON c.lang = i.lang AND c.words = i.words WHERE longer IS NULL OR 100 * CAST(longer AS hugeint) < 80 * CAST(f AS hugeint)),
s AS (SELECT o.lang, o.words, o.f AS a, l.f AS l, r.f AS r, j, CAST(CAST(o.f AS hugeint) * 2000000 // (CAST(l.f AS hugeint) + r.f) AS bigint) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM o) o JOIN g l ON o.lang = l.lang AND l.words = o.words[1 : j] JOIN g r ON o.lang = r.lang AND r.words = o.words[j + 1 : o.k]),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, j) AS best FROM s) z WHERE best = 1),
t AS (SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, score FROM b)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang)) z WHERE rank <= 2000
"""
