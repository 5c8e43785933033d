"""Language identification: script ranges narrow candidates, and a Viterbi path over per-word scores labels spans of mixed-language text.

Learning counts the character n-grams (1 to 3, with word ends) and words of all training rows into hashed buckets for each language. A word's
score for a language is its log posterior; a language whose training letters have less than 1 % of a word's script is no candidate for it
while another is. The path changes language at a cost of `penalty`. A text's language is that of most of its words.

Defined cases: a null text, or one without a letter, is `und` with score 0; rows without a language, or in the held-out fifth, teach nothing;
a null doc_id is not held out; with no training row all is `und`; ties go to the language first in order; texts of any length are whole;
rows that repeat are labelled alike; an empty table gives an empty result; extra columns pass through, ones named
like a result (in any case) are replaced."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import tidy

BUCKETS = 1 << 16
PENALTY = 6.0
#: Distinct tokens that a worker keeps.
TABLE = 200_000
#: Starts of script ranges, in order.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0x20000, "han"), (0x32000, "other"),
)
_STARTS = np.array([a for a, _ in SCRIPTS])
NAMES = sorted({s for _, s in SCRIPTS})
_BY_START = np.array([NAMES.index(s) for _, s in SCRIPTS])
#: Words whose n-grams are looked up at once.
WORDS = 20_000


def letters(token: str) -> str:
    return token.lower() if token.isalpha() else "".join(filter(str.isalpha, token)).lower()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word, script): the bucket of each n-gram and of each whole word with the word's place, in order of words; and each word's script,
    that of most of its letters, as an index in NAMES. All words at once."""
    codes = np.frombuffer(f"^{'$^'.join(words)}$".encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    c = _mixed(codes.astype(np.uint64) + np.uint64(1))
    inner = np.ones(len(c), bool)
    inner[starts] = inner[starts + size - 1] = False
    two = np.flatnonzero(word[:-1] == word[1:])
    three = two[:-1][word[two[:-1]] == word[two[:-1] + 2]]
    a, b = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
    power = np.cumprod(np.full(int(size.max()), a))
    whole = np.add.reduceat(c * power[np.arange(len(c)) - starts[word]], starts)
    one = np.flatnonzero(inner)
    h = np.concatenate([c[one], c[two] * a + c[two + 1], (c[three] * a + c[three + 1]) * b + c[three + 2], whole * b])
    of = np.concatenate([word[one], word[two], word[three], np.arange(len(words))])
    order = np.argsort(of, kind="stable")
    kinds = _BY_START[np.searchsorted(_STARTS, codes[one], "right") - 1]
    counts = np.bincount(word[one] * len(NAMES) + kinds, minlength=len(words) * len(NAMES)).reshape(len(words), len(NAMES))
    return (_mixed(h)[order] % np.uint64(BUCKETS)).astype(np.int64), of[order], counts.argmax(1)


def learn(rows: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, np.ndarray]:
    """Counts of each language: BUCKETS n-gram buckets, then letters by script. Tasks add up what they read, reducers sum by language as parts
    stream in; the driver gets one table of fixed size for each language."""
    size = BUCKETS + len(NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def settle() -> None:
            for k, seen in tokens.items():
                total = sums.setdefault(k, np.zeros(size, np.int64))
                pairs = [(w, n) for token, n in seen.items() if (w := letters(token))]
                for i in range(0, len(pairs), WORDS):
                    words, n = zip(*pairs[i : i + WORDS])
                    n = np.array(n, np.int64)
                    bucket, word, kinds = grams(list(words))
                    total[:BUCKETS] += np.bincount(bucket, n[word], BUCKETS).astype(np.int64)
                    total[BUCKETS:] += np.bincount(kinds, n * np.fromiter(map(len, words), np.int64, len(words)), len(NAMES)).astype(np.int64)
            tokens.clear()

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens.setdefault(k, Counter()).update(x.split())
                if len(tokens[k]) > TABLE:
                    settle()
        settle()
        tidy()
        for k, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([at.astype(np.int32).tobytes()]), pa.array([total[at].tobytes()])], names=["lang", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for k, at, n in zip(*(c.to_pylist() for c in b.columns)):
                sums.setdefault(k, np.zeros(size, np.int64))[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int64)
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([b""]), pa.array([total.tobytes()])], names=["lang", "at", "n"])

    kind = "lang string, at binary, n binary"
    own = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string"), text)
    return {x.lang: np.frombuffer(x.n, np.int64) for x in own.mapInArrow(count, kind).repartition("lang").mapInArrow(add, kind).collect()}


class Model:
    def __init__(self, counts: dict[str, np.ndarray], penalty: float = PENALTY):
        self.langs, self.penalty = sorted(counts), penalty
        n = np.array([counts[k][:BUCKETS] for k in self.langs], np.float64).reshape(-1, BUCKETS)
        self.log_p = np.log((n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * BUCKETS)).T.astype(np.float32)
        by_script = np.array([counts[k][BUCKETS:] for k in self.langs], np.float64).reshape(-1, len(NAMES))
        self.writes = (by_script >= 0.01 * np.maximum(by_script.sum(1, keepdims=True), 1)).T  # script, language
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.langs)), np.float32)
        self.table[0] = np.nan  # a token without letters

    def score(self, words: list[str]) -> np.ndarray:
        """Log posteriors (word, language) by the candidates that each word's script leaves."""
        bucket, word, kinds = grams(words)
        x = np.add.reduceat(self.log_p[bucket].astype(np.float64), np.searchsorted(word, np.arange(len(words)))) / 3
        can = self.writes[kinds]
        x = np.where(can | ~can.any(1, keepdims=True), x, -np.inf)
        x = x - x.max(1, keepdims=True)
        return np.maximum(x - np.log(np.exp(x).sum(1, keepdims=True)), -8.0)

    def scores(self, tokens: list[str]) -> np.ndarray:
        """A row of scores for each token that has letters; NaN for others."""
        at = np.fromiter(map(self.rows.get, tokens, repeat(-1)), np.int64, len(tokens))
        new = list({tokens[i] for i in np.flatnonzero(at < 0).tolist()})
        if not new:
            return self.table[at]
        if len(self.rows) + len(new) > TABLE:
            self.rows.clear()
            new = list(set(tokens))
        self.note(new)
        return self.table[np.fromiter(map(self.rows.__getitem__, tokens), np.int64, len(tokens))]

    def note(self, new: list[str]) -> None:
        at = len(self.rows) + 1
        if at + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((at + len(new), len(self.langs)), np.float32)])
        self.rows.update(zip(new, range(at, at + len(new))))
        words = [letters(t) for t in new]
        known = [i for i, w in enumerate(words) if w]
        self.table[at : at + len(new)] = np.nan
        for i in range(0, len(known), WORDS):
            some = known[i : i + WORDS]
            self.table[at + np.array(some)] = self.score([words[k] for k in some])


def viterbi(scores: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """The best path's language at each word; starts: the first word of each text.

    A text has a path of one language if no other's scores are ahead of the best one's by half the penalty over any run of words (then changes
    never pay). For the rest, the texts of like length step through their words together."""
    n, langs = scores.shape
    if not n or langs < 2:
        return np.zeros(n, np.int64)
    x = scores.astype(np.float64)
    sizes = np.diff(np.r_[starts, n])
    doc = np.repeat(np.arange(len(starts)), sizes)
    best = np.add.reduceat(x, starts).argmax(1)
    path = best[doc]
    own = x[np.arange(n), path]
    most = np.zeros(len(starts))
    far = doc * 1e7
    for s in range(langs):
        gain = x[:, s] - own
        c = np.cumsum(gain)
        low = np.minimum.accumulate(c - gain - far) + far
        most = np.maximum(most, np.maximum.reduceat(c - low, starts))
    hard = np.flatnonzero(most > penalty / 2)
    hard = hard[np.argsort(sizes[hard], kind="stable")]
    begin = 0
    while begin < len(hard):
        stop = begin + 1
        while stop < len(hard) and (stop + 1 - begin) * sizes[hard[stop]] * langs <= 4_000_000:
            stop += 1
        some = hard[begin:stop]
        _together(x, starts[some], sizes[some], penalty, path)
        begin = stop
    return path


def _together(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float, path: np.ndarray) -> None:
    most, (d, langs) = int(sizes[-1]), (len(starts), x.shape[1])
    first = np.searchsorted(sizes, np.arange(most), "right")  # texts from there on have a word at this step
    stays = np.ones((most, d, langs), bool)
    came = np.zeros((most, d), np.int16)
    v = x[starts].copy()
    for t in range(1, most):
        k = first[t]
        top = v[k:].argmax(1)
        change = v[k:][np.arange(d - k), top][:, None] - penalty
        stay = v[k:] >= change
        v[k:] = np.where(stay, v[k:], change) + x[starts[k:] + t]
        stays[t, k:], came[t, k:] = stay, top
    state = v.argmax(1)
    for t in range(most - 1, -1, -1):
        k = first[t]
        path[starts[k:] + t] = state[k:]
        if t:
            stay = stays[t, np.arange(k, d), state[k:]]
            state[k:] = np.where(stay, state[k:], came[t, k:])


def spans(model: Model, text: str) -> list[tuple[int, int, str]]:
    """(first word, one past the last, language) of a text's white-space separated words; words without letters join the span they stand in."""
    tokens = text.split()
    x = model.scores(tokens)
    at = np.flatnonzero(~np.isnan(x[:, 0])) if len(tokens) else np.zeros(0, np.int64)
    if not len(at):
        return []
    path = viterbi(x[at], np.zeros(1, np.int64), model.penalty)
    cut = [0, *(int(at[i]) for i in np.flatnonzero(np.diff(path)) + 1), len(tokens)]
    return [(a, b, model.langs[path[np.searchsorted(at, a)]]) for a, b in zip(cut, cut[1:])]


def _labelled(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[int]]:
    n, tokens = [], []
    for t in texts:
        own = t.split() if t else []
        n.append(len(own))
        tokens += own
    out, score, count = ["und"] * len(texts), [0.0] * len(texts), [0] * len(texts)
    if not model.langs or not tokens:
        return out, score, count
    x = model.scores(tokens)
    good = ~np.isnan(x[:, 0])
    doc = np.repeat(np.arange(len(n)), n)[good]
    if not len(doc):
        return out, score, count
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    path = viterbi(x[good], starts, model.penalty)
    k = len(model.langs)
    row = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(doc)]))
    votes = np.bincount(row * k + path, minlength=len(starts) * k).reshape(-1, k)
    changes = np.bincount(row[1:][(path[1:] != path[:-1]) & (row[1:] == row[:-1])], minlength=len(starts))
    for d, v, c in zip(doc[starts].tolist(), votes, changes.tolist()):
        out[d], score[d], count[d] = model.langs[int(v.argmax())], float(v.max() / v.sum()), c + 1
    return out, score, count


def _parts(texts: list[str | None], size: int = 4_000_000) -> Iterator[list[str | None]]:
    """Runs of about so many characters: texts that need it step through their words together, which pays for many at once."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t or "")
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def label(df: DataFrame, model: Model, text: str = "text", returned: list[str] | None = None) -> DataFrame:
    """df (or only its columns `returned`) with lang_pred, score (the share of words whose span has that language) and n_spans."""
    common.small_batches(df.sparkSession)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_spans", T.IntegerType())]
    own = common.others(df if returned is None else df.select(*returned), [f.name for f in fields])
    df = df.select(text, *(c for c in own if c != text))
    schema = T.StructType([df.schema[c] for c in own] + fields)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(text).to_pylist()
            found = [_labelled(m, part) for part in _parts(texts)]
            cols = [sum((f[k] for f in found), []) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.int32())))], names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    common.small_batches(spark)
    model = Model(learn(docs.where(~held_out()).select("lang", "text")))
    return label(docs.select("doc_id", held_out().alias("held_out"), "text"), model, returned=["doc_id", "held_out"])
