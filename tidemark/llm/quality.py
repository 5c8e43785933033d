"""Quality rules on whole texts: base counts and suffix-array repetition.

The words of each text are numbered and sorted into a suffix array by prefix doubling; the longest common prefixes of neighbours give the
intervals whose prefix is a repeated run of words. A suffix's deepest interval is its longest repeat, and these runs are the occurrences of
the maximal repeated runs. Their spans are united: a text is rejected if runs of at least `min_run` words cover more than `most_covered` of
its words, or if the longest repeat has more than `longest` words. Many texts share one array, with keys that keep texts apart.

Defined cases: a null or empty text has no words, so the base rule rejects it; texts of any length are whole (a long one has an array of its
own); bounds are met by what equals them; rows that repeat are judged alike; an empty table gives an empty result; extra columns pass through, ones named like a
result (in any case) are replaced."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common
from .common import tidy

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
BASE_RUN = 8
#: Rule of the method.
MIN_RUN, MOST_COVERED, LONGEST = 4, 0.35, 200
#: Words that share a suffix array; more only where one text has more.
TOGETHER = 150_000


def longest_repeats(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position, the words of the longest run from there that occurs again in the same doc (overlaps count). doc is sorted."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    left = np.searchsorted(doc, doc, "right") - np.arange(n)  # words to the end of the doc
    key = doc * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    rank, open_ = _ranks(key[order], order, np.zeros(n, np.int64), np.empty(n, np.int64))
    levels, opens, step = [rank], [open_], 1
    while len(open_):
        old = levels[-1]
        ahead = np.where(left[open_] > step, old[np.minimum(open_ + step, n - 1)] + 1, 0)
        key = old[open_] * (n + 1) + ahead
        by = np.argsort(key, kind="stable")
        order = open_[by]
        rank, open_ = _ranks(key[by], order, old[order], old.copy())
        levels.append(rank)
        opens.append(open_)
        step *= 2
    final = levels[-1]
    array = np.empty(n, np.int64)
    array[final] = np.arange(n)
    lcp = np.zeros(n, np.int64)  # of a place in the array and the next
    pairs = np.zeros(0, np.int64)
    for j in range(len(levels) - 1, -1, -1):
        rank, size = levels[j], 1 << j
        new = final[opens[j]]
        new = new[new < n - 1]
        new = new[rank[array[new]] == rank[array[new + 1]]]
        fresh = new[lcp[new] == 0]
        if len(pairs):
            a, b = array[pairs] + lcp[pairs], array[pairs + 1] + lcp[pairs]
            inside = (lcp[pairs] < left[array[pairs]]) & (lcp[pairs] < left[array[pairs + 1]])
            ok = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            lcp[pairs[ok]] += size
        lcp[fresh] = size
        pairs = np.concatenate([pairs, fresh])
    best = lcp.copy()
    best[1:] = np.maximum(best[1:], lcp[:-1])
    return best[final]


def _ranks(key: np.ndarray, order: np.ndarray, base: np.ndarray, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of sorted keys: a group's rank is the place at which it starts, counted from base within its older group; and the positions that share theirs."""
    n = len(key)
    at = np.arange(n)
    first = np.r_[True, key[1:] != key[:-1]]
    older = np.r_[True, base[1:] != base[:-1]]
    start = np.maximum.accumulate(np.where(first, at, 0))
    start_older = np.maximum.accumulate(np.where(older, at, 0))
    into[order] = base + start - start_older
    alone = first & np.r_[first[1:], True]
    return into, order[~alone]


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Positions in the union of the repeated runs of at least so many words."""
    starts = np.flatnonzero(longest >= least)
    change = np.zeros(len(longest) + 1, np.int64)
    change[starts] += 1
    change -= np.bincount(starts + longest[starts], minlength=len(change))
    return np.cumsum(change[:-1]) > 0


def spans(text: str | None, least: int = MIN_RUN) -> list[tuple[int, int]]:
    """The united spans (first word, one past the last) of a text's repeated runs."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    on = np.r_[False, covered(longest_repeats(ids, np.zeros(len(ids), np.int64)), least), False].astype(np.int8)
    edge = np.flatnonzero(np.diff(on))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def duplicate_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    seen: set[str] = set()
    again = [x for x in lines if x in seen or seen.add(x)]
    return sum(1 for x in again if x.strip(SPACE))


def judged(texts: list[str | None], least: int) -> dict[str, np.ndarray]:
    """Base counts, covered words and longest repeat of each text."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    words, chars, symbols, lines = [], [], [], []
    ids: list[int] = []
    for t in texts:
        t = t or ""
        own = t.encode("utf-8", "surrogatepass").split()
        words.append(len(own))
        ids.extend(map(number.__getitem__, own))
        chars.append(len(t) - sum(map(t.count, SPACE)))
        symbols.append(sum(map(t.count, SYMBOLS)))
        lines.append(duplicate_lines(t))
    n = np.array(words, np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    best = longest_repeats(np.array(ids, np.int64), doc)
    per = lambda x: np.bincount(doc[x], minlength=len(n)).astype(np.int64)
    most = np.zeros(len(n), np.int64)
    full = np.flatnonzero(n)
    if len(full):
        most[full] = np.maximum.reduceat(best, (np.cumsum(n) - n)[full])
    return {"n_words": n, "word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64), "n_dup_lines": np.array(lines, np.int64), "n_repeat_words": per(covered(best, BASE_RUN)), "n_covered": per(covered(best, least)), "longest_repeat": most}


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def judge(df: DataFrame, min_run: int = MIN_RUN, most_covered: float = MOST_COVERED, longest: int = LONGEST, text: str = "text", together: int = TOGETHER, returned: list[str] | None = None) -> DataFrame:
    """df (or only its columns `returned`: what is left out is not sent back from Python) with the counts, base_failed and kept."""
    common.small_batches(df.sparkSession, size="8m")
    own = common.others(df if returned is None else df.select(*returned), (*FIELDS, "base_failed", "kept"))
    df = df.select(text, *(c for c in own if c != text))
    schema = T.StructType([df.schema[c] for c in own] + [T.StructField(f, T.LongType()) for f in FIELDS] + [T.StructField(f, T.BooleanType()) for f in ("base_failed", "kept")])

    def parts(texts: list[str | None]) -> Iterator[list[str | None]]:
        part, size = [], 0
        for t in texts:
            size += len(t or "") // 6
            part.append(t)
            if size >= together:
                yield part
                part, size = [], 0
        if part:
            yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judged(p, min_run) for p in parts(b.column(text).to_pylist())]
            x = {f: np.concatenate([p[f] for p in found]) if found else np.zeros(0, np.int64) for f in FIELDS}
            failed = (x["n_words"] < 20) | (100 * x["n_repeat_words"] > 30 * x["n_words"])
            kept = ~failed & (x["n_covered"] <= most_covered * x["n_words"]) & (x["longest_repeat"] <= longest)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *(pa.array(x[f]) for f in FIELDS), pa.array(failed), pa.array(kept)], names=[f.name for f in schema])
        tidy()

    return df.mapInArrow(run, schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"), returned=["doc_id"]).drop("longest_repeat")


def _united(run: int) -> str:
    """SQL: words of each document (k) that a repeated window of so many words covers."""
    return f"""(SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(p, p + {run})) AS p FROM
      (SELECT k, p, count(*) OVER (PARTITION BY k, w[p:p + {run - 1}]) AS c FROM s WHERE p + {run - 1} <= n_words) z WHERE c > 1) y GROUP BY k)"""


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT *, len(w) AS n_words FROM d), s AS (SELECT k, w, n_words, unnest(range(1, n_words + 1)) AS p FROM n),
e AS (SELECT k, count(*) FILTER (c > 1 AND regexp_matches(x, '[^\x20\x09-\x0D]')) AS n FROM
  (SELECT k, x, row_number() OVER (PARTITION BY k, x) AS c FROM (SELECT k, unnest(string_split(t, chr(10))) AS x FROM d) z) y GROUP BY k),
b AS {_united(BASE_RUN)}, c AS {_united(MIN_RUN)},
l AS (SELECT DISTINCT k FROM (SELECT k, count(*) OVER (PARTITION BY k, array_to_string(w[p:p + {LONGEST}], ' ')) AS c FROM
  (SELECT k, w, p, n_words, count(*) OVER (PARTITION BY k, w[p:p + 7]) AS c FROM s WHERE p + 7 <= n_words) z WHERE c > 1 AND p + {LONGEST} <= n_words) y WHERE c > 1),
r AS (SELECT doc_id, n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(e.n, 0) AS n_dup_lines, coalesce(b.n, 0) AS n_repeat_words, coalesce(c.n, 0) AS n_covered, l.k IS NOT NULL AS long_repeat
  FROM n LEFT JOIN e USING (k) LEFT JOIN b USING (k) LEFT JOIN c USING (k) LEFT JOIN l USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_covered <= {MOST_COVERED} * n_words AND NOT long_repeat AS kept FROM r
"""
