"""Secret scan: candidate strings from tokens and assignments, and a random forest that removes false positives.

The forest sees a candidate's length, transitions between kinds of characters, entropy, dictionary coverage, path and neighbouring words. It is
trained from labelled findings (`train`); by default from `labelled_findings`, a generator of keys and passwords in use, and of what
resembles them: long words, names, paths, checksums, identifiers, placeholders.

Defined cases: a null or empty text has no candidate; texts of any length are whole; a null path is an empty one; rows that repeat are
scanned alike; spans that begin alike are taken once, the assigned one first; an empty table gives an empty result; extra columns are left out of findings,
whatever their names, and pass through `redacted`."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHORTEST = 16
TOKEN = re.compile(rf"[A-Za-z0-9+/=_\-.]{{{SHORTEST},}}")
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth", "credential", "pwd")
ASSIGNED = re.compile(rf"(?i)(?:{'|'.join(NAMES)})[\"']?\s*[:=]\s*[\"']?([^\s\"'<>,;]{{6,}})")
KNOWN = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
NEAR = ("password", "passwd", "pwd", "secret", "token", "key", "api", "auth", "credential", "login", "access", "private")
HARMLESS = ("example", "sample", "dummy", "placeholder", "changeme", "test", "sha1", "sha256", "md5", "checksum", "commit", "digest", "hash", "uuid", "guid", "isbn", "integrity")
#: Words that dictionary coverage looks for; a parameter of features().
DICTIONARY = (
    "about access account address admin after again agent all also and any app apple area array auth back base been before best black blue body book both box bring build but buffer button byte cache call can case change char check child class clean client close cloud code color "
    "column come common config connect content context control copy core count create current data date day default delete demo design dev digest display document does down each edit element enable end entry error event every example export factory false field file filter find first float "
    "folder font for format from full function game get global good great green group handler hash have head help here home house http image import index info input install int into item java just key kind language large last left length level light line link list load local log long "
    "look main make manager map master message method mode model module more most name native net new next node not note null number object old one only open option order other out output over owner package page panel param parent part password path people place plain plugin point "
    "port post print private process project property public query read record red request reset response result return right root route run sample save schema scope script search secret section select send server service session set setting shell show simple size small some source "
    "stack start state static status stop store stream string style system table target task template test text that the their then this thread time title token tool tree true type under unit update upload url use user util value var version very view void water web where while "
    "white width window with word work world write year your"
).split()
FEATURES = ("length", "transitions", "digits", "upper", "lower", "symbols", "entropy", "coverage", "vowels", "hex", "runs", "slashes", "dots", "assigned", "known", "near_secret", "near_harmless", "path_harmless", "path_like", "own_harmless")
TREES, DEPTH, THRESHOLD = 40, 8, 0.5
VOWELS = frozenset("aeiouyAEIOUY")


def kind(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def coverage(text: str, dictionary: frozenset[str], longest: int) -> float:
    """Share of the characters that dictionary words of four letters or more cover, from the left, longest first."""
    low, i, n = text.lower(), 0, 0
    while i < len(low) - 3:
        for size in range(min(longest, len(low) - i), 3, -1):
            if low[i : i + size] in dictionary:
                n, i = n + size, i + size
                break
        else:
            i += 1
    return n / max(len(text), 1)


_WORDS = frozenset(w for w in DICTIONARY if len(w) > 3)


def features(value: str, before: str, after: str, path: str, assigned: bool, dictionary: frozenset[str] = _WORDS) -> list[float]:
    n = len(value)
    kinds = [kind(c) for c in value]
    counts = Counter(value)
    by = Counter(kinds)
    near, low, where = before.lower(), value.lower(), path.lower()
    letters = by[0] + by[1]
    return [
        float(n), sum(a != b for a, b in zip(kinds, kinds[1:])) / max(n - 1, 1), by[2] / n, by[1] / n, by[0] / n, by[3] / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()), coverage(value, dictionary, max(map(len, dictionary), default=0)), sum(c in VOWELS for c in value) / max(letters, 1),
        float(all(c in "0123456789abcdef" for c in low)), max(counts.values()) / n, float(value.count("/")), float(value.count(".")), float(assigned), float(bool(KNOWN.match(value))),
        float(any(w in near for w in NEAR)), float(any(w in near or w in after.lower() for w in HARMLESS)), float(any(w in where for w in HARMLESS)), float("/" in value and "." in value.rpartition("/")[2]), float(any(w in low for w in HARMLESS)),
    ]


def candidates(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, assigned) of the strings to judge, in order; a string in an assignment counts once."""
    found: dict[int, tuple[int, int, bool]] = {}
    low = text.lower()
    if any(w in low for w in NAMES):
        for m in ASSIGNED.finditer(text):
            found[m.start(1)] = (m.start(1), m.end(1), True)
    values, upto, at = [found[k] for k in sorted(found)], 0, 0
    for token in (w for w in text.split() if len(w) >= SHORTEST):
        at = text.index(token, at)
        for m in TOKEN.finditer(token):
            a, b = at + m.start(), at + m.end()
            while b > a and text[b - 1] in ".-":
                b -= 1
            while upto < len(values) and values[upto][1] <= a:
                upto += 1
            if b - a >= SHORTEST and not (upto < len(values) and values[upto][0] < b):
                found[a] = (a, b, False)
        at += len(token)
    return [found[k] for k in sorted(found)]


def described(text: str, start: int, end: int, assigned: bool, path: str, dictionary: frozenset[str] = _WORDS) -> list[float]:
    return features(text[start:end], text[max(0, start - 40) : start], text[end : end + 30], path, assigned, dictionary)


def labelled_findings(n: int = 4000, seed: int = 7) -> list[tuple[str, int, int, bool, str, int]]:
    """(text, start, end, assigned, path, label) of made-up findings, half of them secrets."""
    r = random.Random(seed)
    pick = lambda alphabet, a, b: "".join(r.choice(alphabet) for _ in range(r.randint(a, b)))
    lower, hexes, all_ = string.ascii_lowercase, "0123456789abcdef", string.ascii_letters + string.digits
    syllable = lambda: r.choice(lower) + r.choice("aeiou") + r.choice(["", "n", "r", "s", "nd", "th", "tion", "ment"])
    word = lambda a=2, b=4: "".join(syllable() for _ in range(r.randint(a, b)))
    long_word = lambda: "".join(syllable() for _ in range(12))[: r.randint(16, 40)]
    names = list(NAMES) + ["db_password", "client_secret", "access_token"]
    real = [
        lambda: "AKIA" + pick(string.ascii_uppercase + "234567", 16, 16), lambda: "ghp_" + pick(all_, 36, 36), lambda: pick(hexes, 16, 48), lambda: pick(all_ + "+/", 24, 64),
        lambda: pick(all_ + "_-", 20, 44), lambda: "eyJ" + pick(all_, 18, 24) + "." + pick(all_ + "_-", 30, 60), lambda: pick(all_ + "!@#$%^&*", 10, 20),
    ]
    false = [
        long_word, lambda: long_word().capitalize(), lambda: long_word().upper(), lambda: "_".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 5))) + "_value", lambda: "/".join(word() for _ in range(4)) + r.choice([".py", ".html", ".json"]),
        lambda: "".join(r.choice(DICTIONARY).capitalize() for _ in range(4)) + "Handler", lambda: "-".join(pick(hexes, k, k) for k in (8, 4, 4, 4, 12)), lambda: pick(hexes, 40, 40), lambda: r.choice("-=_.*") * r.randint(16, 60),
        lambda: "your_" + r.choice(DICTIONARY) + "_goes_here", lambda: r.choice(["www.", ""]) + word() + "." + word() + ".example.com", lambda: pick("0123456789", 16, 20), lambda: word() + "-" + word() + "-" + word() + "-" + word(),
    ]
    out = []
    for i in range(n):
        filler = " ".join(word(1, 3) for _ in range(r.randint(0, 6)))
        k = r.randrange(len(real if i % 2 else false))
        value = (real if i % 2 else false)[k]()
        assigned = False
        if i % 2:
            assigned = k in (2, 6) or r.random() < 0.6
            lead = f"{r.choice(names)}{r.choice(['=', ': ', ' = ', chr(61) + chr(34), ' = ' + chr(34)])}" if assigned else r.choice(["", "key ", "aws ", "use "])
        elif k in (6, 7):
            lead = r.choice(["commit ", "sha1 ", "uuid ", "checksum ", "digest "])
        elif k in (0, 3, 9) and r.random() < 0.3:
            assigned, lead = True, f"{r.choice(names)}={''}"
        else:
            lead = r.choice(["", "", "see ", "in ", "the "])
        head = f"{filler} {lead}"
        path = r.choice(["", "src/main.py", "config/prod.env", "web/page"]) if i % 2 else r.choice(["", "tests/sample.py", "docs/example.md", "src/main.py", "web/page"])
        out.append((f"{head}{value} {word()}", len(head), len(head) + len(value), assigned, path, i % 2))
    return out


FINDING = "text string, start int, end int, assigned boolean, path string, label int"
#: Labelled findings that a forest is fitted on, at most about so many.
MOST_FINDINGS = 200_000


def corpus_dictionary(docs: DataFrame, least: int = 20, most: int = 20_000) -> list[str]:
    """Words of four to twelve ASCII letters that at least so many documents hold, the most frequent ones (a bounded list, for features)."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z0-9])([a-z]{4,12})(?![a-z0-9])"), 1))).alias("w"))
    return [x.w for x in words.groupBy("w").count().where(F.col("count") >= least).orderBy(F.desc("count"), "w").limit(most).collect()]


def train(spark: SparkSession, findings: DataFrame | None = None, trees: int = TREES, depth: int = DEPTH, dictionary=DICTIONARY, most: int = MOST_FINDINGS):
    """A random forest from labelled findings (FINDING; a null text or path is an empty one), a sample of about `most` where there are more. The scan must be given
    the same dictionary."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    if findings is None:
        findings = spark.createDataFrame(labelled_findings(), FINDING)
    part = min(1.0, most / max(findings.count(), 1))
    known = frozenset(w.lower() for w in dictionary if len(w) > 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            yield pa.RecordBatch.from_arrays([pa.array([described(t or "", a, e, s, w or "", known) for t, a, e, s, w, _ in rows], pa.list_(pa.float64())), pa.array([float(x[5]) for x in rows], pa.float64())], names=["x", "label"])

    few = findings.where(F.rand(5) < part) if part < 1 else findings
    data = few.select("text", "start", "end", "assigned", "path", "label").where("end > start").mapInArrow(run, "x array<double>, label double").withColumn("features", array_to_vector("x"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, subsamplingRate=0.7, seed=5).fit(data)


def scan(docs: DataFrame, model=None, path: str | None = None, threshold: float = THRESHOLD, dictionary=DICTIONARY) -> DataFrame:
    """Findings: doc_id, start, end (code points), assigned, sha256 of the string, p_secret, is_secret. path: a column with the text's path."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    spark = docs.sparkSession
    common.small_batches(spark)
    model = model or train(spark, dictionary=dictionary)
    known = frozenset(w.lower() for w in dictionary if len(w) > 3)
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, (text, p) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for start, end, assigned in candidates(text or ""):
                    at.append(i)
                    rows.append((start, end, assigned, hashlib.sha256(text[start:end].encode("utf-8", "surrogatepass")).hexdigest(), described(text, start, end, assigned, p, known)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", "start", "end", "assigned", "sha256", "x"])

    found = docs.select("doc_id", "text", where.alias("path")).mapInArrow(run, f"doc_id {id_kind}, start long, end long, assigned boolean, sha256 string, x array<double>")
    judged = model.transform(found.withColumn("features", array_to_vector("x")))
    p = F.get(vector_to_array("probability"), F.lit(1))
    return judged.select("doc_id", "start", "end", "assigned", "sha256", p.alias("p_secret"), (p >= threshold).alias("is_secret"))


def redacted(docs: DataFrame, findings: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with the spans of confirmed secrets replaced. A document's spans meet in one row; documents without any pass unchanged."""
    spans = findings.where("is_secret").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans")).withColumnRenamed("doc_id", "_id")
    i, at = common.free_names(docs, "_id", "_spans")
    joined = docs.join(spans.withColumnsRenamed({"_id": i, "_spans": at}), common.same(F.col("doc_id"), F.col(i)), "left")
    where = F.col(at)
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(where, lambda s: s["end"]))
    starts = F.concat(F.transform(where, lambda s: s["start"]), F.array(F.length("text").cast("long")))
    parts = F.zip_with(ends, starts, lambda a, b: F.substring(F.col("text"), a.cast("int") + 1, (b - a).cast("int")))
    return joined.withColumn("text", F.when(where.isNull(), F.col("text")).otherwise(F.array_join(parts, mark))).select(*docs.columns)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"), path="source")
