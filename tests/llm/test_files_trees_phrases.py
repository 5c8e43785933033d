"""Token files, Merkle manifests, phrase collocations."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.orc as orc
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations, merkle, token_files

from .helpers import SCHEMA, WORDS, awkward, empty, folder, prose

ODD = "Été NAÏVE é J̌ it's can't!! <|endoftext|> <|ENDOFTEXT|> 日本語 a b c　d x\x1cy \x01 1234 a.b ., ,a İstanbul ß× ... \u0000 ﬁ don't.Stop,now;"


# token files


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.default_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_encoder_equals_the_library():
    said = open(token_files.default_tokenizer(), encoding="utf-8").read()
    r = random.Random(4)
    texts = [ODD, "", " \n ", prose(400, 2), "x" * 3000 + " " + "y" * 70] + ["".join(r.choice(ODD + "  \n\tABCdefé.,") for _ in range(300)) for _ in range(60)]
    for table in (400_000, 40):  # emptied again and again
        e = token_files.Encoder(said, table=table)
        assert e.apart and e.plain
        for _ in range(2):
            assert [np.frombuffer(x, "<i4").tolist() for x in e.encode([t.encode() for t in texts])] == plain_ids(texts)
    assert all(len(k) <= token_files.LONGEST for k in (*e.chunks, *e.pieces))
    whole = token_files.Encoder(open(token_files.default_tokenizer().replace("word_bpe_49k", "byte_bpe_50k"), encoding="utf-8").read())
    assert not whole.apart
    assert whole.encode([b"one two  three"])[0] == np.array(whole.tokenizer.encode("one two  three").ids, "<i4").tobytes()


class Looked(dict):
    """A table that is looked up and never walked."""

    def keys(self):
        raise AssertionError("walked")

    __iter__ = keys


def test_encoder_looks_chunks_up_and_does_not_walk_its_tables():
    e = token_files.Encoder(open(token_files.default_tokenizer(), encoding="utf-8").read())
    e.chunks, e.pieces = Looked(), Looked()
    texts = [f"\n {prose(50, 3)}  ", "", "\t\x0b\x0c ", ODD, "x", prose(50, 3)]
    for _ in range(2):
        assert [np.frombuffer(x, "<i4").tolist() for x in e.encode([t.encode() for t in texts])] == plain_ids(texts)


def test_token_files_read_back(spark, tmp_path):
    docs = awkward(spark).withColumn("ids", F.lit("x")).withColumn("at", F.lit("y"))
    token_files.write(docs, f"{tmp_path}/t", partitions=3)
    rows = token_files.read(spark, f"{tmp_path}/t").collect()
    given = [(x.doc_id, x.text) for x in docs.collect()]
    assert sorted((x.doc_id is None, x.doc_id, x.ids) for x in rows) == sorted((i is None, i, ids + [1]) for (i, _), ids in zip(given, plain_ids([t for _, t in given])))
    at = 0
    for x in sorted(rows, key=lambda x: x.start):
        assert x.start == at and x.n_tokens == len(x.ids)
        at += x.n_tokens
    order = [x.doc_id for x in sorted(rows, key=lambda x: x.start)]
    assert order[-1] is None and order[:-1] == sorted(order[:-1])
    got = {(x.doc_id, x.start): x.ids_crc32 for x in token_files.checksums(token_files.read(spark, f"{tmp_path}/t")).collect()}
    assert got == {(x.doc_id, x.start): zlib.crc32(np.array(x.ids, "<u4").tobytes()) for x in rows}


def test_token_files_of_nothing(spark, tmp_path):
    token_files.write(empty(spark), f"{tmp_path}/t")
    assert token_files.read(spark, f"{tmp_path}/t").count() == 0
    assert token_files.checksums(token_files.read(spark, f"{tmp_path}/t")).count() == 0


def test_stripes_are_read_apart_and_pruned(spark, tmp_path):
    """Several stripes to a file; splits share them; a search reads a few row groups of the 12 000 rows, and by Bloom filter none for an id between others."""
    docs = spark.range(12_000).select((F.col("id") * 2).alias("doc_id"), F.concat_ws(" ", *(F.element_at(F.array(*map(F.lit, WORDS)), (F.hash("id", F.lit(k)) % len(WORDS)).cast("int") + F.when(F.hash("id", F.lit(k)) % len(WORDS) <= 0, len(WORDS)).otherwise(0)) for k in range(30))).alias("text"))
    path = f"{tmp_path}/t"
    token_files.write(docs, path, stripe=1 << 14, partitions=2)
    files = [orc.ORCFile(f) for f in map(str, (tmp_path / "t").glob("*.orc"))]
    assert len(files) == 2 and all(f.nstripes > 1 and f.row_index_stride == 1000 for f in files)

    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        all_rows = token_files.read(spark, path)
        assert all_rows.rdd.getNumPartitions() > 2 and all_rows.select("doc_id").distinct().count() == all_rows.count() == 12_000

        def read_rows(ids):
            df = token_files.lookup(spark, path, ids)
            found = df.count()
            plan = df.select("doc_id")._jdf.queryExecution()
            assert "PushedFilters" in plan.toString()
            df = token_files.lookup(spark, path, ids).select("doc_id", "start")
            df._jdf.queryExecution().executedPlan().execute().count()
            leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
            scans = [leaves.apply(i) for i in range(leaves.size())]
            return found, sum(s.metrics().apply("numOutputRows").value() for s in scans if "orc" in s.toString().lower())

        found, touched = read_rows([4_000, 16_002])
        assert found == 2 and touched <= 2_000
        found, touched = read_rows([4_001])
        assert found == 0 and touched == 0
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


# Merkle manifests


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_leaf(*fields):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def brute_tree(nodes):
    """Root and, for each leaf, its path as (left, right) texts."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            paths[i].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
        nodes = [h("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
        at = [k // 16 for k in at]
    return nodes[0], paths


def brute_manifest(rows):
    by = {}
    for x in rows:
        by.setdefault(x["source"], []).append((x["doc_id"], brute_leaf(x["doc_id"], x["source"], x["lang"], x["n_chars"], x["text"])))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = brute_tree([x[1] for x in by[s]])
    root, upper = brute_tree([trees[s][0] for s in order])
    return sorted(((i is None, i or 0, leaf, trees[s][0], root, tuple(p + u)) for s, u in zip(order, upper) for (i, leaf), p in zip(by[s], trees[s][1])))


def manifest_rows(docs):
    return sorted((x.doc_id is None, x.doc_id or 0, x.leaf, x.subroot, x.root, tuple((s.left, s.right) for s in x.path)) for x in merkle.manifest(docs).collect())


def test_manifest_equals_brute_force(spark):
    sizes = {"big": 700, "aa": 257, "b": 256, "c": 17, "d": 16, "e": 1, "é": 2, None: 3} | {f"s{i}": 1 for i in range(20)}
    rows = [(s, k) for s, n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame([(7 * i % 2003, f"Text {i} Ä" if i % 9 else None, "en" if i % 5 else None, s, i if i % 4 else None) for i, (s, _) in enumerate(rows)], SCHEMA)
    assert manifest_rows(docs) == brute_manifest(docs.collect())


def test_manifest_awkward_rows(spark):
    docs = awkward(spark)
    clash = docs.select("*", *(F.lit("own").alias(c) for c in ("tree", "place", "digest", "Path", "n", "block", "one")))
    assert manifest_rows(docs) == brute_manifest(docs.collect())
    out = merkle.manifest(clash)
    assert {x.tree for x in out.collect()} == {x.digest for x in out.collect()} == {"own"} and out.count() == 12 and out.columns.count("path") == 1
    assert merkle.manifest(empty(spark)).count() == 0
    lone = docs.where("doc_id = 10")
    (x,) = merkle.manifest(lone).collect()
    assert x.path == [] and x.leaf == x.subroot == x.root


def test_tampering_shows(spark, tmp_path):
    docs = spark.createDataFrame([(i, "Upper Case" if i % 2 else "lower case", "en", f"s{i % 3}", 10) for i in range(300)], SCHEMA)
    rows = merkle.op12_merkle_manifest(spark, folder(docs, tmp_path)).collect()
    assert len(rows) == 300
    for x in rows:
        assert x.verified == (x.folded_root == x.root) == (not (zlib.crc32(str(x.doc_id).encode()) % 5 == 0 and x.doc_id % 2))
    paths = {x.doc_id: x.path for x in merkle.manifest(docs).collect()}
    assert all(x.proof_sha256 == h("".join(s.left + s.right for s in paths[x.doc_id])) for x in rows)


# collocations


def brute_phrases(rows, least, top):
    import re

    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    frequent = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {(p[0], *p[i : i + m]) for p, a in frequent.items() for m in range(2, len(p) - 1) for i in range(1, len(p) - m + 1) if 100 * a >= 80 * f[(p[0], *p[i : i + m])]}
    out = []
    for p, a in frequent.items():
        if p not in gone:
            lang, w = p[0], p[1:]
            score, _, l, r = min((2_000_000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, l, r, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        of = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, k, *x[1:]) for k, x in enumerate(of, 1)]
    return sorted(ranked)


def phrase_rows(n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [r.choice(WORDS[:9]) if r.random() < 0.7 else r.choice(["new york City,", "once upon a time", "Hot", "dog.", "été là", f"rare{r.randrange(500)}"]) for _ in range(30)]
        rows.append((r.choice(["en", "en", "fr", None, "und"]), r.choice([" ", "\t", "  "]).join(words)))
    return rows + [("en", "the the the the the the " * 50), ("fr", None), ("de", ""), (None, " . ")]


@pytest.mark.parametrize("least,top", [(30, 2000), (3, 25), (1, 10_000)])
def test_phrases_equal_brute_force(spark, least, top):
    rows = phrase_rows(60 if least == 1 else 400)
    docs = spark.createDataFrame([(i, t, l, "w1", "f") for i, (l, t) in enumerate(rows)], "doc_id long, text string, lang string, w1 string, f string").repartition(5)
    got = sorted(map(tuple, collocations.collocations(docs, least=least, top=top).collect()))
    assert got == brute_phrases(rows, least, top) and got


def test_prefixes_are_counted_across_partitions(spark):
    """The stack over any cut of the sorted suffixes, hot words included, gives all counts."""
    r = random.Random(8)
    rows = []
    for _ in range(4000):
        w = [1 if r.random() < 0.6 else r.randrange(-3, 4) or 5 for _ in range(r.choice([2, 3, 4, 4, 4]))]
        rows.append((r.choice(["en", "fr"]), *(w + [0] * (4 - len(w))), r.randrange(1, 3)))
    want = Counter()
    for lang, *w, n in rows:
        for k in range(2, 5):
            if w[k - 1]:
                want[(lang, *w[:k], *[0] * (4 - k))] += n
    df = spark.createDataFrame(rows, "lang string, w1 long, w2 long, w3 long, w4 long, n long")
    for least in (1, 7, 200):
        got = {tuple(x)[:5]: x.f for x in collocations.counted(df, least).collect()}
        assert got == {k: v for k, v in want.items() if v >= least}


def test_phrases_of_nothing(spark):
    assert collocations.collocations(empty(spark)).count() == 0


def test_words_that_share_a_hash_change_the_seed(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b a b", "en")], "doc_id long, text string, lang string")
    real = collocations.word_table
    monkeypatch.setattr(collocations, "word_table", lambda docs, seed=0: real(docs, seed).withColumn("h", F.lit(5).cast("long")) if seed < 2 else real(docs, seed))
    words, seed = collocations.words_of(docs)
    assert seed == 2 and {(x.word, x.f) for x in words.collect()} == {("a", 2), ("b", 2)}
