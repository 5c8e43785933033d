"""Token ids in ORC files, in ascending order of doc_id.

A file's rows are (doc_id, at, n_tokens, ids): `ids` with the end id, `at` the ids before the row in its file. ORC keeps integers run-length encoded
in stripes, with a row index and a Bloom filter on doc_id, so that a split reads its own stripes and a search for documents skips stripes and
row groups by their statistics. A small table beside the files (`_index`: a row per file) holds how many ids stand before each file; `start` is the sum of
both, so ids are written once, whatever the number of files.

Each distinct chunk between ASCII white space is encoded once for a worker's table, as `apart` allows where a tokenizer drops white space and its normaliser
looks no farther than that; for others whole texts are encoded.

Defined cases: a null text is encoded as the empty one (the end id only); null doc_ids come last; rows that share a doc_id are ordered by a hash of their
texts, repeated rows stand beside each other; an empty table gives files without rows; texts of any length are whole; extra columns are left out."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import tidy

#: Chunks kept in a worker's table, and the bytes of the longest one kept; what does not fit is encoded anew each time.
TABLE, LONGEST = 400_000, 64
#: Stands between chunks that are encoded together.
STOP = "\x01"
#: Bytes of a stripe, rows to an entry of the row index, share of false positives of the Bloom filter.
STRIPE, STRIDE, FALSE_POSITIVES = 64 << 20, 1_000, 0.01
END = 1
INDEX = "_index"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def apart(said: dict) -> bool:
    """Whether chunks between white space can be encoded one by one: all normalisers look at neighbouring marks only, white space is dropped
    before the merges, and no added token holds or takes white space."""
    steps = lambda x, key: [] if not x else x[key] if x["type"] == "Sequence" else [x]
    local = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in steps(said.get("normalizer"), "normalizers"))
    cuts = steps(said.get("pre_tokenizer"), "pretokenizers")
    dropped = bool(cuts) and cuts[0]["type"] == "Split" and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and all(x and " " not in x for x in cuts[0]["pattern"].get("Regex", " ").split("|"))
    dropped = dropped and all(c["type"] == "ByteLevel" and not c["add_prefix_space"] and not c["use_regex"] for c in cuts[1:])
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not set(t["content"]) & set(" \t\n\v\f\r") for t in said.get("added_tokens", []))
    return local and dropped and plain and not said.get("post_processor")


def letters_alone(said: dict) -> bool:
    """Whether letters are lower-cased, and never in a piece with punctuation but for an apostrophe."""
    cuts = json.dumps(said.get("pre_tokenizer"))
    pattern = said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].split("|") if '"pretokenizers"' in cuts else []
    rest = [x for x in pattern if x not in (r"[\p{L}]+", r"[^\s\p{L}\p{N}]+")]
    return len(pattern) == len(rest) + 2 and all(x.startswith("'") or x == r"[\p{N}]" for x in rest) and '"Lowercase"' in json.dumps(said.get("normalizer"))


#: A tokenizer's step that turns bytes into marks, those marks, and the one letter of PLAIN whose small form is more than a letter.
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_own = [*range(33, 127), *range(161, 173), *range(174, 256)]
MARKS = dict(zip([b for b in range(33, 256) if b not in _own], map(chr, range(256 + 33, 512)))) | {b: chr(b) for b in _own}
DOTTED = "İ".encode()


def bare(tokenizer: str) -> str:
    """The tokenizer's own merges over words that are small letters already, bytes written as marks."""
    return json.dumps(json.loads(tokenizer) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []})


#: A chunk of Latin letters, with punctuation after it or none.
PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf])+)([.,;:!?]*)")


class Encoder:
    """Ids of whole texts (given and returned as bytes: UTF-8, and little-endian 32-bit ids). Chunks that differ in capitals and in punctuation
    after them share the ids of their letters."""

    def __init__(self, tokenizer: str, table: int = TABLE, longest: int = LONGEST):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        said = json.loads(tokenizer)
        self.apart = apart(said)
        self.plain = self.apart and letters_alone(said)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.chunks: dict[bytes, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.size, self.longest = table, longest
        stop = self.tokenizer.encode(STOP, add_special_tokens=False).ids
        self.stop = stop[0] if len(stop) == 1 else None
        mark, vocabulary = said["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool) if self.plain and mark else None
        if self.last is not None:
            self.last[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True
        self.bare = Tokenizer.from_str(bare(tokenizer)) if self.last is not None and said["pre_tokenizer"]["pretokenizers"][1:] == [BYTES] else None

    def ids(self, texts: list[bytes]) -> list[bytes]:
        found = self.batch([t.decode("utf-8") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<i4").tobytes() for e in found]

    def together(self, pieces: list[bytes], most: int = 500) -> list[bytes]:
        """Ids of many pieces, some hundred to a text: the stop character alone stands after each, and no other piece has that character's id."""
        if self.stop is None or any(STOP.encode() in k for k in pieces):
            return self.ids(pieces)
        found = self.parted(pieces, f" {STOP} ", most)
        ends = np.flatnonzero(found == self.stop)
        return self.cut(found, ends, ends + 1) if len(ends) == len(pieces) else self.ids(pieces)

    def words(self, words: list[bytes], most: int = 1000) -> list[bytes]:
        """Ids of many words of letters alone: a word's last token says that it is one."""
        if self.last is None:
            return self.together(words)
        joined = b" ".join(words)
        if self.bare and DOTTED not in joined:
            small = joined.decode("utf-8").lower().encode("utf-8").decode("latin-1").translate(MARKS).split(" ")
            found = self.numbers(self.bare, [" ".join(small[i : i + most]) for i in range(0, len(small), most)])
        else:
            found = self.parted(words, " ", most)
        ends = np.flatnonzero(self.last[found]) + 1
        return self.cut(found, ends, ends) if len(ends) == len(words) else self.together(words)

    def parted(self, pieces: list[bytes], between: str, most: int) -> np.ndarray:
        texts = [between.join([k.decode("utf-8") for k in pieces[i : i + most]]) + between for i in range(0, len(pieces), most)]
        return self.numbers(self.tokenizer, texts)

    @staticmethod
    def numbers(tokenizer, texts: list[str]) -> np.ndarray:
        batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        return np.concatenate([np.empty(0, "<i4"), *(np.array(e.ids, "<i4") for e in batch(texts, add_special_tokens=False))]).astype("<i4")

    @staticmethod
    def cut(ids: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Bytes of the runs that end at ends, each next one from starts."""
        said = ids.tobytes()
        return [said[i:j] for i, j in zip([0, *(4 * starts[:-1]).tolist()], (4 * ends).tolist())]

    def learn(self, table: dict[bytes, bytes], wanted: list[bytes], ids) -> list[bytes]:
        """Ids of what is wanted (each once), each looked up once; what a table does not hold is encoded, and kept while the table has room for it, as what came first
        is what comes often, and but for long keys. A table that knows less than half of what is wanted is of other texts and is emptied."""
        found = [*map(table.get, wanted)]
        new = [k for k, x in zip(wanted, found) if x is None]
        full = len(table) + len(new) > self.size
        if full and 2 * len(new) > len(wanted):
            table.clear()
            full = len(new) > self.size
        made = ids(new)
        if not full:
            table.update((k, x) for k, x in zip(new, made) if len(k) <= self.longest)
        rest = iter(made)
        return [next(rest) if x is None else x for x in found]

    def split(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks by those of their pieces; white space at an end of a text leaves an empty chunk, of no ids."""
        if not self.plain:
            return [x if k else b"" for k, x in zip(chunks, self.together(chunks))]
        found = [*map(PLAIN.fullmatch, chunks)]
        words = [m[1].lower() if m else b"" for m in found]
        odd = [m[2] if m else k for m, k in zip(found, chunks)]
        wanted, rest = list({w for w in words if w}), list({k for k in odd if k})
        ids = {b"": b""} | dict(zip(wanted, self.learn(self.pieces, wanted, self.words)))
        of = {b"": b""} | dict(zip(rest, self.together(rest)))
        return [ids[w] + of[k] for w, k in zip(words, odd)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        n, values = self.encoded(pa.array(texts, pa.binary()))
        ends = np.cumsum(n)
        return self.cut(values, ends, ends)

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each text has, all ids one after another). Chunks are numbered as they are cut, so only distinct ones become objects and are looked up;
        ids are then put together by number."""
        if not self.apart:
            ids = self.ids(texts.to_pylist())
            return np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), "<i4")
        chunks = pc.ascii_split_whitespace(texts.view(pa.string()))
        numbered = chunks.values.dictionary_encode()
        distinct = numbered.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        found = self.learn(self.chunks, distinct, self.split)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        number = numbered.indices.to_numpy()
        n = sizes[number]
        upto = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(upto[-1]) + np.repeat((np.cumsum(sizes) - sizes)[number] - upto[:-1], n)
        return np.diff(upto[chunks.offsets.to_numpy()]), np.frombuffer(b"".join(found), "<i4")[at]


def _encoder(tokenizer: str) -> Encoder:
    """A worker process keeps its encoders, and with them their tables, for the tasks to come: in a module of its own, as this one comes anew with each task."""
    import sys
    import types

    kept = sys.modules.setdefault("tidemark_worker", types.ModuleType("tidemark_worker")).__dict__.setdefault("encoders", {})
    key = zlib.crc32(tokenizer.encode()), len(tokenizer)
    if key not in kept:
        kept[key] = Encoder(tokenizer)
    return kept[key]


def _parts(values: pa.Array, most: int = 8 << 20) -> Iterator[pa.Array]:
    """Runs of about so many bytes."""
    upto = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(upto // most)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]):
        if i < j:
            yield values.slice(i, j - i)


SCHEMA = "doc_id long, at long, n_tokens long, ids array<int>"


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END, stripe: int = STRIPE, stride: int = STRIDE, partitions: int | None = None) -> None:
    """Write docs' (doc_id, text) as token files to a new folder.

    Documents are dealt by range of doc_id, so a file's ids are those of consecutive documents; rows that share a doc_id are dealt by text and by place as well,
    so many of them fill no single task. Texts are shuffled once, before they are encoded."""
    spark = docs.sparkSession
    common.small_batches(spark)
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        said = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = _encoder(said), 0
        for b in batches:
            found = [encoder.encoded(part) for part in _parts(pc.fill_null(b.column("text"), b""))]
            n = np.concatenate([np.empty(0, np.int64), *(k for k, _ in found)])
            ends = np.cumsum(n)
            values = np.insert(np.concatenate([np.empty(0, "<i4"), *(v for _, v in found)]), ends, end_id).astype(np.int32, copy=False)
            upto = np.concatenate([[0], ends + np.arange(1, len(n) + 1)])
            lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(upto[:-1] + before), pa.array(n + 1), lists], names=["doc_id", "at", "n_tokens", "ids"])
            before += int(upto[-1])
        tidy()

    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("place")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    files = dealt.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, SCHEMA).write.format("orc")
    files = files.option("compression", "zstd").option("orc.stripe.size", stripe).option("orc.row.index.stride", stride)
    files.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", FALSE_POSITIVES).save(path)
    index(spark, path).write.parquet(f"{path}/{INDEX}")


def index(spark: SparkSession, path: str) -> DataFrame:
    """A row per file: its name, documents, ids, least and largest doc_id, and the ids before it. Spark numbers files by partition, and those are ranges in order.
    The order is over a row per file."""
    rows = spark.read.schema(SCHEMA).orc(path).select("doc_id", "at", "n_tokens", F.col("_metadata.file_name").alias("file"))
    files = rows.groupBy("file").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("least"), F.max("doc_id").alias("largest"))
    before = F.sum("n_tokens").over(Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("long")).rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("before", F.coalesce(before, F.lit(0)))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids), in splits of whole stripes. A filter on doc_id reaches the files, and unread columns are not decoded."""
    rows = spark.read.schema(SCHEMA).orc(path).select("*", F.col("_metadata.file_name").alias("_file"))
    files = common.if_small(spark.read.parquet(f"{path}/{INDEX}").select(F.col("file").alias("_file"), "before"))
    return rows.join(files, "_file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; stripes and row groups whose statistics or Bloom filter rule them out are not read."""
    wanted: Column = F.col("doc_id").isin(doc_ids) if len(doc_ids) != 1 else F.col("doc_id") == doc_ids[0]
    return read(spark, path).where(wanted)


def checksums(rows: DataFrame) -> DataFrame:
    """rows of `read` with ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in place of the ids."""
    common.small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            at, values = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")
            crc = [zlib.crc32(values[i:j]) for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "tokens")
    write(common.table(spark, sf_dir, "documents"), path)
    return checksums(read(spark, path))
