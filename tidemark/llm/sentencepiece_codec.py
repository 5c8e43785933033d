"""SentencePiece encoding and decoding through a table of distinct chunks.

The pieces of the model hold the white-space marker only as a run at their start, so no merge crosses the place before a marked word.
Each distinct chunk (markers and what follows up to the next marker) is segmented once for a worker's table; ids are joined back by position.
`crosses_markers` says whether a model allows this; for one that does not, whole texts are encoded.

Defined cases: a null text is encoded as the empty one (the end id only); nothing else is special: texts of any length are whole, rows
that repeat are encoded alike, an empty table gives an empty result, and extra columns pass through unless a result has
their name (in any case)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common
from .common import tidy

MARK = "▁"
#: Chunks kept in a worker's table; it is emptied beyond, which costs time but changes no result.
TABLE = 200_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def crosses_markers(sp) -> bool:
    """Whether any piece has a marker after another character, which would let merges cross chunks."""
    return any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()) if not sp.is_control(i))


class Codec:
    """Encodes and decodes whole texts with one model; end_id adds the model's end id."""

    def __init__(self, model: str | bytes, end_id: bool = True, table: int = TABLE):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(**({"model_proto": model} if isinstance(model, bytes) else {"model_file": model}))
        self.whole = crosses_markers(self.sp) or self.sp.encode(" ") == [] or self.sp.encode("a ﬁ  b") != self.sp.encode("a ﬁ", add_eos=False) + self.sp.encode(" b")
        self.end = [self.sp.eos_id()] if end_id else []
        self.mark = self.sp.piece_to_id(MARK)
        self.ids: dict[str, list[int]] = {}
        self.size = table

    def chunks(self, text: str) -> list[str]:
        """Keys of the text's chunks: each chunk without its first marker, which is the dummy prefix's or a space."""
        text = text.replace(MARK, " ")
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [x[1:] for x in re.findall(r" +[^ ]*", f" {text}")]
        return text.split(" ") if text else []

    def learn(self, keys: set[str]) -> None:
        new = [k for k in keys if k not in self.ids]
        if len(self.ids) + len(new) > self.size:
            self.ids.clear()
            new = list(keys)
        self.ids.update(zip(new, self.sp.encode(new, num_threads=1)))
        if "" in keys:
            self.ids[""] = [self.mark]

    def ready(self, texts: list[str | None]) -> None:
        pass

    def encode(self, text: str | None) -> list[int]:
        if self.whole:
            return self.sp.encode(text or "") + self.end
        keys = self.chunks(text or "")
        self.learn(set(keys))
        return [i for k in keys for i in self.ids[k]] + self.end

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


class Digests(Codec):
    """Per text: number of ids, digest of the ids, digest of the decoded text. The table holds each chunk's ids as text; chunks that do not
    decode to themselves (none do with an identity normaliser) stand in a second one with what they decode to."""

    def __init__(self, *a, **b):
        super().__init__(*a, **b)
        self.said: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        sp = self.sp
        n = range(sp.get_piece_size())
        self.names = [str(i) for i in n]
        #: What each id decodes to; None for single bytes, which mean something together only.
        self.texts = [None if sp.is_byte(i) or sp.is_unknown(i) else "" if sp.is_control(i) else sp.id_to_piece(i).replace(MARK, " ") for i in n]

    def decoded(self, key: str, ids: list[int]) -> str:
        """What a chunk's ids decode to, with its first marker as a space."""
        try:
            return "".join(map(self.texts.__getitem__, ids))
        except TypeError:
            return f" {self.sp.decode(ids)}"

    def note(self, keys: set[str]) -> None:
        new = [k for k in keys if k not in self.said]
        if len(self.said) + len(new) > self.size:
            self.said.clear()
            self.odd.clear()
            new = list(keys)
        for k, ids in zip(new, self.sp.encode(new, num_threads=1)):
            ids = ids or [self.mark]  # of the empty key: a marker alone
            self.said[k] = " ".join(map(self.names.__getitem__, ids))
            if (back := self.decoded(k, ids)) != f" {k}":
                self.odd[k] = back

    def ready(self, texts: list[str | None]) -> None:
        """Segment what is new in some texts with one call."""
        if not self.whole:
            self.note({k for t in texts if t for k in self.chunks(t)})

    def of(self, text: str | None) -> tuple[int, str, str]:
        if self.whole:
            ids = self.encode(text)
            said, back = " ".join(map(str, ids)), self.decode(ids)
        else:
            keys = self.chunks(text or "")
            try:
                parts = [*map(self.said.__getitem__, keys)]
            except KeyError:
                self.note(set(keys))
                parts = [*map(self.said.__getitem__, keys)]
            said = " ".join(parts + [*map(str, self.end)])
            back = "".join([self.odd.get(k, f" {k}") for k in keys])[1:] if self.odd else " ".join(keys)
        return said.count(" ") + (said != ""), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()


def _parts(values: list) -> Iterator[list]:
    """Runs of about a million characters."""
    part, size = [], 0
    for x in values:
        part.append(x)
        size += len(x or ())
        if size >= 1_000_000:
            yield part
            part, size = [], 0
    if part:
        yield part


def _codec(kind: type[Codec], model: bytes, end_id: bool) -> Codec:
    """A worker process keeps its codecs, and with them their tables, for the tasks to come: in a module of its own, as this one comes anew with each task."""
    import sys
    import types

    kept = sys.modules.setdefault("tidemark_worker", types.ModuleType("tidemark_worker")).__dict__.setdefault("codecs", {})
    key = (kind.__name__, hashlib.sha256(model).digest(), end_id)
    if key not in kept:
        kept[key] = kind(model, end_id)
    return kept[key]


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _with(df: DataFrame, fields: list[T.StructField], kind: type[Codec], each, model: str | None, end_id: bool, text: str, returned: list[str] | None = None) -> DataFrame:
    """df with new columns that `each` makes of a codec and a text. The model's bytes go with the task: executors need no file."""
    common.small_batches(df.sparkSession)
    proto = _model(model or default_model())
    own = common.others(df if returned is None else df.select(*returned), [f.name for f in fields])
    df = df.select(text, *(c for c in own if c != text))
    schema = T.StructType([df.schema[c] for c in own] + fields)
    types = {"n_tokens": pa.int64(), "token_ids": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(kind, proto, end_id)
        for b in batches:
            made = []
            for part in _parts(b.column(text).to_pylist()):
                codec.ready(part)
                made += [each(codec, x) for x in part]
            cols = list(zip(*made)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *(pa.array(x, types.get(f.name, pa.string())) for f, x in zip(fields, cols))], names=[f.name for f in schema])
        tidy()

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, model: str | None = None, end_id: bool = True, text: str = "text") -> DataFrame:
    """df with token_ids (array<int>) and n_tokens (long)."""

    def each(codec: Codec, x: str | None) -> tuple:
        ids = codec.encode(x)
        return ids, len(ids)

    return _with(df, [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())], Codec, each, model, end_id, text)


def decode(df: DataFrame, model: str | None = None, ids: str = "token_ids") -> DataFrame:
    """df with decoded (string); null ids give null."""
    return _with(df, [T.StructField("decoded", T.StringType())], Codec, lambda codec, x: (None if x is None else codec.decode(x),), model, False, ids)


def digests(df: DataFrame, model: str | None = None, end_id: bool = True, text: str = "text", returned: list[str] | None = None) -> DataFrame:
    """df (or only its columns `returned`) with n_tokens, ids_sha256 and decoded_sha256 of each text, without moving the ids themselves."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _with(df, fields, Digests, lambda codec, x: codec.of(x), model, end_id, text, returned)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"), returned=["doc_id"]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
