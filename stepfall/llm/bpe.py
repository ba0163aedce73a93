"""Byte-level BPE of whole texts, long ones in overlapping chunks.

A text longer than a chunk is cut into chunks that overlap. Chunks are split into
pre-tokens in parallel, wherever they lie. A split that starts inside a pre-token
may be wrong at first, but once it has a boundary in common with the split of the
chunk before, both go on alike, as the pattern never looks back. Stitching picks
such a boundary in each overlap, not after white space, and thereby cuts the text into
pieces that split alone as they do in the whole. Pieces are encoded in parallel and their ids put together.

Where an overlap holds no common boundary (a run without white space longer than the
overlap), the chunk is joined to the one before and split again with it, as one.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfall.llm.scratch import settle

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of a chunk, and of its overlap with the next one.
CHUNK, OVERLAP = 32_768, 1_024
#: A match that ends this near to the end of a chunk could end elsewhere in the whole text.
MARGIN = 4
#: Texts encoded or decoded at a time.
SLICE = 256


@cache
def _pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


@cache
def _codec(ranks: str) -> tiktoken.Encoding:
    with open(public_tokenizers.path(ranks), "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@cache
def _bytes_of(ranks: str) -> list[bytes]:
    codec = _codec(ranks)
    table = [b""] * codec.n_vocab
    for token, rank in codec._mergeable_ranks.items():
        table[rank] = token
    return table


def _id_lists(texts: pa.Array, ranks: str) -> pa.Array:
    """Ids of texts that begin and end where pre-tokens do; each pre-token is merged by itself."""
    encode_text = _codec(ranks).encode_ordinary
    ids = [np.array(encode_text(text.as_py()), np.int32) for text in texts]
    offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short batches, so that what is made of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def boundaries(text: str, is_last: bool, start: int = 0) -> np.ndarray:
    """Ends of the pre-tokens of a chunk that do not depend on what follows it."""
    ends = np.fromiter((m.end() for m in _pattern().finditer(text)), np.int64)
    return (ends if is_last else ends[ends < len(text) - MARGIN]) + start


def _cut(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, str]]:
    for at in range(0, max(1, len(text) - overlap), chunk):
        yield at, text[at : at + chunk + overlap]


def _rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, make: Callable[[dict], Iterator[dict]], most: int = 64) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            for made in make(row):
                out.append(made)
                if len(out) >= most:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def pieces_of_long(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(row, doc_id, at, piece)`` of texts longer than ``chunk`` characters (``row``, ``doc_id``, ``text``)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = f"row long, doc_id {id_type}, seq int, at long, length long, text string"
    out = pa.schema([("row", pa.int64()), ("doc_id", _arrow(docs, "doc_id")), ("seq", pa.int32()), ("at", pa.int64()), ("length", pa.int64()), ("text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(r: dict) -> Iterator[dict]:
            for seq, (at, part) in enumerate(_cut(r["text"], chunk, overlap)):
                yield {"row": r["row"], "doc_id": r["doc_id"], "seq": seq, "at": at, "length": len(r["text"]), "text": part}

        return _rows(batches, out, make)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(r: dict) -> Iterator[dict]:
            ends = boundaries(r["text"], r["at"] + len(r["text"]) >= r["length"], r["at"])
            # Only boundaries in the overlaps are needed to stitch.
            near = (ends <= r["at"] + overlap) | (ends >= r["at"] + chunk)
            yield r | {"ends": ends[near].tolist()}

        return _rows(batches, out.append(pa.field("ends", pa.list_(pa.int64()))), make)

    chunks = docs.mapInArrow(cut, kind).repartition("row", "seq").mapInArrow(split, f"{kind}, ends array<bigint>")

    def stitched(doc: pd.DataFrame) -> pd.DataFrame:
        doc = doc.sort_values("seq")
        starts, texts, length = doc["at"].tolist(), doc["text"].tolist(), int(doc["length"].iloc[0])
        cuts, trusted = [0], np.asarray(doc["ends"].iloc[0], np.int64)

        def text_between(a: int, b: int) -> str:
            out, i = [], min(a // chunk, len(starts) - 1)
            while a < b:
                upto = min(b, starts[i] + len(texts[i]))
                out.append(texts[i][a - starts[i] : upto - starts[i]])
                a, i = upto, i + 1
            return "".join(out)

        for i in range(1, len(texts)):
            ends = np.asarray(doc["ends"].iloc[i], np.int64)
            common = np.intersect1d(trusted[trusted > starts[i]], ends, assume_unique=True)
            # White space at the end of a piece would be split as if nothing followed.
            cut = next((int(b) for b in common if not texts[i][b - 1 - starts[i]].isspace()), None)
            if cut is None:
                # No boundary to cut at: split the chunk again, from the last cut on.
                last = i == len(texts) - 1
                upto = length if last else starts[i] + len(texts[i])
                trusted = boundaries(text_between(cuts[-1], upto), last, cuts[-1])
                continue
            cuts.append(cut)
            trusted = ends[ends >= cut]
        cuts = sorted(set(cuts)) + [length]
        parts = [text_between(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pd.DataFrame({"row": doc["row"].iloc[0], "doc_id": doc["doc_id"].iloc[0], "at": cuts[:-1], "piece": parts})

    return chunks.groupBy("row").applyInPandas(stitched, f"row long, doc_id {id_type}, at long, piece string")


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _ids(batches: Iterator[pa.RecordBatch], ranks: str, text_col: str, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        yield pa.RecordBatch.from_arrays([*(batch[name] for name in keep), _id_lists(batch[text_col], ranks)], [*keep, "ids"])


def _raw(batches: Iterator[pa.RecordBatch], ranks: str, ids_col: str, out_col: str) -> Iterator[pa.RecordBatch]:
    table = _bytes_of(ranks).__getitem__
    for batch in _slices(batches):
        raw = [b"".join(map(table, row.as_py() or ())) for row in batch[ids_col]]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, out_col])


def _short_and_long(docs: DataFrame, id_col: str, text_col: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Written before they are spread, so that a task that runs again finds the same numbers.
    long = settle(slim.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()), "long")
    return slim.where(F.length("text") <= chunk), long


def _encode_long(long: DataFrame, ranks: str, chunk: int, overlap: int) -> DataFrame:
    id_kind = long.schema["doc_id"].dataType.simpleString()
    pieces = pieces_of_long(long, chunk, overlap).repartition("row", "at")
    encoded = pieces.mapInArrow(lambda b: _ids(b, ranks, "piece", ("row", "doc_id", "at")), f"row long, doc_id {id_kind}, at long, ids array<int>")

    def joined(doc: pd.DataFrame) -> pd.DataFrame:
        doc = doc.sort_values("at")
        return pd.DataFrame({"doc_id": doc["doc_id"].iloc[:1].to_numpy(), "ids": [np.concatenate([np.asarray(x, np.int32) for x in doc["ids"]])]})

    return encoded.groupBy("row").applyInPandas(joined, f"doc_id {id_kind}, ids array<int>")


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``(doc_id, ids)`` for every row: the ids ``tiktoken`` gives for the whole text, without special tokens.

    NULL and empty texts have no ids. Texts up to ``chunk`` characters are encoded
    where they are read; of longer ones, the chunks are spread. Repeated rows are rows
    of their own, and NULL ids are allowed. An empty table gives no rows; other columns
    are not looked at.
    """
    short, long = _short_and_long(docs, id_col, text_col, chunk)
    id_kind = short.schema["doc_id"].dataType.simpleString()
    whole = short.mapInArrow(lambda b: _ids(b, ranks, "text", ("doc_id",)), f"doc_id {id_kind}, ids array<int>")
    return whole.unionByName(_encode_long(long, ranks, chunk, overlap))


def decode(encoded: DataFrame, ids_col: str = "ids", ranks: str = RANKS, out_col: str = "bytes") -> DataFrame:
    """Adds the raw bytes that the ids stand for; no ids, no bytes. NULL ids count as none."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(lambda b: _raw(b, ranks, ids_col, out_col), f"{kinds}, `{out_col}` binary")


def round_trip(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: digests of the ids, and of what they decode to.

    As ``decode(encode(docs))``, but short texts go both ways in one Python worker.
    """
    short, long = _short_and_long(docs, id_col, text_col, chunk)
    id_kind = short.schema["doc_id"].dataType.simpleString()
    there_and_back = lambda b: _raw(_ids(b, ranks, "text", ("doc_id",)), ranks, "ids", "bytes")
    both = short.mapInArrow(there_and_back, f"doc_id {id_kind}, ids array<int>, bytes binary")
    both = both.unionByName(decode(_encode_long(long, ranks, chunk, overlap), "ids", ranks, "bytes"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
