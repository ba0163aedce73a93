"""Alignment of two tokenizers over the same text, token by token.

Both cut a text's bytes into tokens. Tokens that overlap belong together, and so do those
joined by a chain of overlaps; these groups end where a token of either side ends.
They are found by pointer jumping: every token points to the token of the other side that
overlaps it and reaches farthest right, or to itself if none reaches farther. All tokens of a
batch of texts follow their pointer's pointer at once, until nothing moves; then each
points to the last token of its group, which names it.

How often two ids meet is counted in documents, over the corpus. A task reads texts in chunks and
writes, for a chunk, each pair of ids once, and for a document the numbers of its
pairs within the chunk. Counts are summed by pair, brought back to the chunks that hold the
pair, and meet the chunk's documents there: no table of counts is broadcast, no
text moves, and a frequent pair has one row per chunk.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepfall.llm import pieces
from stepfall.llm.pieces import text_slices
from stepfall.llm.scratch import settle

#: Tokenizer A, of bytes (the ranks of the vocabulary of byte_bpe_50k.json), and tokenizer B, of pieces.
RANKS, MODEL = "byte_bpe_50k.tiktoken", pieces.MODEL
#: Bytes of texts in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 8 << 20
#: Rows of pairs in a batch.
PAIR_ROWS = 1 << 16
_PAIR_BITS = 32


class Sides:
    """Both tokenizers: ids of texts, and the bytes of every id."""

    def __init__(self, ranks: str, model: str) -> None:
        with open(public_tokenizers.path(ranks), "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.codec = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.a_bytes = [token for token, _ in sorted(table.items(), key=lambda x: x[1])]
        self.b_bytes = pieces.pieces(model).surfaces
        self.encoder = pieces.encoder(model)
        self.a_width = np.array([len(t) for t in self.a_bytes])
        self.b_width = np.array([len(t) for t in self.b_bytes])
        # An id and what follows it: the next id, the other side, the next group.
        self.listed = [f"{i}{sign}".encode() for i in range(max(len(self.a_bytes), len(self.b_bytes))) for sign in ",|;"]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B, one text after the other, and how many each text has: none where the bytes differ from the text's."""
        # A keeps every byte, and B all but the sign that it writes for a space.
        texts = ["" if pieces.SPACE in t else t for t in texts]
        a = [self.codec.encode_ordinary(" " + t) if t else () for t in texts]
        b, n_b = self.encoder(texts)
        n_a = np.array([len(x) for x in a])
        return np.fromiter(chain.from_iterable(a), np.int64, n_a.sum()), n_a, b.astype(np.int64), n_b


@cache
def sides(ranks: str, model: str) -> Sides:
    return Sides(ranks, model)


def ended(ends: np.ndarray, total: int) -> np.ndarray:
    """How many of ``ends`` lie at or before each place up to ``total``."""
    return np.cumsum(np.bincount(ends, minlength=total + 1), dtype=np.int32)


def group_ends(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token of A and of B, the token of B that ends its group. The arguments are the tokens' ends, over the same bytes."""
    n, total = len(a_end), int(a_end[-1]) if len(a_end) else 0
    # The token of the other side that holds a token's last byte overlaps it and reaches farthest.
    over, under = ended(a_end, total)[b_end - 1], ended(b_end, total)[a_end - 1]
    token = np.arange(n, n + len(b_end))
    to = np.r_[n + under, np.where(a_end[over] > b_end, over, token)]
    while ((jump := to[to]) != to).any():
        to = jump
    return to[:n] - n, to[n:] - n


class Aligned:
    """Groups and links of the tokens of some texts."""

    def __init__(self, both: Sides, texts: list[str]) -> None:
        self.a, self.n_a, self.b, self.n_b = both.encode(texts)
        a_end, b_end = np.cumsum(both.a_width[self.a]), np.cumsum(both.b_width[self.b])
        a_last, b_last = group_ends(a_end, b_end)
        is_last = b_last == np.arange(len(b_last))
        number = np.cumsum(is_last) - 1
        self.a_group, self.b_group = number[a_last], number[b_last]
        row = np.arange(len(texts))
        row_of = np.repeat(row, self.n_b)
        self.n_groups = np.bincount(row_of[is_last], minlength=len(texts))
        #: Tokens of either side before each group, and in all.
        groups_ = int(self.n_groups.sum())
        self.a_start = np.r_[0, np.cumsum(np.bincount(self.a_group, minlength=groups_))]
        self.b_start = np.r_[0, np.cumsum(np.bincount(self.b_group, minlength=groups_))]
        # Between one end and the next, of whichever side, lies one overlap.
        total = int(a_end[-1]) if len(a_end) else 0
        ends = np.zeros(total + 1, bool)
        ends[a_end] = ends[b_end] = True
        at = np.flatnonzero(ends) - 1
        link_b = ended(b_end, total)[at]
        self.link_a, self.link_b = self.a[ended(a_end, total)[at]], self.b[link_b]
        self.link_row = row_of[link_b]
        self.n_links = np.bincount(self.link_row, minlength=len(texts))

    def digests(self, both: Sides) -> list[str]:
        """By text, the digest of ``a1,a2|b1;a3|b2``: the ids of every group; empty where there are no tokens."""
        a, b = np.arange(len(self.a)), np.arange(len(self.b))
        listed = np.empty(len(a) + len(b), np.int64)
        listed[a + self.b_start[self.a_group]] = 3 * self.a + (self.a_start[self.a_group + 1] == a + 1)
        listed[b + self.a_start[self.b_group + 1]] = 3 * self.b + 2 * (self.b_start[self.b_group + 1] == b + 1)
        bounds = np.cumsum(np.r_[0, self.n_a + self.n_b]).tolist()
        parts = (b"".join(map(both.listed.__getitem__, listed[lo:hi].tolist())) for lo, hi in zip(bounds, bounds[1:], strict=False))
        return [hashlib.sha256(part[:-1]).hexdigest() if part else "" for part in parts]

    def lists(self) -> pa.Array:
        """By text, its groups with the ids of both sides."""
        a = pa.ListArray.from_arrays(pa.array(self.a_start, pa.int32()), pa.array(self.a, pa.int32()))
        b = pa.ListArray.from_arrays(pa.array(self.b_start, pa.int32()), pa.array(self.b, pa.int32()))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(self.n_groups)], pa.int32()), pa.StructArray.from_arrays([a, b], ["a", "b"]))


def _slim(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return slim, slim.schema["doc_id"].dataType.simpleString()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, model: str = MODEL) -> DataFrame:
    """``(doc_id, groups)``: by row, the groups of the text in order, each with its ids ``a`` and ``b``.

    NULL and empty texts, and those whose bytes one of the tokenizers changes, have no
    groups. Rows need no id, may repeat, and may have other columns of any name.
    """
    slim, id_kind = _slim(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(ranks, model)
        for batch in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], Aligned(both, batch["text"].to_pylist()).lists()], ["doc_id", "groups"])

    return slim.mapInArrow(run, f"doc_id {id_kind}, groups array<struct<a: array<int>, b: array<int>>>")


def _pack(numbers: np.ndarray, times: np.ndarray) -> bytes:
    """Rising numbers and how often each occurs: gaps, byte by byte of equal weight, compressed."""
    gaps = np.diff(numbers, prepend=0)
    flat = np.concatenate([gaps, times - 1]).astype("<i4")
    return zstandard.ZstdCompressor(level=1).compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    flat = np.ascontiguousarray(planes.T).view("<i4").ravel()
    half = len(flat) // 2
    return np.cumsum(flat[:half]), flat[half:] + 1


class _Chunk:
    """Documents of a chunk, and the pairs of ids they hold."""

    def __init__(self, number: int) -> None:
        self.number, self.bytes, self.rows = number, 0, 0
        self.ids: list[pa.Array] = []
        self.columns: list[list[np.ndarray]] = [[], [], [], []]
        self.digests: list[str] = []
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, both: Sides, batch: pa.RecordBatch) -> None:
        found = Aligned(both, batch["text"].to_pylist())
        for column, values in zip(self.columns, (found.n_a, found.n_b, found.n_groups, found.n_links), strict=True):
            column.append(values)
        self.digests += found.digests(both)
        # A document and a pair in one number; of each, how often.
        held = np.sort((found.link_row + self.rows) << _PAIR_BITS | found.link_a * len(both.b_bytes) + found.link_b)
        first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]][: len(held)])
        self.held.append((held[first], np.diff(np.r_[first, len(held)])))
        self.ids.append(batch["doc_id"])
        self.rows += batch.num_rows
        self.bytes += batch["text"].nbytes

    def batches(self, both: Sides, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        held, times = (np.concatenate(x) for x in zip(*self.held, strict=True))
        pairs, which, docs = np.unique(held & (1 << _PAIR_BITS) - 1, return_inverse=True, return_counts=True)
        # Frequent pairs get low numbers, so that gaps are short.
        number = np.empty(len(pairs), np.int64)
        by_count = np.argsort(-docs, kind="stable")
        number[by_count] = np.arange(len(pairs))
        order = np.argsort((held >> _PAIR_BITS) << _PAIR_BITS | number[which])
        numbers, times, row = number[which][order], times[order], held[order] >> _PAIR_BITS
        bounds = np.searchsorted(row, np.arange(self.rows + 1)).tolist()
        packed = [_pack(numbers[lo:hi], times[lo:hi]) for lo, hi in zip(bounds, bounds[1:], strict=False)]
        own = {"doc_id": pa.concat_arrays(self.ids), "links": pa.array(packed, pa.binary()), "groups_sha256": pa.array(self.digests, pa.string())}
        own |= {name: pa.array(np.concatenate(x), pa.int64()) for name, x in zip(("n_a", "n_b", "n_groups", "n_links"), self.columns, strict=True)}
        yield self._batch(own, self.rows, schema)
        pairs, docs = pairs[by_count], docs[by_count]
        for at in range(0, len(pairs), PAIR_ROWS):
            some = pairs[at : at + PAIR_ROWS]
            a, b = np.divmod(some, len(both.b_bytes))
            here = {"number": pa.array(np.arange(at, at + len(some)), pa.int32()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32())}
            yield self._batch(here | {"docs": pa.array(docs[at : at + PAIR_ROWS], pa.int64())}, len(some), schema)

    def _batch(self, columns: dict[str, pa.Array], n: int, schema: pa.Schema) -> pa.RecordBatch:
        columns |= {"chunk": pa.array(np.full(n, self.number), pa.int64()), "is_doc": pa.array(np.full(n, "doc_id" in columns))}
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _chunks(docs: DataFrame, id_col: str, text_col: str, ranks: str, model: str, chunk_bytes: int) -> DataFrame:
    """One row per document and one per pair of a chunk, written once."""
    from pyspark.sql.pandas.types import to_arrow_type

    slim, id_kind = _slim(docs, id_col, text_col)
    long = ("chunk", "n_a", "n_b", "n_groups", "n_links", "docs")
    kinds = {name: ("bigint", pa.int64()) for name in long} | {name: ("int", pa.int32()) for name in ("number", "a", "b")}
    kinds |= {"is_doc": ("boolean", pa.bool_()), "links": ("binary", pa.binary()), "groups_sha256": ("string", pa.string())}
    kinds["doc_id"] = (id_kind, to_arrow_type(slim.schema["doc_id"].dataType))
    schema = pa.schema([pa.field(name, kind) for name, (_, kind) in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, task, made = sides(ranks, model), TaskContext.get().partitionId(), 0
        chunk = _Chunk(task << _PAIR_BITS)
        for batch in text_slices(batches, "text"):
            if chunk.rows and chunk.bytes + batch["text"].nbytes > chunk_bytes:
                yield from chunk.batches(both, schema)
                made += 1
                chunk = _Chunk(task << _PAIR_BITS | made)
            chunk.add(both, batch)
        if chunk.rows:
            yield from chunk.batches(both, schema)

    return settle(slim.mapInArrow(run, ", ".join(f"{name} {kind}" for name, (kind, _) in kinds.items())), "aligned")


def _counted(chunks: DataFrame) -> DataFrame:
    """``(a, b, count, best)``: in how many documents the ids meet, and whether no other ``b`` meets ``a`` in more."""
    counts = chunks.where("NOT is_doc").groupBy("a", "b").agg(F.sum("docs").alias("count"))
    # An id of A meets at most the ids of B's vocabulary.
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def pair_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, model: str = MODEL, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """``(a, b, count, best)`` for all ids that overlap in some text: a translation table of the vocabularies."""
    return _counted(_chunks(docs, id_col, text_col, ranks, model, chunk_bytes))


def measures(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, model: str = MODEL, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row.

    ``n_best`` counts the links whose pair is the best of its A id, ``count_sum`` adds up
    the counts of all links. NULL and empty texts, and those whose bytes a tokenizer
    changes, have zeros and an empty digest. Every row counts as a document, also where
    ids are NULL or repeated; an empty table gives no rows; other columns are not looked at.
    """
    chunks = _chunks(docs, id_col, text_col, ranks, model, chunk_bytes)
    pairs = chunks.where("NOT is_doc").select("chunk", "number", "a", "b")
    known = pairs.join(_counted(chunks), ["a", "b"]).select(F.col("chunk").alias("of_chunk"), "number", "count", "best")
    own = chunks.where("is_doc").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def score(rows: pa.Table, counts: pa.Table) -> pa.Table:
        number = counts["number"].to_numpy()
        count, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        count[number], best[number] = counts["count"].to_numpy(), counts["best"].to_numpy()
        sums = []
        for packed in rows["links"]:
            numbers, times = _unpack(packed.as_py())
            sums.append((int(best[numbers] @ times), int(count[numbers] @ times)))
        made = {"n_best": pa.array([s[0] for s in sums], pa.int64()), "count_sum": pa.array([s[1] for s in sums], pa.int64())}
        return pa.table([made[name] if name in made else rows[name] for name in names], names=names)

    id_kind = chunks.schema["doc_id"].dataType.simpleString()
    kinds = ", ".join(f"{name} {'string' if name == 'groups_sha256' else id_kind if name == 'doc_id' else 'bigint'}" for name in names)
    return own.groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(score, kinds)
