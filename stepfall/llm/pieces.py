"""SentencePiece BPE of whole texts, by merge rounds over flat numpy arrays.

A text becomes symbols, one per character. Two neighbours merge where their
characters together are a piece; the pair of the best score goes first, the leftmost
among equals. Neighbours that stand side by side in no piece never come together, so a
text falls into words, and words into segments, that merge apart from one another. The symbols
of all new words of a batch lie in one array. A round finds the best rank of every segment,
merges all pairs of that rank at once, the left one where two overlap, and closes the
gaps; rounds go on until no segment has a pair left.

All pairs of a rank may merge at once unless the new symbol makes a better pair, or an
equal one, with a neighbour. Pieces for which the vocabulary allows that are found
beforehand; where one is the best of a segment, only its leftmost pair merges in that round. A
long segment of this kind (a run of spaces, whose pieces share one score) is merged pair
by pair from a queue instead, as it would take a round for each pair.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
#: The sign for a space, what decoding gives for an unknown id, and for a byte that is no UTF-8.
SPACE, UNKNOWN_SURFACE, NO_UTF8 = "▁", " ⁇ ", "�"
#: Characters of texts taken at a time.
SLICE_CHARS = 1 << 19
#: Words and characters that a worker remembers; beyond either it starts anew.
CACHE_WORDS, CACHE_CHARS = 1 << 18, 1 << 22
#: Symbols of a segment that merges pair by pair if its best piece may upset the order.
LONG = 64
#: The rank of neighbours that are no piece.
NONE = np.int32(2**31 - 1)
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``start, start+1, ..`` of every range, one range after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.empty(0, np.int64)
    return np.arange(ends[-1], dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class Pairs:
    """Which neighbours merge, into what, and in which order.

    ``found`` has ``(left, right, merged, rank)``; pairs of a lower rank merge first.
    Symbols from ``size`` on never merge.
    """

    def __init__(self, found: list[tuple[int, int, int, int]], size: int) -> None:
        table = np.array(sorted(found), np.int64).reshape(-1, 4)
        self.size = size
        self.keys = np.append(table[:, 0] * size + table[:, 1], np.iinfo(np.int64).max)
        self.merged = np.append(table[:, 2], -1).astype(np.int32)
        self.ranks = np.append(table[:, 3], NONE).astype(np.int32)
        self.none = len(table)
        self._places: dict[tuple[int, int], int] = {}
        rank_of = np.full(size, -1, np.int64)
        rank_of[table[:, 2]] = table[:, 3]
        #: By symbol: may merging into it make a pair of a better or an equal rank?
        self.upsets = np.zeros(size, bool)
        for side in (0, 1):
            self.upsets[table[table[:, 3] <= rank_of[table[:, side]], side]] = True

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs in the table; ``none`` where there is none."""
        keys = np.where((left < self.size) & (right < self.size), left.astype(np.int64) * self.size + right, -1)
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, at, self.none)

    def merge(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left when no pair is, and the place where each began. ``segment`` does not fall."""
        places = np.arange(len(symbols))
        done, done_at = [symbols[:0]], [places[:0]]
        pair = np.full(len(symbols), self.none)
        inner = np.flatnonzero(segment[:-1] == segment[1:])
        pair[inner] = self.of(symbols[inner], symbols[inner + 1])
        while len(symbols):
            first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            sizes = np.diff(np.r_[first, len(symbols)])
            ranks = self.ranks[pair]
            best = np.minimum.reduceat(ranks, first)
            if (over := np.repeat(best == NONE, sizes)).any():
                done.append(symbols[over])
                done_at.append(places[over])
                symbols, segment, places, pair = (x[~over] for x in (symbols, segment, places, pair))
                continue
            hit = np.flatnonzero(ranks == np.repeat(best, sizes))
            owner = segment[hit]
            # Of hits that touch, every second one counts from the left.
            apart = np.r_[True, (np.diff(hit) != 1) | (owner[1:] != owner[:-1])]
            since = np.arange(len(hit)) - np.maximum.accumulate(np.where(apart, np.arange(len(hit)), 0))
            hit, owner = hit[since % 2 == 0], owner[since % 2 == 0]
            upset = self.upsets[self.merged[pair[hit]]]
            keep = np.ones(len(symbols), bool)
            symbols = symbols.copy()
            if upset.any():
                leads = np.r_[True, owner[1:] != owner[:-1]]
                careful = np.isin(owner, owner[upset])
                crowd = np.repeat(sizes, sizes)[hit] > LONG
                for lo in np.searchsorted(segment, owner[careful & leads & crowd]).tolist():
                    hi = int(np.searchsorted(segment, segment[lo], "right"))
                    symbols[lo:hi] = self._in_turn(symbols[lo:hi].tolist())
                    keep[lo:hi] = symbols[lo:hi] >= 0
                    pair[lo:hi] = self.none
                hit = hit[~careful | leads & ~crowd]
            symbols[hit] = self.merged[pair[hit]]
            keep[hit + 1] = False
            at = np.cumsum(keep)[hit] - 1
            symbols, segment, places, pair = (x[keep] for x in (symbols, segment, places, pair))
            near = np.zeros(len(symbols), bool)
            near[at] = near[at[at > 0] - 1] = True
            touched = np.flatnonzero(near)
            pair[touched] = self.none
            touched = touched[touched < len(symbols) - 1]
            touched = touched[segment[touched] == segment[touched + 1]]
            pair[touched] = self.of(symbols[touched], symbols[touched + 1])
        where = np.concatenate(done_at)
        order = np.argsort(where)
        return np.concatenate(done)[order], where[order]

    def _in_turn(self, symbols: list[int]) -> list[int]:
        """One segment merged pair by pair; -1 where a symbol has gone into one before it."""
        if not self._places:
            self._places = {divmod(int(key), self.size): i for i, key in enumerate(self.keys[:-1])}
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(symbols):
                left, right = symbols[i], symbols[after[i]]
                if (at := self._places.get((left, right))) is not None:
                    heappush(queue, (int(self.ranks[at]), i, left, right))

        for i in range(len(symbols)):
            offer(i)
        while queue:
            _, i, left, right = heappop(queue)
            if symbols[i] != left or (j := after[i]) >= len(symbols) or symbols[j] != right:
                continue
            symbols[i], symbols[j], after[i] = int(self.merged[self._places[left, right]]), -1, after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return symbols


class Pieces:
    """A BPE vocabulary with byte fallback: how text becomes ids, and ids text."""

    def __init__(self, model: str) -> None:
        given = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        ids = range(given.get_piece_size())
        names = [given.id_to_piece(i) for i in ids]
        silent = {i for i in ids if given.is_control(i)}
        bytes_of = {i: int(names[i][1:-1], 16) for i in ids if given.is_byte(i)}
        plain = {names[i]: i for i in ids if not (i in silent or i in bytes_of or i == given.unk_id())}
        if len(bytes_of) != 256:
            raise ValueError(f"{model} has no pieces for bytes")
        if any(SPACE in name.lstrip(SPACE) for name in plain):
            raise ValueError(f"{model} has pieces that go on after a space")
        self.size = len(ids)
        self.byte_ids = np.array(sorted(bytes_of, key=bytes_of.__getitem__), np.int32)
        self.is_byte = np.isin(np.arange(self.size), self.byte_ids)

        # Symbols: ids of pieces, then characters that occur in pieces only, then all others.
        strays = sorted({c for name in plain for c in name} - set(plain))
        symbol_of = plain | {c: self.size + i for i, c in enumerate(strays)}
        self.strays = np.array([ord(c) for c in strays], np.int64)
        self.far = self.size + len(strays)
        self.symbols = np.arange(0x110000, dtype=np.int32) + self.far
        single = [c for c in symbol_of if len(c) == 1]
        self.symbols[[ord(c) for c in single]] = [symbol_of[c] for c in single]

        scores = {i: given.get_score(i) for i in plain.values()}
        order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.pairs = Pairs(
            [
                (symbol_of[name[:cut]], symbol_of[name[cut:]], i, order[scores[i]])
                for name, i in plain.items()
                for cut in range(1, len(name))
                if name[:cut] in symbol_of and name[cut:] in symbol_of
            ],
            self.far,
        )
        inside = {(a, b) for name in plain for a, b in zip(name, name[1:], strict=False)}
        self.inside = np.sort(np.array([ord(a) << 32 | ord(b) for a, b in inside] + [np.iinfo(np.int64).max], np.int64))

        surfaces = [b"" if i in silent else bytes([bytes_of[i]]) if i in bytes_of else names[i].replace(SPACE, " ").encode() for i in ids]
        surfaces[given.unk_id()] = UNKNOWN_SURFACE.encode()
        self.surfaces = surfaces
        self.loud = np.array([i not in silent for i in ids])
        self.opens = np.array([names[i].startswith(SPACE) and names[i] in plain for i in ids])

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one word after the other, and how many each has."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        beside = code[:-1] << 32 | code[1:]
        parted = (word[1:] != word[:-1]) | (self.inside[np.searchsorted(self.inside, beside)] != beside)
        symbols, places = self.pairs.merge(self.symbols[code], np.cumsum(np.r_[False, parted][: len(code)]))
        ids, count = symbols, np.ones(len(symbols), np.int64)
        if (strange := np.flatnonzero(symbols >= self.size)).size:
            raw = [chr(c).encode() for c in code[places[strange]].tolist()]
            count[strange] = [len(r) for r in raw]
            ids = np.repeat(symbols, count)
            ids[ranges((np.cumsum(count) - count)[strange], count[strange])] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return ids, np.bincount(word[places], count, len(words)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a list of ids: the space that encoding puts in front is left out, bytes become characters again."""
        if not self.loud[ids].all():
            return self._decode_runs(ids)
        raw = b"".join(map(self.surfaces.__getitem__, ids.tolist()))
        try:
            return raw[1:].decode() if len(ids) and self.opens[ids[0]] else raw.decode()
        except UnicodeDecodeError:
            return self._decode_runs(ids)

    def _decode_runs(self, ids: np.ndarray) -> str:
        """As ``decode``, where begin and end ids part the bytes, or bytes are no UTF-8."""
        out, told = [], ids[self.loud[ids]]
        kinds = np.where(self.loud[ids], self.is_byte[ids], 2)
        for run, kind in ((ids[part], kinds[part[0]]) for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(kinds)) + 1)):
            raw = b"".join(map(self.surfaces.__getitem__, run.tolist()))
            while kind == 1 and raw:
                # One character, or one byte that begins none.
                width = next((n for n in (1, 2, 3, 4) if _is_character(raw[:n])), 0)
                out.append(raw[:width].decode() if width else NO_UTF8)
                raw = raw[width or 1 :]
            out.append(raw.decode())
        return "".join(out)[1 if len(told) and self.opens[told[0]] else 0 :]


def _is_character(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


@cache
def pieces(model: str) -> Pieces:
    return Pieces(model)


class _Numbers(dict):
    """Numbers words as they come; ``new`` are those that came since it was last emptied."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number


class Encoder:
    """Encodes texts; words met before are looked up."""

    def __init__(self, model: str) -> None:
        self.pieces = pieces(model)
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbers()
        self.chars = 0
        self.ids, self.counts = np.empty(0, np.int32), np.empty(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has."""
        words = [_WORD.findall(SPACE + text.replace(" ", SPACE)) if text else [] for text in texts]
        every = list(chain.from_iterable(words))
        if len(self.known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self._forget()
        at = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        if new := self.known.new:
            self.known.new = []
            self.chars += sum(map(len, new))
            ids, counts = self.pieces.encode_words(new)
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        starts = np.cumsum(self.counts) - self.counts
        ids = self.ids[ranges(starts[at], self.counts[at])]
        bounds = np.cumsum([0, *map(len, words)])
        total = np.r_[0, np.cumsum(self.counts[at])]
        return ids, np.diff(total[bounds])


@cache
def encoder(model: str) -> Encoder:
    return Encoder(model)


def text_slices(batches: Iterator[pa.RecordBatch], text_col: str, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds one text, or texts of about ``most`` bytes."""
    for batch in batches:
        sizes = np.cumsum([0, *(len(t.as_buffer()) if t.is_valid else 0 for t in batch[text_col])])
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
            yield batch.slice(at, upto - at)
            at = upto


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))


def _per_slice(docs: DataFrame, id_col: str, text_col: str, made: str, fill: Callable[[list[str]], list[pa.Array]]) -> DataFrame:
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_kind = slim.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(part.split()[0] for part in made.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *fill(batch["text"].to_pylist())], names)

    return slim.mapInArrow(run, f"doc_id {id_kind}, {made}")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``(doc_id, ids)`` for every row: the ids of the whole text, without begin and end ids.

    NULL and empty texts have no ids. Repeated rows are rows of their own, NULL ids are
    allowed, an empty table gives no rows, and other columns are not looked at. A task
    holds one batch of texts; a text is never split between tasks.
    """

    return _per_slice(docs, id_col, text_col, "ids array<int>", lambda texts: [_lists(*encoder(model)(texts))])


def decode(encoded: DataFrame, ids_col: str = "ids", model: str = MODEL, out_col: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for. NULL and empty lists give empty text; ids beyond the vocabulary are an error."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [pieces(model).decode(np.asarray(row.as_py() or [], np.int64)) for row in batch[ids_col]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out_col])

    return encoded.mapInArrow(run, f"{kinds}, `{out_col}` string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: digests of the ids, and of what they decode to.

    As ``decode(encode(docs))``, but both ways in one Python worker.
    """

    def both(texts: list[str]) -> list[pa.Array]:
        ids, counts = encoder(model)(texts)
        ends = np.cumsum(counts)
        decoded = [pieces(model).decode(ids[end - n : end]) for n, end in zip(counts.tolist(), ends.tolist(), strict=True)]
        return [_lists(ids, counts), pa.array(decoded, pa.string())]

    made = _per_slice(docs, id_col, text_col, "ids array<int>, decoded string", both)
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
