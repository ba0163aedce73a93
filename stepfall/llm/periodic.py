"""Repeating stretches of words: runs with a period, found scale by scale.

A run of period ``q`` is a longest stretch in which words ``q`` apart are equal; it counts if it has
no smaller period, ``LEAST`` words and ``TIMES`` periods. Periods from ``2^k`` to ``2^(k+1) - 1`` form octave
``k``. An octave puts a boundary after every ``2^k`` words, with a tile of ``2^k`` words before and
``5 * 2^k`` after it; tiles overlap. A run of the octave covers at least one boundary from which the
words ``q`` further on agree for ``2^(k+1)`` words. Hashes of such blocks nominate boundaries and
periods; the Z-function of the tile forward and backward from the boundary decides, tells how
far they agree, and drops multiples of a smaller period. What a tile sees of a run is a
fragment: fragments of one document and period, wherever they were found, are put together to whole runs.

Texts up to ``PANEL`` words are cut and solved where they are read. Of longer ones the
tiles are spread over the cluster: octaves with short tiles share a panel of the text, longer
octaves have panels of their own. Fragments are slim; of the texts, only those with a
fragment, or with spread tiles, move on to the step that lists runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfall.llm.pieces import ranges, text_slices
from stepfall.llm.scratch import settle

#: Words of a text that is solved where it is read, and of a panel.
PANEL = 4096
#: Words and periods that a run has at least.
LEAST, TIMES = 6, 4
#: Tile before and after a boundary, in units of the octave's smallest period, and boundaries of a panel.
BEFORE, AFTER, STRIDE = 1, 5, 8
#: Forward from a boundary, words that agree are counted up to here, in the same units.
REACH = 3
_ROW_BITS = 33


def z_function(items: list[int]) -> list[int]:
    """Of each place, how many items from there agree with those from the start."""
    n = len(items)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and items[k] == items[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def octaves(n_words: int) -> int:
    """How many octaves hold periods that ``n_words`` words can repeat often enough."""
    return (n_words // TIMES).bit_length()


def solve_tile(words: list[int], boundary: int, octave: int, periods: list[int]) -> list[tuple[int, int, int]]:
    """``(period, start, end)``: from ``start`` up to ``end`` words agree with those a period further on, as far as the tile shows."""
    unit = 1 << octave
    ahead = words[boundary : boundary + AFTER * unit]
    forward = z_function(ahead)
    back_from = max(0, boundary - BEFORE * unit)
    behind = words[back_from:boundary][::-1]
    backward = z_function([*behind, -1, *words[back_from : boundary + 2 * unit][::-1]])
    # The place, in the reversed part, of the word before boundary + q.
    last = min(len(words), boundary + 2 * unit) - 1
    at = len(behind) + 1 + last - (boundary - 1)
    best, lag, found = 0, 1, []
    for q in periods:
        while lag < q:
            best = max(best, lag + forward[lag])
            lag += 1
        agree = min(forward[q], REACH * unit)
        if agree >= 2 * unit and best < 2 * q:
            found.append((q, boundary - (min(backward[at - q], BEFORE * unit) if behind else 0), boundary + agree))
    return found


def fragments(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, lowest: int = 0, highest: int = 64, own: tuple[int, int] | None = None) -> list[tuple[int, int, int, int]]:
    """``(text, period, start, end)`` of texts that lie in ``words`` from ``starts`` to ``ends``, by tiles of the given octaves.

    ``own``, for one text that is part of a longer one, are the places whose boundaries count.
    Places are relative to the text; boundaries lie at multiples of the octave's unit.
    """
    found: list[tuple[int, int, int, int]] = []
    most = min(highest, octaves(int((ends - starts).max(initial=0))) - 1)
    code = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    listed: dict[int, list[int]] = {}
    for level in range(most + 1):
        # From here on ``code`` stands for blocks of 2^(level + 1) words.
        further = np.zeros_like(code)
        further[: max(0, len(code) - (1 << level))] = code[1 << level :]
        code = (code ^ code >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + (further ^ further >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
        if level < lowest:
            continue
        unit = 1 << level
        lo = np.zeros(len(starts), np.int64) if own is None else np.full(1, -(-own[0] // unit))
        hi = (ends - starts - 3 * unit) // unit + 1
        if own is not None:
            hi = np.minimum(hi, -(-own[1] // unit))
        count = np.where(ends - starts >= TIMES * unit, np.maximum(0, hi - lo), 0)
        text = np.repeat(np.arange(len(starts)), count)
        at = starts[text] + ranges(lo, count) * unit
        # By slices, so that boundaries times periods stay few.
        step = max(1, (1 << 20) // unit)
        for some in range(0, len(at), step):
            here, of = at[some : some + step], text[some : some + step]
            other = here[:, None] + np.arange(unit, 2 * unit)
            inside = other + 2 * unit <= ends[of][:, None]
            same = inside & (code[np.minimum(other, len(code) - 1)] == code[here][:, None])
            for b in np.flatnonzero(same.any(axis=1)).tolist():
                t = int(of[b])
                if t not in listed:
                    listed[t] = words[starts[t] : ends[t]].tolist()
                periods = (np.flatnonzero(same[b]) + unit).tolist()
                found += [(t, *part) for part in solve_tile(listed[t], int(here[b] - starts[t]), level, periods)]
    return found


def _numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of texts, a number for each word, and where texts begin and end."""
    words = [t.split() for t in texts]  # of bytes, split() parts at the six kinds of ASCII white space
    known: dict[bytes, int] = {}
    flat = np.fromiter((known.setdefault(w, len(known)) for part in words for w in part), np.int64)
    return words, flat, np.cumsum([0, *map(len, words)])


def _joined(parts: list[tuple[int, int, int, int]]) -> dict[int, list[dict[str, int]]]:
    """Fragments by text, those that touch put together."""
    out: dict[int, list[dict[str, int]]] = {}
    for text, period, start, end in sorted(parts):
        mine = out.setdefault(text, [])
        if mine and mine[-1]["period"] == period and start <= mine[-1]["end"]:
            mine[-1]["end"] = max(mine[-1]["end"], end)
        else:
            mine.append({"period": period, "start": start, "end": end})
    return out


_FRAGMENT = pa.struct([("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _scanned(slim: DataFrame, panel: int) -> DataFrame:
    """By row: a digest of the words where nothing repeats, else the text and its fragments, or the text alone if it is long."""
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [("row", pa.int64()), ("doc_id", to_arrow_type(slim.schema["doc_id"].dataType)), ("is_long", pa.bool_()), ("text", pa.string())]
    schema = pa.schema([*fields, ("words_sha256", pa.string()), ("fragments", pa.list_(_FRAGMENT))])
    id_kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << _ROW_BITS
        for batch in text_slices(batches, "text"):
            words, flat, bounds = _numbered(batch["text"].cast(pa.binary()).to_pylist())
            sizes = np.diff(bounds)
            here = np.flatnonzero(sizes <= panel)
            found = _joined(fragments(flat, bounds[:-1][here], bounds[1:][here]))
            parts = {int(here[i]): mine for i, mine in found.items()}
            moves = [i in parts or n > panel for i, n in enumerate(sizes.tolist())]
            digest = [None if m else hashlib.sha256(b" ".join(w)).hexdigest() for m, w in zip(moves, words, strict=True)]
            texts = pa.array([t if m else None for m, t in zip(moves, batch["text"].to_pylist(), strict=True)], pa.string())
            rows = pa.array(np.arange(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            shown = pa.array([parts.get(i) for i in range(batch.num_rows)], pa.list_(_FRAGMENT))
            columns = [rows, batch["doc_id"], pa.array(sizes > panel), texts, pa.array(digest, pa.string()), shown]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    kinds = f"row bigint, doc_id {id_kind}, is_long boolean, text string, words_sha256 string"
    return settle(slim.mapInArrow(run, f"{kinds}, fragments array<struct<period: bigint, start: bigint, end: bigint>>"), "scanned")


def panels(n_words: int, panel: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """``(lowest, highest, own_from, own_to, from, to)``: octaves, places of boundaries, and words of each panel of a text."""
    shared = max(0, (panel // STRIDE).bit_length() - 1)
    for lowest, highest in [(0, shared), *((k, k) for k in range(shared + 1, octaves(n_words)))]:
        unit = 1 << highest
        stride = max(panel, STRIDE * unit)
        for at in range(0, n_words, stride):
            yield lowest, highest, at, at + stride, max(0, at - BEFORE * unit), min(n_words, at + stride + AFTER * unit)


def _spread(long: DataFrame, panel: int) -> DataFrame:
    """``(row, period, start, end)`` of long texts, whose panels are solved anywhere."""
    names = ["lowest", "highest", "own_from", "own_to", "from"]
    schema = pa.schema([("row", pa.int64()), *((name, pa.int64()) for name in names), ("words", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            for row, text in zip(batch["row"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                _, flat, _ = _numbered([text])
                for *place, lo, hi in panels(len(flat), panel):
                    part = {"row": row, **dict(zip(names, (*place, lo), strict=True)), "words": flat[lo:hi].astype("<u4").tobytes()}
                    yield pa.RecordBatch.from_pylist([part], schema)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                words, at = np.frombuffer(p["words"], "<u4").astype(np.int64), p["from"]
                own = p["own_from"] - at, p["own_to"] - at
                parts = fragments(words, np.zeros(1, np.int64), np.array([len(words)]), p["lowest"], p["highest"], own)
                for mine in _joined(parts).values():
                    out += [{"row": p["row"], "period": f["period"], "start": f["start"] + at, "end": f["end"] + at} for f in mine]
            yield pa.RecordBatch.from_pylist(out, pa.schema([(name, pa.int64()) for name in ("row", "period", "start", "end")]))

    kinds = "row bigint, " + ", ".join(f"{name} bigint" for name in names)
    spread = long.select("row", "text").mapInArrow(cut, f"{kinds}, words binary").repartition("row", "highest", "own_from")
    return spread.mapInArrow(solve, "row bigint, period bigint, start bigint, end bigint")


def _stitched(parts: DataFrame) -> DataFrame:
    """Runs ``(row, start, length, period)`` from fragments that touch or overlap."""
    by = Window.partitionBy("row", "period").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = parts.withColumn("opens", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    whole = opened.withColumn("part", F.sum("opens").over(by)).groupBy("row", "period", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start") + F.col("period")
    runs = whole.select("row", "start", length.alias("length"), "period")
    return runs.where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))


def _parts(docs: DataFrame, id_col: str, text_col: str, panel: int) -> tuple[DataFrame, DataFrame]:
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scanned = _scanned(slim, panel)
    near = scanned.where("fragments IS NOT NULL").select("row", F.inline("fragments"))
    return scanned, _stitched(near.unionByName(_spread(scanned.where("is_long"), panel)))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", panel: int = PANEL) -> DataFrame:
    """``(doc_id, start, length, period)``: every run of every text, places and lengths in words.

    NULL and empty texts have none. Equal rows have equal runs each, NULL ids are allowed,
    and other columns are not looked at. Results do not depend on ``panel``.
    """
    scanned, found = _parts(docs, id_col, text_col, panel)
    return scanned.select("row", "doc_id").join(found, "row").drop("row")


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", panel: int = PANEL) -> DataFrame:
    """By row: its runs, the longest of them, and a digest of the text without what runs repeat.

    Returns ``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256)``. A word is left out if some run holds it after the run's first period.
    Of runs of equal length the first, then that of the smallest period, is the longest. NULL
    and empty texts have no run: nulls, and digests of nothing. Repeated rows and NULL ids stay
    rows of their own; an empty table gives no rows.
    """
    scanned, found = _parts(docs, id_col, text_col, panel)
    by_row = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    moved = scanned.where("words_sha256 IS NULL").select("row", "doc_id", "text").join(by_row, "row", "left").drop("row")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            digests = []
            for text, mine in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["runs"].to_pylist(), strict=True):
                words = text.split()
                step = np.zeros(len(words) + 1, np.int64)
                for run in mine or ():
                    step[run["start"] + run["period"]] += 1
                    step[run["start"] + run["length"]] -= 1
                kept = np.flatnonzero(np.cumsum(step)[:-1] == 0)
                digests.append(hashlib.sha256(b" ".join(map(words.__getitem__, kept.tolist()))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["runs"], pa.array(digests, pa.string())], ["doc_id", "runs", "collapsed_sha256"])

    id_kind = scanned.schema["doc_id"].dataType.simpleString()
    run_kind = "array<struct<start: bigint, length: bigint, period: bigint>>"
    listed = moved.mapInArrow(drop, f"doc_id {id_kind}, runs {run_kind}, collapsed_sha256 string")
    calm = scanned.where("words_sha256 IS NOT NULL").select("doc_id", F.lit(None).cast(run_kind).alias("runs"), F.col("words_sha256").alias("collapsed_sha256"))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS back, -r.period AS small)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    best = listed.unionByName(calm).withColumn("best", longest)
    return best.select(
        "doc_id",
        F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.small")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.small")).alias("exponent_milli"),
        F.sha2(F.coalesce(lines, F.lit("")), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def with_repeated_tail(words: Column, seed: Column) -> Column:
    """Of an array with words and a number: from a word on, a stretch repeats to the end; the number sets both."""
    n = F.size(words).cast("long")
    start = seed % F.greatest(n, F.lit(1))
    period = 1 + F.floor((n - start) / (3 + seed % 8))
    tail = F.flatten(F.array_repeat(F.slice(words, (start + 1).cast("int"), period.cast("int")), F.ceil((n - start) / period).cast("int")))
    return F.slice(F.concat(F.slice(words, 1, start.cast("int")), tail), 1, n.cast("int"))
