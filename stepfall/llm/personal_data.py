"""Personal data: fixed patterns as seeds, and identifiers that turn up in the same contexts.

Seeds (addresses, card and phone numbers that match and pass their tests) induce
lexical patterns: the words around them. Other tokens with digits or an ``@`` occur in
patterns too. On the graph of patterns and instances, a pattern's confidence in a kind is
the mean score of its instances, an instance's score the noisy-or of its patterns, seeds
being certain; a few rounds spread the scores. Tokens inside patterns of high
confidence, backed by enough different seeds, become spans of that kind, and seeds of
the next generation, until nothing new is found.

Edges are aggregated before they are joined, so a context or a number that a third of all
documents share is one row per partner. Texts are read once and never moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfall.llm.scratch import settle
from stepfall.llm.text import whole

# The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that began inside a run of digits could have begun at its start, so looking there is enough.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_DIGIT = re.compile(r"[0-9]")
#: Groups of a number written with blanks, after the first, and the first.
_GROUP, _FIRST_GROUP = re.compile(r"[0-9][0-9()./-]*"), re.compile(r"\+?[0-9][0-9()./-]*")
_EDGES = ".,;:!?()[]{}<>\"'|"
#: Characters looked at on either side for context words, and the shortest token that may be an identifier.
REACH, MIN_TOKEN = 80, 5
ROUNDS = 2
#: What a pattern needs: confidence, and different seeds behind it. Instances that say nothing, added to each.
MIN_CONFIDENCE, MIN_SEEDS, DOUBT = 0.9, 5, 0.25

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local part, ``@``, domain; each ``@`` is looked at once, so long runs cost no more."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Seeds by kind, then by start."""
    found = list(_emails(text))
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        parts = [part.lstrip("0") for part in m[0].split(".")]
        if all(len(part) < 4 and int(part or 0) <= 255 for part in parts):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(digits := _digits(m[0])) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def _single(text: str) -> Iterator[tuple[int, int, int, int]]:
    """Tokens with a digit or ``@``: start and end without punctuation at the edges, and with it."""
    done = 0
    for mark in _MARK.finditer(text):
        if mark.start() < done:
            continue
        start = mark.start()
        while start > done and not _SPACE.match(text[start - 1]):
            start -= 1
        space = _SPACE.search(text, mark.start())
        done = end = space.start() if space else len(text)
        left, right = start, end
        while start < end and text[start] in _EDGES:
            start += 1
        while start < end and text[end - 1] in _EDGES:
            end -= 1
        yield start, end, left, right


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Candidates by start: numbers in groups with one blank between, as one, and single tokens, those groups too."""
    run: list[tuple[int, int]] = []
    open_at = -1

    def closed() -> list[tuple[int, int]]:
        whole_run = [(run[0][0], run[-1][1])] if len(run) > 1 else []
        return [(a, b) for a, b in whole_run + run if b - a >= MIN_TOKEN]

    for start, end, left, right in _single(text):
        joins = left == open_at and text[left:start] in ("", "(") and _GROUP.fullmatch(text, start, end)
        if not joins:
            yield from closed()
            run = []
        run.append((start, end))
        goes_on = text[end:right] in ("", ")") and text[right : right + 1] == " " and (joins or _FIRST_GROUP.fullmatch(text, start, end))
        open_at = right + 1 if goes_on else -1
    yield from closed()


def _patterns(text: str, start: int, end: int) -> list[str]:
    """The words around a token: two before, one on either side, two after. Digits do not tell words apart."""
    before = _DIGIT.sub("0", text[max(0, start - REACH) : start].lower()).split()[-2:]
    after = _DIGIT.sub("0", text[end : end + REACH].lower()).split()[:2]
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    if len(after) == 2:
        out.append(f"_ {after[0]} {after[1]}")
    return out


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_MENTION = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("item", pa.string()), ("patterns", pa.list_(pa.string()))])
_SPAN_SQL = "struct<kind:int,start:bigint,end:bigint>"
_MENTION_SQL = "struct<kind:int,start:bigint,end:bigint,item:string,patterns:array<string>>"


def read(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, mentions)`` of rows ``(doc_id, text)``: seeds, and every token that could be an identifier.

    A mention's kind is its seed's, or -1; tokens that overlap a seed are no mentions of their own.
    """
    kind_of = {kind: i for i, kind in enumerate(KINDS)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, mentions = [], []
            for cell in batch["text"]:
                text = cell.as_py()
                spans = base_spans(text)
                own = [
                    {"kind": kind_of[kind], "start": a, "end": b, "item": text[a:b].lower(), "patterns": _patterns(text, a, b)}
                    for kind, a, b in spans
                ]
                taken, at = sorted((a, b) for _, a, b in spans), 0
                for a, b in _tokens(text):
                    while at < len(taken) and taken[at][1] <= a:
                        at += 1
                    if at == len(taken) or b <= taken[at][0]:
                        own.append({"kind": -1, "start": a, "end": b, "item": text[a:b].lower(), "patterns": _patterns(text, a, b)})
                bases.append([{"kind": kind_of[kind], "start": a, "end": b} for kind, a, b in spans])
                mentions.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(bases, pa.list_(_SPAN)), pa.array(mentions, pa.list_(_MENTION))], ["doc_id", "base", "mentions"]
            )

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(scan, f"doc_id {id_kind}, base array<{_SPAN_SQL}>, mentions array<{_MENTION_SQL}>")


def _per_kind(make: object) -> list[Column]:
    return [make(i).alias(f"k{i}") for i in range(len(KINDS))]


def _trusted(edges: DataFrame, rounds: int) -> DataFrame:
    """``(pattern, kind, confidence)`` of the patterns that may discover, from the edges of patterns with a seed."""

    def confidences(scores: DataFrame | None) -> DataFrame:
        # An instance that is a seed anywhere is certain; others have the score of the last round.
        scored = edges if scores is None else edges.join(scores, "item", "left")
        value = lambda i: F.when(F.col("kind") >= 0, (F.col("kind") == i).cast("double")).otherwise(
            F.lit(0.0) if scores is None else F.coalesce(f"s{i}", F.lit(0.0))
        )
        total = scored.groupBy("pattern").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(F.col("kind") >= 0, 1).otherwise(0)).alias("seeds"),
            *_per_kind(lambda i: F.sum(value(i))),
        )
        return settle(total.select("pattern", "seeds", *_per_kind(lambda i: F.col(f"k{i}") / (F.col("n") + DOUBT))), "confidences")

    found = confidences(None)
    for _ in range(rounds):
        unknown = edges.where("kind < 0").join(found, "pattern")
        # 1 - product of (1 - confidence); confidences stay below 1, so the logarithm exists.
        noisy = [(1 - F.exp(F.sum(F.log(1 - F.col(f"k{i}"))))).alias(f"s{i}") for i in range(len(KINDS))]
        found = confidences(settle(unknown.groupBy("item").agg(*noisy), "scores"))
    best = F.greatest(*[F.col(f"k{i}") for i in range(len(KINDS))])
    kind = reduce(lambda out, i: F.when(F.col(f"k{i}") == best, i).otherwise(out), reversed(range(len(KINDS))), F.lit(-1))
    return found.where((best >= MIN_CONFIDENCE) & (F.col("seeds") >= MIN_SEEDS)).select("pattern", kind.alias("kind"), best.alias("confidence"))


def confident_patterns(mentions: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(pattern, kind, confidence)`` of the patterns that may discover; mentions have ``kind``, ``item``, ``patterns``.

    Generations: instances in trusted patterns are seeds of the next one, where the
    patterns around them may become trusted, until no instance is new. Seeds and trusted
    patterns stay what they are.
    """
    every = mentions.select("kind", F.xxhash64("item").alias("item"), F.explode("patterns").alias("pattern"))
    every = settle(every.groupBy("pattern", "item", "kind").count().drop("count"), "every")
    # Patterns without a seed, as yet, cannot be trusted, and only they would make the graph large.
    seeded = settle(every.where("kind >= 0").select("pattern").distinct(), "seeded")
    edges = settle(every.join(seeded, "pattern", "left_semi"), "edges")
    trusted = settle(_trusted(edges, rounds), "trusted")
    fresh, seeds = trusted, None
    while True:
        best = F.max(F.struct("confidence", F.col("kind_").alias("kind")))["kind"].alias("as")
        new = edges.where("kind < 0").join(fresh.withColumnRenamed("kind", "kind_"), "pattern").groupBy("item").agg(best)
        new = settle(new if seeds is None else new.join(seeds, "item", "left_anti"), "new")
        if new.isEmpty():
            return trusted
        seeds = new if seeds is None else settle(seeds.unionByName(new), "seeds")
        induced = every.where("kind < 0").join(new, "item", "left_semi").select("pattern")
        seeded = settle(seeded.unionByName(induced).distinct(), "seeded")
        kind = F.when(F.col("kind") >= 0, F.col("kind")).otherwise(F.coalesce("as", F.lit(-1)))
        edges = every.join(seeded, "pattern", "left_semi")
        seen = settle(edges.join(seeds, "item", "left").select("pattern", "item", kind.alias("kind")).distinct(), "seen")
        edges = settle(edges, "edges")
        fresh = settle(_trusted(seen, rounds).join(trusted.select("pattern"), "pattern", "left_anti"), "fresh")
        trusted = settle(trusted.unionByName(fresh), "trusted")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, spans)`` for every row; a span is ``(kind, start, end, base)``, offsets in code points, end exclusive.

    Base spans are the seeds, leftmost and without overlap per kind; the others were
    discovered by context; a number in groups and a group of it may both be. Spans come by kind as in ``KINDS``, then by start. NULL and empty
    texts have none. Repeated rows are rows of their own, ids may be NULL, an empty table
    gives no rows, and other columns are not looked at.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    scanned = settle(read(slim).withColumn("row", F.monotonically_increasing_id()), "scanned")
    mentions = scanned.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    trusted = settle(confident_patterns(mentions, rounds), "trusted")
    unseen = mentions.where("kind < 0").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    hits = unseen.join(trusted, "pattern").groupBy("row", "start", "end").agg(F.max(F.struct("confidence", F.col("kind"))).alias("best"))
    span = F.struct(F.col("best.kind").alias("kind"), "start", "end", F.lit(False).alias("base"))
    new = hits.select("row", span.alias("span")).groupBy("row").agg(F.collect_list("span").alias("new"))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean>>")
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(True).alias("base")))
    every = F.sort_array(F.concat(base, F.coalesce("new", none)))
    names = F.array(*map(F.lit, KINDS))
    named = lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))
    return scanned.select("row", "doc_id", "base").join(new, "row", "left").select("doc_id", F.transform(every, named).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base spans per kind, of those discovered beside them and of all, the digest of the base spans' list, and the list of all spans."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [of(kind).alias(f"n_{kind}") for kind in KINDS]
    every = F.size("spans").cast("long")
    counts += [(every - F.size(base)).alias("n_discovered"), every.alias("n_spans")]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
