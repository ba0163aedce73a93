"""Similarity join of documents on five-word shingles: which documents are connected by links.

Two documents link when their shingle sets have a Jaccard similarity of 0.8 or more.

1. *Global order.* Shingles are ordered by how many documents hold them, rarest
   first. Chunks of documents send Golomb-coded fingerprints of their shingles to
   owners, which return the order of magnitude of each count.
2. *Prefixes.* A set of n elements can only link to one that shares an element of
   its first n - ceil(0.8 n) + 1. If all of those are in no other document, the
   document has no partner; this drops all but copies and documents made of
   common passages. The rest go on as their shared shingles, in global order.
3. *Stars.* Equal sets are one node. For each prefix element, its nodes are
   compared with one of them, the leader; comparisons of one leader are a walk
   through the prefix tree of the others, in blocks of bounded size.
4. *The rest.* Where an element's nodes do not lie in one component yet, they are
   compared with each other across components, again in blocks of bounded size.

Steps 3 and 4 test every pair that shares a prefix element, except pairs that are
connected already or whose sizes rule a link out, so the components are exact. Nothing
is capped.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfall.llm import golomb
from stepfall.llm.components import components
from stepfall.llm.scratch import id_of, maybe_in, row_key, settle, shuffle_partitions
from stepfall.llm.shingles import shingle_sets
from stepfall.llm.trie import Trie

#: Characters of text meant to be in one chunk, and shingles meant to be with one owner.
CHUNK_CHARS = 4_000_000
OWNER_SHINGLES = 4_000_000
#: Nodes compared with a leader in one block, and set elements in one part of a larger group.
BLOCK, PART_ELEMENTS = 128, 1 << 16
SPARE_BITS = 8
_LEVEL_SHIFT, _MAX_LEVEL = 59, 15


def _prefix_length(n: np.ndarray) -> np.ndarray:
    return n + (-4 * n // 5) + 1


def _levels(counts: np.ndarray) -> np.ndarray:
    """0 for elements of one document, then the order of magnitude of the number of documents."""
    return np.minimum(_MAX_LEVEL, np.ceil(np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def ordered_sets(docs: DataFrame, chunk_chars: int = CHUNK_CHARS, owner_shingles: int = OWNER_SHINGLES) -> DataFrame:
    """``(doc_id, n, digest, alone, items)`` per row of ``docs`` (``doc_id``, ``text``).

    ``items`` are the shared elements in global order, NULL where no partner is
    possible; ``alone`` counts the elements of no other document.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(shuffle_partitions(spark), int(chars // chunk_chars) + 1)
    expected = max(1, int(chars) // 5)
    bits = min(63, expected.bit_length() + SPARE_BITS)
    owner_bits = (max(shuffle_partitions(spark), expected // owner_shingles) - 1).bit_length()
    low_bits = max(0, bits - owner_bits)

    def elements(chunk: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts, offset = [], 0
        for at in range(0, len(chunk), 256):
            texts = chunk["text"].iloc[at : at + 256]
            doc, value = shingle_sets(texts)
            parts.append((doc + offset, value))
            offset += len(texts)
        doc, value = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        return doc, value, value >> np.uint64(64 - bits)

    def send(chunk: pd.DataFrame) -> pd.DataFrame:
        _, _, prints = elements(chunk)
        values, counts = np.unique(prints, return_counts=True)
        owners = (values >> np.uint64(low_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owners, prepend=-1))
        codes = [golomb.encode(v, int(owners[at]) << low_bits) for at, v in zip(cuts, np.split(values, cuts[1:]), strict=True)] if len(cuts) else []
        held = np.minimum(counts, 65535).astype(np.uint16)
        held = [zlib.compress(c.tobytes(), 1) for c in np.split(held, cuts[1:])] if len(cuts) else []
        return pd.DataFrame({"owner": owners[cuts], "chunk": int(chunk["chunk"].iloc[0]), "code": codes, "held": held})

    def answer(key: tuple, sent: pd.DataFrame) -> pd.DataFrame:
        base = int(key[0]) << low_bits
        lists = [golomb.decode(code, base) for code in sent["code"]]
        held = np.concatenate([np.frombuffer(zlib.decompress(h), np.uint16) for h in sent["held"]])
        values, where = np.unique(np.concatenate(lists), return_inverse=True)
        levels = _levels(np.bincount(where, weights=held, minlength=len(values)))[where]
        cuts = np.cumsum([len(v) for v in lists])[:-1]
        return pd.DataFrame(
            {"owner": key[0], "chunk": sent["chunk"], "levels": [zlib.compress(x.tobytes(), 1) for x in np.split(levels, cuts)]}
        )

    def order(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        size = len(chunk)
        if not size:
            return pd.DataFrame(columns=["doc_id", "n", "digest", "alone", "items"])
        doc, value, prints = elements(chunk)
        n = np.bincount(doc, minlength=size)
        answers = answers.sort_values("owner")
        levels = np.frombuffer(b"".join(map(zlib.decompress, answers["levels"])), np.uint8)
        _, where = np.unique(prints, return_inverse=True)
        level = levels[where] if len(levels) else np.empty(0, np.uint8)
        alone = np.bincount(doc[level == 0], minlength=size)
        keys = ((level.astype(np.uint64) << np.uint64(_LEVEL_SHIFT)) | (value >> np.uint64(64 - _LEVEL_SHIFT))).astype(np.int64)
        ends = np.cumsum(n)
        digests, items = [None] * size, [None] * size
        for d in np.flatnonzero((n > 0) & (alone < _prefix_length(n))):
            own = slice(ends[d] - n[d], ends[d])
            digests[d] = hashlib.blake2b(value[own].tobytes(), digest_size=16).digest()
            items[d] = np.sort(keys[own][level[own] > 0])
        return pd.DataFrame({"doc_id": chunk["doc_id"], "n": n, "digest": digests, "alone": alone, "items": items})

    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    chunked = docs.withColumn("chunk", F.pmod(spread, F.lit(chunks)).cast("int"))
    codes = chunked.groupBy("chunk").applyInPandas(send, "owner long, chunk int, code binary, held binary")
    answers = codes.groupBy("owner").applyInPandas(answer, "owner long, chunk int, levels binary")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n long, digest binary, alone long, items array<bigint>"
    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(order, schema)


def _nodes(sets: DataFrame) -> DataFrame:
    """One row per distinct set that may have a partner. Smaller node numbers have fewer elements of their own."""
    one = sets.where("items IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.first(F.struct("n", "alone", "items")).alias("own")
    )
    row = F.monotonically_increasing_id()
    number = (
        F.shiftleft(F.least(F.col("own.alone"), F.lit(4095)), 51)
        + F.shiftleft(F.shiftrightunsigned(row, 33), 29)
        + row.bitwiseAND((1 << 33) - 1)
    )
    return one.select("digest", "first_id", number.alias("node"), "own.n", "own.alone", "own.items")


def _prefixes(nodes: DataFrame) -> DataFrame:
    """``(item, node)`` for the elements of each node's prefix that other documents hold."""
    length = F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1 - F.col("alone")
    return nodes.select("node", F.explode(F.slice("items", F.lit(1), length.cast("int"))).alias("item"))


def _blocks_of(pairs: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """Sets to compare: each ``leader``'s members in blocks, the leader's own set in every one of them."""
    counts = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    counts = settle(counts, "leaders")
    salted = pairs.join(counts, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("salt"), "node")
    own = counts.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("salt"), F.col("leader").alias("node"))
    return salted.unionByName(own).join(nodes.select("node", "n", "items"), "node")


def _star_links(block: pd.DataFrame) -> pd.DataFrame:
    """Links between a leader and the members of one of its blocks."""
    leads = (block["node"] == block["leader"]).to_numpy()
    lead, rest = block[leads].iloc[0], block[~leads]
    trie = Trie([np.asarray(x, np.int64) for x in rest["items"]], rest["n"].tolist())
    found = trie.similar(np.asarray(lead["items"], np.int64), int(lead["n"]))
    return pd.DataFrame({"a": lead["node"], "b": rest["node"].to_numpy()[found]})


def _cross_links(block: pd.DataFrame) -> pd.DataFrame:
    """Links between a block's probes and its targets that connect different components."""
    probes, targets = block[block["probe"]], block[~block["probe"]]
    sets = [np.asarray(x, np.int64) for x in targets["items"]]
    trie, names, out = Trie(sets, targets["n"].tolist()), targets["node"].to_numpy(), []
    label = targets["comp"].to_numpy().copy()
    joined: dict[int, int] = {}
    for node, comp, n, items in zip(probes["node"], probes["comp"], probes["n"], probes["items"], strict=True):
        own = joined.get(comp, comp)
        for j in trie.similar(np.asarray(items, np.int64), int(n), set(np.flatnonzero(label == own).tolist())):
            out.append((node, names[j]))
            gone = label[j]
            label[label == gone] = own
            joined |= {c: own for c, now in joined.items() if now == gone} | {int(gone): own}
    return pd.DataFrame(out, columns=["a", "b"])


def _can_link(n: Column, alone: Column, m: Column, other_alone: Column) -> Column:
    """Sizes that allow a link: elements of one document are in no intersection."""
    shared = F.least(n - alone, m - other_alone)
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * shared >= 4 * (n + m))


def _feasible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    own = nodes.select("node", "n", "alone")
    lead = nodes.select(F.col("node").alias("leader"), F.col("n").alias("m"), F.col("alone").alias("m_alone"))
    sized = pairs.join(own, "node").join(lead, "leader")
    return sized.where(_can_link(*map(F.col, ("n", "alone", "m", "m_alone")))).select("leader", "node")


def _compared(pairs: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """The links among ``(leader, node)`` pairs."""
    return _blocks_of(pairs, nodes, block).groupBy("leader", "salt").applyInPandas(_star_links, "a long, b long")


def _rest(prefixes: DataFrame, nodes: DataFrame, labels: DataFrame, block: int, elements: int) -> DataFrame:
    """Links across components between nodes that share a prefix element.

    Elements with the same nodes are looked at once. Up to ``block`` nodes, pairs whose
    sizes allow a link are compared. In larger groups most nodes are of one component as a
    rule; the others are probes, and every node is a target. Probes and targets are dealt to
    parts of about ``elements`` set elements, and each part of probes is searched for in each
    part of targets, so no pairs are made of them.
    """
    held = settle(prefixes.join(labels, "node").join(nodes.select("node", "n", "alone"), "node"), "held")
    mixed = held.groupBy("item").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size"),
        F.bit_xor(F.xxhash64("node")).alias("who"), F.sum(F.xxhash64("node", F.lit(1)).bitwiseAND((1 << 40) - 1)).alias("who_too"),
    ).where("low < high")
    once = settle(mixed.groupBy("who", "who_too", "size").agg(F.min("item").alias("item")).select("item", "size"), "mixed")
    few = settle(held.join(once.where(F.col("size") <= block).select("item"), "item"), "few")
    other = few.select("item", *[F.col(c).alias(f"o_{c}") for c in ("node", "comp", "n", "alone")])
    cross = (F.col("node") < F.col("o_node")) & (F.col("comp") != F.col("o_comp"))
    near = few.join(other, (few["item"] == other["item"]) & cross & _can_link(*map(F.col, ("n", "alone", "o_n", "o_alone"))))
    pairs = settle(near.select(F.col("node").alias("leader"), F.col("o_node").alias("node")).distinct(), "pairs")
    found = _compared(pairs, nodes, block)

    many = settle(held.join(once.where(F.col("size") > block).select("item"), "item"), "many")
    weight = F.sum(F.col("n") - F.col("alone")).alias("weight")
    by_comp = many.groupBy("item", "comp").agg(F.count(F.lit(1)).alias("size"), weight)
    most = F.max(F.struct("size", "comp", "weight")).alias("most")
    dealt = by_comp.groupBy("item").agg(most, F.sum("weight").alias("weight")).select(
        "item",
        F.col("most.comp").alias("main"),
        F.ceil((F.col("weight") - F.col("most.weight") + 1) / elements).alias("probe_parts"),
        F.ceil(F.col("weight") / elements).alias("target_parts"),
    )
    placed = many.join(settle(dealt, "dealt"), "item").withColumn("hash", F.xxhash64("node", F.lit(2)))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    columns = ["item", "node", "comp"]
    targets = placed.select(*columns, F.lit(False).alias("probe"), every("probe_parts").alias("p"), F.pmod("hash", "target_parts").alias("t"))
    probes = placed.where("comp <> main").select(
        *columns, F.lit(True).alias("probe"), F.pmod("hash", "probe_parts").alias("p"), every("target_parts").alias("t")
    )
    sets = targets.unionByName(probes).join(nodes.select("node", "n", "items"), "node")
    return found.unionByName(sets.groupBy("item", "p", "t").applyInPandas(_cross_links, "a long, b long"))


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links).withColumnRenamed("node", "known")
    return nodes.select("node").join(found, F.col("node") == F.col("known"), "left").select("node", F.coalesce("comp", "node").alias("comp"))


def connected(nodes: DataFrame, block: int = BLOCK, elements: int = PART_ELEMENTS) -> DataFrame:
    """``(node, comp)`` for every node."""
    prefixes = settle(_prefixes(nodes), "prefixes")
    leaders = prefixes.groupBy("item").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last")
    leaders = settle(leaders.select("item", "leader"), "leaders")
    pairs = prefixes.join(leaders, "item").where("node <> leader").select("leader", "node").distinct()
    pairs = settle(_feasible(settle(pairs, "pairs"), nodes), "feasible")
    stars = settle(_compared(pairs, nodes, block), "stars")
    labels = settle(_labels(nodes, stars), "labels")
    shared = prefixes.join(leaders.select("item"), "item", "left_semi")
    rest = settle(_rest(shared, nodes, labels, block, elements), "rest")
    if rest.isEmpty():
        return labels
    return _labels(nodes, stars.unionByName(rest))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, elements: int = PART_ELEMENTS, **sizes: int
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest id that links reach, the row's own included.
    Texts without words, and NULL, have no shingles and link to nothing; texts of
    fewer than five words are one shingle. Rows are nodes and ids only name them:
    rows that repeat an id are compared like others, and NULL ids name nothing. An
    empty table gives no rows; other columns are not looked at.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = settle(ordered_sets(slim, **sizes), "sets")
    nodes = settle(_nodes(sets), "nodes")
    labels = connected(nodes, block, elements)
    named = nodes.join(labels, "node").select("digest", "first_id", "comp")
    named = settle(named, "named")
    smallest = settle(named.groupBy("comp").agg(F.min("first_id").alias("component_id")), "smallest")
    ids = settle(named.join(smallest, "comp").select("digest", "component_id"), "ids")
    # Most rows have no digest; they are no keys of the join, which would send them all to one task.
    alone = sets.where("digest IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    linked = sets.where("digest IS NOT NULL").select("doc_id", "n", "digest").join(ids, "digest").drop("digest")
    return alone.unionByName(linked).withColumnRenamed("n", "n_shingles")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group that links connect: that of the smallest id.

    NULL ids come last; of texts with the same id, the one with the smallest digest stays,
    and of rows that repeat both, one. Rows without words link to nothing and stay.
    """
    keyed = docs.withColumn("_sf_row", row_key(id_col, text_col))
    found = settle(near_duplicates(keyed, "_sf_row", text_col).where("n_shingles > 0"), "found")
    own = id_of(F.col("doc_id"), docs.schema[id_col].dataType)
    first = F.min(F.struct(own.isNull().alias("none"), own.alias("id"), F.col("doc_id").alias("row"))).alias("first")
    groups = found.groupBy("component_id").agg(first, F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = settle(groups.select("component_id", F.col("first.row").alias("keep")), "groups")
    hit = found.join(groups, "component_id").select(F.col("doc_id").alias("_sf_key"), (F.col("doc_id") == F.col("keep")).alias("_sf_stays"))
    hit = settle(hit.distinct(), "hit")
    marked = maybe_in(keyed, F.col("_sf_row"), hit.select("_sf_key"))
    near = (
        marked.where("_sf_maybe")
        .join(hit, F.col("_sf_row") == F.col("_sf_key"), "left")
        .where("_sf_stays IS NULL OR _sf_stays")
        .withColumn("_sf_n", F.when(F.col("_sf_stays"), F.lit(-1)).otherwise(F.monotonically_increasing_id()))
        .dropDuplicates(["_sf_row", "_sf_n"])
    )
    return marked.where("NOT _sf_maybe").select(*docs.columns).unionByName(near.select(*docs.columns))
