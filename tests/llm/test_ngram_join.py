import random

import brute
import numpy as np
import pytest
from conftest import AWKWARD

from stepfall.llm.components import components
from stepfall.llm.ngram_join import drop_near_duplicates, near_duplicates
from stepfall.llm.shingles import shingle_sets
from stepfall.llm.trie import Trie, lengths_fit, overlap_needed


def _corpus(seed, bases=6, copies=12):
    """Copies with few to many edits, fragments, and documents made of a common passage."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("klmnop") + rng.choice("rstuvw")
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(bases):
        base = [word() for _ in range(rng.choice([3, 7, 30, 120, 300]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 9])):
                text[rng.randrange(len(text))] = word()
            texts.append(text[: rng.choice([len(text), len(text), max(1, len(text) - 4)])])
    texts += [passage + [word() for _ in range(rng.randint(0, 12))] for _ in range(15)]
    texts += [[word() for _ in range(rng.randint(1, 80))] for _ in range(20)]
    rng.shuffle(texts)
    return [(i, rng.choice([" ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed, block, elements", [(1, 128, 1000), (2, 128, 1000), (3, 4, 1000), (4, 2, 150), (5, 1, 40), (6, 1, 10**6)])
def test_matches_brute_force(docs, seed, block, elements):
    rows = _corpus(seed)
    found = near_duplicates(docs(rows, 4), block=block, elements=elements)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == brute.near(rows)


def test_chains_reach_the_smallest_id(docs):
    """Neighbours in the chain link, its ends do not."""
    words = [f"w{i}" for i in range(100)]
    rows = [(50 - k, " ".join([*words[k * 4 :], *[f"v{i}" for i in range(k * 4)]])) for k in range(12)]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(rows)).collect()}
    assert got == {doc: component for doc, (_, component) in brute.near(rows).items()}
    assert set(got.values()) == {39}


def test_awkward_rows(awkward):
    rows = near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (7, 5), 6: (7, 5), 7: (5, 7), 8: (5, 7), 9: (5, 9)} | {9: got[9]}
    left = drop_near_duplicates(awkward)
    assert left.columns == awkward.columns
    assert sorted({r.doc_id for r in left.collect()}) == [1, 2, 3, 4, 5, 7, 9]


def test_rows_without_an_id(docs):
    text = " ".join(f"w{i}" for i in range(30))
    got = near_duplicates(docs([(None, text), (2, text), (None, "x y z")])).collect()
    assert sorted((r.component_id or -1) for r in got) == [-1, 2, 2]


def test_empty_table(nothing):
    assert near_duplicates(nothing).collect() == [] and drop_near_duplicates(nothing).collect() == []


def test_shingle_sets():
    doc, value = shingle_sets(["a b c d e f", "A B c  d\te\nf", "a b", None, "", "b a", "x a b c d e f"])
    sets = [frozenset(value[doc == i].tolist()) for i in range(7)]
    assert sets[0] == sets[1] and len(sets[0]) == 2 and sets[0] < sets[6]
    assert len(sets[2]) == 1 and not sets[3] and not sets[4] and sets[2] != sets[5]


def test_trie_finds_what_pairs_show():
    rng = np.random.default_rng(5)
    base = np.sort(rng.choice(10_000, 200, replace=False))
    sets = [np.sort(np.unique(np.where(rng.random(200) < share, base, rng.integers(0, 10_000, 200)))) for share in rng.uniform(0.6, 1, 60)]
    trie = Trie(sets, [len(s) for s in sets])
    for probe in sets[:20]:
        want = {
            i for i, s in enumerate(sets)
            if lengths_fit(len(s), len(probe)) and len(np.intersect1d(s, probe)) >= overlap_needed(len(s), len(probe))
        }
        assert set(trie.similar(probe, len(probe))) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (103, 100), (200, 200)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}
