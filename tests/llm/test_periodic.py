import hashlib
import random
import zlib

import numpy as np
import pytest
from brute import words
from conftest import AWKWARD
from pyspark.sql import functions as F

from stepfall.llm import periodic
from stepfall.llm.jobs import QUERIES


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _runs(found):
    """Every period tried at every place; of equal stretches, the one with the smallest period."""
    n, smallest = len(found), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if found[i] != found[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and found[j] == found[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                smallest.setdefault((i, j + q), q)
            i = j
    return sorted((i, j - i, q) for (i, j), q in smallest.items())


def _want(doc, found):
    runs = _runs(found)
    gone = {w for s, length, q in runs for w in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return doc, len(runs), *best, milli, _sha(listed), _sha(" ".join(w for i, w in enumerate(found) if i not in gone))


def _got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _planted(doc, found):
    """As the contract of the query says."""
    h = zlib.crc32(str(doc).encode())
    n, g = len(found), h // 10
    if h % 10 or not n:
        return found
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else found[a + (i - a) % p] for i, w in enumerate(found)]


def _texts(seed, count=150):
    """Texts over few words, with powers of random blocks, nested ones among them."""
    rng = random.Random(seed)
    for _ in range(count):
        out = []
        while len(out) < rng.choice([0, 5, 40, 300]):
            block = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 12))]
            if rng.random() < 0.3:
                block = block * rng.randint(2, 6) + ["z"]
            out += block * rng.choice([1, 2, 4, 5, 9]) + block[: rng.randint(0, len(block))]
        yield " ".join(out)


def test_z_function():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randint(0, 1) for _ in range(rng.randint(0, 40))]
        assert periodic.z_function(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


@pytest.mark.parametrize("panel", [8, 64, 4096])
def test_matches_brute_force(docs, panel):
    rows = list(enumerate(_texts(2)))
    assert _got(periodic.collapsed(docs(rows), panel=panel)) == sorted((_want(i, words(t)) for i, t in rows), key=str)


def test_long_texts(docs):
    rng = random.Random(3)
    noise = lambda n: [str(rng.randint(0, 10**6)) for _ in range(n)]
    block = noise(1300)
    rows = [(1, " ".join(["same"] * 9000)), (2, " ".join(noise(500) + block * 5 + noise(3000))), (3, " ".join(["a", "b"] * 5000 + noise(7000)))]
    rows.append((4, " ".join(noise(11_000))))
    want = {1: [(0, 9000, 1)], 2: [(500, 6500, 1300)], 3: [(0, 10_000, 2)], 4: []}
    got = {i: [] for i, _ in rows}
    for r in periodic.runs(docs(rows), panel=1024).collect():
        got[r.doc_id].append((r.start, r.length, r.period))
    assert got == want


def test_panels_hold_every_boundary_once():
    for n, panel in ((1, 64), (5000, 64), (12_345, 1024)):
        seen = set()
        for lowest, highest, lo, hi, start, end in periodic.panels(n, panel):
            for octave in range(lowest, highest + 1):
                unit = 1 << octave
                for c in range(-(-lo // unit) * unit, min(hi, n), unit):
                    assert (octave, c) not in seen and start <= max(0, c - unit) and end >= min(n, c + 5 * unit)
                    seen.add((octave, c))
        assert {(o, c) for o in range(periodic.octaves(n)) for c in range(0, n, 1 << o)} <= seen


def test_words_and_planted_tails(docs):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 37))) for i in range(400)]
    seed = F.floor(F.crc32(F.col("doc_id").cast("string")) / 10)
    df = docs(rows).withColumn("words", F.split("text", " ")).where("text <> ''")
    got = {r.doc_id: r.out for r in df.select("doc_id", periodic.with_repeated_tail(F.col("words"), seed).alias("out")).collect()}
    for i, text in rows:
        if text and zlib.crc32(str(i).encode()) % 10 == 0:
            assert got[i] == _planted(i, text.split(" "))


def test_awkward_rows(awkward, nothing, docs):
    assert _got(periodic.collapsed(awkward, panel=64)) == sorted((_want(i, words(t)) if len(t or "") < 10**5 else _long(i) for i, t, *_ in AWKWARD), key=str)
    assert periodic.collapsed(nothing).collect() == [] == periodic.runs(nothing).collect()
    rows = [(None, "x " * 9), (None, "x " * 9), (None, "y"), (2, "x " * 9), (2, "a b")]
    assert _got(periodic.collapsed(docs(rows))) == sorted((_want(i, words(t)) for i, t in rows), key=str)


def _long(doc):
    """150,000 words with period five."""
    return doc, 1, 0, 150_000, 5, 30_000_000, _sha("0,150000,5\n"), _sha("lorem ipsum dolor sit amet")


def test_the_query(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((_want(r.doc_id, _planted(r.doc_id, words(r.text))) for r in rows), key=str)
    got = _got(QUERIES["op11_periodic_runs"](spark, small))
    assert got == want and sum(r[1] for r in got) > 10


def test_work_is_even_on_one_repeated_word():
    found = periodic.fragments(np.zeros(20_000, np.int64), np.zeros(1, np.int64), np.array([20_000]))
    assert {q for _, q, _, _ in found} == {1} and len(found) <= 20_000
