import hashlib
import random

import brute
from conftest import AWKWARD

from stepfall.llm import personal_data as pii

PARTS = ["a", "@", ".", "1", "22", "333", "+", "-", " ", "(", ")", "b.c", "_", "4111111111111111", "%", "1.2.3.4", "x@y.z", "٣", "\n"]


def test_base_spans_match_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == brute.personal(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "@" * 300_000, "1." * 100_000, "+1 " * 100_000, "1..1" * 50_000):
        pii.base_spans(text)
        list(pii._tokens(text))


def test_digests(docs):
    rows = [(1, "mail a@b.cd or 10.0.0.1"), (2, "nothing"), (3, None), (4, "é +1 555 010 0000, x@y.zz")]
    got = {r.doc_id: r for r in pii.digests(pii.find(docs(rows))).collect()}
    for i, text in rows:
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in brute.personal(text or ""))
        assert got[i].spans == listed and got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert got[i].n_discovered == 0 and got[i].n_spans == len(brute.personal(text or ""))
    assert (got[1].n_email, got[1].n_ip, got[4].n_phone, got[4].n_card) == (1, 1, 1, 0)


def test_contexts_of_seeds_discover_others(docs):
    seeds = [(i, f"text {i} please call me at +1 555 010 {1000 + i} any time soon ok") for i in range(40)]
    hidden = [(100, "text please call me at 0171-4711-99 any time soon ok"), (101, "chapter 12345 of the book has 99999 words in it")]
    counts = {r.doc_id: (r.n_phone, r.n_discovered, r.n_spans) for r in pii.digests(pii.find(docs(seeds + hidden))).collect()}
    assert counts[100] == (0, 1, 1) and counts[101] == (0, 0, 0) and counts[7] == (1, 0, 1)
    got = {r.doc_id: r.spans for r in pii.find(docs(seeds + hidden)).collect()}
    start = hidden[0][1].index("0171")
    assert [(s.kind, s.start, s.end, s.base) for s in got[100]] == [("phone", start, start + 12, False)]
    assert got[101] == [] and all(len(got[i]) == 1 and got[i][0].base for i in range(40))


def test_discovered_identifiers_are_seeds_of_the_next_generation(docs):
    """Numbers found beside seeds lead to contexts that no seed has, and those to further numbers and contexts."""
    number = lambda k, i: f"0{k}71-47{i:02}-99"
    rows = [(i, f"text please call me at +1 555 010 {1000 + i} any time soon ok") for i in range(200)]
    rows += [(300 + i, f"text please call me at {number(1, i)} any time soon ok") for i in range(8)]
    rows += [(400 + i, f"my own line is {number(1, i)} since last year") for i in range(8)]
    rows += [(500, f"my own line is {number(2, 0)} since last year"), (600, f"chapter of book {number(3, 0)} has many words")]
    got = {r.doc_id: [(s.kind, s.base) for s in r.spans] for r in pii.find(docs(rows)).collect()}
    assert all(got[i] == [("phone", False)] for i in (*range(300, 308), *range(400, 408), 500))
    assert got[600] == []


def test_numbers_in_groups_are_one_candidate(docs):
    text = "a 0171 4711 99, or (030) 12 34 x 1 2, 3 +49 17 +49 18 a@bc.d 12345 678"
    assert [text[a:b] for a, b in pii._tokens(text)] == ["0171 4711 99", "030) 12 34", "+49 17", "+49 18", "a@bc.d", "12345 678", "12345"]
    seeds = [(i, f"text {i} please call me at +1 555 010 {1000 + i} any time soon ok") for i in range(40)]
    hidden = (100, "text please call me at 0171 4711 99 any time soon ok")
    spans = {r.doc_id: r.spans for r in pii.find(docs([*seeds, hidden])).collect()}[100]
    assert [(s.kind, hidden[1][s.start : s.end]) for s in spans] == [("phone", "0171 4711 99")]


def test_few_seeds_are_no_evidence(docs):
    rows = [(1, "call me at +1 555 010 1000 any time"), (2, "call me at 0171-4711-99 any time")]
    assert {r.doc_id: len(r.spans) for r in pii.find(docs(rows)).collect()} == {1: 1, 2: 0}


def test_awkward_rows(awkward, nothing):
    rows = pii.digests(pii.find(awkward)).collect()
    assert len(rows) == len(AWKWARD)
    nine = next(r for r in rows if r.doc_id == 9)
    assert (nine.n_email, nine.n_ip, nine.n_card, nine.n_phone) == (1, 0, 1, 1)
    assert pii.find(nothing).collect() == []
