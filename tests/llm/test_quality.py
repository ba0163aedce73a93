import random

import brute
from conftest import AWKWARD

from stepfall.llm.quality import host_rates, judge, measure

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_measures_match_brute_force(docs):
    rng = random.Random(1)
    parts = ["a", "bb", "c#", "é", "the", "\n", "\n\n", " ", "\t", "x y z v w", "|", "\x1c", " "]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in measure(docs(rows)).collect()}
    assert got == {i: brute.measures(text) for i, text in rows}


def test_hosts_decide(docs):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(20)), "en", "good") for i in range(60)]
    bad = [(100 + i, "too short" if i < 55 else " ".join(f"v{i}x{j}" for j in range(20)), "en", "bad") for i in range(60)]
    tiny = [(300, "short", "en", "tiny"), *[(301 + k, " ".join(f"t{j}" for j in range(20)), "en", f"h{k}") for k in range(20)]]
    rows = {r.doc_id: r for r in judge(docs(good + bad + tiny)).collect()}
    assert all(rows[i].kept for i in range(60))
    assert not any(rows[100 + i].kept for i in range(60)) and not rows[159].base_failed
    assert rows[300].base_failed
    rates = {r.host: r for r in host_rates(measure(docs(good + bad + tiny))).collect()}
    assert rates["tiny"].p_short < 1 and rates["bad"].p_short < rates["bad"].k_short / rates["bad"].n
    assert 0 < rates["good"].p_short < 0.1


def test_awkward_rows(awkward):
    rows = judge(awkward).collect()
    assert len(rows) == len(AWKWARD)
    got = {r.doc_id: r for r in rows}
    for i, text, *_ in AWKWARD:
        assert tuple(got[i][f] for f in FIELDS) == brute.measures(text)
    assert got[1].base_failed and got[2].base_failed and not got[4].kept
    assert got[7].base_failed and got[7].n_repeat_words == got[7].n_words


def test_empty_table(nothing):
    assert judge(nothing).collect() == []
