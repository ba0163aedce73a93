import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from conftest import AWKWARD
from tokenizers import Tokenizer

from stepfall.llm import alignment
from stepfall.llm.jobs import QUERIES

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.MODEL))
PARTS = ["a", "the", " ", "  ", "\n", "'s", "ing", "é", "漢字", "🙂", "123", "<|endoftext|>", "</s>", "\t", "!!", " the", "x" * 7, "　", "\x85", "_"]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _unicode():
    """The bytes that the entries of a byte-level vocabulary write as characters."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


CODE = _unicode()
A_BYTES = {i: bytes(CODE[c] for c in entry) for entry, i in A.get_vocab().items() if entry != "<|endoftext|>"}


def _b_bytes(i):
    name = B.id_to_piece(i)
    return bytes([int(name[1:-1], 16)]) if B.is_byte(i) else name.replace("▁", " ").encode()


def _tokens(text):
    a, b = (A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)) if text else ([], [])
    whole = (" " + (text or "")).encode()
    if not text or any(b"".join(x) != whole for x in ([A_BYTES[i] for i in a], [_b_bytes(i) for i in b])):
        return [], []
    return a, b


def _spans(ids, raw):
    at, out = 0, []
    for i in ids:
        out.append((i, at, at + len(raw(i))))
        at = out[-1][2]
    return out


def _aligned(text):
    """Groups and links of one text, by comparing all tokens."""
    a, b = _tokens(text)
    a, b = _spans(a, A_BYTES.__getitem__), _spans(b, _b_bytes)
    ends = sorted({e for *_, e in a} & {e for *_, e in b})
    groups = [([i for i, _, e in a if lo < e <= hi], [i for i, _, e in b if lo < e <= hi]) for lo, hi in zip([0, *ends], ends, strict=False)]
    links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
    return len(a), len(b), groups, links


def _want(rows):
    found = [(doc, *_aligned(text)) for doc, text in rows]
    counts = Counter(pair for *_, links in found for pair in set(links))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for doc, n_a, n_b, groups, links in found:
        listed = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(listed.encode()).hexdigest() if groups else ""
        out.append((doc, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def _texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ranks_stand_for_the_vocabulary_with_merges():
    """Merging by the ranks of the merged bytes and by the listed merges is the same if every entry comes out of its own bytes."""
    both = alignment.sides(alignment.RANKS, alignment.MODEL)
    assert {i: t for i, t in enumerate(both.a_bytes)} == A_BYTES
    for i, entry in ((i, e) for e, i in A.get_vocab().items() if i in A_BYTES):
        made = A.model.tokenize(entry)
        assert [t.id for t in made] == [i]


def test_both_split_at_the_same_characters():
    codec: tiktoken.Encoding = alignment.sides(alignment.RANKS, alignment.MODEL).codec
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 2000):
        # A letter, a digit, a sign or white space joins other neighbours each.
        text = "".join(f"a{chr(c)}b1{chr(c)}2.{chr(c)}, {chr(c)} " for c in points[at : at + 2000])
        assert codec.encode_ordinary(text) == A.encode(text, add_special_tokens=False).ids


def test_pointers_end_at_the_last_token_of_a_group():
    rng = random.Random(4)
    for _ in range(300):
        total = rng.randint(1, 60)
        a, b = (np.array([*sorted(rng.sample(range(1, total), rng.randint(0, total - 1))), total]) for _ in "ab")
        common = np.intersect1d(a, b)
        by_a, by_b = alignment.group_ends(a, b)
        last = lambda ends: [int(np.searchsorted(b, common[np.searchsorted(common, e)])) for e in ends]
        assert by_a.tolist() == last(a) and by_b.tolist() == last(b)


def test_matches_brute_force(docs):
    rows = list(enumerate([*_texts(5, 120), "a▁b", "▁", " ", "the " * 300, "漢" * 200, None, ""]))
    want = _want(rows)
    for chunk_bytes in (1, 2000, alignment.CHUNK_BYTES):
        assert _got(alignment.measures(docs(rows), chunk_bytes=chunk_bytes)) == want


def test_groups_and_counts(docs):
    rows = list(enumerate(_texts(6, 40)))
    got = {r.doc_id: [(list(g.a), list(g.b)) for g in r.groups] for r in alignment.groups(docs(rows)).collect()}
    assert got == {i: _aligned(t)[2] for i, t in rows}
    counts = Counter(pair for _, t in rows for pair in set(_aligned(t)[3]))
    found = alignment.pair_counts(docs(rows)).collect()
    assert {(r.a, r.b): r["count"] for r in found} == counts
    best = {a: max(n for (x, _), n in counts.items() if x == a) for a, _ in counts}
    assert all(r.best == (r["count"] == best[r.a]) for r in found)


def test_awkward_rows(awkward, nothing, docs):
    short = [(i, t) for i, t, *_ in AWKWARD if len(t or "") < 10_000]
    assert _got(alignment.measures(awkward.where("text IS NULL OR length(text) < 10000"))) == _want(short)
    long = {r.doc_id: r for r in alignment.measures(awkward).collect()}[7]
    assert (long.n_a, long.n_b) == tuple(map(len, _tokens(AWKWARD[7][1]))) and long.n_links == long.n_a + long.n_b - long.n_groups
    assert alignment.measures(nothing).collect() == [] == alignment.groups(nothing).collect()
    rows = [(None, "the end"), (None, "the end"), (None, None), (4, "the"), (4, "end of it")]
    assert _got(alignment.measures(docs(rows))) == _want(rows)


def test_the_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: r for r in _got(QUERIES["op12_tokenizer_alignment"](spark, small))}
    short = [(i, t) for i, t in rows if len(t or "") < 2500]
    assert sorted(got) == sorted(i for i, _ in rows)
    for doc, text in short:
        n_a, n_b, groups, links = _aligned(text)
        listed = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        assert got[doc][1:5] == (n_a, n_b, len(groups), len(links)) and got[doc][7] == (hashlib.sha256(listed.encode()).hexdigest() if groups else "")
