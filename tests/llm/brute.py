"""Plain Python forms of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

import tiktoken

from stepfall.llm import bpe

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def one_spaced(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def exact(rows):
    """``{doc_id: (keep_id, group_size, sha)}`` for unique ids."""
    groups = {}
    for doc, text in rows:
        groups.setdefault(one_spaced(text), []).append(doc)
    return {d: (min(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for d in ids}


def shingles(text):
    found = (text or "").encode().lower().split()
    if len(found) < 5:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def near(rows):
    """``{doc_id: (n_shingles, component_id)}``, every pair compared."""
    sets = [(doc, shingles(text)) for doc, text in rows]
    up = {doc: doc for doc, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if x and y and 100 * both >= 80 * (len(x) + len(y) - both):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {doc: (len(s), top(doc)) for doc, s in sets}


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    found = words(text)
    lines = [line for line in (text or "").split("\n") if words(line)]
    windows = {}
    for i in range(len(found) - 4):
        windows.setdefault(tuple(found[i : i + 5]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight, what is above a cap shared anew until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        share = (total - sum(out.values())) / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] >= most * sizes[s]}
        if not over:
            return out | {s: share * weight[s] for s in free}
        out |= {s: most * sizes[s] for s in over}
        free -= over
    return out


def tokens(text):
    codec: tiktoken.Encoding = bpe._codec(bpe.RANKS)
    ids = codec.encode_ordinary(text or "")
    listed = ",".join(map(str, ids))
    return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
