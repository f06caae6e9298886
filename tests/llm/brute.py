"""Brute-force versions that the operators are held against, and awkward document tables."""

from __future__ import annotations

import collections
import functools
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, n bigint, key string"


def table(spark, rows):
    """Documents with extra columns whose names clash with working names."""
    full = [(i, t, "en" if k % 2 else None, None if k % 5 == 4 else f"s{k % 3}", None if t is None else len(t), "x", 7, "y")
            for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def awkward(long: int = 30_000) -> list[tuple[int, str | None]]:
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()
    prose = " ".join(words[(i * i + i // 3) % len(words)] + str(i % 17) for i in range(120))
    return [(1, None), (2, ""), (3, " \n\t "), (4, prose), (5, prose), (6, prose + " tail"), (7, prose.upper()), (4, prose),
            (8, "x" * long), (9, ("word " * (long // 5)).strip()), (10, "don't 'tis I'll we've \n\n 12 3٤ naïve 日本語 😀  end "),
            (11, "\n".join([prose, "All rights reserved.", prose, "", "All rights reserved."])),
            (12, "12345 !!! ###"), (13, "Ünïcödé ſtraße Kelvin " + prose), (14, "a"), (None, "no id here"), (None, None)]


def components(ids, linked):
    """Smallest id reachable, by union over linked pairs of positions."""
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in linked:
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def simhash(text: str | None, k: int = 4) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def secrets(text: str | None):
    t, out = text or "", []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A):
        if len(m.group(2)) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 32]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def quality(text: str | None):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i:i + 3]), []).append(i)
    inside = {i + d for at in windows.values() if len(at) > 1 for i in at for d in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(inside),
            len(words) < 50 or 100 * len(inside) > 50 * len(words))


def repeats(rows, length=50):
    """(n_bytes, n_removed, n_spans, sha256 of kept) of each (id, text) row."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            first[w] = min(first.get(w, 1 << 62), 1 << 62 if i is None else i)
    out = []
    for i, t in rows:
        b, own = (t or "").encode(), 1 << 62 if i is None else i
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s:s + length]] < own:
                cover[s:s + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, cover) if not y)
        out.append((i, len(b), sum(cover), len([x for x in bytes(cover).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


def pieces(text: str | None, size: int = 1024):
    """(piece, start, length, crc32) by the tokenizers library."""
    ids = tokenizer().encode(text or "", add_special_tokens=False).ids + [2]
    first = (len(ids) - 1) % size + 1
    cuts = [0, first, *range(first + size, len(ids) + 1, size)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


_TOKENIZER = []


def tokenizer():
    if not _TOKENIZER:
        _TOKENIZER.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
        _TOKENIZER[0].encode_special_tokens = True
    return _TOKENIZER[0]


def repeated_words_removed(rows, window=35):
    """(id, n_words, n_removed, sha256 of kept words) of each (id, text) row."""
    split = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    count = collections.Counter(tuple(w[k:k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = {j for k in range(len(w) - window + 1) if count[tuple(w[k:k + window])] > 1 for j in range(k, k + window)}
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return out


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def spelling_variants(rows, length=6, least=5, damage=199, ratio=5):
    """(word, form, root, n, n_near, form_n): neighbours by deleting each letter."""
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= length and k >= least}
    index = collections.defaultdict(set)
    for w in n:
        for k in range(len(w)):
            index[w[:k] + w[k + 1:]].add(w)
    near = collections.defaultdict(set)
    for cut, words in index.items():
        both = words | ({cut} & n.keys())
        for a in both:
            near[a] |= {b for b in both if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w
    return [(w, form.get(w), root(w), k, len(near[w]), n.get(form.get(w))) for w, k in n.items()]


def conversation(rows):
    """Facts, cheapest edits (all of them tried) and digest of one conversation's (turn, role, text) rows."""
    rows = sorted(rows, key=lambda m: (m[0] is not None, m[0] or 0, m[1], hashlib.sha256(f"{len(m[1])}:{m[1]}{m[2]}".encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        shown = re.sub("[\x20\x09-\x0D]", "", text)
        faults.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    grammar = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @functools.cache
    def best(i, state, put_in):
        ways = [(0, "", "")] if i == len(rows) and state in (0, 3) else []
        choices = [("I", i, 2, r, "") for r in ("user", "assistant")] if put_in < 3 else []
        if i < len(rows):
            _, role, text = rows[i]
            if rest := best(i + 1, state, 0):
                ways.append((3 + rest[0], "D" + rest[1], rest[2]))
            if faults[i] not in ("b", "d"):
                extra = faults[i] == "t"
                choices += [("K", i + 1, extra, role, text), *[("R", i + 1, 2 + extra, r, text) for r in ("user", "assistant")]]
        for letter, to, cost, role, text in choices:
            if (state, role[:1]) in grammar and (rest := best(to, grammar[state, role[:1]], put_in + 1 if letter == "I" else 0)):
                ways.append((cost + rest[0], letter + rest[1], f"\n{role}:{text}{rest[2]}"))
        return min(ways, default=None)

    cost, audit, text = best(0, 0, 0)
    return (gaps, *map(faults.count, "bdt"), illegal, cost, audit, hashlib.sha256(text[1:].encode()).hexdigest())


def damaged_conversations(rows):
    """(conv_id, *facts) of all conversations after the damage by hash."""
    plain = lambda v: " " if v is None else str(v)
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        group, draw, role, text = groups[conv], zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20, plain(role), plain(text)
        if draw:
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            group += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return [(conv, *conversation(group)) for conv, group in groups.items()]
