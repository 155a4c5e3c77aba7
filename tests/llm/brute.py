"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import xxhash

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def base_phrases(text):
    words = alnum(text)
    found = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


def contamination(docs, items, width=13):
    windows = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        if w:
            k = min(width, len(w))
            for i in range(len(w) - k + 1):
                windows[tuple(w[i : i + k])].add(item)
    out = []
    for doc, text in docs:
        w = alnum(text)
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (key := tuple(w[i : i + k])) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[key]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g.encode(), seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def simhash(docs):
    prints = {d: fingerprint(t) for d, t in docs}
    ids = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = union(pairs, ids)
    return {(d, f"{prints[d]:016x}", roots[d]) for d in ids}


def substrings(docs, width=50):
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone |= set(range(i, i + width))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def grams(text):
    out = Counter()
    letters = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "")
    for word in letters.split():
        padded = f"\0{word}\0"
        out.update(word)
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    joined = "\0".join(["", *letters.split(), ""])
    if letters.split():
        out.update(joined[i : i + 2] for i in range(len(joined) - 1))
    return out


def _key(g):
    return (len(g), g)


def ranked(counts, depth=300):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], _key(x[0])))[:depth]]


def language_profiles(docs, depth=300):
    total = defaultdict(Counter)
    for text, lang in docs:
        if lang is not None:
            total[lang].update(grams(text))
    return {lang: {g: i for i, g in enumerate(ranked(c, depth))} for lang, c in total.items() if c}


def language(text, profiles, depth=300):
    mine = ranked(grams(text), depth)
    if not mine or not profiles:
        return "und", 0.0
    d, lang = min((sum(abs(p[g] - i) if g in p else depth for i, g in enumerate(mine)), lang) for lang, p in profiles.items())
    return lang, max(0.0, 1 - d / (depth * len(mine)))


def targets(sizes):
    """Water-filling as the contract says it: share by weight, cut at three times the size, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, goal, free = Fraction(sum(sizes.values())), {s: Fraction(0) for s in names}, set(names)
    while left and free:
        w = sum(weight[s] for s in free)
        share = {s: goal[s] + left * weight[s] / w for s in free}
        left = Fraction(0)
        for s, v in share.items():
            goal[s] = min(v, Fraction(3 * sizes[s]))
            left += v - goal[s]
            if v >= 3 * sizes[s]:
                free.discard(s)
    return {s: float(v) for s, v in goal.items()}


_M = 2**64 - 1


def _mix(h):
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & _M
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & _M
    return h ^ h >> 32


def chunks(lines, every=2, least=2, most=32):
    """Chunks of lines: a rolling hash of two lines ends a chunk, between the least and the most lines; and all runs of the least."""
    h = [xxhash.xxh3_64_intdigest(x) for x in lines]
    rolled = [h[0]] + [_mix((b * 0x9E3779B97F4A7C15 + (a ^ 0xA0761D6478BD642F)) & _M) for a, b in zip(h, h[1:], strict=False)]
    out, at = {(i, i + least) for i in range(len(lines) - least + 1)}, 0
    for i, v in enumerate(rolled):
        size = i + 1 - at
        if (_mix(v) % every == 0 and size >= least) or size == most or i + 1 == len(lines):
            out.add((at, i + 1))
            at = i + 1
    return out


def line_dedup(docs):
    """[(doc_id, kept text or None, lines, removed)] of rows (doc_id, text)."""
    split = [(d, t.encode().split(b"\n") if t is not None else None) for d, t in docs]
    places = {}
    for r, (d, lines) in enumerate(split):
        if lines is None:
            continue
        for a, b in chunks(lines):
            body = b"\n".join(lines[a:b])
            if b - a >= 2 and re.search(rb"[0-9A-Za-z\x80-\xff]", body):
                places.setdefault(body, []).append((d is None, d or 0, r, a, b))
    gone = [set() for _ in split]
    for held in places.values():
        _, _, r0, a0, b0 = min(held)
        for _, _, r, a, b in held:
            gone[r] |= set(range(max(a, b0) if r == r0 else a, b))
    out = []
    for (d, lines), lost in zip(split, gone, strict=True):
        out.append((d, None, 0, 0) if lines is None else (d, b"\n".join(x for i, x in enumerate(lines) if i not in lost).decode(), len(lines), len(lost)))
    return out


def licence_evidence(text, phrases, restriction, family, known):
    """(labels, score) by trying every place for every phrase, and every prefix after the tag for an expression."""
    words = alnum(text)
    labels, doubt = set(), 1.0
    for _, label in base_phrases(text)[1]:
        labels.add(label)
        doubt *= 0.4
    spans = []
    for phrase, label in phrases.items():
        k = phrase.split()
        spans += [(i, i + len(k), label) for i in range(len(words) - len(k) + 1) if words[i : i + len(k)] == k]
    for a, b, label in spans:
        # Not one that ends within a notice that began before it, or at its place and is longer.
        if not any((x, -y) < (a, -b) and y >= b for x, y, _ in spans):
            labels.add(label)
            doubt *= 0.5
    for m in re.finditer(r"(?i)spdx-license-identifier\s*:[ \t]*([^\r\n]*)", text or ""):
        tokens = re.findall(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*", m[1])
        for n in range(len(tokens), 0, -1):
            held = tokens[:n]

            def operand():
                if held and held[0] == "(":
                    held.pop(0)
                    out = expression()
                    assert held.pop(0) == ")"
                else:
                    assert known(held[0]) and held[0].upper() not in ("AND", "OR", "WITH")
                    out = {family(held.pop(0))}
                    if held and held[0].upper() == "WITH":
                        held.pop(0)
                        assert "exception" in held.pop(0).lower()
                return out

            def expression():
                out = operand()
                while held and held[0].upper() in ("AND", "OR"):
                    held.pop(0)
                    out |= operand()
                return out

            try:
                found = expression()
                assert not held
            except (AssertionError, IndexError):
                continue
            labels |= found - {"none", "noassertion"}
            doubt *= 0.1
            break
    return ",".join(sorted(labels)), 1 - doubt


def text_features(text):
    """The quality features of one text, by counting."""
    import math

    raw = (text or "").encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    n, size, n_lines = max(1, len(words)), max(1, len(raw)), max(1, len(lines))
    isalnum = lambda c: 48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128
    space = lambda c: c == 32 or 9 <= c <= 13
    marks = lambda x: sum(not isalnum(c) and not space(c) for c in x)
    upper = lambda x: sum(65 <= c < 91 for c in x)
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, sum(len(w) > 20 for w in words) / n, upper(raw) / size, sum(48 <= c < 58 for c in raw) / size, marks(raw) / size,
        sum(map(space, raw)) / size, n_lines / n, sum(c >= 128 for c in raw) / size, len(set(words)) / n, len(set(lines)) / n_lines, sum(upper(w) > 0.6 * len(w) for w in words) / n,
        sum(marks(w) >= 2 for w in words) / n, sum(w[-1:] in (b".", b"!", b"?") for w in words) / n, sum(w == b"|" for w in words) / n, math.log1p(len(raw) / n_lines),
    ]


def fim_units(text, joined):
    """Units of a text: a new one wherever ``joined`` does not hold for two neighbours."""
    out = []
    for c in text:
        if out and joined(out[-1][-1], c):
            out[-1] += c
        else:
            out.append(c)
    return out


def fim(doc_id, text):
    """The row of the fill-in-the-middle contract."""
    text = text or ""
    cut = fim_units(text, lambda a, b: a.isascii() and a.isalpha() and b.isascii() and b.isalpha())
    n, digest = len(cut), sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (cut[:a], cut[a:b], cut[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def resampled(docs, aims, order=1, buckets=10_000, percent=10, least=20):
    """Rows of the importance resampling contract, in order of drawing and then as they come."""
    import math
    import zlib
    from collections import Counter

    def grams(t):
        w = alnum(t)
        return w, Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(w) - n + 1))

    held = [(d, *grams(t)) for d, t in docs]
    s, t = sum((g for *_, g in held), Counter()), sum((grams(x)[1] for x in aims), Counter())
    S, T = s.total(), t.total()
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (S + buckets) / ((s[k] + 1) * (T + buckets)))) for k in s}
    rows = []
    for d, w, g in held:
        weight = sum(n * gain[k] for k, n in g.items())
        h = int(sha("2024:" + ("" if d is None else str(d)))[:8], 16)
        rows.append((d, len(w), g.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    k = len(able) * percent // 100
    return [(*r, i + 1 if i < k else None) for i, r in enumerate(able)] + [(*r, None) for r in rows if r[1] < least]
