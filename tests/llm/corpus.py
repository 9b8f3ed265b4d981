"""A small corpus with every awkward case, and plain restatements of the contracts to hold results against."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import xxhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, did long, tag string, h string"


def rows(seed: int = 3) -> list[tuple]:
    """Documents with copies, near copies, shared passages, nulls, blanks, repeats and a long text; extra columns have clashing names."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéñü") for _ in range(r.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = prose(70)
    texts: list[str | None] = [None, "", "   \n\t ", "one", "Two Words", "a b c", "x" * 3000, "日本語" * 300, "ha " * 400, prose(12000)]
    base = [prose(r.randint(20, 400)) for _ in range(12)]
    texts += base + base[:4] * 3
    for t in base[:6]:
        words = t.split()
        words[r.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [f"{prose(30)}\n{passage}\n{prose(20)}" for _ in range(6)]
    texts += [f"common line of the site here\n{prose(40)}\n*** {prose(3)} $$" for _ in range(8)]
    out = [(i, t, "en", f"src{i % 3}", len(t or ""), 7, "tag", "h") for i, t in enumerate(texts)]
    out.append((len(out), texts[11], None, None, None, None, None, None))
    out.append(out[12])  # a repeated row
    out.append((None, "text without an id " * 3, "en", "src0", 1, None, None, None))
    return out


def key(doc_id: int | None) -> int:
    return -(1 << 63) if doc_id is None else doc_id


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def contamination(docs, items, window=13, share=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(str(item))
    sizes, out = {len(w) for w in windows}, []
    for d in docs:
        w = words(d[1])
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (t := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[t]
        out.append((d[0], len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit) and share * len(hit) >= len(w)))
    return out


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    h = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def near_duplicates(docs):
    prints = [fingerprint(d[1]) for d in docs]
    group = list(range(len(docs)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(docs):
        least[find(i)] = min(least.get(find(i), 1 << 62), key(d[0]))
    return [(d[0], f"{p:016x}", None if least[find(i)] == key(None) else least[find(i)]) for i, (d, p) in enumerate(zip(docs, prints, strict=True))]


def repeats(docs, size):
    data = [(d[1] or "").encode() for d in docs]
    counts = Counter(t[i : i + size] for t in data for i in range(len(t) - size + 1))
    out = []
    for d, t in zip(docs, data, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if counts[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d[0], len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone, strict=True) if not g))))
    return out


def later_bytes(docs, size):
    """(doc_id, bytes left) without the bytes that a string of ``size`` bytes standing earlier covers; ``docs`` in their order, without repeated rows."""
    seen, out = set(), []
    for d in docs:
        t = (d[1] or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if t[i : i + size] in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(t[i : i + size])
        out.append((d[0], bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


def later_windows(docs, size=20):
    """``docs`` without repeated rows."""
    seen, out = set(), []
    for d in sorted(docs, key=lambda d: key(d[0])):
        w = (d[1] or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            t = tuple(w[i : i + size])
            if t in seen:
                gone[i : i + size] = [True] * size
            seen.add(t)
        out.append((d[0], len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def base_quality(docs):
    out = []
    for d in docs:
        text = d[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        fives = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = set()
        for i in range(len(w) - 4):
            if fives[tuple(w[i : i + 5])] > 1:
                hit |= set(range(i, i + 5))
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        out.append((d[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed))
    return out


def features(text):
    """The classifier's statistics of a text, one after another."""
    data = (text or "").encode()
    w = data.split()
    if not w:
        return [0.0] * 22
    n, size = len(w), len(data)
    _, n_words, _, n_symbols, n_dup, n_repeat, _ = base_quality([(0, text)])[0]
    assert n_words == n
    count = lambda keep: sum(map(keep, data))
    mean = sum(map(len, w)) / n
    times = Counter(w)
    lines = data.split(b"\n")
    share = [c / size for c in Counter(data).values()]
    marks = set(range(33, 127)) - set(b"0123456789.,") - set(range(65, 91)) - set(range(97, 123))
    return [
        math.log1p(size), math.log1p(n), mean, math.sqrt(sum((len(x) - mean) ** 2 for x in w) / n), max(map(len, w)), n_symbols / size, sum(any(c in b"#*$%&|<>" for c in x) for x in w) / n,
        count(lambda c: 48 <= c < 58) / size, count(lambda c: 65 <= c < 91) / size, data.count(b".") / n, data.count(b",") / n, count(lambda c: c in marks) / size, count(lambda c: c > 127) / size, len(lines) / n, n_dup / len(lines),
        n_repeat / n, len(times) / n, max(times.values()) / n, len(set(zip(w, w[1:], strict=False))) / (n - 1) if n > 1 else 1.0, sum(len(x) <= 3 for x in w) / n, -sum(p * math.log2(p) for p in share), max(len(x) + 1 for x in lines) / size,
    ]


def tree_score(forest, x):
    """One row's score, by walking down each tree."""
    total = forest.base
    for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
        total += leaf[node - len(feature)]
    return 1 / (1 + math.exp(-total))


def crc(text):
    return zlib.crc32((text or "").encode())


def ngram_join(docs, size=4, percent=85):
    """(doc_id, size of the set, least id reachable), every pair compared; also the number of linked pairs."""
    sets = []
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(d[1] or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    group = list(range(len(docs)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, one in enumerate(sets):
        for j, other in enumerate(sets[:i]):
            n, m = len(one), len(other)
            if n and 100 * min(n, m) >= percent * max(n, m) and find(i) != find(j):
                shared = len(one & other)
                if 100 * shared >= percent * (n + m - shared):
                    a, b = find(i), find(j)
                    group[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(docs):
        least[find(i)] = min(least.get(find(i), 1 << 62), key(d[0]))
    return [(d[0], len(s), None if least[find(i)] == key(None) else least[find(i)]) for i, (d, s) in enumerate(zip(docs, sets, strict=True))]


def runs(w, least=6, times=4):
    """(start, length, period) of every run, period by period."""
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                out.setdefault((i, j + q - i), q)  # the least period of a stretch comes first
            i = j + 1
    return sorted(((a, m, q) for (a, m), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for a, m, q in found for i in range(a + q, a + m)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def ranked(docs, items, k=10):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))
    held = [(d[0], Counter(terms(d[1]))) for d in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    big_n, big_l = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 10 + 90 * n * big_n // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                found.append((-s, key(i)))
        out += [(item, r + 1, None if i == key(None) else i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return out
