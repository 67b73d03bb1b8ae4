"""Plain versions of the operators, for comparison."""

import hashlib
import math
import re
import struct
from html.parser import HTMLParser
from itertools import combinations

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def simhash(text):
    words = SPACED.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=3):
    """id to fingerprint, to id to the smallest linked id."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], dtype=np.uint64)
    for a, i in enumerate(ids):
        for b in np.flatnonzero(np.bitwise_count(values ^ values[a]) <= radius).tolist():
            x, y = find(i), find(ids[b])
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def private(text):
    text, out = text or "", {"email": [], "ip": [], "card": [], "phone": []}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in re.sub("[^0-9]", "", m[0])]
        total = sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out["phone"].append(m.span())
    return out


def hits(text, items, width=13):
    words = ALNUM.findall((text or "").translate(LOWER))
    covered, names = set(), set()
    for name, body in items:
        own = ALNUM.findall((body or "").translate(LOWER))
        n = min(width, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in windows:
                covered.update(range(i, i + n))
                names.add(name)
    return len(words), len(covered), names


def later(docs, window=20):
    """[(key, text)] in order to the kept words of each."""
    seen, out = set(), []
    for _, text in docs:
        words = SPACED.findall(text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone.update(range(i, i + window))
            seen.add(w)
        out.append([w for i, w in enumerate(words) if i not in gone])
    return out


def nearest(vectors, every, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], dtype=np.float64)
    out = {}
    for a, i in enumerate(ids):
        if i % every == 0:
            s = [(-sum(p * q for p, q in zip(x[a], x[b], strict=True)), j) for b, j in enumerate(ids) if j != i]
            out[i] = [(j, -v) for v, j in sorted(s)[:k]]
    return out


def waterfill(sizes, weights, total, epochs):
    caps = {s: epochs * n for s, n in sizes.items()}
    full = set()
    while True:
        left = total - sum(caps[s] for s in full)
        rest = sum(weights[s] for s in sizes if s not in full)
        goal = {s: caps[s] if s in full else left * weights[s] / rest for s in sizes}
        over = {s for s in sizes if s not in full and goal[s] > caps[s]}
        if not over or len(full | over) == len(sizes):
            return {s: min(goal[s], caps[s]) for s in sizes}
        full |= over


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def pairs(n):
    return combinations(range(n), 2)


class _Article(HTMLParser):
    """The blocks of what is inside article elements, by the standard library's parser."""

    BLOCKS = {"p", "div", "ul", "ol", "li", "h1", "h2", "h3", "article", "section", "table", "tr", "footer", "nav", "blockquote", "pre"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.skipped, self.piece, self.blocks = 0, 0, [], []

    def flush(self):
        if text := " ".join("".join(self.piece).split()):
            self.blocks.append(text)
        self.piece = []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skipped += tag in {"script", "style"}
        if tag in self.BLOCKS:
            self.flush()
        elif tag == "br":
            self.piece.append(" ")

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.flush()
        self.depth -= tag == "article"
        self.skipped -= tag in {"script", "style"}

    def handle_data(self, data):
        if self.depth > 0 and not self.skipped:
            self.piece.append(data)


def article(page):
    parser = _Article()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return "\n".join(parser.blocks)


def resampled(docs, targets, share, seed, size):
    """{key: (log weight, draw)} and the keys chosen: two bags of hashed words and pairs, their log ratio, Gumbel noise, the top share."""
    bags = {}
    for i, text in docs:
        tokens = re.findall(r"\w+|[^\w\s]+", (text or "").lower())
        one = [xxhash.xxh64_intdigest(t) for t in tokens]
        two = [(a * 0x9E3779B97F4A7C15 % 2**64) ^ b for a, b in zip(one, one[1:], strict=False)]
        bags[i] = [x % size for x in one + [x ^ (x >> 29) for x in two]]
    raw, good = [1] * size, [1] * size
    for i, bag in bags.items():
        for x in bag:
            raw[x] += 1
            good[x] += i in targets
    out = {}
    for i, text in docs:
        weight = sum(math.log(good[x] / sum_good) - math.log(raw[x] / sum_raw) for sum_good, sum_raw in [(sum(good), sum(raw))] for x in bags[i])
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
        for part in (str(i), text or ""):
            h = xxhash.xxh64_intdigest(part.encode(), h)
        out[i] = (weight, weight - math.log(-math.log(((h >> 11) + 0.5) / 2**53)))
    return out, set(sorted(out, key=lambda i: -out[i][1])[: math.ceil(share * len(out))])
