"""Plain loops that state what the operators must return."""

import re

import xxhash


def brute_fingerprint(text, length=3):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + length]) for i in range(len(words) - length + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids_fps, bits=3):
    parent = list(range(len(ids_fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids_fps)):
        for j in range(i):
            if bin(ids_fps[i][1] ^ ids_fps[j][1]).count("1") <= bits:
                parent[root(i)] = root(j)
    least = {}
    for i, (id_, _) in enumerate(ids_fps):
        if id_ is not None:
            least[root(i)] = min(least.get(root(i), id_), id_)
    return [least.get(root(i)) for i in range(len(ids_fps))]


def brute_contamination(text, items, length=13):
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, owners = words_of(text), set(), set()
    for item, body in items:
        own = words_of(body)
        n = min(length, len(own))
        for s in range(len(own) - n + 1 if n and item is not None else 0):
            for at in range(len(words) - n + 1):
                if words[at:at + n] == own[s:s + n]:
                    hit.update(range(at, at + n))
                    owners.add(str(item))
    return len(words), len(hit), sorted(owners)
