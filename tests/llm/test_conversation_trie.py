"""The prefix tree next to a dictionary of all prefixes."""

import hashlib
import math
import random
import zlib

import pytest

from stallwise.llm.conversation_trie import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, n int, lead string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plainly(rows, rebuild):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        built = {c: own.get(c - int(math.fmod(c, 20)), [])[:h[c]] + ts[h[c]:] for c, ts in own.items()}
    else:
        built = own
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    totals = {}
    for p in sorted(members, key=len, reverse=True):
        below = [totals[k] for k in kids.get(p, [])]
        words = len(p[-1][1].encode().split()) if p else 0
        totals[p] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[p]) - 1) * words)
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *totals[p],
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def made_rows(seed, n=150):
    rng = random.Random(seed)
    said = ["hello", "hello there friend", "", "ok", None, "what is\tthis", "日本 語", "so  it goes"]
    rows = []
    for c in range(n):
        if c % 7 == 3:
            continue  # no such conversation
        length = rng.choice([1, 2, 3, 5, 9])
        common = rng.random() < 0.4
        for t in range(length):
            text = said[t % 3] if common else rng.choice(said)
            role = rng.choice(["user", "user", "assistant", None]) if not common else "user"
            rows.append((c, t if rng.random() < 0.98 else None, role, text, 1, 2, "x"))
    rows += [r for r in rows if r[0] == 5]                       # repeated rows
    rows += [(None, 1, "user", "nobody's", 1, 2, "x")] * 3       # no conversation
    rows += [(-7, 1, "user", "hello", 1, 2, "x")]
    for c in (200, 201, 402, 999):                                # long ones: 402 and 999 agree in 60 turns, 200 = 201
        rows += [(c, t, "user", f"turn {t if c < 400 or t < 60 else (t, c)} of it", 1, 2, "x")
                 for t in range(1, 90 + (c == 999))]
    return rows


@pytest.mark.parametrize("limit, longest, rebuild", [(256, 4096, True), (4, 4096, True), (3, 16, False), (40, 2, True)])
def test_equals_all_prefixes(spark, limit, longest, rebuild):
    rows = made_rows(limit)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = prefix_trie(frame, rebuild=rebuild, limit=limit, longest=longest)
    have = [tuple(r) for r in found.collect()]
    assert len(have) == len(set(have))
    assert set(have) == plainly(rows, rebuild)


def test_hot_conversation_common_turn_and_copies(spark):
    """A third of all rows in one conversation, a third of all conversations alike, one first turn for most."""
    rows = [(0, t, "user", f"line {t}", 1, 1, "") for t in range(1000)]
    rows += [(c, t, "user", f"same {t}", 1, 1, "") for c in range(1, 400) for t in range(2)]
    rows += [(c, t, "user", "same 0" if t == 0 else f"{c} {t}", 1, 1, "") for c in range(400, 900) for t in range(2)]
    found = prefix_trie(spark.createDataFrame(rows, SCHEMA), limit=50, longest=16)
    assert {tuple(r) for r in found.collect()} == plainly(rows, False)


def test_empty_and_one(spark):
    frame = spark.createDataFrame([(3, None, None, None, 1, 1, "")], SCHEMA)
    assert prefix_trie(frame.limit(0)).count() == 0
    assert {tuple(r) for r in prefix_trie(frame).collect()} == plainly([(3, None, None, None)], False)
    nobody = spark.createDataFrame([(None, 1, "user", "x", 1, 1, "")], SCHEMA)
    assert prefix_trie(nobody).count() == 0
