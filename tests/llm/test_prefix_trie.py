import hashlib
import random
import re
import zlib

import pytest

from hydrospark.llm import prefix_trie


def rebuilt(rows):
    convs = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, own in convs.items():
        if c is None:
            out[c] = own
            continue
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(paths):
    members = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)

    def small(cs):
        ids = [c for c in cs if c is not None]
        return min(ids) if ids else None

    nodes = {}
    for pre, cs in members.items():
        below = [p for p in members if p[:len(pre)] == pre]
        kids = lambda p: [x for x in below if len(x) == len(p) + 1 and x[:len(p)] == p]
        words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        ends = sorted(c for c in cs if c is not None and len(paths[c]) == len(pre))
        nodes[pre] = (small(cs), len(pre), small(members[pre[:-1]]) if pre else None, len(cs), len(kids(pre)),
                      sum(not kids(p) for p in below), sum((len(members[p]) - 1) * words(p) for p in below),
                      hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return sorted(nodes.values(), key=str)


def _table(seed, n=70):
    r = random.Random(seed)
    rows = []
    openings = ["hello there", "", None, "a b\tc\n d", "x"]
    for c in range(n):
        if c in (20, 41):  # absent base, absent conversation
            continue
        length = r.choice([1, 1, 2, 3, 4, 6])
        rows += [(c, None if t == 0 and c % 9 == 0 else t, ("user", "assistant", None)[t % 3],
                  r.choice(openings[:2] if t < 2 else openings)) for t in range(length)]
    copies = [(t, "user", "same words here") for t in range(5)]
    rows += [(c, *x) for c in range(200, 260) for x in copies]  # a frequent conversation
    rows += [(300, t, "user", f"long {t % 3}") for t in range(120)] + [(301, t, "user", f"long {t % 3}") for t in range(120)]
    rows += [(302, 1, "user", "twice"), (302, 1, "user", "twice"), (None, 0, "user", "x"), (None, 1, "user", "y")]
    return rows


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("limit", [1, 8, 60, 100_000])
def test_matches_brute_force(spark, limit):
    rows = _table(3)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, p1 long")
    assert got(prefix_trie.prefix_trie(df, limit=limit)) == brute(rebuilt(rows))


def test_as_they_stand_and_empty(spark):
    rows = [r for r in _table(8, 30) if r[0] is not None and r[0] < 220]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        plain.setdefault(c, []).append((role or "", text or ""))
    assert got(prefix_trie.prefix_trie(df.repartition(7), rebuilt=False, limit=16)) == brute(plain)
    assert prefix_trie.prefix_trie(df.where("false")).count() == 0
    # Only turnless conversations: the root alone.
    lone = spark.createDataFrame([(41, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    h = zlib.crc32(b"41") % 4
    want = brute({41: [] if h else [("user", "x")]})
    assert got(prefix_trie.prefix_trie(lone)) == want


def test_long_digest_in_pieces(spark):
    rows = [(c, 0, "user", "one") for c in range(9000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(9)
    leaf = [r for r in prefix_trie.prefix_trie(df, rebuilt=False, limit=100).collect() if r["depth"] == 1]
    assert len(leaf) == 1 and leaf[0]["n_convs"] == 9000 and leaf[0]["saved_tokens"] == 8999
    assert leaf[0]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(9000))).encode()).hexdigest()
