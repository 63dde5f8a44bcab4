import random
import re

import pytest
import xxhash

from hydrospark.llm import simhash as sh
from hydrospark.llm.components import connected_components


def brute_fp(text, k=3):
    words = [w for w in re.split("[\x20\x09-\x0D]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    parts = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in linked:
        parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def classes(of):
    out = {}
    for n, r in of.items():
        out.setdefault(r, set()).add(n)
    return {frozenset(c) for c in out.values()}


def test_fingerprint():
    r = random.Random(3)
    texts = [None, "", "  \t ", "One", "one TWO", "a b c", "Ünï CÖDE   x y z", "same same same same"]
    texts += [" ".join(r.choice("abcdefg") * r.randint(1, 3) for _ in range(r.randint(3, 200))) for _ in range(40)]
    for t in texts:
        assert sh.fingerprint(None if t is None else t.encode()) == brute_fp(t)
    long = " ".join(str(i) for i in range(70_000))
    assert sh.fingerprint(long.encode()) == brute_fp(long)


@pytest.mark.parametrize("cell_rows", [4096, 5])
def test_links_match_brute_force(spark, cell_rows):
    r = random.Random(11)
    fps = {0, (1 << 64) - 1}
    for _ in range(25):
        base = r.getrandbits(64)
        fps.add(base)
        for _ in range(r.randint(0, 12)):
            x = base
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
            if r.random() < 0.3:
                base = x  # chains
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    got = [(x["a"], x["b"]) for x in sh.fingerprint_links(df, 3, cell_rows).collect()]
    assert classes(roots(signed, got)) == classes(roots(signed, links))


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, 7)]
    edges += [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x["node"]: x["root"] for x in connected_components(df).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert set(got) == nodes
    assert classes(got) == classes(roots(nodes, [(a, b) for a, b in edges if a != b]))
    assert connected_components(df.where("a < 0")).count() == 0


def test_groups(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = [r.choice(words) for _ in range(r.randint(60, 400))]
        for c in range(r.randint(1, 5)):
            w = list(base)
            if c:
                w[r.randrange(len(w))] = "changed"
            rows.append((len(rows) + 10, " ".join(w)))
    rows += [(1, None), (2, ""), (3, "!"), (3, "!"), (None, "! "), (None, rows[0][1])]
    df = spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows], "doc_id long, text string, fp string, root double")
    got = sh.simhash_groups(df).select("doc_id", "fp", "component_id").collect()
    fps = [brute_fp(t) for _, t in rows]
    of = roots(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a)
                                  if (fps[a] ^ fps[b]).bit_count() <= 3])
    want = []
    for n, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in of if of[m] == of[n] and rows[m][0] is not None]
        want.append((str(i), fps[n], min(ids, default=None)))
    assert sorted((str(x[0]), x[1] % (1 << 64), x[2]) for x in got) == sorted(want)
    assert sh.simhash_groups(df.where("false")).count() == 0
