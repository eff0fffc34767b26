import random
import re
from itertools import combinations

import numpy as np
import xxhash

from heliograph.llm import simhash as sh
from heliograph.llm.common import Workspace

DOC = "doc_id bigint, text string"


def fp(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute(rows):
    f = [fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if (f[i] ^ f[j]).bit_count() <= 4:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{f[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_cover():
    assert all(any(set(t) <= set(q) for t in sh.COVER) for q in combinations(range(8), 4))
    x = np.array([0, 0xFF, 0xFF00000000000000], np.uint64)
    assert sh.first_cover(x).tolist() == [0, 0, sh.COVER.index((1, 2, 3, 4))]


def test_trees_join_all_that_is_close():
    random.seed(9)
    of, fp = [], []
    for k, m in enumerate([1, 2, 2, 3, 40, 200]):
        base = [random.getrandbits(64) for _ in range(3)]
        for _ in range(m):
            x = random.choice(base)
            for b in random.sample(range(64), random.choice([0, 1, 4, 8])):
                x ^= 1 << b
            of.append(k)
            fp.append(x)
    u, v = sh.grown(np.array(of), np.array(fp, np.uint64))
    assert len(u) < len(of)
    pairs = [(i, j) for i, j in combinations(range(len(of)), 2) if of[i] == of[j] and (fp[i] ^ fp[j]).bit_count() <= 4]
    assert groups(list(zip(u.tolist(), v.tolist())), range(len(of))) == groups(pairs, range(len(of)))


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    out = {}
    for n in nodes:
        out.setdefault(find(n), set()).add(n)
    return {frozenset(x) for x in out.values()}


def test_links_and_components_on_planted_fingerprints(spark):
    random.seed(6)
    fps = set()
    for _ in range(30):
        x = random.getrandbits(64)
        for _ in range(random.choice([1, 2, 60])):
            for b in random.sample(range(64), random.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    fps |= {random.getrandbits(20) << 44 for _ in range(50)} | {0, 1, (1 << 64) - 1, 1 << 63}
    want = groups([(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 4], fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp bigint")
    found = sh.links(df)
    unsigned = lambda v: v % (1 << 64)
    got = [(unsigned(r.u), unsigned(r.v)) for r in found.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in got)
    assert groups(got, fps) == want
    comp = sh.components(found, Workspace(spark, "t")).collect()
    by = {}
    for r in comp:
        by.setdefault(r.component, set()).add(unsigned(r.node))
    assert {frozenset(x) for x in by.values()} == {x for x in want if len(x) > 1}


def test_edge_cases(spark):
    base = "one two three four five six seven eight nine ten " * 20
    rows = [(9, None), (8, ""), (7, " \n"), (6, "A b"), (5, "a  B"), (4, base), (3, base + "x"), (3, base), (2, "w " * 40000), (None, base), (None, "alone of its kind"), (1, "É é"), (1, "É é")]
    df = spark.createDataFrame([(*r, "z") for r in rows], DOC + ", fp string")
    assert sorted(map(tuple, sh.near_duplicates(df).collect()), key=repr) == brute(rows)
    assert sh.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, sh.op4_simhash(spark, sf).collect()), key=repr) == brute(rows)
