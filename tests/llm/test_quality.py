import itertools
import re

import numpy as np

from heliograph.llm import quality as q

DOC = "doc_id bigint, text string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    field = q.LineField(rng.normal(size=q.N_FEATURES + 1), rng.normal(size=(2, 2)))
    doc = np.repeat([0, 1, 2], [1, 7, 4])
    feats = rng.integers(0, q.N_FEATURES, (12, 3))
    got = field.decode(feats, doc)
    e = field.weights[feats].sum(1)
    for d in range(3):
        own = np.flatnonzero(doc == d)
        score = lambda s: sum(e[i] for i, x in zip(own, s) if x) + sum(field.pairs[a, b] for a, b in zip(s, s[1:]))
        assert score(got[own].astype(int).tolist()) == max(map(score, itertools.product((0, 1), repeat=len(own))))


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a b c d e f g h\n" * 5), (3, "a b c d e f g h\n" * 5), (4, "wörd " * 40000), (5, "é\x0b\x1c # x\n\n \n# x\n# x"), (None, "z"), (6, " ".join(map(str, range(40))))]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOC + ", n_words int")
    field = q.fit_field(df, spark.createDataFrame([], "doc_id bigint, quality int"))
    got = sorted((tuple(r)[:7] for r in q.judge(df, field).collect()), key=str)
    small = [r for r in rows if r[0] != 4]
    assert [g for g in got if g[0] != 4] == sorted([(i, *brute(t)) for i, t in small], key=str)
    assert [g[1:] for g in got if g[0] == 4] == [(40000, 160000, 0, 0, 40000, True)]
    assert {r.doc_id for r in q.judge(df, field).where("kept").collect()} == {6}
    assert q.judge(spark.createDataFrame([], DOC), field).count() == 0


def features(line, earlier, known):
    """The active features of a line, one by one from their definitions."""
    w = line.split()
    chars = [len(x.decode("utf8", "replace")) for x in w]
    total = max(1, sum(chars))
    count = lambda chars_: sum(line.count(bytes([c])) for c in chars_) / total
    values = [len(w), total / len(w), count(q.SYMBOLS), count(range(65, 91)), count(range(48, 58)), count(b"!?;:{}[]()=\"_/\\~^"), sum(n <= 3 for n in chars) / len(w), 1 - len(set(w)) / len(w)]
    out, base = [0], 1
    for v, cuts in zip(values, q.CUTS.values()):
        out.append(base + sum(v >= c for c in cuts))
        base += len(cuts) + 1
    flags = [q.line_hash(line) in known, line in earlier, bool(q.LICENCE.search(line)), line.rstrip()[-1:] in (b".", b"!", b"?")]
    return out + [base + k for k, f in enumerate(flags) if f]


def share(text, field):
    """The share of words in content lines, by Viterbi line after line."""
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    if not lines:
        return 0.0
    best = []
    for i, x in enumerate(lines):
        e = (0.0, sum(field.weights[k] for k in features(x, lines[:i], field.known)))
        if not best:
            best.append([(e[s], None) for s in (0, 1)])
            continue
        now = []
        for s in (0, 1):
            v = [best[-1][p][0] + field.pairs[p, s] for p in (0, 1)]
            p = int(v[1] >= v[0])
            now.append((v[p] + e[s], p))
        best.append(now)
    s = int(best[-1][1][0] >= best[-1][0][0])
    states = []
    for row in reversed(best):
        states.append(s)
        s = row[s][1]
    states = states[::-1]
    return sum(len(x.split()) for x, s in zip(lines, states) if s) / sum(len(x.split()) for x in lines)


SF = "/root/testdata/sf0.01"


def test_query_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    field = q.fit_field(docs, labels)
    got = {r.doc_id: r for r in q.op7_quality(spark, SF).collect()}
    rows = [d for d in docs.collect() if len(d.text) < 6000]
    assert len(rows) > 700
    mixed = 0
    for d in rows:
        base, part = brute(d.text), share(d.text, field)
        mixed += 0 < part < 1
        assert tuple(got[d.doc_id])[1:7] == base, d.doc_id
        assert abs(got[d.doc_id].content_share - part) < 1e-9 and got[d.doc_id].kept == (not base[5] and part >= q.MIN_SHARE), d.doc_id
    assert mixed > 50


def test_planted_blocks_in_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    field = q.fit_field(docs, labels.where("doc_id % 2 = 0"))
    held = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").orderBy("doc_id").collect()
    lines = lambda t: [x for x in t.encode().split(b"\n") if len(x.split()) > 5]
    junk = [x for r in held if r.quality == 0 for x in lines(r.text) if b"***" in x or x.count(b"!!") > 5]
    good = [lines(r.text) for r in held if r.quality == 1 and len(lines(r.text)) >= 4]
    assert len(junk) > 20 and len(good) > 40
    marked = kept = planted = clean = 0
    shares = []
    for k, own in enumerate(good):
        block = [junk[(3 * k + i) % len(junk)] for i in range(3)]
        at = 1 + k % (len(own) - 1)
        text = own[:at] + block + own[at:]
        feats, words, doc, _ = q.line_features([b"\n".join(text)], field.known)
        state = field.decode(feats, doc)
        marked += int((~state[at : at + 3]).sum())
        planted += 3
        kept += int(state[:at].sum() + state[at + 3 :].sum())
        clean += len(own)
        shares.append((words * state).sum() / words.sum())
    assert marked >= 0.9 * planted and kept >= 0.9 * clean
    assert sum(0 < x < 1 for x in shares) >= 0.9 * len(shares)


def test_lines_that_come_back():
    doc = np.array([0, 0, 0, 1, 1, 2, 2, 2, 3, 3, 3])
    own = np.array([1, 9, 2, 9, 3, 4, 9, 5, 1, 8, 2], np.uint64)
    assert q.coming_back(doc, own) == {9}
    assert q.coming_back(np.arange(4), np.full(4, 7, np.uint64)) == frozenset()


def test_held_out_accuracy(spark):
    docs_df, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    field = q.fit_field(docs_df, labels.where("doc_id % 2 = 0"))
    kept = {r.doc_id: r for r in q.judge(docs_df, field).collect()}
    test = [r for r in labels.where("doc_id % 2 = 1").collect()]
    good = [kept[r.doc_id] for r in test if r.quality == 1]
    bad = [kept[r.doc_id] for r in test if r.quality == 0]
    print(len(good), sum(r.kept for r in good), sum(r.base_failed for r in good), len(bad), sum(r.kept for r in bad), sum(r.base_failed for r in bad))
    assert sum(r.kept or r.base_failed for r in good) >= 0.97 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)
