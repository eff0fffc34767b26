import pytest
import zlib

import numpy as np

from heliograph.llm import language as lg

DOC = "doc_id bigint, text string, lang string"


def test_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = lg.op5_language(spark, sf).collect()
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id].lang for r in held)
    print("held out", len(held), right)
    assert right >= 0.97 * len(held)


def test_mixed_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, table = lg.fit(docs)
    by = {}
    for r in docs.where("length(text) > 900").orderBy("doc_id").collect():
        by.setdefault(r.lang, []).append(r.text[:800])
    mixed = [a + "\n" + b for a, b in zip(by["fr"][:20], by["de"][:20])]
    share = lg.mixtures(mixed, table)
    fr, de = langs.index("fr"), langs.index("de")
    assert (np.abs(share[:, fr] - 0.5) < 0.15).mean() > 0.8 and (np.abs(share[:, de] - 0.5) < 0.15).mean() > 0.8
    pure = lg.mixtures(by["es"][:20], table)
    assert ((pure > 0).sum(1) == 1).mean() > 0.8


def test_together_equals_alone():
    rng = np.random.default_rng(0)
    table = np.log(rng.dirichlet(np.ones(lg.BINS), 3).T).astype(np.float32)
    texts = ["".join(rng.choice(list("abcde éß\n1"), n)) for n in (0, 1, 2, 3, 50, 400, 1000)]
    assert np.allclose(lg.mixtures(texts, table), np.concatenate([lg.mixtures([t], table) for t in texts]))


def test_edge_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", "fr"), (4, "the cat " * 20000, "en"), (4, "the cat", "en"), (5, "le chat est la", "fr"), (None, "der hund", "de"), (6, "z", None), (8, "the dog and the cat", "en"), (9, "le chien et le chat", "fr")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], DOC + ", score double")
    got = {(r.doc_id, r.lang_pred) for r in lg.identify(df, lg.fit(df)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (8, "en")} <= got
    assert lg.identify(df, lg.fit(df)).count() == len(rows)
    empty = spark.createDataFrame([], DOC)
    assert lg.identify(empty, lg.fit(empty)).count() == 0
    assert {r.lang_pred for r in lg.identify(df, lg.fit(empty)).collect()} == {"und"}


def brute_bins(text):
    """Bins of a text's letter trigrams, one by one."""
    s = [ord(c) for c in f" {text.lower()} "]
    s = [32 if c < 0x61 or 0x7A < c < 0xAA else c for c in s]
    out = []
    for a, b, c in zip(s, s[1:], s[2:]):
        if a == 32 and b == 32:
            continue
        h = ((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) % (1 << 64)) >> 40
        out.append((h ^ (h >> 9)) % lg.BINS)
    return out


def brute_mixture(text, table):
    """Proportions by expectation-maximisation span after span, and forward selection with its price."""
    bins = brute_bins(text)
    n_lang = table.shape[1]
    if not bins:
        return [0.0] * n_lang
    n = max(1, len(bins) // lg.SPAN)
    spans = [bins[i * lg.SPAN : (i + 1) * lg.SPAN if i < n - 1 else None] for i in range(n)]
    like = [[sum(float(table[b, k]) for b in s) for k in range(n_lang)] for s in spans]

    def em(langs):
        share = {k: 1 / len(langs) for k in langs}
        for _ in range(lg.ROUNDS):
            new = dict.fromkeys(langs, 0.0)
            for s in like:
                top = max(s)
                r = {k: share[k] * np.exp(max(s[k] - top, -60.0)) for k in langs}
                total = sum(r.values())
                for k in langs:
                    new[k] += r[k] / total
            share = {k: v / n for k, v in new.items()}
        return share, sum(max(s) + np.log(sum(share[k] * np.exp(max(s[k] - max(s), -60.0)) for k in langs)) for s in like)

    alone = [sum(max(s[k], max(s) - 60.0) for s in like) for k in range(n_lang)]
    first = alone.index(max(alone))
    chosen, share, best = [first], {first: 1.0}, max(alone)
    price = max(lg.PENALTY * 0.5 * np.log(max(2, n)), lg.LEAST_GAIN)
    while len(chosen) < n_lang:
        tries = [(em(sorted([*chosen, k])), k) for k in range(n_lang) if k not in chosen]
        (new, fit), k = max(tries, key=lambda x: (x[0][1], -x[1]))
        if fit - best <= price:
            break
        chosen, share, best = [*chosen, k], new, fit
    return [share.get(k, 0.0) for k in range(n_lang)]


def test_query_by_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    learn = [r for r in rows if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    langs = sorted({r.lang for r in learn})
    counts = np.full((lg.BINS, len(langs)), 0.05)
    for r in learn:
        np.add.at(counts, (brute_bins(r.text), langs.index(r.lang)), 1)
    table = np.log(counts / counts.sum(0)).astype(np.float32)
    got_langs, got_table = lg.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    assert got_langs == langs and np.allclose(got_table, table)
    got = {r.doc_id: r for r in lg.op5_language(spark, sf).collect()}
    assert len(got) == len(rows)
    some = [r for r in rows if len(r.text or "") < 6000]
    assert len(some) > 100
    for r in some:
        share = brute_mixture(r.text or "", table)
        best = share.index(max(share))
        known = any(c.isalpha() for c in r.text or "") and max(share) > 0
        assert got[r.doc_id].lang_pred == (langs[best] if known else "und"), r.doc_id
        assert abs(got[r.doc_id].score - (share[best] if known else 0)) < 1e-4, r.doc_id


def test_all_languages_are_learned(spark, monkeypatch):
    """300 values of lang, each with words of its own and one document."""
    word = lambda k, j: "".join(chr(0x3400 + (37 * k + 11 * j + i * i) % 6000) for i in range(6))
    rows = [(i, " ".join(word(k, j) for j in range(40)), f"l{k:03d}") for k in range(300) for i in [next(d for d in range(10 * k, 10 * k + 10) if zlib.crc32(str(d).encode()) % 4 != 2)]]
    df = spark.createDataFrame(rows, DOC)
    model = lg.fit(df)
    assert model[0] == [f"l{k:03d}" for k in range(300)]
    got = {r.doc_id: r.lang_pred for r in lg.identify(df, model).collect()}
    assert sum(got[i] == x for i, _, x in rows) >= 295
    monkeypatch.setattr(lg, "LANGUAGES", 299)
    with pytest.raises(ValueError, match="more than 299"):
        lg.fit(df)
