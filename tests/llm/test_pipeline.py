import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from heliograph.llm import pii, quality
from heliograph.llm.common import read_text
from tests.llm import test_decontam, test_pii, test_similar


def test_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    judged = {r.doc_id: r.kept for r in quality.judge(docs, quality.fit_field(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    good = cp.quality_rules(spark, docs, sf)
    assert good.columns == names
    rows = {d: t for d, t in rows.items() if judged[d]}
    assert sorted((r.doc_id, r.text) for r in good.collect()) == sorted(rows.items())

    one = cp.near_duplicates(spark, good, sf)
    rows = {d: rows[d] for d, c in test_similar.brute(sorted(rows.items())) if d == c}
    assert one.columns == names
    assert sorted((r.doc_id, r.text) for r in one.collect()) == sorted(rows.items())

    clean = cp.decontamination(spark, one, sf)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {d: rows[d] for d, *_, hit in test_decontam.brute(list(rows.items()), items) if not hit}
    assert clean.columns == names
    assert sorted((r.doc_id, r.text) for r in clean.collect()) == sorted(rows.items())

    private = cp.pseudonyms(spark, clean, sf)
    test_pii.KEY, old = read_text(spark, pii.own_key_file(spark)).strip(), test_pii.KEY
    rows = {d: test_pii.brute(t)[0] for d, t in rows.items()}
    test_pii.KEY = old
    assert private.columns == names
    assert sorted((r.doc_id, r.text, r.n_chars) for r in private.collect()) == sorted((d, t, len(t)) for d, t in rows.items())

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, t in rows.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in cp.run(spark, sf).collect()} == want


def test_stages_take_odd_tables(spark, sf):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, words int, new string, hit_id int"
    text = " ".join(f"word{i}" for i in range(50)) + "."
    odd = spark.createDataFrame([(1, text, "en", "s", 1, "c", 1, "n", 3), (1, text, "en", "s", 1, "c", 1, "n", 3), (2, None, None, None, None, None, None, None, None), (None, text + " x", "en", "s", 1, "c", 1, "n", 3), (3, "", "en", "s", 0, "c", 1, "n", 3)], schema)
    for table in (odd, odd.limit(0)):
        for name, stage in cp.STAGES:
            out = stage(spark, table, sf)
            assert out.columns == table.columns or name == "tokens"
            rows = out.collect()
            assert len(rows) <= 5
            if table is odd and name in ("pseudonyms", "tokens"):
                assert len(rows) == 5
