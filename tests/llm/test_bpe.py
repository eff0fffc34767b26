import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from heliograph.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id bigint, text string"


def oracle(text):
    tok = Tokenizer.from_file(PATH)
    ids = tok.encode(text or "", add_special_tokens=False).ids
    back = tok.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_random_text_equals_library():
    random.seed(1)
    own, lib = bpe.ByteBPE(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)
    pool = [chr(c) for c in [*range(0x250), *range(0x370, 0x400), 0x1680, 0x2028, 0x202F, 0x3000, 0x4E00, 0x1F600, 0x200B, 0x300, 0x660, 0xB2, 0x2160, 0xFEFF, 0x180E]]
    pool += ["<|endoftext|>", "'s", "'ll", " ", "  ", "\n", "aaaa", "0000", "the", "ing"] * 8
    texts = ["".join(random.choice(pool) for _ in range(random.randint(0, 14))) for _ in range(4000)]
    texts += ["a" * 3000, " " * 500, "ab" * 777, "0" * 400, "=" * 300, "\n" * 50 + "x", ""]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    got = own.encode_many(texts)
    assert got == want
    assert [own.decode(x) for x in got] == [lib.decode(x, skip_special_tokens=False) for x in want]


def test_merge_paths_agree():
    random.seed(9)
    own = bpe.ByteBPE(open(PATH, encoding="utf-8").read())
    words = [bytes(random.choice(b"aaethin go\xc3\xa9") for _ in range(random.randint(1, 45))) for _ in range(500)]
    assert own.merge_many(words) == [own.merge(w) for w in words]


def test_rows_and_edge_cases(spark, sf):
    rows = [(1, None), (2, ""), (3, "x " * 30000), (4, "same"), (4, "same"), (None, "y"), (5, "<|endoftext|>a")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], DOC + ", n_tokens string")
    got = sorted(map(tuple, bpe.encode(df, PATH).collect()), key=str)
    assert got == sorted([(i, *oracle(t)) for i, t in rows], key=str)
    assert bpe.encode(spark.createDataFrame([], DOC), PATH).count() == 0


def test_query_equals_library(spark, sf):
    got = {r[0]: tuple(r)[1:] for r in bpe.op10_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    tok = Tokenizer.from_file(PATH)
    for d in docs:
        ids = tok.encode(d.text, add_special_tokens=False).ids
        assert got[d.doc_id][:2] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[d.doc_id][2] == hashlib.sha256(d.text.encode()).hexdigest()
