import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from heliograph.llm import token_store as ts
from heliograph.llm.common import Workspace

PATH = public_tokenizers.path("word_bpe_49k.json")


def oracle(rows):
    tok, out, start = Tokenizer.from_file(PATH), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_codes_round_trip_and_access():
    rng = np.random.default_rng(0)
    for n in (1, 7, 511, 512, 513, 5000):
        ids = (rng.integers(0, 1 << 31, n) >> rng.integers(0, 31, n)).astype(np.uint32)
        codes = ts.Codes(*ts.Codes.levels(ids))
        assert (codes.all() == ids).all()
        assert [codes.access(i) for i in range(0, n, 3)] == ids[::3].tolist()


def test_words_equal_library():
    random.seed(2)
    tok = Tokenizer.from_file(PATH)
    own = ts.WordIds(open(PATH, encoding="utf-8").read())
    pool = [chr(c) for c in [*range(0x250), *range(0x370, 0x400), 0x1680, 0x2028, 0x3000, 0x4E00, 0x1F600, 0x300, 0x301, 0x130, 0x212A, 0x3A3, 0xFEFF]]
    pool += ["<|endoftext|>", "'s", "'LL", " ", "  ", "\n", "é", "É", "the", "ING", "1", "ß", "ÿ"] * 10
    texts = ["".join(random.choice(pool) for _ in range(random.randint(0, 14))) for _ in range(4000)]
    ids, lens = own.encode([t.encode() for t in texts], 2)
    want = [[*e.ids, 2] for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert lens.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_rows_and_edge_cases(spark):
    rows = [(5, "five five"), (1, None), (3, ""), (2, "word " * 30000), (4, "b"), (4, "a"), (4, "a"), (None, "n"), (-7, "minus")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, text string, base int")
    for most in (4, 1 << 16):
        store = ts.write(df, PATH, Workspace(spark, "t"), segment_ids=most)
        got = sorted(map(tuple, ts.read(store).collect()), key=lambda r: r[1])
        assert got == oracle(rows)
    every = [i for r in store.orderBy("part", "segment").collect() for i in ts.Codes(r.chunks, r.bitmaps, r.ranks).all().tolist()]
    before = ts.ids_before(store)
    for at in (0, 1, 5, len(every) // 2, len(every) - 1):
        assert ts.token_at(store, at, before) == every[at]
    assert ts.token_at(store, len(every)) is None and ts.token_at(store, -1) is None
    assert ts.read(ts.write(spark.createDataFrame([], "doc_id bigint, text string"), PATH, Workspace(spark, "t"))).count() == 0


def test_query_equals_library(spark, sf):
    got = sorted(map(tuple, ts.op9_token_store(spark, sf).collect()))
    assert got == sorted(oracle([(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]))


def test_pieces_and_pauses_of_collection(monkeypatch):
    """The pattern's order changes no piece, and Python's collector rests while a block is encoded."""
    import gc
    import random
    import re

    import public_tokenizers

    from heliograph.llm.token_store import WordIds

    plain = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ÿ]+")
    draw = random.Random(3)
    for _ in range(20_000):
        text = "".join(draw.choices("''''strevmld é÷×ß19.,-!\t\nabÿ", k=30))
        assert WordIds.PIECES.findall(text) == plain.findall(text)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        coder = WordIds(f.read())
    seen, learn = [], coder.learn
    monkeypatch.setattr(coder, "learn", lambda pieces: (seen.append(gc.isenabled()), learn(pieces)))
    texts = ["It's theirs, they've 19 dogs", "", "naïve «x»"]
    ids, lens = coder.encode([t.encode() for t in texts], 2)
    assert ids.tolist() == [x for t in texts for x in [*coder.lib.encode(t, add_special_tokens=False).ids, 2]] and lens.sum() == len(ids)
    assert seen == [False] and gc.isenabled()
