from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from heliograph.llm import token_rollup as tr
from heliograph.llm.common import Workspace

CHANGE = "kind string, doc_id bigint, source string, lang string, tokenizer_version string, n_tokens bigint, old_tokens bigint, n_docs int"


def totals(r):
    return {tuple(x)[:3]: tuple(x)[3:] for x in r.totals().collect()}


def test_batches_commit_once(spark):
    r = tr.Rollup(spark, Workspace(spark, "t").path + "/r")
    assert totals(r) == {}
    one = spark.createDataFrame([("insert", 1, "a", "en", "v1", 10, None, 7), ("insert", 2, "a", "en", "v1", 5, None, 7), ("insert", 2, "a", "en", "v1", 5, None, 7), ("insert", 3, None, None, "v1", None, None, 7)], CHANGE)
    two = spark.createDataFrame([("revise", 1, "a", "en", "v1", 12, 10, 7), ("delete", 2, "a", "en", "v1", 5, None, 7), ("insert", 1, "a", "en", "v2", 3, None, 7)], CHANGE)
    want1 = {("a", "en", "v1"): (3, 20), (None, None, "v1"): (1, 0)}
    want2 = want1 | {("a", "en", "v1"): (2, 17), ("a", "en", "v2"): (1, 3)}
    assert r.commit("one", one) and totals(r) == want1
    assert not r.commit("one", one) and totals(r) == want1
    assert r.commit("two", two) and totals(r) == want2
    r.compact()
    assert totals(r) == want2 and not r.commit("one", one) and not r.commit("two", two) and totals(r) == want2
    assert r.commit("none", one.limit(0)) and totals(r) == want2
    with pytest.raises(tr.OtherContents):
        r.commit("one", two)
    assert totals(r) == want2
    # a write that broke off stays hidden
    r._write(tr.delta(two), "_left")
    assert totals(r) == want2 and r.commit("again", two.limit(0)) and totals(r) == want2


def test_unknown_kind(spark):
    r = tr.Rollup(spark, Workspace(spark, "t").path + "/r")
    with pytest.raises(Exception, match="unknown kind"):
        r.commit("x", spark.createDataFrame([("upsert", 1, "a", "en", "v1", 1, 1, 1)], CHANGE))
    assert totals(r) == {}


def test_query_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want, seen = Counter(), set()
    toks = {n: Tokenizer.from_file(public_tokenizers.path(f"{n}.json")) for n in ("byte_bpe_50k", "word_bpe_49k")}
    groups = {(d.source, d.lang, n) for d in docs for n in toks}
    for d in sorted(docs, key=lambda d: d.doc_id):
        for n, t in toks.items():
            if d.text not in seen:
                want[d.source, d.lang, n, 0] += 1
                want[d.source, d.lang, n, 1] += len(t.encode(d.text, add_special_tokens=False).ids)
        seen.add(d.text)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in tr.op6_token_rollup(spark, sf).collect()}
    assert got == {g: (want[*g, 0], want[*g, 1]) for g in groups}


def test_odd_documents(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    schema = "doc_id bigint, text string, source string, lang string, text_key int"
    df = spark.createDataFrame([(1, None, None, None, 1), (None, "", "s", "en", 1), (2, "a " * 30000, "s", "en", 1), (2, "a a", "s", "en", 1), (2, "a a", "s", "en", 1)], schema)
    assert sorted(r.v for r in tr.counted(df, {"v": path}).collect()) == [0, 0, 2, 2, 30001]
    assert tr.counted(df.limit(0), {"v": path}).count() == 0


def insert(spark, k):
    return spark.createDataFrame([("insert", k, "a", "en", "v1", 10, None, 0)], CHANGE)


@pytest.mark.parametrize("after", range(1, 8))
def test_folds_that_break_off_after_any_step(spark, after):
    class Broken(Exception):
        pass

    r = tr.Rollup(spark, Workspace(spark, "t").path + "/r")
    for k in range(3):
        r.commit(f"b{k}", insert(spark, k))
    steps = [0]

    def counted(f):
        def run(*a):
            out = f(*a)
            steps[0] += 1
            if steps[0] == after:
                raise Broken
            return out

        return run

    b = tr.Rollup(spark, r.path)
    for name in ("_write", "_write_names", "_move", "_remove"):
        setattr(b, name, counted(getattr(b, name)))
    try:
        b.compact()
    except Broken:
        pass
    assert totals(r) == {("a", "en", "v1"): (3, 30)}
    assert r.commit("b3", insert(spark, 3)) and not r.commit("b1", insert(spark, 1))
    for _ in range(2):
        r.compact()
        assert totals(r) == {("a", "en", "v1"): (4, 40)}
    assert all(r.committed(f"b{k}") for k in range(4)) and len(r._stored()) == 1


@pytest.mark.parametrize("at", ["_claimed", "_move"])
@pytest.mark.parametrize("turn", [False, True])
def test_two_writers_of_one_batch(spark, at, turn):
    """The other writer commits whole between this one's look at what is there and its claim, or its move: whichever of the two row sets'
    hashes comes first, exactly one commit of other rows is True, the other raises, and totals never change after a True."""
    sets = [insert(spark, 1), insert(spark, 2).unionByName(insert(spark, 3))]
    sets = sets[::-1] if turn else sets
    for mine, theirs in ((sets[0], sets[1]), (sets[0], sets[0])):
        r = tr.Rollup(spark, Workspace(spark, "t").path + "/r")
        other, plain, answers, seen = tr.Rollup(spark, r.path), getattr(r, at), [], []

        def send(who, rows):
            try:
                answers.append(who.commit("b", rows))
            except tr.OtherContents:
                answers.append("raised")
            if True in answers:
                seen.append(totals(r))

        def late(*a):
            setattr(r, at, plain)
            send(other, theirs)
            return plain(*a)

        setattr(r, at, late)
        send(r, mine)
        assert answers.count(True) == 1
        assert sorted(map(str, answers)) == (["False", "True"] if mine is theirs else ["True", "raised"])
        for again in (mine, theirs):
            send(r, again)
        r.commit("c", insert(spark, 9))
        r.compact()
        assert len({str(s) for s in seen}) == 1
        more = totals(r)[("a", "en", "v1")]
        assert more == tuple(x + y for x, y in zip(seen[0][("a", "en", "v1")], (1, 10)))
        assert len(r._stored()) == 1


def test_a_claim_whose_writer_died(spark):
    r = tr.Rollup(spark, Workspace(spark, "t").path + "/r")
    r._claimed(r._key("b"), tr.digest(r._write(tr.delta(insert(spark, 1)), "_x")))
    with pytest.raises(tr.OtherContents):
        r.commit("b", insert(spark, 2).unionByName(insert(spark, 3)))
    assert not r.committed("b") and totals(r) == {}
    assert r.commit("b", insert(spark, 1)) and not r.release("b")
    r._claimed(r._key("c"), "other")
    assert r.release("c") and not r.release("c") and r.commit("c", insert(spark, 2))


def test_one_of_many_gets_a_claim(spark):
    from concurrent.futures import ThreadPoolExecutor

    from heliograph.llm.common import claim_text, claimed_text

    path = Workspace(spark, "t").path + "/deep/claim"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: claim_text(spark, path, f"writer {k}"), range(40)))
    assert won.count(True) == 1 and claimed_text(spark, path) == f"writer {won.index(True)}"


def test_counts_are_the_encodings_lengths():
    """Counting has patterns and sums of its own: texts of easy and other characters, special tokens, a cleared cache."""
    import random

    import public_tokenizers

    from heliograph.llm import bpe, token_store

    rng = random.Random(7)
    easy = "aZ é ÿÀ09 \t\n\r\x0b\x0c '~!.,'s 'll're <|endoftext|>"
    marks = ["<|endoftext|>", "[CLS]", "[SEP]", "'s", "  ", "\n\n"]
    texts = ["", " ", "<|endoftext|>", "<|endoftext|><|endoftext|> x"]
    for other in ("", "ªµß\x85\xa0\x1cŁ中😀½"):
        texts += ["".join(rng.choice(marks) if rng.random() < 0.1 else rng.choice(easy + other) for _ in range(rng.randrange(60))) for _ in range(600)]
    one = bpe.ByteBPE(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    two = token_store.WordIds(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert all(one.words_of(t) == one.pieces(t) for t in texts)
    for some in (texts, texts[::-1]):
        assert one.count_many(some) == [len(x) for x in one.encode_many(some)]
        assert two.count_many(some) == [len(e.ids) for e in two.lib.encode_batch(some, add_special_tokens=False)]
    one.cache.clear()
    one.sizes.clear()
    two.reset()
    assert one.count_many(texts[:9]) == [len(x) for x in one.encode_many(texts[:9])]
