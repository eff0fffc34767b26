from heliograph.llm import preference as pf
from tests.llm.helpers import same_rows

CONV = "conv_id bigint, turn bigint, role string, text string, turns int"


def test_oracle(spark):
    sf = "/root/testdata/sf0.01"
    got = pf.op2_preference(spark, sf)
    assert same_rows(got, pf.ORACLE_SQL, sf) == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
    rows = got.collect()
    turns = lambda r, side: r[side].count("<|end|>")
    assert sum(r.n_prompt_turns > 1 for r in rows) > 30 and sum(turns(r, "chosen") > 1 for r in rows) > 30 and sum(turns(r, "rejected") > 1 for r in rows) > 30
    assert sum(r.chosen_spans.count(":") > 1 or r.rejected_spans.count(":") > 1 for r in rows) > 20


def test_marks_in_texts(spark, tmp_path):
    rows = [(1, 0, "a|b\\", "x <|end|>\n \\"), (1, 1, "assistant", "<|assistant|>"), (2, 0, "user", "y"), (2, 1, "assistant", "<\\|"), (3, 0, "user", "no reply"), (3, 1, "user", "|>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], CONV)
    (tmp_path / "sf").mkdir()
    df.write.parquet(f"{tmp_path}/sf/conversations.parquet")
    out = pf.op2_preference(spark, f"{tmp_path}/sf")
    assert same_rows(out, pf.ORACLE_SQL, f"{tmp_path}/sf") == 3
    for r in out.collect():
        for s in (r.prompt, r.chosen, r.rejected):
            assert s.count("<|end|>") == s.count("<|") / 2


def pairs(spark, chosen, rejected):
    table = lambda rows: pf.turns_of(spark.createDataFrame([(*r, 1) for r in rows], CONV)).withColumnRenamed("conv_id", "pair_id")
    return {r.pair_id: r for r in pf.preference_pairs(table(chosen), table(rejected)).collect()}


def test_prefix_and_masks(spark):
    base = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "and?")]
    chosen = [*base, (1, 3, "assistant", "good"), (2, 0, "user", "a"), (3, 0, "user", "same"), (4, 0, "user", "x"), (None, 0, "user", "n")]
    rejected = [*base, (1, 3, "assistant", "bäd"), (1, 4, "user", "hm"), (1, 5, "assistant", None), (2, 0, "user", "b"), (3, 0, "user", "same"), (5, 0, "user", "x"), (None, 0, "user", "n")]
    got = pairs(spark, chosen, rejected)
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert one.n_prompt_turns == 3 and one.prompt.count("<|end|>") == 3 and one.differs
    assert [one.chosen[s.start : s.stop] for s in one.chosen_spans] == ["good<|end|>\n"]
    assert [one.rejected[s.start : s.stop] for s in one.rejected_spans] == ["bäd<|end|>\n", "<|end|>\n"]
    assert (got[2].n_prompt_turns, got[2].prompt, got[2].chosen_spans) == (0, "", [])
    assert (got[3].n_prompt_turns, got[3].chosen, got[3].rejected, got[3].differs) == (1, "", "", False)
    shorter = pairs(spark, base, base[:1])
    assert shorter[1].n_prompt_turns == 1 and shorter[1].rejected == "" and shorter[1].differs


def test_edge_cases(spark):
    rows = [(7, None, None, None), (8, 0, "assistant", "only"), (9, 0, "user", "a"), (9, 1, "assistant", "b " * 40000), (9, 1, "assistant", "b " * 40000), (10, 0, "user", "no reply"), (None, 0, "assistant", "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], CONV)
    got = {r.pair_id: r for r in pf.preference_pairs(*pf.contrasted(df)).collect()}
    assert set(got) == {7, 8, 9, 10} and (got[10].n_prompt_turns, got[10].chosen, got[10].chosen_spans) == (1, "", [])
    assert got[9].n_prompt_turns == 2 and len(got[9].chosen_spans) == 1 and got[9].rejected == "" and got[9].differs
    assert got[8].prompt == "<|assistant|>\nonly<|end|>\n" and len(got[8].rejected_spans) == 2
    assert pf.preference_pairs(*pf.contrasted(df.limit(0))).count() == 0
