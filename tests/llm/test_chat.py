import duckdb
from pyspark.sql import functions as F

from turnwise.llm import queries
from turnwise.llm.chat import conversations_as_rows, pair_neighbours, preference_pairs


def test_matches_sql(spark):
    for d in ("sf0.001", "sf0.01"):
        got = queries.op10_preference_formatting(spark, f"/root/testdata/{d}").toPandas().sort_values("pair_id").reset_index(drop=True)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{d}/conversations.parquet'")
        want = con.execute(queries.ORACLES["op10_preference_formatting"]).df().sort_values("pair_id").reset_index(drop=True)
        assert list(got.columns) == list(want.columns) and len(got) == len(want)
        for c in got.columns:
            assert [None if x != x else x for x in got[c]] == [None if x != x else x for x in want[c]], c


def test_prefix_and_masks(spark):
    same = [("system", "be kind"), ("user", "hi <|im_end|>")]
    rows = [(2, k, *t) for k, t in enumerate([*same, ("assistant", "yes"), ("user", "ok")])] + [(3, k, *t) for k, t in enumerate([*same, ("assistant", "no")])]
    rows += [(4, 0, "user", None), (4, 1, None, "x"), (6, 0, "user", "a"), (6, 1, "assistant", "b"), (7, 0, "user", "a"), (None, 0, "user", "z"), (9, 0, "user", "q")]
    rows += [(-1, 0, "user", "odd"), (-2, 0, "user", "even"), (-3, 0, "user", "lone")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, prompt int")
    got = {r.pair_id: r for r in preference_pairs(pair_neighbours(conversations_as_rows(turns))).collect()}
    one = got[1]
    assert one.n_prompt_turns == 2 and one.prompt.count("<|im_end|>") == 2
    cut = lambda text, spans: [text[s.begin : s.end] for s in spans]
    assert cut(one.chosen_text, one.chosen_spans) == ["yes<|im_end|>"] and cut(one.rejected_text, one.rejected_spans) == ["no<|im_end|>"]
    assert (got[3].n_prompt_turns, got[3].rejected_text, cut(got[3].chosen_text, got[3].chosen_spans)) == (1, "", ["b<|im_end|>"])
    assert got[2].rejected_text is None and got[2].n_prompt_turns == 1
    assert {k: (got[k].chosen_id, got[k].rejected_id) for k in (-2, -1)} == {-2: (None, -3), -1: (-2, -1)} and 0 not in got
    assert got[4].chosen_text is None and got[4].prompt == ""
    assert preference_pairs(pair_neighbours(conversations_as_rows(turns.where(F.lit(False))))).count() == 0
