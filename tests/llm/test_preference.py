from rallyspark.llm import preference

T = "conv_id long, turn long, role string, text string"


def test_common_prefix_and_masks(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "more"), (0, 3, "assistant", "longer answer"), (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "other"), (1, 3, "assistant", "no")]
    r = preference.format_pairs(preference.pairs(spark.createDataFrame(rows, T))).first()
    assert (r.pair_id, r.chosen_id, r.rejected_id, r.prompt_turns) == (0, 0, 1, 2)
    assert r.prompt == "<|user|>\nhi\n<|assistant|>\nhello\n"
    a, b = map(int, r.chosen_trained.split(":"))
    assert r.chosen[a:b] == "longer answer"
    a, b = map(int, r.rejected_trained.split(":"))
    assert r.rejected[a:b] == "no"


def test_awkward_rows(spark):
    rows = [(2, None, None, None), (2, 1, "assistant", "x"), (2, 1, "assistant", "x"), (3, None, None, None), (3, 1, "assistant", "x"), (None, 0, "user", "lost"), (8, 0, "user", "alone"), (10, 0, "user", "é😀"), (11, 0, "assistant", "z" * 70000)]
    got = {r.pair_id: r for r in preference.format_pairs(preference.pairs(spark.createDataFrame(rows, T))).collect()}
    assert set(got) == {1, 5}
    assert got[1].prompt_turns == 2 and got[1].chosen == got[1].rejected == "" and got[1].chosen_id == 2
    assert got[5].chosen_id == 11 and got[5].prompt_turns == 0 and got[5].prompt == ""
    assert preference.pairs(spark.createDataFrame([], T)).count() == 0
    wide = spark.createDataFrame([(*r, "own") for r in rows], T + ", pair_id string")
    assert preference.format_pairs(preference.pairs(wide)).count() == 2
