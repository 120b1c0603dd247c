import pytest
from barloom.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string"
PAIR = "pair_id long, turn long, role string, text string"


def test_prefix_is_rendered_once_and_masks_cover_answers(spark):
    shared = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi <|end|> 🙂"), (1, 2, "assistant", "Hello")]
    chosen = [*shared, (1, 3, "user", "And?"), (1, 4, "assistant", "Größe 🙂")]
    rejected = [*shared, (1, 3, "user", "And?"), (1, 4, "assistant", "")]
    row = chat_format.format_pairs(chat_format.paired(spark.createDataFrame(chosen, PAIR), spark.createDataFrame(rejected, PAIR))).first()
    assert row.n_common == 4
    assert row.prompt == "<|system|>\nBe brief.<|end|>\n<|user|>\nHi < |end|> 🙂<|end|>\n<|assistant|>\nHello<|end|>\n<|user|>\nAnd?<|end|>\n"
    assert row.chosen == "<|assistant|>\nGröße 🙂<|end|>\n" and row.rejected == "<|assistant|>\n<|end|>\n"
    a, z = map(int, row.chosen_mask.split(":"))
    assert row.chosen[a:z] == "Größe 🙂<|end|>" and row.rejected_mask == "14:21"


def test_no_common_turns_and_several_answers(spark):
    chosen = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d")]
    rejected = [(1, 0, "user", "x")]
    row = chat_format.format_pairs(chat_format.paired(spark.createDataFrame(chosen, PAIR), spark.createDataFrame(rejected, PAIR))).first()
    assert row.n_common == 0 and row.prompt == "" and row.rejected_mask == ""
    assert [row.chosen[int(a) : int(z)] for a, z in (m.split(":") for m in row.chosen_mask.split(","))] == ["b<|end|>", "d<|end|>"]


def test_swapped_answers(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "zero"), (1, 0, "user", "q"), (1, 1, "assistant", "one"), (1, 2, "user", "bye"), (4, 0, "user", "alone"), (4, 1, "assistant", "four"), (6, 0, "user", "none here")]
    out = {r.pair_id: r for r in chat_format.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert "one" in out[0].rejected and "zero" in out[1].rejected and out[1].chosen.endswith("bye<|end|>\n")
    assert out[4].rejected == "<|assistant|>\n<|end|>\n" and out[6].chosen == out[6].rejected == "" and out[6].n_common == 1


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")]])
def test_nothing_to_format(spark, rows):
    assert chat_format.report(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (1, 1, "assistant", "y" * 200_000), (2, 0, "assistant", "")]
    out = {r.pair_id: r for r in chat_format.report(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", n int, id string")).collect()}
    assert out[1].prompt.startswith("<|unknown|>\n<|end|>\n<|user|>\n<|end|>\n<|user|>\n<|end|>\n") and out[1].n_common == 4 - 1
    assert out[2].n_common == 1 and out[2].chosen == "", "a missing partner's answer is empty, as this one's is"
    one = chat_format.format_pairs(spark.createDataFrame([(1, None, None)], "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")).first()
    assert one.n_common == 0 and one.prompt == one.chosen == one.rejected == ""
