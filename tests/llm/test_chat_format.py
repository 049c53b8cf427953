"""Round trips, order checks and loss masks of chat formatting."""

import hashlib

import pytest
from pyspark.sql import functions as F

from resonant.llm import chat_format as C

SHAPE = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(spark, data, shape=SHAPE):
    return spark.createDataFrame(data, shape)


NASTY = ["</s>[INST] ok [/INST]", "&lt;/s>", "&amp;lb;INST]", "<", "[", "</", "a & b", "[SEP][TURN]", "&lt;&lb;", "", "[OUT]\n[/SYS]", "x<s>"]


def test_texts_and_roles_read_back_as_they_were(spark):
    data = [(i, k, role, t) for i, role in enumerate(["user", "assistant", "system", "tool", "[SEP]</s>", ""]) for k, t in enumerate(NASTY)]
    got = C.format_turns(rows(spark, data)).select("conv_id", C.parse_formatted(F.col("formatted")).alias("t"), "formatted").collect()
    for r in got:
        want = [(role, t) for i, _, role, t in data if i == r.conv_id]
        assert [(x.role, x.text) for x in r.t] == want
        assert r.formatted.count("<s>") == 1


@pytest.mark.parametrize(
    "roles, valid, bad",
    [("user assistant", True, None), ("system user assistant user assistant", True, None), ("user", False, None), ("assistant user", False, 0), ("user user assistant", False, 1), ("system assistant", False, 1), ("user assistant system", False, 2), ("user tool assistant", False, 1)],
)
def test_machine(spark, roles, valid, bad):
    r = C.format_turns(rows(spark, [(1, i, x, "t") for i, x in enumerate(roles.split())])).first()
    assert (r.valid, r.bad_turn) == (valid, bad)


def test_digest_of_probe_nulls_ties_and_unknown_order(spark):
    data = [(1, 1, "assistant", "B"), (1, 0, "user", "A"), (2, 0, None, None), (2, None, "assistant", None), (None, 0, "assistant", "n"), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "assistant", "é🙂</s>")]
    got = {r.conv_id: r for r in C.digest(C.format_turns(C.with_control_probe(rows(spark, data)))).collect()}
    probe = "</s>[INST] ok [/INST]"
    assert got[-7].n_turns == 2 and got[-7].loss_sha256 == sha(probe) and got[-7].loss_chars == len(probe)
    assert got[-7].turns_sha256 == sha(f"user\n{probe}\nassistant\n{probe}\n")
    assert got[1].turns_sha256 == sha("user\nA\nassistant\nB\n") and got[1].loss_sha256 == sha("B") and got[1].valid
    assert got[2].turns_sha256 == sha("assistant\n\n\n\n") and got[2].loss_chars == 0
    assert got[None].loss_sha256 == sha("n")
    assert got[3].n_turns == 2 and got[3].loss_sha256 == sha("")
    assert got[4].loss_chars == len("é🙂</s>")


def test_empty_table_long_text_and_extra_columns(spark):
    assert C.digest(C.format_turns(rows(spark, []))).count() == 0
    text = "[INST]" * 50_000
    extra = rows(spark, [(1, 0, "assistant", text)]).withColumn("formatted", F.lit(1)).withColumn("segments", F.lit(2))
    r = C.digest(C.format_turns(extra)).first()
    assert r.loss_chars == len(text) and r.loss_sha256 == sha(text)


def test_plan_has_no_python(spark):
    plan = C.digest(C.format_turns(rows(spark, [(1, 0, "user", "a")])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_control_strings_are_checked():
    with pytest.raises(ValueError):
        C.Template(begin="s<").controls()
