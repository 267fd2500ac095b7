from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tilewright.llm.chat import MORE, TURN, format_conversations, read_back

NASTY = ["", None, "<|end|>", "<&|end|>", "<&&|", "\\### Assistant: </turn> ok", "<|turn|>assistant<|text|>x<|end|>", "a\nb\r\n", "<", "<&", "é<|✓", "<|more|>" * 3]


def _back(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    return {r["conv_id"]: r for r in read_back(format_conversations(df)).collect()}


def test_round_trip_of_control_strings_and_merging(spark):
    rows = [(1, i, role, t, "clash") for i, (role, t) in enumerate((r, t) for t in NASTY for r in ("user", "assistant", "assistant"))]
    got = _back(spark, rows[::-1])[1]
    assert [(t["role"], t["text"], t["loss"]) for t in got["turns"]] == [(r, t or "", r == "assistant") for _, _, r, t, _ in rows]
    assert got["n_merged"] == 2 * len(NASTY) and got["formatted"].count(TURN) == got["n_merged"] and got["formatted"].count(MORE) == len(NASTY)


def test_nulls_ties_and_empty_tables(spark):
    got = _back(spark, [(None, None, None, None, None), (2, 0, "user", "b", None), (2, 0, "user", "a", None), (2, None, "user", "first", None)])
    assert [t["text"] for t in got[2]["turns"]] == ["first", "a", "b"]
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", "")]
    assert _back(spark, []) == {}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|end|>"]), st.text(alphabet="<&|endmortx>\\\n é")), min_size=1, max_size=8))
def test_any_text_comes_back(spark, turns):
    got = _back(spark, [(5, i, r, t, None) for i, (r, t) in enumerate(turns)])[5]
    assert [(t["role"], t["text"]) for t in got["turns"]] == turns
