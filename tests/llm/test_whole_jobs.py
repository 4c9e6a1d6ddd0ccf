"""Whole jobs of the training-data operators: every row, every group."""

from evalspark.llm import chat, ngram_join
from evalspark.llm import queries as llm


def folder(tmp_path, **tables):
    """A scale-factor folder of DataFrames."""
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_turns_without_a_conversation_id_are_formatted(spark, tmp_path):
    big = 2**60 + 1
    turns = [(c, t, role, f"text {t}") for c in (None, big, 7) for t, role in enumerate(["user", "assistant"] * 3)]
    at = folder(tmp_path, conversations=spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: tuple(r)[1:] for r in llm.op1_chat_formatting(spark, at).collect()}
    assert got.keys() == {None, big, 7, -1} and got[None] == got[big] == got[7] and got[None][0] == 6


def test_messages_on_a_cycle_are_left_out(spark):
    rows = [(1, k, 1 + k % 3, "user", f"c{k}", 9.0) for k in (1, 2, 3)] + [(1, 4, 2, "user", "below", 9.0), (1, 5, None, "user", "root", 0.0), (1, 6, 5, "assistant", "leaf", 0.0), (2, 1, 1, "user", "self", 1.0), (None, 1, None, "user", "q", 1.0), (None, 2, 1, "assistant", "a", 1.0)]
    messages = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")
    for most in (1, 2):
        best = chat.format_paths(chat.best_paths(messages, most), messages).collect()
        assert {r.tree: r.formatted for r in best} == {1: chat.render([("user", "root"), ("assistant", "leaf")]), None: chat.render([("user", "q"), ("assistant", "a")])}
    assert chat.best_paths(messages.limit(0)).count() == 0


def test_one_row_of_each_group_of_near_copies_stays(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (5, a), (5, a), (5, f"{a} more"), (9, a), (5, b), (6, b), (7, c), (None, c), (None, ""), (None, ""), (3, ""), (3, ""), (4, None), (None, "alone")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, row long")
    out = ngram_join.drop_near_duplicates(docs)
    got = [(r.doc_id, (r.text or "")[:1]) for r in out.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert out.columns == docs.columns
    assert sorted(got, key=key) == sorted([(5, "a"), (5, "b"), (7, "c"), (None, ""), (3, ""), (4, ""), (None, "a")], key=key)
