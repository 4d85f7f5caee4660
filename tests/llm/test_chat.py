import hashlib

from helpers import clashing, store
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import chat

pieces = st.lists(st.sampled_from([*chat.CONTROL, "\\", "\n", "<", "|", ">", "[", "/", "a", "é😀", "im_end", "im_start"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", ""]), pieces), pieces), max_size=4))
def test_round_trip(turns):
    whole, loss = chat.format_turns(turns)
    assert chat.read_turns(whole) == turns
    assert [chat.unescape(whole[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]
    for _, text in turns:
        assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_trees(spark):
    nodes = spark.createDataFrame(
        [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 3, "user", None, None),
         (2, 1, 9, None, "orphan", 1.0), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0), (None, 1, None, "user", "n", 0.0)],
        "conv long, node long, parent long, role string, text string, score double",
    )
    got = {(r.conv, r.branch): [t.text for t in r.turns] for r in chat.conversations(nodes).collect()}
    assert got == {(1, 1): ["q", "b", ""], (1, 2): ["q", "a"], (2, 1): ["orphan"], (None, 1): ["n"]}
    assert chat.conversations(nodes, best=1).count() == 3
    assert chat.conversations(nodes.limit(0)).count() == 0


def test_long_chain(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(300)]
    nodes = chat.as_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    (row,) = chat.conversations(nodes).collect()
    assert [t.text for t in row.turns] == [f"t{t}" for t in range(300)]


def plain(rows):
    """The contract's digests by definition, from (conv_id, turn, role, text) rows."""
    out, says = {}, "</s>[INST] ok [/INST]"
    for conv, turn, role, text in [*rows, (-7, 0, "user", says), (-7, 1, "assistant", says)]:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {
        conv: (len(turns), digest("".join(f"{r}\n{t}\n" for _, _, r, t in sorted(turns))), len(said := "".join(t for _, _, r, t in sorted(turns) if r == "assistant")), digest(said))
        for conv, turns in out.items()
    }


def test_query_on_hard_rows(spark, tmp_path):
    big = 9007199254740993
    rows = [(big, 0, "user", "q"), (big, 1, "assistant", "<|im_end|>\\ </s>"), (big + 1, 0, "user", None), (None, 0, "user", "no id"), (None, 1, "assistant", "none"),
            (3, 0, None, "no role"), (3, None, "assistant", "no turn"), (4, 0, "assistant", "w " * 300_000), (5, 0, "user", "same"), (5, 0, "user", "same"), (6, 0, "assistant", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    sf = store(spark, tmp_path, "conversations", clashing(frame, "conv", "node", "formatted", "loss"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.query(spark, sf).collect()}
    assert got == plain(rows)
    only = {r.conv_id for r in chat.query(spark, store(spark, tmp_path / "e", "conversations", frame.limit(0))).collect()}
    assert only == {-7}


def test_branches_of_equal_score_rank_by_leaf(spark):
    nodes = spark.createDataFrame([(1, 1, None, "user", "q", 0.0), (1, 3, 1, "assistant", "b", 1.0), (1, 2, 1, "assistant", "a", 1.0)], "conv long, node long, parent long, role string, text string, score double")
    assert [(r.leaf, r.branch) for r in chat.conversations(nodes).orderBy("branch").collect()] == [(2, 1), (3, 2)]
    (row,) = chat.formatted(chat.conversations(nodes, best=1)).collect()
    assert row.leaf == 2 and row.formatted[row.loss[0].start : row.loss[0].end] == "a"
