import hashlib
import itertools
import zlib

import pytest
from helpers import clashing, store
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import repair

FIRST = {"system": "s", "user": "u", "assistant": "a"}


def good(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return not initials or bool(rest) and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2)


def brute(turns):
    """(cost, audit, roles) of the cheapest and then least of all edits, by trying them; turns are (initial, fault)."""
    gaps = [("", ""), ("u", "I"), ("a", "I"), ("ua", "II"), ("au", "II")]
    found = []
    for inserts in itertools.product(gaps, repeat=len(turns) + 1):
        for edits in itertools.product("KuaD", repeat=len(turns)):
            roles, audit, cost = inserts[0][0], inserts[0][1], 5 * len(inserts[0][1])
            for (initial, fault), edit, gap in zip(turns, edits, inserts[1:]):
                if edit == "D":
                    audit, cost = audit + "D", cost + 2
                elif fault in (repair.BLANK, repair.DUPLICATE):
                    break
                else:
                    roles += initial if edit == "K" else edit
                    audit, cost = audit + ("K" if edit == "K" else "R"), cost + (edit != "K") + 5 * (fault == repair.TRUNCATED)
                roles, audit, cost = roles + gap[0], audit + gap[1], cost + 5 * len(gap[1])
            else:
                if good(roles):
                    found.append((cost, audit, roles))
    return min(found)


turn = st.tuples(st.sampled_from("suax"), st.sampled_from(range(4)))


@settings(max_examples=60, deadline=None)
@given(st.lists(turn, max_size=3))
def test_edits_are_the_cheapest_and_least(turns):
    cost, role, audit = repair.finish(repair.choose(turns, repair.NONE))
    assert (cost, audit) == brute(turns)[:2]
    names = {"s": "system", "u": "user", "a": "assistant", "x": "x"}
    left = repair.apply([(names[i], "t") for i, _ in turns], audit)
    assert good("".join(r[0] for r, _ in left))


@settings(max_examples=200, deadline=None)
@given(st.lists(turn, max_size=30), st.integers(1, 7))
def test_segments_chained_are_the_whole(turns, size):
    import pyarrow as pa

    rows = [repair._summary(0, k, 1, [("system" if i == "s" else {"u": "user", "a": "assistant"}.get(i, i), "t", f) for i, f in turns[a : a + size]], [None] * len(turns[a : a + size]), False) for k, a in enumerate(range(0, max(len(turns), 1), size))]
    table = pa.Table.from_pylist([{k: v for k, v in r.items() if k not in ("turns", "whole")} for r in rows])
    steps = repair.chain(table).to_pylist()
    audit = ""
    for r, s in zip(rows, steps, strict=True):
        ends = repair.choose([(t["role"][:1], t["fault"]) for t in r["turns"]], s["before"])
        audit += ends[s["after"]][1] + ("I" * repair.AFTER[s["after"]] if s["last"] else "")
    cost, _, whole = repair.finish(repair.choose(turns, repair.NONE))
    assert (steps[-1]["cost"], audit) == (cost, whole)


def plain(rows):
    """The contract by definition, from (conv_id, turn, role, text) rows."""
    out = {}
    for conv, turn_, role, text in rows:
        done = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn_ is None else turn_}"
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        done += [(turn_ is not None, turn_ or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    found = {}
    for conv, turns in out.items():
        turns = sorted(turns, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        faults, seen = [], set()
        for _, _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append(repair.BLANK if not bare else repair.DUPLICATE if (role, text) in seen else repair.TRUNCATED if bare[-1] not in ".!?" else repair.FINE)
            seen.add((role, text))
        initials = [t[2][:1] for t in turns]
        known = [t[1] for t in turns if t[0]]
        cost, _, audit = repair.finish(repair.choose(list(zip(initials, faults)), repair.NONE))
        lines = [f"{r}:{t}" for r, t in repair.apply([t[2:] for t in turns], audit)]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        found[conv] = (gaps, *(faults.count(f) for f in (repair.BLANK, repair.DUPLICATE, repair.TRUNCATED)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def test_query_on_hard_rows(spark, tmp_path):
    big = 9007199254740993
    rows = [(big, 0, "user", "q."), (big, 1, "assistant", "a"), (big + 1, 0, "tool", None), (None, 0, "user", "no id?"), (None, None, None, None), (None, 2, "assistant", "yes!"),
            (3, 5, "", "x."), (3, None, "assistant", "no turn."), (3, None, "user", "."), (4, 0, "assistant", "w " * 300_000), (5, 0, "user", "same."), (5, 0, "user", "same."), (5, 3, "user", "same."),
            (6, 0, "assistant", " \t\n"), (7, 1, "user", "é😀…"), (7, 2, "unknown", "b.\r\n")]
    rows += [(100 + k, t, ("user", "assistant")[t % 2], f"text {t}{'.' if k % 3 else ''}") for k in range(30) for t in range(k % 6)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    sf = store(spark, tmp_path, "conversations", clashing(frame, "conv", "n", "part", "audit", "fault"))
    got = {r.conv_id: tuple(r)[1:] for r in repair.query(spark, sf).collect()}
    assert got == plain(rows)
    assert repair.query(spark, store(spark, tmp_path / "e", "conversations", frame.limit(0))).count() == 0


def test_a_conversation_without_rows_after_damage(spark, tmp_path):
    conv = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    sf = store(spark, tmp_path, "conversations", spark.createDataFrame([(conv, 0, "user", "q.")], "conv_id long, turn long, role string, text string"))
    (row,) = repair.query(spark, sf).collect()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("most", [3, 50])
def test_a_conversation_that_holds_most_rows_spreads_over_tasks(spark, most):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would be read by one task
    rows = [(1, t, ("user", "assistant", "user", "system")[t % 4], f"text {t % 700}{'.' if t % 5 else ''}") for t in range(2000)] + [(1, 2000, "user", "again.")] * 300
    rows += [(k, t, "user", "hello.") for k in range(2, 40) for t in range(3)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    try:
        pieces = repair.repair(repair.damage(frame), most)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert pieces.where("conv = 1").select("part").distinct().count() > 1
    got = {r.conv: (r.gaps, r.n_blank, r.n_duplicate, r.n_truncated, r.n_illegal, r.cost, r.audit, r.repaired_sha256) for r in repair.digests(pieces).collect()}
    assert got == plain(rows)
