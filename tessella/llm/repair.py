"""Repair of the structure of conversations: a dynamic program over the turns that are retained.

A conversation is repaired when its roles are an optional system turn and then pairs of a user and an assistant turn, or
nothing. Every turn is kept, given another role or deleted, and empty turns may be inserted. The program chooses which
turns to retain, and as what: for a turn retained with a role, the best retained turn before it follows from a running
minimum for each role, of cost less the sum of deletions so far, so the price of the gap between the two is the
difference of two prefix sums plus the inserts that their pair of roles needs. Equal costs go by the audit, the string
of edits (``D`` < ``I`` < ``K`` < ``R``). No audit of the same turns that ends in a retained or deleted turn is the
beginning of another, so the least audit of a whole begins with the least audit of its parts.

Turns are dealt by ranges of (conversation, turn, role, text), so a conversation of any length spreads over tasks, and are
cut to segments of at most ``SEGMENT`` turns or about ``LARGE`` characters. A segment is solved for each of four roles that may come before it; a
conversation's segments are chained by 32 small numbers each (costs, and the order of audits), and only then are
texts repaired, segment by segment. A conversation that lies inside one task and segment takes no further step.

Faults, the first that holds: blank (no word), duplicate (role and text seen earlier in the conversation), truncated (the
last character that is not white space is none of ``.!?``). Blank and duplicate turns are deleted.

Nulls: a null conversation is one of its own, a null turn comes first, null roles and texts are one space. Rows that repeat
all four values follow each other and are counted before they are dealt. Roles other than system, user and assistant count
by their first letter; one with another first letter can't be kept. Columns of any other name are not read. Empty in,
empty out. A text of any length is one value; an audit is one string, so a conversation has 2^31 turns at most.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut

#: Turns of a segment, and characters after which one ends.
SEGMENT, LARGE = 1024, 1 << 24
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ROLE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Turns to insert between a retained role and the next one, and after the last; None where none helps.
BETWEEN = [[None, 0, 0, 1], [None, None, 0, 1], [None, None, 1, 0], [None, None, 0, 1]]
AFTER = [0, 2, 1, 0]
INSERT, DELETE, REROLE, TRUNCATED_KEPT = 5, 2, 1, 5
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"


def choose(turns: list[tuple[str, int]], before: int) -> list[tuple[int, str] | None]:
    """For each role that may be the last retained one: least cost and its least audit, after ``before``.

    ``turns`` are (initial of the role, fault). The inserts that the role before the segment needs belong to the segment.
    """
    best: list[tuple[int, str] | None] = [None] * 4  # running minima: cost less deletions so far, and the audit
    best[before] = (0, "")
    deleted = 0
    for initial, fault in turns:
        kept: list[tuple[int, str] | None] = [None] * 4
        if fault in (FINE, TRUNCATED):
            own = ROLE.get(initial)
            for role in (SYSTEM, USER, ASSISTANT):
                if role == SYSTEM and own != SYSTEM:
                    continue
                letter, price = ("K", 0) if own == role else ("R", REROLE)
                price += deleted + (TRUNCATED_KEPT if fault == TRUNCATED else 0)
                for last in STATES:
                    n = BETWEEN[last][role]
                    if n is not None and (old := best[last]) is not None:
                        new = (old[0] + INSERT * n + price, old[1] + "I" * n + letter)
                        if kept[role] is None or new < kept[role]:
                            kept[role] = new
        deleted += DELETE
        for role in STATES:
            gone = best[role] and (best[role][0], best[role][1] + "D")
            stays = kept[role] and (kept[role][0] - deleted, kept[role][1])
            best[role] = min(gone, stays) if gone and stays else gone or stays
    return [b and (b[0] + deleted, b[1]) for b in best]


def finish(ends: list[tuple[int, str] | None]) -> tuple[int, int, str]:
    """(cost, role, audit) of a whole conversation from what ``choose`` found."""
    cost, audit, role = min((e[0] + INSERT * AFTER[q], e[1] + "I" * AFTER[q], q) for q, e in enumerate(ends) if e)
    return cost, role, audit


def apply(turns: list[tuple[str, str]], audit: str, before: int = NONE) -> list[tuple[str, str]]:
    """The (role, text) turns that an audit leaves."""
    out, rest = [], iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rest)
        if edit == "D":
            continue
        if edit in "IR":
            role = "assistant" if before == USER else "user"
        out.append((role, text))
        before = ROLE[role[:1]]
    return out


def damage(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, n) of (conv_id, turn, role, text): faults by the hash of conversation and turn.

    n is how many times the row stands: 0 once it is dropped, 2 once it is repeated.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key) % 20
    text = F.coalesce("text", blank)
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", blank))
    n = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), n.cast("long").alias("n"))


def faults(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number ``n``, the fault of the first (``fault``) and of the others (``again``)."""
    gone = F.col("n") == 0
    rows = rows.select("conv", "turn", *(F.when(gone, F.lit("")).otherwise(F.coalesce(c, F.lit(" "))).alias(c) for c in ("role", "text")), "n")
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    named = rows.where("n > 0").select("conv", "role", F.sha2("text", 256).alias("said"), F.struct(F.col("turn").isNotNull().alias("known"), "turn").alias("at"))
    many = named.groupBy("conv", "role", "said").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    many = many.select(F.col("conv").alias("c"), F.col("role").alias("r"), "said", F.col("first.turn").alias("first"), F.lit(True).alias("more"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.sha2("text", 256) == F.col("said"))
    seen = F.coalesce("more", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first"))
    bare = F.rtrim("text", F.lit(SPACE))
    first = F.when(bare == "", BLANK).when(seen, DUPLICATE).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    joined = rows.join(many, same, "left")
    return joined.select("conv", "turn", "role", "text", "n", first.alias("fault"), F.when(bare == "", BLANK).otherwise(DUPLICATE).alias("again"))


TURNS = "array<struct<role:string,text:string,fault:int>>"
STATS = ["n_blank", "n_duplicate", "n_truncated", "n_illegal", "n_turns", "low", "high"]


def _summary(part, order, conv, turns, numbers, whole) -> dict:
    """A segment as a row; ``numbers`` are the turn numbers of its rows."""
    tally = [0] * 4
    for _, _, fault in turns:
        tally[fault] += 1
    initials = [r[:1] for r, _, _ in turns]
    known = [x for x in numbers if x is not None]
    row = {
        "part": part, "ord": order, "conv": conv, "whole": whole, "first_role": initials[0] if turns else None, "last_role": initials[-1] if turns else None,
        "n_blank": tally[BLANK], "n_duplicate": tally[DUPLICATE], "n_truncated": tally[TRUNCATED],
        "n_illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "n_turns": len(set(known)),
        "low": known[0] if known else None, "high": known[-1] if known else None, "costs": None, "ranks": None,
        "turns": [{"role": r, "text": t, "fault": f} for r, t, f in turns],
    }
    if not whole:
        costs, ranks = [], []
        for before in STATES:
            ends = choose([(r[:1], f) for r, _, f in turns], before)
            ordered = sorted((e[1], q) for q, e in enumerate(ends) if e)
            place = {q: k for k, (_, q) in enumerate(ordered)}
            costs += [-1 if e is None else e[0] for e in ends]
            ranks += [place.get(q, -1) for q in STATES]
        row |= {"costs": costs, "ranks": ranks}
    return row


def segments(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """Conversations cut to runs of at most ``most`` turns, (part, ord) ascending in the order of turns."""
    kind = dict(rows.dtypes)["conv"]
    order = ["conv", "turn", "role", "text"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = pa.schema([
        ("part", pa.int32()), ("ord", pa.int64()), ("conv", pa.null()), ("whole", pa.bool_()), ("first_role", pa.string()), ("last_role", pa.string()),
        *((s, pa.int64()) for s in STATS), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())),
        ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("fault", pa.int32())]))),
    ])

    def run(batches):
        out, turns, numbers, here, order, part, began = [], [], [], None, 0, None, False
        ended = 0  # conversations that have ended in this task
        typed, split, held, made = None, False, 0, 0  # characters of the segment, and of those not yet handed on

        def close(whole):
            nonlocal order, turns, numbers, held, made
            out.append(_summary(part, order, here, turns, numbers, whole))
            order, turns, numbers, held, made = order + 1, [], [], 0, made + held

        def flush():
            nonlocal out, made
            done, out, made = pa.RecordBatch.from_pylist(out, typed), [], 0
            return done

        for b in batches:
            typed = typed or pa.schema([f if f.name != "conv" else pa.field("conv", b.schema.field("conv").type) for f in schema])
            for conv, turn, role, text, n, fault, again, p in zip(*(b.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "n", "fault", "again", "part")), strict=True):
                if began and conv != here:
                    close(not split and ended > 0)  # the first one may go on from the task before
                    ended, split = ended + 1, False
                here, began, part = conv, True, p
                for k in range(n):
                    if len(turns) == most or held > LARGE:
                        close(False)
                        split = True
                    turns.append((role, text, again if k else fault))
                    numbers.append(turn)
                    held += len(text)
                if made > LARGE or len(out) > 2000:
                    yield flush()
        if began:
            close(False)  # the last one may go on in the next task
            yield flush()

    ddl = f"part int, ord long, conv {kind}, whole boolean, first_role string, last_role string, " + ", ".join(f"{s} long" for s in STATS) + f", costs array<long>, ranks array<long>, turns {TURNS}"
    return placed.mapInArrow(run, ddl)


def chain(table: pa.Table) -> pa.Table:
    """Of one conversation's segments: the role before each, the role it ends in, and the conversation's numbers in the last."""
    table = table.sort_by([("part", "ascending"), ("ord", "ascending")])
    rows = table.drop_columns(["conv"]).to_pylist()
    cost, rank, back = [0, None, None, None], [0, None, None, None], []
    for r in rows:
        best = [min(((cost[p] + r["costs"][p * 4 + q], rank[p], p) for p in STATES if cost[p] is not None and r["costs"][p * 4 + q] >= 0), default=None) for q in STATES]
        back.append([b and b[2] for b in best])
        ordered = sorted((b[1], r["ranks"][b[2] * 4 + q], q) for q, b in enumerate(best) if b)
        place = {q: k for k, (_, _, q) in enumerate(ordered)}
        cost, rank = [b and b[0] for b in best], [place.get(q) for q in STATES]
    whole, _, end = min((cost[q] + INSERT * AFTER[q], rank[q], q) for q in STATES if cost[q] is not None)
    steps = []
    for k in range(len(rows) - 1, -1, -1):
        steps.append((back[k][end], end))
        end = back[k][end]
    steps.reverse()
    total = {s: sum(r[s] for r in rows) for s in ("n_blank", "n_duplicate", "n_truncated", "n_illegal", "n_turns")}
    spoken = [r for r in rows if r["first_role"] is not None]
    total["n_illegal"] += sum(a["last_role"] + b["first_role"] not in LEGAL for a, b in zip(spoken, spoken[1:]))
    numbered = [r for r in rows if r["low"] is not None]
    total["n_turns"] -= sum(a["high"] == b["low"] for a, b in zip(numbered, numbered[1:]))
    gaps = numbered[-1]["high"] - numbered[0]["low"] + 1 - total["n_turns"] if numbered else 0
    n = len(rows)
    out = {"before": pa.array([s[0] for s in steps], pa.int32()), "after": pa.array([s[1] for s in steps], pa.int32()), "last": pa.array([k == n - 1 for k in range(n)])}
    out |= {k: pa.array([v] * n, pa.int64()) for k, v in {"cost": whole, "gaps": gaps, **total}.items()}
    return pa.table({"part": table["part"], "ord": table["ord"], **out})


CHAINED = "part int, ord long, before int, after int, last boolean, cost long, gaps long, n_blank long, n_duplicate long, n_truncated long, n_illegal long, n_turns long"
NUMBERS = ["gaps", "n_blank", "n_duplicate", "n_truncated", "n_illegal", "cost"]


def repair(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """Pieces of repaired conversations, from (conv, turn, role, text, n).

    (conv, part, ord, whole, last, audit, turns, and numbers in the last piece): the pieces of a conversation in order of
    (part, ord), of which most have one. ``turns`` are the repaired (role, text), ``audit`` the edits.
    """
    cutting = cut(segments(faults(rows), most), "repair-segments")
    kind = dict(cutting.dtypes)["conv"]
    some = cutting.where(~F.col("whole"))
    chained = some.drop("turns", "whole").groupBy("conv").applyInArrow(chain, CHAINED)
    split = some.select("part", "ord", "conv", "whole", "turns").join(chained, ["part", "ord"])
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0).cast("long"))
    none = F.lit(None)
    alone = cutting.where("whole").select("part", "ord", "conv", "whole", "turns", none.cast("int").alias("before"), none.cast("int").alias("after"), F.lit(True).alias("last"), none.cast("long").alias("cost"), gaps.alias("gaps"), "n_blank", "n_duplicate", "n_truncated", "n_illegal", "n_turns")

    def run(batches):
        for b in batches:
            made = {"audit": [], "turns": [], "cost": []}
            for turns, before, after, last, cost in zip(*(b.column(c).to_pylist() for c in ("turns", "before", "after", "last", "cost")), strict=True):
                ends = choose([(t["role"][:1], t["fault"]) for t in turns], before or NONE)
                if after is None:
                    cost, _, audit = finish(ends)
                else:
                    audit = ends[after][1] + ("I" * AFTER[after] if last else "")
                made["audit"].append(audit)
                made["cost"].append(cost)
                made["turns"].append([{"role": r, "text": t} for r, t in apply([(t["role"], t["text"]) for t in turns], audit, before or NONE)])
            arrays = {"audit": pa.array(made["audit"], pa.string()), "turns": pa.array(made["turns"], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), "cost": pa.array(made["cost"], pa.int64())}
            names = ["conv", "part", "ord", "whole", "last", "audit", "turns", *NUMBERS]
            yield pa.RecordBatch.from_arrays([arrays[c] if c in arrays else b.column(c) for c in names], names=names)

    ddl = f"conv {kind}, part int, ord long, whole boolean, last boolean, audit string, turns array<struct<role:string,text:string>>, " + ", ".join(f"{c} long" for c in NUMBERS)
    columns = alone.columns
    return alone.mapInArrow(run, ddl).unionByName(split.select(*columns).mapInArrow(run, ddl))


def digests(pieces: DataFrame) -> DataFrame:
    """A row a conversation: its numbers, audit and the hash of its repaired turns, read piece by piece in order."""
    kind = dict(pieces.dtypes)["conv"]

    def run(batches):
        audit, hashed, empty = [], hashlib.sha256(), True
        for b in batches:
            rows = []
            for k, (piece, turns, last) in enumerate(zip(*(b.column(c).to_pylist() for c in ("audit", "turns", "last")), strict=True)):
                audit.append(piece)
                for t in turns:
                    hashed.update((("" if empty else "\n") + t["role"] + ":" + t["text"]).encode())
                    empty = False
                if last:
                    rows.append((k, "".join(audit), hashed.hexdigest()))
                    audit, hashed, empty = [], hashlib.sha256(), True
            at = pa.array([r[0] for r in rows], pa.int64())
            arrays = [b.column(c).take(at) for c in ("conv", *NUMBERS)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["conv", *NUMBERS, "audit", "repaired_sha256"])

    ddl = f"conv {kind}, " + ", ".join(f"{c} long" for c in NUMBERS) + ", audit string, repaired_sha256 string"
    split = pieces.where(~F.col("whole")).repartition("conv").sortWithinPartitions("conv", "part", "ord")
    return pieces.where("whole").mapInArrow(run, ddl).unionByName(split.mapInArrow(run, ddl))


def query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = digests(repair(damage(rows)))
    names = {"conv": "conv_id", "n_blank": "blank", "n_duplicate": "duplicate", "n_truncated": "truncated", "n_illegal": "illegal"}
    return found.withColumnsRenamed(names).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


_BITS = "flatten([[(ord(c) >> k) & 1 FOR k IN range(8)] FOR c IN string_split(key, '')])"


def _step() -> str:
    """One turn: the least (cost, audit) for each last role of n, s, u and a."""

    def least(*options):
        return f"list_sort(list_filter([{', '.join(options)}], lambda o: o.c < 1000000000))[1]"

    def go(state, cost, letters):
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letters}'}}"

    stay = f"CASE WHEN t.fault IN ({BLANK}, {DUPLICATE}) THEN 1000000000 ELSE CASE WHEN t.fault = {TRUNCATED} THEN {TRUNCATED_KEPT} ELSE 0 END"
    options = {}
    for role, name in ((NONE, "n"), (SYSTEM, "s"), (USER, "u"), (ASSISTANT, "a")):
        options[name] = [go(name, DELETE, "D")]
        for last, state in ((NONE, "n"), (SYSTEM, "s"), (USER, "u"), (ASSISTANT, "a")):
            n = BETWEEN[last][role]
            if n is None:
                continue
            for letter, price in (("K", f"CASE WHEN t.initial = '{name}' THEN 0 ELSE 1000000000 END"), ("R", str(REROLE))):
                if letter == "K" or role != SYSTEM:
                    options[name].append(go(state, f"{INSERT * n} + {stay} + {price} END", "I" * n + letter))
    return ", ".join(f"coalesce({least(*o)}, {{'c': 1000000000, 'a': ''}}) AS {name}" for name, o in options.items())


_NONE = "{'c': 1000000000, 'a': ''}"
ORACLE = f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hashed AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, [b::BIGINT FOR b IN {_BITS}]),
    lambda x, b: xor(x >> 1, 3988292384::BIGINT * (xor(x, b) & 1))), 4294967295::BIGINT) % 20 AS kind FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS times, substr(role, 1, 1) AS initial,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS previous FROM placed),
turns AS MATERIALIZED (SELECT conv_id, turn, place, role, text, initial, previous,
    CASE WHEN bare = '' THEN {BLANK} WHEN times > 1 THEN {DUPLICATE} WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN {TRUNCATED} ELSE {FINE} END AS fault FROM seen),
numbers AS MATERIALIZED (SELECT conv_id, max(place) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate, count(*) FILTER (fault = {TRUNCATED}) AS truncated,
    count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
best AS (SELECT conv_id, 0::BIGINT AS place, {{'c': 0, 'a': ''}} AS n, {_NONE} AS s, {_NONE} AS u, {_NONE} AS a FROM numbers
  UNION ALL SELECT t.conv_id, t.place, {_step()} FROM best b JOIN turns t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.place = b.place + 1),
ended AS (SELECT b.conv_id, list_sort([{{'c': b.n.c, 'a': b.n.a}}, {{'c': b.s.c + {INSERT * AFTER[SYSTEM]}, 'a': b.s.a || 'II'}},
    {{'c': b.u.c + {INSERT * AFTER[USER]}, 'a': b.u.a || 'I'}}, {{'c': b.a.c, 'a': b.a.a}}])[1] AS won
  FROM best b JOIN numbers m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.n = b.place),
edits AS (SELECT conv_id, won.a AS audit, unnest(range(1, length(won.a) + 1)) AS k FROM ended),
said AS (SELECT e.conv_id, k, substr(audit, k, 1) AS edit, length(replace(substr(audit, 1, k), 'I', '')) AS place FROM edits e),
roles AS (SELECT s.*, t.role, t.text, count(*) FILTER (edit <> 'D') OVER (PARTITION BY s.conv_id ORDER BY k) AS nth,
    max(CASE WHEN edit = 'K' AND t.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS led
  FROM said s LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.place = s.place AND s.edit <> 'I'),
lines AS (SELECT conv_id, k, CASE WHEN edit = 'K' THEN role WHEN (nth - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line FROM roles WHERE edit <> 'D'),
hashes AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY k)) AS sha FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(m.gaps, 0) AS gaps, coalesce(m.blank, 0) AS blank, coalesce(m.duplicate, 0) AS duplicate, coalesce(m.truncated, 0) AS truncated,
  coalesce(m.illegal, 0) AS illegal, CAST(coalesce(e.won.c, 0) AS BIGINT) AS cost, coalesce(e.won.a, '') AS audit, coalesce(h.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN numbers m ON m.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN hashes h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
"""
