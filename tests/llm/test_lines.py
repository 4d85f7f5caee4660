from helpers import clashing, docs, store

from tessella.llm import lines


OWN = [chr(97 + k) * 5 for k in range(20)]


def rows(spark, texts):
    return docs(spark, [(k, t) for k, t in enumerate(texts)])


def texts_of(frame):
    frame = frame.select("doc.*") if "doc" in frame.columns else frame
    return {r.doc_id: r.text for r in frame.collect()}


def test_variable_fields_share_a_template(spark):
    texts = [f"{OWN[k]} {OWN[k + 1]} {OWN[k + 2]} {OWN[k + 3]}\nPosted by {'user' + chr(97 + k)} on 2024-01-{k:02d} at home" for k in range(14)]
    got = texts_of(lines.dedup(rows(spark, texts)))
    assert got[0] == texts[0]  # the template's first line stays
    assert all(got[k] == texts[k].split("\n")[0] for k in range(1, 14))


def test_rare_short_and_blank_lines_stay(spark):
    texts = [f"To. Be.\n\n  \n{OWN[k]} a {OWN[k + 1]} c {OWN[k + 2]} e\n{'shared line of words' if k < 9 else 'x y z' * k}" for k in range(12)]
    assert texts_of(lines.dedup(rows(spark, texts))) == dict(enumerate(texts))


def test_exact_copies_count_once(spark):
    texts = ["one two three four\nfive six seven eight"] * 30
    assert set(texts_of(lines.dedup(rows(spark, texts))).values()) == {texts[0]}


def test_a_line_twice_in_its_first_document(spark):
    texts = [f"all rights are reserved\nown{k}\nall rights are reserved" for k in range(12)]
    got = texts_of(lines.dedup(rows(spark, texts)))
    assert got[0] == "all rights are reserved\nown0" and all(got[k] == f"own{k}" for k in range(1, 12))


def test_stage_drops_emptied_documents(spark):
    frame = rows(spark, ["all rights are reserved", *(f"all rights are reserved\n{'z' * k}" for k in range(12))])
    kept = texts_of(lines.stage(spark, frame, None))
    assert kept[0] == "all rights are reserved" and 1 not in kept and kept[5] == "zzzz"


def test_edges(spark, tmp_path):
    frame = docs(spark, [(None, None), (1, ""), (1, "a b c\nd"), (1, "a b c\nd"), (2, "w" * 300000), (3, "w1 " * 40000)])
    frame = clashing(frame.withColumnsRenamed({"lang": "n", "source": "leaf"}), "_key", "_lines", "_dropped", "_all", "drops", "doc", "id", "th", "lines")
    got = lines.dedup(frame)
    assert got.columns == ["doc", "n_lines", "n_dropped"] and sorted(map(str, got.select("doc.*").collect())) == sorted(map(str, frame.collect()))
    assert sorted((r.n_lines, r.n_dropped) for r in got.collect()) == [(0, 0), (1, 0), (1, 0), (1, 0), (2, 0), (2, 0)]
    out = lines.stage(spark, frame, None)
    assert out.columns == frame.columns and sorted(map(str, out.collect())) == sorted(map(str, frame.collect()))
    assert lines.query(spark, store(spark, tmp_path, "documents", docs(spark, []))).count() == 0


def test_long_lines_of_two_texts_go(spark):
    long, short = " ".join(OWN[:12]), " ".join(OWN[:9])
    texts = [f"{long}\n{short}\nown a", f"own b\n{short}\n{long}", f"{long}\n{long}\nown c", f"{long.upper()}\nown d"]
    copies = [" ".join(OWN[::-1]) + "\nown e"] * 3
    got = texts_of(lines.stage(spark, rows(spark, texts + copies), None))
    assert got == dict(enumerate([texts[0], f"own b\n{short}", "own c", texts[3], *copies]))
    assert texts_of(lines.dedup(rows(spark, texts + copies))) == got
    assert texts_of(lines.dedup(rows(spark, texts + copies), exact=False)) == dict(enumerate(texts + copies))


def test_nine_texts_with_one_long_line_in_the_query(spark, tmp_path):
    line = " ".join(OWN[:15])
    sf = store(spark, tmp_path, "documents", rows(spark, [f"{line}\nown {OWN[k]}" for k in range(9)]))
    assert {r.doc_id: r.n_dropped for r in lines.query(spark, sf).collect()} == {0: 0, **{k: 1 for k in range(1, 9)}}
