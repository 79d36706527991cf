"""The line grammar: what opens where, offsets, and blocks of any size against a plain scan."""

import random

from provenir.sources import grammar as G

ACT = """LAWS OF EXAMPLE
An Act to make provision for data.
ENACTED by the Parliament
P A R T I
PRELIMINARY
MATTERS
1. This Act may be cited as the Data Act.
   (1) more of it
2A. In this Act—
Schedule
3. The Schedule lists the fees.
PART II ENFORCEMENT
4.1 A person shall keep data.
0705.29 other goods
SCHEDULE
[Section 3]
(Fees for a licence)
1. Fee: 10
closing words"""


def parsed(spark, texts, block=G.BLOCK):
    df = spark.createDataFrame([(i, t, 7, 8) for i, t in texts], "doc_id long, text string, block int, start int")
    out = {}
    for r in G.sections(df, block=block).orderBy("doc_id", "section").collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_an_act(spark):
    got = parsed(spark, [(1, ACT)])[1]
    assert "\n".join(r.text for r in got) == ACT
    assert all(ACT[r.start : r.start + len(r.text)] == r.text for r in got)
    assert [(r.kind, r.label, r.heading_path) for r in got] == [
        ("prose", None, ""),
        ("long title", None, ""),
        ("prose", None, ""),
        ("heading", None, ""),
        ("provision", "1", "P A R T I PRELIMINARY MATTERS"),
        ("provision", "2A", "P A R T I PRELIMINARY MATTERS"),
        ("provision", "3", "P A R T I PRELIMINARY MATTERS"),
        ("heading", None, "P A R T I PRELIMINARY MATTERS"),
        ("provision", "4.1", "PART II ENFORCEMENT"),
        ("schedule", None, "PART II ENFORCEMENT"),
        ("provision", "1", "SCHEDULE"),
    ]
    assert got[5].text.endswith("Schedule")  # a marginal note, not a schedule
    assert got[8].text.endswith("other goods")  # a tariff code opens nothing
    assert got[9].text == "SCHEDULE\n[Section 3]\n(Fees for a licence)"


def plain(lines, signs):
    """One walk over all lines."""
    state, out = G.STATES[0], []
    for line, c in zip(lines, signs):
        state, action = G.TABLE[state, c]
        if action or not out:
            out.append((action or "prose", [line]))
        else:
            out[-1][1].append(line)
    return [(k, "\n".join(x)) for k, x in out]


def test_blocks_of_any_size_give_the_same(spark):
    rnd = random.Random(2)
    kinds = ["Part IV", "PART II THINGS", "SCHEDULE", "(a caption of some length)", "[Section 3]", "An Act to try", "ENACTED by all", "12. words", "1.2.3 deep", "LOUD WORDS", "quiet words", "", "😀 wide", "  3. spaced", "FIRST SCHEDULE"]
    sign_of = dict(zip(kinds, "PQSKBLENNCXXXNS"))
    texts = [(i, [rnd.choice(kinds) for _ in range(rnd.randint(1, 60))]) for i in range(80)]
    for size in (1, 2, 7, G.BLOCK):
        got = parsed(spark, [(i, "\n".join(x)) for i, x in texts], size)
        for i, lines in texts:
            signs = []
            for k, line in enumerate(lines):
                c = sign_of[line]
                if c == "S" and k + 1 < len(lines) and sign_of[lines[k + 1]] == "N":
                    c = "C"  # a schedule's name above a number
                signs.append(c)
            want = plain(lines, signs)
            assert [(r.kind, r.text) for r in got[i]] == want, (i, size)
            text = "\n".join(lines)
            assert all(text[r.start : r.start + len(r.text)] == r.text for r in got[i])


def test_composition_equals_walking():
    rnd = random.Random(5)
    for _ in range(300):
        signs = "".join(rnd.choice(G.SIGNS) for _ in range(rnd.randint(0, 12)))
        for k, state in enumerate(G.STATES):
            for c in signs:
                state = G.TABLE[state, c][0]
            assert G.STATES[G._composed(signs)[k]] == state


def test_empty_and_null_texts(spark):
    got = parsed(spark, [(1, ""), (2, None), (3, "\n\n"), (4, "one line")])
    assert [[(r.kind, r.text, r.start) for r in got[i]] for i in (1, 2, 3, 4)] == [[("prose", "", 0)], [("prose", "", 0)], [("prose", "\n\n", 0)], [("prose", "one line", 0)]]
    df = spark.createDataFrame([], "doc_id long, text string")
    assert G.sections(df).count() == 0


def test_pieces_and_pages_leave_in_small_batches(spark, monkeypatch):
    from provenir.sources import pages as P

    docs = spark.createDataFrame([(i, "\n".join(f"{k}. It must be so {i}." for k in range(1, 40))) for i in range(20)], "doc_id long, text string")
    html = "".join(f"<h2>Part {k}</h2><p>{'words of it ' * 20}</p>" for k in range(9))
    pages = spark.createDataFrame([(i, html if i % 3 else None) for i in range(20)], "page_id long, html string")
    whole = [sorted(map(tuple, df.collect()), key=str) for df in (G.sections(docs), P.parsed(pages))]
    monkeypatch.setattr(G, "HELD", 300)
    monkeypatch.setattr(P, "HELD", 300)
    assert [sorted(map(tuple, df.collect()), key=str) for df in (G.sections(docs), P.parsed(pages))] == whole
    assert len(whole[0]) == 780 and len(whole[1]) == 7 + 13 * 9
