import random

from stockloom.llm import line_dedup
from tests.llm.edge import CLASHES, LONG, documents


def brute(rows, least):
    """Lines to delete of each row: every two equal lines are aligned and the match extended both ways."""
    order = lambda r: (r[0] is not None, r[0] or 0)
    flat, where, gone = [], {}, {}
    for row in sorted({r for r in rows if r[1] is not None}, key=order):
        for i, x in enumerate(row[1].split("\n")):
            x = x.strip(" ")
            if x:
                where.setdefault(x, []).append(len(flat))
                flat.append((row, i, x, x.count(" ") + 1))
    same = lambda a, b, k: (  # noqa: E731  whether the lines k further on lie in the same documents and are equal
        min(a, b) + k >= 0 and max(a, b) + k < len(flat) and flat[a + k][0] == flat[a][0] and flat[b + k][0] == flat[b][0] and flat[a + k][2] == flat[b + k][2]
    )
    for spots in where.values():
        for n, later in enumerate(spots):
            for earlier in spots[:n]:
                if not same(earlier, later, -1):
                    k = 0
                    while same(earlier, later, k + 1):
                        k += 1
                    if sum(x[3] for x in flat[later : later + k + 1]) >= least:
                        gone.setdefault(flat[later][0], set()).update(range(flat[later][1], flat[later + k][1] + 1))
    return gone


def expected(rows, least):
    gone, out = brute(rows, least), []
    for doc, text in rows:
        drop = set(gone.get((doc, text), ()))
        out.append((doc, text if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)))
    return sorted(out, key=str)


def test_random_texts_against_definition(spark):
    rng = random.Random(3)
    lines = [" ".join(rng.choices("abcdefgh", k=rng.choice([1, 2, 3, 5, 9]))) for _ in range(9)] + ["", "  "]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 14)))) for i in range(60)]
    got = line_dedup.dedup_lines(documents(spark, rows), min_words=8)[0].collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == expected(rows, 8)
    assert sorted((r.doc_id, r.text) for r in got) == whole_runs(rows, 8)


def test_awkward_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (None, f"{passage}\nfirst"), (1, None), (2, ""), (3, f"intro\n{passage}\n\nend"), (4, passage), (5, "short\nshort"),
        (6, LONG), (7, f"x\n  {passage}  "), (8, "one"), (8, "one"), (9, f"{passage} more"),
    ]
    docs = documents(spark, rows)
    got, names = line_dedup.dedup_lines(docs, min_words=50)
    texts = [(r.doc_id, r.text) for r in got.collect()]
    assert (None, f"{passage}\nfirst") in texts and (1, None) in texts and (2, "") in texts and (6, LONG) in texts
    assert (3, "intro\n\nend") in texts and (4, "") in texts and (7, "x") in texts and (9, f"{passage} more") in texts
    assert texts.count((8, "one")) == 2 and len(texts) == len(rows)
    assert all(r[c] == f"kept {c}" for r in got.collect() for c in CLASHES)


def test_repeated_rows_lose_the_same_lines(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    got, _ = line_dedup.dedup_lines(documents(spark, [(2, f"a\n{passage}"), (1, passage), (2, f"a\n{passage}")]), 50)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, passage), (2, "a"), (2, "a")]


def test_removed_runs_are_told(spark):
    passage = "\n".join(" ".join(f"p{i}.{j}" for i in range(20)) for j in range(3))
    got, names = line_dedup.dedup_lines(documents(spark, [(1, passage), (2, f"a\n{passage}\nb")]), 50)
    row = {r.doc_id: r for r in got.collect()}[2]
    assert [tuple(x) for x in row[names["runs"]]] == [(1, 3)] and row[names["n_removed"]] == 3 and row.text == "a\nb"


def test_empty_table(spark):
    assert line_dedup.dedup_lines(documents(spark, []), 50)[0].count() == 0


def whole_runs(rows, least):
    """Rows without every run of lines of ``least`` words or more, of any length, that occurred before; runs go with the blank lines inside."""
    seen, found = {}, []
    for doc, text in sorted(set(rows)):
        lines = [(i, x.strip(" ")) for i, x in enumerate(text.split("\n"))]
        lines = [(i, x) for i, x in lines if x]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                content = tuple(x for _, x in lines[a : b + 1])
                if sum(x.count(" ") + 1 for x in content) >= least:
                    place = (doc, text, a)
                    found.append((content, place, range(lines[a][0], lines[b][0] + 1)))
                    seen[content] = min(seen.get(content, place), place)
    gone = {(p[0], p[1], i) for content, p, run in found if seen[content] < p for i in run}
    return sorted((d, "\n".join(x for i, x in enumerate(t.split("\n")) if (d, t, i) not in gone)) for d, t in rows)


def test_a_whole_run_goes_with_its_short_end(spark):
    long, x, y = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("l", 60), ("x", 20), ("y", 20)))
    rows = [(1, f"{long}\n{x}"), (2, f"{long}\n\n{x}\n{y}"), (3, f"own\n{long}\n{x}\n{y}\nend"), (4, f"{long}\n\n{x}\n{y}"), (5, f"{x}\n{y}")]
    got = line_dedup.dedup_lines(documents(spark, rows), min_words=50)[0].collect()
    assert {r.doc_id: r.text for r in got} == {1: f"{long}\n{x}", 2: y, 3: "own\nend", 4: "", 5: f"{x}\n{y}"}


def test_whole_runs_keep_blank_lines_only_around_them(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    got = line_dedup.dedup_lines(documents(spark, [(1, f"{a}\n\n{b}"), (2, f"x\n\n{a}\n\n\n{b}\n\ny")]), min_words=50)[0].collect()
    assert {r.doc_id: r.text for r in got}[2] == "x\n\n\ny"
