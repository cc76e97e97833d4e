"""Line dedup against brute force, and substring dedup against planted passages."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import line_dedup, substring_dedup

SCHEMA = "doc_id long, text string"


def varied(rng, base, letters="abcé"):
    line = list(base)
    for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
        at, kind = rng.randrange(len(line) + 1), rng.random()
        if kind < 0.4:
            line.insert(at, rng.choice(letters))
        elif at < len(line):
            line[at : at + 1] = [] if kind < 0.7 else [rng.choice(letters)]
    return "".join(line).strip()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng = random.Random(edits)
    pairs = [(a, varied(rng, a)) for a in ("".join(rng.choice("abé") for _ in range(rng.randint(6, 40))) for _ in range(300))]
    pairs = [p for p in pairs if len(p[1]) >= edits]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.split("a", "").alias("x"), F.split("b", "").alias("y"))
    got = got.select("a", "b", line_dedup.edit_distance(F.col("x"), F.col("y"), edits).alias("d")).collect()
    for r in got:
        true = distance(r.a, r.b)
        assert r.d == true if true <= edits else r.d > edits


def test_line_classes_equal_brute_force(spark):
    rng = random.Random(5)
    how = line_dedup.EditJoin(2, 12)
    bases = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(14, 40))).strip() for _ in range(40)]
    lines = [varied(rng, rng.choice(bases)) for _ in range(400)]
    docs = spark.createDataFrame([(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(100)], SCHEMA)
    texts = sorted({x for x in lines if len(x) >= how.least_chars})
    group = {x: x for x in texts}
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                old, new = group[b], group[a]
                group = {k: new if v == old else v for k, v in group.items()}
    first = {}
    for n, x in enumerate(lines):
        first.setdefault(group.get(x, x), divmod(n, 4))
    got = {(r.doc_id, r.line_no): r for r in line_dedup.line_classes(docs, how).collect()}
    assert len(got) == 400
    for n, x in enumerate(lines):
        r = got[divmod(n, 4)]
        if x:
            assert (r.class_doc, r.class_line) == first[group.get(x, x)]
            assert r.kept == (divmod(n, 4) == first[group.get(x, x)] or len(x) < how.least_chars)


LONG = "a line that is long enough to be compared with others"


def test_lines_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, LONG), (5, LONG + "!\nshort"), (None, LONG), (6, LONG), (6, LONG), (7, "x" * 30_000), (8, "x" * 29_999 + "y")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], SCHEMA + ", node string")  # a clashing extra column
    got = {(r.doc_id, r.line_no): (r.class_doc, r.kept) for r in line_dedup.line_classes(docs).collect()}
    assert got[4, 0] == (4, True) and got[5, 0] == (4, False) and got[6, 0] == (4, False) and got[5, 1] == (5, True)
    assert got[None, 0] == (None, True) and got[2, 0] == (2, True) and got[3, 1] == (3, True) and got[8, 0] == (7, False)
    kept = line_dedup.without_repeated_lines(docs)
    assert sorted((r.doc_id or 0, r.text if r.text is None else r.text[:5]) for r in kept.collect()) == [(0, LONG[:5]), (1, None), (2, ""), (3, "\n \n"), (4, LONG[:5]), (5, "short"), (7, "xxxxx")]
    assert kept.columns == docs.columns
    assert line_dedup.without_repeated_lines(docs.limit(0)).count() == 0


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_planted_passages_are_removed(spark):
    rng = random.Random(2)
    planted = [passage(rng, 60) for _ in range(20)]
    texts = [f"{passage(rng, 40)} {p} {passage(rng, 40)}" if k % 2 else f"{passage(rng, 40)}\n{p}\n{passage(rng, 40)}" for k in range(3) for p in planted]
    clean = [passage(rng, 120) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts + clean)), SCHEMA)
    spans = substring_dedup.repeated_spans(docs)
    by_lines = {r.doc_id: r.removed_chars for r in substring_dedup.repeated_spans(docs, inside_lines=False).collect()}
    assert {i for i, n in by_lines.items() if n} == set(range(40, 60))  # those where the passage is a line of its own
    got, covered = {r.doc_id: r for r in spans.collect()}, []
    for i, t in enumerate(texts):
        start = t.index(planted[i % 20])
        inside = sum(s.end - s.start for s in got[i].spans)
        assert all(start <= s.start and s.end <= start + len(planted[i % 20]) for s in got[i].spans)
        covered.append(inside / len(planted[i % 20]))
    assert all(got[i].kept_in == ([i % 20] if i >= 20 else []) for i in range(60))
    assert not any(covered[:20]) and all(covered[20:]) and sum(covered) > 0.65 * 40
    assert all(got[len(texts) + i].n_removed == 0 for i in range(40))
    cut = {r.doc_id: r.text for r in substring_dedup.deduplicated(docs, spans).collect()}
    for i, t in enumerate(texts):
        keep, at = "", 0
        for s in got[i].spans:
            keep, at = keep + t[at : s.start], s.end
        assert cut[i] == keep + t[at:]


def test_spans_of_odd_rows(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(1, None), (2, " \n"), (3, same), (3, same), (4, f"é {same}\n{same}"), (None, same), (5, same.upper())]
    docs = spark.createDataFrame([(*r, [1]) for r in rows], SCHEMA + ", digests array<int>")
    got = [(r.doc_id, r.n_removed > 0) for r in substring_dedup.repeated_spans(docs, least_points=40).collect()]
    assert sorted(got, key=str) == sorted([(1, False), (2, False), (3, False), (3, False), (4, True), (None, False), (5, True)], key=str)
    assert substring_dedup.repeated_spans(docs.limit(0)).count() == 0


def brute_spans(rows, least):
    """Lines, paragraphs and whole texts that an earlier document or place has, by their words."""
    owner, parts = {}, {}
    for d, t in rows:
        lines, at = [], 0
        for x in t.split("\n"):
            lines.append((at, at + len(x), x))
            at += len(x) + 1
        blocks, held = [], []
        for x in [*lines, (0, 0, "")]:
            if x[2].split():
                held.append(x)
            elif held:
                blocks.append((held[0][0], held[-1][1], " ".join(y[2] for y in held)))
                held = []
        found = [("line", x) for x in lines if len(x[2].split()) >= 6 or len(x[2].strip()) >= 16] + [("block", x) for x in blocks if len(blocks) > 1] + [("text", (0, len(t), t))] * bool(t.split())
        parts[d] = [(kind, " ".join(x[2].lower().split()), x[0] + len(x[2]) - len(x[2].lstrip()) if kind != "text" else len(t) - len(t.lstrip()), x[1] - len(x[2]) + len(x[2].rstrip()) if kind != "text" else len(t.rstrip())) for kind, x in found]
        for kind, key, *_ in parts[d]:
            owner[kind, key] = min(d, owner.get((kind, key), d))
    out = {}
    for d, t in rows:
        gone, seen = set(), set()
        for kind, key, a, b in parts[d]:
            if owner[kind, key] != d or (kind, key) in seen:
                gone |= set(range(a, b))
            seen.add((kind, key))
        spans = []
        for k in sorted(gone):
            if spans and spans[-1][1] == k:
                spans[-1][1] = k + 1
            else:
                spans.append([k, k + 1])
        whole = [len(t) - len(t.lstrip()), len(t.rstrip())]
        out[d] = [tuple(x) for x in spans if x[1] - x[0] >= least or x == whole]
    return out


@pytest.mark.parametrize("least", [1, 40])
def test_lines_and_paragraphs_equal_brute_force(spark, least):
    rng = random.Random(least)
    pool = [passage(rng, rng.choice([1, 3, 7, 12])) for _ in range(25)]
    rows = [(i, rng.choice(["\n", "\n\n"]).join(" ".join(rng.sample(pool, rng.choice([1, 1, 2]))) for _ in range(rng.randint(1, 6)))) for i in range(80)]
    rows = [(i, t.upper() if i % 7 == 0 else t) for i, t in rows]
    got = substring_dedup.repeated_spans(spark.createDataFrame(rows, SCHEMA), least, inside_lines=False).collect()
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in got} == brute_spans(rows, least)


@pytest.mark.parametrize("block", [512, 7])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK_ROWS", block)
    rng = random.Random(11)
    bases = ["".join(rng.choice("abcdeé ") for _ in range(30)).strip() for _ in range(4)]
    near = [LONG[:at] + c + LONG[at + 1 :] for at in range(0, 20, 2) for c in "XYZ"]  # one large class, all within two edits
    lines = near + [varied(rng, rng.choice(bases)) for _ in range(80)]
    docs = spark.createDataFrame([(i, f"{x}\n{x}") for i, x in enumerate(lines)], SCHEMA)
    long = [x for x in set(lines) if len(x) >= 24]
    want = {x: sum(a != x and distance(a, x) <= 2 for a in long) for x in long}
    got = line_dedup.line_classes(docs, line_dedup.EditJoin(2, 24)).collect()
    assert all(want[x] == len(near) - 1 for x in near)
    assert all(r.n_links == want.get(lines[r.doc_id], 0) for r in got)


def test_short_lines_equal_brute_force(spark):
    rng = random.Random(12)
    bases = ["".join(rng.choice("abcdefghijklé") for _ in range(n)) for n in range(3, 27)]
    lines = [varied(rng, rng.choice(bases)) for _ in range(300)] + ["no", "no", "版权所有。", "版权所有。", "All rights reserved.", "All rights reserved!"]
    docs = spark.createDataFrame(list(enumerate(lines)), SCHEMA)
    texts = sorted({x for x in lines if x})
    near = {x: {b for b in texts if b != x and distance(x, b) <= min(2, max(len(x), len(b)) // 6)} for x in texts}
    group = {x: x for x in texts}
    for a in texts:
        for b in near[a]:
            old, new = group[b], group[a]
            group = {k: new if v == old else v for k, v in group.items()}
    first = {}
    for n, x in enumerate(lines):
        first.setdefault(group.get(x), n)
    for r in line_dedup.line_classes(docs).collect():
        x = lines[r.doc_id]
        if x:
            assert (r.class_doc, r.n_links, r.kept) == (first[group[x]], len(near[x]), first[group[x]] == r.doc_id)


def test_passages_of_short_pieces_and_unspaced_scripts(spark):
    menu = "\n".join(f"item {k}" for k in range(12))
    names = ". ".join(f"n{k}" for k in range(40)) + "."
    chinese = "".join(chr(0x4E00 + 37 * k) for k in range(60))
    thai = "".join(chr(0x0E01 + 7 * k % 40) for k in range(50))
    whole = [menu, names, chinese, thai, "two words", "字", "A short line of text"]
    docs = [(i, t) for i, t in enumerate(whole + whole)] + [(50, f"before {menu}\nafter"), (51, f"前{chinese}\n后"), (52, "𠀀é 字\n" + "All rights reserved."), (53, "other\nAll rights reserved.")]
    docs = spark.createDataFrame(docs, SCHEMA)
    got = {r.doc_id: r for r in substring_dedup.repeated_spans(docs, least_points=1).collect()}
    long = {r.doc_id: [tuple(s) for s in r.spans] for r in substring_dedup.repeated_spans(docs).collect()}
    assert all(long[i + len(whole)] == [(0, len(t))] for i, t in enumerate(whole))  # copies of a whole text go at any length
    assert not long[53] and not long[50] and not long[51]
    for i, t in enumerate(whole):
        assert not got[i].spans
        assert [tuple(s) for s in got[i + len(whole)].spans] == [(0, len(t))]
    assert got[50].removed_chars > 0.6 * len(menu) and got[51].removed_chars > 0.6 * len(chinese)
    assert not got[52].spans and [tuple(s) for s in got[53].spans] == [(6, 26)]


def test_spans_are_cut_from_their_own_text(spark):
    rng = random.Random(7)
    copied = passage(rng, 40)
    rows = [(1, copied), (5, f"{copied}\nnew end"), (5, passage(rng, 60)), (6, f"{copied}\nnew end")]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = sorted(map(tuple, substring_dedup.deduplicated(docs, substring_dedup.repeated_spans(docs)).collect()))
    assert left == sorted([(1, copied), (5, "\nnew end"), (5, rows[2][1]), (6, "")])


def test_spans_as_registered_equal_brute_force(spark):
    rng = random.Random(8)
    pool = [passage(rng, rng.choice([1, 2, 4, 9, 30])) for _ in range(40)]
    rows = [(i, rng.choice(["\n", "\n\n", " "]).join(rng.sample(pool, rng.randint(1, 6)))) for i in range(90)] + [(200, None), (201, " ")]
    owner, made = {}, {i: list(zip(*(x.tolist() for x in substring_dedup.units(t, True, True)), strict=True)) for i, t in rows}
    for i, found in made.items():
        for digest, *_ in found:
            owner.setdefault(digest, i)
    spans = substring_dedup.repeated_spans(spark.createDataFrame(rows, SCHEMA), least_points=1, every_line=True)
    got = {r.doc_id: r for r in spans.collect()}
    assert len(got) == len(rows)
    for i, found in made.items():
        gone, seen = set(), set()
        for digest, a, b in found:
            if owner[digest] != i or digest in seen:
                gone |= set(range(a, b))
            seen.add(digest)
        assert {k for s in got[i].spans for k in range(s.start, s.end)} == gone
    lines = {}
    for i, t in rows:  # every line that an earlier document has goes, whatever its size
        for at, line in enumerate((t or "").split("\n")):
            if line.split():
                start = sum(len(x) + 1 for x in t.split("\n")[:at])
                if lines.setdefault(" ".join(line.split()), i) != i:
                    assert any(s.start <= start and start + len(line.rstrip()) <= s.end for s in got[i].spans)


@pytest.mark.parametrize(("n", "how"), [(150, "start"), (300, "start"), (200, "end"), (200, "middle")])
def test_lines_with_a_common_part_are_not_all_paired(spark, n, how):
    rng = random.Random(n)
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    common = "2024-05-06T07:08:09.123Z INFO worker 7"
    lines = {"start": [common + word(24) for _ in range(n)], "end": [word(24) + common for _ in range(n)], "middle": [word(15) + common + word(15) for _ in range(n)]}[how]
    near = [x[:-3] + y + x[-2:] for x, y in zip(lines[:9], "!?#!?#!?#", strict=True)] + [lines[0][0] + "~" + lines[0][1:], lines[1][:20] + lines[1][21:-5] + lines[1][-4:]]
    docs = spark.createDataFrame(list(enumerate(lines + near)), SCHEMA)
    texts = lines + near
    want = {frozenset((a, b)) for i, a in enumerate(texts) for b in texts[i + 1 :] if a != b and distance(a, b) <= 2}
    pairs, nodes = line_dedup.candidates(line_dedup.lines_of(docs), line_dedup.EditJoin())
    name = {r.node: r.line for r in nodes.select("node", "line").collect()}
    met = {frozenset((name[r.a], name[r.b])) for r in pairs.collect()}
    assert want <= met and len(want) >= 11
    assert len(met) < 8 * n  # in proportion to the lines, and not to their pairs


def test_lines_of_the_same_letters_are_not_all_paired(spark):
    """Their letters tell nothing, as all have the same; what stands next to each other does."""
    rng = random.Random(8)
    texts = ["all of these lines begin alike, and then " + "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 26)) for _ in range(150)]
    texts += [texts[0][:-3] + "é" + texts[0][-2:], texts[1][:-5] + "#" + texts[1][-5:], texts[2][:-1] + "#"]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    want = {frozenset((a, b)) for i, a in enumerate(texts) for b in texts[i + 1 :] if a != b and distance(a, b) <= 2}
    pairs, nodes = line_dedup.candidates(line_dedup.lines_of(docs), line_dedup.EditJoin())
    name = {r.node: r.line for r in nodes.select("node", "line").collect()}
    met = {frozenset((name[r.a], name[r.b])) for r in pairs.collect()}
    assert want <= met and len(want) >= 3 and len(met) < 8 * len(texts)


@pytest.mark.parametrize("like", [0.5, 2.0])
def test_links_by_narrow_keys_equal_brute_force(spark, monkeypatch, like):
    """Every key of more than four rows is replaced (2.0: also those whose lines are alike)."""
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 4)
    monkeypatch.setattr(line_dedup, "LIKE_PART", like)
    monkeypatch.setattr(line_dedup, "HOT_ROUNDS", 2)
    rng = random.Random(21)
    bases = ["".join(rng.choice("abé ") for _ in range(k)).strip() for k in (8, 13, 20, 26)]
    lines = sorted({varied(rng, rng.choice(bases), "abé") for _ in range(110)} - {""})
    docs = spark.createDataFrame(list(enumerate(lines)), SCHEMA)
    want = {x: sum(a != x and distance(a, x) <= min(2, max(len(a), len(x)) // 6) for a in lines) for x in lines}
    got = line_dedup.line_classes(docs).collect()
    assert {lines[r.doc_id]: r.n_links for r in got} == want


@pytest.mark.parametrize(("compared", "replaced"), [(0, True), (64, False)])
def test_keys_are_replaced_only_if_they_are_costly(spark, monkeypatch, compared, replaced):
    """What is compared under large keys decides; the links are the same either way, and blocks of copies do not count."""
    calls, narrowed = [], line_dedup.narrowed
    monkeypatch.setattr(line_dedup, "narrowed", lambda rows: calls.append(1) or narrowed(rows))
    monkeypatch.setattr(line_dedup, "COMPARED_A_ROW", compared, raising=False)
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 4)
    monkeypatch.setattr(line_dedup, "HOT_ROUNDS", 2)
    rng = random.Random(22)
    bases = ["".join(rng.choice("abcdé ") for _ in range(k)).strip() for k in (13, 20, 26)]
    lines = sorted({varied(rng, rng.choice(bases), "abé") for _ in range(90)} - {""})
    lines += ["one start of many lines: " + "".join(rng.choice("abcdefghij") for _ in range(12)) for _ in range(30)]
    docs = spark.createDataFrame([(i, "\n".join([x] * (40 if i == 3 else 1))) for i, x in enumerate(lines)], SCHEMA)
    want = {x: sum(a != x and distance(a, x) <= min(2, max(len(a), len(x)) // 6) for a in lines) for x in lines}
    got = line_dedup.line_classes(docs).collect()
    assert {lines[r.doc_id]: r.n_links for r in got} == want and len(got) == len(lines) + 39
    assert bool(calls) == replaced


def test_lines_with_other_digits_may_be_told_apart(spark):
    docs = spark.createDataFrame([(1, "Chapter 2 of the book"), (2, "Chapter 1 of the book"), (3, "Chapter 1 of the books")], SCHEMA)
    kept = lambda how: [r.doc_id for r in line_dedup.line_classes(docs, how).filter("kept").orderBy("doc_id").collect()]
    assert kept(line_dedup.EditJoin()) == [1] and kept(line_dedup.EditJoin(same_digits=True)) == [1, 2]
