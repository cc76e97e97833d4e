"""Exact dedup, phrases and whitening against brute force, and on odd rows."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import collocations, exact_dedup, whitening
from millrace.llm.collocations import Mining

DOCS = "doc_id long, text string, digest string, content string, place int"


def weak(sha):
    """Three digests for all texts, so that different texts share one."""
    return F.pmod(F.xxhash64(sha), F.lit(3))


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    top = {t: max((x for x in ids if x is not None), default=None) for t, ids in groups.items()}
    return Counter((i, top[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def texts():
    rng = random.Random(1)
    pool = ["", "a", "A", "a ", "a\n", "é", "é", "x" * 40_000, "hot"]
    rows = [(i, rng.choice(pool)) for i in range(200)] + [(1_000 + i, "hot") for i in range(300)]
    rows += [(None, "a"), (None, "only null ids"), (None, "only null ids"), (7, None), (5_000, "hot"), (5_000, "hot"), (5_000, "single"), (9, "once")]
    return rows


@pytest.mark.parametrize("digest", [exact_dedup.whole, weak])
@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_exact_classes_equal_brute_force(spark, monkeypatch, digest, broadcast):
    monkeypatch.setattr(exact_dedup, "REPEATED_ROWS", broadcast)
    rows = texts()
    docs = spark.createDataFrame([(*r, "d", "c", 1) for r in rows], DOCS).repartition(7)
    got = exact_dedup.exact_classes(docs, digest).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == exact(rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    left = exact_dedup.without_copies(docs, digest)
    assert left.columns == docs.columns
    assert Counter((r.text or "", r.doc_id) for r in left.collect()) == Counter((t, max((i for i, x in rows if (x or "") == t and i is not None), default=None)) for t in {t or "" for _, t in rows})
    assert exact_dedup.exact_classes(docs.limit(0), digest).count() == 0 == exact_dedup.without_copies(docs.limit(0), digest).count()


def pieces(text):
    for c in ".,;:!?\n\x0b\x0c\r":
        text = text.replace(c, ".")
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [[w for w in p.replace("\t", " ").split(" ") if w] for p in text.split(".")]


def phrases(rows, mining):
    out = {}
    for lang in {g or "und" for _, g in rows}:
        counts, n = Counter(), 0
        for t, g in rows:
            for words in pieces(t or "") if (g or "und") == lang else []:
                n += len(words)
                counts.update(tuple(words[i : i + k]) for k in range(1, mining.longest + 1) for i in range(len(words) - k + 1))
        found = {}
        for p, a in counts.items():
            if a >= mining.least and len(p) > 1:
                score, k = min((1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found[p] = (a, counts[p[:k]], counts[p[k:]], n, score)
        gone = {q for p, v in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * v[0] >= mining.inside_percent * found[q := p[i : i + m]][0]}
        ranked = sorted(((-v[4], -v[0], " ".join(p).encode(), v) for p, v in found.items() if p not in gone))[: mining.best]
        out |= {(lang, i): (p.decode(), *v) for i, (_, _, p, v) in enumerate(ranked, 1)}
    return out


def corpus():
    rng = random.Random(2)
    words = ["the", "The", "of", "river", "town", "é", "İ", "a-b", " ", "x y", "Zug"]
    rows = []
    for i in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "en", "de", None, "und"])))
    return [*rows, (None, "en"), ("", None), ("a a a a a a a a a", "en"), (" \t..;", "xx"), ("no separator " * 300, "en"), ("New York City New York City. new york city", "en")]


@pytest.mark.parametrize("mining", [Mining(2), Mining(3, 4, 60, 15), Mining(100), Mining(1, 3)])
def test_phrases_equal_brute_force(spark, mining):
    rows = corpus()
    docs = spark.createDataFrame([(t, g, 1, "w") for t, g in rows], "text string, lang string, rank int, phrase string").repartition(5)
    for block in (50, collocations.BLOCK_WORDS):
        got = collocations.collocations(docs, mining, block).collect()
        assert {(r.lang, r["rank"]): tuple(r)[2:] for r in got} == phrases(rows, mining)
        assert len(got) == len({(r.lang, r["rank"]) for r in got})


def test_phrases_of_shuffled_names_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FREQUENT_ROWS", 0)
    docs = spark.createDataFrame([(t, g) for t, g in corpus()], "text string, lang string")
    got = collocations.collocations(docs, Mining(4), 200).collect()
    assert {(r.lang, r["rank"]): tuple(r)[2:] for r in got} == phrases(corpus(), Mining(4))
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_blocks_are_cut_between_pieces():
    tokens = collocations.tokens_of("a b. c d e f g h. i, j k")
    assert [b" ".join(p) for p in collocations._parts(tokens, 3)] == [b"a b . c d e f g h", b"i . j k"]
    assert list(collocations._parts([b"x"] * 10, 3)) == [[b"x"] * 10]


def brute_whitening(vectors, k):
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    z = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = np.array([[sum(r[i] * r[j] for r in z) / n**3 for j in range(d)] for i in range(d)])
    values, columns = np.linalg.eigh(v)
    values, columns = values[::-1][:k], columns[:, ::-1][:, :k]
    return n, [sum(a * a for a in r) for r in z], np.array(z) / n @ columns / np.sqrt(values), values / np.trace(v)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    data = (rng.standard_normal((300, 40)) * np.linspace(3, 0.2, 40) + 5).astype(np.float32)
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(data)]
    odd = [(900, None, 1.0), (901, [], 1.0), (902, [float("nan")] * 40, 1.0), (903, [float("inf")] + [0.0] * 39, 1.0), (904, [None] + [0.0] * 39, 1.0), (905, [1.0] * 39, 1.0)]
    table = spark.createDataFrame([*rows, *odd, (None, data[0].tolist(), 1.0)], "vec_id long, embedding array<float>, whitened double").repartition(6)
    got = whitening.whitened(table).collect()
    n, deviation, white, explained = brute_whitening([*data, data[0]], 32)
    assert len(got) == 301 * 32 and {r.component for r in got} == set(range(1, 33)) and {r.n for r in got} == {n}
    ours = np.zeros((301, 32))
    for r in got:
        i = 300 if r.vec_id is None else r.vec_id
        assert r.deviation == deviation[i]
        assert abs(r.explained - explained[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
        ours[i, r.component - 1] = r.whitened
    signs = np.sign((ours * white).sum(axis=0))
    assert np.abs(ours - white * signs).max() < 1e-7


def test_whitening_of_few_or_equal_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    of = lambda rows: whitening.whitened(spark.createDataFrame(rows, schema)).collect()
    assert of([]) == of([(1, None)]) == of([(1, [1.0, 2.0])]) == of([(i, [1.0, 2.0]) for i in range(50)]) == []
    flat = of([(i, [float(i), 1.0, 2.0 * i]) for i in range(10)])
    assert len(flat) == 10 and {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
    huge = of([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 5.0])])
    assert {r.vec_id: r.deviation for r in huge}[1] is None and len(huge) == 3  # the second variance is below the least


def test_deviations_in_whole_numbers_of_any_size():
    y, rest = np.array([[3, -2], [0, 1]]), np.array([1, 5])
    for n in (7, 10**12):
        want = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, rest, strict=True)) for r in y]
        assert whitening.deviations(y, rest, n) == [w if w < 1 << 63 else None for w in want]
