"""Decontamination and quality measures against brute force; URL rules and propagation; languages; archives."""

import hashlib
import random
import re
import zlib

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from millrace.llm import decontaminate, language_id, queries, quality, url_filter, warc

SCHEMA = "doc_id long, text string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contaminated(docs, items):
    windows = {}
    for i, t in items:
        w = item_words(t)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = item_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= x
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_contamination_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "MOST_WINDOWS", broadcast)
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "b", "Ünï", "c1", "d"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 4, 10, 14])))) for i in range(2, 30)] + [(30, None), (31, "..."), (100, "same words here"), (101, "Same, words; HERE")] + [(200 + i, "a window of many items") for i in range(50)]
    docs = [(i, ", ".join(word() for _ in range(rng.randint(0, 80)))) for i in range(60)] + [(90, None), (91, ""), (92, "x same-words/here y"), (94, "A window of many items, a window of many items"), (93, " ".join(f"u{i}" for i in range(30_000)))]
    got = decontaminate.contamination(spark.createDataFrame([(*d, 1) for d in docs], SCHEMA + ", start int"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: tuple(r)[2:] for r in got.collect()} == contaminated(docs, items)


def test_contaminated_documents_go(spark):
    docs = spark.createDataFrame([(1, "clean text"), (2, "one two three"), (2, "other text"), (None, "one two three"), (3, None)], SCHEMA)
    items = spark.createDataFrame([(7, "ONE two... three")], "item_id long, text string")
    kept = decontaminate.without_contaminated(docs, items)
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.filter("text is null or not text like '%one%'").collect()))
    assert decontaminate.without_contaminated(docs, items.limit(0)).count() == 5
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


def measures(text):
    text = text or ""
    words, windows = re.findall(r"[^\x20\x09-\x0D]+", text), {}
    for k in range(len(words) - 2):
        windows.setdefault(tuple(words[k : k + 3]), []).append(k)
    inside = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def test_measures_equal_brute_force(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a ", "bé ", "c\n", "# ", "d\t", "\n", "|x "]) for _ in range(rng.randint(0, 150))) for _ in range(120)]
    texts += [None, "", " \n\t", "a b c " * 40, "w\r\nw\r\n", " ".join(f"w{i}" for i in range(20_000)), "😀 é"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], SCHEMA + ", lines int")
    got = {r.doc_id: r for r in quality.measured(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measures(t)
        assert not (r.base_failed and r.kept)
    assert quality.measured(docs.limit(0)).count() == 0


def test_lines_that_fail(spark):
    rows = [("Home | News | Contact", True), ("This is a plain sentence.", False), ("All rights reserved.", True), ("### $$$ %%%", True), ("12345", True), ("", False), ("A sentence, with (brackets) and \"quotes\"!", False)]
    got = spark.createDataFrame(rows, "line string, fails boolean").withColumn("x", quality.line_fails(F.col("line"))).collect()
    assert all(r.x == r.fails for r in got)


def test_labels_agree_with_the_verdict(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    rows = quality.measured(docs.select("doc_id", "text")).join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in rows}
    assert share[1] > 0.99 and share[0] < 0.2


RULES = url_filter.parsed_rules(queries.URL_RULES)


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("https://WWW.Example.com/en/x?a=/fr/", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://m.example.com/en/1#top", "m.example.com", "/en/1", "example.com/en/", "block"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://a.net/es/", "a.net", "/es/", "net/es/", "block"),
        ("http://a.com", "a.com", "", None, "allow"),
        ("x://y://z/w", "y:", "//z/w", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://É.org?q", "É.org".replace("É", "É"), "", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    row = url_filter.judge(spark.createDataFrame([(1, url, None)], "page_id long, url string, html string"), RULES).first()
    assert tuple(row) == (1, host, path, rule, verdict)


def reference_rank(hosts, seeds, edges, rounds, damping=0.85):
    total = {h: sum(n for s, _, n in edges if s == h) for h in hosts}
    rank = dict(seeds)
    for _ in range(rounds):
        lost = sum(rank[h] for h in hosts if not total[h])
        rank = {h: (1 - damping) * seeds[h] + damping * (sum(rank[s] * n / total[s] for s, d, n in edges if d == h) + lost * seeds[h]) for h in hosts}
    return rank


def test_propagation(spark):
    edges = [("a", "b", 2), ("b", "c", 1), ("a", "c", 1), ("d", "e", 3), ("e", "d", 1), ("c", "a", 1)]
    seeds = {"a": 0.5, "b": 0.0, "c": 0.0, "d": 0.0, "e": 0.5, "f": 0.0}
    got = url_filter.propagated(spark.createDataFrame(list(seeds.items()), "host string, seed double"), spark.createDataFrame(edges, "src string, dst string, n long"), 5)
    want = reference_rank(seeds, seeds, edges, 5)
    assert {r.host: pytest.approx(want[r.host]) for r in got.collect()} == {r.host: r["rank"] for r in got.collect()}


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">x</a> <a HREF=//{h}/y>' for h in hosts)
    pages = [(1, "http://bad.net/es/", link("farm.org")), (2, "http://farm.org/", link("bad.net")), (3, "http://good.org/", link("fine.com")), (4, "http://fine.com/", link("good.org")), (5, "http://lone.org/", "<a href='/in'>")]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_held_out_accuracy(spark):
    path = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang")
    rows = queries.op6_language_id(spark, path).join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) > 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.accepted for r in rows) > 0.98 * len(rows)


def test_languages_of_odd_rows(spark):
    labelled = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("the cat and the dog " * 20, "en"), ("der hund und die katze " * 20, "de"), (None, "fr"), ("x", None)])], SCHEMA + ", lang string")
    languages = language_id.fit(labelled)
    assert sorted(languages.names) == ["de", "en"]
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "123 !", 0.5), (4, "the dog and the cat", 0.5), (5, "und die katze " * 9_000, 0.5)], SCHEMA + ", score double")
    got = {r.doc_id: (r.lang_pred, r.accepted) for r in language_id.identify(docs, languages).collect()}
    assert got == {1: ("und", False), 2: ("und", False), 3: ("und", False), 4: ("en", True), 5: ("de", True)}
    nothing = language_id.fit(labelled.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_ties_are_rejected_at_every_length(spark):
    languages = language_id.Languages(["a", "b"], [b"the cat and the dog " * 9] * 2)
    docs = spark.createDataFrame([(1, "zq"), (2, "zq " * 9), (3, "zq xw " * 900)], SCHEMA)
    got = language_id.identify(docs, languages).collect()
    assert {(r.lang_pred, r.score, r.margin_bytes, r.accepted) for r in got} == {("a", 0.0, 0, False)}


def test_least_margin_is_learned(spark):
    rng = random.Random(3)
    word = {x: ["".join(rng.choice(x) for _ in range(5)) for _ in range(60)] for x in ("abcdefgh", "ijklmnop")}
    rows = [(i, " ".join(rng.choice(word[x]) for _ in range(80)), x[:1]) for i, x in enumerate(list(word) * 300)]
    mixed = [(1_000 + i, " ".join(rng.choice(word[rng.choice(list(word))]) for _ in range(80)), "ai"[i % 2]) for i in range(200)]
    clear, unclear = (language_id.fit(spark.createDataFrame(x, SCHEMA + ", lang string")) for x in (rows, rows + mixed))
    assert clear.least_bytes == 1 < unclear.least_bytes
    assert all(len(d) <= language_id.DICTIONARY_BYTES for d in unclear.dictionaries)


def test_archives_round_trip(spark, tmp_path):
    html = ["<p>é</p>", "<p>é</p>", "", None, "x" * 200_000, "<p>é</p>", "\r\n\r\nWARC/1.1"]
    rows = [(i, f"http://a/{i} b\n", h, 1) for i, h in enumerate(html)] + [(9, None, "unique", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, length int").repartition(3)
    index = warc.write_archives(pages, str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read_records(index, str(tmp_path / "w")).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {0: ("revisit", 5), 1: ("revisit", 5), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 9: ("response", None)}
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), warc.digest_of(raw))
        assert got[i].payload == (None if got[i].record_type == "revisit" else h or "")
    one = warc.read_records(index.filter("page_id = 4"), str(tmp_path / "w")).collect()
    assert [r.page_id for r in one] == [4]
    other = {r.page_id: r.record_type for r in warc.read_records(warc.write_archives(pages, str(tmp_path / "v"), 100), str(tmp_path / "v")).collect()}
    assert set(other.values()) == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_ranges_are_joined():
    entries = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("b", 0, 7)]
    assert list(warc.ranges(entries, gap=10, most=100)) == [("a", 0, 15, [(0, 10), (10, 5)]), ("a", 40, 45, [(40, 5)]), ("b", 0, 7, [(0, 7)])]
    assert len(list(warc.ranges(entries, gap=100, most=12))) == 4


def test_distrust_goes_along_a_long_chain(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "TOLERANCE", 1.0)  # some 40 rounds
    link = lambda host: f'<a href="https://{host}/x">x</a>'
    pages = [(0, "http://bad.net/es/", "")] + [(k + 1, f"http://h{k}.org/", link(f"h{k - 1}.org" if k else "bad.net")) for k in range(20)] + [(100 + k, f"http://o{k}.org/", "") for k in range(400)]
    found = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()}
    assert all(found[k] == ("block" if k <= 20 else "allow") for k in found)


def test_many_rules_equal_the_short_list(spark, monkeypatch):
    rng = random.Random(6)
    hosts = ["com", "example.com", "www.example.com", "net", "a.net", "b.a.net", "org"]
    rules = [url_filter.parse_rule(rng.choice(["allow", "block"]), rng.choice(hosts) + "/" + rng.choice(["", "e", "en/", "en/x", "f/"])) for _ in range(25)]
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    urls = [f"http://{rng.choice(['', 'm.', 'x.y.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/xy?q', '/e', '/f/', '/g'])}" for _ in range(150)] + [None, "none", "http://", "http://./en/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    short = sorted(map(str, url_filter.judge(pages, rules).collect()))
    monkeypatch.setattr(url_filter, "LITERAL_RULES", 3)
    assert sorted(map(str, url_filter.judge(pages, rules).collect())) == short
    many = rules + [("block", f"h{i}.zz", "/") for i in range(2_000)]
    assert sorted(map(str, url_filter.judge(pages, many).collect())) == short


def test_no_language_is_lost(spark, monkeypatch):
    rng = random.Random(5)
    word = {x: ["".join(rng.choice(x) for _ in range(5)) for _ in range(80)] for x in ("abcdefgh", "ijklmnop", "qrstuvwx")}
    text = lambda x, n: " ".join(rng.choice(word[x]) for _ in range(n))
    sizes = {"abcdefgh": 5_500, "ijklmnop": 60, "qrstuvwx": 9_000}  # two languages have long documents only
    rows = [(i, text(x, sizes[x]), x[:2]) for i, x in enumerate(list(sizes) * 6)]
    labelled = spark.createDataFrame(rows, SCHEMA + ", lang string")
    probes = [(i, text(x, 30), x[:2]) for i, x in enumerate(list(sizes) * 5)]
    for budget in (language_id.ALL_DICTIONARIES_BYTES, 30):
        monkeypatch.setattr(language_id, "ALL_DICTIONARIES_BYTES", budget)
        languages = language_id.fit(labelled)
        assert sorted(languages.names) == ["ab", "ij", "qr"]
        assert all(0 < len(d) <= language_id.DICTIONARY_BYTES for d in languages.dictionaries)
        got = language_id.identify(spark.createDataFrame(probes, SCHEMA + ", lang string"), languages).collect()
        assert all(r.lang_pred == r.lang for r in got)


def test_sizes_equal_plain_zstandard(spark):
    """The winner is that of plain zstandard with the dictionary before the text, and the margin its distance."""
    import zstandard

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").filter("length(text) between 1 and 16000").collect()]
    table = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    languages = language_id.fit(table)
    how = zstandard.ZstdCompressionParameters(window_log=17, chain_log=17, hash_log=17, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
    got = {r.doc_id: r for r in language_id.identify(table.select("doc_id", "text"), languages).collect()}
    for i, t in docs:
        data = t.lower().encode()
        if len(data) > language_id.BLOCK_BYTES or got[i].lang_pred == "und":
            continue
        sizes = [len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress(data)) for d in languages.dictionaries]
        best, second = sorted(sizes)[:2]
        assert languages.names[sizes.index(best)] == got[i].lang_pred and got[i].margin_bytes == second - best


@pytest.mark.parametrize(
    ("line", "fails"),
    [
        ("He will resign in May.", False), ("The design in question was simple.", False), ("He could not assign up to ten more seats.", False), ("She baked a cookie for the children.", False),
        ("They read more books in a year than most people do in ten.", False), ("Impressumspflicht gilt auch hier.", False), ("Sign in", True), ("Read more…", True), ("» Cookie policy", True),
        ("Please subscribe, or sign up", True), ("© 2024 Somebody", True), ("Politique de confidentialité", True), ("Datenschutzerklärung und Impressum", True),
    ],
)
def test_phrases_are_whole_words(spark, line, fails):
    assert spark.createDataFrame([(line,)], "line string").select(quality.line_fails(F.col("line"))).first()[0] == fails


def test_settled_ranks_equal_an_exact_solve(spark):
    """At the registered tolerance, against the linear system that the ranks solve."""
    import numpy as np

    hosts = ["a", "b", "c", "d", "e", "f"]
    edges = [("a", "b", 2), ("b", "c", 1), ("a", "c", 1), ("d", "e", 3), ("e", "d", 1), ("c", "d", 1)]
    seeds = np.array([0.7, 0, 0, 0, 0, 0.3])
    flow = np.zeros((6, 6))
    for s, d, n in edges:
        flow[hosts.index(d), hosts.index(s)] = n / sum(m for x, _, m in edges if x == s)
    flow[:, 5] = seeds  # what a host without links holds goes back to the seeds
    exact = np.linalg.solve(np.eye(6) - url_filter.DAMPING * flow, (1 - url_filter.DAMPING) * seeds)
    got = url_filter.propagated(spark.createDataFrame(list(zip(hosts, seeds.tolist(), strict=True)), "host string, seed double"), spark.createDataFrame(edges, "src string, dst string, n long"))
    settled = {r.host: r["rank"] for r in got.collect()}
    most = url_filter.TOLERANCE / len(hosts) * url_filter.DAMPING / (1 - url_filter.DAMPING)
    assert all(abs(settled[h] - e) <= most for h, e in zip(hosts, exact, strict=True))
