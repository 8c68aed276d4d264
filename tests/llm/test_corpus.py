"""Corpus operators against brute force, on odd inputs and on the smallest tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sequor.llm import html, packing, pieces, quality, queries, repeats, shards, simhash, urls, vectors
from sequor.llm.common import unite
from tests.conftest import SF

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n_words long, shard int, found string, anchor long, component_id long"


def odd_texts():
    rnd = random.Random(5)
    vocab = ["the", "of", "Ünd", "ab,", "x.", "naïve", "梦", "#5", "|"]
    make = lambda n: " ".join(rnd.choice(vocab) + str(rnd.randint(0, 400)) for _ in range(n))
    passage, long = make(60), make(3000)
    return [None, "", " \n\t ", "one", "a b", passage, passage, f"{make(30)} {passage} {make(40)}", f"{passage[:300]}", "a " * 400, "b" * 700, long, f"{long[:9000]} {make(20)}", "é" * 350, f"{make(10)}\n{passage}\n{make(5)}", "The the\nThe the\n\nThe the x"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", 1, 2, "f", 3, 4) for i, t in enumerate(odd_texts())]
    rows += [rows[5], rows[11]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


def components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


# quality rules


def base_counts(text):
    text = text or ""
    w = WORDS.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_verdicts(spark, odd, empty):
    for r in quality.score_documents(odd).collect():
        n, chars, symbols, lines, rep = base_counts(odd_texts()[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, rep), r.doc_id
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)
    assert quality.score_documents(empty).count() == 0
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op1_quality_rules"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("quality", "good"), "doc_id").where("not base_failed")
    n = {(r.good, r.kept): r["count"] for r in got.groupBy("good", "kept").count().collect()}
    assert n.get((1, True), 0) >= 0.98 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.9 * (n.get((0, True), 0) + n.get((0, False), 0))
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score_documents(odd).where("kept").collect()}


def test_votes_recover_accuracies():
    rnd = random.Random(0)
    rows = Counter()
    for _ in range(20000):
        good = rnd.random() < 0.7
        rows[tuple((1 if good == (rnd.random() < a) else -1) if rnd.random() < 0.8 else 0 for a in (0.95, 0.9, 0.8))] += 1
    odds, table = quality.fit_votes(sorted(rows.items()))
    assert abs(1 / (1 + math.exp(-odds)) - 0.7) < 0.06
    assert table[0][1][0] > table[2][1][0] > 0.5


# embeddings


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + (i % 7) * 0.03 * rng.standard_normal(16)).tolist(), i % 3 if i % 11 else None) for i in range(400)]
    rows += [(1000, rows[1][1], rows[1][2]), (1001, None, 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] * 16, 1), (1004, [None, *[1.0] * 15], 1), (1005, [1.0, 2.0], 1), (1006, [2.0, 4.0], 1), (1007, [float("inf")] * 16, 1), (1008, [1e-200] * 16, 0), (1009, [1e200] * 16, 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(1)).repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(d).collect()}
    good = [(i, np.array(e) / np.abs(e).max(), k) for i, e, k in rows if e and None not in e and np.isfinite(e).all() and any(e) and k is not None]
    linked = [(a[0], b[0]) for n, a in enumerate(good) for b in good[:n] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= 0.98]
    count = Counter(x for p in linked for x in p)
    for i, c in components([r[0] for r in rows], linked).items():
        if i not in (1008, 1009):  # their squares leave the range of doubles
            assert got[i] == (count[i], c, c == i), i
    assert len(linked) > 100
    assert vectors.near_vectors(d.where("false")).count() == 0


def test_vector_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(2)
    d = spark.createDataFrame([(i, (np.ones(8) + 0.12 * rng.standard_normal(8)).tolist(), 0) for i in range(150)], "vec_id long, embedding array<double>, label int")
    x = {r.vec_id: np.array(r.embedding) for r in d.collect()}
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(d).collect()}
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    assert got == {i: sum(j != i and cos(x[i], x[j]) >= 0.98 for j in x) for i in x}


# shards


def test_unite_in_place():
    label = np.arange(5)
    unite(label, np.array([0, 2, 1, 3]), np.array([3, 3, 2, 4]))
    assert not label.any()
    rng = np.random.default_rng(2)
    for _ in range(50):
        i, j = rng.integers(0, 60, (2, 50))
        label, root = np.arange(60), list(range(60))
        unite(label, i, j)
        for _ in range(60):
            for a, b in zip(i, j, strict=True):
                root[a] = root[b] = min(root[a], root[b])
        assert label.tolist() == root


def test_closest_forest_is_minimal():
    rng = np.random.default_rng(4)
    for _ in range(30):
        i, j = rng.integers(0, 40, (2, 120))
        far = rng.integers(0, 9, 120)
        got = simhash.closest_forest(40, i, j, far)
        root, cost = list(range(40)), 0
        find = lambda x: x if root[x] == x else find(root[x])
        for k in np.argsort(far, kind="stable"):
            a, b = find(i[k]), find(j[k])
            if a != b:
                root[a] = b
                cost += far[k]
        assert far[got].sum() == cost and len(got) == 40 - len({find(x) for x in range(40)})


def test_near_copies_are_verified(spark):
    """Chains of edits: what goes has a copy of at least 0.8 among the others, and clear copies go."""
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randint(0, 5000)}"
    texts = []
    for _ in range(25):
        w = [word() for _ in range(rnd.choice((80, 300, 1500)))]
        for share in (0.0, 0.01, 0.04, 0.08):
            texts.append(" ".join(word() if rnd.random() < share else x for x in w))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in simhash.keep_one_of_each(d).collect()}
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for k in range(len(texts)):
        best = max(alike(k, x) for x in range(len(texts)) if x != k)
        if k not in kept:
            assert best >= 0.79
        elif any(x < k and alike(k, x) >= 0.86 for x in range(len(texts))):
            raise AssertionError(k)


def five_words(text):
    w = text.split()
    return set(zip(*(w[k:] for k in range(5)), strict=False))


def test_near_copies_of_a_lost_original(spark):
    """Hundreds of copies whose similarities lie on both sides of 0.8: groups are those of exact linking."""
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randint(0, 5000)}"
    texts = []
    for share in (0.0125, 0.014, 0.016):
        w = [word() for _ in range(500)]
        texts += [" ".join(word() if rnd.random() < share else x for x in w) for _ in range(150)]
    sets = [five_words(t) for t in texts]
    linked = [(a, b) for b in range(len(texts)) for a in range(b) if a // 150 == b // 150 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {k for k, root in components(range(len(texts)), linked).items() if k == root}
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.keep_one_of_each(d).collect()} == want


def test_rows_of_one_id_are_told_apart(spark):
    """A clean text isn't dropped for another text of its id, and a near copy of a smaller id goes alone."""
    words = lambda k, n=60: " ".join(f"{k}w{x}" for x in range(n))
    rows = [(1, words("a")), (2, words("b")), (2, words("a") + " more"), (3, words("c")), (3, words("d")), (3, words("d")), (4, words("c") + " more")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.text) for r in simhash.keep_one_of_each(d).collect())
    assert got == [(1, words("a")), (2, words("b")), (3, words("c")), (3, words("d"))]


def test_long_near_copies_are_decided_exactly(spark):
    """Pairs of long texts next to 0.8 on either side: none below it goes, those above it do."""
    rnd = random.Random(13)
    word = lambda: f"w{rnd.randint(0, 5000)}"
    texts, alike = [], []
    for _ in range(60):
        w = [word() for _ in range(3000)]
        texts += [" ".join(w), " ".join(word() if rnd.random() < 0.0235 else x for x in w)]
        a, b = map(five_words, texts[-2:])
        alike.append(len(a & b) / len(a | b))
    above = {2 * k + 1 for k, x in enumerate(alike) if x >= 0.8}
    assert min(len(above), 60 - len(above)) > 10 and sum(0.79 < x < 0.81 for x in alike) > 10
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    gone = set(range(120)) - {r.doc_id for r in simhash.keep_one_of_each(d).collect()}
    assert gone <= above
    prints = [np.array(simhash.fingerprint(simhash.shingle_hashes(t, 5), 4), np.int64) for t in texts]
    far = {k: int(np.bitwise_count((prints[k] ^ prints[k - 1]).view(np.uint64)).sum()) for k in above - gone}
    assert all(x > 51 for x in far.values()), far


@pytest.mark.parametrize("part", [1 << 30, 3000])
def test_open_links_in_blocks(spark, monkeypatch, part):
    """Trees that no closest edge joins are joined by the pairs left, in one task or in blocks."""
    monkeypatch.setattr(simhash, "SHINGLES", part)
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(12, 10, replace=False)).astype(np.uint64) for _ in range(40)]
    nodes = spark.createDataFrame([(k, k // 20, k) for k in range(40)], "node long, group long, label long")
    prints = spark.createDataFrame([(k, k % 3) for k in range(40)], "node long, f0 long")
    stored = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sets)], "node long, s binary")
    got = [(r.a, r.b) for r in simhash.open_links(nodes, prints, stored, ["f0"], 1, 0.7).collect()]
    alike = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.7 * len(np.union1d(sets[a], sets[b]))
    want = [(a, b) for b in range(40) for a in range(b) if a // 20 == b // 20 and ((a % 3) ^ (b % 3)).bit_count() <= 1 and alike(a, b)]
    assert components(range(40), got) == components(range(40), want)


def test_fewest_shards(spark, odd, empty):
    rnd = random.Random(3)
    for _ in range(3):
        capacity = 10_000
        sizes = sorted((rnd.randint(1, 6000) for _ in range(5000)), reverse=True)
        room, want = [], []
        for x in sizes:  # the tightest bin by looking at all
            fits = [(r, b) for b, r in enumerate(room) if r >= x]
            b = min(fits)[1] if fits else len(room)
            if not fits:
                room.append(capacity)
            room[b] -= x
            want.append(b)
        assert shards.fewest_bins(sizes, capacity) == want
        sizes, counts = sorted(rnd.sample(range(1, 6000), 30), reverse=True), [rnd.randint(1, 50) for _ in range(30)]
        alone = [x for x, n in zip(sizes, counts, strict=True) for _ in range(n)]
        assert shards.by_item(shards.fewest_bins_runs(sizes, counts, capacity)) == shards.fewest_bins(alone, capacity)
        runs = shards.least_capacity_runs(sizes, counts, 8)
        assert shards.by_item(runs) == shards.least_capacity(alone, 8) and len(runs) <= 30 + 8 * 20
    assert shards.fewest_bins([30, 5, 4], 10) == [0, 1, 1]
    rows = shards.shard_by_capacity(odd, 5000).collect()
    assert len(rows) == odd.count()
    full, texts, by_id = Counter(), defaultdict(set), {r.doc_id: r.text or "" for r in odd.collect()}
    for r in rows:
        full[r.shard] += r.size
        texts[by_id[r.doc_id]].add(r.shard)
    assert all(len(x) == 1 for x in texts.values())
    of = Counter()
    for r in rows:
        of[by_id[r.doc_id]] += r.size
    large = {next(iter(texts[t])) for t, n in of.items() if n > 5000}
    assert all(n <= 5000 or b in large for b, n in full.items())
    assert shards.shard_by_capacity(empty, 10).count() == 0
    with pytest.raises(ValueError):
        shards.shard_by_capacity(empty, 0)


def test_shards(spark, odd, empty):
    rows = shards.shard_documents(odd, shards=3).collect()
    texts = odd_texts()
    assert len(rows) == odd.count()
    of = defaultdict(set)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        of[raw].add(r.shard)
    assert all(len(s) == 1 for s in of.values())
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert shards.shard_documents(empty).count() == 0
    assert shards.best_fit([7, 6, 3, 2, 2], 2, 10) == [0, 1, 0, 1, 1]
    assert shards.best_fit([7, 6, 5], 2, 10) is None
    rnd = random.Random(0)
    sizes = sorted((rnd.randint(1, 100) for _ in range(60)), reverse=True)
    load = Counter()
    for s, b in zip(sizes, shards.least_capacity(sizes, 4), strict=True):
        load[b] += s
    assert max(load.values()) - min(load.values()) <= 3
    got, of = Counter(), defaultdict(Counter)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in shards.op3_sharding(spark, SF).collect():
        got[r.shard] += r.size
        of[docs[r.doc_id]][r.shard] += r.size
    assert len(got) == 8 and max(got.values()) < 1.05 * min(got.values())
    assert all(len(x) == 1 for x in of.values())
    groups = sorted((sum(x.values()) for x in of.values()), reverse=True)
    want = Counter()
    for size, b in zip(groups, shards.least_capacity(groups, 8), strict=True):  # every group on its own
        want[b] += size
    assert got == want


def test_shards_of_one_size(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "lpad(string(id % 4000), 9, '0') as text")
    got, of = Counter(), defaultdict(set)
    for r in shards.shard_documents(docs).collect():
        got[r.shard] += r.size
        of[r.doc_id % 4000].add(r.shard)
    assert sorted(got) == list(range(8)) and all(len(x) == 1 for x in of.values())
    assert sum(got.values()) == 50_000 and max(got.values()) - min(got.values()) <= 20


# urls


def test_urls(spark):
    rows = [(1, "http://a.Example.COM/en/7x?q"), (2, "https://example.com/en/1#t"), (3, "x://net/de/8"), (4, "http://www.example.net/de/81"), (5, "http://b.org/es/"), (6, None), (7, "nothing"), (8, "http://notexample.com/en/7"), (9, "http://x.com?y=/en/"), (9, "http://x.com?y=/en/"), (10, "http://" + "a" * 5000 + ".com/en/x://y")]
    got = by_id(urls.judge(spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, f_depth int"), urls.RULES), "page_id")
    g = {k: (v[0].host[:20], v[0].path[:10], v[0].rule, v[0].verdict) for k, v in got.items()}
    assert g[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and g[2][2:] == ("com/en/", "block")
    assert g[3][2:] == ("net/de/", "allow") and g[4][2:] == ("example.net/de/8", "block") and g[5][2:] == ("org/es/", "block")
    assert g[6][:3] == ("", "", None) and g[7][:3] == ("", "", None) and g[8][2] == "com/en/" and g[9][:3] == ("x.com", "", None) and len(got[9]) == 2
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), urls.RULES).count() == 0
    d = "/root/testdata/sf0.1"
    out = urls.op4_url_filter(spark, d).where("rule is null").withColumn("bad", F.col("host").rlike("|".join(urls.TERMS)))
    n = {(r.bad, r.verdict): r["count"] for r in out.groupBy("bad", "verdict").count().collect()}
    assert sum(v for (b, v2), v in n.items() if b == (v2 == "block")) > 0.95 * sum(n.values())


# passages


def later_words(docs):
    first, out = {}, {}
    for i, t in sorted(docs.items()):
        w = WORDS.findall(t or "")
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (i, s))
    for i, t in docs.items():
        w = WORDS.findall(t or "")
        gone = {s + k for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] < (i, s) for k in range(20)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def repeated_bytes(docs):
    raws = [(i, (t or "").encode()) for i, t in docs]
    c = Counter(r[s : s + 200] for _, r in raws for s in range(len(r) - 199))
    out = {}
    for i, r in raws:
        gone = np.zeros(len(r), bool)
        for s in range(len(r) - 199):
            if c[r[s : s + 200]] > 1:
                gone[s : s + 200] = True
        a = np.frombuffer(r, np.uint8)
        out[i] = (len(r), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(r) else 0, hashlib.sha256(a[~gone].tobytes()).hexdigest())
    return out


def test_later_words(spark, odd, empty):
    want = later_words(dict(enumerate(odd_texts())))
    got = by_id(repeats.remove_later_words(odd))
    for i, w in want.items():
        assert {(r.n_words, r.n_removed, r.kept_sha256) for r in got[i]} == {w}, i
    assert repeats.remove_later_words(empty).count() == 0
    assert sum(w[1] for w in want.values()) > 500


def test_rows_without_an_id_are_documents_of_their_own(spark):
    """What repeats in one text is cut there alone, not in other texts of its id or without one."""
    rnd = random.Random(4)
    make = lambda n: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(n))
    passage, clean, own, short = make(60), make(300), make(200), make(3)
    texts = [f"{make(150)} {passage} {make(9)}", clean, short, f"{own} {passage}", "x", None]
    for ids in ([None] * 6, [7] * 6):
        d = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
        words = Counter((r.n_words, r.n_removed) for r in repeats.remove_later_words(d).collect())
        lost = {n: k for (n, k) in words if k}
        assert sum(words.values()) == 6 and list(lost.values()) == [60] and set(lost) <= {219, 260}
        assert {(300, 0), (3, 0), (1, 0), (0, 0)} <= set(words)
        got = {r.n_bytes: r.n_removed for r in repeats.remove_repeated_bytes(d).collect()}
        assert len(got) == 6 - 0 and got[len(clean)] == got[len(short)] == 0
        assert sorted(n > 0 for n in got.values()) == [False] * 4 + [True] * 2
        cut = [r.text for r in repeats.cut_repeats(d).collect()]
        assert clean in cut and short in cut and None in cut and not any(passage in (t or "") for t in cut) and len(cut) == 6


@pytest.mark.parametrize("contexts", [16384, 1])
def test_repeated_bytes(spark, odd, empty, monkeypatch, contexts):
    monkeypatch.setattr(repeats, "CONTEXTS", contexts)
    docs = list(enumerate(odd_texts()))
    want = repeated_bytes([*docs, docs[5], docs[11]])
    got = by_id(repeats.remove_repeated_bytes(odd))
    for i, w in want.items():
        assert {(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got[i]} == {w}, i
    assert repeats.remove_repeated_bytes(empty).count() == 0
    cut = repeats.cut_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert {r.text for r in cut.where("doc_id = 13").collect()} == {""} or "é" in cut.where("doc_id = 13").first().text


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 64)
    u = np.frombuffer(b"".join(bytes([k % 251, k % 7]) for k in range(900)), np.uint8)
    runs = list(repeats.runs_of(repeats.Bytes, u))
    assert sum(int(n.sum()) for *_, n in runs) == len(u) - 199


# SimHash


def test_simhash(spark, odd, empty):
    def fp(t):
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if not w:
            return 0
        sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = {i: fp(t) for i, t in enumerate(odd_texts())}
    comp = components(want, [(a, b) for a in want for b in want if a < b and (want[a] ^ want[b]).bit_count() <= 2])
    for r in simhash.simhash_components(odd).collect():
        assert r.f0 % (1 << 64) == want[r.doc_id] and r.component_id == comp[r.doc_id]
    assert simhash.simhash_components(empty).count() == 0
    with_null = odd.withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id")))
    assert simhash.simhash_components(with_null).count() == odd.count()
    kept = simhash.keep_one_of_each(with_null)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 1 and kept.where("doc_id = 5").count() == 1 and kept.where("doc_id = 6").count() == 0


@pytest.mark.parametrize("block", [20000, 8])
def test_hamming_links(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(4)
    f = {}
    for i in range(300):
        x = rnd.getrandbits(64) if i % 3 == 0 else f[rnd.randrange(i)]
        for _ in range(rnd.randint(0, 3)):
            x ^= 1 << rnd.randrange(64)
        f[i] = x
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    d = spark.createDataFrame([(i, signed(x)) for i, x in f.items()], "id long, f0 long")
    got = {r.id: r.component_id for r in simhash.components(d, "id", ["f0"], 16, 2).collect()}
    assert got == components(f, [(a, b) for a in f for b in f if a < b and (f[a] ^ f[b]).bit_count() <= 2])


# pages


def test_pages(spark):
    page = "<html><head><title>t</title><style>a{}</style></head><body><nav><li>menu</li></nav><div class='cookie-notice'>yes?</div><article><h1>A &amp; B</h1><p><b>One\n two<br><p>Thr&eacute;e&#33;<script>if (a<b) x('</p>')</script><aside>side</aside><section class=\"comments\"><p>bad</p></section></article><footer>&copy; f</footer></body>"
    plain = "<body><div><p>{}</p></div><div>all rights</div><p>made here</p></body>"
    rows = [(1, "http://a/x", page), (2, None, None), (3, "http://a/y", ""), (4, "", "no tags &lt;b&gt;"), (5, "http://a/z", "<article>cut <b"), (5, "http://a/z", "<article>cut <b"), (6, "http://a/l", "<article>" + "<p>w &amp;</p>" * 20000 + "</article>")]
    rows += [(10 + k, f"http://t.net/{k}", plain.format(f"text {k}")) for k in range(5)]
    got = by_id(html.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")), "page_id")
    t = {k: v[0].text for k, v in got.items()}
    assert t[1] == "A & B\n\nOne two\n\nThrée!" and t[2] == t[3] == "" and t[4] == "no tags <b>" and t[5] == "cut" and len(got[5]) == 2
    assert t[6] == "\n\n".join(["w &"] * 20000) and got[6][0].n_chars == len(t[6])
    assert [t[10 + k] for k in range(5)] == [f"text {k}" for k in range(5)]  # what all pages of the host share is template
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# packing


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary("word_bpe_49k.json"))
    rows = packing.pack_documents(odd, capacity=128).collect()
    texts, seen = odd_texts(), defaultdict(list)
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.start == 128 * r.piece
        seen[r.sequence_id].append((r.offset, r.length))
    for v in seen.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 128
    copies = Counter(r.doc_id for r in odd.collect())
    total = sum(len(ids[i]) * n for i, n in copies.items())
    assert sum(r.length for r in rows) == total and len(seen) <= 1.1 * total / 128 + 1
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_the_histogram(seed):
    rng = np.random.default_rng(seed)
    h = Counter(np.minimum(64, rng.geometric(0.05, 5000)).tolist())
    plan = packing.make_plan(dict(h), 64)
    got = Counter()
    for pattern, n in plan:
        assert sum(s * m for s, m in pattern) <= 64
        for s, m in pattern:
            got[s] += m * n
    assert got == h
    assert sum(n for _, n in plan) <= 1.01 * sum(s * n for s, n in h.items()) / 64 + 1


def test_least_squares_fit_small_histograms():
    """The error of the repeats against a plain projected gradient that runs long."""
    rng = np.random.default_rng(8)
    for _ in range(4):
        want = np.zeros(41)
        want[rng.integers(1, 41, 18)] = rng.integers(1, 60, 18)
        cols = packing.patterns_of(np.flatnonzero(want), 40)
        assert all(a >= b >= c and 40 - packing.SLACK <= a + b + c <= 40 for a, b, c in cols.tolist())
        full = {(a, b, c) for a in range(41) for b in range(a + 1) for c in range(b + 1) if a + b + c == 40 and all(not s or want[s] for s in (a, b, c))}
        assert full <= set(map(tuple, cols.tolist()))
        matrix = np.zeros((41, len(cols)))
        for k, p in enumerate(cols.tolist()):
            for s in p:
                matrix[s, k] += s > 0
        weight = 1 / np.sqrt(np.maximum(want, 1))
        a, b = matrix * weight[:, None], want * weight
        z = np.zeros(len(cols))
        for _ in range(20000):
            z = np.maximum(0, z - a.T @ (a @ z - b) / np.linalg.norm(a, 2) ** 2)
        x = packing.fit_counts(cols, want, 4000, 1e-9)
        assert (x >= 0).all() and np.sum((a @ x - b) ** 2) <= np.sum((a @ z - b) ** 2) * 1.02 + 1e-3


def test_patterns_place_most_sequences(spark):
    pieces_ = packing.token_pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text", packing.vocabulary("word_bpe_49k.json"), 2048, 0)
    h = {r["length"]: r["count"] for r in pieces_.groupBy("length").count().collect()}
    plan, left = packing.pattern_plan(h, 2048)
    several = sum(n for p, n in plan if sum(m for _, m in p) > 1)
    assert several >= sum(n for _, n in packing.make_plan(h, 2048)) / 3
    assert sum(n for _, n in packing.make_plan(h, 2048)) == -(-sum(s * n for s, n in h.items()) // 2048)
    assert {s: n for s, n in Counter({s: sum(m * k for p, k in plan for z, m in p if z == s) for s in h}).items()} == {s: n - left.get(s, 0) for s, n in h.items()}


def test_packing_of_null_ids(spark):
    d = spark.createDataFrame([(None, "a b"), (None, None), (None, "a b"), (1, "x " * 300)], "doc_id long, text string")
    rows = packing.pack_documents(d, capacity=64).collect()
    assert Counter((r.doc_id, r.piece) for r in rows)[None, 0] == 3
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for a, b in zip(places, places[1:], strict=False):
        assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0)


def test_word_codec_equals_tokenizer():
    c = packing.WordCodec(packing.vocabulary("word_bpe_49k.json"))
    rnd = random.Random(0)
    texts = ["".join(rnd.choice("ab cZ.,!'é梦\n<|>İΣ7_ ") for _ in range(rnd.randint(0, 80))) for _ in range(300)] + ["it's <|endoftext|> <|ENDOFTEXT|>.", "word<|endoftext|>,"]
    for t, got in zip(texts, c.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == c.tokenizer.encode(t, add_special_tokens=False).ids, t


# pieces


def test_pieces_round_trip_and_best_score(spark, odd, empty):
    c = pieces.PieceCodec.of(pieces.vocabulary("piece_bpe_32k.model"))
    rnd = random.Random(1)
    vocab = {c.text_of[k]: k for k in range(len(c.text_of)) if c.text_of[k] and k not in c.bytes_at}
    for _ in range(60):
        t = "".join(rnd.choice("the of a,.\n▁ é梦\U0001f600Zx") for _ in range(rnd.randint(1, 24)))
        raw = b" " + t.encode()
        best = [0.0] + [-math.inf] * len(raw)
        for i in range(len(raw)):
            if best[i] == -math.inf or raw[i] & 0xC0 == 0x80:
                continue
            for j in range(i + 1, len(raw) + 1):
                if raw[i:j] in vocab:
                    best[j] = max(best[j], best[i] + c.score[vocab[raw[i:j]]])
            w = len(raw[i:].decode()[0].encode())
            if raw[i : i + w] not in vocab:
                best[i + w] = max(best[i + w], best[i] + c.unknown)
        ids = c.encode(t)
        assert c.decode(ids) == t
        assert math.isclose(c.viterbi(raw)[1], best[-1], rel_tol=1e-9)
        score = sum(c.score[k] for k in np.frombuffer(ids, "<u4").tolist())
        unknown = sum(x.encode() not in vocab for x in " " + t)
        assert math.isclose(score + unknown * c.unknown, best[-1], rel_tol=1e-9)
    back = {r.doc_id: r.text for r in pieces.decode_documents(pieces.encode_documents(odd)).collect()}
    assert back == {i: t or "" for i, t in enumerate(odd_texts())}
    assert pieces.digest_documents(odd).where("not round_trip").count() == 0 and pieces.digest_documents(empty).count() == 0


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = cp.STAGES[0][1](spark, docs, SF)
    b = cp.STAGES[1][1](spark, a, SF)
    c = cp.STAGES[2][1](spark, b, SF)
    assert a.columns == b.columns == c.columns == docs.columns
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [WORDS.findall((t or "").lower())] for i in range(max(1, len(w) - 4))}
    kept = [shingles(r.text) for r in b.collect()]
    near = sum(len(x & y) >= 0.8 * len(x | y) for i, x in enumerate(kept) for y in kept[:i])
    assert near <= 1 and b.count() < a.count()
    want = repeated_bytes([(r.doc_id, r.text) for r in b.collect()])
    for r in c.collect():
        n = len((r.text or "").encode())
        assert want[r.doc_id][0] - want[r.doc_id][1] <= n <= want[r.doc_id][0] - want[r.doc_id][1] + 8 * want[r.doc_id][2]
    rows = cp.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in c.collect()} and max(r.offset + r.length for r in rows) <= 2048


def test_queries_match_their_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        a, b = queries.QUERIES[name](spark, SF).toPandas(), c.execute(sql).fetchdf()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        plain = lambda d: sorted(str(tuple(None if v is None or v != v else int(v) if isinstance(v, float) and v.is_integer() else v for v in r)) for r in d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None))
        assert plain(a) == plain(b), name


def test_url_trees_on_other_hosts(spark):
    """Labels from a rule over shapes, not words: held-out hosts, and the expression against the model itself."""
    from pyspark.ml.feature import VectorAssembler

    rnd = random.Random(9)

    def url(bad):
        name = "".join(rnd.choice("abcdefghij") for _ in range(6))
        if bad:
            return f"http://{name}-{rnd.randint(100, 999)}-{name[:3]}.example.com/{rnd.randint(10**6, 10**7)}?a={rnd.randint(0, 9999)}&b=1&c={name}"
        return f"https://www.{name}.example.org/{name[:4]}/{name[2:]}.html"

    rows = [(url(k % 2), float(k % 2)) for k in range(600)]
    d = spark.createDataFrame(rows, "url string, blocked double")
    model = urls.train(d.limit(300))
    rest = spark.createDataFrame([(k, *r) for k, r in enumerate(rows[300:])] + [(-1, None, 0.0), (-2, "", 0.0)], "page_id long, url string, blocked double")
    got = model.apply(urls.lexical(rest.withColumnRenamed("blocked", "label").withColumns(urls.url_parts(F.col("url"))), "url")).cache()
    right = got.where("page_id >= 0").agg(F.avg((F.col("blocked") == (F.col("label") == 1)).cast("int"))).first()[0]
    assert right >= 0.95
    whole = VectorAssembler(inputCols=list(urls.FEATURES), outputCol="features").transform(got.na.drop(subset=["url"]))
    assert model.fitted.transform(whole).where((F.col("prediction") == 1) != F.col("blocked")).count() == 0
    verdicts = {r.page_id: r.verdict for r in urls.judge(rest, [], labelled=d).collect()}
    assert len(verdicts) == 302 and set(verdicts.values()) == {"allow", "block"}


def test_pieces_of_any_ids(spark):
    c = pieces.PieceCodec.of(pieces.vocabulary("piece_bpe_32k.model"))
    for text in ("hello", " two  spaces ", "né 語 \U0001f600!"):
        ids = np.frombuffer(c.encode(text), "<u4")
        whole = b"".join(c.text_of[k] for k in ids.tolist())
        for lo in range(len(ids) + 1):
            for hi in range(lo, len(ids) + 1):
                raw = b"".join(c.text_of[k] for k in ids[lo:hi].tolist())
                assert c.decode(ids[lo:hi].tobytes()) == raw.removeprefix(b" ").decode(errors="replace")
        assert c.decode(ids.tobytes()) == text and whole == b" " + text.encode()
    first = int(np.frombuffer(c.encode("a"), "<i4")[0])
    d = spark.createDataFrame([(1, [first, None, -5, 10**9]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode_documents(d).collect()} == {1: "a" + "\ufffd" * 3, 2: "", 3: ""}


def test_vectors_of_any_size(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 16))
    x[30:] = x[:30] + 0.05 * rng.standard_normal((30, 16))
    scale = [1e200, 1e-200, 1.0, 3e-5]
    d = spark.createDataFrame([(k, [float(a) for a in v * scale[k % 4]], "a") for k, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T) >= 0.98).sum(1) - 1
    assert {r.vec_id: r.n_links for r in vectors.near_vectors(d).collect()} == dict(enumerate(want.tolist())) and want.sum() > 20
