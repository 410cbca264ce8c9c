"""Near-duplicates against all pairs by brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from stratalens.llm import common, exact_dedup, graph, mixing, near_dup, queries


def bag(t, width=5):
    w = (t or "").encode().lower().split()
    return Counter(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else Counter([tuple(w)] if w else [])


def classes(texts, least=0.8):
    bags, where = [bag(t) for t in texts], {}
    for i, b in enumerate(bags):
        for s in b:
            where.setdefault(s, []).append(i)
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in {(a, b) for held in where.values() for k, a in enumerate(held) for b in held[k + 1 :]}:
        both = sum((bags[x] & bags[y]).values())
        if both / (sum(bags[x].values()) + sum(bags[y].values()) - both) >= least:
            p, q = top(x), top(y)
            root[max(p, q)] = min(p, q)
    return [top(i) for i in range(len(texts))]


def run(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, class_id string")
    return {r.doc_id: r for r in near_dup.near_duplicates(df, **options).collect()}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        a = {int(x): int(rng.integers(1, 9)) if rng.random() < 0.3 else 1 for x in rng.integers(0, 1 << 60, 200)}
        b = {x: max(1, n + int(rng.integers(-3, 4))) for x, n in a.items() if rng.random() < 0.85}
        pair = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        s = near_dup.bag_min_hash(pair, 512)
        errors.append((s[0] == s[1]).mean() - near_dup.similarity(*pair))
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.035


def test_signature_of_few_and_heavy_shingles():
    one = (np.array([7], np.uint64), np.array([1]))
    heavy = (np.array([7], np.uint64), np.array([10_000]))
    s = near_dup.bag_min_hash([one, one, heavy], 96)
    assert np.isfinite(s).all() and (s[0] == s[1]).all() and (s[0] == s[2]).mean() < 0.1


def test_table_against_brute_force(spark, smallest):
    docs = sorted(spark.read.parquet(f"{smallest}/documents.parquet").collect(), key=lambda r: r.doc_id)
    want = classes([r.text for r in docs])
    got = {r.doc_id: r.class_id for r in queries.op8_near_dup(spark, smallest).collect()}
    assert got == {r.doc_id: docs[want[i]].doc_id for i, r in enumerate(docs)}


@pytest.mark.parametrize("chunk", [1_000, 4_000, 200_000])  # bytes: a text, three texts, all texts
def test_chains_and_false_centres(spark, chunk):
    """Texts drifting away word by word: the first resembles the last no more, yet all links count."""
    rnd = random.Random(5)
    texts = []
    for _ in range(4):
        words = [f"w{rnd.randint(0, 10**6)}" for _ in range(120)]
        for step in range(12):
            texts.append(" ".join(words))
            words[step * 9] = f"n{rnd.randint(0, 10**6)}"
    texts += [" ".join(f"u{rnd.randint(0, 10**6)}" for _ in range(80)) for _ in range(20)]
    rnd.shuffle(texts)
    got = run(spark, texts, chunk=chunk)
    assert [got[i].class_id for i in range(len(texts))] == classes(texts)


def test_cases(spark):
    got = run(spark, ["a b c", "A b  c", None, "", None, "a b c d", "x " * 20_000, "x " * 19_000, "x " * 9_000])
    assert [got[i].class_id for i in range(9)] == [0, 0, 2, 3, 4, 5, 6, 6, 8]
    assert [got[i].kept for i in range(9)] == [True, False, True, True, True, True, True, False, True]
    assert run(spark, []) == {}
    twice = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    rows = near_dup.near_duplicates(twice).collect()
    assert {(r.class_id, r.class_size) for r in rows} == {(3, 3)} and sum(r.kept for r in rows) == 1
    assert near_dup.keep_one(twice).collect() == [(3, "a b")]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3), (200, 100), (100, 200)]
    got = {r.u: r.v for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 200: 100}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rows_stay_the_same_when_splits_change(spark, tmp_path, monkeypatch):
    """Files are cut into other splits after the first table is written, as after the loss of an executor."""
    texts = [f"w{i % 20} " + " ".join(f"t{i % 20}x{k}" for k in range(40)) + (" end" if i >= 20 else "") for i in range(40)]
    exact = [t.removesuffix(" end") for t in texts]
    for name, held in (("near", texts), ("exact", exact)):
        spark.createDataFrame([(i, t, "a", len(t)) for i, t in enumerate(held)], "doc_id long, text string, source string, n_chars long").repartition(8, "doc_id").write.parquet(f"{tmp_path}/{name}")
    size = "spark.sql.files.maxPartitionBytes"
    before, real = spark.conf.get(size), near_dup.materialize
    for module, run, name in ((near_dup, near_dup.keep_one, "near"), (exact_dedup, exact_dedup.keep_one, "exact"), (mixing, mixing.apply_mix, "exact")):

        def shifted(*args, **kwargs):
            out = real(*args, **kwargs)
            spark.conf.set(size, "64k")
            return out

        read = lambda: sorted(map(tuple, run(spark.read.parquet(f"{tmp_path}/{name}")).collect()))  # noqa: B023, E731
        want = read()
        monkeypatch.setattr(module, "materialize", shifted)
        try:
            assert read() == want, module.__name__
        finally:
            spark.conf.set(size, before)
            monkeypatch.setattr(module, "materialize", real)


def merged(links):
    """The smallest node of each linked node's component."""
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = top(u), top(v)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in root}


def test_cells_between_parts(spark):
    """A part that fills many chunks, small parts and strays in one bucket: all pairs of parts meet, rows of one part do not."""
    rnd = random.Random(4)
    common = [f"w{i}" for i in range(60)]
    texts, part = [], []
    for i in range(60):  # one part of similar texts
        texts.append(" ".join(common + [f"e{i % 3}"]))
        part.append(0)
    for i in range(12):  # strays, of which every third resembles the part, and the others each other in pairs
        own = [f"s{i // 2}x{k}" for k in range(60)]
        texts.append(" ".join(common + ["stray"]) if i % 3 == 0 else " ".join([*own, f"t{i}"]))
        part.append(100 + i)
    found, _ = near_dup.bags(texts, 5)
    rows = [(i, h.tobytes(), c.astype(np.int32).tobytes(), 12 * len(h)) for i, (h, c) in enumerate(found)]
    held = spark.createDataFrame(rows, "row long, hashes binary, counts binary, size long")
    members = spark.createDataFrame([(7, i, p) for i, p in enumerate(part)] + [(8, 60, 160), (8, 63, 163)], "bucket long, row long, part long")
    want = {}
    for i, j in itertools.combinations(range(len(texts)), 2):
        if part[i] != part[j] and near_dup.similarity(found[i], found[j]) >= 0.8:
            want.setdefault(part[i], set()).add(part[j])
    for chunk in (1, 2_000, 10**6):
        links = near_dup.link_cells(members, held, 0.8, chunk).collect()
        assert all(near_dup.similarity(found[r.u], found[r.v]) >= 0.8 for r in links)
        joined, whole = merged([(part[r.u], part[r.v]) for r in links]), merged([(a, b) for a, bs in want.items() for b in bs])
        assert joined == whole and whole


def test_filter_grows_with_the_rows():
    assert near_dup.filter_bits(0) == near_dup.filter_bits(1000) == 1 << 20
    assert near_dup.filter_bits(1 << 20) == 1 << 24 and near_dup.filter_bits(10**9) == 1 << 28


def test_tables_on_the_way_are_deleted(spark, smallest, tmp_path, monkeypatch):
    """The result is read from what stays: the classes alone, and for kept rows the numbered rows too."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    found = near_dup.near_duplicates(docs)
    assert {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()} == {"near-placed"}
    kept = near_dup.keep_one(docs)
    assert {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()} == {"near-placed", "near-docs", "near-gone"}
    assert found.count() == docs.count() and found.where("kept").count() == kept.count()
