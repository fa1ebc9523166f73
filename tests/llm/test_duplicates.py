import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparksymbols.llm import exact_dedup, minhash, repeats, shingles, suffixes

SCHEMA = "doc_id bigint, text string, lang string, _id string, keep_id string, key string, n int"
WORDS = [a + b for a in "ka lo mi ne ru sa te vu wo xi".split() for b in "na pe ri so tu".split()]


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "a", "b", "c", 1) for i, t in rows], SCHEMA)


def texts(seed, n=60):
    """Near copies in families, shared passages, tiny, blank, empty and null texts, equal ones, a long one."""
    rng = random.Random(seed)
    word = lambda: rng.choice(WORDS)
    bases = [[word() for _ in range(rng.choice([3, 8, 40, 200]))] for _ in range(8)]
    passage = " ".join(word() for _ in range(14))
    out = [None, "", "  \n", "one", "One", "one two three four", "x" * 700_000, "y " * 3000, "y " * 3001]
    for _ in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            w[rng.randrange(len(w))] = word()
        text = " ".join(w).upper() if rng.random() < 0.1 else " ".join(w)
        out.append(text + (f"\n{passage}\t" if rng.random() < 0.3 else ""))
    rng.shuffle(out)
    return list(enumerate(out, start=100))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_exact_dedup(spark):
    rows = [(1, "a"), (5, "a"), (3, "a"), (2, None), (7, ""), (9, "b"), (None, "b"), (None, "c"), (None, "c"), (4, "d"), (4, "d")]
    rows += [(100 + i, "hot") for i in range(300)]
    got = exact_dedup.exact_dedup(table(spark, rows), support=0.1)
    last = {}
    for i, t in rows:
        last.setdefault(t or "", []).append(i)
    want = []
    for i, t in rows:
        group = last[t or ""]
        keep = max((x for x in group if x is not None), default=None)
        want.append((i, keep, len(group), i == keep))
    assert sorted(((r[0], r[1], r[2], r[3]) for r in got.collect()), key=str) == sorted(want, key=str)
    stay = exact_dedup.drop_exact_copies(table(spark, rows))
    assert stay.columns == table(spark, []).columns
    assert sorted((r["doc_id"] for r in stay.collect()), key=str) == sorted((w[0] for w in want if w[3]), key=str)
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def test_heavy_digests_are_bounded_and_hold_the_frequent(spark):
    rows = exact_dedup.digests(table(spark, [(i, f"t{i % 7 if i % 2 else i}") for i in range(4000)]))
    heavy = exact_dedup.heavy_digests(rows, 0.02).collect()
    assert len(heavy) <= 50 and sum(r["group_size"] > 200 for r in heavy) == 7


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = texts(seed)
    assert rows_of(minhash.near_duplicates(table(spark, rows))) == sorted(brute.near(rows), key=str)


def test_pipeline_drops_near_copies_from_four_fifths(spark):
    """Families of which each pair shares 80 to 85 per cent: the pipeline's stage takes them for near copies, and finds all."""
    import corpus_pipeline

    rng = random.Random(6)
    rows = []
    for i in range(120):
        w = [rng.choice(WORDS) + f"{i}x{p}" for p in range(304)]  # 300 shingles; each word inside changes five
        other = list(w)
        for p in rng.sample(range(10, 290, 10), rng.choice([5, 6, 6])):
            other[p] = f"new{i}x{p}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    sets = [brute.shingles(t) for _, t in rows]
    shares = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert 0.8 <= min(shares) < max(shares) < 0.85
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, table(spark, rows), "").collect()}
    assert kept == {i for i, _, _, keep in brute.near(rows, percent=80) if keep} == {2 * i for i in range(120)}


def test_bands_follow_the_similarity():
    assert minhash.band_shape(85) == (25, 5)
    for percent in (50, 70, 80, 85, 95):
        count, rows = minhash.band_shape(percent)
        assert count * rows <= minhash.BINS and (1 - (percent / 100) ** rows) ** count <= minhash.MISSED


def test_near_duplicates_of_large_families(spark, monkeypatch):
    """Buckets larger than a block, with classes that only meet through later members."""
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 16)
    rng = random.Random(3)
    base = [rng.choice(WORDS) + str(i) for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for p in rng.sample(range(120), rng.choice([0, 1, 2, 3])):
            w[p] = f"new{i}x{p}"
        rows.append((i, " ".join(w)))
    assert rows_of(minhash.near_duplicates(table(spark, rows))) == sorted(brute.near(rows), key=str)


def test_near_duplicates_edges(spark):
    got = rows_of(minhash.near_duplicates(table(spark, [(None, "a b c d e f"), (8, "a b c d e f"), (None, None), (3, "z"), (3, "z")])))
    assert got == sorted([(None, 2, 8, False), (8, 2, 8, True), (None, 0, None, True), (3, 1, 3, True), (3, 1, 3, True)], key=str)
    assert minhash.near_duplicates(table(spark, [])).count() == 0
    kept = minhash.drop_near_copies(table(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (5, None)]))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 5, None]


def test_odd_sketch_estimates():
    rng = np.random.default_rng(5)
    for shared, own in ((1000, 50), (1000, 100), (1000, 300)):
        common = rng.integers(0, 2**63, shared, np.uint64) * np.uint64(2)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, own, np.uint64) * np.uint64(2) + np.uint64(1)])) for _ in range(2))
        flips = np.bitwise_count(np.bitwise_xor(*minhash.odd_sketches(minhash.samples([a, b])))).sum()
        estimate = 1 + minhash.SKETCH_BITS / (4 * minhash.BINS) * np.log(1 - 2 * flips / minhash.SKETCH_BITS)
        assert abs(estimate - shared / (shared + 2 * own)) < 0.1


def test_words_across_blocks(monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK", 32)
    monkeypatch.setattr(shingles, "_powers", [])
    data = b"  ab cd\t" + b"q" * 100 + b"\nab " + b"z" * 31 + b" cd " + b"w" * 32
    starts, hashes = shingles.words(data)
    found = [data[s:].split()[0] for s in starts]
    assert found == data.split()
    assert len(set(hashes.tolist())) == len(set(data.split()))


@given(st.binary(max_size=300) | st.text("ab", max_size=400).map(str.encode) | st.integers(0, 60).map(lambda n: b"abcab" * n))
@settings(max_examples=150, deadline=None)
def test_two_stage_sort(data):
    t = np.frombuffer(data, np.uint8)
    order = suffixes.two_stage_sort(t, 24)
    assert sorted(order.tolist()) == list(range(len(t)))
    cut = [data[i : i + 24].ljust(24, b"\0") for i in order]
    assert cut == sorted(cut)


@given(st.lists(st.text("ab", max_size=90), max_size=8), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_equal_windows_have_equal_anchors(parts, extra):
    texts = [p.encode() for p in parts] + [("ab" * 40).encode()] * extra
    data, ends = b"".join(texts), np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
    start, count, h, doc = suffixes.anchors(np.frombuffer(data, np.uint8), ends, 30)
    seen, places = {}, []
    for s, n, x, d in zip(start.tolist(), count.tolist(), h.tolist(), doc.tolist(), strict=True):
        for p in range(s, s + n):
            places.append((d, p))
            assert seen.setdefault(data[p : p + 30], x) == x
    begin = [0, *ends.tolist()]
    assert places == [(d, p) for d in range(len(texts)) for p in range(begin[d], begin[d + 1] - 29)]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats(spark, hot):
    rows = [*texts(7, 40), (None, " ".join(WORDS)), (3, " ".join(WORDS)), (2, "é" * 30 + " ".join(WORDS[5:])), (90, "é" * 60), (90, "é" * 60)]
    got = repeats.remove_repeats(spark, table(spark, rows), section_bytes=3000, bucket_bytes=4000, hot=hot, with_text=True).collect()
    assert sorted(((r[0], r[1], r[2], r[3], r[4]) for r in got), key=str) == sorted(brute.repeats(rows), key=str)
    assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in got)
    assert repeats.remove_repeats(spark, table(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["component"] for r in minhash.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}


def test_components_grow_with_links(spark):
    """Classes found before plus further links are the classes of all links."""
    rng = random.Random(8)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(120)]
    later = [(rng.randrange(320), rng.randrange(320)) for _ in range(90)]
    frame = lambda rows: spark.createDataFrame(rows, "a bigint, b bigint")
    get = lambda df: {r["node"]: r["component"] for r in df.collect() if r["node"] != r["component"]}
    first = minhash.components(frame(pairs))
    assert get(minhash.joined_components(first, frame(later))) == get(minhash.components(frame(pairs + later)))
    assert get(minhash.joined_components(first, frame([]))) == get(first)
    assert get(minhash.joined_components(minhash.components(frame([])), frame(later))) == get(minhash.components(frame(later)))


def test_jobs_of_near_copies_are_few(spark):
    """The number of jobs follows the rounds of the components, not partitions or rows."""
    tracker = spark.sparkContext.statusTracker()

    def jobs(df):
        group = f"near-{df.rdd.getNumPartitions()}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            assert minhash.drop_near_copies(df, percent=80).count()
            return len(tracker.getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setJobGroup("", "")

    docs = table(spark, texts(5, 120))
    few, many = jobs(docs.repartition(2)), jobs(docs.repartition(40))
    assert max(few, many) < 260 and abs(few - many) < 20, (few, many)
