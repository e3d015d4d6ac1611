"""Operators on texts against brute force, on a table of hard cases."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import pytest

from windrift.llm.common import Scratch
from windrift.llm.quality import quality_rules
from windrift.llm.recompression import remove_repeats
from windrift.llm.suffixes import Passages, repeated_passages
from windrift.llm.weighted_minhash import Likeness, near_duplicate_classes


def rows_of(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


def test_quality_rules_equal_brute_force(documents, words):
    want = []
    for i, t in rows_of(documents):
        w = words(t)
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = set()
        for k in range(len(w) - 4):
            if windows[tuple(w[k : k + 5])] > 1:
                hit.update(range(k, k + 5))
        lines = [x for x in (t or "").split("\n") if words(x)]
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        longest = max((n for n in range(8, len(w)) if max(Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)).values()) > 1), default=0) if hit and len(w) < 700 else 0
        eights, long = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), set()
        for k in range(len(w) - 7):
            if eights[tuple(w[k : k + 8])] > 1:
                long.update(range(k, k + 8))
        verdict = not failed and len(long) <= 0.15 * len(w) and longest <= 50
        want.append((i, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed, verdict, len(long), longest))
    got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"], r["covered_words"], r["longest_repeat"]) for r in quality_rules(documents, keep_columns=["doc_id"]).collect()]
    assert sorted(got) == sorted(want)


def test_quality_rules_on_nothing(empty):
    assert quality_rules(empty).count() == 0


def test_long_repeats_decide_where_base_rules_do_not(spark):
    say = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, say("a", 400)), (2, say("b", 60) + " " + say("c", 600) + " " + say("b", 60)), (3, say("d", 20) + " " + say("e", 210) + " " + say("d", 20)), (4, " ".join(f"{say(f'f{k}x', 6)} {say(f'g{k}x', 60)} {say(f'f{k}x', 6)}" for k in range(5)))]
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert [(got[k]["kept"], got[k]["covered_words"], got[k]["longest_repeat"]) for k in (1, 2, 3, 4)] == [(True, 0, 0), (False, 120, 60), (False, 40, 20), (True, 0, 0)]


def test_a_long_text_of_one_phrase(spark):
    text = "one two three four five six seven eight nine " * 60_000
    r = quality_rules(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()[0]
    assert (r["n_words"], r["covered_words"], r["longest_repeat"], r["kept"]) == (540_000, 540_000, 539_991, False)


def test_recompression_equals_brute_force(spark, documents, words):
    rows = rows_of(documents)
    count = Counter(tuple(w[k : k + 35]) for _, t in rows for w in [words(t)] for k in range(len(w) - 34))
    want, texts = [], {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        kept = [x for k, x in enumerate(w) if k not in gone]
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
        texts[i] = " ".join(kept) if gone else t
    got = remove_repeats(Scratch(spark), documents, with_text=True)
    assert set(got.columns) >= {"lang", "source", "n_chars", "kept_text"}
    rows = got.collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows) == sorted(want)
    assert all(r["kept_text"] == texts[r["doc_id"]] for r in rows)


def test_recompression_on_nothing(spark, empty):
    assert remove_repeats(Scratch(spark), empty).count() == 0


def test_sparse_suffixes_find_all_passages(spark, documents, words):
    rows = rows_of(documents)
    count = Counter(tuple(w[k : k + 50]) for _, t in rows for w in [words(t)] for k in range(len(w) - 49))
    got = defaultdict(set)
    for r in repeated_passages(Scratch(spark), documents).collect():
        assert r["n_words"] == r["end_word"] - r["start_word"] >= 50
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    for i, t in rows:
        w = words(t)
        want = set()
        for k in range(len(w) - 49):
            if count[tuple(w[k : k + 50])] > 1:
                want.update(range(k, k + 50))
        assert got[i] == want


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("n", [1, 40])
def test_texts_without_repeats(spark, partitions, n):
    partitions(n)
    clean = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(60))), (2, " ".join(f"b{i}" for i in range(60)))], "doc_id bigint, text string")
    none = spark.createDataFrame([(1, None), (None, None), (None, "")], "doc_id bigint, text string")
    for docs in (clean, none):
        assert repeated_passages(Scratch(spark), docs).count() == 0
        assert [r["n_removed"] for r in remove_repeats(Scratch(spark), docs).collect()] == [0] * docs.count()
    if n == 1:
        assert sorted(r["class_size"] for r in near_duplicate_classes(Scratch(spark), clean.union(none)).collect()) == [1] * 5


@pytest.mark.parametrize("n,crowd", [(64, 4000), (8, 3)])
def test_no_passage_is_lost_between_tasks(spark, partitions, n, crowd):
    """Pairs of texts that share fifty words, some of them around a passage that all share, and a null id."""
    partitions(n)
    rng = random.Random(n)
    say = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    hot, rows, want = say(26), [], {}
    for k in range(200):
        left = rng.randrange(25)
        passage = say(left) + hot + say(24 - left) if k % 2 else say(50)
        for half in (2 * k, 2 * k + 1):
            head = say(rng.randrange(1, 30))
            rows.append((None if half == 399 else half, " ".join(head + passage + say(rng.randrange(30)))))
            want[half] = (len(head), len(head) + 50, half ^ 1)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["start_word"], r["end_word"], r["partner_doc_id"]) for r in repeated_passages(Scratch(spark), docs, Passages(crowd=crowd)).collect()}
    assert len(got) == 400
    for half, (a, z, other) in want.items():
        found = got[None if half == 399 else half]
        assert found[:2] == (a, z)
        assert found[2] == (None if other == 399 else other)


def test_words_that_share_sixteen_bits_are_told_apart(spark):
    """Two texts share 49 words; the next differ, but not in the bits that neighbours are compared by."""
    import pyarrow as pa

    from windrift.llm.words import Words

    words = [f"w{i}" for i in range(4000)]
    alike: dict[int, list[str]] = defaultdict(list)
    for x, h in zip(words, Words(pa.array([" ".join(words)])).hashes.tolist(), strict=True):
        alike[h % 65535].append(x)
    pairs = [v[:2] for v in alike.values() if len(v) > 1][:20]
    assert len(pairs) == 20
    rows = []
    for k, (x, y) in enumerate(pairs):
        shared = [f"s{k}x{i}" for i in range(49)]
        last = [f"t{k}"] if k % 2 else []  # some go on alike after the word that differs
        rows += [(2 * k, " ".join([*shared, x, *last])), (2 * k + 1, " ".join([*shared, y, *last]))]
    true = [f"q{i}" for i in range(55)]
    rows += [(100, " ".join([*true, pairs[0][0]])), (101, " ".join([*true, pairs[0][1]]))]
    got = repeated_passages(Scratch(spark), spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"], r["partner_doc_id"]) for r in got) == [(100, 0, 55, 101), (101, 0, 55, 100)]


def test_sparse_suffixes_on_nothing(spark, empty):
    assert repeated_passages(Scratch(spark), empty).count() == 0


def shingle_counts(w):
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_near_duplicate_classes_equal_brute_force(spark, documents, words):
    rows = rows_of(documents)
    bags = [shingle_counts(words(t)) for _, t in rows]
    df = Counter(s for b in bags for s in b)
    n = len(rows)
    weight = lambda s: math.log(1 + n / max(df[s], 1, 0.001 * n))
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        if rows[a][1] is None or rows[b][1] is None:
            alike = rows[a] == rows[b]
        elif rows[a][1] == rows[b][1]:
            alike = True
        else:
            either = set(bags[a]) | set(bags[b])
            high = sum(max(bags[a][s], bags[b][s]) * weight(s) for s in either)
            alike = high > 0 and sum(min(bags[a][s], bags[b][s]) * weight(s) for s in either) >= 0.8 * high
        if alike:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    least = defaultdict(lambda: 10**9)
    for k in range(n):
        least[find(k)] = min(least[find(k)], rows[k][0])
    got = near_duplicate_classes(Scratch(spark), documents).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == sorted((rows[k][0], least[find(k)]) for k in range(n))
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_likenesses_of_bags(words):
    import numpy as np

    from windrift.llm.weighted_minhash import likenesses

    rng = random.Random(2)
    texts = [Counter(rng.choices(range(30), k=rng.randint(0, 40))) for _ in range(12)]
    weight = {s: 0.5 + s / 10 for s in range(30)}
    rows = [(i, s, c, weight[s]) for i, b in enumerate(texts) for s, c in b.items()]
    got = likenesses(*(np.array(x) for x in zip(*rows, strict=True)), len(texts), step=5)
    for (i, a), (j, b) in itertools.product(enumerate(texts), repeat=2):
        high = sum(max(a[s], b[s]) * weight[s] for s in set(a) | set(b))
        assert abs(got[i, j] - (sum(min(a[s], b[s]) * weight[s] for s in set(a) & set(b)) / high if high else 0)) < 1e-12


@pytest.mark.parametrize("square", [300_000, 3_000])
def test_near_duplicates_that_meet_only_in_long_runs(spark, words, square):
    template = [f"t{i}" for i in range(284)]
    tail = lambda k: [f"p{k // 2 if k < 40 else k}", *(f"u{k}x{j}" for j in range(4))]
    rows = [(k, " ".join(template + tail(k))) for k in range(240)]
    bags = [shingle_counts(words(t)) for _, t in rows]
    df = Counter(s for b in bags for s in b)
    weight = {s: math.log(1 + len(rows) / df[s]) for s in df}
    least = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        shared = sum(weight[s] for s in set(bags[a]) & set(bags[b]))
        if shared >= 0.8 * sum(weight[s] for s in set(bags[a]) | set(bags[b])):
            least[b] = min(least[b], a)
    assert sum(x != k for k, x in enumerate(least)) == 20  # twenty pairs, the others are alike to nothing
    got = near_duplicate_classes(Scratch(spark), spark.createDataFrame(rows, "doc_id bigint, text string"), Likeness(square=square)).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == list(enumerate(least))


def test_near_duplicate_classes_on_nothing(spark, empty):
    assert near_duplicate_classes(Scratch(spark), empty).count() == 0
