"""The corpus pipeline, stage by stage, against brute force and on the smallest tables."""

import itertools
import math
import os
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from windrift.llm.common import Scratch

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_follow_each_other(spark, words):
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.save(stage(spark, docs, SF))
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids and (before is None or ids <= before)
        if name != "best_fit_packing":
            assert out.columns == columns
        if name == "substring_dedup":
            seen, again = set(), 0
            for r in out.collect():
                w = words(r["text"])
                assert r["n_chars"] == len(r["text"])
                again += len(w) == 0
            assert not again
        before, docs = ids, out
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def alike(rows, words):
    """The smallest row number that links of weighted Jaccard similarity reach, for each row."""
    bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    bags, n = [bag(words(r["text"])) for r in rows], len(rows)
    df = Counter(s for b in bags for s in b)
    weight = {s: math.log(1 + n / max(df[s], 0.001 * n)) for s in df}
    least = list(range(n))
    changed = True
    near = [(a, b) for a, b in itertools.combinations(range(n), 2) if rows[a]["text"] == rows[b]["text"] or (high := sum(max(bags[a][s], bags[b][s]) * weight[s] for s in set(bags[a]) | set(bags[b]))) and sum(min(bags[a][s], bags[b][s]) * weight[s] for s in set(bags[a]) & set(bags[b])) >= 0.8 * high]
    while changed:
        changed = False
        for a, b in near:
            low = min(least[a], least[b])
            changed |= (least[a], least[b]) != (low, low)
            least[a] = least[b] = low
    return least


def test_stages_equal_brute_force(spark, documents, words):
    """Each stage on its own input, beside columns that clash with an operator's own."""
    stages = dict(corpus_pipeline.STAGES)
    scratch = Scratch(spark)
    run = lambda name, docs: scratch.save(stages[name](spark, docs, SF))
    key = lambda r: (r["doc_id"], r["text"])

    def windows(w, n):
        return Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))

    def covered(w, n, count):
        return {k + j for k in range(len(w) - n + 1) if count[tuple(w[k : k + n])] > 1 for j in range(n)}

    first = run("quality_rules", documents)
    want = []
    for r in documents.collect():
        w = words(r["text"])
        long = covered(w, 8, windows(w, 8))
        if len(w) >= 10 and 5 * len(covered(w, 5, windows(w, 5))) <= len(w) and len(long) <= 0.15 * len(w) and not covered(w, 51, windows(w, 51)):
            want.append(tuple(r))
    assert sorted(map(tuple, first.collect())) == sorted(want) and first.columns == documents.columns

    rows = sorted(first.collect(), key=lambda r: r["doc_id"])
    second = run("minhash_near_dedup", first)
    least = alike(rows, words)
    assert sorted(map(tuple, second.collect())) == sorted({tuple(rows[k]) for k in least})

    third = run("substring_dedup", second)
    count = sum((windows(words(r["text"]), 35) for r in second.collect()), Counter())
    want = []
    for r in second.collect():
        w = words(r["text"])
        gone = covered(w, 35, count)
        text = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else r["text"]
        if text:
            want.append(tuple({**r.asDict(), "text": text, "n_chars": len(text)}.values()))
    assert sorted(map(tuple, third.collect())) == sorted(want)

    fourth = run("source_mixing", third)
    sizes, taken = Counter(), Counter()
    for r in third.collect():
        sizes[r["source"]] += len(words(r["text"]))
    whole = {key(r)[0]: words(r["text"]) for r in third.collect()}
    for r in fourth.collect():
        taken[r["source"]] += len(words(r["text"]))
        rest = iter(whole[r["doc_id"]])
        assert all(x in rest for x in words(r["text"])) and r["n_chars"] == len(r["text"]) and r["places"] == "p"
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    unit, closed = 0.0, set()
    while True:
        unit = (sum(sizes.values()) - sum(3 * sizes[s] for s in closed)) / sum(weight[s] for s in names if s not in closed)
        more = {s for s in names if s not in closed and weight[s] * unit > 3 * sizes[s]}
        if not more:
            break
        closed |= more
    for s in names:
        target = 3 * sizes[s] if s in closed else weight[s] * unit
        assert abs(taken[s] - target) <= max(48, 0.02 * target)

    fifth = run("best_fit_packing", fourth)
    places = defaultdict(list)
    for r in fifth.collect():
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        ends = [a + n for a, n in sorted(spans)]
        assert [a for a, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert Counter(r["doc_id"] for r in fifth.collect() if r["piece"] == 0) == Counter(r["doc_id"] for r in fourth.collect())


def test_stages_of_an_empty_table(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_registered_queries_have_their_names():
    from windrift.llm.queries import QUERIES

    assert {f"op{k}" for k in range(1, 14)} | {"pipeline"} == {n.split("_")[0] for n in QUERIES}
