"""Sharding, mixing, packing, embeddings, licences and language models."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from windrift.llm import licenses
from windrift.llm.common import Scratch, components
from windrift.llm.embeddings import near_duplicates
from windrift.llm.language_model import Language, score_documents
from windrift.llm.mixing import Mix, Plan, drawn_counts, mix_documents, mixed_texts, permuted
from windrift.llm.packing import Pack, best_fit, complete_bins, completed, dominated, fillings, improved, lower_bound, pack_counts, pack_documents, tokenizer
from windrift.llm.queries import tokenizer_path
from windrift.llm.sharding import shard_documents


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        c = (low + high) // 2
        used, room = 1, c
        for s in sizes:
            if s > room:
                used, room = used + 1, c
            room -= s
        low, high = (low, c) if used <= shards else (c + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_are_minimax(spark, documents, shards):
    rows = documents.select("doc_id", "text").collect()
    out = shard_documents(Scratch(spark), documents, shards).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in rows)
    sizes, slots, places = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(0 <= s < shards for s in sizes)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    text = {r["doc_id"]: r["text"] for r in rows}
    for r in out:
        t = text[r["doc_id"]]
        places[t].add(r["shard"])
        assert r["size"] == (len(t.encode()) if t else 0) + 16 and r["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
    assert all(len(v) == 1 for v in places.values())
    from pyspark.sql import functions as F

    groups = documents.groupBy(F.xxhash64("text").alias("h")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("s")).orderBy("h").collect()
    assert max(sizes.values()) == least_capacity([g["s"] for g in groups], shards)


def test_shards_of_nothing(spark, empty):
    assert shard_documents(Scratch(spark), empty).count() == 0


def wanted_targets(sizes, mix=Mix()):
    """Targets by the definition: share by weight, stop those above the limit, share the rest anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(names)}
    out, rest, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit > mix.limit * sizes[s]}
        if not full:
            return out | {s: weight[s] * unit for s in open_}
        out |= {s: float(mix.limit * sizes[s]) for s in full}
        rest -= sum(mix.limit * sizes[s] for s in full)
        open_ -= full
    return out


@pytest.mark.parametrize("few", [1, 7, 100])
def test_targets_fill_up_to_the_limit(spark, few):
    cases = [{"a": 100, "b": 1000, None: 10}, {"a": 0}, {"é": 50, "b": 2, "a": 3, "Z": 4000, "": 7, None: 0}, {f"s{k}": k * k for k in range(60)}]
    for sizes in cases:
        rows = [(k, s, "w " * n) for k, (s, n) in enumerate(sizes.items())]
        out = mix_documents(Scratch(spark), spark.createDataFrame(rows, "doc_id bigint, source string, text string"), Mix(few_sources=few)).collect()
        want = wanted_targets(sizes)
        for r in out:
            s = rows[r["doc_id"]][1]
            assert r["source_size"] == r["size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
            # Off by a block and by what one shard's draw of its slots is off.
            assert abs(r["taken"] - want[s]) <= 32 * (1.5 + 4 * (want[s] / 32 / 40) ** 0.5) + 64 * (few < 100) and r["taken"] <= 3 * sizes[s]
            assert sum(x["words"] for x in r["shards"]) == r["taken"] and all(0 <= x["out_shard"] < 40 and x["words"] for x in r["shards"])


def test_draws_follow_their_probabilities_and_limits():
    rng = np.random.default_rng(1)
    owed, most, share = np.array([600.0, 300.0, 100.0, 0.0]), np.array([10**6] * 4), np.full(10, 100)
    first = np.array([drawn_counts(owed, most, share, rng)[0] for _ in range(400)])
    assert np.abs(first.mean(0) - owed / 10).max() < 1.5 and np.abs(first.var(0) - 100 * owed / 1000 * (1 - owed / 1000)).max() < 6
    for limit in ([590, 10**6, 10**6, 0], [334, 333, 333, 0], [600, 300, 90, 10]):
        out = drawn_counts(owed, np.array(limit), share, rng)
        assert (out.sum(1) == 100).all() and (out.sum(0) <= limit).all()
    assert (np.abs(drawn_counts(owed, most, share, rng).sum(0) - owed) <= 20).all()


def by_slots(rows, slots, block=32):
    """Words taken from each row for each shard, by walking through every slot's block."""
    streams = defaultdict(list)
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    for k, s, t in sorted(rows, key=lambda r: r[0]):
        streams[names.index(s)] += [k] * len(t.split())
    out = Counter()
    for no, b, shard in slots:
        for k in streams[no][b * block : (b + 1) * block]:
            out[k, shard] += 1
    return out


def test_the_draw_decides_what_each_shard_takes(spark):
    """Shards hold equally many slots; the counts of their sources are drawn; the result follows from the slots."""
    rows = [(k, f"s{k % 3}", "w " * (1500 + 37 * k)) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    seen = []
    for mix in (Mix(), Mix(), Mix(seed=18), Mix(shards=1)):
        plan = Plan(Scratch(spark), docs, mix)
        slots = [(r["source_no"], r["block"], r["out_shard"]) for r in plan.slots.collect()]
        sizes = Counter(s for _, _, s in slots)
        assert len(sizes) == mix.shards and max(sizes.values()) - min(sizes.values()) <= 1
        out = mix_documents(Scratch(spark), docs, mix).collect()
        assert {(r["doc_id"], x["out_shard"]): x["words"] for r in out for x in r["shards"]} == dict(by_slots(rows, slots))
        counts = Counter((no, s) for no, _, s in slots)
        seen.append(counts)
        blocks = Counter((no, b) for no, b, _ in slots)
        for r in plan.sources.collect():
            n = sum(c for (no, _), c in counts.items() if no == r["source_no"])
            assert {blocks[r["source_no"], k] for k in range(r["blocks"])} <= {n // r["blocks"], -(-n // r["blocks"])}
            assert abs(n - r["owed"]) <= 4 * (r["owed"] / mix.shards) ** 0.5 + 1
    assert seen[0] == seen[1] != seen[2] and len({c for c in seen[0].values()}) > 5


def test_sizes_and_targets_by_sql(spark):
    """What SQL can say of the mix: sizes, and targets where no source comes to the limit."""
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    out = mix_documents(Scratch(spark), spark.read.parquet(path)).collect()
    sql = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM '{path}'),
    s AS (SELECT source, sum(size) AS n, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY 1)
    SELECT doc_id, size, n, w * (SELECT sum(n) FROM s) / (SELECT sum(w) FROM s), max(w / n) OVER () * (SELECT sum(n) FROM s) / (SELECT sum(w) FROM s) <= 3 FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source"""
    want = {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}
    assert len(out) == len(want) == 200
    free = all(v[3] for v in want.values())
    for r in out:
        size, n, target, _ = want[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size, n) and (not free or abs(r["target"] - target) < 1e-6 * target)


def test_mixed_texts_agree_on_reruns_of_rows_that_differ_in_source_only(spark):
    rows = [(1, "same words " * 40, f"s{k}", f"l{k}") for k in range(6)] + [(None, "x " * 50, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    once, again = (sorted(map(repr, mixed_texts(Scratch(spark), d).collect())) for d in (docs, docs.repartition(3)))
    assert once == again and len({r.split("source=")[1][:5] for r in once}) > 3


def test_permutations_are_permutations():
    for n in (1, 2, 3, 17, 1000):
        for key in (1, 99):
            got = permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(got) == list(range(n))


def test_mix_meets_its_targets(spark, documents, words):
    size = {r["doc_id"]: len(words(r["text"])) for r in documents.collect()}
    out = mix_documents(Scratch(spark), documents).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in documents.collect())
    assert all(r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] for r in out)
    by = defaultdict(list)
    for r in out:
        by[r["source_size"], r["target"]].append(r["taken"])
    for (n, target), taken in by.items():
        assert abs(sum(taken) - target) <= max(64, 0.05 * target) or n < 64
    again = mix_documents(Scratch(spark), documents.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in out)


def test_mixed_texts_hold_the_taken_words(spark, documents, words):
    plain = documents.dropDuplicates(["doc_id", "text"]).select("doc_id", "text", "lang", "source", "n_chars")
    taken = {r["doc_id"]: r["taken"] for r in mix_documents(Scratch(spark), plain).collect()}
    out = mixed_texts(Scratch(spark), plain)
    assert out.columns == plain.columns
    got = Counter()
    for r in out.collect():
        got[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in taken.items() if v} == dict(got)


def test_mix_of_nothing(spark, empty):
    assert mix_documents(Scratch(spark), empty).count() == 0


def test_quick_tokens_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_path())
    encode = tokenizer(tokenizer_path())
    rng = random.Random(2)
    texts = ["", " ", "don't stop", "<|endoftext|> a", "ünï çødé 漢字 🎈", "a" * 5000, "\n\n  \t x", "1234 5,6"]
    texts += ["".join(rng.choice("ab é\n'1<|>漢 ") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    for t in texts:
        assert encode(t).tolist() == exact.encode(t, add_special_tokens=False).ids


def test_packing_holds_every_token_once(spark, documents):
    encode = tokenizer(tokenizer_path())
    pack = Pack()
    out = pack_documents(Scratch(spark), documents, tokenizer_path(), pack).collect()
    places = defaultdict(list)
    got = Counter()
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= pack.capacity
    want = Counter()
    for d in documents.collect():
        ids = np.r_[encode(d["text"]) if d["text"] else np.empty(0, np.uint32), 2].astype("<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert got == want
    sizes = Counter()
    for k, n in want.items():
        sizes[k[3]] += n
    assert len(places) <= lower_bound(sizes, 1024) + 1


def test_packing_of_nothing(spark, empty):
    assert pack_documents(Scratch(spark), empty, tokenizer_path()).count() == 0


def test_completion_beats_or_meets_best_fit():
    assert sum(m for _, m in pack_counts({6: 2, 4: 2, 5: 2, 3: 1, 2: 1}, Pack(capacity=10))) == 4
    for seed in range(20):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(1, 101, 60)
        counts = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True), strict=True)}
        patterns = pack_counts(counts, Pack(capacity=100))
        held = Counter()
        for contents, many in patterns:
            assert sum(s * n for s, n in contents) <= 100
            for s, n in contents:
                held[s] += n * many
        assert held == counts


def fewest(sizes, capacity):
    """The least number of bins, by trying every set of pieces as the next bin."""
    n = len(sizes)
    fits = [sum(sizes[i] for i in range(n) if m >> i & 1) <= capacity for m in range(1 << n)]
    least = [0] + [n] * ((1 << n) - 1)
    for m in range(1, 1 << n):
        low, rest = m & -m, m & ~(m & -m)
        part = rest
        while True:
            if fits[part | low]:
                least[m] = min(least[m], least[rest & ~part] + 1)
            if not part:
                break
            part = (part - 1) & rest
    return least[-1]


def test_completion_equals_exhaustive_search():
    better = 0
    for seed in range(60):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(3, 15, 10).tolist() if seed % 2 else rng.choice([4, 5, 6, 7, 9], 10).tolist()
        counts = dict(Counter(sizes))
        got, want = complete_bins(counts, Pack(capacity=20, nodes=100_000)), fewest(sizes, 20)
        assert got.proved and got.sequences == want >= got.bound
        better += want < sum(m for _, m in best_fit(counts, 20))
    assert better


def test_completion_is_never_above_best_fit_and_tells_its_gap():
    for seed in range(6):
        sizes = np.random.default_rng(seed).integers(200, 690, 400)
        counts = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True), strict=True)}
        got = complete_bins(counts, Pack(nodes=300, rounds=300))
        assert got.bound <= got.sequences <= sum(m for _, m in best_fit(counts, 1024))
        assert got.proved or got.nodes == 300


def test_packing_beats_best_fit_by_far():
    """Two thousand sizes of which nearly three go in a sequence: best fit needs 740, no packing less than 690."""
    rng = np.random.default_rng(1)
    counts = dict(Counter(rng.integers(200, 501, 2000).tolist()))
    got = complete_bins(counts, Pack(nodes=200))
    held = Counter()
    for contents, many in got.patterns:
        assert sum(s * n for s, n in contents) <= 1024
        for s, n in contents:
            held[s] += n * many
    assert held == Counter(counts) and got.sequences == sum(m for _, m in got.patterns) <= 700 and got.bound >= 690
    assert got.sequences == complete_bins(counts, Pack(nodes=200)).sequences


def test_exchanges_keep_every_piece_and_never_lengthen():
    rng, draw = np.random.default_rng(2), random.Random(2)
    for _ in range(20):
        counts = dict(Counter(rng.integers(1, 60, rng.integers(1, 80)).tolist()))
        start = best_fit(counts, 100)
        for new in (completed(counts, 100, draw, 1), completed(counts, 100, draw, 8), improved(start, 100, lower_bound(counts, 100), 200, draw)):
            held = Counter()
            for contents, many in new:
                assert sum(s * n for s, n in contents) <= 100
                for s, n in contents:
                    held[s] += n * many
            assert held == Counter(counts)
        assert lower_bound(counts, 100) <= sum(m for _, m in new) <= sum(m for _, m in start)


def test_undominated_fillings():
    assert list(fillings({5: 1, 3: 1, 2: 1}, 6)) == [(1, ((5, 1),))]  # 3 and 2 together are no more than 5
    assert dominated(((3, 1),), {3: 1, 4: 1}, 1) and not dominated(((3, 1),), {3: 1, 5: 1}, 1)
    assert [f for _, f in fillings({4: 2}, 9)] == [((4, 2),)]


def test_tokens_of_all_texts_equal_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    exact, encode = Tokenizer.from_file(tokenizer_path()), tokenizer(tokenizer_path())
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    for t, e in zip(texts, exact.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(t).tolist() == e.ids


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = dict(components(Scratch(spark), spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)}


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(300):
        v = rng.standard_normal(16)
        rows.append((k, [float(np.float32(x)) for x in v], k % 3 if k % 11 else None))
        if k % 4 == 0:
            rows.append((1000 + k, [float(np.float32(x)) for x in v + 0.08 * rng.standard_normal(16)], k % 3 if k % 11 else None))
        if k % 10 == 0:
            rows += [(2000 + 10 * k + j, rows[-1][1], rows[-1][2]) for j in range(3)]
    rows += [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [float("inf")] + [1.0] * 15, 1), (9005, [1.0, None] + [1.0] * 14, 1), (9006, [], 1), (9007, [1e30] * 16, 1), (9008, [1e-30] * 16, 1)]
    got = {r["vec_id"]: r for r in near_duplicates(Scratch(spark), spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    fine = [(i, np.float32(v).astype(float), c) for i, v, c in rows if c is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    near = defaultdict(set)
    for n, (i, a, c) in enumerate(fine):
        for j, b, d in fine[n + 1 :]:
            if c == d and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                near[i].add(j)
                near[j].add(i)
    assert len(got) == len(rows)
    for i, _, _ in rows:
        assert got[i]["n_links"] == len(near[i])
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[i]["component_id"] == min(seen) and got[i]["kept"] == (i == min(seen))


def link_counts(x, threshold=0.93):
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.concatenate([(x[a : a + 2000] @ x.T >= threshold).sum(axis=1) - 1 for a in range(0, len(x), 2000)])


def test_links_in_a_dense_group_are_counted_in_full(spark):
    rng = np.random.default_rng(6)
    x = (rng.standard_normal(64) + 0.27 * rng.standard_normal((6000, 64))).astype(np.float32)
    want = link_counts(x)
    assert 1000 < np.median(want) < 5900  # many links, but not all to all
    got = near_duplicates(Scratch(spark), spark.createDataFrame([(k, [float(y) for y in v], 1) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int")).toPandas().sort_values("vec_id")
    assert (got["n_links"].to_numpy() == want).all()


def test_links_of_spread_vectors_over_many_blocks(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((10_000, 64))
    x = np.r_[base, base + 0.36 * rng.standard_normal(base.shape)].astype(np.float32)  # pairs near the threshold
    want = link_counts(x)
    got = near_duplicates(Scratch(spark), spark.createDataFrame([(k, [float(y) for y in v], 1) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int")).toPandas().sort_values("vec_id")
    found = got["n_links"].to_numpy()
    assert (found <= want).all() and found.sum() >= 0.998 * want.sum() > 5000


def test_repeated_vector_ids_are_rows_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (None, [0.0, 1.0], 1), (3, None, None)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id bigint, embedding array<float>, label int, rep string, n string")
    got = near_duplicates(Scratch(spark), docs).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (1, 1, 1, True), (None, 1, 1, False), (3, 0, 3, True)], key=key)


def test_embeddings_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert near_duplicates(Scratch(spark), none).count() == 0
    dull = spark.createDataFrame([(1, None, 1), (2, [1.0], None)], "vec_id bigint, embedding array<float>, label int")
    assert sorted(map(tuple, near_duplicates(Scratch(spark), dull).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."


def wrapped(text, width):
    import textwrap

    return "\n".join(textwrap.wrap(text, width))


def test_licences_are_named_and_others_not(spark):
    model = licenses.train()
    assert model.held_out > 0.97
    cases = {
        "Released under the MIT License.": ["MIT"],
        "made available under the MIT license": ["MIT"],
        "distributed under the terms of the Apache License 2.0": ["Apache-2.0"],
        "SPDX-License-Identifier: MIT": ["MIT"],
        "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0"],
        "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"],
        "This is not licensed under the MIT License.": [],
        "A history of the Apache License, Version 2.0 and its authors.": [],
        "All rights reserved.": [],
        "the license of the driver\nwas released under the bridge": [],
        "Prose first.\nLICENSED UNDER THE MIT LICENCE!\nLicensed under CC BY-NC 4.0.\nMore prose.": ["CC-BY-NC-4.0", "MIT"],
    }
    for width in (35, 50, 70, 80, 500):
        cases["Some prose.\n\n" + wrapped(GPL, width) + "\n\nMore of it."] = ["GPL-2.0"]
        cases[wrapped(GPL.replace("version 2", "version 3").replace("General", "Affero General"), width)] = ["AGPL-3.0"]
        cases[wrapped(licenses.NOTICES["MIT"][0], width)] = ["MIT"]
    rows = list(enumerate(cases)) + [(900, None), (901, ""), (902, "Released under the MIT License.\n\nReleased under the MIT License."), (902, "x"), (None, "word " * 200_000 + "\n\nReleased under the MIT License.")]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id bigint, text string, blocks string, named string")
    out = licenses.scan_licenses(docs).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r for r in out if r["doc_id"] != 902}
    for k, want in enumerate(cases.values()):
        assert got[k]["licenses"] == want, list(cases)[k]
    assert got[900]["n_paragraphs"] == got[901]["n_paragraphs"] == 0
    assert sorted((r["n_paragraphs"], r["n_licensed"]) for r in out if r["doc_id"] == 902) == [(1, 0), (2, 2)]
    assert got[None]["licenses"] == ["MIT"] and got[None]["n_paragraphs"] == 2
    assert licenses.scan_licenses(docs.where("doc_id < 0")).count() == 0


def test_no_paragraph_without_an_anchor_holds_a_template():
    model = licenses.train()
    for _, grams, need in model.templates:
        assert len([g for g in grams if not set(g.split()) & set(model.anchors)]) < need


def brute_losses(rows, good, prior=1000.0, shared=5000.0):
    """Losses of each text by the definition, from counts of all other texts."""
    words = [(t or "").split() for _, t in rows]
    flags = [i in good for i, _ in rows]
    every = Counter(w for x in words for w in x)
    total = sum(every.values())
    n_target = sum(len(x) for x, f in zip(words, flags, strict=True) if f)
    out = {}
    for k, own in enumerate(words):
        losses = []
        for background in (False, True):
            grow = (n_target / total if n_target else 1.0) if background else 1.0
            others = [x for j, x in enumerate(words) if j != k and (background or flags[j])]
            single, pair = Counter(), Counter()
            for x in others:
                single.update(x)
                if x:
                    single[None] += 1
                    pair.update(zip([None, *x], x, strict=False))
            size = sum(len(x) for x in others) * grow
            loss = 0.0
            for v, w in zip([None, *own], own, strict=False):
                p = (single[w] * grow + shared * every[w] / total) / (size + shared)
                loss -= math.log((pair[v, w] * grow + prior * p) / (single[v] * grow + prior))
            losses.append(loss / len(own) if own else None)
        out[rows[k][0]] = losses
    return out


@pytest.mark.parametrize("few", [0, 4_000_000])
def test_losses_equal_brute_force(spark, few):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(rng.randint(0, 40)))) for k in range(60)] + [(100, None), (101, "rare words here"), (102, "rare words here"), (103, "a b " * 3000)]
    labels = [(k, int(k % 3 == 0), 0) for k in range(40)]
    want = brute_losses(rows, {k for k, q, _ in labels if q})
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, target string")
    for r in score_documents(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), Language(few_targets=few)).collect():
        a, b = want[r["doc_id"]]
        if a is None:
            assert r["target_loss"] is r["score"] is None
        else:
            assert abs(r["target_loss"] - a) < 1e-5 and abs(r["background_loss"] - b) < 1e-5 and abs(r["score"] - a + b) < 1e-5


def test_scores_tell_held_out_documents_apart(spark):
    rng = random.Random(5)
    good, bad = [f"g{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    shared = [f"c{i}" for i in range(60)]
    rows, labels = [], []
    for k in range(300):
        own = good if k % 2 else bad
        rows.append((k, " ".join(rng.choice(own if rng.random() < 0.4 else shared) for _ in range(80))))
        if k < 150:
            labels.append((k, k % 2, 0))
    rows += [(900, None), (901, "  "), (902, "one")]
    out = {r["doc_id"]: r for r in score_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([*labels, (1, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")).collect()}
    held = [k for k in range(150, 300)]
    assert sum(out[k]["preferred"] == bool(k % 2) for k in held) >= 0.95 * len(held)
    assert out[900]["score"] is None and not out[901]["preferred"] and out[902]["n_tokens"] == 1


def test_scores_without_rows_or_labels(spark):
    docs, labels = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert score_documents(docs, labels).count() == 1
    assert score_documents(docs.where("doc_id > 1"), labels).count() == 0


def test_null_ids_repeated_rows_and_a_very_long_text(spark):
    """Every operator on documents gives each row its result, whatever its id."""
    from windrift.llm.quality import quality_rules
    from windrift.llm.recompression import remove_repeats

    rng = random.Random(11)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    rows = [(None, "one two three"), (None, "one two three"), (None, None), (7, ""), (7, ""), (8, long), (9, "four " * 12)]
    docs = spark.createDataFrame([(*r, "s", "x", "y") for r in rows], "doc_id bigint, text string, source string, length string, slot string")
    labels = spark.createDataFrame([(8, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    key = lambda r: (r["doc_id"] is None, r["doc_id"])
    ids = sorted(((i is None, i) for i, _ in rows), key=repr)
    for out in (shard_documents(Scratch(spark), docs, 3), mix_documents(Scratch(spark), docs), score_documents(docs, labels), quality_rules(docs), remove_repeats(Scratch(spark), docs), licenses.scan_licenses(docs)):
        assert sorted(map(key, out.collect()), key=repr) == ids
    pieces = pack_documents(Scratch(spark), docs, tokenizer_path()).collect()
    assert sorted((key(r) for r in pieces if r["piece"] == 0), key=repr) == ids
    whole = [r for r in pieces if r["doc_id"] == 8]
    assert sum(r["length"] for r in whole) == len(tokenizer(tokenizer_path())(long)) + 1 and {r["length"] for r in whole if r["piece"]} == {1024}
