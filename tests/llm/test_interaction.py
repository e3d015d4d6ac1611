"""The filter interaction audit against a walk through every order of the filters."""

from itertools import permutations

from windrift.llm.common import Scratch
from windrift.llm.interaction import filter_interactions

LABELS = "doc_id bigint, quality int, toxic int, text string"


def by_walking(rows, labels, words_of):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = words_of(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and first.get(t, i) < i}
        docs.append((i, lang or "", frozenset(k for k, v in fails.items() if v)))
    out = {}
    for part in {p for _, p, _ in docs}:
        own = [d for d in docs if d[1] == part]
        shares = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = own
            for k, c in enumerate(order):
                removed = [d for d in left if c in d[2]]
                before = set(order[:k])
                redundant = sum(c in d[2] and bool(d[2] & before) for d in own)
                left = [d for d in left if c not in d[2]]
                shares[c] += len(removed)
                steps.append(("".join(order), k + 1, c, len(left), len(removed), redundant, sum(d[2] == {c} for d in own), sum(d[0] in good for d in removed), sum(d[0] in toxic for d in removed)))
        for order, k, c, *rest in steps:
            out[part, order, k] = (*rest, shares[c])
    return out


def result(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def test_every_order_is_walked(spark, documents, words):
    more = [(300, "A B C # d", None, "s", 1), (301, "A B C # d", "", "s", 1), (None, "A B C # d", "en", "s", 1), (None, None, "en", "s", 1), (302, " ".join(f"w{i} É" for i in range(150)), "en", "s", 1), (303, "x " * 250 + "$", "fr", "s", 1)]
    docs = documents.unionByName(spark.createDataFrame([(*r, "p", "q", "r", "t") for r in more], documents.schema)).withColumnsRenamed({"places": "mask", "size": "part", "uid": "digest", "at": "n"})
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(1, 90)] + [(301, None, 1), (301, 1, None), (None, 1, 1), (10**6, 1, 1)]
    table = spark.createDataFrame([(*r, "t") for r in labels], LABELS)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    labels = [(i, q, t) for i, q, t in labels if i is not None]
    got = result(filter_interactions(Scratch(spark), docs, table))
    assert got == by_walking(rows, labels, words)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_without_labels_or_documents(spark, documents, empty):
    none = spark.createDataFrame([], LABELS)
    got = result(filter_interactions(Scratch(spark), documents, none))
    assert got and all(v[4] == v[5] == 0 for v in got.values())
    assert filter_interactions(Scratch(spark), empty, none).count() == 0
