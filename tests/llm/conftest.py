import random
import re

import pytest

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="session")
def words():
    return words_of


@pytest.fixture(scope="session")
def documents(spark):
    """A hard little table: nulls, empty and long texts, copies, near copies, shared passages, repeated rows, clashing columns."""
    rng = random.Random(8)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, hot = say(60), say(40)
    rows = [(1, None, "en", None, 0), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 3), (4, "one", None, "b", 3), (5, "a " * 300, "en", "b", 600), (6, " x y z", "en", "b", 6)]
    for k in range(10, 60):
        w = say(rng.randint(3, 160))
        if k % 5 == 0:
            w = w + passage + say(5)
        if k % 3 == 0:
            w = hot + w
        rows.append((k, (" " if k % 2 else "\n").join(w), "en", f"s{k % 4}", 1))
    base = say(300)
    for k in range(60, 75):
        w = list(base)
        w[(k * 13) % 300] = f"edit{k}"
        rows.append((k, " ".join(w), "fr", "hot", 1))
    rows += [(k, " ".join(base), "fr", "hot", 1) for k in range(75, 95)]
    rows += [rows[-1], rows[20]]  # rows equal in everything
    rows.append((200, " ".join(say(6000)), "de", "long", 1))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, places string, size string, uid string, at string"
    return spark.createDataFrame([(*r, "p", "q", "r", "t") for r in rows], schema)


@pytest.fixture(scope="session")
def empty(documents):
    return documents.where("doc_id < 0")
