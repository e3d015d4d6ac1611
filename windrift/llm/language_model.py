"""Language-model scoring by cross-entropy difference.

Two word bigram models, of the target documents and of all documents, share one vocabulary (every
word of the corpus), order and smoothing. A document's score is its loss under the target model
minus its loss under the background model, per token: the lower, the more it is like the target.

All words and word pairs of the corpus count, however rare: each block of documents asks the corpus
for the counts of its own words and pairs, so what is gathered grows with the input and no task
holds a model. Every document is scored by models that have not seen it: its own counts are taken
off, from the background always, from the target if it trained it.

P(w | v) = (c(v, w) + m p(w)) / (c(v) + m) and p(w) = (c(w) + s q(w)) / (N + s), where q(w) is the
share of w among all words of the corpus, the same in both models. A text's end is an event too, so
the words that can follow v share what it leaves. The background's counts are scaled to the size of
the target, so that neither model is the surer for having read more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrift.llm.common import Scratch, arrow_schema, record
from windrift.llm.tallies import ask
from windrift.llm.words import Words, mix


@dataclass(frozen=True)
class Language:
    prior: float = 1000.0  # m: weight of the unigram model; rare pairs count too, so it is large
    shared: float = 5000.0  # s: words' worth of the distribution of all words in either unigram model
    few_targets: int = 4_000_000  # up to so many target ids, they are sent to every task


#: Names of what is no word: the start of a text, and the sum of all words.
START, ALL = np.uint64(0x5DEECE66D1CE4E5B), np.uint64(0x2545F4914F6CDD1D)
PAIR = np.uint64(0xD1342543DE82EF95)


def grouped(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each row, a row of each group, size of each group) for rows equal in text and key."""
    name = mix(key ^ mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(name)
    sorted_ = name[order]
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]][: len(name)])
    group, sizes = np.empty(len(name), np.int64), np.diff(np.r_[first, len(name)])
    group[order] = np.repeat(np.arange(len(first)), sizes)
    return group, order[first], sizes


def score_documents(docs: DataFrame, labels: DataFrame, language: Language = Language(), target=None) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score, preferred for each row of docs.

    target: a condition on labels (default quality = 1); the rows of docs with a label that meets
    it train the target model, all rows the background model. preferred: score < 0. Texts without
    words have null losses and are not preferred; without any target both models are alike but for
    smoothing. A doc_id that is labelled twice counts as target if any of its labels is. Rows that
    repeat are documents of their own, each seen by the other's models.
    """
    scratch = Scratch(docs.sparkSession)
    target = F.col("quality") == 1 if target is None else target
    wanted_ids = labels.where(target & F.col("doc_id").isNotNull()).select("doc_id").distinct().withColumn("target", F.lit(True))
    # The ids of the target grow with the corpus: texts stay in place while they are few, and are joined beyond.
    wanted_ids = scratch.save(wanted_ids)
    few = wanted_ids.count() <= language.few_targets
    marked = docs.select("doc_id", "text").join(F.broadcast(wanted_ids) if few else wanted_ids.hint("merge"), "doc_id", "left")
    marked = marked if few else scratch.save(marked)  # it is read twice, in one order
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("target_loss", "background_loss", "score")), T.StructField("preferred", T.BooleanType())])
    wanted = arrow_schema(schema)
    m, s = language.prior, language.shared

    def build(b):
        w = Words(b.column("text"))
        text = w.text_index()
        is_target = b.column("target").fill_null(False).to_numpy(zero_copy_only=False)
        before = np.r_[START, w.hashes[:-1]][: w.n]
        heads = w.bounds[:-1][w.counts > 0]
        before[heads] = START
        pair = mix(before * PAIR + w.hashes)
        word_of, word_at, word_n = grouped(text, w.hashes)
        _, pair_at, pair_n = grouped(text, pair)
        # The context of a pair: the word before it, or the start, which stands after the words among the keys.
        context_of = np.r_[len(word_n), word_of[:-1]][: w.n]
        context_of[heads] = len(word_n)
        keys = np.r_[w.hashes[word_at], START, ALL, pair[pair_at]]
        own = np.r_[word_n, len(heads), w.n, pair_n]
        of_target = np.r_[np.where(is_target[text[word_at]], word_n, 0), is_target[w.counts > 0].sum(), w.counts[is_target].sum(), np.where(is_target[text[pair_at]], pair_n, 0)]
        return keys, np.stack([of_target, own], axis=1).astype(np.uint32), (w.counts, is_target, text[pair_at], word_n, word_of[pair_at], context_of[pair_at], pair_n)

    def finish(b, arrays, values):
        words, is_target, text, word_n, word, context, pair_n = arrays
        of_word, everything, of_pair = values[: len(word_n) + 1], values[len(word_n) + 1], values[len(word_n) + 2 :]
        word_n = np.r_[word_n, 1]  # a text starts once
        all_target, all_words = float(everything[0]), float(everything[1])
        q = of_word[word, 1] / max(all_words, 1.0)
        loss = np.zeros((2, len(words)))
        for k in range(2):
            own = is_target[text] | bool(k)  # where the document's own counts are part of the model's
            grow = (all_target / all_words if all_target else 1.0) if k else 1.0
            others = lambda counts, mine: np.maximum(counts[:, k] - np.where(own, mine, 0), 0) * grow  # noqa: B023, E731
            total = np.maximum(everything[k] - np.where(own, words[text], 0), 0) * grow
            p = (others(of_word[word], word_n[word]) + s * q) / (total + s)
            chance = (others(of_pair, pair_n) + m * p) / (others(of_word[context], word_n[context]) + m)
            loss[k] = np.bincount(text, -np.log(chance) * pair_n, minlength=len(words))
        empty = words == 0
        loss /= np.maximum(words, 1)
        score = loss[0] - loss[1]
        yield record(wanted, doc_id=b.column("doc_id"), n_tokens=words.astype(np.int64), target_loss=pa.array(loss[0], mask=empty), background_loss=pa.array(loss[1], mask=empty), score=pa.array(score, mask=empty), preferred=(score < 0) & ~empty)

    return ask(scratch, marked, build, finish, schema, lambda sums: sums, tallies=2, answers=2, again=True)
