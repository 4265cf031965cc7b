"""Subjects of documents by a sentence-level latent Dirichlet topic model.

Topics are word distributions, a document is a mixture of topics, and all words of a sentence share one. The model is
fitted by distributed expectation-maximisation: a task adds up the expected counts of its documents, the sums over all
tasks make the next topics. The first rounds run over the labelled documents, whose subjects are the prior of their
mixture; the following ones run over every document. Then the topics' top terms are looked up among the labelled documents,
which names each topic's subject, and a document's subjects are those with enough of its sentences.

Words are hashed to a fixed number of columns, so the model's size is bounded whatever the corpus holds (VOCABULARY x topics
floats), and no word is left out.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import constant_map
from ..session import spread, written
from .sentences import sentence_spans

#: Columns of the hashed vocabulary; labelled documents the fit starts from, at most; rounds over these, and over all.
VOCABULARY, MAX_LABELLED, LABELLED_ROUNDS, ROUNDS = 1 << 17, 20_000, 4, 1
#: Topics of each subject; rounds of topics that start at random.
TOPICS, RANDOM_ROUNDS = 1, 20
#: Smoothing of topics and mixtures; share of the mixture that a label's subjects are expected to have.
BETA, ALPHA, LABEL_SHARE = 0.02, 0.3, 0.9
#: Posterior from which a sentence of a document without labels counts towards the topics.
SURE = 0.8
#: Occurrences from which a word counts as known; weight of all labelled documents' counts beside those of all documents.
RARE, ANCHOR = 2.0, 10.0

_MARKUP = regex.compile(r"<[/!]?\p{L}[^<>]{0,500}>|&\p{L}{2,8};|https?://\S+")
_TILDE = regex.compile(r"(?<=[一-鿿])[~～]")
_WORD = regex.compile(r"[\p{Latin}\p{M}]{3,}|[\p{Cyrillic}\p{Greek}\p{Arabic}\p{Devanagari}\p{Thai}\p{Hangul}\p{M}]{2,}")


@lru_cache(maxsize=200_000)
def _hashed(word: str) -> int:
    return zlib.crc32(word.encode()) % VOCABULARY


def featurise(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of all sentences of a text, and how many there are in each sentence."""
    if not text or not text.strip():
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    text = unicodedata.normalize("NFKC", text)
    text = _TILDE.sub("。", _MARKUP.sub(lambda m: " " * len(m.group()), text))
    spans = sentence_spans(text)
    if not spans:
        return np.zeros(0, np.int32), np.zeros(1, np.int32)
    starts = np.array([s for s, _ in spans])
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    han = (points >= 0x4E00) & (points <= 0x9FFF)
    at = np.flatnonzero(han[:-1] & han[1:])
    ids = ((points[at] * 0x9E3779B1 + points[at + 1] * 0x85EBCA77) >> 7) % VOCABULARY
    words = [(m.start(), _hashed(m.group().lower())) for m in _WORD.finditer(text)]
    if words:
        at = np.concatenate([at, [p for p, _ in words]])
        ids = np.concatenate([ids, [i for _, i in words]])
        order = np.argsort(at, kind="stable")
        at, ids = at[order], ids[order]
    sentence = np.searchsorted(starts, at, side="right") - 1
    keep = sentence >= 0
    sizes = np.bincount(sentence[keep], minlength=len(spans)).astype(np.int32)
    # headings' numbers, emoji and the like between the sentences are no sentences
    return ids[keep].astype(np.int32), sizes[sizes > 0] if sizes.any() else sizes[:1]


class _Docs:
    """The documents of one Arrow batch as flat arrays."""

    def __init__(self, words: pa.ListArray, sizes: pa.ListArray):
        self.words = words.flatten().to_numpy(zero_copy_only=False)
        self.sizes = sizes.flatten().to_numpy(zero_copy_only=False)
        per_doc = np.diff(sizes.offsets.to_numpy())
        self.doc = np.repeat(np.arange(len(per_doc)), per_doc)
        self.n_docs = len(per_doc)
        self.n_sentences = per_doc
        self.sentence = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def posterior(self, log_topics: np.ndarray, prior: np.ndarray, rounds: int = 3) -> np.ndarray:
        """P(topic | sentence); prior: of each document's mixture, as pseudo-counts."""
        k = log_topics.shape[1]
        likelihood = np.zeros((len(self.sizes), k))
        filled = np.flatnonzero(self.sizes)
        if len(filled):
            starts = (np.cumsum(self.sizes) - self.sizes)[filled]
            likelihood[filled] = np.add.reduceat(log_topics[self.words].astype(np.float64), starts, axis=0)
        mixture = prior / prior.sum(1, keepdims=True)
        for _ in range(rounds):
            p = likelihood + np.log(mixture)[self.doc]
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            counts = np.stack([np.bincount(self.doc, p[:, j], self.n_docs) for j in range(k)], 1)
            mixture = (counts + prior) / (counts + prior).sum(1, keepdims=True)
        return p


def _topics(counts: np.ndarray) -> np.ndarray:
    """Log probability of each word in each topic, weighted by how much the word tells topics apart.

    The weight is 1 less the relative entropy of P(topic | word): words of sentence patterns, alike in all topics, count for
    nothing, whatever the topics' share of the language they belong to; rare words count little.
    """
    smooth = counts + BETA * counts.sum() / counts.size + 1e-9
    p = smooth / smooth.sum(0, keepdims=True)
    even = counts / (counts.sum(0, keepdims=True) + 1e-9) * counts.sum() / counts.shape[1]
    of_word = (even + RARE / counts.shape[1]) / (even.sum(1, keepdims=True) + RARE)
    entropy = -(of_word * np.log(of_word)).sum(1, keepdims=True) / np.log(counts.shape[1])
    weighted = np.log(p) - np.log(p).mean(1, keepdims=True)
    return (weighted * (1 - entropy)).astype(np.float32)


def _round(docs: DataFrame, log_topics: np.ndarray, seeds: np.ndarray, scatter: bool = False, sure: float = SURE) -> np.ndarray:
    """One round of expectation-maximisation over (words, sizes, labels) rows: expected counts of each word in each topic.

    seeds: the subject that each topic was started from; labels: a document's subjects, which its mixture is expected to be of,
    or empty. scatter: of a subject's topics, expect one only, by the document's words, so that they begin to differ. sure: the
    posterior from which sentences of documents without labels count.
    """
    k = log_topics.shape[1]
    per_subject = k // (int(seeds.max()) + 1)
    model = docs.sparkSession.sparkContext.broadcast(log_topics)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics = model.value
        counts = np.zeros((VOCABULARY, k))
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                d = _Docs(batch.column(0), batch.column(1))
                if not len(d.sizes):
                    continue
                prior = np.full((d.n_docs, k), ALPHA)
                labels = batch.column(2).to_pylist()
                free = np.array([not x for x in labels])
                for i in np.flatnonzero(~free):
                    own = np.isin(seeds, labels[i])
                    if scatter:
                        words = batch.column(0)[i].values.to_numpy(zero_copy_only=False)
                        own &= np.arange(k) % per_subject == (int(words.min()) if len(words) else 0) % per_subject
                    expected = 20.0 * max(1, d.n_sentences[i])
                    prior[i] = expected * np.where(own, LABEL_SHARE / max(1, own.sum()), (1 - LABEL_SHARE) / max(1, k - own.sum()))
                p = d.posterior(topics, prior)
                # topics of one subject share what is sure of it
                best = np.zeros((len(p), seeds.max() + 1))
                np.add.at(best.T, seeds, p.T)
                p[free[d.doc] & (best.max(1) < sure)] = 0.0
                flat = p[d.sentence]
                for j in range(k):
                    counts[:, j] += np.bincount(d.words, flat[:, j], VOCABULARY)
        used = np.flatnonzero(counts.sum(1) > 1e-6)
        for part in np.array_split(used, max(1, len(used) // 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(counts[part, j]) for j in range(k))], ["word", *(f"t{j}" for j in range(k))])

    schema = "word int, " + ", ".join(f"t{j} double" for j in range(k))
    sums = docs.select("words", "sizes", "labels").mapInArrow(run, schema).groupBy("word").agg(*(F.sum(f"t{j}").alias(f"t{j}") for j in range(k))).toPandas()
    model.unpersist()
    counts = np.zeros((VOCABULARY, k))
    counts[sums["word"].to_numpy()] = sums.drop(columns="word").to_numpy()
    return counts


def name_topics(counts: np.ndarray, labelled: np.ndarray, top: int = 200) -> np.ndarray:
    """Each topic's subject: that in whose labelled documents its top terms (by lift over all topics) are most over-represented."""
    p = (counts + 1e-9) / (counts.sum(0, keepdims=True) + 1e-6)
    lift = p * np.log(p / p.mean(1, keepdims=True))
    share = (labelled + 0.01) / (labelled + 0.01).sum(0, keepdims=True)
    share /= share.sum(1, keepdims=True)
    names = []
    for j in range(counts.shape[1]):
        best = np.argpartition(-lift[:, j], top)[:top]
        names.append(int((lift[best, j][:, None] * share[best]).sum(0).argmax()))
    return np.array(names)


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", text: str = "text", rest: str = "other", least: float = 1 / 3, max_labelled: int = MAX_LABELLED, topics: int = TOPICS, seeded: bool = True) -> DataFrame:
    """(doc_id, subject, share) of every document with text: each subject with at least `least` of its sentences, else `rest`.

    labels: (doc_id, subject) rows, repeated ones count once, those of unknown subjects or documents not at all; the
    documents of at most `max_labelled` of them (by hash) start the fit. Without any labels every document is `rest`.
    topics: of each subject. seeded: start topics from the labelled documents; else from random ones, so that labels only name
    the topics that the corpus gives. Null and blank texts have no row. Documents of one key are each assigned for themselves.
    """
    names = sorted(r.subject for r in subjects.select("subject").filter("subject is not null").distinct().collect())
    if rest not in names:
        names.append(rest)
    k = len(names)
    seeds = np.repeat(np.arange(k), topics)
    source = spread(documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).filter("text is not null"), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                ids, words, sizes = [], [], []
                for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    w, s = featurise(x)
                    if len(s):
                        ids.append(i)
                        words.append(w)
                        sizes.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(words, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))], ["doc_id", "words", "sizes"])

    id_type = source.schema["doc_id"].dataType.simpleString()
    docs = written(source.mapInArrow(features, f"doc_id {id_type}, words array<int>, sizes array<int>"), "subjects-words")

    number = constant_map({n: i for i, n in enumerate(names)}, "map<string,int>")
    known = labels.select("doc_id", F.try_element_at(number, F.lower(F.trim("subject"))).alias("s")).filter("s is not null and doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("s")).alias("labels"))
    n_labelled = known.count()
    if n_labelled > max_labelled:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n_labelled))
    known = F.broadcast(known)  # of about max_labelled rows at most
    labelled = written(docs.join(known, "doc_id"), "subjects-labelled")

    uniform = np.full((VOCABULARY, k * topics), 1.0)
    counts = _round(labelled, _topics(uniform), seeds, scatter=topics > 1)
    if not counts.any():
        return docs.select("doc_id", F.lit(rest).alias("subject"), F.lit(1.0).alias("share"))
    # what the labels say of each word, by which topics are named
    of_subject = counts.reshape(VOCABULARY, k, topics).sum(2)
    everything = docs.join(known, "doc_id", "left").select("words", "sizes", F.coalesce("labels", F.array().cast("array<int>")).alias("labels"))
    evidence = counts
    for _ in range(LABELLED_ROUNDS - 1 if seeded else 0):
        evidence = counts = _round(labelled, _topics(counts), seeds)
    for _ in range(ROUNDS if seeded else 0):
        found = _round(everything, _topics(counts), seeds)
        counts = found + ANCHOR * found.sum() / evidence.sum() * evidence
    if not seeded:
        free = everything.withColumn("labels", F.array().cast("array<int>"))
        counts = np.random.default_rng(7).gamma(0.1, 1.0, counts.shape)
        for _ in range(RANDOM_ROUNDS):
            counts = _round(free, _topics(counts), seeds, sure=0.0)
    subject_of = name_topics(counts, of_subject)
    model = documents.sparkSession.sparkContext.broadcast((_topics(counts), subject_of))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_topics, subject = model.value
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                d = _Docs(batch.column(1), batch.column(2))
                if not d.n_docs:
                    continue
                p = d.posterior(log_topics, np.full((d.n_docs, log_topics.shape[1]), ALPHA))
                of_sentence = np.zeros((len(p), k))
                np.add.at(of_sentence.T, subject, p.T)
                best = of_sentence.argmax(1)
                best[d.sizes == 0] = names.index(rest)
                share = np.zeros((d.n_docs, k))
                np.add.at(share, (d.doc, best), 1.0)
                share /= np.maximum(1, d.n_sentences)[:, None]
                named = share + 1e-9 >= least
                named[:, names.index(rest)] = False
                named[~named.any(1), names.index(rest)] = True
                at, which = np.nonzero(named)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([names[j] for j in which], pa.string()), pa.array(share[at, which])], ["doc_id", "subject", "share"])

    return docs.mapInArrow(assign, f"doc_id {id_type}, subject string, share double")
