"""Subject areas of documents by seeded non-negative factorisation.

The term matrix has one row per distinct sentence and label set, its entries weighted by how often
the sentence occurs; it is factored by alternating multiplicative updates into sentence weights and
term components. Each subject has one anchored component, seeded from the labelled documents and the
subject's description and kept near its seed by a prior; one further component takes the general
talk. Sentences of labelled documents may use only their subjects and the general component.
Components have a fixed number of hashed terms, so they are small whatever the corpus.

Defined cases: NULL and blank documents give no rows; documents without a subject-bearing sentence
give none; labels of unknown documents and subjects are not used; without any label the descriptions
alone seed the components; repeated documents are judged alike; texts are read whole.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from . import languages

TERMS = 1 << 16
ROUNDS, INNER = 3, 8
#: How often the anchors are taken anew, from all documents by the components so far.
BOOTS = 2
#: Sentences, and share of the subject-bearing ones, from which an unlabelled document counts for an anchor.
SURE_SENTENCES, SURE_SHARE = 2, 0.3
#: N-grams, and margin per n-gram, from which a labelled document is clearly in a language.
TONGUE_GRAMS, TONGUE_MARGIN = 200, 0.25
#: How much more often than elsewhere an anchor is said in its subject's documents.
LIFT = 2.0
#: Start weight of a subject that a labelled document does not have: a passing sentence.
OUTSIDE = 0.02
#: Weight of a component's seed against what the updates gather.
PRIOR = 0.2
#: Weight share from which a sentence is about a subject.
ABOUT = 0.5
#: Share of the subject-bearing sentences from which a document is about a subject.
SHARE = 0.2

_TAGS = re.compile(r"<[^>\n]{1,60}>|\\boxed\{[^}]*\}|https?://\S+")
_LEAD = re.compile(r"^[\W\d_]*(?:(?:step|schritt|étape|paso|reader|chair|entry|day|note|[a-zé]+)\s*[\d.]*[a-z]?\s*:\s+)?(?:[\d.]+[.)]?\s+)?", re.I)
_BREAK = re.compile(r"(?<=[.!?])[\"'”*_)\]]*\s+|[\r\n]+|(?<=[。！？])")
_NAME = re.compile(r"(?<=[^\W\d_A-Z] )[A-ZÀ-Þ][\w'’]*(?: [A-ZÀ-Þ][\w'’]*)*(?=[ .,;:?!]|$)")
_GERMAN = re.compile(r"\b(?:der|die|das|und|den|dem|ein|eine|im|am|zu|von|bei|nicht|ist)\b")
_WORD = re.compile(r"[^\W\d_]{2,}")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text with names and numbers left out, so that equal talk is equal."""
    if not text or not text.strip():
        return []
    plain = _TAGS.sub("\n", html.unescape(text))
    out = []
    for s in _BREAK.split(plain):
        s = _LEAD.sub("", s, count=1)
        if not _GERMAN.search(s):  # German nouns are capitals too
            s = _NAME.sub(" ", s)
        words = _WORD.findall(s.lower())
        if len(words) >= 3:
            out.append(" ".join(words))
    return out


def terms(sentence: str) -> np.ndarray:
    """Hashed words and word pairs of a sentence, each once."""
    words = sentence.split(" ")
    return np.unique(np.fromiter((zlib.crc32(t.encode()) & (TERMS - 1) for t in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]), np.int64))


def _weights(columns: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Non-negative weights of the components for one sentence; columns: components x its terms."""
    w = allowed / allowed.sum()
    for _ in range(INNER):
        mix = w @ columns
        w = w * (columns @ (1.0 / np.maximum(mix, 1e-12)))
        total = w.sum()
        if total <= 0:
            return np.zeros_like(w)
        w = w / total
    return w


def _sentence_subject(sentence: str, components: np.ndarray) -> int:
    """The subject a sentence is about, -1 for general talk."""
    w = _weights(components[:, terms(sentence)], np.ones(len(components)))
    return int(w[:-1].argmax()) if w[:-1].max() >= ABOUT else -1


class _Judge:
    """Sentence subjects with a cache; equal talk is common."""

    def __init__(self, components: np.ndarray, size: int = 200_000):
        self.components, self.size, self.known = components, size, {}

    def __call__(self, sentence: str) -> int:
        c = self.known.get(sentence)
        if c is None:
            c = _sentence_subject(sentence, self.components)
            if len(self.known) < self.size:
                self.known[sentence] = c
        return c


def _bits(mask: str | None) -> tuple[int, ...]:
    """The subjects of a mask: their numbers with commas, after a minus sign if they are inferred; "" for none."""
    return tuple(int(x) for x in (mask or "").lstrip("-").split(",") if x)


def _masked(documents: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(text, mask): the numbers of each document's labelled subjects, "" without any."""
    number = F.create_map(*[F.lit(x) for i, s in enumerate(subjects) for x in (s, i)])
    masks = labels.filter(F.col("subject").isin(subjects)).select("doc_id", number[F.col("subject")].alias("b")).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("b")).cast("array<string>"), ",").alias("mask"))
    return spread(documents.select("doc_id", "text")).join(masks, "doc_id", "left").select("text", F.coalesce("mask", F.lit("")).alias("mask"))


def _labelled_tongues(masked: DataFrame) -> list[int]:
    """The languages that some labelled document is clearly in; a subject is learnt per language from labels only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = languages.model()
        for b in batches:
            scores, grams = languages.posteriors([" ".join(sentences(t)) for t in b.column(0).to_pylist()], logp)
            top = np.sort(scores, axis=1)
            clear = (top[:, -1] - top[:, -2] > TONGUE_MARGIN * grams) & (grams >= TONGUE_GRAMS) if len(grams) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(scores.argmax(axis=1)[clear]), pa.int32())], names=["tongue"])

    return sorted(r["tongue"] for r in masked.filter("mask <> ''").mapInArrow(run, "tongue int").distinct().collect())  # at most one per language


def _rows(masked: DataFrame, components: np.ndarray | None, tongues: list[int]) -> DataFrame:
    """(sentence, mask, tongue, n): distinct sentences with the subjects and the language of their documents.

    Documents without labels get, from the components so far, an inferred mask of the
    subjects their sentences are mostly about: evidence for the anchors, but no constraint.
    """
    sent = None if components is None else masked.sparkSession.sparkContext.broadcast(components)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = sent and _Judge(sent.value)
        logp = languages.model()
        # equal sentences are summed inside the batch before anything is exchanged
        for b in batches:
            seen: Counter = Counter()
            split = [sentences(t) for t in b.column(0).to_pylist()]
            scores = languages.posteriors([" ".join(own) for own in split], logp)[0] if split else np.empty((0, len(logp)))
            for own, m, tongue in zip(split, b.column(1).to_pylist(), np.take(tongues, scores[:, tongues].argmax(axis=1))):
                if judge and not m:
                    about = Counter(c for c in map(judge, own) if c >= 0)
                    sure = sorted(c for c, n in about.items() if n >= SURE_SENTENCES and n >= SURE_SHARE * sum(about.values()))
                    m = "-" + ",".join(map(str, sure)) if sure else ""
                seen.update((s, m, int(tongue)) for s in own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in seen], pa.string()), pa.array([x[1] for x in seen], pa.string()), pa.array([x[2] for x in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())],
                names=["sentence", "mask", "tongue", "n"],
            )

    return masked.mapInArrow(run, "sentence string, mask string, tongue int, n bigint").groupBy("sentence", "mask", "tongue").agg(F.sum("n").alias("n"))


def _gather(rows: DataFrame, width: int, of_row) -> tuple[np.ndarray, np.ndarray]:
    """(cell, sum) of the sum over the rows (sentence, mask, tongue, n) of n times of_row(terms, mask, tongue), which gives
    (first line, lines x terms); at most width x TERMS sums are collected, line by line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, TERMS))
        for b in batches:
            for s, m, g, n in zip(*(b.column(i).to_pylist() for i in range(4))):
                t = terms(s)
                at, values = of_row(t, m, g)
                total[at : at + len(values), t] += n * values
        i, j = np.nonzero(total > 1e-9)
        yield pa.RecordBatch.from_arrays([pa.array(i * TERMS + j), pa.array(total[i, j])], names=["cell", "v"])

    sums = rows.select("sentence", "mask", "tongue", "n").mapInArrow(run, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas().sort_values("cell")
    return sums["cell"].to_numpy(np.int64), sums["v"].to_numpy()


def _table(cells: np.ndarray, values: np.ndarray, first: int, width: int) -> np.ndarray:
    """The lines from first on as a table of width x TERMS."""
    out = np.zeros(width * TERMS)
    lo, hi = np.searchsorted(cells, [first * TERMS, (first + width) * TERMS])
    out[cells[lo:hi] - first * TERMS] = values[lo:hi]
    return out.reshape(width, TERMS)


def _normal(h: np.ndarray) -> np.ndarray:
    return h / np.maximum(h.sum(axis=1, keepdims=True), 1e-12)


def fit(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> tuple[list[str], np.ndarray]:
    """(subjects, components): one row per subject and the general one last, over hashed terms."""
    named = sorted((r["subject"], f"{r['subject_name'] or ''} {r['description'] or ''}") for r in areas.filter("subject is not null").distinct().collect())  # the fixed list of areas
    subjects = [s for s, _ in named]
    masked = _masked(documents, labels, subjects)
    h, tongues = None, _labelled_tongues(masked) or list(range(len(languages.LANGUAGES)))
    for _ in range(1 + BOOTS):
        h = _factor(cut_lineage(_rows(masked, h, tongues)), named)
    return subjects, h.astype(np.float32)


def _factor(rows: DataFrame, named: list[tuple[str, str]]) -> np.ndarray:
    """The components of the rows, from anchors seeded by the documents' subjects."""
    k = len(named)

    def shares(t: np.ndarray, mask: str, tongue: int) -> tuple[int, np.ndarray]:
        has = np.zeros(k)
        has[list(_bits(mask))] = 1
        return tongue * (k + 1), np.repeat(np.concatenate((has / max(has.sum(), 1), [1.0]))[:, None], len(t), axis=1)

    # an anchor is what a subject's documents say more often than documents in the same language do
    cells, values = _gather(rows, (k + 1) * len(languages.LANGUAGES), shares)
    everywhere, inside, expected = np.zeros(TERMS), np.zeros((k, TERMS)), np.zeros((k, TERMS))
    for tongue in np.unique(cells // ((k + 1) * TERMS)):
        own = _table(cells, values, int(tongue) * (k + 1), k + 1)
        everywhere += own[k]
        inside += own[:k]
        expected += own[:k].sum(axis=1, keepdims=True) * own[:k].sum(axis=0) / max(own[:k].sum(), 1e-9)
    lift = inside / (expected + 0.3)
    # a subject that many documents have cannot stand out by much
    most = inside.sum() / np.maximum(inside.sum(axis=1, keepdims=True), 1e-9)
    enough = np.minimum(LIFT, 1 + (most - 1) / 2)
    seeds = np.where((lift > enough) & (inside >= 1), inside * np.minimum(lift, k) / k, 0)
    for i, (_, description) in enumerate(named):
        told = [w for w in _WORD.findall(description.lower()) if len(w) > 3]
        seeds[i, [zlib.crc32(w.encode()) & (TERMS - 1) for w in told]] += max(1.0, 0.002 * seeds[i].sum())
    shared = everywhere / np.maximum(1, lift.max(axis=0) ** 2)
    h0 = _normal(np.vstack([seeds, shared]))
    h = h0 + 1e-7
    # without labels a sentence may be about anything, whatever its documents are about
    free = rows.groupBy("sentence", F.when(F.startswith("mask", F.lit("-")), "").otherwise(F.col("mask")).alias("mask"), F.lit(0).alias("tongue")).agg(F.sum("n").alias("n"))
    free = cut_lineage(free)
    for _ in range(ROUNDS):
        sent = rows.sparkSession.sparkContext.broadcast(h)  # fixed size

        def update(t: np.ndarray, mask: str, tongue: int) -> tuple[int, np.ndarray]:
            allowed = np.full(k + 1, OUTSIDE if mask else 1.0)
            allowed[[*_bits(mask), k]] = 1.0
            columns = sent.value[:, t]
            w = _weights(columns, allowed)
            return 0, (w[:, None] * columns) / np.maximum(w @ columns, 1e-12)

        h = _normal(_normal(_table(*_gather(free, k + 1, update), 0, k + 1)) + PRIOR * h0) + 1e-7
    return h


def mixtures(documents: DataFrame, subjects: list[str], components: np.ndarray) -> DataFrame:
    """(doc_id, subject, n_sentences, share): the subject-bearing sentences of each document by subject."""
    sent = documents.sparkSession.sparkContext.broadcast(components.astype(np.float64))  # fixed size
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(sent.value)
        for b in batches:
            at, subject, number, share = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = Counter()
                for s in sentences(t):
                    c = judge(s)
                    if c >= 0:
                        found[c] += 1
                total = sum(found.values())
                for c, n in found.items():
                    at.append(i)
                    subject.append(subjects[c])
                    number.append(n)
                    share.append(n / total)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(subject, pa.string()), pa.array(number, pa.int32()), pa.array(share, pa.float64())], names=["doc_id", "subject", "n_sentences", "share"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, subject string, n_sentences int, share double")


def document_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, subject) of every document without labels: each subject with at least the share of its subject-bearing sentences."""
    found = mixtures(documents, *fit(documents, labels, areas)).filter(F.col("share") >= share - 1e-9)
    return found.join(labels.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "subject")
