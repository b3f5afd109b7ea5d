"""Subject areas of each document.

A document is read as units: the sentences of its message and its changed lines. Terms are the
words and word pairs of a unit, identifiers split into their words. A term's weight is its inverse
document frequency times how unevenly it spreads over the subjects. Weighted term vectors of all
documents are decomposed (truncated SVD); labelled documents give each subject a seed centroid, and
the centroids are refined over all documents. A unit belongs to the subject whose centroid its
vector is closest to by cosine; a document is about the subjects of its units, but a subject that
only one unit speaks of, beside others that are spoken of, was named in passing.

What is bounded: the labelled documents that serve as seeds, LABELLED at most, as many of each subject.
What covers every document: which terms there are, their frequencies and unevenness, the
decomposition, centroid refinement, assignment. The driver and each task hold the chosen terms, a row of
DIMENSIONS numbers for each. A term must be held by a share of all documents (TERM_SHARE), so that the
terms don't grow with the corpus: at most the mean number of different terms in a document, over that share.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.sources.shared import dropped, staged

#: Labelled documents that serve as seeds, chosen by a hash of their id among those of each subject.
LABELLED = 6000
#: Documents that must hold a term, and the share of all documents. The share bounds the number of terms,
#: whatever the size of the corpus.
TERM_DOCUMENTS = 3
TERM_SHARE = 1e-4
#: Share of all documents that holds a term from which the decomposition's subspace is found.
CORE_SHARE = 1e-3
DIMENSIONS = 32
#: Terms whose sums travel together.
BLOCK = 1024
#: A term is folded in if the truncated decomposition keeps less than this share of its length or
#: leaves it further than this cosine from every centroid, and if it is this uneven.
CAPTURED = 0.5
APART = 0.4
FOLD_UNEVENNESS = 0.8
#: Observations of a term in documents that were given a class, at most, beside those in labelled ones.
GIVEN = 20
#: Rounds over the corpus that spread the labels to choose terms, of the decomposition, and of the centroids.
TERM_ROUNDS = 2
SVD_ROUNDS = 2
CORPUS_ROUNDS = 2
#: Terms spread more evenly over subjects than this (0 evenly, 1 in a single one) carry no subject.
UNEVENNESS = 0.45
#: What the unevenness of a unit's terms must add up to for the unit to speak of a subject: a single term that is
#: only just uneven enough doesn't.
SPEAKS = 0.6
#: Least cosine of a unit, and of a document that takes part in refinement.
UNIT_COSINE = 0.3
DOCUMENT_COSINE = 0.7
#: How far the closest subject of a unit must be ahead of the second.
AHEAD = 1.5
#: Units that must speak of a subject if the document speaks of others as well.
UNITS = 2
NONE = "unassigned"

# Beginnings of lines that are no message.
_HEADERS = (
    "commit ", "Author: ", "Date: ", "Merge: ", "From ", "From: ", "# HG changeset", "# User ", "# Date ", "# Node ID", "# Parent",
    "Signed-off-by:", "Co-authored-by:", "Reviewed-by:", "---",
)
_SVN = re.compile(r"r\d+ \| ")
_SUBJECT = re.compile(r"Subject: (?:\[[^\]]*\] ?)?")
_SENTENCE = re.compile(r"(?<=[.!?]) +|(?<=[.!?][)\"']) +")
_WORD = re.compile(r"[A-Z]*[^\W\d_A-Z]+|[A-Z]+")  # a hump in an identifier begins a word


def units_of(text: str) -> list[str]:
    """Sentences of the message, then changed lines. Headers, paths and context lines are left out."""
    units: list[str] = []
    message: list[str] = []
    paragraphs: list[list[str]] = [message]
    in_diff = False
    for line in text.splitlines():
        if in_diff:
            first = line[:1]
            if (first == "+" and not line.startswith("+++ ")) or (first == "-" and not line.startswith("--- ") and line != "-- "):
                units.append(line[1:])
            continue
        if line.startswith("diff --") or line.startswith("Index: "):
            in_diff = True
            continue
        body = line.strip()
        if not body:
            paragraphs.append([])
        elif line.startswith("Subject: "):
            paragraphs.append([_SUBJECT.sub("", line)])
        elif not line.startswith(_HEADERS) and not _SVN.match(line) and not body.startswith(("Signed-off-by:", "Co-authored-by:")):
            if body.startswith("* "):
                paragraphs.append([])
            paragraphs[-1].append(body)
    return [s for p in paragraphs if p for s in _SENTENCE.split(" ".join(p))] + units


def words_of(unit: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(unit)]


def pair_numbers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Term numbers of word pairs, from those of their words."""
    x = (a.astype(np.int64) * 0x9E3779B1 + b.astype(np.int64) * 0x85EBCA6B + 0x27D4EB2F) & 0xFFFFFFFF
    x = ((x ^ (x >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
    return ((x ^ (x >> 12)) - (1 << 31)).astype(np.int32)


class Terms:
    """Term numbers of units, kept for units and words that repeat."""

    KEPT = 100_000

    def __init__(self):
        self.kept: dict[str, list[int]] = {}
        self.numbers: dict[str, int] = {}

    def words(self, unit: str) -> list[int]:
        """Numbers of a unit's words."""
        got = self.kept.get(unit)
        if got is None:
            words = _WORD.findall(unit)
            got = list(map(self.numbers.get, words))
            if None in got:
                if len(self.numbers) >= 4 * self.KEPT:
                    self.numbers.clear()
                for i, n in enumerate(got):
                    if n is None:
                        got[i] = self.numbers[words[i]] = zlib.crc32(words[i].lower().encode("utf-8", "replace")) - (1 << 31)
            if len(self.kept) >= self.KEPT:
                self.kept.clear()
            self.kept[unit] = got
        return got

    def of(self, unit: str) -> list[int]:
        """Numbers of a unit's words, then of its word pairs."""
        words = np.array(self.words(unit), np.int32)
        return [*words.tolist(), *pair_numbers(words[:-1], words[1:]).tolist()]


def with_pairs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``words`` of units of ``sizes`` (none empty), one after another, with the pairs of each unit behind its words; the new sizes."""
    ends = np.cumsum(sizes)
    unit = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.r_[0, np.cumsum(2 * sizes - 1)[:-1]] if len(sizes) else np.empty(0, np.int64)
    out = np.empty(int((2 * sizes - 1).sum()), np.int32)
    place = np.arange(len(words)) - (ends - sizes)[unit] + starts[unit]
    out[place] = words
    first = np.flatnonzero(np.arange(len(words)) < (ends - 1)[unit])  # words with another one behind
    out[place[first] + sizes[unit[first]]] = pair_numbers(words[first], words[first + 1])
    return out, 2 * sizes - 1


# --- fitting ----------------------------------------------------------------------------


@dataclass
class Model:
    """``terms``: known term numbers; ``vectors``: their weighted SVD rows; ``centroids``: unit
    vectors, a row for each of ``subjects``, then one of what is about none of them; ``unevenness`` of the terms."""

    subjects: list[str]
    terms: np.ndarray
    vectors: np.ndarray
    centroids: np.ndarray
    unevenness: np.ndarray | None = None


@dataclass
class Seeds:
    """``ids``: labelled documents, sorted; ``shares``: a share of each subject for each of them, the
    last column meaning none of the subjects."""

    ids: np.ndarray
    shares: np.ndarray

    def of(self, ids: pa.Array) -> np.ndarray:
        """Shares of the documents ``ids``; rows of zeros for those that aren't labelled."""
        out = np.zeros((len(ids), self.shares.shape[1]))
        if len(self.ids) and len(ids):
            mine = ids.fill_null(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(self.ids, mine), len(self.ids) - 1)
            there = (self.ids[at] == mine) & ids.is_valid().to_numpy(zero_copy_only=False)
            out[there] = self.shares[at[there]]
        return out


def _unevenness(term: np.ndarray, of: np.ndarray, x: np.ndarray, sizes: np.ndarray, n_terms: int):
    """How unevenly terms spread over classes, the class each leans to, and what was seen of it. ``x``
    observations of ``term`` lie in class ``of``, a pair once. Classes count alike, however many documents
    (``sizes``) they have. The first half of the classes holds labelled documents, the second those that
    were given a class; the latter count as GIVEN observations of a term at most."""
    n_classes = len(sizes) // 2
    rate = x / np.maximum(sizes[of], 1.0)
    kind = term * 2 + of // n_classes
    seen = np.bincount(kind, weights=x, minlength=2 * n_terms)
    seen = seen.astype(float)  # without rows they are integers
    seen[1::2] = np.minimum(seen[1::2], GIVEN)
    together = np.maximum(np.bincount(kind, weights=rate, minlength=2 * n_terms), 1e-12)
    pairs, at = np.unique(term * n_classes + of % n_classes, return_inverse=True)
    x = np.bincount(at, weights=rate / together[kind] * seen[kind], minlength=len(pairs))
    term, of, seen = pairs // n_classes, pairs % n_classes, seen[::2] + seen[1::2]
    share = (x + 1.0 / n_classes) / (seen[term] + 1.0)  # one observation's worth of evenness
    rest = 1.0 / n_classes / (seen + 1.0)  # the share of each class without observations
    entropy = -np.bincount(term, weights=share * np.log(share), minlength=n_terms).astype(float)
    entropy -= (n_classes - np.bincount(term, minlength=n_terms)) * rest * np.log(rest)
    lean = np.zeros(n_terms, np.int64)
    order = np.lexsort((-of, x, term))  # the last of each term: the most observations, of equal ones the first class
    lean[term[order]] = of[order]
    return 1 - entropy / np.log(max(n_classes, 2)), lean, seen


def _spread(rows, cols, values, vectors, n_rows, block=200_000):
    """Sparse matrix (rows sorted) times dense ``vectors``."""
    out = np.zeros((n_rows, vectors.shape[1]))
    for i in range(0, len(rows), block):
        r = rows[i : i + block]
        part = vectors[cols[i : i + block]] * values[i : i + block, None]
        starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        out[r[starts]] += np.add.reduceat(part, starts)
    return out


def _unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def truncated_svd(rows, cols, values, shape, k, rounds=4, seed=7):
    """Right singular vectors (columns) and singular values of a sparse matrix by subspace iteration."""
    k = max(1, min(k, *shape))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((shape[1], k)))[0]
    order = np.lexsort((rows, cols))
    for _ in range(rounds):
        y = _spread(rows, cols, values, q, shape[0])
        z = _spread(cols[order], rows[order], values[order], y, shape[1])
        q = np.linalg.qr(z)[0]
    y = _spread(rows, cols, values, q, shape[0])
    _, sigma, vt = np.linalg.svd(y, full_matrices=False)
    return q @ vt.T, sigma


def _few(df: DataFrame) -> DataFrame:
    """In as many tasks as run at once, as each sends its own sums for the terms it has met."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))


def known_terms(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Term numbers that enough of all documents hold, sorted, the documents that hold each; the number
    of all documents. There are no more of them than a document has terms in the mean, over TERM_SHARE."""
    n_docs = tokens.count()
    held = tokens.select(F.explode("held").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    got = held.filter(F.col("n") >= max(TERM_DOCUMENTS, math.ceil(TERM_SHARE * n_docs))).toArrow()
    terms, n = (got.column(c).to_numpy().astype(np.int64) for c in ("t", "n"))
    order = np.argsort(terms)
    return terms[order], n[order], n_docs


def _class_counts(tokens: DataFrame, given: Broadcast, n_classes: int, telling) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Term positions, classes and how many documents of the class hold the term, where there are any;
    documents of each class. Classes of labelled documents come first, then the same for documents that
    were given one. ``telling``: unevenness and the class it leans to of each term; documents
    without labels take on the class that most of theirs lean to, for each term the class that the other terms give."""
    side = tokens.sparkSession.sparkContext.broadcast(telling)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, seeds), telling = given.value, side.value
        table = _table(known)
        sizes = np.zeros(2 * n_classes)
        for batch in batches:
            flat, lengths = _arrays(batch.column(1))
            cols, on = _positions(known, flat, table)
            rows, cols = np.repeat(np.arange(len(lengths)), lengths)[on], cols[on]
            labels = seeds.of(batch.column(0))
            sizes[:n_classes] += labels.sum(0)
            labelled = labels.sum(1) > 0
            keys, amounts = [], []
            for c in np.flatnonzero(labels.sum(0)):
                on = np.flatnonzero(labels[rows, c])
                keys.append(cols[on] * 2 * n_classes + c)
                amounts.append(labels[rows[on], c])
            if telling is not None and len(cols):
                g, lean = telling
                own, to = g[cols].astype(float), lean[cols].astype(np.int64)
                votes = np.bincount(rows * n_classes + to, weights=own, minlength=len(lengths) * n_classes).reshape(-1, n_classes)
                first, best, total = votes.argmax(1), votes.max(1), votes.sum(1)
                sizes[n_classes:] += np.bincount(first[~labelled & (best >= 0.8 * total) & (best >= 2.0)], minlength=n_classes)
                # a term's own vote does not count for what it is found with
                rest = best[rows] - np.where(to == first[rows], own, 0.0)
                sure = np.flatnonzero(~labelled[rows] & (rest >= 0.8 * (total[rows] - own)) & (rest >= 2.0))
                keys.append((cols[sure] * 2 + 1) * n_classes + first[rows[sure]])
                amounts.append(np.ones(len(sure)))
            if keys:
                key, at = np.unique(np.concatenate(keys), return_inverse=True)
                yield _triples(key // (2 * n_classes), key % (2 * n_classes), np.bincount(at, weights=np.concatenate(amounts), minlength=len(key)))
        yield _triples(np.full(2 * n_classes, -1), np.arange(2 * n_classes), sizes)

    sums = tokens.select("doc_id", "held").mapInArrow(run, "s int, d int, x double").groupBy("s", "d").agg(F.sum("x").alias("x")).toArrow()
    side.destroy()
    s, d, x = (sums.column(c).to_numpy() for c in ("s", "d", "x"))
    sizes = np.zeros(2 * n_classes)
    sizes[d[s < 0]] = x[s < 0]
    there = (s >= 0) & (x > 0)
    return s[there].astype(np.int64), d[there].astype(np.int64), x[there], sizes


def choose_terms(tokens: DataFrame, seeds: Seeds) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Term numbers that tell subjects (and none of them) apart, sorted, their unevenness, the class each leans to
    and the documents that hold it; the number of all documents. Counted over all documents."""
    terms, n, n_docs = known_terms(tokens)
    given = tokens.sparkSession.sparkContext.broadcast((terms, seeds))
    telling, g, lean, seen = None, np.zeros(len(terms)), np.zeros(len(terms), np.int64), np.zeros(len(terms))
    for _ in range(TERM_ROUNDS + 1):
        *found, sizes = _class_counts(tokens, given, seeds.shares.shape[1], telling)
        g, lean, seen = _unevenness(*found, sizes, len(terms))
        g = np.where((g >= UNEVENNESS) & (seen > 0), g, 0.0)
        if not g.any():
            break
        telling = g.astype(np.float32), lean.astype(np.int32)
    given.destroy()
    keep = g > 0
    return terms[keep], g[keep], lean[keep], n[keep].astype(float), n_docs


def _weighted(flat: np.ndarray, lengths: np.ndarray, weight: np.ndarray):
    """Rows, columns, damped counts and weighted values (rows of length 1) of documents by terms."""
    there = flat >= 0
    doc = np.repeat(np.arange(len(lengths)), lengths)[there]
    pairs, tf = np.unique(doc * len(weight) + flat[there], return_counts=True)
    rows, cols = np.divmod(pairs, len(weight))
    damped = 1 + np.log(tf)
    values = damped * weight[cols]
    norms = np.sqrt(np.bincount(rows, weights=values**2, minlength=len(lengths)))
    return rows, cols, damped, values / np.maximum(norms[rows], 1e-12)


def _term_sums(features: DataFrame, weight: np.ndarray, k: int, points, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the matrix A of all documents by terms, and a point of ``k`` numbers for each document: A' times the
    points, the squared lengths of A's columns, and the shares in them. ``points`` is called with the ids,
    rows, columns and values of A in a batch and gives the points and a share for each document. ``only``: the terms wanted."""
    wanted = np.arange(len(weight)) if only is None else only
    place = np.full(len(weight), -1, np.int32)
    place[wanted] = np.arange(len(wanted))
    side = features.sparkSession.sparkContext.broadcast((weight, place, points))
    n_blocks = -(-len(wanted) // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, place, points = side.value
        n = n_blocks * BLOCK
        sums = np.zeros((n, k + 2))
        for batch in batches:
            flat, lengths = _arrays(batch.column(1))
            rows, cols, _, values = _weighted(flat, lengths, weight)
            y, shares = points(batch.column(0), rows, cols, values, len(lengths))
            at = place[cols]
            on = np.flatnonzero((at >= 0) & (shares[rows] > 0))
            on = on[np.argsort(at[on], kind="stable")]
            sums[:, :k] += _spread(at[on], rows[on], values[on], y, n)
            sums[:, k] += np.bincount(at[on], weights=values[on] ** 2, minlength=n)
            sums[:, k + 1] += np.bincount(at[on], weights=shares[rows[on]], minlength=n)
        yield _blocks((b, x.astype(np.float32)) for b, x in enumerate(sums.reshape(n_blocks, -1)) if x.any())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[b] = sums.get(b, 0.0) + np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
        yield _blocks(sums.items())

    parts = _few(features.select("doc_id", "terms")).mapInArrow(run, "b int, sums binary")
    got = parts.repartition("b").mapInArrow(add, "b int, sums binary").toArrow()  # a row for each BLOCK wanted terms
    side.destroy()
    out = np.zeros((n_blocks * BLOCK, k + 2))
    for b, x in zip(got.column("b").to_pylist(), got.column("sums")):
        out[b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(x.as_buffer(), np.float64).reshape(BLOCK, k + 2)
    out = out[: len(wanted)]
    return out[:, :k], out[:, k], out[:, k + 1]


def _blocks(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x.tobytes() for _, x in rows], pa.binary())], names=["b", "sums"])


@dataclass
class _Projected:
    """Points of documents: their rows of A times ``q``, which has a row for each term of ``place``."""

    place: np.ndarray
    q: np.ndarray

    def __call__(self, ids, rows, cols, values, n):
        at = self.place[cols]
        on = at >= 0
        return _spread(rows[on], at[on], values[on], self.q, n), np.ones(n)


@dataclass
class _Labelled:
    """Points of labelled documents: the centroids of their subjects."""

    seeds: Seeds
    centroids: np.ndarray

    def __call__(self, ids, rows, cols, values, n):
        labels = self.seeds.of(ids)
        return labels @ self.centroids, labels.sum(1)


def corpus_svd(
    features: DataFrame, weight: np.ndarray, n_docs: int, k: int, rounds: int = SVD_ROUNDS, seed: int = 7,
    core: np.ndarray | None = None, start: np.ndarray | None = None,
):
    """``truncated_svd`` of the weighted matrix of all documents by terms, a pass over ``features``
    for each round; also the lengths of the matrix's columns. The subspace is found from the ``core`` terms (positions;
    all of them if not given); the rows of the others are folded in: what they hold of the documents' vectors. ``start``: columns to begin with."""
    core = np.arange(len(weight)) if core is None else core
    place = np.full(len(weight), -1, np.int32)
    place[core] = np.arange(len(core))
    k = max(1, min(k, n_docs, len(core)))
    q = np.random.default_rng(seed).standard_normal((len(core), k))
    if start is not None:
        q[:, : min(k, start.shape[1])] = start[core][:, :k]
        q[:, ~q.any(0)] = 1.0
    q = np.linalg.qr(q)[0]
    for _ in range(rounds):
        q = np.linalg.qr(_term_sums(features, weight, k, _Projected(place, q.astype(np.float32)), core)[0])[0]
    z, squares, _ = _term_sums(features, weight, k, _Projected(place, q.astype(np.float32)))
    inner = q.T @ z[core]
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = np.maximum(values[::-1], 0.0), turn[:, ::-1]
    v = (z @ turn) / np.maximum(values, 1e-12)
    v[core] = q @ turn
    return v, np.sqrt(values), np.sqrt(squares)


def fit(
    features: DataFrame, seeds: Seeds, terms: np.ndarray, g: np.ndarray, lean: np.ndarray, frequency: np.ndarray, n_docs: int,
    subjects: list[str], descriptions: dict[str, str] | None = None,
) -> Model:
    """``features``: positions in ``terms`` of each document; ``frequency``: documents that hold each
    term, of ``n_docs``. Wordings that share no document with others of their subject are lost in the
    truncation; the uneven ones are folded in as the centroids of the labelled documents that hold them.
    The seed of a subject that no labelled document has alone is what its description's terms say.
    """
    weight = (np.log((n_docs + 1.0) / (frequency + 1.0)) + 1.0) * g * g
    n_classes = seeds.shares.shape[1]
    if not len(terms) or not subjects:
        return Model(subjects, terms, np.zeros((len(terms), 1), np.float32), np.zeros((n_classes, 1), np.float32))
    core = np.flatnonzero(frequency >= CORE_SHARE * n_docs)
    core = core if len(core) >= DIMENSIONS else np.arange(len(terms))
    start = np.zeros((len(terms), min(n_classes, DIMENSIONS // 2)))
    begun = lean < start.shape[1]
    start[begun, lean[begun]] = g[begun]
    v, sigma, length = corpus_svd(features, weight, n_docs, DIMENSIONS, core=core, start=start)
    vectors = v * weight[:, None]
    chosen = features.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(seeds.ids, pa.int64())}))
    held = staged(features.join(F.broadcast(chosen), "doc_id", "left_semi"), "labelled")  # LABELLED documents or so
    centroids = _unit_rows(_seed_sums(held, seeds, vectors))
    for c in np.flatnonzero(~centroids.any(1)[: len(subjects)]):
        at, on = _positions(terms, np.array(Terms().of((descriptions or {}).get(subjects[c]) or ""), np.int64))
        centroids[c] = _unit_rows(vectors[at[on]].sum(0, keepdims=True))[0]
    folded, _, support = _term_sums(held, weight, centroids.shape[1], _Labelled(seeds, centroids))
    dropped(held)
    captured = np.linalg.norm(v * sigma, axis=1) / np.maximum(length, 1e-12)
    apart = (_unit_rows(vectors) @ centroids.T).max(1) < APART
    lost = ((captured < CAPTURED) | apart) & (support >= TERM_DOCUMENTS - 1e-6) & (g >= FOLD_UNEVENNESS)
    vectors[lost] = (_unit_rows(folded) * (weight * length / max(sigma[:n_classes].mean(), 1e-12))[:, None])[lost]
    return Model(subjects, terms, vectors.astype(np.float32), _unit_rows(centroids).astype(np.float32), g.astype(np.float32))


def _seed_sums(held: DataFrame, seeds: Seeds, vectors: np.ndarray) -> np.ndarray:
    """For each class the sum of the vectors of the documents that have its label alone."""
    side = held.sparkSession.sparkContext.broadcast((seeds, vectors.astype(np.float32)))
    shape = seeds.shares.shape[1], vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, vectors = side.value
        sums = np.zeros(shape)
        for batch in batches:
            flat, lengths = _arrays(batch.column(1))
            rows, cols, damped, _ = _weighted(flat, lengths, np.ones(len(vectors)))
            points = _unit_rows(_spread(rows, cols, damped, vectors, len(lengths)))
            sums += (seeds.of(batch.column(0)) == 1).astype(float).T @ points
        yield _triples(*(x.ravel() for x in np.indices(shape)), sums.ravel())

    out = _summed(held.select("doc_id", "terms").mapInArrow(run, "s int, d int, x double"), shape)
    side.destroy()
    return out


def _triples(s, d, x) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(d, pa.int32()), pa.array(x, pa.float64())], names=["s", "d", "x"])


def _summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Triples of all tasks added up: a matrix of classes by dimensions."""
    out = np.zeros(shape)
    got = parts.groupBy("s", "d").agg(F.sum("x").alias("x")).toArrow()
    out[got.column("s").to_numpy(), got.column("d").to_numpy()] = got.column("x").to_numpy()
    return out


# --- vectors of documents and units -----------------------------------------------------------


def unit_subjects(flat: np.ndarray, lengths: np.ndarray, model: Model):
    """``flat``: term positions with -1 behind each unit, documents of ``lengths`` one after another.
    Gives (document, subject) of each unit that speaks of a subject."""
    ends = flat == -1
    unit = np.cumsum(ends) - ends
    n_units = int(ends.sum())
    doc_of_unit = np.repeat(np.arange(len(lengths)), lengths)[ends]
    there = ~ends
    if not there.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sums = _spread(unit[there], flat[there], np.ones(there.sum()), model.vectors, n_units)
    cosine = _unit_rows(sums) @ model.centroids.T
    best = cosine.argmax(1)
    top = cosine.max(1)
    second = np.partition(cosine, -2, axis=1)[:, -2] if cosine.shape[1] > 1 else np.zeros(len(top))
    ok = (top >= UNIT_COSINE) & (top >= AHEAD * second) & (best < len(model.subjects))
    if model.unevenness is not None:
        ok &= np.bincount(unit[there], weights=model.unevenness[flat[there]], minlength=n_units) >= SPEAKS
    return doc_of_unit[ok], best[ok]


def document_subjects(flat: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """Booleans, documents by subjects."""
    if not model.subjects:
        return np.zeros((len(lengths), 0), bool)
    doc, subject = unit_subjects(flat, lengths, model)
    n = np.zeros((len(lengths), len(model.subjects)), np.int64)
    np.add.at(n, (doc, subject), 1)
    several = n >= UNITS
    # units of one subject alone, however few, are what the document is about; if each of several
    # subjects has a unit or so, those with the most are
    alone = (n == n.max(1, keepdims=True)) & (n > 0) & ~several.any(1, keepdims=True)
    return several | alone


def document_vectors(flat: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    doc = np.repeat(np.arange(len(lengths)), lengths)
    there = flat >= 0
    return _unit_rows(_spread(doc[there], flat[there], np.ones(there.sum()), model.vectors, len(lengths)))


# --- over the corpus ----------------------------------------------------------------------------


def _arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return flat.astype(np.int64), np.diff(offsets)


def _lists(offsets: np.ndarray, flat) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def _positions(known: np.ndarray, flat: np.ndarray, table: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where each number stands in ``known`` (sorted), and whether it does. ``table`` as ``_table`` makes it."""
    if not len(known):
        return np.zeros(len(flat), np.int64), np.zeros(len(flat), bool)
    first, crowded = table or _table(known)
    slot = flat & (len(first) - 1)
    at = first[slot]
    on = known[at] == flat
    rest = np.flatnonzero(crowded[slot] & ~on)
    at[rest] = np.minimum(np.searchsorted(known, flat[rest]), len(known) - 1)
    on[rest] = known[at[rest]] == flat[rest]
    return at, on


def _table(known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the low bits of a number, the place of a known one that has them, and whether several have."""
    size = 1 << max(4, (16 * len(known)).bit_length())
    first, crowded = np.zeros(size, np.int64), np.zeros(size, bool)
    if len(known):
        slot = known & (size - 1)
        first[slot] = np.arange(len(known))
        crowded[:] = np.bincount(slot, minlength=size) > 1
    return first, crowded


def _tokens_of(docs: DataFrame) -> DataFrame:
    """``doc_id, terms, units, held``: term numbers of each document, how many each of its units has, and each number once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            flat, units, units_at = array("i"), array("i"), [0]
            for t in batch.column(1).to_pylist():
                for u in units_of(t) if t else ():
                    if got := terms.words(u):
                        flat.extend(got)
                        units.append(len(got))
                units_at.append(len(units))
            numbers, sizes = with_pairs(np.frombuffer(flat, np.int32), np.frombuffer(units, np.int32).astype(np.int64))
            offsets = np.r_[0, np.cumsum(sizes)][np.array(units_at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(offsets, numbers), _lists(np.array(units_at), sizes)], names=["doc_id", "terms", "units"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, terms array<int>, units array<int>")
    return rows.withColumn("held", F.array_distinct("terms"))


def _positions_of(tokens: DataFrame, known: np.ndarray) -> DataFrame:
    """``doc_id, terms``: positions of the known terms of each unit, -1 behind each unit that has any."""
    side = tokens.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = side.value, _table(side.value)
        for batch in batches:
            flat, lengths = _arrays(batch.column(1))
            sizes, _ = _arrays(batch.column(2))
            doc, unit = np.repeat(np.arange(len(lengths)), lengths), np.repeat(np.arange(len(sizes)), sizes)
            at, on = _positions(known, flat, table)
            at, doc, unit = at[on], doc[on], unit[on]
            last = np.flatnonzero(np.r_[unit[1:] != unit[:-1], True]) if len(unit) else np.empty(0, np.int64)
            out = np.insert(at, last + 1, -1)
            n = np.bincount(np.insert(doc, last + 1, doc[last]), minlength=len(lengths))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(np.r_[0, np.cumsum(n)], out)], names=["doc_id", "terms"])

    return tokens.mapInArrow(run, "doc_id bigint, terms array<int>")


def labelled_sample(labels: DataFrame, names: list[str]) -> Seeds:
    """As many documents of each subject, and of none, up to LABELLED in all, with all their labels."""
    known = F.when(F.col("subject").isin(names), F.col("subject")).otherwise(NONE) if names else F.lit(NONE)
    given = labels.filter("doc_id is not null and subject is not null").select("doc_id", known.alias("class"), "subject").distinct()
    order = Window.partitionBy("class").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = given.select("doc_id", "class").distinct().withColumn("n", F.row_number().over(order))
    chosen = ranked.filter(F.col("n") <= max(1, LABELLED // (len(names) + 1))).select("doc_id").distinct()
    found: dict[int, set[str]] = {}
    for r in given.join(F.broadcast(chosen), "doc_id").collect():  # at most LABELLED documents
        found.setdefault(r["doc_id"], set()).add(r["subject"])
    shares = np.zeros((len(found), len(names) + 1))
    for i, d in enumerate(sorted(found)):
        for s in found[d]:
            shares[i, names.index(s) if s in names else len(names)] += 1.0 / len(found[d])
    return Seeds(np.array(sorted(found), np.int64), shares)


def _refined(features: DataFrame, model: Model, vectors: Broadcast) -> Model:
    """Centroids moved to the mean of all documents that are close to them."""
    bare = Model(model.subjects, np.empty(0, np.int64), np.empty(0), model.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = replace(bare, vectors=vectors.value[0], unevenness=vectors.value[1])
        sums = np.zeros(m.centroids.shape)
        for batch in batches:
            points = document_vectors(*_arrays(batch.column(0)), m)
            cosine = points @ m.centroids.T
            best = np.where(cosine.max(1) >= DOCUMENT_COSINE, cosine.argmax(1), -1)
            for c in range(len(sums)):
                sums[c] += points[best == c].sum(0)
        yield _triples(*(x.ravel() for x in np.indices(sums.shape)), sums.ravel())

    sums = _summed(features.select("terms").mapInArrow(run, "s int, d int, x double"), model.centroids.shape)
    moved = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, sums, model.centroids)
    return replace(model, centroids=_unit_rows(moved).astype(np.float32))


def _fitted(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> tuple[Model, DataFrame, Broadcast]:
    """The fitted model, the corpus as term positions (staged), and the model's vectors as the tasks have them."""
    told = subjects.select("subject", F.col("description") if "description" in subjects.columns else F.lit(None).alias("description"))
    rows = told.groupBy("subject").agg(F.max("description").alias("description")).orderBy("subject").collect()  # a centroid for each is kept anyway
    descriptions = {r["subject"]: r["description"] for r in rows if r["subject"] not in (None, NONE)}
    names = list(descriptions)
    seeds = labelled_sample(labels, names)
    tokens = staged(_tokens_of(docs), "tokens")
    terms, g, lean, frequency, n_docs = choose_terms(tokens, seeds)
    features = staged(_positions_of(tokens, terms), "subjects")
    dropped(tokens)
    model = fit(features, seeds, terms, g, lean, frequency, n_docs, names, descriptions)
    vectors = docs.sparkSession.sparkContext.broadcast((model.vectors, model.unevenness))
    for _ in range(CORPUS_ROUNDS if names else 0):
        model = _refined(features, model, vectors)
    return model, features, vectors


def train(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> tuple[Model, DataFrame]:
    """The fitted model, and the corpus as term positions (staged)."""
    return _fitted(docs, labels, subjects)[:2]


def assign_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """``doc_id, subject``: every subject of each document; documents that tell of none, null and
    empty texts among them, get ``unassigned`` alone. Labels serve as seeds, never as results."""
    model, features, vectors = _fitted(docs, labels, subjects)
    bare = Model(model.subjects, np.empty(0, np.int64), np.empty(0), model.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = replace(bare, vectors=vectors.value[0], unevenness=vectors.value[1])
        names = np.array([*m.subjects, NONE], dtype=object)
        for batch in batches:
            found = document_subjects(*_arrays(batch.column(1)), m)
            found = np.c_[found, ~found.any(1)]
            doc, subject = np.nonzero(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(names[subject], pa.string())], names=["doc_id", "subject"]
            )

    return features.mapInArrow(run, "doc_id bigint, subject string")
