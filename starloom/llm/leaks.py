"""Evaluation texts leaking into training text.

Words are longest runs of letters and digits; letter case is ignored. Each is canonicalised to a
template token: a number becomes a number placeholder, a name a name placeholder, a unit of
measurement a unit placeholder, and any other word stays. Names are words that the test items write
with a capital inside a sentence and never without, and in documents also capitalised words that no
item uses. So a word that both sides use gets the same token on both, however it is written.

Windows of template tokens are hashed and joined by hash, in two forms:

* word by word, a token for each word. Where such a window agrees and its words agree as well, the passage
  is held exactly (``shared_passages``). Every window of words that agrees is a window of templates that
  agrees, so nothing exact is missed. A window with fewer than PLAIN words of its own is hashed by its words:
  rows of numbers match nothing but themselves.
* with runs of names and runs of numbers drawn together, so that a name of two words may stand for one of
  one word. A shared window says that a document holds an item's wording, perhaps with other numbers and names.
  The slots decide: over the windows that an item and a document share at one alignment (places that lie equally
  far apart), each value of the item stands for one value of the document. Several values may become
  the same one, as a number drawn anew may repeat another. One consistent alignment is enough, since a document may
  hold an item several times with other values each time; but it must cover EVIDENCE tokens (or the
  whole item, if that is shorter), as single frames of a sentence are shared by many texts (``template_leaks``).

Ids of documents are unique, and so are those of items. Texts and passages that are null or short match nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.balance import balanced_join
from starloom.sources.shared import staged

WINDOW = 12
#: Words in a window that are no placeholders, at least, for its template to say anything.
PLAIN = 4
#: Tokens that an alignment must cover.
EVIDENCE = 18
#: Most item windows that are broadcast (16 bytes each, so 16 MB, beside the passages' own words);
#: more are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000
#: Most item words that are broadcast; more are joined to the documents' words by a shuffle.
BROADCAST_WORDS = 1_000_000
#: Bits of the filter that keeps documents' windows that no item has out of the shuffle: 16 for each item window, at most so many.
FILTER_BITS = 1 << 29

# Words that stand for units of measurement.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons pound pounds ounce ounces ml l litre litres liter liters"
    " gallon gallons second seconds minute minutes hour hours day days week weeks month months year years evening evenings season seasons"
    " percent degree degrees celsius fahrenheit kelvin volt volts watt watts ampere amperes hertz byte bytes kb mb gb euro euros dollar"
    " dollars cent cents".split()
)

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_DRAWN = np.uint64(0x5851F42D4C957F2D)  # keeps the two forms of windows apart


def words_of(text: str) -> list[str]:
    """Words as they are written; their lower case is what is compared."""
    return _WORD.findall(text)


def names_of(passages: list[str]) -> frozenset[str]:
    """Words that occur with a capital inside a sentence of the passages, and nowhere without one."""
    capital, small = set(), set()
    for text in passages:
        at_start = True
        for m in re.finditer(r"[^\W_]+|[.!?:]", text):
            word = m[0]
            if word in ".!?:":
                at_start = True
                continue
            if word[0].isupper():
                if not at_start:
                    capital.add(word.lower())
            else:
                small.add(word.lower())
            at_start = False
    return frozenset(capital - small)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


NUMBER, NAME, UNIT = "\0number", "\0name", "\0unit"
_NUMBER, _NAME, _UNIT = (np.uint64(_hash(t)) for t in (NUMBER, NAME, UNIT))


class Templates:
    """Maps words, as they are written, to template tokens and those to 64-bit numbers.

    ``vocabulary``: the items' words in lower case; without it only known names are names."""

    KEPT = 500_000

    def __init__(self, names: frozenset[str], vocabulary: frozenset[str] | None = None):
        self.names, self.vocabulary = names, vocabulary
        self.kept: dict[str, int] = {}
        self.exact: dict[str, int] = {}

    def token(self, word: str) -> str:
        small = word.lower()
        if small.isnumeric() or (small[0].isnumeric() and any(c.isnumeric() for c in small)):
            return NUMBER
        if small in self.names:
            return NAME
        if small in UNITS:
            return UNIT
        if self.vocabulary is not None and word[0].isupper() and small not in self.vocabulary:
            return NAME
        return small

    def _of(self, words: list[str], kept: dict[str, int], make) -> np.ndarray:
        found = list(map(kept.get, words))
        if None in found:
            if len(kept) >= self.KEPT:
                kept.clear()
            for i, h in enumerate(found):
                if h is None:
                    found[i] = kept[words[i]] = _hash(make(words[i]))
        return np.array(found, np.uint64)

    def numbers(self, words: list[str]) -> np.ndarray:
        return self._of(words, self.kept, self.token)

    def word_numbers(self, words: list[str]) -> np.ndarray:
        return self._of(words, self.exact, str.lower)


def window_hashes(numbers: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Hash of each run of ``window`` consecutive numbers (polynomial, modulo 2 ** 64)."""
    n = len(numbers) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = numbers[:n].copy()
    for i in range(1, window):
        out *= _MIX
        out += numbers[i : i + n]
    return out


class Text:
    """The windows of one text in both forms."""

    def __init__(self, words: list[str], templates: Templates, window: int):
        self.words, self.templates, self.window = words, templates, window
        self.numbers = templates.numbers(words)

    @cached_property
    def filled(self) -> np.ndarray:
        """Whether each token is a placeholder."""
        n = self.numbers
        return (n == _NUMBER) | (n == _NAME) | (n == _UNIT)

    @cached_property
    def starts(self) -> np.ndarray:
        """Where the drawn-together tokens begin: not at a number behind a number, nor at a name behind a name."""
        n = self.numbers
        again = np.zeros(len(n), bool)
        again[1:] = (n[1:] == n[:-1]) & ((n[1:] == _NUMBER) | (n[1:] == _NAME))
        return np.flatnonzero(~again)

    def _telling(self, filled: np.ndarray) -> np.ndarray:
        """Whether each window has words enough that are no placeholders."""
        sums = np.r_[0, np.cumsum(~filled)]
        return sums[self.window :] - sums[: -self.window] >= PLAIN

    def by_word(self) -> np.ndarray:
        """Hashes of the windows of words."""
        out = window_hashes(self.numbers, self.window)
        if len(out):
            bare = ~self._telling(self.filled)
            if bare.any():
                out[bare] = window_hashes(self.templates.word_numbers(self.words), self.window)[bare]
        return out

    def drawn(self) -> tuple[np.ndarray, np.ndarray]:
        """Places, among the drawn-together tokens, and hashes of the windows that tell something."""
        out = window_hashes(self.numbers[self.starts], self.window)
        if not len(out):
            return np.empty(0, np.int64), out
        on = np.flatnonzero(self._telling(self.filled[self.starts]))
        return on, out[on] ^ _DRAWN

    def small(self) -> list[str]:
        return [w.lower() for w in self.words]

    def values(self) -> list[tuple[bool, str]]:
        """Each drawn-together token: whether it is a placeholder, and its words."""
        small, ends = self.small(), [*self.starts[1:].tolist(), len(self.words)]
        return [(f, small[a] if b == a + 1 else " ".join(small[a:b])) for a, b, f in zip(self.starts.tolist(), ends, self.filled[self.starts].tolist())]


class _Index:
    """Sorted hashes with the item and the place of each."""

    def __init__(self, places: list[np.ndarray], hashes: list[np.ndarray]):
        flat = np.concatenate([np.empty(0, np.uint64), *hashes])
        item = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(h) for h in hashes])
        place = np.concatenate([np.empty(0, np.int64), *places]).astype(np.int32)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.item, self.place = flat[order], item[order], place[order]

    def hits(self, places: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place in the text, item, place in the item) of each window that both have."""
        if not len(hashes) or not len(self.hashes):
            return
        first = np.searchsorted(self.hashes, hashes)
        first[first == len(self.hashes)] = 0
        at = np.flatnonzero(self.hashes[first] == hashes)
        ends = np.searchsorted(self.hashes, hashes[at], side="right")
        for place, a, b in zip(places[at].tolist(), first[at].tolist(), ends.tolist()):
            for e in range(a, b):
                yield place, int(self.item[e]), int(self.place[e])


class ItemWindows:
    """All windows of the items. ``templates`` are made of the items themselves if not given."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, templates: Templates | None = None):
        self.window = window
        self.ids = [i for i, _ in items]
        words = [words_of(t) for _, t in items]
        if templates is None:
            templates = Templates(names_of([t for _, t in items]), frozenset(w.lower() for ws in words for w in ws))
        self.templates = templates
        texts = [Text(ws, templates, window) for ws in words]
        self.words, self.values = [t.small() for t in texts], [t.values() for t in texts]
        by_word, drawn = [t.by_word() for t in texts], [t.drawn() for t in texts]
        self.by_word = _Index([np.arange(len(h)) for h in by_word], by_word)
        self.drawn = _Index([a for a, _ in drawn], [h for _, h in drawn])

    def compare(self, words: list[str], reworded: bool = True) -> Iterator[tuple[int, int, int, bool]]:
        """(item id, exact windows, template windows, slots consistent at some alignment) for each item that shares
        a window. Without ``reworded`` only exact windows are looked for."""
        if len(words) < self.window and not reworded:
            return
        text = Text(words, self.templates, self.window)
        found: dict[int, list] = {}
        small: list[str] = []
        hashes = text.by_word()
        for at, item, i in self.by_word.hits(np.arange(len(hashes)), hashes):
            small = small or text.small()
            state = found.setdefault(item, [0, 0, {}])
            state[0] += small[at : at + self.window] == self.words[item][i : i + self.window]
        values: list[tuple[bool, str]] = []
        for at, item, i in self.drawn.hits(*text.drawn()) if reworded else ():
            values = values or text.values()
            mine, theirs = values[at : at + self.window], self.values[item][i : i + self.window]
            if any(f != g or (not f and a != b) for (f, a), (g, b) in zip(theirs, mine)):
                continue  # the hashes agree by chance
            state = found.setdefault(item, [0, 0, {}])
            state[1] += 1
            slots = state[2].setdefault(at - i, [True, {}, 0, -self.window])
            slots[2] += min(self.window, i - slots[3])
            slots[3] = i
            for (f, a), (_, b) in zip(theirs, mine):
                if f and slots[1].setdefault(a, b) != b:
                    slots[0] = False
        for item, (exact, shared, alignments) in found.items():
            least = min(EVIDENCE, len(self.values[item]))
            yield self.ids[item], exact, shared, any(fits and covered >= least for fits, _, covered, _ in alignments.values())


# --- over the corpus ----------------------------------------------------------------------

_MATCH_DDL = "doc_id bigint, item_id bigint, n_exact int, n_template int, consistent boolean"


def document_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, reworded: bool = True) -> DataFrame:
    """``doc_id, item_id, n_exact, n_template, consistent`` for every document and item that share
    a template window: how many windows agree word by word, how many as templates, and whether the
    slots are filled consistently at an alignment that is evidence enough. Without ``reworded`` the last two are
    not looked for.

    Item windows are broadcast while their counted number is within BROADCAST_WINDOWS; beyond it
    ``document_matches_shuffled`` joins both sides by hash, with the same rows.
    """
    n_chars = items.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0]
    if n_chars > 2 * BROADCAST_WINDOWS:  # a window takes at least two characters of its own
        return document_matches_shuffled(docs, items, window, reworded)
    rows = [(r["item_id"], r["passage"]) for r in items.select("item_id", "passage").filter("passage <> ''").collect()]
    side = docs.sparkSession.sparkContext.broadcast(ItemWindows(rows, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare = side.value.compare
        for batch in batches:
            texts = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            out = [(doc, *m) for doc, text in texts if text for m in compare(words_of(text), reworded)]
            if out:
                yield _batch(out)

    return docs.select("doc_id", "text").mapInArrow(run, _MATCH_DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    names = ["doc_id", "item_id", "n_exact", "n_template", "consistent"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


# --- item sets of any size ----------------------------------------------------------------------

_WINDOW_DDL = "id bigint, at int, drawn boolean, h bigint, x bigint, n int"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _with_words(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``id, text, known, names``: which words of each text are the items', and which of those are names, by a join."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, w) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for w in {x.lower() for x in words_of(t)}]
            if rows:
                ids, found = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found)], names=["__id", "word"])

    held = texts.select("id", "text").mapInArrow(distinct, "__id bigint, word string").join(words, "word")
    lists = held.groupBy("__id").agg(F.collect_list("word").alias("known"), F.collect_list(F.when(F.col("name"), F.col("word"))).alias("names"))
    return texts.join(lists, F.col("id").eqNullSafe(F.col("__id")), "left").select("id", "text", "known", "names")


def _windows(texts: DataFrame, side, window: int, reworded: bool, seen=None) -> DataFrame:
    """Windows of both forms: hash, hash of the words, drawn-together tokens of the text. ``seen``: a filter (broadcast);
    windows it doesn't know are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = side.value
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for i, text, *marks in zip(*columns):
                if not text:
                    continue
                templates = common or Templates(frozenset(marks[1] or ()), frozenset(marks[0] or ()))
                t = Text(words_of(text), templates, window)
                h = t.by_word()
                x = window_hashes(templates.word_numbers(t.words), window)
                parts = [(np.arange(len(h)), h, x, False)]
                if reworded:
                    at, drawn = t.drawn()
                    parts.append((at, drawn, np.zeros(len(at), np.uint64), True))
                for at, h, x, kind in parts:
                    if seen is not None and len(h):
                        bits = seen.value
                        b = h & np.uint64(len(bits) * 64 - 1)
                        on = np.flatnonzero(bits[b >> np.uint64(6)] >> (b & np.uint64(63)) & np.uint64(1))
                        at, h, x = at[on], h[on], x[on]
                    if len(h):
                        n = len(h)
                        arrays = [pa.array([i] * n, pa.int64()), pa.array(at, pa.int32()), pa.array([kind] * n), _signed(h), _signed(x), pa.array([len(t.starts)] * n, pa.int32())]
                        yield pa.RecordBatch.from_arrays(arrays, names=["id", "at", "drawn", "h", "x", "n"])

    return texts.mapInArrow(run, _WINDOW_DDL)


def _filter_of(windows: DataFrame) -> np.ndarray:
    """A bit for each hash, as words of 64: at most FILTER_BITS / 64 of them reach the driver."""
    n = windows.count()
    bits = min(FILTER_BITS, 1 << max(10, int(16 * n).bit_length()))
    bit = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = windows.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((h & {bits - 1}) & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def document_matches_shuffled(docs: DataFrame, items: DataFrame, window: int = WINDOW, reworded: bool = True) -> DataFrame:
    """The same for item sets of any size: windows of both sides meet by hash in a shuffle, hashes of very many windows
    split over tasks. Pairs that an alignment speaks for are compared text by text.

    Items' words decide what is a name: they are broadcast within BROADCAST_WORDS, else joined to the words of each text.
    """
    spark = docs.sparkSession
    mine, theirs = docs.select(F.col("doc_id").alias("id"), "text"), items.select(F.col("item_id").alias("id"), F.col("passage").alias("text"))
    words = items.select("passage").mapInArrow(_word_rows, "word string, capital boolean").groupBy("word").agg(F.coalesce(F.min("capital"), F.lit(False)).alias("name"))
    words = staged(words, "words")
    if words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        listed = words.collect()
        common = Templates(frozenset(r["word"] for r in listed if r["name"]), frozenset(r["word"] for r in listed))
    else:
        common, mine, theirs = None, _with_words(mine, words), _with_words(theirs, words)
    side = spark.sparkContext.broadcast(common)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = staged(_windows(theirs, side, window, reworded), "items").withColumnsRenamed({"id": "item_id", "at": "i_at", "drawn": "i_drawn", "x": "i_x"})
    seen = spark.sparkContext.broadcast(_filter_of(left))
    found = staged(_windows(mine, side, window, reworded, seen).withColumnRenamed("id", "doc_id").drop("n"), "windows")
    joined = balanced_join(found, left, ["h"], tasks, "inner", spread=F.xxhash64("doc_id", "at")).filter("drawn = i_drawn")
    shift = (F.col("at") - F.col("i_at")).alias("shift")
    exact = F.sum((~F.col("drawn") & (F.col("x") == F.col("i_x"))).cast("int")).alias("n_exact")
    span = F.max("i_at") - F.min("i_at") + window
    by_shift = joined.groupBy("doc_id", "item_id", "drawn", shift).agg(
        exact, F.sum(F.col("drawn").cast("int")).alias("n_template"), (F.max(F.col("drawn")) & (span >= F.least(F.lit(EVIDENCE), F.max("n")))).alias("telling")
    )
    sums = [F.sum(n).cast("int").alias(n) for n in ("n_exact", "n_template")]
    pairs = staged(by_shift.groupBy("doc_id", "item_id").agg(*sums, F.max("telling").alias("telling")), "pairs")
    if not reworded:
        return pairs.select("doc_id", "item_id", "n_exact", "n_template", F.lit(False).alias("consistent"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = side.value
        for batch in batches:
            out = []
            for d, i, text, passage, *marks in zip(*[c.to_pylist() for c in batch.columns]):
                templates = common or Templates(frozenset((marks[1] or []) + (marks[3] or [])), frozenset((marks[0] or []) + (marks[2] or [])))
                out += [(d, i, 0, 0, m[3]) for m in ItemWindows([(i, passage)], window, templates).compare(words_of(text))]
            if out:
                yield _batch(out)

    marks = lambda p: [] if common else [F.col(f"{p}.known").alias(f"{p}_known"), F.col(f"{p}.names").alias(f"{p}_names")]
    told = pairs.filter("telling").select("doc_id", "item_id")
    told = told.join(mine.alias("m"), F.col("doc_id").eqNullSafe(F.col("m.id"))).join(theirs.alias("t"), F.col("item_id").eqNullSafe(F.col("t.id")))
    told = told.select("doc_id", "item_id", F.col("m.text").alias("text"), F.col("t.text").alias("passage"), *marks("m"), *marks("t"))
    verdict = told.mapInArrow(run, _MATCH_DDL).groupBy(F.col("doc_id").alias("__d"), F.col("item_id").alias("__i")).agg(F.max("consistent").alias("consistent"))
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("item_id").eqNullSafe(F.col("__i"))
    out = pairs.join(verdict, same, "left")
    return out.select("doc_id", "item_id", "n_exact", "n_template", F.coalesce("consistent", F.lit(False)).alias("consistent"))


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, capital``: words in lower case; true for those that look like names, false where one doesn't."""
    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t]
        names = names_of(texts)
        small = {w.lower() for t in texts for w in words_of(t) if not w[0].isupper()}
        neutral = {w.lower() for t in texts for w in words_of(t)} - names - small  # only ever at the start of sentences
        words = [*names, *small, *neutral]
        flags = [True] * len(names) + [False] * len(small) + [None] * len(neutral)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(flags, pa.bool_())], names=["word", "capital"])


def shared_passages(matches: DataFrame) -> DataFrame:
    """``doc_id, item_id``: WINDOW or more consecutive words in common."""
    return matches.filter("n_exact > 0").select("doc_id", "item_id")


def template_leaks(matches: DataFrame) -> DataFrame:
    """``doc_id, item_id, kind, n_windows``: exact leaks and, where slots are consistent, re-parameterised ones."""
    kind = F.when(F.col("n_exact") > 0, "exact").otherwise("re-parameterised")
    return matches.filter("n_exact > 0 or consistent").select("doc_id", "item_id", kind.alias("kind"), F.col("n_template").alias("n_windows"))
