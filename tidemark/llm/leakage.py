"""Evaluation texts leaking into training text: size-partitioned MinHash containment search.

Test items are short sets, documents long ones.  Both are cut into windows of
successive word shingles (five words), a window's MinHash is the least hash of
its shingles, and an item window is found in a document where a window of the same
size has the same MinHash.  Items are partitioned by size, which sets the window:

* items of 24 own words or more can leak with one word in eight edited; 24 words with
  three edits always keep six words in a row, so their windows have 2 shingles;
* shorter ones leak only by twelve words in a row: their windows have 8 shingles.

A window that survives intact has the same MinHash for certain, so the search
loses no leak; whatever else it brings is verified.  First comes exact containment:
some stretch of the item must have so many of its shingles in the document as a leak
leaves at least (all 8 of twelve words in a row, 5 of an edited stretch).
Then the shingles' places decide: a run of successive words, or an alignment.
Wording that several items share (eight words or more in a row, such as instructions)
is taken out of the items before; it is counted over all items, by a shuffle of their
window hashes.

Documents are only scanned, never shuffled.  The index of a block of at most
BLOCK_ITEMS items (some MB) and the words of the test items travel with the tasks; a larger
test set runs in blocks over documents that are turned into word numbers once.
What is found does not depend on the blocks.

Words are compared after: character references and markup removed, invisible
characters removed, compatibility forms folded, marks above letters dropped, case
folded; a word broken by a hyphen at a line's end is joined if that is a word of the
test items.

Defined cases: null, empty and short texts leak nothing; repeated document rows are found
each; items that are null or have fewer than twelve own words in a row cannot leak;
an item given twice would share all its wording with its copy, so copies are
indexed once and reported under each id; an id with several texts leaks by any of them.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.encoding import spread
from tidemark.session import materialise

SHINGLE = 5
RUN_WORDS = 12  # successive words that are a leak
STRETCH_WORDS, EDIT_SHARE = 24, 8  # words of a stretch, one of so many may be edited
SHARED_WORDS = 8  # wording of so many words in several items does not count
RUN_SHINGLES, STRETCH_SHINGLES = RUN_WORDS - SHINGLE + 1, 2 * STRETCH_WORDS - SHINGLE
#: Shingles that three edits leave of a stretch of 24 words.
LEAST_SHINGLES = STRETCH_WORDS - SHINGLE + 1 - SHINGLE * (STRETCH_WORDS // EDIT_SHARE)
#: Test items whose index travels at once.
BLOCK_ITEMS = 4096
_LOST = np.uint64(0xFFFFFFFFFFFFFFFF)

_BLOCK_TAG = re.compile(r"</?(?:p|br|div|li|ul|ol|td|tr|th|table|h[1-6]|hr|pre|blockquote|section|article)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_INVISIBLE = re.compile("[\xad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_WORD, _PLAIN_WORD = re.compile(r"[^\W_]+"), re.compile(r"[a-z0-9]+")
_HYPHEN_END = re.compile(r"[-\u2010\u2011][ \t]*[\n\x85\u2028]")
_BROKEN = re.compile(r"([^\W_]+)[-\u2010\u2011][ \t]*[\n\x85\u2028]\s*(?:[>|*#]\s*)*([^\W_]+)")


def clean(text: str) -> str:
    """Text without markup, invisible characters, compatibility forms and marks above letters; case and lines kept."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text))
    marks = [ord(c) for c in set(text) if unicodedata.combining(c)]
    return text.translate(dict.fromkeys(marks)) if marks else text


def fold(text: str) -> str:
    """Text in which only what counts is left."""
    return clean(text).casefold()


def words(text: str, known=None) -> list[str]:
    """Words in comparable form; words broken at a line's end are joined if `known` holds them."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = fold(text)
    if known is not None and _HYPHEN_END.search(text):
        text = _BROKEN.sub(lambda m: m[1] + m[2] if m[1] + m[2] in known else f"{m[1]} {m[2]}", text)
    return (_PLAIN_WORD if text.isascii() else _WORD).findall(text)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(ids: np.ndarray) -> np.ndarray:
    """Hash of each run of five word numbers; windows with a number below 0 get _LOST."""
    n = len(ids) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = h * np.uint64(0x100000001B3) + (ids[k : k + n] + 3).astype(np.uint64)
    h = _mix(h)
    bad = np.convolve(ids < 0, np.ones(SHINGLE, int), "valid") > 0
    h[bad] = _LOST
    return h


def window_minima(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(MinHash of each window of `size` shingles, whether all its shingles are known)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    least = hashes[:n].copy()
    most = hashes[:n].copy()
    for k in range(1, size):
        np.minimum(least, hashes[k : k + n], out=least)
        np.maximum(most, hashes[k : k + n], out=most)
    return least, most != _LOST


def numbers(text: str | None, vocabulary: dict[str, int]) -> list[int]:
    """Word numbers of a text, -1 for words that no test item has."""
    get = vocabulary.get
    return [get(w, -1) for w in words(text, vocabulary)] if text else []


def window_hashes(item: list[str]) -> list[int]:
    """Hash of each run of SHARED_WORDS words."""
    return [xxhash.xxh64_intdigest("\x1f".join(item[p : p + SHARED_WORDS])) - (1 << 63) for p in range(len(item) - SHARED_WORDS + 1)]


def _matches(values: np.ndarray, wanted: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equi-join of wanted[at] with sorted values: (positions in wanted, places among the values)."""
    if not len(at) or not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lo = np.searchsorted(values, wanted[at], "left")
    hit = values[np.minimum(lo, len(values) - 1)] == wanted[at]
    at, lo = at[hit], lo[hit]
    n = np.searchsorted(values, wanted[at], "right") - lo
    return np.repeat(at, n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


class ItemIndex:
    """Word numbers, own shingles and window MinHashes of a block of test items.

    items: (id, words, where runs of SHARED_WORDS words begin that other items have too).
    """

    def __init__(self, items: list[tuple[int, list[str], list[int]]], vocabulary: dict[str, int]) -> None:
        self.ids = [i for i, _, _ in items]
        self.vocabulary = vocabulary
        self.items: list[np.ndarray] = []
        self.shingles: list[np.ndarray] = []
        entries: dict[int, list[tuple[int, int]]] = {2: [], RUN_WORDS - SHINGLE + 1: []}
        for k, (_, w, shared) in enumerate(items):
            ids = np.array([vocabulary[x] for x in w], dtype=np.int64)
            for p in shared:
                ids[p : p + SHARED_WORDS] = -2
            hashes = shingle_hashes(ids)
            self.items.append(ids)
            self.shingles.append(hashes)
            size = 2 if (ids >= 0).sum() >= STRETCH_WORDS else RUN_WORDS - SHINGLE + 1
            least, whole = window_minima(hashes, size)
            entries[size] += [(int(v), k) for v in np.unique(least[whole])]
        self.tables = {}
        for size, pairs in entries.items():
            pairs.sort()
            self.tables[size] = (np.array([v for v, _ in pairs], dtype=np.uint64), np.array([k for _, k in pairs], dtype=np.int64))
        n = np.array([len(h) for h in self.shingles], np.int64)
        every = np.concatenate([*self.shingles, np.empty(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        order = order[every[order] != _LOST]
        self.exact = every[order], np.repeat(np.arange(len(n)), n)[order], (np.arange(len(every)) - np.repeat(np.cumsum(n) - n, n))[order]
        self.long = np.array([(ids >= 0).sum() >= STRETCH_WORDS for ids in self.items], bool)

    def candidates(self, hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Distinct (document, item) with a window of the same MinHash, by size partition; `of`: document of each shingle."""
        found = []
        for size, (values, owner) in self.tables.items():
            least, whole = window_minima(hashes, size)
            at, each = _matches(values, least, np.flatnonzero(whole))
            found.append(np.column_stack([of[at], owner[each]]))
        return np.unique(np.concatenate(found), axis=0)

    def contained(self, hashes: np.ndarray, of: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """The candidates of which a stretch of the item has enough of its exact shingles in the document."""
        values, item, place = self.exact
        wanted = np.zeros(of[-1] + 1 if len(of) else 0, bool)
        wanted[pairs[:, 0]] = True
        at, each = _matches(values, hashes, np.flatnonzero(wanted[of[: len(hashes)]] & (hashes != _LOST)))
        span = len(self.items) + 1
        key, keys = of[at] * span + item[each], pairs[:, 0] * span + pairs[:, 1]
        known = np.isin(key, keys)
        key, p = key[known], place[each][known]
        order = np.lexsort((p, key))
        key, p = key[order], p[order]
        new = np.append(True, (key[1:] != key[:-1]) | (p[1:] != p[:-1]))[: len(key)]
        key, p = key[new], p[new]
        held = []
        for n, window, use in ((RUN_SHINGLES, RUN_SHINGLES, np.ones(len(key), bool)), (LEAST_SHINGLES, STRETCH_SHINGLES, self.long[key % span] if len(key) else np.empty(0, bool))):
            a, z = np.arange(len(key) - n + 1), np.arange(n - 1, len(key))
            held.append(key[a][(key[a] == key[z]) & (p[z] - p[a] < window) & use[a]])
        return pairs[np.isin(keys, np.concatenate(held))]

    def leaks_of(self, texts: list[list[int]]) -> list[tuple[int, int, int]]:
        """(text, item id, words) of the items that each text of word numbers leaks; words: the longest run, or the stretch's length.

        All texts are hashed at once; an unknown word between them keeps windows inside texts.
        """
        length = np.array([len(t) + 1 for t in texts], np.int64)
        starts = np.append(0, np.cumsum(length))
        every = np.full(starts[-1], -1, np.int64)
        for t, at in zip(texts, starts, strict=False):
            every[at : at + len(t)] = t
        hashes = shingle_hashes(every)
        of = np.repeat(np.arange(len(texts)), length)
        out = []
        for d, k in self.contained(hashes, of, self.candidates(hashes, of)).tolist():
            lo, hi = starts[d], starts[d + 1] - 1
            held = self.verify(every[lo:hi], hashes[lo : max(lo, hi - SHINGLE + 1)], k)
            if held:
                out.append((d, self.ids[k], held))
        return out

    def leaks(self, text: str | None) -> list[tuple[int, int]]:
        """(item id, words) of the items that one text leaks."""
        return [(i, n) for _, i, n in self.leaks_of([numbers(text, self.vocabulary)])]

    def verify(self, doc: np.ndarray, hashes: np.ndarray, k: int) -> int:
        """Words of the leak of a candidate, 0 if there is none: a run or a stretch."""
        own = self.shingles[k]
        at = np.flatnonzero(np.isin(hashes, own[own != _LOST]))
        if not len(at):
            return 0
        order = np.argsort(own, kind="stable")
        lo, hi = np.searchsorted(own[order], hashes[at], "left"), np.searchsorted(own[order], hashes[at], "right")
        i = np.repeat(at, hi - lo)
        j = np.concatenate([order[a:b] for a, b in zip(lo, hi, strict=True)])
        by = np.lexsort((i, i - j))
        i, j = i[by], j[by]
        start = np.append(True, (np.diff(i) != 1) | (np.diff(i - j) != 0))
        first = np.flatnonzero(start)
        longest = int(np.diff(np.append(first, len(i))).max()) + SHINGLE - 1
        if longest >= RUN_WORDS:
            return longest
        if (self.items[k] >= 0).sum() < STRETCH_WORDS:
            return 0
        for lo_, hi_ in dense_regions(i, j):
            held = edited_stretch(self.items[k], doc[max(0, lo_ - STRETCH_WORDS) : hi_ + 2 * STRETCH_WORDS])
            if held:
                return held
        return 0


#: A stretch of fewer than 48 words has at most five edits: its shingles lie so far apart at most, on diagonals so far apart.
_REACH, _DRIFT = 2 * STRETCH_WORDS + 2 * STRETCH_WORDS // EDIT_SHARE, 2 * STRETCH_WORDS // EDIT_SHARE


def dense_regions(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of document positions in which a stretch can lie, from matches (i in the document, j in the item).

    A stretch keeps at least five of its shingles within a small box of position and
    diagonal.  Four shifted grids of cells twice that size hold every such box whole.
    """
    found = set()
    for a in (0, 1):
        for b in (0, 1):
            row, col = (i - j + a * _DRIFT) // (2 * _DRIFT), (i + b * _REACH) // (2 * _REACH)
            cells = np.unique(np.column_stack([row, col, j]), axis=0)[:, :2]
            cells, n = np.unique(cells, axis=0, return_counts=True)
            for c in cells[n >= LEAST_SHINGLES, 1]:
                found.add((int(c) * 2 * _REACH - b * _REACH, (int(c) + 1) * 2 * _REACH - b * _REACH))
    return sorted(found)


def edited_stretch(item: np.ndarray, region: np.ndarray) -> int:
    """Length of a stretch of the item found in region with few enough edits, 0 if none.

    A stretch begins and ends with a kept word.  One of 48 words or more has a half that
    qualifies too, so lengths below that are enough.
    """
    m, n = len(item), len(region)
    if m < STRETCH_WORDS or n == 0:
        return 0
    starts = np.arange(m - STRETCH_WORDS + 1)
    starts = starts[item[starts] >= 0]
    if not len(starts):
        return 0
    far = 1000
    steps = np.arange(n + 1)
    cost = np.full((len(starts), n + 1), far)
    cost[:, 1:][item[starts][:, None] == region[None, :]] = 0  # the first word is kept
    for r in range(2, 2 * STRETCH_WORDS):
        at = starts + r - 1
        inside = at < m
        if not inside.any():
            break
        word = np.where(inside, item[np.minimum(at, m - 1)], -9)
        same = (word[:, None] == region[None, :]) & (word >= 0)[:, None]
        if r >= STRETCH_WORDS and (same & (cost[:, :-1] <= r // EDIT_SHARE)).any():
            return r
        following = cost + 1  # the item's word dropped
        np.minimum(following[:, 1:], cost[:, :-1] + ~same, out=following[:, 1:])
        cost = np.minimum.accumulate(following - steps, axis=1) + steps  # words inserted
        if cost.min() > 2 * STRETCH_WORDS // EDIT_SHARE:
            break
    return 0


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, words)"""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["item", "words"])


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, at, window) of every run of SHARED_WORDS words"""
    for batch in batches:
        items, at, hashes = [], [], []
        for item, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = window_hashes(w)
            items += [item] * len(h)
            at += range(len(h))
            hashes += h
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(at, pa.int32()), pa.array(hashes, pa.int64())], names=["item", "at", "window"])


def prepare_items(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(item, words, shared: where runs begin that other items have too) of distinct texts, and (item, copy): the ids of each text."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    cut = materialise(rows.mapInArrow(_cut_batches, "item bigint, words array<string>").distinct(), "items")
    digest = F.xxhash64(F.concat_ws("\x1f", "words"), F.size("words"))
    one = cut.withColumn("text", digest)
    first = one.groupBy("text").agg(F.min("item").alias("item"))
    copies = one.join(first, "text").select(first["item"], one["item"].alias("copy"))
    texts = one.join(first, ["text", "item"], "left_semi").select("item", "words")
    windows = texts.mapInArrow(_window_batches, "item bigint, at int, window bigint")
    shared = windows.groupBy("window").agg(F.min("item").alias("a"), F.max("item").alias("z")).where("a <> z")
    marks = windows.join(shared, "window", "left_semi").groupBy("item").agg(F.array_sort(F.collect_list("at")).alias("shared"))  # at most an item's words
    return materialise(texts.join(marks, "item", "left"), "items"), copies


def item_blocks(prepared: DataFrame) -> Iterator[list[tuple[int, list[str], list[int]]]]:
    """Prepared items in blocks of bounded size."""
    block: list[tuple[int, list[str], list[int]]] = []
    for r in prepared.toLocalIterator():
        block.append((r.item, r.words, r.shared or []))
        if len(block) == BLOCK_ITEMS:
            yield block
            block = []
    if block:
        yield block


def read_vocabulary(prepared: DataFrame) -> dict[str, int]:
    """A number for each word of the test items."""
    rows = prepared.select(F.explode("words").alias("w")).distinct().orderBy("w").toArrow()
    return {w: n for n, w in enumerate(rows.column("w").to_pylist())}


def _number_batches(vocabulary: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([numbers(t, vocabulary) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "numbers"])

    return run


def _scan(index: ItemIndex, numbered: bool):
    """Leaks of (doc_id, text), or of (doc_id, word numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(1).to_pylist()
                found = index.leaks_of(texts if numbered else [numbers(t, index.vocabulary) for t in texts])
                docs, items, held = ([f[i] for f in found] for i in range(3))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(docs, pa.int64())), pa.array(items, pa.int64()), pa.array(held, pa.int64())], names=["doc_id", "item", "words"])

    return run


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, words) of every test item that a document leaks."""
    docs = spread(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null"), "doc_id")
    prepared, copies = prepare_items(items, item_id, item_text)
    vocabulary = read_vocabulary(prepared)
    numbered = prepared.count() > BLOCK_ITEMS
    if numbered:
        docs = materialise(docs.mapInArrow(_number_batches(vocabulary), "doc_id bigint, numbers array<int>"), "numbers")
    found = None
    for block in item_blocks(prepared):
        part = docs.mapInArrow(_scan(ItemIndex(block, vocabulary if not numbered else _part(vocabulary, block)), numbered), "doc_id bigint, item bigint, words bigint")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, words bigint")
    return found.join(copies, "item").select("doc_id", F.col("copy").alias("item_id"), "words")


def _part(vocabulary: dict[str, int], block: list[tuple[int, list[str], list[int]]]) -> dict[str, int]:
    """The words of a block; documents are numbered already."""
    return {w: vocabulary[w] for _, words_, _ in block for w in words_}
