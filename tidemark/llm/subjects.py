"""Subject areas of documents: classifier chains over term, source and structure features.

1. Parsing.  Every text is cut into sentences of prose once; their word hashes are
   written to a table, which all further steps read.
2. Terms.  Labelled example sentences (a bounded table, see MAX_EXAMPLES) give first
   term weights.  Over all documents these name the subject of sentences, and every
   word n-gram is counted by the subject of the sentences *around* it (its own
   sentence has no say).  An n-gram that keeps to one subject's company belongs to
   it, also if no example has it; one that is frequent in any company and that no
   example has marks wording that treats nothing (fillers, passing mentions).
3. Features.  Per subject: how many sentences treat it and how many treat others
   (as soft indicators of each number), the number of sentences and the kind of text
   (structure), and how much more often than elsewhere the source treats it (source).
   No feature states the rule by which a document has a subject.
4. Chains.  One calibrated logistic regression per subject, each seeing the labels before
   it in its chain, is trained on documents composed of example sentences and labelled
   by what they were composed of.  Source, kind, length and the subjects that go
   together are those of a bounded sample of real documents (TEMPLATES); part of
   the sentences loses its wording (HIDDEN), so that the chain, source and structure
   have to speak where the wording does not.  A beam search decodes the most probable
   combination of labels over several chain orders.

The examples, templates and composed documents are bounded by documented parameters;
term counts and make-up by source are taken over all documents and never cut. A term
table of up to TRAVEL_TERMS n-grams travels with the tasks; a larger one is joined to the
sentences' n-grams, with the same result.

Defined cases: null, empty and blank texts, number tables and texts without prose
have no subject; repeated documents are each classified; a missing source counts as
one of its own; without examples or documents there are no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.encoding import spread
from tidemark.llm.leakage import clean
from tidemark.session import materialise

MAX_EXAMPLES = 20_000
#: Documents from which source, kind, length and subject counts of training documents are drawn.
TEMPLATES = 6_000
#: A term table of more n-grams than this does not travel with the tasks but is joined.
TRAVEL_TERMS = 2_000_000
NGRAMS = 3
ENOUGH = 3  # sentences that make a subject
#: Share of a training document's sentences whose wording tells nothing.
HIDDEN = 0.04
#: Texts parsed and documents classified at once.
DOCUMENTS = 1024

#: German month names and the word for times, after which a number's point ends no sentence; fixed values.
_ORDINAL = "Januar|Februar|März|Marz|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Mal|Quartal"
_END = re.compile(r"[.!?…)][\"”“'»)\]]*\s+(?=\S)")
_FOLLOWS_NUMBER = re.compile(rf"(?i:{_ORDINAL})\b")
_SHORT_DAY = re.compile(r"\d\d\.\d\d\.$")
_NOT_SMALL = re.compile(r"[^\W\d_a-z]")
_BULLETS = ">*#•-–|"
_PARAGRAPH = re.compile(r"\n\s*\n")
_LINE_END = re.compile("\r\n|[\r\x85\u2028\u2029]")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’.][^\W\d_]+)*")
_PLAIN_WORD = re.compile(r"[a-z]+(?:[-'.][a-z]+)*")
_DIGIT = re.compile(r"\d")


def sentences(text: str | None) -> list[str]:
    """Sentences of a text, markup and bullets removed; wrapped lines are joined again."""
    if not text or text.isspace():
        return []
    text = clean(_LINE_END.sub("\n", text) if _LINE_END.search(text) else text)
    out: list[str] = []
    for block in _PARAGRAPH.split(text) if "\n" in text else (text,):
        joined = ""
        for line in block.split("\n"):
            bare = line.strip()
            while bare and bare[0] in _BULLETS:
                bare = bare.lstrip(_BULLETS).lstrip()
            if not bare:
                continue
            wrapped = joined and joined[-1] not in ".!?:…)" and bare[0].islower()
            if wrapped:
                joined += " " + bare
            else:
                out += _split(joined)
                joined = bare
        out += _split(joined)
    return out


def _ends(text: str, m: re.Match) -> bool:
    """Whether a mark, closing quotes and blanks end a sentence: no day of a month, no ordinal number, no aside in brackets."""
    at, start = m.end(), m.start()
    if text[start] != ")" and not (
        text[start] == "." and text[start - 1 : start].isdigit() and (_SHORT_DAY.search(text, max(0, start - 5), start + 1) or (at == start + 2 and _FOLLOWS_NUMBER.match(text, at)))
    ):
        return True
    return m.group().rstrip()[-1] == ")" and _NOT_SMALL.match(text, at) is not None


def _split(text: str) -> list[str]:
    if not text:
        return []
    out, last = [], 0
    for m in _END.finditer(text):
        if _ends(text, m):
            out.append(text[last : m.start() + 1])
            last = m.end()
    out.append(text[last:])
    return out


_word_hashes: dict[str, int] = {}
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes_of(words: list[str]) -> np.ndarray:
    known = _word_hashes
    if len(known) > 1_000_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def prose_words(sentence: str) -> list[str] | None:
    """Words of a sentence in small letters; None unless it has three or more and more letters than digits."""
    small = sentence.lower()
    found = (_PLAIN_WORD if small.isascii() else _WORD).findall(small)
    if len(found) < 3:
        return None
    letters = sum(map(len, found))
    return found if 2 * letters > len(sentence) or letters > len(_DIGIT.findall(sentence)) else None


def is_prose(sentence: str) -> bool:
    return prose_words(sentence) is not None


def grams(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence number, hash) of every word n-gram, from word hashes and words per sentence.

    All sentences of a batch are hashed at once.  The two lowest bits of a hash tell the n-gram's length.
    """
    of = np.repeat(np.arange(len(lengths)), lengths)
    owners, hashes = [], []
    h = np.zeros(len(words), np.uint64)
    for n in range(1, NGRAMS + 1):
        if len(words) < n:
            break
        h = h[: len(words) - n + 1] * _MIX + words[n - 1 :]
        whole = of[: len(h)] == of[n - 1 :]
        mixed = (h[whole] ^ (h[whole] >> np.uint64(29))) * _MIX
        owners.append(of[: len(h)][whole])
        hashes.append(((mixed ^ (mixed >> np.uint64(32))) >> np.uint64(1)).astype(np.int64) & ~np.int64(3) | n)
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(owners), np.concatenate(hashes)


def _distinct(owner: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram of a sentence once."""
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    first = np.append(True, (np.diff(owner) != 0) | (np.diff(gram) != 0)) if len(owner) else np.empty(0, bool)
    return owner[first], gram[first]


class Keys:
    """Sorted n-gram hashes; most others are told apart by a bit table before the search."""

    def __init__(self, values) -> None:
        self.values = np.unique(np.fromiter(values, np.int64) if not isinstance(values, np.ndarray) else values)
        self.bits = 20
        while (1 << self.bits) < 16 * len(self.values) and self.bits < 26:
            self.bits += 1
        self.there = np.zeros(1 << self.bits, bool)
        self.there[self._slot(self.values)] = True

    def _slot(self, v: np.ndarray) -> np.ndarray:
        return (v >> 2) & ((1 << self.bits) - 1)

    def find(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in v of the values held, their places among the sorted values)."""
        maybe = np.flatnonzero(self.there[self._slot(v)]) if len(self.values) else np.empty(0, np.int64)
        at = np.searchsorted(self.values, v[maybe])
        at = np.minimum(at, max(len(self.values) - 1, 0))
        right = self.values[at] == v[maybe] if len(maybe) else np.empty(0, bool)
        return maybe[right], at[right]


class TermModel:
    """n-gram hash -> log odds of each subject over the even share; `idle` n-grams treat nothing."""

    def __init__(self, subjects: list[str], keys: np.ndarray, table: np.ndarray, idle: np.ndarray) -> None:
        order = np.argsort(keys)
        self.subjects, self.keys, self.table, self.idle = subjects, Keys(keys[order]), table[order].reshape(len(keys), len(subjects)), Keys(idle)

    def sums(self, owner: np.ndarray, gram: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """Per sentence: summed weights, n-grams that tell, trigrams, idle trigrams."""
        k = len(self.subjects)
        hit, at = self.keys.find(gram)
        who, place = _distinct(owner[hit], at)
        score = np.stack([np.bincount(who, self.table[place, s], n) for s in range(k)], axis=1) if k else np.zeros((n, 0))
        three = gram & 3 == 3
        idle, _ = self.idle.find(gram[three])
        return score, np.bincount(who, minlength=n), np.bincount(owner[three], minlength=n), np.bincount(owner[three][idle], minlength=n)

    def evidence(self, owner: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
        return evidence_of(*self.sums(owner, gram, n))


def evidence_of(score: np.ndarray, told: np.ndarray, threes: np.ndarray, idle: np.ndarray) -> np.ndarray:
    """(sentences, subjects): probability of each subject for each sentence; a row sums to less than 1, the rest is none."""
    score = score / np.sqrt(np.maximum(told, 1))[:, None]
    nothing = (told == 0) | ((threes > 0) & (2 * idle >= threes))
    most = np.maximum(score.max(axis=1, initial=0.0), NONE_SCORE)[:, None]
    e = np.exp(score - most)
    e /= e.sum(axis=1, keepdims=True) + np.exp(NONE_SCORE - most)
    e[nothing] = 0.0
    return e


#: Score of "treats nothing": what one n-gram with four fifths of its company in one subject reaches.
NONE_SCORE = 1.6
#: An n-gram tells its subject if so much of its company is one subject's, and is flat below the second share.
LEAST_SHARE, FLAT_SHARE = 0.6, 0.4


def hashed(parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    return _hashes_of([w for p in parts for w in p]), np.array([len(p) for p in parts], np.int64)


def first_terms(labels: list[str], parts: list[list[str]]) -> tuple[TermModel, np.ndarray]:
    """(term weights from labelled sentences, all their n-grams)."""
    subjects = sorted(set(labels))
    index = {s: i for i, s in enumerate(subjects)}
    owner, gram = _distinct(*grams(*hashed(parts)))
    keys, at = np.unique(gram, return_inverse=True)
    counts = np.zeros((len(keys), len(subjects)))
    np.add.at(counts, (at, np.array([index[s] for s in labels])[owner]), 1.0)
    share, odds = _log_odds(counts, 1.0)
    use = (counts.sum(axis=1) >= 2) & (share >= 0.7)
    return TermModel(subjects, keys[use], odds[use], np.empty(0, np.int64)), keys


def _log_odds(counts: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """(largest share, weights) of n-grams by their counts (n-grams, subjects)."""
    k = counts.shape[1]
    share = (counts + prior / k) / (counts.sum(axis=1, keepdims=True) + prior)
    return share.max(axis=1), np.log(share * k)


# --- parsing: once over all texts ---

PARSED = "doc_id bigint, source bigint, kind string, lengths array<int>, words array<bigint>"


def source_key(source: str | None) -> int:
    return xxhash.xxh64_intdigest(source or "") >> 1


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, source, kind, words per sentence, word hashes) of texts with prose."""
    for batch in batches:
        for lo in range(0, batch.num_rows, DOCUMENTS):
            part = batch.slice(lo, DOCUMENTS)
            cut = [[w for s in sentences(t) if (w := prose_words(s))] for t in part.column(1).to_pylist()]
            use = [i for i, c in enumerate(cut) if c]
            hashes, lengths = hashed([p for i in use for p in cut[i]])
            n = np.array([len(cut[i]) for i in use], np.int64)
            ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(n))] if len(use) else np.zeros(1, np.int64)
            sources, keys = part.column(2).to_pylist(), {}
            for i in use:
                if sources[i] not in keys:
                    keys[sources[i]] = source_key(sources[i])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(use, pa.int64())), pa.array([keys[sources[i]] for i in use], pa.int64()), part.column(3).take(pa.array(use, pa.int64())),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(lengths.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes.view(np.int64))),
                ],
                names=["doc_id", "source", "kind", "lengths", "words"],
            )


def parse(documents: DataFrame) -> DataFrame:
    """The parsed table of (doc_id, text, source, doc_kind), written once."""
    return materialise(documents.mapInArrow(_parse_batches, PARSED).withColumn("row", F.monotonically_increasing_id()), "sentences")


def _parts(batches: Iterator[pa.RecordBatch], lengths: int = 3) -> Iterator[tuple]:
    """(batch, document of each sentence, sentence of each n-gram, n-grams) in slices of a batch."""
    for batch in batches:
        for lo in range(0, batch.num_rows, DOCUMENTS):
            part = batch.slice(lo, DOCUMENTS)
            n, words = part.column(lengths), part.column(lengths + 1)
            of = np.repeat(np.arange(part.num_rows), n.value_lengths().to_numpy(zero_copy_only=False))
            owner, gram = grams(words.flatten().to_numpy().view(np.uint64), n.flatten().to_numpy())
            yield part, of, owner, gram


# --- terms: counts over all documents ---


def _count_batches(model: TermModel):
    """(gram, n per subject) of n-grams by the subject of the sentences around them, and documents of a source by subject."""
    k = len(model.subjects)
    schema = pa.schema([("kind", pa.string()), ("gram", pa.int64()), *[(f"n{i}", pa.float32()) for i in range(k)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {"gram": [], "source": []}  # (key, subject, n)

        def merged(kind: str) -> tuple[np.ndarray, np.ndarray]:
            keys, subject, n = (np.concatenate(c) for c in zip(*held[kind], strict=True))
            order = np.argsort(keys)
            keys = keys[order]
            new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
            keys = keys[new]
            return keys, np.bincount((np.cumsum(new) - 1) * k + subject[order], n[order], len(keys) * k).reshape(-1, k)

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if parts:
                    keys, table = merged(kind)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(keys)), pa.array(keys), *[pa.array(table[:, s].astype(np.float32)) for s in range(k)]], schema=schema)
                    parts.clear()

        for part, of, owner, gram in _parts(batches):
            seen = model.evidence(owner, gram, len(of))
            seen[(seen.max(axis=1, initial=0.0) < 0.5)[:, None] | (seen < 0.1)] = 0.0
            total = np.stack([np.bincount(of, seen[:, s], part.num_rows) for s in range(k)], axis=1)
            document, subject = np.nonzero(total >= ENOUGH - 0.5)
            held["source"].append((part.column(1).to_numpy()[document], subject, np.ones(len(document), np.float32)))
            near = np.zeros_like(seen)
            for d in (1, 2):
                same = of[d:] == of[:-d]
                near[d:][same] += seen[:-d][same]
                near[:-d][same] += seen[d:][same]
            around = near.sum(axis=1)
            near[around <= 0.5] = 0.0
            of_sentence, subject = np.nonzero(near)
            share = (near[of_sentence, subject] / around[of_sentence]).astype(np.float32)
            order = np.argsort(owner, kind="stable")  # a sentence's n-grams together
            per = np.bincount(owner, minlength=len(of))
            first = np.append(0, np.cumsum(per))[:-1]
            n = per[of_sentence]
            at = np.repeat(first[of_sentence] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
            held["gram"].append((gram[order[at]], np.repeat(subject, n), np.repeat(share, n)))
            size += len(at)
            if size > 4_000_000:
                yield from flush()
                size = 0
        yield from flush()

    return run


def corpus_counts(parsed: DataFrame, model: TermModel) -> DataFrame:
    """(kind, gram, n0, n1, ...) summed over all documents; n-grams that might tell or be idle only."""
    k = len(model.subjects)
    names = [f"n{i}" for i in range(k)]
    counted = parsed.mapInArrow(_count_batches(model), "kind string, gram bigint, " + ", ".join(f"{c} float" for c in names))
    summed = counted.groupBy("kind", "gram").agg(*[F.sum(c).alias(c) for c in names])
    return materialise(summed.where("kind <> 'gram' or " + " + ".join(names) + " >= 5"), "terms")


def _terms(counts: DataFrame, first: TermModel, known: np.ndarray) -> DataFrame:
    """(gram, idle, w0, w1, ...): the term table.  `known` are all n-grams of the examples (bounded by MAX_EXAMPLES).

    What examples had by chance keeps no single company and is left out; where both
    speak, examples say more than company does.
    """
    k = len(first.subjects)
    spark = counts.sparkSession
    odds = np.full((len(known), k), np.nan)
    odds[np.searchsorted(known, first.keys.values)] = first.table
    bounded = spark.createDataFrame(pa.table({"gram": known, "example": np.ones(len(known), bool), **{f"e{i}": odds[:, i] for i in range(k)}}))
    every = [F.col(f"n{i}") for i in range(k)]
    total, most = sum(every[1:], every[0]), F.greatest(*every) if k > 1 else every[0]
    j = counts.where("kind = 'gram'").join(bounded, "gram", "full_outer")
    counted, telling = F.col("kind").isNotNull(), most / total >= LEAST_SHARE
    idle = counted & (most / total <= FLAT_SHARE) & (total >= 8) & F.expr("gram & 3 = 3") & F.col("example").isNull()
    share = [(c + 2.0 / k) / (total + 2.0) for c in every]
    has = F.col("e0").isNotNull() & ~F.isnan("e0")
    weight = [F.when(counted, F.log(s * k) + F.when(has, 0.5 * F.col(f"e{i}")).otherwise(0.0)).otherwise(F.col(f"e{i}")) for i, s in enumerate(share)]
    j = j.where(F.when(counted, telling | idle).otherwise(has))
    return j.select("gram", F.coalesce(idle & ~telling, F.lit(False)).alias("idle"), *[w.alias(f"w{i}") for i, w in enumerate(weight)])


def _model(subjects: list[str], terms: DataFrame) -> TermModel:
    t = terms.toArrow()
    idle = t.column("idle").to_numpy()
    gram = t.column("gram").to_numpy()
    table = np.stack([t.column(f"w{i}").to_numpy() for i in range(len(subjects))], axis=1)
    return TermModel(subjects, gram[~idle], table[~idle], gram[idle])


# --- documents: features, chains, beam search ---

#: Numbers of sentences that have an indicator of their own; the last stands for more.
OWN, OTHERS = 5, 3


def _soft(n: np.ndarray, most: int) -> np.ndarray:
    """Indicators of 0, 1, ..., most, shared between the two next to n."""
    n = np.clip(n, 0, most)
    return np.maximum(0.0, 1.0 - np.abs(n[..., None] - np.arange(most + 1)))


def features(counts: np.ndarray, sentences_: np.ndarray, talk: np.ndarray, makeup: np.ndarray) -> np.ndarray:
    """(documents, subjects, features) from sentences that treat each subject, sentences, kind and source.

    talk: 1 for chats and threads; makeup: log of how much more often the source treats the subject.
    """
    n, k = counts.shape
    others = counts.sum(axis=1, keepdims=True) - counts
    shape = np.stack([np.log1p(sentences_), talk], axis=1)
    return np.concatenate([_soft(counts, OWN), _soft(others, OTHERS), np.repeat(shape[:, None], k, axis=1), makeup[..., None]], axis=2)


def makeup_of(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Log of how much more often than elsewhere a source treats each subject, from its documents by subject."""
    counts = np.nan_to_num(counts)
    share = (counts + 20 * prior) / (counts.sum(axis=1, keepdims=True) + 20)
    return np.log(share / prior)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 40) -> np.ndarray:
    """Weights (last: intercept) by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty * len(x))
    ridge[-1] = 1e-6 * len(x)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Chain:
    """One chain: its order, each link's weights over (own features, labels before it), its calibration."""

    order: list[int]
    links: list[np.ndarray]
    scales: list[tuple[float, float]]

    def probability(self, step: int, own: np.ndarray, before: np.ndarray) -> np.ndarray:
        """own: (documents, features), before: (documents, beams, labels so far); gives (documents, beams)."""
        w = self.links[step]
        f = own.shape[1]
        z = (own @ w[:f])[:, None] + before @ w[f:-1] + w[-1]
        a, b = self.scales[step]
        return 1.0 / (1.0 + np.exp(-np.clip(a * z + b, -30, 30)))


def train_chains(x: np.ndarray, y: np.ndarray, chains: int = 3, seed: int = 7) -> list[Chain]:
    """x: (documents, subjects, features), y: (documents, subjects); a fifth is held out for calibration."""
    rng = np.random.default_rng(seed)
    n, k = y.shape
    held = np.arange(n) % 5 == 4
    out = []
    for _ in range(chains):
        order = [int(i) for i in rng.permutation(k)]
        links, scales = [], []
        for step, s in enumerate(order):
            inputs = np.concatenate([x[:, s], y[:, order[:step]]], axis=1)
            w = _logistic(inputs[~held], y[~held, s])
            z = inputs[held] @ w[:-1] + w[-1]
            a, b = _logistic(z[:, None], y[held, s], penalty=1e-2) if 0 < y[held, s].sum() < held.sum() else (1.0, 0.0)
            links.append(w)
            scales.append((float(max(a, 0.1)), float(b)))
        out.append(Chain(order, links, scales))
    return out


def decode(chains: list[Chain], x: np.ndarray, width: int = 8) -> np.ndarray:
    """(documents, subjects) labels: each chain's beam search gives combinations, the best mean probability wins.

    x: (documents, subjects, features).  All documents of a batch move through the beams together.
    """
    n, k, _ = x.shape
    combos, scores = [], []
    for chain in chains:
        beams, logs = np.zeros((n, 1, 0)), np.zeros((n, 1))
        for step, s in enumerate(chain.order):
            p = np.clip(chain.probability(step, x[:, s], beams), 1e-9, 1 - 1e-9)
            logs = np.concatenate([logs + np.log(p), logs + np.log(1 - p)], axis=1)
            bit = np.concatenate([np.ones_like(p), np.zeros_like(p)], axis=1)[..., None]
            beams = np.concatenate([np.concatenate([beams, beams], axis=1), bit], axis=2)
            best = np.argsort(-logs, axis=1, kind="stable")[:, :width]
            logs = np.take_along_axis(logs, best, axis=1)
            beams = np.take_along_axis(beams, best[..., None], axis=1)
        labels = np.zeros_like(beams)
        labels[:, :, chain.order] = beams
        combos.append(labels)
        scores.append(np.exp(logs) / len(chains))
    combo, score = np.concatenate(combos, axis=1), np.concatenate(scores, axis=1)
    code = (combo @ (2.0 ** np.arange(k)) if k <= 50 else None)
    same = code[:, :, None] == code[:, None] if code is not None else (combo[:, :, None] == combo[:, None]).all(axis=3)
    total = (same * score[:, None]).sum(axis=2)
    return combo[np.arange(n), total.argmax(axis=1)]


def compose(examples: list[tuple[int, np.ndarray]], templates: tuple[np.ndarray, ...], k: int, documents: int = 2 * TEMPLATES, seed: int = 11):
    """Training documents of example sentences (subject, evidence), labelled by what they were made of.

    templates: (sentences per subject, sentences, talk, make-up) of real documents, drawn with
    replacement; their counts are moved by up to one sentence, so that all counts around the
    border of a subject occur.
    """
    rng = np.random.default_rng(seed)
    by = [np.array([e for s, e in examples if s == i]).reshape(-1, k) for i in range(k)]
    base, length, talk, makeup = templates
    drawn = rng.integers(0, len(base), documents)
    counts = np.rint(base[drawn]).astype(int)
    moved = np.where(rng.random(counts.shape) < 0.5, rng.integers(-1, 2, counts.shape), 0)
    counts = np.where(counts > 0, np.maximum(counts + moved, 0), 0)
    treated = counts.sum(axis=1, keepdims=True)
    y = (counts >= ENOUGH) | ((treated < ENOUGH) & (counts == treated) & (counts > 0))
    seen = np.zeros((documents, k))
    for s in range(k):
        who = np.repeat(np.arange(documents), counts[:, s])
        shown = rng.random(len(who)) >= HIDDEN
        rows = by[s][rng.integers(0, max(len(by[s]), 1), len(who))] if len(by[s]) else np.zeros((len(who), k))
        np.add.at(seen, who[shown], rows[shown])
    length = np.maximum(length[drawn], treated[:, 0])
    return features(seen, length, talk[drawn], makeup[drawn]), y.astype(float)


# --- whole corpus ---

TALK = ("chat", "thread")


def _shape(part: pa.RecordBatch, of: np.ndarray, first: int) -> tuple[np.ndarray, ...]:
    """(sentences, talk, make-up counts) of a batch; the source's counts stand from column `first` on."""
    talk = np.array([x in TALK for x in part.column(2).to_pylist()], float)
    own = np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(first, part.num_columns)], axis=1)
    return np.bincount(of, minlength=part.num_rows), talk, own


def _counts_of(model: TermModel):
    """Templates: (length, talk, source's counts..., sentences per subject...) of each document."""
    k = len(model.subjects)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, of, owner, gram in _parts(batches):
            seen = model.evidence(owner, gram, len(of))
            length, talk, own = _shape(part, of, 5)
            counts = np.stack([np.bincount(of, seen[:, s], part.num_rows) for s in range(k)], axis=1)
            data = np.column_stack([length, talk, own, counts]).astype(float)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, data.size + 1, data.shape[1]).astype(np.int32)), pa.array(data.ravel()))], names=["row"])

    return run


def _labelled(ids: pa.Array, seen: np.ndarray, of: np.ndarray, shape: tuple[np.ndarray, ...], subjects: list[str], chains: list[Chain], prior: np.ndarray) -> pa.RecordBatch:
    length, talk, own = shape
    counts = np.stack([np.bincount(of, seen[:, s], len(ids)) for s in range(len(subjects))], axis=1)
    use = np.unique(of[seen.max(axis=1, initial=0.0) >= 0.3])  # a text that treats nothing needs no chain
    docs, names = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(use):
        at, names = np.nonzero(decode(chains, features(counts[use], length[use], talk[use], makeup_of(own[use], prior))))
        docs = use[at]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(docs)), pa.array(subjects, pa.string()).take(pa.array(names))], names=["doc_id", "subject"])


def _label_batches(model: TermModel, chains: list[Chain], prior: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, of, owner, gram in _parts(batches):
            seen = model.evidence(owner, gram, len(of))
            yield _labelled(part.column(0), seen, of, _shape(part, of, 5), model.subjects, chains, prior)

    return run


def _explode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, sentence, gram) of all n-grams, each once a sentence; `row` is the first column."""
    for part, of, owner, gram in _parts(batches):
        start = np.searchsorted(of, np.arange(part.num_rows))
        ids = part.column(0).to_numpy()
        owner, gram = _distinct(owner, gram)
        yield pa.RecordBatch.from_arrays([pa.array(ids[of[owner]]), pa.array((owner - start[of[owner]]).astype(np.int32)), pa.array(gram)], names=["row", "sentence", "gram"])


def _joined_evidence(parsed: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(row, found: array of (sentence, told, threes, idle, weights)) by joining n-grams with the term table.

    A frequent n-gram's rows are split by AQE.
    """
    grams_ = parsed.select("row", "source", "kind", "lengths", "words").mapInArrow(_explode_batches, "row bigint, sentence int, gram bigint")
    j = grams_.join(terms, "gram", "left")
    tells, three = F.col("idle") == F.lit(False), F.expr("gram & 3 = 3").cast("long")
    sums = [F.sum(F.when(tells, F.col(f"w{i}")).otherwise(0.0)).alias(f"w{i}") for i in range(k)]
    s = j.groupBy("row", "sentence").agg(F.count_if(tells).alias("told"), F.sum(three).alias("threes"), F.count_if(F.col("idle")).alias("idle"), *sums)
    return s.groupBy("row").agg(F.collect_list(F.struct("sentence", "told", "threes", "idle", F.array(*[F.col(f"w{i}") for i in range(k)]).alias("w"))).alias("found"))


def _label_joined(subjects: list[str], chains: list[Chain], prior: np.ndarray):
    """Labels from (doc_id, source, kind, lengths, found, source's counts...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = batch.column(4), batch.column(3)
            per = n.value_lengths().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(batch.num_rows), per)
            flat = found.flatten()
            where = np.repeat(np.append(0, np.cumsum(per))[:-1], found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) + flat.field("sentence").to_numpy()
            sums = [np.zeros((len(of), len(subjects))), *(np.zeros(len(of)) for _ in range(3))]
            sums[0][where] = flat.field("w").flatten().to_numpy().reshape(-1, len(subjects))
            for i, name in enumerate(("told", "threes", "idle"), 1):
                sums[i][where] = flat.field(name).to_numpy()
            yield _labelled(batch.column(0), evidence_of(*sums), of, _shape(batch, of, 5), subjects, chains, prior)

    return run


def read_examples(examples: DataFrame) -> tuple[list[str], list[list[str]]]:
    """(subjects, words) of the labelled texts' sentences, at most MAX_EXAMPLES texts by id."""
    rows = examples.where("text is not null and subject is not null").orderBy("example_id").limit(MAX_EXAMPLES).select("subject", "text").collect()
    found = [(r.subject, w) for r in rows for s in sentences(r.text) if (w := prose_words(s))]
    return [s for s, _ in found], [w for _, w in found]


def label_subjects(documents: DataFrame, examples: DataFrame, travel_terms: int = TRAVEL_TERMS) -> DataFrame:
    """(doc_id, subject) of every document that treats a subject."""
    docs = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "doc_kind").where("text is not null"), "doc_id")
    labels, parts = read_examples(examples)
    if not labels:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, subject string")
    parsed = parse(docs)
    first, known = first_terms(labels, parts)
    subjects, k = first.subjects, len(first.subjects)
    counts = corpus_counts(parsed, first)
    names = [f"n{i}" for i in range(k)]
    by_source = materialise(counts.where("kind = 'source'").select(F.col("gram").alias("source"), *names), "sources")
    totals = np.array([x or 0.0 for x in by_source.agg(*[F.sum(c) for c in names]).first()])
    prior = (totals + 1.0) / (totals + 1.0).sum()
    with_source = parsed.join(by_source, "source", "left").select("doc_id", "source", "kind", "lengths", "words", *names, "row")

    terms = materialise(_terms(counts, first, known), "model")
    every = max(1, parsed.count() // TEMPLATES)
    sample = with_source.where(F.pmod(F.xxhash64("doc_id", "lengths"), F.lit(every)) == 0)  # the same however the texts are partitioned
    travels = terms.count() <= travel_terms
    model = _model(subjects, terms if travels else _terms_of(terms, sample, known))
    index = {s: i for i, s in enumerate(subjects)}
    owner, gram = grams(*hashed(parts))
    told = list(zip([index[s] for s in labels], model.evidence(owner, gram, len(parts)), strict=True))
    chains = train_chains(*compose(told, _templates(sample, model, prior), k))
    if travels:
        return with_source.drop("row").mapInArrow(_label_batches(model, chains, prior), "doc_id bigint, subject string")
    found = _joined_evidence(parsed, terms, k)
    joined = with_source.drop("words").join(found, "row").select("doc_id", "source", "kind", "lengths", "found", *names)
    return joined.mapInArrow(_label_joined(subjects, chains, prior), "doc_id bigint, subject string")


def _terms_of(terms: DataFrame, sample: DataFrame, known: np.ndarray) -> DataFrame:
    """The part of the term table that the examples and the sample of documents need (bounded by both)."""
    mine = sample.select("row", "source", "kind", "lengths", "words").mapInArrow(_explode_batches, "row bigint, sentence int, gram bigint").select("gram")
    examples = terms.sparkSession.createDataFrame(pa.table({"gram": pa.array(known)}))
    return terms.join(mine.union(examples).distinct(), "gram", "left_semi")


def _templates(sample: DataFrame, model: TermModel, prior: np.ndarray) -> tuple[np.ndarray, ...]:
    """(sentences per subject, sentences, talk, make-up) of the sampled documents."""
    k = len(model.subjects)
    rows = sample.drop("row").mapInArrow(_counts_of(model), "row array<double>").toArrow()
    data = rows.column("row").combine_chunks().flatten().to_numpy().reshape(-1, 2 * k + 2)
    data = data[np.lexsort(data.T)]  # rows come in any order
    # a subject that the sample lacks must be learned all the same
    plain = np.zeros((k, 2 * k + 2))
    plain[:, 0] = 4
    plain[np.arange(k), k + 2 + np.arange(k)] = ENOUGH
    data = np.concatenate([data, np.repeat(plain, max(1, len(data) // (50 * k)), axis=0)])
    return data[:, k + 2 :], data[:, 0], data[:, 1], makeup_of(data[:, 2 : k + 2], prior)
