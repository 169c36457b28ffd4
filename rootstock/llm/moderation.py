"""Scores for abusive, hateful or sexually explicit wording, by weak supervision.

1. Voters (`rootstock.llm.wordings`) look at every sentence of every document.  What they voted is stored with the
   sentence's hashed words, two bytes each.
2. A generative label model is fitted to the counts of all vote patterns: it estimates how often each voter
   speaks up in harmless, abusive, hateful, sexual and menacing sentences, finds voters that are correlated given the class and models
   these together, so that they don't count twice.
3. A linear classifier over words, word pairs and votes learns the model's posterior labels on a bounded sample.
4. It judges every sentence, with votes or without; a document's score is the greatest probability among them.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootstock.functions.storage import keep
from rootstock.llm.text import words
from rootstock.llm.wordings import AGAINST, CATEGORIES, LABELS, NAMES, SUPPORTS, WEAK, closed, judged, sentences, votes

#: Bounds of what is fitted on the driver; neither changes what is scored.
SAMPLE_ROWS = 20_000
LABELLED_ROWS = 10_000
#: Vote patterns that the driver works through, BLOCK at a time; more are left to the executors, with the same results.
AT_ONCE = 1 << 16
BLOCK = 1 << 12
#: Bound of `_patterns`, which nothing is fitted on.
PATTERNS = 1 << 20
#: Rows per class that stand for what is known of voters beforehand.
PRIOR = 20
_DIM = 1 << 15


# --- label model


@dataclass
class LabelModel:
    """Class priors and, per group of correlated voters, the probability of each joint vote in each class; class 0 is harmless."""

    priors: np.ndarray
    groups: list[list[int]]
    tables: list[np.ndarray]
    #: Per voter: the probability that it is right when it speaks up, classes taken as equally frequent.
    accuracies: np.ndarray | None = None
    #: Residual correlation of voters within classes, before grouping.
    correlations: np.ndarray | None = None

    def cells(self, masks: np.ndarray) -> list[np.ndarray]:
        return [sum((((masks >> j) & 1) << i) for i, j in enumerate(g)) for g in self.groups]

    def classes(self, masks: Sequence[int]) -> np.ndarray:
        """Probability of each class, by row."""
        m = np.asarray(masks, np.int64)
        log = np.tile(np.log(self.priors), (len(m), 1))
        for cells, table in zip(self.cells(m), self.tables, strict=True):
            log += np.log(table).T[cells]
        e = np.exp(log - log.max(axis=1, keepdims=True, initial=-1e9))
        return e / e.sum(axis=1, keepdims=True)

    def posterior(self, masks: Sequence[int]) -> np.ndarray:
        """Probability that a passage with these votes isn't harmless."""
        return 1 - self.classes(masks)[:, 0]


def fit_label_model(patterns: Mapping[int, int] | DataFrame, labelled: Sequence[tuple[int, Sequence[int]]], supports: np.ndarray, weak: np.ndarray, correlated: float = 0.3, rounds: int = 60) -> LabelModel:
    """EM over pattern counts, a frame (votes, n) where there are many, with labelled rows (votes, possible classes) beside them.

    supports[c, j]: voter j speaks for class c; weak[j]: it says little alone.  EM starts from a vote of the majority:
    where voters that aren't weak speak against harmlessness and no more of them for it, the classes that most of
    these support, and harmlessness elsewhere.  From then on every rate is estimated, also how often voters err in harmless
    sentences; nothing is fixed, but PRIOR rows per class are added in which its voters speak up in 30 %, others in 1 % and weak ones in 5 %.  Labelled rows weigh together as much as the sentences that speak against
    harmlessness, at least one each, so that a class stays what its labelled rows show.  First all voters are
    independent given the class; pairs whose residuals then correlate by more than `correlated` are put in one group (at most four
    voters), and EM runs again over groups.
    """
    k, m = supports.shape
    added = _adder(patterns)
    masks = np.array([v for v, _ in labelled], np.int64)
    known = np.array([[c in cs for c in range(k)] for _, cs in labelled], bool).reshape(-1, k)
    bad = added(lambda v, n: np.array([n[_majority(supports, weak, v)[1]].sum()]))[0]
    weight = np.full(len(labelled), max(1.0, bad / max(1, len(labelled))))
    rows = masks, weight, known
    alone = [[j] for j in range(m)]
    start = np.where(supports, 0.3, np.where(weak, 0.05, 0.01))
    model = _em(LabelModel(np.full(k, 1 / k), alone, _joint(alone, start)), added, rows, rounds, _joint(alone, start), lambda v: _majority(supports, weak, v)[0])
    fires = np.stack([t[:, 1] for t in model.tables], axis=1)
    # Sums of (vote - rate) * (vote - rate) over rows and classes, multiplied out.
    spoken, q = _votes(masks, m), _possible(model.classes(masks), known) * weight[:, None]
    seen = _masses(added, model, model.classes)
    mass, fired = seen[0].sum(axis=1) + q.sum(axis=0), np.stack([n[:, 1] for n in seen], axis=1) + q.T @ spoken
    cov = added(partial(_together, m)).reshape(m, m) + (spoken * weight[:, None]).T @ spoken
    cov -= fires.T @ fired + fired.T @ fires - (fires * mass[:, None]).T @ fires
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    corr = cov / np.outer(sd, sd)
    groups = [[j] for j in range(m)]
    pairs = [(a, b) for a in range(m) for b in range(a) if abs(corr[a, b]) > correlated and not weak[a] and not weak[b]]
    for a, b in sorted(pairs, key=lambda x: -abs(corr[x])):
        ga, gb = next(g for g in groups if a in g), next(g for g in groups if b in g)
        if ga is not gb and len(ga) + len(gb) <= 4:
            groups.remove(gb)
            ga += gb
    joint = _em(LabelModel(model.priors, groups, _joint(groups, fires)), added, rows, rounds, _joint(groups, start))
    joint.accuracies = (fires * supports).max(axis=0) / ((fires * supports).max(axis=0) + (fires * ~supports).max(axis=0))
    joint.correlations = corr
    return joint


def _adder(patterns: Mapping[int, int] | DataFrame) -> Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]:
    """Adds up over all patterns what a function makes of their votes and counts: here or, of a frame, on the executors."""
    if not isinstance(patterns, DataFrame):
        masks, counts = np.array([*patterns], np.int64), np.array([*patterns.values()], float)
        return lambda f: sum(f(masks[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, max(1, len(masks)), BLOCK))

    def added(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = sum(f(b.column(0).to_numpy(), b.column(1).to_numpy().astype(float)) for b in batches)
            if np.ndim(sums):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums, pa.float64())], names=["place", "value"])

        rows = patterns.select("votes", "n").mapInArrow(part, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        return np.array([r["value"] for r in sorted(rows, key=lambda r: r["place"])])

    return added


def _votes(masks: np.ndarray, m: int) -> np.ndarray:
    return ((masks[:, None] >> np.arange(m)) & 1).astype(float)


def _majority(supports: np.ndarray, weak: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each class by a vote of the majority, and whether that is against harmlessness, by row."""
    k, m = supports.shape
    strong = _votes(masks, m) * ~weak
    spoken = (strong @ supports[1:].T).max(axis=1) if k > 1 else np.zeros(len(masks))
    bad = (spoken > 0) & (spoken >= strong @ supports[0])
    q = np.zeros((len(masks), k))
    best = (strong @ supports.T) == np.maximum(spoken, 0.5)[:, None]
    best[:, 0] = False
    q[:, 0] = 1.0
    q[bad] = np.c_[np.full(bad.sum(), 0.2), 0.8 * best[bad, 1:] / best[bad, 1:].sum(axis=1, keepdims=True)] if k > 1 else 1.0
    q += 1e-9
    return q / q.sum(axis=1, keepdims=True), bad


def _together(m: int, masks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each two of m voters spoke up together."""
    votes_of = _votes(masks, m)
    return ((votes_of * counts[:, None]).T @ votes_of).ravel()


def _mass(of: Callable[[np.ndarray], np.ndarray], model: LabelModel, masks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each joint vote of each group came in each class, in three parts: multiples of 2^-16, 2^-32 and 2^-48.

    Sums of such over up to 2^37 sentences are exact, so neither order nor parting of the patterns changes them.
    """
    q, parts = of(masks), []
    for bits in (16, 32, 48):
        parts.append(np.rint(q * 2.0**bits) / 2.0**bits)
        q = q - parts[-1]
    weights = np.concatenate(parts, axis=1).T * counts
    came = np.concatenate([c == np.arange(1 << len(g))[:, None] for g, c in zip(model.groups, model.cells(masks), strict=True)])
    return (weights @ came.T.astype(float)).ravel()


def _masses(added: Callable, model: LabelModel, of: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """Per group of the model the sum over all patterns, by class and joint vote; `of` gives the classes of votes."""
    k = len(model.priors)
    found = added(partial(_mass, of, model)).reshape(3, k, -1).sum(axis=0)
    return np.split(found, np.cumsum([1 << len(g) for g in model.groups])[:-1], axis=1)


def _joint(groups: Sequence[Sequence[int]], rates: np.ndarray) -> list[np.ndarray]:
    """Tables of groups whose voters speak up independently at these rates, by class."""
    tables = []
    for g in groups:
        cells = np.arange(1 << len(g))
        tables.append(np.prod([np.where((cells >> i) & 1, rates[:, [j]], 1 - rates[:, [j]]) for i, j in enumerate(g)], axis=0))
    return tables


def _possible(q: np.ndarray, known: np.ndarray) -> np.ndarray:
    q = q * known
    return q / q.sum(axis=1, keepdims=True)


def _em(model: LabelModel, added: Callable, labelled: tuple[np.ndarray, np.ndarray, np.ndarray], rounds: int, prior: list[np.ndarray], first: Callable[[np.ndarray], np.ndarray] | None = None) -> LabelModel:
    """Begins with the classes by `first` where given; labelled: votes, weights, possible classes. PRIOR rows distributed as `prior` are added to each class; class priors come from unlabelled rows, a tenth of a row per class added."""
    masks, weight, known = labelled
    cells, k = model.cells(masks), len(model.priors)
    for _ in range(rounds):
        of, first, tables = first or model.classes, None, []
        seen, mass = _masses(added, model, of), _possible(of(masks), known) * weight[:, None]
        for g, c, n, before in zip(model.groups, cells, seen, prior, strict=True):
            n = n + np.stack([np.bincount(c, mass[:, i], 1 << len(g)) for i in range(k)]) + PRIOR * before
            tables.append(n / n.sum(axis=1, keepdims=True))
        free = seen[0].sum(axis=1) + 0.1
        model = LabelModel(free / free.sum(), model.groups, tables)
    return model


# --- linear classifier


class _Codes(dict):
    """Hash of a word below _DIM, by the word."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh32_intdigest(word) % _DIM
        return h


_codes = _Codes()


def word_codes(text: str) -> np.ndarray:
    return np.fromiter(map(_codes.__getitem__, words(text)), np.uint16)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Codes of neighbouring words, from _DIM."""
    return _DIM + ((a.astype(np.int64) * 40_503 + b.astype(np.int64) * 9_973 + 7) >> 3) % _DIM


@dataclass(frozen=True)
class Classifier:
    """Logistic regression over counts of words and word pairs, and votes; `threshold` was chosen on labelled rows."""

    weights: np.ndarray
    bias: float
    threshold: float = 0.5

    def scores(self, masks: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Of sentences, given their votes and numbers of words and all words in a row."""
        z = self.bias + ((masks[:, None] >> np.arange(len(NAMES))) & 1) @ self.weights[2 * _DIM :]
        if len(codes):
            each = self.weights[codes]
            each[1:] += self.weights[_pairs(codes[:-1], codes[1:])]
            some = lengths > 0
            begins = (np.cumsum(lengths, dtype=np.int64) - lengths)[some]
            # A sentence's first word has no pair.
            inner = begins[begins > 0]
            each[inner] = self.weights[codes[inner]]
            z[some] += np.add.reduceat(each, begins)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def score(self, mask: int, codes: np.ndarray) -> float:
        return float(self.scores(np.array([mask], np.int64), np.array([len(codes)]), codes)[0])

    @property
    def nothing(self) -> float:
        """Score of a text without words."""
        return float(1 / (1 + np.exp(-self.bias)))


def fit_classifier(rows: Sequence[tuple[int, np.ndarray]], targets: np.ndarray, weights: np.ndarray, penalty: float = 2e-4, rounds: int = 300, rate: float = 0.05) -> Classifier:
    """Soft-label logistic regression by Adam over all rows (votes, word codes) at once."""
    found = [np.r_[c.astype(np.int64), _pairs(c[:-1], c[1:]), 2 * _DIM + np.flatnonzero((v >> np.arange(len(NAMES))) & 1)] for v, c in rows]
    row = np.repeat(np.arange(len(rows)), [len(f) for f in found])
    column = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
    size = 2 * _DIM + len(NAMES)
    w, b, share = np.zeros(size), 0.0, weights / weights.sum()
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    # A vote is seen more often than a word; words are pulled to zero harder, so that they add to votes rather than replace them.
    pull = np.where(np.arange(size) < 2 * _DIM, penalty * 10, penalty)
    for k in range(1, rounds + 1):
        z = b + np.bincount(row, w[column], len(rows))
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - targets) * share
        g = np.bincount(column, e[row], size) + pull * w
        gb = e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.999**k)) + 1e-8)
    return Classifier(w, b)


def threshold_of(scores: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the widest gap between scores with the best F1, from 0.2 to 0.8; 0.5 without labelled rows of both classes."""
    if not len(scores) or bad.all() or not bad.any():
        return 0.5
    cuts = np.unique(np.r_[0.2, scores[(scores > 0.2) & (scores < 0.8)], 0.8])
    best = (-1.0, 0.0, 0.5)
    for low, high in zip(cuts, cuts[1:], strict=False):
        t = (low + high) / 2
        hit = (scores >= t) & bad
        f1 = 2 * hit.sum() / max(1, (scores >= t).sum() + bad.sum())
        best = max(best, (float(f1), float(high - low), float(t)))
    return best[2]


# --- operator


class _Looker:
    """What voters and classifier need of a text, packed; lines and sentences met before, as in revisions of a page, aren't looked at again."""

    def __init__(self):
        self._sentences: dict[str, tuple[int, int, bytes]] = {}
        self._lines: dict[str, tuple[bytes, bytes, bytes]] = {}

    def _sentence(self, sentence: str) -> tuple[int, int, bytes]:
        if len(self._sentences) > 1 << 16:
            self._sentences.clear()
        mask, _, found = judged(sentence)
        self._sentences[sentence] = out = (mask, len(found), array("H", map(_codes.__getitem__, found)).tobytes())
        return out

    def _line(self, text: str) -> tuple[bytes, bytes, bytes]:
        met = self._sentences
        found = [met.get(s) or self._sentence(s) for s in sentences(text)]
        return array("q", [m for m, _, _ in found]).tobytes(), array("i", [n for _, n, _ in found]).tobytes(), b"".join([c for _, _, c in found])

    def __call__(self, text: str | None) -> bytes:
        # Sentences end at line ends, so a text whose lines are closed is read line by line.
        parts, met = [], self._lines
        for line in text.split("\n") if text else ():
            if (found := met.get(line)) is None:
                if not closed(line):
                    parts = [self._line(text)]
                    break
                if len(met) > 1 << 16:
                    met.clear()
                met[line] = found = self._line(line)
            if found[0]:
                parts.append(found)
        masks, lengths, codes = (b"".join([x[i] for x in parts]) for i in range(3))
        head = (len(masks) >> 3).to_bytes(4, "little") + len(codes).to_bytes(4, "little")
        return head + pa.compress(masks + lengths + codes, codec="lz4", asbytes=True)


def unpacked(*found: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(votes, number of words) by sentence and the codes of all words in a row, of one text or several."""
    parts = [(n := int.from_bytes(f[:4], "little"), pa.decompress(f[8:], 12 * n + int.from_bytes(f[4:8], "little"), "lz4", asbytes=True)) for f in found]
    joined = [b"".join(x) for x in ([d[: 8 * n] for n, d in parts], [d[8 * n : 12 * n] for n, d in parts], [d[12 * n :] for n, d in parts])]
    return np.frombuffer(joined[0], np.int64), np.frombuffer(joined[1], np.int32), np.frombuffer(joined[2], np.uint16)


def _seen(documents: DataFrame, text: str) -> DataFrame:
    """documents without the text, with found: votes and words of every sentence. Kept, because fitting and scoring both read it."""
    others = [c for c in documents.columns if c != text]
    if clash := {"found", "__text"} & set(others):
        raise ValueError(f"columns {sorted(clash)} exist in the documents")
    schema = T.StructType([*documents.drop(text).schema.fields, T.StructField("found", T.BinaryType())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looker = _Looker()
        for b in batches:
            at = b.schema.get_field_index("__text")
            rows = [looker(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns) if i != at], pa.array(rows, pa.binary())], names=[*others, "found"])

    return keep(documents.select(*[f"`{c}`" for c in others], F.col(f"`{text}`").alias("__text")).mapInArrow(look, schema))


def labelled_votes(sample: DataFrame, text: str, category: str) -> list[tuple[int, np.ndarray, int]]:
    """(votes, word codes, number of the category in LABELS) of the sentences of at most LABELLED_ROWS labelled texts.

    Rows without text or of other categories are left out.  Of a harmful text of several sentences, those count in which voters
    that aren't weak speak against harmlessness, or all where there are none.
    """
    rows = sample.select(F.col(f"`{text}`"), F.col(f"`{category}`")).where(f"`{text}` is not null and `{category}` is not null").limit(LABELLED_ROWS).collect()
    return [x for t, c in rows if c in CATEGORIES for x in labelled_sentences(t, c)]


def labelled_sentences(text: str, category: str) -> list[tuple[int, np.ndarray, int]]:
    number = list(CATEGORIES).index(category)
    found = [(mask, word_codes(plain), number) for mask, plain in map(votes, sentences(text))]
    return [x for x in found if x[0] & AGAINST] or found if number else found


_MIX = np.random.default_rng(1).integers(1, 1 << 63, 97, np.uint64) | np.uint64(1)


def _hashes(masks: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """63-bit hashes of sentences from their votes, words and the order of these."""
    out = masks.astype(np.uint64) * _MIX[0] + lengths.astype(np.uint64)
    some = lengths > 0
    if some.any():
        begins = (np.cumsum(lengths, dtype=np.int64) - lengths)[some]
        place = np.arange(len(codes)) - np.repeat(begins, lengths[some])
        each = (codes.astype(np.uint64) + np.uint64(1)) * _MIX[1 + place % 96]
        out[some] += np.add.reduceat(each ^ (each >> np.uint64(29)), begins)
    out ^= out >> np.uint64(31)
    out *= _MIX[5]
    return (out ^ (out >> np.uint64(32))) >> np.uint64(1)


def _tally(seen: DataFrame, sample_rows: int) -> DataFrame:
    """votes, spoken, codes, hash, n by partition: how often each vote pattern came (codes is NULL), and how often each of the
    sample_rows distinct sentences with the least hashes, of those in which a voter that isn't weak speaks against harmlessness and of the rest.

    A sentence among the least of all partitions is among the least of each that has it, so its counts add up to all its copies;
    sentences of one 63-bit hash count as copies.
    """
    schema = "votes bigint, spoken boolean, codes binary, hash bigint, n bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: dict[int, int] = {}
        kept: tuple[dict, dict] = ({}, {})
        most = [1 << 63, 1 << 63]
        for b in batches:
            masks, lengths, codes = unpacked(*b.column(0).to_pylist())
            for v, n in zip(*np.unique(masks, return_counts=True), strict=True):
                patterns[int(v)] = patterns.get(int(v), 0) + int(n)
            hashes, sides, ends = _hashes(masks, lengths, codes), (masks & AGAINST) != 0, np.cumsum(lengths, dtype=np.int64)
            for side, counts in enumerate(kept):
                mine = np.flatnonzero((sides == side) & (hashes < np.uint64(most[side])))
                least, first, times = np.unique(hashes[mine], return_index=True, return_counts=True)
                for i, n in zip(mine[first[:sample_rows]].tolist(), times[:sample_rows].tolist(), strict=True):
                    key = int(hashes[i]), int(masks[i]), codes[ends[i] - lengths[i] : ends[i]].tobytes()
                    counts[key] = counts.get(key, 0) + n
                if len(counts) > sample_rows:
                    rest = {k: counts[k] for k in sorted(counts)[:sample_rows]}
                    most[side] = max(rest)[0] + 1
                    counts.clear()
                    counts.update(rest)
        rows = [(v, v & AGAINST != 0, None, None, n) for v, n in patterns.items()]
        rows += [(v, side == 1, s, h, counts[h, v, s]) for side, counts in enumerate(kept) for h, v, s in sorted(counts)[:sample_rows]]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["votes", "spoken", "codes", "hash", "n"])

    return seen.select("found").mapInArrow(count, schema).groupBy("votes", "spoken", "codes", "hash").agg(F.sum("n").alias("n"))


def _patterns(tally: DataFrame) -> dict[int, int]:
    """Counts of vote patterns, at most PATTERNS: beyond, weak votes are left out of all, then those for harmlessness.

    A coarser view only; the label model is fitted on `_every_pattern`.
    """
    every = (1 << len(NAMES)) - 1
    for left_out in ([], np.flatnonzero(WEAK), np.flatnonzero(WEAK | SUPPORTS[0])):
        told = every - sum(1 << int(j) for j in left_out)
        rows = tally.where("codes is null").groupBy(F.col("votes").bitwiseAND(F.lit(told)).alias("votes")).agg(F.sum("n").alias("n")).limit(PATTERNS + 1).collect()
        if len(rows) <= PATTERNS:
            return {0: 0} | {r["votes"]: r["n"] for r in rows}
    raise ValueError(f"more than {PATTERNS} patterns of votes")


def _every_pattern(tally: DataFrame) -> dict[int, int] | DataFrame:
    """Counts of all vote patterns; more than AT_ONCE stay a frame (votes, n)."""
    every = tally.where("codes is null").select("votes", "n")
    rows = every.limit(AT_ONCE + 1).collect()
    if len(rows) <= AT_ONCE:
        return {0: 0} | {r["votes"]: r["n"] for r in rows}
    return keep(every.repartition(-(-every.count() // AT_ONCE)))


def fit(seen: DataFrame, labelled: Sequence[tuple[int, np.ndarray, int]], sample_rows: int = SAMPLE_ROWS) -> tuple[Classifier, LabelModel]:
    """Label model over the votes of all sentences; classifier on distinct ones, taken by hash and weighted by their copies, and the labelled rows.

    Half of the sample has votes, other than weak ones, against harmlessness.
    """
    half = max(1, sample_rows // 2)
    tally = keep(_tally(seen, half))
    model = fit_label_model(_every_pattern(tally), [(v, LABELS[c]) for v, _, c in labelled], SUPPORTS, WEAK)
    sides = [[(r["votes"], np.frombuffer(r["codes"], np.uint16), r["n"]) for r in tally.where(f"codes is not null and spoken = {side}").orderBy("hash", "votes", "codes").limit(half).collect()] for side in ("true", "false")]
    return trained(model, sides, labelled), model


def trained(model: LabelModel, sides: Sequence[Sequence[tuple[int, np.ndarray, int]]], labelled: Sequence[tuple[int, np.ndarray, int]]) -> Classifier:
    """The classifier of the model's posteriors on both halves of a sample, and of labelled rows; its threshold is chosen on the latter."""
    drawn = [*[(v, s) for side in sides for v, s, _ in side], (0, np.zeros(0, np.uint16))]
    rows = drawn + [(v, t) for v, t, _ in labelled]
    soft = np.r_[model.posterior([v for v, _ in drawn]), np.array([float(c > 0) for *_, c in labelled])]
    # Both halves weigh the same, shared out by copies, and a text in which nothing stands as much as both; labelled rows weigh as much as the sample together, at most tenfold each.
    each = max(10.0, len(sides[0]))
    shares = [np.array([n for *_, n in side], float) for side in sides]
    weight = np.r_[*[each * n / max(1.0, n.sum()) for n in shares], 2 * each, np.full(len(labelled), min(10.0, max(1.0, 2 * each / max(1, len(labelled)))))]
    c = fit_classifier(rows, soft, weight)
    scores = np.array([c.score(v, t) for v, t, _ in labelled])
    return Classifier(c.weights, c.bias, threshold_of(scores, np.array([c > 0 for *_, c in labelled], bool)))


def moderated(documents: DataFrame, sample: DataFrame, *, text: str, sample_text: str = "text", category: str = "category") -> DataFrame:
    """documents without the text, with score (0 to 1) and flagged (score reaches the threshold chosen on the labelled rows).

    Empty and NULL texts have the score of a text in which nothing is seen.  Repeated documents are
    scored alike.  Without labelled rows the threshold is 0.5.  No documents give no rows.
    """
    seen = _seen(documents, text)
    classifier, _ = fit(seen, labelled_votes(sample, sample_text, category))
    shared = documents.sparkSession.sparkContext.broadcast(classifier)
    others = [c for c in seen.columns if c != "found"]
    if clash := {"score", "flagged"} & set(others):
        raise ValueError(f"columns {sorted(clash)} exist in the documents")
    schema = T.StructType([*seen.drop("found").schema.fields, T.StructField("score", T.DoubleType()), T.StructField("flagged", T.BooleanType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            found = b.column(len(others)).to_pylist()
            each = c.scores(*unpacked(*found))
            of = np.repeat(np.arange(len(found)), [int.from_bytes(f[:4], "little") for f in found])
            scores = np.full(len(found), c.nothing)
            np.maximum.at(scores, of, each)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(others))], pa.array(scores, pa.float64()), pa.array(scores >= c.threshold, pa.bool_())], names=[*others, "score", "flagged"])

    return seen.mapInArrow(judge, schema)


def rates(scored: DataFrame, by: str) -> DataFrame:
    """Documents, flagged documents, their share and the mean score per source; NULL is a source of its own."""
    return scored.groupBy(by).agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("flagged").cast("bigint")).alias("n_flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
