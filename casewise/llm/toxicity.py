"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine (operator 3).

A text is the set of its words. The kernel of two words sums their common, possibly gapped,
subsequences of three and of four letters, each gap letter costing a factor, so words with inserted
or dropped letters stay close to the insult they hide. Kernel values against a few dozen landmark
words, whitened by the landmarks' own kernel matrix, are the features of a squared-hinge linear SVM.
A document scores by how many distinct words reach each of a few margins, through a logistic curve
with weights that are not negative, fitted to labelled documents.

Labels are of documents, so training first finds witness words: words of toxic documents that hold a
letter run frequent there and absent from clean documents. Training reads a sample of labelled rows
bounded by ``Training``, whose texts it reads whole, and leaves out keys labelled both ways; tasks cut
these texts into words and the driver gets each one's distinct words, held once however many texts share
them. Scoring reads every whole text. Kernel values are computed once per distinct word in a bounded memo.

Defined results: null or empty texts score as having no word (near 0); without labels of both kinds
every score is 0; repeated rows score alike; an empty table gives an empty result; other columns pass
through, and a column named like the score is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, in_parts, table

_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_SPELLED = re.compile(r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D][\x20\x09-\x0D]){2,}[^\x20\x09-\x0D](?![^\x20\x09-\x0D])").findall
#: Look-alikes written for letters (fixed values).
_LOOKALIKE = str.maketrans({"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i"})
_SPAN = 16  # longer words are read in overlapping spans of this many letters


@dataclass(frozen=True)
class Training:
    toxic_documents: int = 1500  # labelled rows read at most, by kind
    clean_documents: int = 3000
    landmarks: int = 48
    landmark_letters: int = _SPAN + 1  # a whole span with its start mark
    decay: float = 0.6
    penalty: float = 2e-4
    rounds: int = 4


def words_of(text: str) -> set[str]:
    """Distinct lower-cased words, with runs of single spaced letters also read as one word."""
    lower = text.lower()
    found = set(_WORDS(lower))
    for run in _SPELLED(lower):
        found.add("".join(run.split()))
    return found


def spans_of(word: str) -> list[str]:
    """The letters of a word behind a start mark, in spans that together cover all of it."""
    core = word.strip(".,;:!?\"'()[]{}<>")
    letters = "".join(c for c in core.translate(_LOOKALIKE) if c.isalpha()) if not core.isalpha() else core
    if len(letters) <= _SPAN:
        return ["^" + letters]
    return ["^" + letters[:_SPAN], *(letters[i : i + _SPAN] for i in range(_SPAN // 2, len(letters) - _SPAN // 2, _SPAN // 2))]


def _codes(words: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(words), width), pad, dtype=np.int32)
    for row, word in enumerate(words):
        points = np.frombuffer(word[:width].encode("utf-32-le"), dtype="<u4")
        out[row, : len(points)] = points
    return out


def kernels(words: list[str], marks: np.ndarray, decay: float) -> np.ndarray:
    """Unnormalised kernels of 3 and 4 letters of each word against each row of ``marks``: (2, words, marks).

    ``marks`` is (n, m), or (words, m) as (words, 1, m) to pair each word with a row of its own.
    """
    width = max(map(len, words))
    chars = _codes(words, width, -1)
    marks = marks[None] if marks.ndim == 2 else marks
    m = marks.shape[-1]
    shape = (len(words), marks.shape[1], m)
    step = np.arange(m)
    carry = np.where(step[None] >= step[:, None], decay ** (step[None] - step[:, None]).clip(0).astype(float), 0).astype(np.float32)
    square = np.float32(decay * decay)
    prefix = [np.ones(shape, np.float32)] + [np.zeros(shape, np.float32) for _ in range(3)]  # value before each place
    total = np.zeros((2, *shape[:2]), np.float32)
    for at in range(width):
        match = (chars[:, at, None, None] == marks).astype(np.float32) * square
        total[1] += np.einsum("blm,blm->bl", match, prefix[3])
        total[0] += np.einsum("blm,blm->bl", match, prefix[2])
        for i in (3, 2, 1):
            ahead = ((match * prefix[i - 1]).reshape(-1, m) @ carry).reshape(shape)
            prefix[i] *= np.float32(decay)
            prefix[i][..., 1:] += ahead[..., :-1]
    return total


def normalised(words: list[str], marks: list[str], decay: float, mark_width: int) -> np.ndarray:
    """Sum of the two normalised kernels, words by marks."""
    own_marks = _codes(marks, mark_width, -2)
    cut = [w[:mark_width] for w in marks]
    mark_self = kernels(cut, own_marks[:, None, :], decay)[:, :, 0]
    out = np.empty((len(words), len(marks)), np.float32)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for at in range(0, len(order), 512):
        part = order[at : at + 512]
        chosen = [words[i] for i in part]
        width = max(map(len, chosen))
        mine = kernels(chosen, _codes(chosen, width, -2)[:, None, :], decay)[:, :, 0]
        norm = np.sqrt(np.maximum(mine[:, :, None] * mark_self[:, None, :], 1e-30))
        out[part] = (kernels(chosen, own_marks, decay) / norm).sum(0)
    return out


@dataclass
class Model:
    """A trained scorer. ``weights`` are on normalised kernel values against ``marks``."""

    marks: list[str]
    weights: np.ndarray
    bias: float
    decay: float
    mark_width: int
    curve: np.ndarray  # weights of the counts of words at EDGES, then the shift

    def __post_init__(self):
        self._tables = None

    def tables(self):
        """The decision function as one weight per letter subsequence.

        A kernel value is a sum over common subsequences, so the weighted sum over landmarks folds
        into a table by subsequence; nothing is approximated.
        """
        if self._tables is None:
            cut = [m[: self.mark_width] for m in self.marks]
            letters = sorted(set("".join(cut)))
            size = len(letters) + 1
            number = {c: i + 1 for i, c in enumerate(letters)}
            own = kernels(cut, _codes(cut, self.mark_width, -2)[:, None, :], self.decay)[:, :, 0]
            weight = [np.zeros(size**3), np.zeros(size**4)]
            for row, mark in enumerate(cut):
                coded = np.array([number[c] for c in mark])
                for kind, n in enumerate((3, 4)):
                    if len(mark) >= n:
                        places, factor = _places(len(mark), n, self.decay)
                        value = self.weights[row] / np.sqrt(own[kind, row]) * factor
                        np.add.at(weight[kind], coded[places] @ size ** np.arange(n), value)
            self._tables = number, size, [w.astype(np.float32) for w in weight]
        return self._tables

    def span_margins(self, spans: list[str]) -> np.ndarray:
        number, size, weight = self.tables()
        out = np.full(len(spans), self.bias, np.float32)
        by_length: dict[int, list[int]] = {}
        for i, span in enumerate(spans):
            by_length.setdefault(len(span), []).append(i)
        for length, rows in by_length.items():
            step = max(16, 400_000 // max(1, len(_places(length, 4, self.decay)[1])))
            for at in range(0, len(rows) if length >= 3 else 0, step):
                part = rows[at : at + step]
                chosen = [spans[i] for i in part]
                own = kernels(chosen, _codes(chosen, length, -2)[:, None, :], self.decay)[:, :, 0]
                coded = np.array([[number.get(c, 0) for c in w] for w in chosen], dtype=np.int32)
                for kind, n in enumerate((3, 4)):
                    if length < n:
                        continue
                    places, factor = _places(length, n, self.decay)
                    index = coded[:, places[:, 0]].copy()
                    for k in range(1, n):
                        index += coded[:, places[:, k]] * size**k
                    out[part] += (weight[kind][index] @ factor) / np.sqrt(np.maximum(own[kind], 1e-30))
        return out

    def margins(self, words: list[str]) -> np.ndarray:
        """The worst span of each word."""
        spans = [spans_of(w) for w in words]
        flat = list(set(chain.from_iterable(spans)))
        value = dict(zip(flat, self.span_margins(flat).tolist()))
        return np.array([max(map(value.__getitem__, s)) for s in spans])

    def probability(self, margins) -> float:
        """Of a document with these word margins; words alike in their letters count once."""
        counts = _counts(margins)
        return float(1 / (1 + np.exp(-np.clip(counts @ self.curve[:-1] + self.curve[-1], -40, 40))))


_PLACES: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def _places(length: int, n: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """All increasing choices of ``n`` places, with decay to the power of the stretch they cover."""
    key = (length, n, decay)
    if key not in _PLACES:
        places = np.array(list(combinations(range(length), n)), dtype=np.int64).reshape(-1, n)
        _PLACES[key] = places, (decay ** (places[:, -1] - places[:, 0] + 1)).astype(np.float32)
    return _PLACES[key]


#: Margins at which words of a document are counted, each count up to three.
EDGES = (-0.2, 0.0, 0.2, 0.4, 0.6, 0.8)


def _counts(margins) -> np.ndarray:
    near = {m for m in margins if m >= EDGES[0]}
    return np.array([min(3, sum(m >= edge for m in near)) for edge in EDGES], dtype=float)


def _runs(span: str) -> set[str]:
    return {span[i : i + n] for n in (5, 6) for i in range(len(span) - n + 1)} or {span}


Bag = tuple[str, ...]  # distinct words of a text


def _witnesses(toxic: list[Bag], clean: list[Bag]) -> set[str]:
    """Spans in toxic documents around the letter run that tells most against clean documents."""

    def runs_of(bag: Bag) -> set[str]:
        return {r for w in bag for span in spans_of(w) for r in _runs(span)}

    in_toxic = {run: n for run, n in Counter(chain.from_iterable(map(runs_of, toxic))).items() if n >= 2}  # others tell nothing
    in_clean = Counter(chain.from_iterable(in_toxic.keys() & runs_of(bag) for bag in clean))

    def gain(run: str) -> float:
        n = in_toxic[run]
        ratio = (n + 0.5) / (len(toxic) + 1) / ((in_clean[run] + 0.5) / (len(clean) + 1))
        return n * float(np.log(ratio)) if ratio > 3 else 0.0

    worth = {run: gain(run) for run in in_toxic}
    typical = sorted((max((worth.get(r, 0.0) for r in runs_of(bag)), default=0.0) for bag in toxic), reverse=True)
    least = max(8.0, 0.04 * typical[len(typical) // 2])
    found: set[str] = set()
    for bag in toxic:
        mine = {span: max(worth.get(r, 0.0) for r in _runs(span)) for span in set(chain.from_iterable(map(spans_of, bag)))}
        top = max(mine.values(), default=0.0)
        if top > 0 and top >= least:
            found |= {span for span, value in mine.items() if value >= 0.5 * top}
    return found


def _landmarks(positive: list[str], negative: list[str], p: Training) -> list[str]:
    """Farthest-first positives in kernel distance, then negatives by even steps."""
    positive = sorted({w[: p.landmark_letters] for w in positive})
    positive = positive[:: max(1, len(positive) // 1000)]
    negative = sorted({w[: p.landmark_letters] for w in negative if len(w) >= 5})
    count = min(len(positive), 2 * p.landmarks // 3)
    chosen = [positive[0]]
    nearest = normalised(positive, chosen, p.decay, p.landmark_letters)[:, 0]
    while len(chosen) < count:
        far = positive[int(nearest.argmin())]
        if far in chosen:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, normalised(positive, [far], p.decay, p.landmark_letters)[:, 0])
    rest = p.landmarks - len(chosen)
    return chosen + [w for w in negative[:: max(1, len(negative) // max(rest, 1))][:rest] if w not in chosen]


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float) -> np.ndarray:
    """Newton steps on the primal problem; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        slack = 1 - y * (x @ w)
        on = slack > 0
        grad = penalty * w - x[on].T @ (cost[on] * y[on] * slack[on])
        hess = penalty * np.eye(len(w)) + (x[on] * cost[on, None]).T @ x[on]
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _curve(counts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of the counts (none negative) and the shift, by projected Newton steps; kinds weigh alike."""
    cost = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    x = np.hstack([counts, np.ones((len(counts), 1))])
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    ridge = np.r_[np.full(counts.shape[1], 2e-3), 1e-6]
    w = np.r_[np.full(counts.shape[1], 0.5), -1.0]
    for _ in range(300):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (cost * (q - target)) + ridge * w
        hess = (x * (cost * np.maximum(q * (1 - q), 1e-3))[:, None]).T @ x + np.diag(ridge)
        free = np.r_[(w[:-1] > 0) | (grad[:-1] < 0), True]
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
        new = w - np.clip(step, -0.5, 0.5)
        new[:-1] = np.maximum(new[:-1], 0)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def bags_of(words: Iterable[Iterable[str]]) -> list[Bag]:
    """Bags that share the words they have in common."""
    own: dict[str, str] = {}
    return [tuple(own.setdefault(w, w) for w in some) for some in words]


def fit(texts: Iterable[str], toxic: list[int], p: Training = Training()) -> Model | None:
    """Train on labelled texts; None if a kind is missing."""
    return fit_bags(bags_of(sorted(words_of(t)) for t in texts), toxic, p)


def fit_bags(bags: list[Bag], toxic: list[int], p: Training = Training()) -> Model | None:
    """``fit`` on the distinct words of each text."""
    bad = [b for b, y in zip(bags, toxic) if y == 1]
    good = [b for b, y in zip(bags, toxic) if y == 0]
    if not bad or not good:
        return None
    common = Counter(chain.from_iterable({s for w in b for s in spans_of(w)} for b in good))
    seen_in = Counter(chain.from_iterable({s for w in b for s in spans_of(w)} for b in bad))
    positive = sorted(s for s in _witnesses(bad, good) if seen_in[s] > common[s])
    ranked = sorted(common.keys() - set(positive), key=lambda s: (-common[s], s))
    if not positive or not ranked:
        return None
    marks = _landmarks(positive, ranked[:2000], p)
    gram = normalised([m[: p.landmark_letters] for m in marks], marks, p.decay, p.landmark_letters).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-4 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    x_pos = normalised(positive, marks, p.decay, p.landmark_letters) @ whiten
    chosen = dict.fromkeys(ranked[:1500] + ranked[:: max(1, len(ranked) // 1500)])
    x_neg = normalised(list(chosen), marks, p.decay, p.landmark_letters) @ whiten
    for turn in range(p.rounds):  # the clean words nearest to the insults join
        x = np.vstack([x_pos, x_neg])
        y = np.r_[np.ones(len(x_pos)), -np.ones(len(x_neg))]
        often = np.array([seen_in[m] ** 0.5 for m in positive]), np.array([common[m] for m in chosen], dtype=float)
        cost = np.r_[often[0] / often[0].sum(), 0.5 / len(x_neg) + 0.5 * often[1] / often[1].sum()]
        w = _squared_hinge(x, y, cost, p.penalty)
        model = Model(marks, whiten @ w[:-1], float(w[-1]), p.decay, p.landmark_letters, np.ones(len(EDGES) + 1))
        if turn + 1 < p.rounds:
            worst = model.span_margins(ranked)
            hard = [ranked[i] for i in np.argsort(-worst, kind="stable")[:1500] if worst[i] > -0.8 and ranked[i] not in chosen]
            if not hard:
                break
            chosen.update(dict.fromkeys(hard))
            x_neg = np.vstack([x_neg, normalised(hard, marks, p.decay, p.landmark_letters) @ whiten])
    every, near = sorted(set(chain.from_iterable(bags))), {}
    for at in range(0, len(every), 20_000):  # only margins that count are kept
        part = every[at : at + 20_000]
        near.update((w, m) for w, m in zip(part, model.margins(part).tolist()) if m >= EDGES[0])
    model.curve = _curve(np.array([_counts([near[w] for w in b if w in near]) for b in bags]), np.array(toxic, dtype=float))
    return model


def _cut(batches):
    """Distinct words of each text ``t``, with spaces between."""
    for batch in batches:
        words = pa.array([" ".join(sorted(words_of(t or ""))) for t in batch.column(0).to_pylist()], pa.string())
        yield from in_parts(pa.RecordBatch.from_arrays([words, batch.column(1)], names=["words", "toxic"]))


def train(docs: DataFrame, labels: DataFrame, p: Training = Training(), key: str = "doc_id", text: str = "text") -> Model | None:
    """Fit on a bounded sample of labelled rows, chosen by a hash of the key; never on held-out rows."""
    labelled = labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull()).where(~held_out(F.col(key)))
    agreed = labelled.groupBy(key).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    picked = [
        agreed.where(F.col("toxic") == kind).select(key, "toxic").orderBy(F.xxhash64(key), key).limit(most)
        for kind, most in ((1, p.toxic_documents), (0, p.clean_documents))
    ]
    sample = picked[0].union(picked[1])
    rows = docs.select(key, F.col(text).cast("string").alias("t")).join(F.broadcast(sample), key)
    rows = rows.selectExpr("t", "cast(toxic as int) toxic").mapInArrow(_cut, "words string, toxic int").toArrow()
    bags = bags_of(filter(None, words.as_py().split(" ")) for words in rows.column("words"))
    order = sorted(range(len(bags)), key=lambda i: (rows.column("toxic")[i].as_py(), bags[i]))
    bags, toxic = [bags[i] for i in order], [rows.column("toxic")[i].as_py() for i in order]
    del rows
    model = fit_bags(bags, toxic, p)
    del bags
    give_back()  # a driver lives on after this stage
    return model


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 5 == 0


_MEMO: dict[bytes, dict[str, float]] = {}


def score_documents(docs: DataFrame, model: Model | None, text: str = "text", score: str = "score", memo_words: int = 400_000) -> DataFrame:
    """``docs`` with the toxicity score of each whole text."""
    base = docs.drop(score)
    if model is None:
        return base.withColumn(score, F.lit(0.0))
    schema = T.StructType([*base.schema.fields, T.StructField(score, T.DoubleType())])
    place = base.columns.index(text)
    mark = model.weights.tobytes() + repr(model.marks).encode()

    def run(batches):
        if mark not in _MEMO:
            _MEMO.clear()  # one model at a time
            _MEMO[mark] = {}
        known = _MEMO[mark]
        nothing = model.probability([])
        for batch in batches:
            scores: list[float] = []
            for at in range(0, batch.num_rows, 512):
                bags = [words_of(t or "") for t in batch.column(place).slice(at, 512).to_pylist()]
                new = list(set().union(*bags).difference(known))
                rare = dict(zip(new, model.margins(new).tolist())) if new else {}
                if len(known) + len(new) <= memo_words:
                    known.update(rare)
                    look = known.__getitem__
                else:
                    look = _Both(known, rare).get_margin
                scores += [model.probability(map(look, b)) if b else nothing for b in bags]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, score])

    return base.mapInArrow(run, schema)


class _Both:
    """Looks a word up in the memo and then among the words of the batch at hand."""

    def __init__(self, known: dict[str, float], rare: dict[str, float]):
        self.known, self.rare = known, rare

    def get_margin(self, word: str) -> float:
        value = self.known.get(word)
        return self.rare[word] if value is None else value


def op3_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
