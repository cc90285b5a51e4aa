"""Quality classifier from weak labels.

Heuristic labellers vote for good, bad, or abstain on each document. Expectation-maximisation over the counts of vote
patterns (at most 3^m, however many documents there are) estimates the share of good documents and each labeller's
accuracy in either class, without any given label: there are two classes, and labellers are independent within one.
Posteriors of a bounded sample then train a linear scorer over hashed word shapes and byte shares, and the scorer
judges every document.

The labellers' bounds are those that published filters of web text use (symbols to words, mean word length, shares of
letters and of words without any, the most frequent pair and repeated runs of five words), or round shares; none was set by given labels.

Defined cases: null texts and texts without a word score 0 and are rejected; texts are read whole; equal texts get
equal scores; an empty table gives no rows; if the labellers don't disagree (no bad or no good posterior), the
posterior of the votes decides; extra columns stay untouched; the id may be of any type.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.dealing import dealt
from .common import fresh, written

#: The most documents whose posteriors train the scorer, distinct in id and text; each weighs as often as it occurs,
#: up to one hundredth of the sample. Vote counts cover all documents.
SAMPLE = 8000
FEATURES = 1 << 12
STEPS, RATE, RIDGE = 600, 1.0, 1e-5
#: Documents that score less are rejected.
CUT = 0.5

# Symbols, full stops of scripts, and the scripts that are written without spaces.
_SYMBOLS = [ord(c) for c in "#$%&*+<=>@[\\]^_`{|}~"]
_ENDS = re.compile("[.!?;:…։؟۔।॥၊။።፧។。！．？]")
_NO_SPACES = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿]")
LABELLERS = ("symbols", "capitals", "exclaims", "wordless", "repeats", "phrases", "stutter", "sentences", "word_length", "letters")


#: Bytes that are looked at together, cut at white space, so that a long text takes little memory beside itself.
CHUNK = 1 << 20
_SPACE, _LETTER, _RUN = (np.zeros(256, bool) for _ in range(3))
_SPACE[list(b" \t\n\r\v\f")] = True
_SHAPE = np.arange(256, dtype=np.uint8)  # capitals are A, other letters a, digits 0; runs of those are shortened
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91], _SHAPE[48:58] = 65, 48
_RUN[[65, 97, 48]] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_BASE = 0x100000001B3
_LOW = np.array([1], np.uint64).repeat(1 << 16)
with np.errstate(over="ignore"):
    _LOW[1:] = np.multiply.accumulate(np.full((1 << 16) - 1, _BASE, np.uint64))
    _HIGH = np.multiply.accumulate(np.concatenate([[1], np.full((1 << 15) - 1, pow(_BASE, 1 << 16, 1 << 64))]).astype(np.uint64))


def _hashes(values: np.ndarray, place: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each run of bytes, from its places (0, 1, ...) and the runs' starts."""
    with np.errstate(over="ignore"):
        power = _LOW[place & 0xFFFF] * _HIGH[place >> 16] if len(place) and place.max() >= 1 << 16 else _LOW[place]
        h = np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * power, starts)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(32)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """hash, length and shape of each word, and how many have no letter."""
    at = np.flatnonzero(~_SPACE[data])
    if not len(at):
        none = np.zeros(0, np.uint64)
        return none, none, none, 0
    first = np.concatenate([[True], np.diff(at) > 1])
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(at)))
    of = data[at]
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    bare = int(np.count_nonzero(~np.logical_or.reduceat(_LETTER[of], starts)))
    shape = _SHAPE[of]
    kept = first | ~_RUN[shape] | np.concatenate([[True], shape[1:] != shape[:-1]])
    n = np.add.reduceat(kept.astype(np.int64), starts)
    begin = np.cumsum(n) - n
    shapes = _hashes(shape[kept], np.arange(int(n.sum())) - np.repeat(begin, n), begin) % np.uint64(FEATURES - 259)
    return _hashes(of, place, starts), lengths.astype(np.uint64), shapes, bare


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """_words of a text of any length, chunk by chunk."""
    data, out, a = np.frombuffer(raw, np.uint8), [], 0
    while a < len(data):
        b = min(a + CHUNK, len(data))
        while b < len(data) and not _SPACE[data[b]]:  # up to the end of the word
            far = np.flatnonzero(_SPACE[data[b : b + CHUNK]])
            b = b + int(far[0]) if len(far) else min(b + CHUNK, len(data))
        out.append(_words(data[a:b]))
        a = b
    if not out:
        return _words(data)
    return *(np.concatenate([x[i] for x in out]) for i in range(3)), sum(x[3] for x in out)


@dataclass
class Counts:
    """What a text's votes and features are made of; the text is read for it once."""

    text: str
    bytes: np.ndarray
    words: int
    bare: int  # words without a letter
    shapes: np.ndarray  # feature numbers, one for each word
    pairs: float
    phrases: float
    stutter: float


def counts_of(text: str) -> Counts:
    raw = text.encode("utf-8", "surrogatepass")
    h, lengths, shapes, bare = words_of(raw)
    n, stutter, phrases, pairs = len(h), 0.0, 0.0, 0.0
    with np.errstate(over="ignore"):
        if n > 1:
            stutter = np.count_nonzero(h[1:] == h[:-1]) / (n - 1)
            _, at, count = np.unique(h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:], return_index=True, return_counts=True)
            pairs = float((count * (lengths[at] + lengths[at + 1]) * (count > 1)).max() / lengths.sum())
        if n > 4:
            fives = np.zeros(n - 4, np.uint64)
            for i in range(5):
                fives = (fives ^ h[i : i + n - 4]) * np.uint64(0x9FB21C651E98DF25)
                fives ^= fives >> np.uint64(32)
            phrases = 1 - len(np.unique(fives)) / (n - 4)
    return Counts(text, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), n, bare, shapes.astype(np.int64), pairs, phrases, stutter)


def votes_of(c: Counts) -> list[int]:
    """1 good, -1 bad, 0 abstains, in the order of LABELLERS. A labeller whose measure needs spaces abstains on a
    script that has none."""
    h, n, w = c.bytes, int(c.bytes.sum()), c.words
    upper, lower, wide = int(h[65:91].sum()), int(h[97:123].sum()), int(h[128:].sum())
    letters, symbols, marks = upper + lower + wide + int(h[48:58].sum()), int(h[_SYMBOLS].sum()), int(h[33])
    spaces = int(h[32] + h[9] + h[10] + h[13])
    points = len(c.text)
    dense = wide > n // 4 and len(_NO_SPACES.findall(c.text)) * 4 > points
    mean = (points - spaces) / w
    ends = len(_ENDS.findall(c.text)) if wide else int(h[46] + h[63] + h[58] + h[59]) + marks
    either = lambda good, bad: 1 if good else -1 if bad else 0
    return [
        0 if dense else either(symbols / w <= 0.02, symbols / w > 0.1),
        either(upper <= 0.2 * (upper + lower), upper > 0.5 * (upper + lower)) if upper + lower >= 20 else 0,
        0 if dense else either(marks / w <= 0.02, marks / w > 0.2),
        either(c.bare / w <= 0.05, c.bare / w > 0.2),
        either(c.pairs <= 0.1, c.pairs > 0.2) if w >= 10 else 0,
        either(c.phrases <= 0.05, c.phrases > 0.15) if w >= 20 else 0,
        either(c.stutter <= 0.02, c.stutter > 0.1) if w >= 10 else 0,
        0 if dense or w < 50 else either(ends * 25 >= w, ends * 200 < w),
        0 if dense else either(3 <= mean <= 10, mean < 2 or mean > 15),
        either(letters / n >= 0.75, letters / n < 0.6),
    ]


def pattern(votes: list[int]) -> str:
    return "".join("-0+"[v + 1] for v in votes)


def pattern_of(text: str | None) -> str:
    """The votes as one string of +, - and 0; empty for a text without a word."""
    c = counts_of(text or "")
    return pattern(votes_of(c)) if c.words else ""


@dataclass
class LabelModel:
    """The share of good documents, and each labeller's chances of a bad and a good vote in either class, where it votes.

    An abstention says nothing about the class: it is the measure that doesn't apply, or stays between the bounds.
    """

    good: float = 0.5
    rates: np.ndarray = field(default_factory=lambda: np.zeros((0, 2, 3)))  # labeller, class (bad, good), vote (bad, none: 1, good)
    voting: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))  # labeller, class
    posteriors: dict[str, float] = field(default_factory=dict)
    rounds: int = 0

    def posterior(self, votes: str) -> float:
        """P(good) of a vote pattern, seen in the fitting or not."""
        if not len(self.rates):
            return 0.5
        v = [{"-": 0, "0": 1, "+": 2}[x] for x in votes]
        bad, good = (math.log(p) + sum(math.log(self.rates[j, k, x]) for j, x in enumerate(v)) for k, p in enumerate((1 - self.good, self.good)))
        return 1 / (1 + math.exp(max(-700.0, min(700.0, bad - good))))

    def accuracies(self) -> list[tuple[str, float, float, float, float]]:
        """Labeller, how often its votes are right on good and on bad documents, and how often it votes on them."""
        out = []
        for name, r, said in zip(LABELLERS, self.rates, self.voting, strict=False):
            out.append((name, float(r[1, 2]), float(r[0, 0]), float(said[1]), float(said[0])))
        return out


def fit_labellers(patterns_: list[str], counts: list[int], rounds: int = 500) -> LabelModel:
    """Expectation-maximisation of the two-class model: from the majority of each pattern's votes, until nothing moves.

    Every rate is smoothed by one pseudo-document over its two votes, whichever the labeller and the class.
    """
    v = np.array([[{"-": 0, "0": 1, "+": 2}[c] for c in p] for p in patterns_])
    c = np.array(counts, float)
    plus, minus = (v == 2).sum(1), (v == 0).sum(1)
    # a labeller that finds a fault speaks for a few documents, one that finds none for most: a bad vote weighs as much
    # more as good ones are more frequent in all
    weight = (c @ plus) / max(1.0, c @ minus)
    q = (1 + plus) / (2 + plus + weight * minus)
    rates = voting = good = None
    for n in range(rounds):
        w = np.stack([c * (1 - q), c * q], 1)
        good = (w[:, 1].sum() + 0.5) / (c.sum() + 1)
        seen = np.array([[[w[v[:, j] == x, k].sum() for x in range(3)] for k in range(2)] for j in range(v.shape[1])])
        voting = (seen[:, :, 0] + seen[:, :, 2]) / np.maximum(seen.sum(2), 1e-9)
        rates = seen + np.array([0.5, 0.0, 0.5])
        rates /= rates[:, :, :1] + rates[:, :, 2:]
        rates[:, :, 1] = 1.0
        log = np.log([1 - good, good])[None, :] + sum(np.log(rates[j]).T[v[:, j]] for j in range(v.shape[1]))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))
        done = np.abs(new - q).max() < 1e-7
        q = new
        if done:
            break
    return LabelModel(float(good), rates, voting, dict(zip(patterns_, q.tolist(), strict=True)), n + 1)


def features_of(c: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features: the roots of the shares of hashed shapes, of repeats of each kind, and of bytes."""
    n = np.bincount(c.shapes)
    f, b = np.flatnonzero(n), np.flatnonzero(c.bytes)
    return np.concatenate([f, [FEATURES - 259, FEATURES - 258, FEATURES - 257], b + (FEATURES - 256)]), np.concatenate([np.sqrt(n[f] / c.words), np.sqrt([c.pairs, c.phrases, c.stutter]), np.sqrt(c.bytes[b] / c.bytes.sum())])


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression with soft targets, by gradient descent with momentum; each row weighs what it is given."""
    used = np.unique(np.concatenate([f for f, _ in rows]))
    x = np.zeros((len(rows), len(used)), np.float32)
    for i, (f, v) in enumerate(rows):
        x[i, np.searchsorted(used, f)] = v
    share = (np.ones(len(target)) if weight is None else weight) / (len(target) if weight is None else weight.sum())
    w, b, momentum, bm = np.zeros(len(used), np.float32), np.float32(0), np.zeros(len(used), np.float32), np.float32(0)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = (share * (p - target)).astype(np.float32)
        momentum = np.float32(0.9) * momentum + g @ x + np.float32(RIDGE) * w
        bm = np.float32(0.9) * bm + g.sum()
        w, b = w - np.float32(RATE) * momentum, b - np.float32(RATE) * bm
    full = np.zeros(FEATURES)
    full[used] = w
    return full, float(b)


class Model:
    """The label model and the scorer's weights; its size is fixed by 3^m and FEATURES."""

    def __init__(self, labels: LabelModel, weights: np.ndarray | None, bias: float):
        self.labels, self.weights, self.bias = labels, weights, bias

    def judge(self, text: str | None) -> tuple[str, float | None, float]:
        """Votes, their posterior, and the score."""
        c = counts_of(text or "")
        if not c.words:
            return "", None, 0.0
        p = pattern(votes_of(c))
        q = self.labels.posteriors.get(p)
        q = self.labels.posterior(p) if q is None else q
        if self.weights is None:
            return p, q, q
        f, v = features_of(c)
        return p, q, 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.weights[f] @ v) + self.bias))))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Vote counts over all documents and a scorer trained on at most `sample` of them, from one reading of the texts.

    The sample is of distinct (id, text), those of the smallest hashes; a document that occurs often is drawn at most
    once. Features are made in the same pass for somewhat more rows than will be drawn, chosen by the hash too.
    """
    total = docs.count()
    share = min(1.0, 1.2 * (sample + 100) / max(1, total))
    limit = int(share * (1 << 62)) if share < 1 else 1 << 62

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for h, text in zip(pdf["h"], pdf["text"], strict=True):
                c = counts_of(text or "")
                f = features_of(c) if c.words and h < limit else None
                rows.append((h, pattern(votes_of(c)) if c.words else "", None if f is None else f[0].tolist(), None if f is None else f[1].tolist()))
            yield pd.DataFrame(rows, columns=["h", "p", "f", "v"])

    # 62 bits, not negative, so that a share of the hashes is a share of the distinct rows
    h = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("draw")), 2)
    seen = dealt(docs.select(h.alias("h"), F.col(text_col).alias("text"))).mapInPandas(run, "h bigint, p string, f array<bigint>, v array<double>")
    seen = written(seen.where("p <> ''"), "votes")
    table = seen.groupBy("p").agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # 3^m rows at most
    if not table:
        return Model(LabelModel(), None, 0.0)
    labels = fit_labellers([r["p"] for r in table], [r["n"] for r in table])
    if max(labels.posteriors.values()) < CUT or min(labels.posteriors.values()) >= CUT:
        return Model(labels, None, 0.0)
    one = seen.where("f is not null").groupBy("h").agg(F.first(F.struct("p", "f", "v")).alias("x"), F.count(F.lit(1)).alias("n"))
    drawn = one.orderBy("h").limit(sample).select("x.*", "n").collect()  # bounded by sample
    drawn.sort(key=lambda r: (r["p"], r["f"], r["v"]))
    target = np.array([labels.posteriors[r["p"]] for r in drawn])
    if not len(target) or target.min() >= CUT or target.max() < CUT:
        return Model(labels, None, 0.0)
    weight = np.minimum(np.array([r["n"] for r in drawn], float), max(1.0, sample / 100))
    w, b = train([(np.array(r["f"]), np.array(r["v"])) for r in drawn], target, weight)
    return Model(labels, w, b)


def judged(model: Model):
    """text -> votes, posterior, score."""

    @F.pandas_udf("votes string, posterior double, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame([model.judge(t) for t in texts], columns=["votes", "posterior", "score"])
            yield out.astype({"posterior": "float64", "score": "float64"})

    return judge


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """id, votes, posterior of the votes, score, kept."""
    model = fit(docs, id_col, text_col, sample)
    out = dealt(docs.select(id_col, text_col)).select(F.col(id_col), judged(model)(F.col(text_col)).alias("j"))
    return out.select(id_col, "j.votes", "j.posterior", "j.score", (F.col("j.score") >= CUT).alias("kept"))


def labeller_accuracies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """labeller, right_on_good, right_on_bad, votes_on_good, votes_on_bad, as estimated."""
    spark = docs.sparkSession
    votes = docs.select(F.pandas_udf(lambda t: t.map(pattern_of), T.StringType())(F.col(text_col)).alias("p"))
    table = votes.where("p <> ''").groupBy("p").agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # 3^m rows at most
    model = fit_labellers([r["p"] for r in table], [r["n"] for r in table]) if table else LabelModel()
    return spark.createDataFrame(model.accuracies(), "labeller string, right_on_good double, right_on_bad double, votes_on_good double, votes_on_bad double")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """docs without those that the classifier rejects."""
    j = fresh(docs, "quality_judged")
    return dealt(docs).withColumn(j, judged(fit(docs, id_col, text_col, sample))(F.col(text_col))).where(F.col(f"{j}.score") >= CUT).drop(j)
