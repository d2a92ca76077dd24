"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels exist for documents only, so token labels are derived first: from labelled training documents a greedy cover
picks the words and word beginnings that explain most toxic documents not yet explained and are rare in clean ones; their tokens in toxic documents are labelled toxic, all others clean. A two-label chain over features of the
word and its beginnings is then fitted by gradient ascent on its likelihood. Scoring runs forward-backward over every
whole text, exactly: between tokens that carry a feature the chain is a power of one matrix. A document's score is a logistic
function, fitted on the same sample, of the sum, the maximum and the share of its marginals.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batch_of, bound_batches, keyed, map_batches, tidy, trim

#: Bounds of the training sample: documents of either label, and bytes of one of them.
TRAIN_DOCS, TRAIN_BYTES = 1500, 40_000
#: Word beginnings, in bytes, that are features besides the whole word.
PREFIXES = (4, 5, 6, 7)
#: Least share of toxic documents among those, evenly drawn, that hold a seed.
PURITY = 0.88
#: A whole word is a seed, too, if so large a part of the toxic documents hold it and its purity is as high.
USUAL, USUAL_PURITY = 0.05, 0.97
#: Tokens of a training sequence, sequences without any feature, steps of the fit, weight of its prior.
SEGMENT, PLAIN_SEGMENTS, STEPS, PRIOR = 24, 2000, 120, 0.02
#: Words whose score a worker keeps; a bound on memory only.
WORDS_KEPT = 150_000

_BREAK = bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122 or c == 95))
_SPACES = bytes.maketrans(_BREAK, b" " * len(_BREAK))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words: runs of letters, digits, underscores and characters beyond ASCII."""
    return text.decode(errors="replace").lower().encode().translate(_SPACES).split()


def features_of(word: bytes) -> list[bytes]:
    return [word] + [word[:k] + b"*" for k in PREFIXES if len(word) > k]


@dataclass
class Crf:
    """bias and weights lift label 1; step[i][j] is the log weight of label j after label i; start of label 1."""

    weights: dict[bytes, float]
    bias: float
    step: np.ndarray
    start: float
    document: np.ndarray | None = None

    def lift(self, word: bytes) -> float | None:
        """The log weight that the word's features add to label 1; None where it has no feature of the model."""
        found = [self.weights[f] for f in features_of(word) if f in self.weights]
        return sum(found) if found else None

    def plain_powers(self, most: int = 64) -> list[np.ndarray]:
        one = np.exp(self.step) * np.exp([0.0, self.bias])[None, :]
        out = [np.eye(2)]
        for _ in range(most):
            out.append(out[-1] @ one)
            out[-1] /= out[-1].sum()
        return out

    def marginals(self, lifts: list[tuple[int, float]], n: int) -> list[float]:
        """P(label 1) at the tokens of lifts (position, lift) in a text of n tokens, by forward-backward."""
        if not lifts:
            return []
        powers = self.__dict__.get("_powers") or self.__dict__.setdefault("_powers", self.plain_powers())

        def across(gap: int) -> np.ndarray:
            while gap >= len(powers):
                powers.append(_normal(powers[-1] @ powers[1]))
            return powers[gap]

        trans = np.exp(self.step)
        state = np.array([1.0, np.exp(self.start)])  # before the first token, start is folded into its label
        ahead, last = [], -1
        for at, lift in lifts:
            if last < 0 and at > 0:
                state = np.array([1.0, np.exp(self.start + self.bias)]) @ across(at - 1)
                state = state @ trans
            elif last >= 0:
                state = state @ across(at - last - 1) @ trans
            state = state * np.array([1.0, np.exp(min(50.0, self.bias + lift))])
            state = state / state.sum()
            ahead.append(state)
            last = at
        back, out = np.ones(2), [0.0] * len(lifts)
        back = across(n - 1 - last) @ back
        for k in range(len(lifts) - 1, -1, -1):
            both = ahead[k] * back
            out[k] = float(both[1] / both.sum())
            if k:
                at, lift = lifts[k]
                back = trans @ (np.array([1.0, np.exp(min(50.0, self.bias + lift))]) * back)
                back = across(at - lifts[k - 1][0] - 1) @ (back / back.sum())
        return out


def _normal(m: np.ndarray) -> np.ndarray:
    return m / m.sum()


def _all_features(text: bytes) -> set[bytes]:
    return {f for w in set(words_of(text)) for f in features_of(w)}


def seeds(toxic: list[bytes], clean: list[bytes]) -> set[bytes]:
    """Features that together explain the toxic texts: greedy cover by those that are far more frequent in them.

    A feature qualifies if of equally many toxic and clean texts that hold it, a share of PURITY would be toxic. Texts are
    cut into words one at a time, and only features that enough toxic texts hold are kept with the numbers of these.
    """
    least = max(3, len(toxic) // 150)
    hashed = [np.fromiter(map(xxhash.xxh64_intdigest, _all_features(t)), np.uint64) for t in toxic]
    values, counts = np.unique(np.concatenate([*hashed, np.zeros(0, np.uint64)]), return_counts=True)
    frequent = set(values[counts >= least].tolist())
    held: dict[bytes, set[int]] = defaultdict(set)
    for k, t in enumerate(toxic):
        for f in _all_features(t):
            if xxhash.xxh64_intdigest(f) in frequent:
                held[f].add(k)
    touched = Counter(f for t in clean for f in _all_features(t) if f in held)
    worth: dict[bytes, float] = {}
    for f, docs in held.items():
        if len(docs) >= least:
            rate, other = len(docs) / len(toxic), touched[f] / max(1, len(clean))
            if rate / (rate + other) >= PURITY:
                worth[f] = 2 * rate / (rate + other) - 1
    left = {f: held[f] for f in worth}
    chosen: set[bytes] = set()
    while left:
        best = max(left, key=lambda f: (len(left[f]) * worth[f], not f.endswith(b"*"), len(f), f))
        chosen.add(best)
        done = left.pop(best)
        left = {f: rest for f, docs in left.items() if len(rest := docs - done) >= least}
    usual = max(5, len(toxic) * USUAL)  # words that many toxic documents hold, even if others explain these too
    return chosen | {f for f, x in worth.items() if not f.endswith(b"*") and len(held[f]) >= usual and x >= 2 * USUAL_PURITY - 1}


def _by_word(words: list[bytes], found: list[tuple[int, float]]) -> list[float]:
    """The largest marginal of each different word: a repeated line tells no more than one."""
    best: dict[bytes, float] = {}
    for k, p in found:
        best[words[k]] = max(p, best.get(words[k], 0.0))
    return list(best.values())


def _summary(marginals: list[float], n: int) -> list[float]:
    """What a document's score looks at: expected toxic words, the surest one, and the share of them."""
    total = sum(marginals)
    return [float(np.log1p(total)), max(marginals, default=0.0), float(np.log((total + 0.01) / (n + 20)))]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    ridge = np.eye(len(beta)) * prior * weight.sum()
    ridge[-1, -1] = 1e-9
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge
        beta = beta + np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge @ beta)
    return beta


def fit(toxic_texts: list[bytes], clean_texts: list[bytes], weight: tuple[float, float] = (1.0, 1.0), seed: int = 0) -> Crf:
    """Derive token labels and fit the chain and the document score. weight: what a toxic and a clean text stand for.

    Without a toxic document the model finds nothing toxic.
    """
    marks = seeds(toxic_texts, clean_texts)
    marked = lambda w: any(f in marks for f in features_of(w))
    seen = Counter(f for text in toxic_texts for w in set(words_of(text)) if marked(w) for f in features_of(w))
    number = {f: k + 1 for k, f in enumerate(sorted(f for f, n in seen.items() if n >= 2 or f in marks))}
    wide = 1 + len(PREFIXES)
    rich: list[tuple[np.ndarray, np.ndarray, int]] = []
    plain: list[int] = []  # the sizes of sequences without any feature
    for label, group in ((1, toxic_texts), (0, clean_texts)):
        for text in group:
            words = words_of(text)
            known = {w: own for w in set(words) if (own := [number[f] for f in features_of(w) if f in number])}
            for lo in range(0, len(words), SEGMENT):
                part = words[lo : lo + SEGMENT]
                if known.keys().isdisjoint(part):
                    plain.append(len(part))
                    continue
                ids = np.zeros((SEGMENT, wide), np.int32)
                gold = np.zeros(SEGMENT, np.int8)
                for k, w in enumerate(part):
                    own = known.get(w, ())
                    ids[k, : len(own)] = own
                    gold[k] = label and marked(w)
                rich.append((ids, gold, len(part)))
    rng = np.random.default_rng(seed)
    some = sorted(rng.permutation(len(plain))[:PLAIN_SEGMENTS])
    parts = rich + [(np.zeros((SEGMENT, wide), np.int32), np.zeros(SEGMENT, np.int8), plain[k]) for k in some]
    weights, bias, step, start = np.zeros(len(number) + 1), -4.0, np.zeros((2, 2)), 0.0
    if rich:
        weights, bias, step, start = _ascend(*(np.stack(x) for x in zip(*((i, g) for i, g, _ in parts), strict=True)), np.array([n for *_, n in parts]), len(number) + 1)
    crf = Crf({f: float(weights[k]) for f, k in number.items()}, float(bias), step, float(start))
    scorer, rows = Scorer(crf), []
    for text in toxic_texts + clean_texts:
        words, found = scorer.tag(text)
        rows.append(_summary(_by_word(words, found), len(words)))
    y = np.r_[np.ones(len(toxic_texts)), np.zeros(len(clean_texts))]
    if rich and clean_texts:
        crf.document = _logistic(np.array(rows), y, np.where(y == 1, *weight))
    return crf


def _ascend(ids: np.ndarray, gold: np.ndarray, sizes: np.ndarray, n_features: int) -> tuple:
    """Maximise the mean log-likelihood of the sequences by Adam; padding has no weight."""
    count, length, _ = ids.shape
    real = np.arange(length)[None, :] < sizes[:, None]
    g = gold.astype(float) * real
    pairs = np.zeros((2, 2))
    both = real[:, 1:]
    for i in (0, 1):
        for j in (0, 1):
            pairs[i, j] = ((gold[:, :-1] == i) & (gold[:, 1:] == j) & both).sum()
    theta = np.zeros(n_features + 6)  # weights, bias, start, step
    theta[n_features] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    used = np.nonzero(ids)
    used_ids = ids[used]
    per_token = np.zeros((count, length))
    for t in range(1, STEPS + 1):
        w, bias, start, step = theta[:n_features], theta[n_features], theta[n_features + 1], theta[n_features + 2 :].reshape(2, 2)
        per_token[:] = bias
        np.add.at(per_token, used[:2], w[used_ids])
        lift = np.where(real, per_token, 0.0)
        ahead = np.zeros((count, length, 2))
        ahead[:, 0, 1] = lift[:, 0] + start
        for k in range(1, length):
            new = np.logaddexp(ahead[:, k - 1, 0, None] + step[0], ahead[:, k - 1, 1, None] + step[1])
            new[:, 1] += lift[:, k]
            ahead[:, k] = np.where(real[:, k, None], new, ahead[:, k - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        back = np.zeros((count, length, 2))
        expected = np.zeros((2, 2))
        for k in range(length - 1, 0, -1):
            inner = back[:, k].copy()
            inner[:, 1] += lift[:, k]
            joint = ahead[:, k - 1, :, None] + step[None] + inner[:, None, :] - total[:, None, None]
            expected += np.exp(joint[real[:, k]]).sum(axis=0)
            new = np.logaddexp(step[:, 0][None] + inner[:, 0, None], step[:, 1][None] + inner[:, 1, None])
            back[:, k - 1] = np.where(real[:, k, None], new, back[:, k])
        p = np.exp(ahead[..., 1] + back[..., 1] - total[:, None]) * real
        diff = g - p
        grad = np.zeros_like(theta)
        grad[:n_features] = np.bincount(used_ids, diff[used[:2]], n_features)
        grad[n_features] = diff.sum()
        grad[n_features + 1] = diff[:, 0].sum()
        grad[n_features + 2 :] = (pairs - expected).ravel()
        grad -= PRIOR * theta
        grad /= max(1.0, g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        theta = theta + 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta[:n_features], theta[n_features], theta[n_features + 2 :].reshape(2, 2), theta[n_features + 1]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learnt from: crc32 of the id as text divisible by five. Null ids are held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> Crf:
    """Fit on a sample of labelled rows that are not held out: per_label of either label at most, by hash of the id.

    Texts over most_bytes are left out of the sample. Only the sample's ids, at most 2 * per_label, are broadcast.
    """
    spark = docs.sparkSession
    known = labels.filter(~held_out(id_col) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_t")).filter(F.octet_length("_t").between(1, most_bytes))
    ids = [r["_id"] for y in (0, 1) for r in known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id", F.lit(9)), "_id").select("_id").limit(per_label).collect()]
    picked = spark.createDataFrame([(x,) for x in ids], "_id long").join(known, "_id")
    rows = texts.join(F.broadcast(picked), "_id").groupBy("_id", "_y").agg(F.max("_t").alias("_t")).collect()
    groups = {y: [r["_t"].encode() for r in sorted(rows, key=lambda r: r["_id"]) if r["_y"] == y] for y in (0, 1)}
    del rows
    crf = fit(groups[1], groups[0], tuple(counts.get(y, 0) / max(1, len(groups[y])) for y in (1, 0)))
    del groups
    trim()  # what the driver held for fitting
    return crf


class Scorer:
    def __init__(self, crf: Crf) -> None:
        self.crf, self.known = crf, {}

    def tag(self, text: bytes) -> tuple[list[bytes], list[tuple[int, float]]]:
        """Words of the text, and (position, P(toxic)) of those that carry a feature."""
        words = words_of(text)
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        known, lift = self.known, self.crf.lift
        for w in set(words):
            if w not in known:
                known[w] = lift(w)
        lifts = [(k, x) for k, x in enumerate(map(known.__getitem__, words)) if x is not None]
        return words, list(zip((k for k, _ in lifts), self.crf.marginals(lifts, len(words)), strict=True))

    def judge(self, text: bytes) -> tuple[float, list[tuple[int, float]]]:
        """The document's score, and the words (position, P(toxic)) that are more likely toxic than not.

        A text without any feature is scored by its length alone. A model that knows no toxic text scores 0.
        """
        words, found = self.tag(text)
        beta = self.crf.document
        if beta is None:
            return 0.0, []
        z = float(np.dot(beta[:-1], _summary(_by_word(words, found), len(words))) + beta[-1])
        return 1.0 / (1.0 + math.exp(-min(30.0, max(-30.0, z)))), [x for x in found if x[1] >= 0.5]


_FINDER = re.compile(r"[0-9a-z_\u0080-\U0010ffff]+")


def offsets(text: bytes, positions: list[int]) -> list[tuple[int, int, str]]:
    """(start, end, word in lower case) of the words at these positions, in characters of the text as it is."""
    if not positions:
        return []
    raw = text.decode(errors="replace")
    low = raw.lower()
    wanted = set(positions)
    found = [(m.start(), m.end(), m[0]) for k, m in enumerate(_FINDER.finditer(low)) if k in wanted]
    if len(low) != len(raw):  # some characters have longer lower-case forms
        source = np.repeat(np.arange(len(raw)), [len(c.lower()) for c in raw])
        found = [(int(source[i]), int(source[j - 1]) + 1, w) for i, j, w in found]
    return found


def score_documents(df: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, n_toxic, spans): one row for each row of df; see the module for what score is.

    predicted is 1 from 0.5 on; spans are the character offsets (start, end) of the words with a marginal of 0.5 or more,
    n_toxic their number. A null or empty text has the score of no words. Repeated rows give repeated rows, a null id
    stays null, other columns are not read, an empty table stays empty.
    """
    scorer = Scorer(crf)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = as_bytes(batch.column(1))
        scores, words = map(list, zip(*map(scorer.judge, texts), strict=True))
        spans = [[{"start": a, "end": b} for a, b, _ in offsets(t, [k for k, _ in w])] for t, w in zip(texts, words, strict=True)]
        columns = [batch.column(0), scores, [int(s >= 0.5) for s in scores], list(map(len, words)), spans]
        return batch_of(["doc_id", "score", "predicted", "n_toxic", "spans"], columns, [pa.int64(), pa.float64(), pa.int32(), pa.int64(), span])

    return map_batches(keyed(df, id_col, text_col), run, "doc_id long, score double, predicted int, n_toxic long, spans array<struct<start: long, end: long>>")


def toxic_spans(df: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, word, p): character offsets of every word whose marginal is at least `least`, in lower case.

    Null and empty texts have none; repeated rows repeat theirs; a null id stays null; an empty table gives no rows.
    """
    scorer = Scorer(crf)
    names = ["doc_id", "start", "end", "word", "p"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            wanted = [(k, p) for k, p in scorer.tag(text)[1] if p >= least]
            rows += [(doc_id, *where, p) for where, (_, p) in zip(offsets(text, [k for k, _ in wanted]), wanted, strict=True)]
        columns = list(map(list, zip(*rows, strict=True))) if rows else [[]] * 5
        return batch_of(names, columns, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()])

    return map_batches(keyed(df, id_col, text_col), run, "doc_id long, start long, end long, word string, p double")


def drop_toxic(df: DataFrame, crf: Crf, text_col: str = "text") -> DataFrame:
    """df without the rows that the model predicts toxic; all columns as they were, whatever their names.

    Rows with null and empty texts stay unless texts of no words are predicted toxic; repeated rows are judged alike; an
    empty table stays empty.
    """
    scorer, at, schema = Scorer(crf), df.columns.index(text_col), df.schema
    bound_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array([scorer.judge(x)[0] < 0.5 for x in as_bytes(batch.column(at))], pa.bool_()))

    return df.mapInArrow(tidy(run), schema)
