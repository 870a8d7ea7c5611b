"""Linear text classifiers over hashed features, trained on a bounded labelled sample.

``WordNgrams`` hashes word n-grams for the quality classifier, ``CharNgrams`` hashes character n-grams for
the toxicity classifier, whose features are scaled by naive Bayes log-count ratios.  Both are fitted by
follow-the-regularised-leader (FTRL-proximal) updates; a score is the logistic of a sparse dot product.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

U64 = np.uint64

#: Byte classes of word tokens: 0 white space, 1 letters, digits and all non-ASCII bytes, 2 others.
TOKEN_CLASS = np.full(256, 2, dtype=np.uint8)
TOKEN_CLASS[K.IS_SPACE] = 0
TOKEN_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
#: Bytes of word shapes: a space, or the mark of a capital, another letter, a digit, or anything else.
SHAPE = np.full(256, ord("."), dtype=np.uint8)
SHAPE[K.IS_SPACE] = 32
SHAPE[48:58], SHAPE[65:91], SHAPE[97:123], SHAPE[128:] = ord("9"), ord("A"), ord("a"), ord("a")


@dataclass(frozen=True)
class WordNgrams:
    """Hashed unigrams and bigrams of word tokens, valued count / number of tokens.

    Tokens are maximal runs of letters and digits, or of other printing characters; unigrams are hashed as
    they are written and in lower case, bigrams as they are written.  N-grams of the shapes of whole words
    stand beside them: bytes by class (capital, other letter, digit, rest), runs of one class cut to two.
    """

    bits: int = 18
    shape_sizes: tuple[int, ...] = (2, 3)

    def features(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(indexes, n+1 bounds, value of each occurrence by text); one triple for each family of n-grams."""
        if len(data) == 0:
            return
        kind = TOKEN_CLASS[data]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        change = np.empty(len(data) + 1, dtype=bool)
        change[0] = change[-1] = True
        change[1:-1] = kind[1:] != kind[:-1]
        change |= cut
        at = np.flatnonzero(change)
        starts, ends = at[:-1], at[1:]
        real = kind[starts] > 0
        starts, ends = starts[real], ends[real]
        bounds = np.searchsorted(starts, offsets)
        low, own = (K.span_hash(K.prefix_hash(x), starts, ends) for x in (K.ASCII_LOWER[data], data))
        shift = U64(64 - self.bits)
        value = 1.0 / np.maximum(np.diff(bounds), 1)
        yield (K.mix(low) >> shift).astype(np.int64), bounds, value
        yield (K.mix(own + U64(1)) >> shift).astype(np.int64), bounds, value
        pair = np.zeros(len(own), dtype=U64)
        if len(own) > 1:
            pair[1:] = K.mix(own[:-1] * U64(K.BASE) + own[1:])
        pair[np.minimum(bounds[:-1], max(len(own) - 1, 0))] = 0  # the first word of a text has none before it
        yield (pair >> shift).astype(np.int64), bounds, value
        kind = SHAPE[data]
        keep = np.ones(len(kind), dtype=bool)
        keep[2:] = (kind[2:] != kind[1:-1]) | (kind[2:] != kind[:-2])
        keep |= cut[:-1]
        keep[1:] |= cut[:-2]
        shape, offsets = kind[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
        starts, ends, bounds = K.words(shape, offsets)
        word = K.span_hash(K.prefix_hash(shape), starts, ends)
        value = 1.0 / np.maximum(np.diff(bounds), 1)
        for size in self.shape_sizes:
            index, at = K.shingles(word + U64(size), bounds, size)
            yield (index >> shift).astype(np.int64), at, value


@dataclass(frozen=True)
class CharNgrams:
    """Hashed n-grams of the lower-cased UTF-8 bytes, valued 1 where a text holds them.

    White space counts as one space character; n-grams do not run from one text into the next.
    """

    bits: int = 20
    sizes: tuple[int, ...] = (4, 5, 6)

    def features(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        low = np.where(K.IS_SPACE, 32, K.ASCII_LOWER).astype(np.uint8)[data].astype(np.uint32)
        length = np.diff(offsets)
        one = np.ones(len(length))
        rolling = low + np.uint32(1)
        mult = np.uint32(1)
        for j in range(1, max(self.sizes)):
            mult = np.uint32((int(mult) * 0x01000193 + 2 * j) % 2**32 | 1)
            if len(low) > j:
                rolling[:-j] += (low[j:] + np.uint32(1)) * mult
            size = j + 1
            if size in self.sizes:
                n = np.maximum(length - j, 0)
                bounds = np.concatenate([[0], np.cumsum(n)])
                x = rolling * np.uint32(0x9E3779B1) + np.uint32(size)
                x ^= x >> np.uint32(15)
                x = (x * np.uint32(0x85EBCA77)) >> np.uint32(32 - self.bits)
                inside = np.ones(len(low), dtype=bool)
                for k in range(1, size):  # windows that would cross the end of a text
                    inside[np.maximum(offsets[1:] - k, offsets[:-1])[length > 0]] = False
                yield x[inside].astype(np.int64), bounds, one


Features = WordNgrams | CharNgrams


@dataclass
class LinearModel:
    features: Features
    weights: np.ndarray
    bias: float
    scale: float
    #: False where rows of one class or of both are missing; every score is then 0.
    fitted: bool = True

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.bias)
        for lo, hi, part, off in K.chunks(data, offsets):
            for index, bounds, value in self.features.features(part, off):
                if isinstance(self.features, CharNgrams):
                    out[lo:hi] += self.once(index, bounds)
                else:
                    out[lo:hi] += self.scale * value * K.segment_sum(self.weights[index], bounds)
        return out

    def once(self, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Sum of the weights of each text's distinct n-grams; only those with a weight are told apart."""
        at = np.flatnonzero(self.weights[index])
        text = np.searchsorted(bounds, at, side="right") - 1
        kinds = np.unique((text << 32) | index[at])
        return np.bincount(kinds >> 32, weights=self.weights[kinds & 0xFFFFFFFF], minlength=len(bounds) - 1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(offsets) - 1)
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(data, offsets), -35, 35)))


def sparse_rows(features: Features, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct indexes, summed values) of each text; n-grams valued by presence share one value."""
    once = isinstance(features, CharNgrams)
    out = []
    for text in texts:
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        found = [(np.unique(i).astype(np.int32) if once else i.astype(np.int32), v) for i, _, v in features.features(data, np.array([0, len(data)]))]
        if once:
            out.append((np.unique(np.concatenate([i for i, _ in found])) if found else np.zeros(0, dtype=np.int32), np.ones(1)))
            continue
        index = np.concatenate([i for i, _ in found]) if found else np.zeros(0, dtype=np.int32)
        kinds, inverse = np.unique(index, return_inverse=True)
        value = np.concatenate([np.full(len(i), v[0]) for i, v in found]) if found else np.zeros(0)
        out.append((kinds, np.bincount(inverse, weights=value, minlength=len(kinds))))
    return out


def log_count_ratios(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of the smoothed counts of texts of either class that hold a feature."""
    p, q = np.full(size, smooth), np.full(size, smooth)
    for (index, _), y in zip(rows, labels, strict=True):
        (p if y else q)[index] += 1
    n1, n0 = smooth + labels.sum(), smooth + (1 - labels).sum()
    return np.log((p / n1) / (q / n0))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, alpha: float, l1: float, l2: float, epochs: int, seed: int = 5, beta: float = 1.0) -> tuple[np.ndarray, float]:
    """FTRL-proximal logistic regression; both classes weigh the same in all."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rng = np.random.default_rng(seed)
    balance = len(labels) / (2.0 * np.maximum([(labels == 0).sum(), (labels == 1).sum()], 1))

    def weights(i: np.ndarray, sharp: np.ndarray) -> np.ndarray:
        keep = np.abs(z[i]) > sharp
        return np.where(keep, -(z[i] - np.sign(z[i]) * sharp) / ((beta + np.sqrt(n[i])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i, x = np.append(rows[r][0], size), np.append(rows[r][1], 1.0)
            sharp = np.full(len(i), l1)
            sharp[-1] = 0.0
            w = weights(i, sharp)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[r]) * balance[int(labels[r])] * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    sharp = np.full(size + 1, l1)
    sharp[-1] = 0.0
    w = weights(np.arange(size + 1), sharp)
    return w[:-1], float(w[-1])


def unfitted(features: Features) -> LinearModel:
    return LinearModel(features, np.zeros(1, dtype=np.float32), 0.0, 1.0, False)


def fit_quality(texts: list[str], labels: np.ndarray, features: WordNgrams | None = None) -> LinearModel:
    """Hashed word n-grams and FTRL updates; with no rows of one class nothing is learnt."""
    features = features or WordNgrams()
    scale = 30.0
    if not 0 < labels.sum() < len(labels):
        return unfitted(features)
    rows = [(i, v * scale) for i, v in sparse_rows(features, texts)]
    weights, bias = ftrl(rows, labels, 1 << features.bits, alpha=0.5, l1=0.05, l2=1.0, epochs=4)
    return LinearModel(features, weights.astype(np.float32), bias, scale)


def fit_toxicity(texts: list[str], labels: np.ndarray, features: CharNgrams | None = None, folds: int = 3) -> LinearModel:
    """Naive Bayes log-count ratios as feature scales, FTRL weights on top (Wang and Manning, 2012).

    The bias is then moved so that one half falls where it parts the margins of left-out folds best, a clean text
    above it weighing FALSE_COST times a toxic one below.  With no rows of one class nothing is learnt.
    """
    features = features or CharNgrams()
    if not 0 < labels.sum() < len(labels):
        return unfitted(features)
    rows = sparse_rows(features, texts)
    weights, bias = _scaled_ftrl(rows, labels, 1 << features.bits)
    if len(rows) >= 4 * folds:
        fold, margin = np.arange(len(rows)) % folds, np.zeros(len(rows))
        for f in range(folds):
            inside = np.flatnonzero(fold != f)
            w, b = _scaled_ftrl([rows[i] for i in inside], labels[inside], 1 << features.bits)
            for i in np.flatnonzero(fold == f):
                margin[i] = w[rows[i][0]].sum() + b
        bias -= _parting(margin, labels)
    return LinearModel(features, weights.astype(np.float32), bias, 1.0)


#: What a clean training text scored toxic costs, in toxic ones missed.
FALSE_COST = 4.0


def _scaled_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    ratio = log_count_ratios(rows, labels, size)
    ratio[np.abs(ratio) < 1.5] = 0.0  # scarcely any evidence
    scaled = []
    for i, _ in rows:
        i = i[ratio[i] != 0]
        scaled.append((i, ratio[i]))
    weights, bias = ftrl(scaled, labels, size, alpha=0.05, l1=3.0, l2=1.0, epochs=4)
    return weights * ratio, bias


def _parting(margin: np.ndarray, labels: np.ndarray) -> float:
    """The cut between two margins with the least cost; of equal ones the middle."""
    order = np.argsort(margin, kind="stable")
    m, y = margin[order], labels[order]
    missed = np.concatenate([[0.0], np.cumsum(y)]) / max(y.sum(), 1)
    wrong = ((1 - y).sum() - np.concatenate([[0.0], np.cumsum(1 - y)])) / max((1 - y).sum(), 1)
    cost = missed + FALSE_COST * wrong
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    cuts = np.concatenate([[m[0] - 1], (m[1:] + m[:-1]) / 2, [m[-1] + 1]])
    return float(cuts[best].mean())


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, learnable: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """(i, y, t): whole texts and 0/1 labels of about ``per_class`` rows of each class, chosen by a hash of the id.

    The bound on the sample is ``per_class``, in expectation; texts are whole.  An id with labels of both classes counts as
    1, one with several texts by the least of them; null ids and labels other than 0 and 1 are left out.  An id's
    choice does not depend on partitions, and an empty table of labels gives an empty sample.
    """
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & learnable).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    counts = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(0.0)
    for y, n in counts.items():
        rate = F.when(F.col("y") == y, min(1.0, per_class / n)).otherwise(rate)
    chosen = marked.filter(F.pmod(F.xxhash64(F.lit(seed), "i"), F.lit(1 << 30)) < rate * (1 << 30))  # about 2 * per_class rows
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).join(F.broadcast(chosen), "i")
    return rows.groupBy("i", "y").agg(F.min("t").alias("t"))


def fitted(sample: DataFrame, fit: Callable[[list[str], np.ndarray], LinearModel]) -> LinearModel:
    """The model that ``fit`` makes of a sample (i, y, t), in one task: the driver gets its weights other than zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        rows = sorted(x for batch in batches for x in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        model = fit([t for _, t, _ in rows], np.array([float(y) for _, _, y in rows]))
        at = np.flatnonzero(model.weights)
        about = pickle.dumps((model.features, model.bias, model.scale, model.fitted))
        yield pa.RecordBatch.from_arrays([pa.array([about]), pa.array([at.astype(np.int32).tobytes()]), pa.array([model.weights[at].astype(np.float32).tobytes()])], names=["about", "at", "weights"])

    row = sample.select("i", "t", "y").coalesce(1).mapInArrow(run, "about binary, at binary, weights binary").first()
    if row is None:
        return fit([], np.zeros(0))
    features, bias, scale, sure = pickle.loads(bytes(row.about))
    weights = np.zeros(1 << features.bits if sure else 1, dtype=np.float32)
    weights[np.frombuffer(row.at, dtype=np.int32)] = np.frombuffer(row.weights, dtype=np.float32)
    return LinearModel(features, weights, bias, scale, sure)


def score(docs: DataFrame, model: LinearModel, id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """The id of every row and its score; a null text is scored as the empty one.  A map without a shuffle.

    Repeated rows and null ids are scored like any other, an empty table gives an empty one, other columns are not
    read, and a model that had no rows of both classes to learn from scores 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits float32 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.scores(*K.text_buffers(batch.column(1))))], names=["id", out])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, {out} double").withColumnRenamed("id", id_col)


def keep_below(docs: DataFrame, model: LinearModel, bound: float, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text scores below ``bound``, with all their columns; a map without a shuffle.

    A null text is scored as the empty one; repeated rows stay or go alike; a model that had no rows of both classes
    to learn from keeps every row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(*K.text_buffers(batch.column(place))) < bound))

    return docs.mapInArrow(run, docs.schema)
