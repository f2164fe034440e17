"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean embedding of its hashed byte n-grams (ASCII case folded,
digits and punctuation as spaces).  The model is trained by stochastic gradient
descent in numpy on a bounded, hash-ordered sample of labelled rows
(``rows_per_lang`` rows of each of the ``max_langs`` most frequent labels, of long texts
``spans`` pieces spread over the whole text, ``chars_per_row`` characters together);
part of the sample is held back to fit a temperature and two rejection thresholds.

A softmax only weighs the learned languages against each other, so a text also has
a familiarity: the mean log-probability of its n-grams in the language chosen,
as a distance from that of the held-back texts of that language in standard
deviations for its length.  The thresholds are the lowest at which the accepted part
of the held-back texts, of the same texts with their own language taken out of the model,
and of the same texts with their letters shuffled is right to ``precision``,
but never cost more than ``max_rejected`` of the right answers.
Prediction reads whole texts.  The trained tables have a fixed size
(``buckets`` x languages), which bounds the broadcast.

Defined cases: a text that is null or holds no letter is ``und`` with score 0
and rejected; without labelled rows every text is; rows without a label, or with one beyond the most frequent, are not
used for training; repeated rows count once each; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm import arrays

ORDERS = (3, 4)
LETTER = regex.compile(r"\p{L}")
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[b for b in range(128) if not (65 <= b < 91 or 97 <= b < 123)]] = 32
UNDEFINED = "und"


@dataclass(frozen=True)
class Settings:
    rows_per_lang: int = 800
    max_langs: int = 200
    chars_per_row: int = 2000
    spans: int = 4
    buckets: int = 1 << 16
    width: int = 16
    epochs: int = 6
    rate: float = 0.5
    held_back: float = 0.25  # share of the sample for calibration
    precision: float = 0.99  # of accepted rows in the held-back sample
    max_rejected: float = 0.002  # share of right predictions that the threshold may cost


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # logits of each bucket
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    familiar: np.ndarray | None = None  # log-probability of each bucket in each language
    usual: np.ndarray | None = None  # per language: mean of the texts' means, their variance, variance within texts
    floor: float = -np.inf
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def grams(data: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, order by order, and the text of each."""
    folded = FOLD[data].astype(np.uint32)
    found, owner = [], []
    for n in ORDERS:
        if len(folded) < n:
            continue
        h = np.full(len(folded) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ folded[k: len(folded) - n + 1 + k]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        at = arrays.window_starts(offs, n)
        found.append(h[at] % np.uint32(buckets))
        owner.append(np.searchsorted(offs, at, "right") - 1)
    none = np.zeros(0, np.int64)
    return np.concatenate(found or [none]), np.concatenate(owner or [none])


def means(tables: np.ndarray, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the rows of ``tables`` at the buckets of each text, by differences of running sums per order, and their number."""
    n_docs = len(offs) - 1
    total, count = np.zeros((n_docs, tables.shape[1])), np.zeros(n_docs)
    folded = FOLD[data].astype(np.uint32)
    for n in ORDERS:
        if len(folded) < n:
            continue
        h = np.full(len(folded) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ folded[k: len(folded) - n + 1 + k]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        bucket = (h % np.uint32(len(tables))).astype(np.int32)
        lo, hi = np.minimum(offs[:-1], len(bucket)), np.maximum(np.minimum(offs[1:] - n + 1, len(bucket)), 0)
        hi = np.maximum(hi, lo)
        for k in range(tables.shape[1]):
            sums = np.zeros(len(bucket) + 1)
            np.cumsum(tables[:, k][bucket], out=sums[1:])
            total[:, k] += sums[hi] - sums[lo]
        count += hi - lo
    return total / np.maximum(count, 1)[:, None], count


def familiarity(model: Model, mean: np.ndarray, count: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Standard deviations between a text's mean log-probability in language ``best`` and the usual one."""
    middle, between, within = model.usual[:, best]
    # Neighbouring n-grams share bytes: as many independent ones as there are fewer by the sum of the orders.
    spread = np.sqrt(between + within * sum(ORDERS) / np.maximum(count, 1) + 1e-9)
    return np.where(count > 0, (mean[np.arange(len(best)), best] - middle) / spread, 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[str], settings: Settings | None = None, seed: int = 7) -> Model:
    """Stochastic gradient descent over the sample, then temperature and threshold on the part held back."""
    s = settings or Settings()
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1, 1, (s.buckets, s.width)).astype(np.float32) / s.width
    weights, bias = np.zeros((s.width, max(1, len(langs))), np.float32), np.zeros(max(1, len(langs)), np.float32)
    empty = Model(langs, np.zeros((s.buckets, len(langs)), np.float32), np.zeros(len(langs), np.float32))
    if not langs:
        return empty
    docs = _bags(texts, s.buckets)
    y = np.array([langs.index(x) for x in labels])
    held = rng.random(len(texts)) < s.held_back
    learn = np.flatnonzero(~held if (~held).any() else held)
    steps, done = s.epochs * len(learn), 0
    for _ in range(s.epochs):
        for i in rng.permutation(learn):
            rate, done = s.rate * (1 - done / steps), done + 1
            ids, n = docs[i]
            if not len(ids):
                continue
            share = (n / n.sum()).astype(np.float32)[:, None]
            hidden = (embed[ids] * share).sum(axis=0)
            err = -_softmax(hidden @ weights + bias)
            err[y[i]] += 1
            back = weights @ err
            weights += rate * np.outer(hidden, err)
            bias += rate * err
            embed[ids] += rate * share * back * len(ids) ** 0.5  # rare buckets would otherwise hardly move
    model = Model(langs, (embed @ weights).astype(np.float32), bias)
    check = np.flatnonzero(held) if held.any() else learn
    z = np.stack([(model.table[ids] * (n / max(1, n.sum()))[:, None]).sum(axis=0) + bias for ids, n in (docs[i] for i in check)])
    truth = y[check]
    scales = np.geomspace(0.05, 10, 60)
    loss = [-np.log(_softmax(z / t)[np.arange(len(check)), truth] + 1e-12).mean() for t in scales]
    model.temperature = float(scales[int(np.argmin(loss))])
    prob = _softmax(z / model.temperature)
    seen = np.full((s.buckets, len(langs)), 0.5)
    for i in learn:
        seen[docs[i][0], y[i]] += docs[i][1]
    model.familiar = np.log(seen / seen.sum(axis=0)).astype(np.float32)
    _calibrate(model, [texts[i] for i in check], truth, s, rng)
    return model


def _bags(texts: list[str], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their counts."""
    docs = []
    for i in range(0, len(texts), 200):
        some = texts[i: i + 200]
        bucket, owner = grams(*arrays.flat(pa.array(some, pa.string())), buckets)
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(len(some) + 1))
        docs += [np.unique(bucket[order[a:b]], return_counts=True) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return docs


def _shuffled(text: str, rng: np.random.Generator) -> str:
    """The text with its letters in random order; spaces and other characters stay."""
    chars = np.array(list(text.lower()), object)
    at = np.flatnonzero([c.isalpha() for c in chars])
    chars[at] = chars[rng.permutation(at)]
    return "".join(chars)


def _piece(text: str, n: int, rng: np.random.Generator) -> str:
    """``n`` characters from anywhere in the text."""
    at = int(rng.integers(0, max(1, len(text) - n + 1)))
    return text[at: at + n]


def _calibrate(model: Model, texts: list[str], truth: np.ndarray, s: Settings, rng: np.random.Generator) -> None:
    """Usual familiarity of each language and both thresholds, from held-back texts and texts made wrong."""
    k = len(model.langs)
    model.usual = np.zeros((3, k))
    for lang in range(k):
        own = _bags([t for t, y in zip(texts, truth, strict=True) if y == lang] or texts, s.buckets)
        values = [(model.familiar[ids, lang].astype(float), n / n.sum()) for ids, n in own if len(ids)]
        if values:
            mean = np.array([(v * n).sum() for v, n in values])
            within = np.mean([(v * v * n).sum() for v, n in values]) - np.mean(mean**2)
            model.usual[:, lang] = mean.mean(), mean.var(), max(0.0, within)

    def judge(some: list[str], without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mean, count = means(np.hstack([model.table, model.familiar]), *arrays.flat(pa.array(some, pa.string())))
        z = (mean[:, :k] + model.bias) / model.temperature
        if without is not None:
            z[np.arange(len(z)), without] = -np.inf
        prob = _softmax(z)
        best = prob.argmax(axis=1)
        return best, prob.max(axis=1), familiarity(model, mean[:, k:], count, best)

    some = {n: [_piece(t, n, rng) for t in texts] for n in (s.chars_per_row, 200, 60)}
    parts = [judge(some[n]) for n in (s.chars_per_row, 200, 60)]
    best, prob, near = (np.concatenate(c) for c in zip(*parts, strict=True))
    right = best == np.tile(truth, len(parts))
    wrong = [judge([_shuffled(t, rng) for t in some[n]]) for n in (s.chars_per_row, 200)]
    if k > 1:
        wrong += [judge(some[n], truth) for n in (s.chars_per_row, 200)]
    _, wrong_prob, wrong_near = (np.concatenate(c) for c in zip(*wrong, strict=True))
    near, prob = np.concatenate([near, wrong_near]), np.concatenate([prob, wrong_prob])
    right = np.concatenate([right, np.zeros(len(wrong_near), bool)])
    model.floor = _lowest(near, right, s)
    ok = near >= model.floor
    model.threshold = _lowest(prob[ok], right[ok], s)


def _lowest(value: np.ndarray, right: np.ndarray, s: Settings) -> float:
    """The lowest threshold with the wanted precision, unless that costs too many right answers."""
    if not right.any():
        return 0.0
    order = np.argsort(-value, kind="stable")
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= s.precision)
    most = float(np.quantile(value[right], s.max_rejected))
    return min(most, float(value[order[good[-1]]])) if len(good) else most


def fit(docs: DataFrame, settings: Settings | None = None) -> Model:
    """Train on a bounded sample of the rows with text and lang; the same rows at every partitioning."""
    s = settings or Settings()
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        "lang", "doc_id", F.xxhash64("text").alias("_t"), "text")
    narrow = known.drop("text").withColumn(
        "_p", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "_t"), F.lit(1 << 30)) / F.lit(1 << 30)).distinct()
    # About twice the wanted rows of each language pass the cut by hash; only those are ordered.
    cut = narrow.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "lang").limit(s.max_langs).select(
        "lang", (F.lit(2.0 * s.rows_per_lang + 100) / F.col("_n")).alias("_cut"))
    order = Window.partitionBy("lang").orderBy("_p", "doc_id", "_t")
    chosen = narrow.join(cut, "lang").filter("_p < _cut").withColumn("_k", F.row_number().over(order))
    chosen = chosen.filter(F.col("_k") <= s.rows_per_lang).select(
        F.col("lang").alias("_lang"), F.col("doc_id").alias("_id"), F.col("_t").alias("_h"), "_k")
    chosen = F.broadcast(chosen)  # at most rows_per_lang narrow rows for each of max_langs languages
    same = (F.col("lang") == F.col("_lang")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_h"))
    size, each = F.length("text"), s.chars_per_row // s.spans
    starts = [F.floor((size - each) * (k / max(1, s.spans - 1))).cast("int") + 1 for k in range(s.spans)]
    spread = F.concat_ws(" ", *[F.substring(F.col("text"), at, F.lit(each)) for at in starts])
    text = F.when(size <= s.chars_per_row, F.col("text")).otherwise(spread)
    sample = known.join(chosen, same).select("lang", "_k", text.alias("text"))
    sample = sample.dropDuplicates(["lang", "_k"])
    rows = sample.select("lang", "_k", "text").toPandas().sort_values(["lang", "_k"])
    return train(rows["text"].tolist(), rows["lang"].tolist(), s)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus lang_pred, score (calibrated probability) and accepted, for whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tables = np.hstack([m.table, m.familiar]) if m.langs else m.table
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            data, offs = arrays.flat(texts)
            for i, j in arrays.parts(offs):
                some = texts.slice(i, j - i)
                letters = np.array([LETTER.search(t) is not None for t in some.to_pylist()], bool)
                prob = np.zeros((j - i, 1))
                near = np.zeros(j - i)
                if m.langs:
                    mean, count = means(tables, data[offs[i]: offs[j]], offs[i: j + 1] - offs[i])
                    prob = _softmax((mean[:, : len(m.langs)] + m.bias) / m.temperature)
                    near = familiarity(m, mean[:, len(m.langs):], count, prob.argmax(axis=1))
                known = letters & bool(m.langs)
                best, score = prob.argmax(axis=1), np.where(known, prob.max(axis=1), 0.0)
                names = [m.langs[b] if k else UNDEFINED for b, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in keep), pa.array(names, pa.string()), pa.array(score),
                     pa.array(known & (score >= m.threshold) & (near >= m.floor))], [*keep, "lang_pred", "score", "accepted"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(arrays.giving_back(run), schema)
