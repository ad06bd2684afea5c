"""Toxicity by a convolutional text classifier, trained in numpy.

A text is lower-cased (A-Z) and cut at white space and punctuation; each word hashes to one of BUCKETS embeddings.
Filters of WIDTHS words slide over the whole text, each filter's largest response is kept (max pooling), and a logistic
output weighs them. A convolution over looked-up embeddings is a sum of looked-up rows, so scoring gathers from
one small table (a row of sum(WIDTHS) x FILTERS floats for each bucket that training met, BUCKETS at most), which each worker
makes of the embeddings (DIM floats a bucket); these are what is broadcast, and their size doesn't grow with the data.

Training: every labelled document, one row each. Whole texts become bucket numbers on the executors, packed by a hash of the id into
shards of some SHARD documents. Where all of them come to SAMPLE documents and SAMPLE_WORDS words at most, the driver trains on all.
Otherwise what it takes of the first shard within these bounds gives the starting weights only, and EPOCHS rounds follow, in which
each shard trains on all its texts from the weights of the round before; what a bucket has changed by is averaged over the shards
that trained it. Only changes of weights and counts by bucket reach the driver, as Arrow columns and not row by row, so that what it
holds doesn't grow with the data.
All embedding dimensions train. The first starts at how much more often toxic texts hold the bucket than chance gives,
the others at random. A quarter of the texts doesn't train but calibrates:
Platt scaling for the score, and for each language the threshold, at least 0.5, above which at most FALSE_ALARMS
of its clean documents lie. After rounds, logits count in steps of 1 / GRID for that, rounded up. Languages with fewer than LEAST clean calibration documents take the threshold of all.
The score itself sees nothing but the text. To filter labelled rows, drop_toxic trains a model on each half of the ids and
judges each half by the model that hasn't seen it.

Defined cases: a null or empty text is a window of padding and gets that score. Labels that are null, or whose
document is missing, don't train; of repeated labels the highest counts. With no labelled row of either kind every
score is 0. An empty table gives an empty result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, fields, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from reachlake.llm.common import id_hash, whole, written

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
SAMPLE, EPOCHS, BATCH, RATE, DECAY = 12000, 4, 32, 0.005, 1e-3
FALSE_ALARMS, LEAST = 0.01, 200
#: Words of the training texts that reach the driver, at four bytes each.
SAMPLE_WORDS = 12_000_000
#: Documents of a shard, and bytes of text if all texts are as long as the mean.
SHARD, SHARD_BYTES = 4096, 1 << 26
#: Of a logit's steps in calibration, and of a weight's in sums, which are of whole numbers and so the same in any order.
GRID, FINE = 1 << 12, 1 << 20
#: At most so many bits tell which documents may have a label.
MARK_BITS = 1 << 26
#: Where the first embedding dimension starts: deviations that count as nothing, and the divisor of the logarithm of those above.
DEAD, TOP = 1.0, 1.0
#: Words convolved at a time.
STEP = 1 << 15
PUNCTUATION = bytes.maketrans(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 31)


class Buckets(dict):
    """Word to bucket; forgets all it knows at 2^18 words, so its memory is bounded. Bucket 0 is padding."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = found = 1 + zlib.crc32(word) % (BUCKETS - 1)
        return found


def bucket_ids(text: str, buckets: Buckets) -> np.ndarray:
    parts = text.encode().lower().translate(PUNCTUATION).split()
    return np.fromiter(map(buckets.__getitem__, parts), np.uint32, len(parts))


@dataclass
class Weights:
    """Embeddings, what the filters and the output weigh, and which buckets have been trained."""

    emb: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: np.ndarray
    trained: np.ndarray

    def dense(self) -> list[np.ndarray]:
        return [self.kernel, self.bias, self.out, self.offset]


#: Which word of its window each row of a filter looks at.
TAPS = [(k, t) for k, width in enumerate(WIDTHS) for t in range(width)]


@dataclass
class Model:
    #: Embeddings of the buckets that say something, and each bucket's row; row 0 is empty.
    rows: np.ndarray = field(default_factory=lambda: np.zeros((1, DIM), np.float32))
    kernel: np.ndarray = field(default_factory=lambda: np.zeros((len(TAPS), DIM, FILTERS), np.float32))
    place: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.int32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    scale: tuple[float, float] = (1.0, -1e9)
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5
    #: While it trains.
    weights: Weights | None = None

    @cached_property
    def table(self) -> np.ndarray:
        """What each tap of each filter gives for each row. It is six times as large as the rows, so it is made where it is used."""
        table = np.empty((len(self.rows), len(TAPS) * FILTERS), np.float32)
        for i in range(len(TAPS)):
            table[:, i * FILTERS : (i + 1) * FILTERS] = self.rows @ self.kernel[i]
        return table

    def __getstate__(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def pooled(ids: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter over the whole text and where it starts."""
    ids = np.concatenate((ids, np.zeros(max(WIDTHS) - 1, ids.dtype)))
    n = len(ids) - max(WIDTHS) + 1
    best, where = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.int64)
    for start in range(0, max(n, 1), STEP):
        rows = table[ids[start : start + STEP + max(WIDTHS) - 1]]
        count, tap = max(1, min(STEP, n - start)), 0
        for k, width in enumerate(WIDTHS):
            total = rows[:count, tap : tap + FILTERS]
            for t in range(1, width):
                total = total + rows[t : t + count, tap + t * FILTERS : tap + (t + 1) * FILTERS]
            tap += width * FILTERS
            at, own = total.argmax(axis=0), slice(k * FILTERS, (k + 1) * FILTERS)
            top = total[at, np.arange(FILTERS)]
            better = top > best[own]
            best[own], where[own] = np.where(better, top, best[own]), np.where(better, at + start, where[own])
    return best, where


def logit(ids: np.ndarray, model: Model) -> float:
    best, _ = pooled(model.place[ids if len(ids) else np.zeros(1, np.uint32)], model.table)
    return float(np.maximum(best + model.bias, 0) @ model.out)


def excess(texts: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """For each bucket, how many deviations more toxic texts hold it than chance gives: 0 for DEAD or fewer, then by logarithm."""
    seen = np.zeros((2, BUCKETS))
    for ids, y in zip(texts, toxic, strict=True):
        seen[int(y), np.unique(ids)] += 1
    return excess_of(seen, float(toxic.mean()))


def excess_of(seen: np.ndarray, share: float) -> np.ndarray:
    """The same of the numbers of clean and toxic texts that hold each bucket, and the toxic ones' share."""
    chance = seen.sum(axis=0) * share
    found = np.log1p(np.maximum((seen[1] - chance) / np.sqrt(chance + 1) - DEAD, 0)) / TOP
    found[0] = 0
    return found.astype(np.float32)


def fit(texts: list[np.ndarray], toxic: np.ndarray, seed: int = 7) -> Model:
    """The model of texts in memory. While a half of them trains, the excess comes from the other half, so that no text vouches for its own words."""
    rng = np.random.default_rng(seed)
    texts = [x if len(x) else np.zeros(1, np.uint32) for x in texts]
    half = rng.permutation(len(texts)) % 2
    firsts = [excess([x for x, h in zip(texts, half, strict=True) if h != k], toxic[half != k]) for k in (0, 1)]
    emb = (rng.standard_normal((BUCKETS, DIM)) * 0.01).astype(np.float32)
    emb[0] = 0
    emb[:, 0] = 0
    kernel = (rng.standard_normal((len(TAPS), DIM, FILTERS)) * 0.2).astype(np.float32)
    kernel[:, 0, :] = np.abs(kernel[:, 0, :]) + 0.2
    bias, out = np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
    weights = Weights(emb, kernel, bias, out, np.zeros(1, np.float32), np.zeros(BUCKETS, bool))
    ratio = len(toxic) / (2 * np.maximum(1, np.bincount(toxic.astype(int), minlength=2)))
    train(weights, texts, toxic, half, firsts, ratio, rng, EPOCHS)
    return finished(weights, excess(texts, toxic))


def train(weights: Weights, texts: list[np.ndarray], toxic: np.ndarray, half: np.ndarray, firsts: list[np.ndarray], ratio: np.ndarray, rng: np.random.Generator, epochs: int) -> None:
    """Adam on the logistic loss, in place. The first embedding dimension is the bucket's excess in toxic texts (firsts, by the text's half)
    plus what is learnt. The others start at random."""
    emb, (kernel, bias, out, offset) = weights.emb, weights.dense()
    dense = weights.dense()
    m, v = [np.zeros_like(p) for p in [emb, *dense]], [np.zeros_like(p) for p in [emb, *dense]]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        batches = [(k, own[i : i + BATCH]) for k in (0, 1) for own in [order[half[order] == k]] for i in range(0, len(own), BATCH)]
        for which in rng.permutation(len(batches)):
            k, chosen = batches[which]
            # Only the batch's buckets take part; they are numbered anew, padding first.
            used, local = np.unique(np.concatenate([np.zeros(1, np.uint32), *(texts[i] for i in chosen)]), return_inverse=True)
            weights.trained[used] = True
            learnt = emb[used]
            own_emb = learnt.copy()
            own_emb[:, 0] += firsts[k][used]
            table = np.concatenate([own_emb @ kernel[i] for i in range(len(TAPS))], axis=1)
            grads = [DECAY * learnt, DECAY * kernel, *(np.zeros_like(p) for p in dense[1:])]
            at = 1
            for i in chosen:
                ids = local[at : at + len(texts[i])]
                at += len(ids)
                best, where = pooled(ids, table)
                act = np.maximum(best + bias, 0)
                p = 1 / (1 + np.exp(-float(act @ out + offset[0])))
                g = (p - toxic[i]) * ratio[int(toxic[i])] / len(chosen)
                down = g * out * (act > 0)
                grads[2] += down
                grads[3] += g * act
                grads[4] += g
                padded = np.concatenate((ids, np.zeros(max(WIDTHS), ids.dtype)))
                for x, (j, t) in enumerate(TAPS):
                    own = slice(j * FILTERS, (j + 1) * FILTERS)
                    rows = padded[where[own] + t]
                    grads[1][x] += own_emb[rows].T * down[own]
                    np.add.at(grads[0], rows, down[own, None] * kernel[x].T)
            grads[0][0] = 0
            step += 1
            for at, (p, g) in enumerate(zip([emb, *dense], grads, strict=True)):
                rows = used if at == 0 else slice(None)
                a, b = m[at][rows] * 0.9 + 0.1 * g, v[at][rows] * 0.999 + 0.001 * g * g
                m[at][rows], v[at][rows] = a, b
                p[rows] -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-4)


def finished(weights: Weights, final: np.ndarray) -> Model:
    """What scores, with final as the excess; a bucket that no text has trained says nothing else."""
    weights.emb[~weights.trained] = 0
    emb = weights.emb.copy()
    emb[:, 0] += final
    some = np.flatnonzero(emb.any(axis=1))
    place = np.zeros(BUCKETS, np.int32)
    place[some] = np.arange(1, len(some) + 1)
    rows = np.concatenate((np.zeros((1, DIM), np.float32), emb[some]))
    return Model(rows, weights.kernel, place, weights.bias, weights.out, weights=weights)


def platt(z: np.ndarray, toxic: np.ndarray, count: np.ndarray | None = None) -> tuple[float, float]:
    """(a, b) of sigmoid(a * z + b) with a > 0, by Newton steps with halving on smoothed targets. Each z counts count times."""
    count = np.ones(len(z)) if count is None else count
    pos, neg = count @ (toxic == 1), count @ (toxic != 1)
    y = np.where(toxic == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    middle = float(np.average(z, weights=count))
    spread = float(np.sqrt(np.average((z - middle) ** 2, weights=count))) + 1e-6
    x = np.stack([(z - middle) / spread, np.ones_like(z)], axis=1)
    w = np.array([1.0, float(np.log((pos + 1) / (neg + 1)))])

    def loss(w: np.ndarray) -> float:
        t = x @ w
        return float(count @ (np.logaddexp(0, t) - y * t))

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (count * (p - y)))
        size = 1.0
        while size > 1e-6 and loss(w - size * move) > loss(w):
            size /= 2
        w = w - size * move
    w[0] = max(w[0], 1e-3)
    return float(w[0] / spread), float(w[1] - w[0] * middle / spread)


def probability(z: np.ndarray, scale: tuple[float, float]) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-(scale[0] * z + scale[1])))


def marked(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit for each remainder of the ids' hashes."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    found = ids.select(F.shiftright(at, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    return words


def smallest(rows: Iterable[tuple[int, str | None, bytes]]) -> dict[int, tuple[int, bytes, str]]:
    """Of rows that share an id, the one of the fewest words."""
    best: dict[int, tuple[int, bytes, str]] = {}
    for doc_id, lang, ids in rows:
        row = (len(ids), ids, lang if isinstance(lang, str) else "")
        if doc_id not in best or row < best[doc_id]:
            best[doc_id] = row
    return best


PACKED = "shard long, doc_ids binary, toxic binary, lengths binary, langs array<string>, ids binary"


def packed(docs: DataFrame, known: DataFrame, shards: int, bits: int) -> DataFrame:
    """A row for each shard with the bucket numbers of its labelled documents. Only texts that may have a label are hashed and shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(marked(known, bits))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), whole("text").alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("at"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets, words = Buckets(), shared.value
        for df in batches:
            at = df["at"].to_numpy()
            df = df[(words[at >> 6] >> (at & 63)) & 1 == 1]
            best = smallest((i, lang, bucket_ids(text, buckets).tobytes()) for i, lang, text in zip(df["doc_id"], df["lang"], df["text"], strict=True))
            yield pd.DataFrame({"doc_id": pd.Series(list(best), dtype="int64"), "lang": [x[2] or None for x in best.values()], "ids": [x[1] for x in best.values()]})

    def pack(texts: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        toxic = dict(zip(marks["doc_id"], marks["toxic"], strict=True))
        best = smallest((i, lang, ids) for i, lang, ids in zip(texts["doc_id"], texts["lang"], texts["ids"], strict=True) if i in toxic)
        own = sorted(best)
        if not own:
            return pd.DataFrame(columns=["shard", "doc_ids", "toxic", "lengths", "langs", "ids"])
        row = (int(marks["shard"].iloc[0]), np.array(own, np.int64).tobytes(), np.array([toxic[i] > 0 for i in own], np.uint8).tobytes(), np.array([best[i][0] // 4 for i in own], np.int64).tobytes(), [best[i][2] for i in own], b"".join([best[i][1] for i in own]))
        return pd.DataFrame([row], columns=["shard", "doc_ids", "toxic", "lengths", "langs", "ids"])

    dealt = lambda df: df.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)))
    found = dealt(rows.mapInPandas(digest, "doc_id long, lang string, ids binary")).groupBy("shard").cogroup(dealt(known).groupBy("shard")).applyInPandas(pack, PACKED)
    done = written(found, "shards")
    shared.destroy()
    return done


@dataclass
class Shard:
    doc_ids: np.ndarray
    toxic: np.ndarray
    texts: list[np.ndarray]
    langs: list[str]

    @classmethod
    def of(cls, row: tuple) -> Shard:
        ids, ends = np.frombuffer(row.ids, np.uint32), np.cumsum(np.frombuffer(row.lengths, np.int64))
        return cls(np.frombuffer(row.doc_ids, np.int64), np.frombuffer(row.toxic, np.uint8).astype(float), np.split(ids, ends[:-1]), list(row.langs))

    def tunes(self) -> np.ndarray:
        return tunes(self.doc_ids)

    def halves(self) -> np.ndarray:
        return np.array([zlib.crc32(b"half %d" % x) % 2 for x in self.doc_ids])

    def chosen(self, mask: np.ndarray) -> Shard:
        pick = lambda x: [y for y, m in zip(x, mask, strict=True) if m]
        return Shard(self.doc_ids[mask], self.toxic[mask], pick(self.texts), pick(self.langs))


def tunes(doc_ids: Iterable[int]) -> np.ndarray:
    """Which documents calibrate and don't train."""
    return np.array([zlib.crc32(b"tune %d" % x) % 4 == 0 for x in doc_ids], bool)


def over_shards(shards: DataFrame, work: Callable[[Shard, int], pd.DataFrame], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for row in df.itertuples():
                yield work(Shard.of(row), int(row.shard))

    return shards.mapInPandas(run, schema)


def train_on(docs: DataFrame, marks: DataFrame, hold_out: bool = True, sample: int = SAMPLE, sample_words: int = SAMPLE_WORDS) -> Model:
    """The model of all labelled rows, of which sample documents and sample_words words at most reach the driver; with hold_out, rows whose crc32(id) mod 5 is 0 never train."""
    known = marks.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    if hold_out:
        known = known.filter(F.pmod(id_hash(), F.lit(5)) != 0)
    count, size = known.count(), docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not count:
        return Model()
    n = 1 if count <= sample and size <= 8 * sample_words else max(-(-count // SHARD), -(-size // SHARD_BYTES))
    shards = packed(docs, known, n, min(MARK_BITS, max(64, 1 << (16 * count).bit_length())))

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for row in df.itertuples():
                tune, toxic = tunes(np.frombuffer(row.doc_ids, np.int64)), np.frombuffer(row.toxic, np.uint8)
                yield pd.DataFrame([(len(toxic), int(np.frombuffer(row.lengths, np.int64).sum()), *(int(((tune == t) & (toxic == y)).sum()) for t in (False, True) for y in (0, 1)))])

    total = shards.select("doc_ids", "toxic", "lengths").mapInPandas(counts, "docs long, words long, a long, b long, c long, d long").agg(*[F.sum(x) for x in ("docs", "words", "a", "b", "c", "d")]).first()
    docs_n, words_n, *split = [int(x or 0) for x in total]
    if docs_n < 8 or not split[0] + split[2] or not split[1] + split[3]:
        return Model()

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for row in df.itertuples():
                own = Shard.of(row)
                fits = np.cumsum([len(x) for x in own.texts]) <= sample_words
                fits[sample:] = False
                own = own.chosen(fits)
                yield pd.DataFrame({"doc_id": own.doc_ids, "lang": [x or None for x in own.langs], "toxic": own.toxic.astype(int), "ids": [x.tobytes() for x in own.texts]})

    first = shards.select(F.min("shard")).first()[0]
    got = shards.filter(F.col("shard") == first).mapInPandas(head, "doc_id long, lang string, toxic int, ids binary").toArrow().to_pandas().sort_values("doc_id", ignore_index=True)
    texts, toxic = [np.frombuffer(x, np.uint32) for x in got["ids"]], got["toxic"].to_numpy(float)
    tune = tunes(got["doc_id"])
    apart = all(split)
    if not apart or len(set(toxic[tune])) < 2 or len(set(toxic[~tune])) < 2:
        tune[:] = True
        model = fit(texts, toxic)
    else:
        model = fit([x for x, t in zip(texts, tune, strict=True) if not t], toxic[~tune])
    if len(got) < docs_n:
        return trained_on(shards, model, split, apart)
    z = np.array([logit(x, model) for x, t in zip(texts, tune, strict=True) if t])
    model.scale = platt(z, toxic[tune])
    score = probability(z, model.scale)
    clean, langs = score[toxic[tune] == 0], got["lang"][tune][toxic[tune] == 0]
    above = lambda x: float(max(0.5, np.quantile(x, 1 - FALSE_ALARMS, method="higher") + 1e-9))
    model.threshold = above(clean) if len(clean) else 0.5
    model.thresholds = {k: above(clean[(langs == k).to_numpy()]) for k, n in langs.value_counts().items() if n >= LEAST}
    return replace(model, weights=None)


def trained_on(shards: DataFrame, model: Model, split: list[int], apart: bool) -> Model:
    """The model that starts at another's weights and is trained and calibrated by all shards."""
    context = shards.sparkSession.sparkContext
    train_part = lambda shard: shard.chosen(~shard.tunes()) if apart else shard
    tune_part = lambda shard: shard.chosen(shard.tunes()) if apart else shard
    fill = lambda texts: [x if len(x) else np.zeros(1, np.uint32) for x in texts]

    def held(shard: Shard, _: int) -> pd.DataFrame:
        """Texts that hold each bucket, by half and label; the last bucket's are all texts."""
        own, seen = train_part(shard), np.zeros((4, BUCKETS + 1), np.int64)
        for x, y, h in zip(fill(own.texts), own.toxic, own.halves(), strict=True):
            seen[2 * h + int(y), np.append(np.unique(x), BUCKETS)] += 1
        some = np.flatnonzero(seen.any(axis=0))
        return pd.DataFrame({"slot": some} | {f"c{k}": seen[k][some] for k in range(4)})

    found = over_shards(shards, held, "slot long, c0 long, c1 long, c2 long, c3 long").groupBy(F.col("slot").cast("int").alias("slot")).agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(4)]).toArrow()
    seen, slot = np.zeros((4, BUCKETS + 1)), found["slot"].to_numpy()
    for k in range(4):
        seen[k, slot] = found[f"c{k}"].to_numpy()
    texts, seen = seen[:, BUCKETS].reshape(2, 2), seen[:, :BUCKETS].reshape(2, 2, BUCKETS)
    of = lambda counts, n: excess_of(counts, float(n[1] / max(1.0, n.sum())))
    firsts, final = [of(seen[1 - k], texts[1 - k]) for k in (0, 1)], of(seen.sum(axis=0), texts.sum(axis=0))
    labels = texts.sum(axis=0)
    ratio = labels.sum() / (2 * np.maximum(1, labels))
    weights = model.weights or Weights(*(np.zeros(0) for _ in range(6)))
    for epoch in range(EPOCHS):
        shared = context.broadcast((weights, firsts, ratio))
        change = over_shards(shards, changes(shared, train_part, fill, epoch), "slot int, " + ", ".join(f"d{i} int" for i in range(DIM)))
        mean = change.groupBy("slot").agg(*[(F.sum(f"d{i}") / F.count("*") / FINE).cast("float").alias(f"d{i}") for i in range(DIM)]).toArrow()
        rows, slot = np.zeros((BUCKETS + dense_rows(weights), DIM), np.float32), mean["slot"].to_numpy()
        for i in range(DIM):
            rows[slot, i] = mean[f"d{i}"].to_numpy()
        weights.emb += rows[:BUCKETS]
        weights.trained[slot[slot < BUCKETS]] = True
        flat = rows[BUCKETS:].ravel()
        for p in weights.dense():
            p += flat[: p.size].reshape(p.shape)
            flat = flat[p.size :]
        shared.destroy()
    model = finished(weights, final)
    return calibrated(shards, replace(model, weights=None), tune_part)


def dense_rows(weights: Weights) -> int:
    return -(-sum(p.size for p in weights.dense()) // DIM)


def changes(shared: Broadcast, part: Callable[[Shard], Shard], fill: Callable[[list[np.ndarray]], list[np.ndarray]], epoch: int) -> Callable[[Shard, int], pd.DataFrame]:
    """What a shard's training changes each bucket's row by, and the other weights, which follow the buckets in rows of DIM numbers."""

    def work(shard: Shard, number: int) -> pd.DataFrame:
        before, firsts, ratio = shared.value
        own = part(shard)
        columns = ["slot", *(f"d{i}" for i in range(DIM))]
        if not len(own.toxic):
            return pd.DataFrame(columns=columns, dtype=np.int32)
        after = Weights(*(np.array(getattr(before, f.name)) for f in fields(before)))
        after.trained[:] = False
        train(after, fill(own.texts), own.toxic, own.halves(), firsts, ratio, np.random.default_rng([epoch, number]), 1)
        slots = np.flatnonzero(after.trained)
        flat = np.concatenate([(a - b).ravel() for a, b in zip(after.dense(), before.dense(), strict=True)])
        rest = np.zeros((dense_rows(before), DIM), np.float32)
        rest.ravel()[: len(flat)] = flat
        rows = np.concatenate((after.emb[slots] - before.emb[slots], rest))
        steps = np.rint(rows.astype(float) * FINE).astype(np.int32)
        return pd.DataFrame(np.concatenate((np.concatenate((slots, BUCKETS + np.arange(len(rest))))[:, None].astype(np.int32), steps), axis=1), columns=columns)

    return work


def calibrated(shards: DataFrame, model: Model, part: Callable[[Shard], Shard]) -> Model:
    """The model with its scale and thresholds, of counts of logits by step."""
    shared = shards.sparkSession.sparkContext.broadcast(model)

    def steps(shard: Shard, _: int) -> pd.DataFrame:
        own = part(shard)
        z = np.clip(np.ceil(np.array([logit(x, shared.value) for x in own.texts], float) * GRID), -64 * GRID, 64 * GRID)
        found = pd.DataFrame({"lang": [x or None for x in own.langs], "toxic": own.toxic.astype(int), "step": z.astype(int)})
        return found.groupby(["lang", "toxic", "step"], dropna=False).size().reset_index(name="n")

    found = written(over_shards(shards, steps, "lang string, toxic int, step int, n long").groupBy("lang", "toxic", "step").agg(F.sum("n").alias("n")), "logits")
    both = found.groupBy("toxic", "step").agg(F.sum("n").alias("n")).toArrow().to_pandas().sort_values(["toxic", "step"], ignore_index=True)
    model.scale = platt(both["step"].to_numpy(float) / GRID, both["toxic"].to_numpy(float), both["n"].to_numpy(float))
    clean = found.filter("toxic = 0")

    def above(counts: DataFrame, by: list[str]) -> DataFrame:
        """The smallest step that all but FALSE_ALARMS of the clean texts keep to."""
        upto = F.sum("n").over(Window.partitionBy(*by).orderBy("step"))
        rows = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
        return rows.filter(F.col("upto") >= F.ceil((F.col("all") - 1) * (1 - FALSE_ALARMS)) + 1).groupBy(*by).agg(F.min("step").alias("step"), F.first("all").alias("all"))

    score = lambda step: float(max(0.5, probability(np.array([step / GRID]), model.scale)[0] + 1e-9))
    every = clean.groupBy("step").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1))
    model.threshold = next((score(r.step) for r in above(every, ["one"]).collect()), 0.5)
    model.thresholds = {r.lang: score(r.step) for r in above(clean.filter("lang is not null"), ["lang"]).filter(F.col("all") >= LEAST).collect()}
    shared.destroy()
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score, the language's threshold, and flagged; docs' own columns of these names go."""
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, weights=None))

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        own = shared.value
        buckets = Buckets()
        z = np.array([logit(bucket_ids(x, buckets), own) for x in texts], float)
        return pd.Series(probability(z, own.scale))

    cases = F.lit(model.threshold)
    for name, value in sorted(model.thresholds.items()):
        cases = F.when(F.col("lang") == name, value).otherwise(cases)
    scored = docs.withColumn("score", score(whole("text"))).withColumn("threshold", cases)
    return scored.withColumn("flagged", F.col("score") >= F.col("threshold"))


def drop_toxic(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """docs without those that are flagged, each by a model that was trained on the other half of the ids."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    half = lambda: F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(2))
    packed = docs.select(F.struct(*columns).alias("doc"), "text", *(["lang"] if "lang" in docs.columns else [F.lit(None).cast("string").alias("lang")]), half().alias("half"))
    kept = [score_toxicity(packed.filter(F.col("half") == k), train_on(docs.filter(half() != k), marks.filter(half() != k), hold_out=False)).filter("not flagged").select("doc.*") for k in (0, 1)]
    return kept[0].unionAll(kept[1])
