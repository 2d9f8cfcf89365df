"""Log-bilinear language model trained with noise-contrastive estimation.

Classes to predict: the most frequent training words, whose number grows with
the square root of the corpus (see vocabulary_size), the end of a text, and
RARE classes that share all other words by hash.  The two tokens before predict
a vector by element-wise context weights, c1 * r[x1] + c2 * r[x2], where x is a
context class: one for each of the FREQUENT commonest words, others by hash,
and the start.  A class scores by its product with q[w] plus a bias.  Training
tells data from noise drawn from the class frequencies; a batch shares its
noise, so that its scores are one matrix product.

Scores are normalised over all classes.  exp(q . (c1 r1 + c2 r2)) is a product
of a factor of x1 and a factor of x2, so the normalisers of all pairs of
context classes are one matrix product over the classes to predict, computed in
row blocks by the cluster.  A word of a rare class has, within it, its smoothed
share (c + 1) / (N' + V' + 1) of the training counts N' of the V' words there.

Training is layout-independent: texts are dealt by hash to a number of parts
that follows from their size, in a fixed order.  In each of ROUNDS passes every
part trains from the same start, and each vector becomes the average of its
versions, weighted by how often the part has seen its class.

Counts of all words are exact over the whole training corpus: each chunk of
documents sends its distinct words with their training counts to buckets, and
the buckets answer with totals (see chunks).

Defined results: a null text counts as empty and is the end token alone;
a null doc_id hashes as an empty text; repeated rows have equal scores; extra
columns are carried along; an empty table gives an empty result; without
training texts every count is zero and the score equals the base score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexisieve.llm import arrays as A
from lexisieve.llm import chunks as C
from lexisieve.llm.spark_utils import discard, persist_table

MOST_WORDS = 1 << 18  # of a model that is shipped to every task: 18 MB
FREQUENT, HASHED, RARE = 767, 256, 256
WIDTH, NOISE, DRAWN, BATCH = 16, 16, 64, 4096  # NOISE: of a token, spread over the DRAWN samples of a batch
ROUNDS, RATE, FALL = 2, 0.1, 0.5
GROWN = 1e-5  # where the sums of squares start: a class seen once moves little
PART_BYTES = 16 << 20
FAN = 8
COUNTED = "chunk long, bucket long, n long, v long, answer binary, rare binary"


def vocabulary_size(total: int) -> int:
    """Words with a class of their own for so many bytes of text."""
    return min(MOST_WORDS, max(500, math.isqrt(total)))


def _counts(buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h, first = A.all_words(table.column("text"), lower=True)
        uniq, inverse = np.unique(h, return_inverse=True)
        train = np.repeat(table.column("train").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(first))
        count = np.bincount(inverse, weights=train, minlength=len(uniq)).astype(np.int64)
        runs = C.cuts(C.bucket_of(uniq, buckets))
        return pa.table({"bucket": pa.array([b for b, _, _ in runs], pa.int64()), "chunk": pa.array([key[0].as_py()] * len(runs), pa.int64()), "words": A.binaries([uniq[i:j].tobytes() for _, i, j in runs]), "counts": A.binaries([C.pack_ints(count[i:j]) for _, i, j in runs])})

    return run


def _total(most: int):
    """One bucket's totals, for each chunk in its own order; a row of chunk -1 with N, V, the most frequent words, and N and V by rare class."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        count = np.concatenate([C.unpack_ints(x) for x in table.column("counts").to_pylist()])
        uniq, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(inverse, weights=count, minlength=len(uniq)).astype(np.int64)
        top = np.lexsort((uniq, -total))[:most]
        top = top[total[top] > 1]
        answers = [C.pack_ints(x) for x in np.split(total[inverse], np.cumsum([len(v) for v in lists])[:-1])]
        shares = np.concatenate([np.bincount(rare_class(uniq), weights=w, minlength=RARE) for w in (total, total > 0)]).astype(np.int64)
        n = len(answers)
        return pa.table({
            "chunk": pa.array([*table.column("chunk").to_pylist(), -1], pa.int64()),
            "bucket": pa.array([key[0].as_py()] * (n + 1), pa.int64()),
            "n": pa.array([0] * n + [int(total.sum())], pa.int64()),
            "v": pa.array([0] * n + [int((total > 0).sum())], pa.int64()),
            "answer": A.binaries([*answers, uniq[top].tobytes() + total[top].tobytes()]),
            "rare": A.binaries([b""] * n + [shares.tobytes()]),
        })

    return run


def rare_class(h: np.ndarray) -> np.ndarray:
    """The rare class of word hashes, by bits that don't decide their bucket."""
    return (h & np.uint64(RARE - 1)).astype(np.int64)


def _tops(batches):
    for batch in batches:
        for data in batch.column(0).to_pylist():
            half = len(data) // 2
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data[:half], np.int64)), pa.array(np.frombuffer(data[half:], np.int64))], names=["word", "count"])


def _shares(batches):
    for batch in batches:
        for data in batch.column(0).to_pylist():
            n, v = np.frombuffer(data, np.int64).reshape(2, RARE)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(RARE)), pa.array(n), pa.array(v)], names=["class", "n", "v"])


class Vocabulary:
    """Classes to predict: 0 .. k - 1 the frequent words, k the end, then the rare classes; and their context classes."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, end_count: int, n: int, v: int, rare_n: np.ndarray, rare_v: np.ndarray):
        order = np.argsort(words)
        self.words, own = words[order], counts[order]
        self.end = k = len(words)
        self.size = k + 1 + RARE
        at = rare_class(self.words)
        self.rare_n = rare_n - np.bincount(at, weights=own, minlength=RARE).astype(np.int64)
        self.rare_v = rare_v - np.bincount(at, minlength=RARE)
        self.n, self.v, self.end_count = n + end_count, v + (end_count > 0), end_count
        self.freq = np.concatenate((own, [end_count], self.rare_n)) + 1.0
        frequent = np.lexsort((self.words, -own))[:FREQUENT]
        self.context = np.concatenate((FREQUENT + (self.words % np.uint64(HASHED)).astype(np.int64), [FREQUENT], FREQUENT + np.arange(RARE) % HASHED))
        self.context[frequent] = np.arange(len(frequent))
        self.start = FREQUENT + HASHED
        self.contexts = self.start + 1

    def classes(self, h: np.ndarray) -> np.ndarray:
        rare = self.end + 1 + rare_class(h)
        if not len(self.words):
            return rare
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, rare)

    def stream(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Token classes of all rows, an end after each, with the context classes of the two tokens before each; and the row offsets."""
        off = first + np.arange(len(first))
        token = np.empty(off[-1], np.int64)
        ends = off[1:] - 1
        inner = np.ones(len(token), bool)
        inner[ends] = False
        token[inner], token[ends] = words, self.end
        as_context = self.context[token]
        one, two = np.full((2, len(token)), self.start)
        one[1:] = as_context[:-1]
        two[2:] = as_context[:-2]
        head = off[:-1]
        one[head] = self.start
        two[head] = self.start
        second = head[np.diff(off) > 1] + 1
        two[second] = self.start
        return token, one, two, off


class Network:
    """r: vectors of context classes, q and bias: of predicted classes, c: weights of the two context places; single precision."""

    def __init__(self, r, q, bias, c):
        self.r, self.q, self.bias, self.c = r, q, bias, c

    @classmethod
    def fresh(cls, vocabulary: Vocabulary) -> Network:
        rng = np.random.Generator(np.random.PCG64(1))
        share = vocabulary.freq / vocabulary.freq.sum()
        parts = rng.normal(0, 0.1, (vocabulary.contexts, WIDTH)), rng.normal(0, 0.1, (vocabulary.size, WIDTH)), np.log(share), np.full((2, WIDTH), 0.5)
        return cls(*[p.astype(np.float32) for p in parts])

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.q, self.bias, self.c]

    def normalisers(self, rows: slice) -> np.ndarray:
        """log sum exp of the class scores for pairs of context classes, those of the first in rows: a matrix product."""
        r, c, top_one, top_two = self.r.astype(np.float64), self.c.astype(np.float64), None, None
        one, two = r[rows] * c[0], r * c[1]
        blocks = [slice(i, i + 4096) for i in range(0, len(self.q), 4096)]

        def scores(b: slice) -> tuple[np.ndarray, np.ndarray]:
            q = self.q[b].astype(np.float64)
            return one @ q.T, two @ q.T + self.bias[b]

        for b in blocks:
            x, y = (m.max(axis=1, keepdims=True) for m in scores(b))
            top_one, top_two = (x, y) if top_one is None else (np.maximum(top_one, x), np.maximum(top_two, y))
        total = 0.0
        for b in blocks:
            x, y = scores(b)
            total = total + np.exp(x - top_one) @ np.exp(y - top_two).T
        return top_one + top_two.T + np.log(total)

    def log_probability(self, token, one, two, z) -> np.ndarray:
        out = np.empty(len(token))
        r0, r1, q = self.r.astype(np.float64) * self.c[0], self.r.astype(np.float64) * self.c[1], self.q.astype(np.float64)
        for i in range(0, len(token), 1 << 16):
            s = slice(i, i + (1 << 16))
            out[s] = ((r0[one[s]] + r1[two[s]]) * q[token[s]]).sum(axis=1) + self.bias[token[s]] - z[one[s], two[s]]
        return out


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and the sums of their values."""
    order = np.argsort(rows.astype(np.uint16) if len(rows) and rows.max() < 1 << 16 else rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    return rows[first], np.add.reduceat(values[order], first, axis=0)


class Trainer:
    """Noise-contrastive estimation with AdaGrad on weighted (one, two, token) triples."""

    def __init__(self, net: Network, freq: np.ndarray, seed: int, rate: float):
        self.net, self.rate = Network(*[p.copy() for p in net.parts()]), np.float32(rate)
        self.grown = [np.full(p.shape, GROWN, np.float32) for p in self.net.parts()]
        noise = freq**0.75
        noise = noise / noise.sum()
        self.cdf, self.log_noise = np.cumsum(noise), np.log(NOISE * noise).astype(np.float32)
        self.rng = np.random.Generator(np.random.PCG64(seed))
        self.tokens, self.contexts, self.weight = np.zeros(len(self.net.q)), np.zeros(len(self.net.r)), 0.0

    def learn(self, token: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        a, b = np.int64(len(self.net.r)), np.int64(len(self.net.q))
        triple, count = np.unique((one * a + two) * b + token, return_counts=True)
        order = self.rng.permutation(len(triple))
        size = min(BATCH, max(64, len(order) // 32))
        for i in range(0, len(order), size):
            pick = order[i : i + size]
            t = triple[pick]
            self._step(t % b, t // b // a, t // b % a, count[pick].astype(np.float32))
        self.tokens += np.bincount(token, minlength=b)
        self.contexts += np.bincount(one, minlength=a) + np.bincount(two, minlength=a)
        self.weight += len(token)

    def _move(self, part: int, rows, grad: np.ndarray) -> None:
        p, grown = self.net.parts()[part], self.grown[part]
        grown[rows] += grad * grad
        p[rows] += self.rate * grad / np.sqrt(grown[rows])

    def _step(self, token, one, two, weight) -> None:
        net = self.net
        noise = np.minimum(np.searchsorted(self.cdf, self.rng.random(DRAWN)), len(self.cdf) - 1)
        weight = weight / weight.sum()
        r1, r2, q, qn = net.r[one], net.r[two], net.q[token], net.q[noise]
        h = net.c[0] * r1 + net.c[1] * r2
        data = weight / (1 + np.exp(np.einsum("nd,nd->n", h, q) + net.bias[token] - self.log_noise[token]))
        drawn = h @ qn.T
        drawn += net.bias[noise] - self.log_noise[noise]
        np.negative(drawn, out=drawn)
        np.exp(np.minimum(drawn, 80, out=drawn), out=drawn)
        drawn += 1
        np.divide((-NOISE / DRAWN) * weight[:, None], drawn, out=drawn)
        dh = data[:, None] * q + drawn @ qn
        rows, grad = _by_row(np.concatenate((token, noise)), np.concatenate((np.concatenate((data[:, None] * h, data[:, None]), axis=1), np.concatenate((drawn.T @ h, drawn.sum(axis=0)[:, None]), axis=1))))
        dc = np.stack(((dh * r1).sum(axis=0), (dh * r2).sum(axis=0)))
        at, dr = _by_row(np.concatenate((one, two)), np.concatenate((dh * net.c[0], dh * net.c[1])))
        self._move(0, at, dr)
        self._move(1, rows, grad[:, :-1])
        self._move(2, rows, grad[:, -1])
        self._move(3, slice(None), dc)

    def weights(self) -> list[np.ndarray]:
        """How much each vector of each part of the network counts in the average."""
        return [self.contexts + 1e-3, self.tokens + 1e-3, self.tokens + 1e-3, np.full(2, self.weight)]


def _flat(parts: list[np.ndarray]) -> bytes:
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32).tobytes()


def _train(vocabulary: Vocabulary, net: Network, rate: float):
    """The texts of one part -> its number and its parameters, each times its weight, and the weights."""

    def run(batches):
        from pyspark import TaskContext

        trainer = Trainer(net, vocabulary.freq, 7, rate)
        for batch in batches:
            for i, j in A.pieces(batch.column(0), 4 << 20):
                h, first = A.all_words(batch.column(0).slice(i, j - i), lower=True)
                token, one, two, _ = vocabulary.stream(vocabulary.classes(h), first)
                trainer.learn(token, one, two)
        if not trainer.weight:
            return
        weights = trainer.weights()
        data = _flat([(p.T * w).T for p, w in zip(trainer.net.parts(), weights, strict=True)] + weights)
        if not np.isfinite(np.frombuffer(data, np.float32)).all():
            raise ArithmeticError("training gave parameters that are not finite")
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), A.binaries([data])], names=["part", "params"])

    return run


def _summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = 0.0
    for x in table.sort_by("part").column("params"):
        total = total + np.frombuffer(x.as_py(), np.float32).astype(np.float64)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "params": A.binaries([total.astype(np.float32).tobytes()])})


def train(texts: DataFrame, vocabulary: Vocabulary, total: int) -> Network:
    """A network from all texts (doc_id, text) of `total` bytes."""
    net = Network.fresh(vocabulary)
    size = PART_BYTES * min(64.0, max(1.0, math.sqrt(total / 2**29)))
    parts = max(1, math.ceil(total / size))
    # a text hashes with its doc_id, so copies spread
    dealt = texts.select("doc_id", "text").repartition(parts, F.xxhash64("doc_id", "text")).sortWithinPartitions("doc_id", "text").select("text")
    shapes = [p.shape for p in net.parts()]
    cuts = np.cumsum([math.prod(s) for s in shapes] + [s[0] for s in shapes])[:-1]
    for k in range(ROUNDS):
        left = persist_table(dealt.mapInArrow(_train(vocabulary, net, RATE * FALL**k), "part long, params binary"), "lm-parts")
        n = left.agg(F.max("part")).first()[0]
        if n is None:
            discard(left)
            return net
        while n > 0:  # FAN at a time
            n //= FAN
            sums = persist_table(left.withColumn("part", F.floor(F.col("part") / FAN)).withColumn("key", F.col("part")).groupBy("key").applyInArrow(_summed, "part long, params binary"), "lm-parts")
            discard(left)
            left = sums
        flat = np.split(np.frombuffer(left.first()["params"], np.float32), cuts)
        discard(left)
        half = len(shapes)
        net = Network(*[(p.reshape(s).T / w).T.astype(np.float32) for p, w, s in zip(flat[:half], flat[half:], shapes, strict=True)])
    return net


def normalisers(spark: SparkSession, net: Network, block: int = 128) -> np.ndarray:
    """The table of all normalisers, its row blocks computed by the cluster; its size is fixed."""

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                z = net.normalisers(slice(i * block, (i + 1) * block))
                yield pa.RecordBatch.from_arrays([pa.array([i]), A.binaries([z.tobytes()])], names=["id", "z"])

    n = -(-len(net.r) // block)
    rows = spark.range(0, n, 1, n).mapInArrow(run, "id long, z binary").orderBy("id").collect()
    return np.concatenate([np.frombuffer(r["z"]) for r in rows]).reshape(len(net.r), len(net.r))


def _score(vocabulary: Vocabulary, net: Network, z: np.ndarray, buckets: int, names: list[str]):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        h, first = A.all_words(docs.column("text"), lower=True)
        uniq, inverse = np.unique(h, return_inverse=True)
        got = dict(zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist(), strict=True))
        count = np.zeros(len(uniq), np.int64)
        for b, i, j in C.cuts(C.bucket_of(uniq, buckets)):
            count[i:j] = C.unpack_ints(got[b])
        kind = vocabulary.classes(uniq)
        token, one, two, off = vocabulary.stream(kind[inverse], first)
        inner = np.ones(len(token), bool)
        inner[off[1:] - 1] = False
        c = np.full(len(token), vocabulary.end_count)
        c[inner] = count[inverse]
        base = np.log10((c + 1) / (vocabulary.n + vocabulary.v + 1))
        logp = net.log_probability(token, one, two, z) / math.log(10)
        rare = token > vocabulary.end
        kind = token[rare] - vocabulary.end - 1
        logp[rare] += np.log10((c[rare] + 1) / (vocabulary.rare_n + vocabulary.rare_v + 1)[kind])
        out = {n: docs.column(n) for n in names}
        return pa.table(out | {
            "n_tokens": pa.array(np.diff(off)),
            "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), off[:-1]) if len(docs) else np.zeros(0, np.int64)),
            "train_tokens": pa.array(np.full(len(docs), vocabulary.n)),
            "base_score": pa.array(np.add.reduceat(base, off[:-1])),
            "score": pa.array(np.add.reduceat(logp if vocabulary.n else base, off[:-1])),
        })

    return run


def score(docs: DataFrame, train_flag: str) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score; train_flag is a boolean column of docs.

    Logarithms are to base 10 and summed over a text's tokens.
    """
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "chunk", "train")
    docs = docs.withColumns({"text": F.coalesce(F.col("text").cast("string"), F.lit("")), "train": F.coalesce(F.col(train_flag), F.lit(False))})
    names = [c for c in docs.columns if c not in new]
    keyed, buckets, total = C.chunked(docs.select(*names, "train") if "doc_id" in names else docs.select(*names, "train", F.lit(None).cast("long").alias("doc_id")))
    most = vocabulary_size(total)
    counted = keyed.select("chunk", "text", "train").groupBy("chunk").applyInArrow(_counts(buckets), "bucket long, chunk long, words binary, counts binary").groupBy("bucket").applyInArrow(_total(most), COUNTED)
    counted = persist_table(counted, "lm-counts")
    sums = counted.where("chunk = -1")
    n, v = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    top = sums.select("answer").mapInArrow(_tops, "word long, count long").orderBy(F.desc("count"), "word").limit(most).toArrow()
    rare = np.zeros((2, RARE), np.int64)
    for r in sums.select("rare").mapInArrow(_shares, "class long, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        rare[:, r["class"]] = r["n"], r["v"]
    ends = docs.where("train").count()
    words, counts = (top.column(c).to_numpy().astype(np.int64) for c in ("word", "count"))
    vocabulary = Vocabulary(words.view(np.uint64), counts, ends, n, v, *rare)
    net = train(keyed.where("train"), vocabulary, total)
    schema = T.StructType([*[docs.schema[c] for c in names], *[T.StructField(c, T.LongType()) for c in new[:3]], *[T.StructField(c, T.DoubleType()) for c in new[3:5]]])
    answers = counted.where("chunk >= 0").groupBy("chunk")
    z = normalisers(docs.sparkSession, net)
    return keyed.groupBy("chunk").cogroup(answers).applyInArrow(_score(vocabulary, net, z, buckets, names), schema)
