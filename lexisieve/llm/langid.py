"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The likelihood of a word is the sum, over all its segmentations into pieces,
of the product of their probabilities: a forward pass over its characters.
Words are independent, so a text's log-likelihood is a sum over words, and
each distinct word of a batch is scored once, all words of a length at a time.

Piece probabilities are fitted by expectation-maximisation (forward-backward)
on a bounded sample of distinct labelled texts: at most SAMPLE_DOCS texts and
SAMPLE_CHARS characters a language (fewer if there are many languages, so that
SAMPLE_ALL bounds all), in the order of a hash of the text.  A language with too
few texts of SAMPLE_TEXT characters or less also takes the beginnings of longer
ones.  More than MAX_LANGUAGES labels are an error: no label is left out silently.

Words are runs of letters, lower-cased; a run of more than 64 letters counts
as several of 64.  Letters that no piece covers have a fixed small probability.
Sums are rescaled on the way, so that runs in any script have finite scores.

Defined results: a null text, or one without a letter, is `und` with score 0;
without any labelled text all are.  Rows with equal texts have equal results;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexisieve.llm import arrays as A

SAMPLE_DOCS = 200
SAMPLE_CHARS = 600_000
SAMPLE_ALL = 4000  # texts of all languages
SAMPLE_TEXT = 20_000  # longer texts come last into the sample, cut to this length
MAX_LANGUAGES = 1000
RUN = 64
LONGEST = 16  # characters of the longest pieces that are looked for
SCALED = 8
UNKNOWN = 1e-7
CACHE = 300_000
ROUNDS = 3


def default_vocabulary() -> list[str]:
    import public_tokenizers

    return vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def vocabulary(path: str) -> list[str]:
    """The text pieces of a SentencePiece model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def letter_runs(word: str) -> list[str]:
    """The runs of letters of a word, lower-cased, at most RUN letters each, the first of the word marked as its start."""
    word = word.lower()
    runs = [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split()
    return [("▁" if i == 0 else "") + r[i : i + RUN] for r in runs for i in range(0, len(r), RUN)]


class Pieces:
    """Finds the pieces that spell the substrings of many words at once."""

    def __init__(self, pieces: list[str]):
        self.longest = min(LONGEST, max(map(len, pieces), default=1))
        pieces = sorted({p for p in pieces if len(p) <= self.longest})
        key = np.array([self.hashes(self.codes([p]))[0, len(p)] for p in pieces], np.uint64) if pieces else np.zeros(0, np.uint64)
        order = np.argsort(key)
        self.key, self.pieces = key[order], [pieces[i] for i in order]
        self.n = len(pieces)

    @staticmethod
    def codes(words: list[str]) -> np.ndarray:
        """(words, length) code points of words of one length."""
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1)

    @staticmethod
    def hashes(codes: np.ndarray) -> np.ndarray:
        """(words, length + 1) prefix sums of the polynomial of each word."""
        n = codes.shape[1]
        total = np.zeros((len(codes), n + 1), np.uint64)
        np.cumsum(A.mix(codes.astype(np.uint64) + np.uint64(1)) * A.powers(A._P, n), axis=1, out=total[:, 1:])
        return total

    def table(self, codes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """(from, to) -> piece numbers of that substring of each word: n where there is none, n + 1 for a single unknown letter."""
        total, n, out = self.hashes(codes), codes.shape[1], {}
        inverse = A.powers(A._P_INV, n + 1)
        for j in range(n):
            for i in range(j + 1, min(n, j + self.longest) + 1):
                h = (total[:, i] - total[:, j]) * inverse[j]
                at = np.minimum(np.searchsorted(self.key, h), self.n - 1) if self.n else np.zeros(len(h), np.int64)
                hit = self.key[at] == h if self.n else np.zeros(len(h), bool)
                if i == j + 1:
                    out[j, i] = np.where(hit, at, self.n + 1)
                elif hit.any():
                    out[j, i] = np.where(hit, at, self.n)
        return out


def forward(table: dict, n: int, p: np.ndarray, words: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sums over the segmentations of each prefix: n + 1 arrays (words, languages), and the logarithms of what each is to be multiplied by.

    Every SCALED characters the sums in reach are divided by the last one, so
    that a run of any length in any script stays far from underflow.
    """
    near, scale = [np.ones((words, p.shape[1]))], np.zeros((words, p.shape[1]))
    out, scales = [near[0]], [scale]
    for i in range(1, n + 1):
        acc = np.zeros((words, p.shape[1]))
        for j in range(max(0, i - LONGEST), i):
            if (at := table.get((j, i))) is not None:
                acc += near[j] * p[at]
        near.append(acc)
        if i % SCALED == 0:
            for j in range(max(0, i - LONGEST), i + 1):
                near[j] = near[j] / acc
            scale = scale + np.log(acc)
        out.append(near[i])
        scales.append(scale)
    return out, scales


def backward(table: dict, n: int, p: np.ndarray, words: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The same for each suffix: that from character j on is at place j."""
    turned = {(n - i, n - j): at for (j, i), at in table.items()}
    out, scales = forward(turned, n, p, words)
    return out[::-1], scales[::-1]


def by_length(words: list[str], block: int = 20_000):
    """(indices, code points) of words in groups of one length."""
    size = np.array([len(w) for w in words])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        for k in range(0, len(at), block):
            part = at[k : k + block]
            yield part, Pieces.codes([words[i] for i in part])


def log_likelihoods(finder: Pieces, p: np.ndarray, words: list[str]) -> np.ndarray:
    """(words, languages) natural log-likelihoods, always finite."""
    out = np.zeros((len(words), p.shape[1]))
    for at, codes in by_length(words):
        a, scales = forward(finder.table(codes), codes.shape[1], p, len(at))
        out[at] = np.log(a[-1]) + scales[-1]
    return out


class Model:
    def __init__(self, langs: list[str], finder: Pieces, p: np.ndarray):
        self.langs, self.finder, self.p = langs, finder, p


def fit(texts: list[tuple[str, str]], pieces: list[str]) -> Model | None:
    """A model from (language, text) pairs."""
    langs = sorted({lang for lang, _ in texts})
    if not langs:
        return None
    number: dict[str, int] = {}
    counts: list[dict[int, int]] = [{} for _ in langs]
    for lang, text in texts:
        own = counts[langs.index(lang)]
        for word in text.split():
            for run in letter_runs(word):
                k = number.setdefault(run, len(number))
                own[k] = own.get(k, 0) + 1
    words = list(number)
    weight = np.zeros((len(words), len(langs)))
    for c, own in enumerate(counts):
        weight[list(own), c] = list(own.values())
    finder = Pieces(pieces)
    p = np.full((finder.n + 2, len(langs)), 1 / max(1, finder.n))
    p[finder.n], p[finder.n + 1] = 0, UNKNOWN
    for _ in range(ROUNDS):
        seen = np.zeros_like(p)
        for at, codes in by_length(words):
            n, table = codes.shape[1], finder.table(codes)
            (a, a_scale), (b, b_scale) = forward(table, n, p, len(at)), backward(table, n, p, len(at))
            share = weight[at] / a[n]
            for (j, i), piece in table.items():
                mass = a[j] * p[piece] * b[i] * share
                if n >= SCALED:
                    mass *= np.exp(a_scale[j] + b_scale[i] - a_scale[n])
                for c in range(len(langs)):
                    seen[:, c] += np.bincount(piece, weights=mass[:, c], minlength=len(seen))
        p[: finder.n] = (seen[: finder.n] + 0.02) / (seen[: finder.n].sum(axis=0) + 0.02 * finder.n)
        if not np.isfinite(p).all():
            raise ArithmeticError("the piece probabilities are not finite")
    return Model(langs, finder, p)


_SCORED: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # what this worker has scored, by model


def _scorer(model: Model | None):
    name = uuid.uuid4().hex

    def run(batches):
        known, value = _SCORED.get(name, (np.zeros(0, np.uint64), None))
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for i, j in A.pieces(text, 2 << 20):
                part = text.slice(i, j - i)
                buf, off = A.text_buffer(part)
                starts, ends, first = A.word_spans(buf, off)
                h = A.span_hashes(A._BYTE[buf], starts, ends)
                uniq, index, inverse = np.unique(h, return_index=True, return_inverse=True)
                n_lang = len(model.langs) if model else 1
                if value is None:
                    value = np.zeros((0, n_lang + 1))
                place = np.minimum(np.searchsorted(known, uniq), max(0, len(known) - 1))
                new = known[place] != uniq if len(known) else np.ones(len(uniq), bool)
                if new.any():
                    raw = buf.tobytes()
                    fresh = [letter_runs(raw[starts[k] : ends[k]].decode("utf-8", "replace")) for k in index[new]]
                    runs = list(dict.fromkeys(r for w in fresh for r in w))
                    own = np.zeros((len(fresh), n_lang + 1))
                    if runs:
                        number = {r: k for k, r in enumerate(runs)}
                        score = log_likelihoods(model.finder, model.p, runs) if model else np.zeros((len(runs), 1))
                        row = np.repeat(np.arange(len(fresh)), [len(w) for w in fresh])
                        col = [number[r] for w in fresh for r in w]
                        np.add.at(own[:, :-1], row, score[col])
                        own[:, -1] = [len(w) for w in fresh]
                    if len(known) > CACHE:
                        known, value = uniq[~new], value[place[~new]]
                    merged = np.concatenate((known, uniq[new]))
                    order = np.argsort(merged)
                    known, value = merged[order], np.concatenate((value, own))[order]
                    _SCORED.clear()
                    _SCORED[name] = known, value
                per = value[np.searchsorted(known, uniq)] if len(uniq) else np.zeros((0, n_lang + 1))
                rows = A.row_of(first)
                total = np.stack([np.bincount(rows, weights=per[inverse, c], minlength=j - i) for c in range(n_lang + 1)], axis=1)
                lang, score = ["und"] * (j - i), np.zeros(j - i)
                if model:
                    some, ll = total[:, -1] > 0, total[:, :-1]
                    best = ll.argmax(axis=1)
                    post = 1 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1)
                    lang = [model.langs[b] if s else "und" for b, s in zip(best, some, strict=True)]
                    score = np.where(some, post, 0.0)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), pa.array(lang, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return run


def learn(labelled: DataFrame, pieces: list[str] | None = None) -> Model | None:
    """A model from labelled rows (text, lang): a bounded sample in the order of a hash of the text."""
    rows = labelled.where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), (F.length("text") > SAMPLE_TEXT).alias("long"), F.substring("text", 1, SAMPLE_TEXT).alias("text"), F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("rank"))
    # distinct texts, as equal texts share one draw
    distinct = rows.select("lang", "long", "rank").distinct().groupBy("lang").agg(F.count_if(~F.col("long")).alias("short"), F.count_if("long").alias("long"), F.count("*").alias("n"))
    count = {r["lang"]: (r["short"], r["long"]) for r in distinct.orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()}
    if not count:
        return None
    if len(count) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled")
    each = max(1, min(SAMPLE_DOCS, SAMPLE_ALL // len(count)))

    def cut(n: int) -> int:
        """A share of n texts that yields a language's sample and some to spare; what is over goes below."""
        return min(1 << 40, int((1.5 * each + 20) / max(1, n) * (1 << 40)))

    limits = [(F.create_map(*[F.lit(x) for lang, n in count.items() for x in (lang, value(*n))])) for value in (lambda short, long: cut(short), lambda short, long: cut(long) if short < each else 0)]
    limit = F.when(F.col("long"), limits[1][F.col("lang")]).otherwise(limits[0][F.col("lang")])
    taken = rows.where(F.col("rank") < limit).distinct().orderBy("long", "rank", "lang", "text").limit(4 * SAMPLE_ALL + 60 * MAX_LANGUAGES).collect()
    texts, size = [], {}
    for r in sorted(taken, key=lambda r: (r["long"], r["rank"], r["lang"], r["text"])):
        n, chars = size.get(r["lang"], (0, 0))
        if n < each and chars < SAMPLE_CHARS:
            size[r["lang"]] = (n + 1, chars + len(r["text"]))
            texts.append((r["lang"], r["text"]))
    return fit(texts, pieces if pieces is not None else default_vocabulary())


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (doc_id, text first) with lang_pred and score, the probability of that language among those learned."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), *[c for c in docs.columns if c not in ("doc_id", "text", "lang_pred", "score")])
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_scorer(model), schema)


def held_out(doc_id, mod: int, remainder: int):
    """crc32 of doc_id as text, modulo mod, is remainder (a null doc_id counts as empty)."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % mod == remainder
