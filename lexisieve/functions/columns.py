"""Detection as Column functions.

`Sieve` binds a lexicon and settings.  `detect` runs the kernel once per row in
an Arrow UDF; `contains`, `mask` and the scalar accessors are native
expressions over its result.  A null text gives null; a text beyond
max_input_length, or one whose fuzzy search passes its limit, gives a struct
with `error` set and null matches, so that one document never fails a job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexisieve.functions.detector import Detector
from lexisieve.functions.lexicon import Lexicon
from lexisieve.functions.settings import Settings, SettingsError, profile
from lexisieve.functions.views import base_view

MATCH = T.StructType([T.StructField(n, k) for n, k in (("term", T.StringType()), ("matched_text", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("method", T.StringType()), ("score", T.DoubleType()))])
RESULT = T.StructType([T.StructField("normalized_text", T.StringType()), T.StructField("error", T.StringType()), T.StructField("matches", T.ArrayType(MATCH))])
_MATCH = pa.struct([("term", pa.string()), ("matched_text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("method", pa.string()), ("score", pa.float64())])
_RESULT = pa.struct([("normalized_text", pa.string()), ("error", pa.string()), ("matches", pa.list_(_MATCH))])
SLICE, SLICE_ROWS = 1 << 20, 512  # bytes and rows of texts that a kernel takes at once
_DETECTORS: dict[str, Detector] = {}  # of this Python worker


def _detector(key: str, lexicon: Lexicon, settings: Settings) -> Detector:
    if key not in _DETECTORS:
        if len(_DETECTORS) >= 64:
            _DETECTORS.clear()
        _DETECTORS[key] = Detector(lexicon, settings)
    return _DETECTORS[key]


def slices(batches: Iterator[pa.Array]) -> Iterator[list[str | None]]:
    """The texts of batches, SLICE bytes or one text at a time: what a kernel holds doesn't grow with the rows of a batch."""
    for texts in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, n = 0, len(texts)
        while at < n:
            before = ends[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, before + SLICE, side="right"))), at + SLICE_ROWS)
            yield texts.slice(at, to - at).to_pylist()
            at = to


class Sieve:
    """Detection with one lexicon under one profile or settings (the default is the balanced profile)."""

    def __init__(self, lexicon: Lexicon, profile_name: str | None = None, settings: Settings | None = None):
        if profile_name is not None and settings is not None:
            raise SettingsError("a profile or settings, not both")
        self.settings = settings or profile(profile_name or "balanced")
        self.lexicon = lexicon
        Detector(lexicon, self.settings)  # raises here rather than in a task
        text = repr((self.settings, sorted(self.settings.obfuscation_separators), sorted(lexicon.blacklist), sorted(lexicon.whitelist), sorted(lexicon.aliases.items())))
        key, own, on = hashlib.sha256(text.encode()).hexdigest(), lexicon, self.settings
        self._key = key

        def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            detector = _detector(key, own, on)
            for texts in slices(batches):
                rows = []
                for t in texts:
                    if t is None:
                        rows.append(None)
                        continue
                    normal, matches, error = detector(t)
                    found = None if matches is None else [vars(m) for m in matches]
                    rows.append({"normalized_text": normal, "error": error, "matches": found})
                yield pa.array(rows, _RESULT)

        def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            detector = _detector(key, own, on)
            for texts in slices(batches):
                rows = [None if t is None else detector(t)[1] for t in texts]
                yield pa.array([None if r is None else bool(r) for r in rows], pa.bool_())

        def only(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            detector = _detector(key, own, on)
            for texts in slices(batches):
                rows = [None if t is None else detector(t)[1] for t in texts]
                yield pa.array([None if r is None else [vars(m) for m in r] for r in rows], pa.list_(_MATCH))

        self._kernel, self._found, self._only = F.arrow_udf(kernel, RESULT), F.arrow_udf(found, T.BooleanType()), F.arrow_udf(only, T.ArrayType(MATCH))

    def detect(self, text: Column | str) -> Column:
        """struct<normalized_text, error, matches>; matches are disjoint and in the order of their spans."""
        return self._kernel(text if isinstance(text, Column) else F.col(text))

    def contains(self, text: Column | str) -> Column:
        """Whether anything is found; only the answer leaves the kernel."""
        return self._found(text if isinstance(text, Column) else F.col(text))

    def matches(self, text: Column | str) -> Column:
        """The matches of detect, null where it fails; normalised texts don't leave the kernel."""
        return self._only(text if isinstance(text, Column) else F.col(text))

    def register(self, spark: SparkSession, name: str) -> None:
        """SQL names: name(text) and name_contains(text) as functions, name_spans(text) as a table function for LATERAL."""
        spark.udf.register(name, self._kernel)
        spark.udf.register(f"{name}_contains", self._found)
        key, own, on = self._key, self.lexicon, self.settings

        class Spans:
            def eval(self, text: str):
                found = None if text is None else _detector(key, own, on)(text)[1]
                for m in found or ():
                    yield m.term, m.matched_text, m.start, m.end, m.method, m.score

        spark.udtf.register(f"{name}_spans", F.udtf(Spans, returnType=MATCH))

    def with_detection(self, df: DataFrame, text: str = "text", to: str = "detection") -> DataFrame:
        """df with the detection struct in a column of its own, so that later expressions don't run the kernel again."""
        return df.withColumn(to, self.detect(text))

    def spans(self, df: DataFrame, text: str = "text") -> DataFrame:
        """One row per match: the columns of df without text, and term, matched_text, start, end, method, score."""
        keep = [c for c in df.columns if c != text]
        # inline would have Spark infer a filter over the kernel's result, and run the kernel twice
        return df.select(*keep, self.matches(text).alias("_m")).select(*keep, F.inline_outer("_m")).where("term is not null")

    def mask(self, df: DataFrame, text: str = "text", char: str = "*", to: str = "masked") -> DataFrame:
        return self.with_detection(df, text, "_d").withColumn(to, masked(F.col(text), F.col("_d"), char)).drop("_d")


def found_by(sieves: dict[str, Sieve], text: Column | str) -> Column:
    """array<struct<profile, matches' fields>> of several sieves of one lexicon: each text is read once, and its common readings are made once."""
    if any(s.lexicon != next(iter(sieves.values())).lexicon for s in sieves.values()):
        raise SettingsError("sieves of one lexicon are needed")
    own = [(name, s._key, s.lexicon, s.settings) for name, s in sieves.items()]
    kind = pa.list_(pa.struct([("profile", pa.string()), *_MATCH]))

    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        detectors = [(name, _detector(*rest)) for name, *rest in own]
        for texts in slices(batches):
            rows = []
            for t in texts:
                shared: dict = {}
                rows.append(None if t is None else [{"profile": name, **vars(m)} for name, detector in detectors for m in detector(t, shared)[1] or ()])
            yield pa.array(rows, kind)

    shape = T.ArrayType(T.StructType([T.StructField("profile", T.StringType()), *MATCH]))
    return F.arrow_udf(kernel, shape)(text if isinstance(text, Column) else F.col(text))


def contains(detection: Column) -> Column:
    """Whether anything was found; null where detection failed."""
    return F.when(detection["matches"].isNotNull(), F.size(detection["matches"]) > 0)


def first(detection: Column) -> dict[str, Column]:
    """detected, matched_word, method and confidence, as the first match has them."""
    m = F.get(detection["matches"], 0)
    some = contains(detection)
    return {
        "detected": some,
        "matched_word": m["matched_text"],
        "method": F.when(some.isNotNull(), F.coalesce(m["method"], F.lit("none"))),
        "confidence": F.when(some.isNotNull(), F.coalesce(m["score"], F.lit(0.0))),
    }


def masked(text: Column, detection: Column, char: str = "*") -> Column:
    """text with each code point of each match replaced by char; null where detection failed."""
    if not isinstance(char, str) or len(char) != 1:
        raise SettingsError("char: exactly one code point")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, m):
        gap = F.substring(text, acc["at"] + 1, m["start"] - acc["at"])
        return F.struct(m["end"].alias("at"), F.concat(acc["out"], gap, F.repeat(F.lit(char), m["end"] - m["start"])).alias("out"))

    return F.aggregate(detection["matches"], start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def normalize(text: Column | str, form: str = "NFKC") -> Column:
    """struct<text, starts, ends>: normalised text and the original span of each of its code points."""

    def places(of: list) -> pa.Array:
        flat = [np.arange(x.start, x.stop, dtype=np.int32) if isinstance(x, range) else np.array(x, np.int32) for x in of]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, flat)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *flat])))

    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            views = [None if t is None else base_view(t, form) for t in texts]
            parts = [pa.array([v and v.text for v in views], pa.string()), places([v.starts if v else () for v in views]), places([v.ends if v else () for v in views])]
            yield pa.StructArray.from_arrays(parts, ["text", "starts", "ends"], mask=pa.array([v is None for v in views]))

    return F.arrow_udf(kernel, "struct<text:string,starts:array<int>,ends:array<int>>")(text if isinstance(text, Column) else F.col(text))


def original_span(view: Column, start: Column, end: Column) -> Column:
    """struct<start, end> in the original of the span [start, end) of a normalised text; null if it is empty or out of range."""
    ok = (start >= 0) & (start < end) & (end <= F.length(view["text"]))
    return F.when(ok, F.struct(F.element_at(view["starts"], start + 1).alias("start"), F.element_at(view["ends"], end).alias("end")))


# Native forms, without the kernel, for the text alone.

PYTHON_BLANK = r"[\x09-\x0D\x1C-\x20\x85\xA0  -     　]"


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(text, PYTHON_BLANK + "+", " ")


def without_separators(text: Column, separators: frozenset[str]) -> Column:
    """Separator runs between letters or digits go."""
    own = "".join("\\" + s for s in sorted(separators))
    return F.regexp_replace(text, rf"(?<=[\p{{L}}\p{{N}}])[{own}]+(?=[\p{{L}}\p{{N}}])", "")


def leak_key(text: Column) -> Column:
    """A key for leakage checks: lower case, no punctuation, separators or format characters, no immediate repeats.

    Exact for texts that are NFKC already; see leak_key_full for others.
    """
    folded = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(F.regexp_replace(folded, r"[\p{P}\p{Z}\p{Cf}]", ""), r"(?s)(.)\1+", "$1")


def leak_key_full(text: Column | str) -> Column:
    """leak_key for any text: NFKC and full case folding, in an Arrow UDF."""

    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import unicodedata

        def key(t: str) -> str:
            kept = [c for c in unicodedata.normalize("NFKC", t).casefold() if unicodedata.category(c)[0] not in "PZ" and unicodedata.category(c) != "Cf"]
            return "".join([c for i, c in enumerate(kept) if not i or kept[i - 1] != c])

        for texts in slices(batches):
            yield pa.array([None if t is None else key(t) for t in texts], pa.string())

    return F.arrow_udf(kernel, "string")(text if isinstance(text, Column) else F.col(text))


def deletion_signatures(word: Column) -> Column:
    """The word and all its variants without one character (distinct)."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) > 0, cut).otherwise(F.array().cast("array<string>"))))


def fuzzy_tokens(tokens: DataFrame, terms: DataFrame, token: str = "token", term: str = "term", distance: int = 1) -> DataFrame:
    """Pairs of distinct tokens and terms with an edit distance of 1 to `distance` (1 or 2), natively: an equi-join on deletion signatures, then levenshtein."""
    if distance not in (1, 2):
        raise SettingsError("distance: 1 or 2")

    def signed(df: DataFrame, name: str) -> DataFrame:
        s = deletion_signatures(F.col(name))
        if distance == 2:
            s = F.array_distinct(F.flatten(F.transform(s, deletion_signatures)))
        return df.select(name).distinct().select(name, F.explode(s).alias("_s"))

    # a token that is longer or shorter than every term by more than `distance` has no partner
    size = terms.agg(F.min(F.length(term)).alias("_least"), F.max(F.length(term)).alias("_most"))
    near = tokens.join(F.broadcast(size), F.length(token).between(F.col("_least") - distance, F.col("_most") + distance))
    pairs = signed(near, token).join(signed(terms, term), "_s").where(F.col(token) != F.col(term)).select(token, term).distinct()
    return pairs.where(F.levenshtein(F.col(token), F.col(term), distance).between(1, distance))
