"""Secret scanning with a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived
(on the driver, from the parsed expression): a conjunction of disjunctions
that any matching text, lower-cased, must satisfy.  The index holds a posting
(trigram, document key) for each trigram that some rule asks for; postings are
combined per document into bit masks (map-side first), the masks answer the
queries, and candidates are joined back to be verified with the expression.
A rule without mandatory trigrams, such as the run of hexadecimal digits,
scans all texts.  The document key is a 64-bit hash: a collision only adds a
candidate.

Spans are half-open code-point offsets, found from the pieces between matches
(split) and the matches themselves (regexp_extract_all).

Defined results: a null text counts as empty and has no spans; repeated rows
have equal results; extra columns are carried along; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """kind, expression (valid for Python and Java), and the least length of a group of the match (0: all of it)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
)
# A key in PEM goes to its END line (no five dashes come before it), or where there is none over the run of base64 lines
# and what white space and escaped line ends part them; loops over groups are bounded, since Java's recurse.
_KEY_BEGIN = "-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"
_KEY_TO_END = "[^-]*(?:-{1,4}[^-]+){0,64}-----END [A-Z ]{0,32}PRIVATE KEY-----"
_KEY_LINES = r"[\\\x20\x09-\x0Dnr]*(?:[A-Za-z-]{1,32}:\x20[^\x0A\x0D]{0,200}[\\\x20\x09-\x0Dnr]+){0,4}[A-Za-z0-9+/]{16,}[A-Za-z0-9+/=\\\x20\x09-\x0D]*"
ADDED = (
    Rule("private_key", _KEY_BEGIN + "(?:" + _KEY_TO_END + "|" + _KEY_LINES + ")?"),
    Rule("code_host", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", "AIza[0-9A-Za-z_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("payment", "[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("login_url", r"[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{3,64}@"),
)
EXACT = 48  # strings a subexpression may stand for before it counts as anything

Query = tuple[tuple[frozenset[str], ...], ...]  # a conjunction of disjunctions of trigram conjunctions


def _strings(node) -> list[str] | None:
    """All lower-cased strings a parsed node can match, or None if too many to list."""
    op, arg = node
    if op is rc.LITERAL:
        return [chr(arg).lower()]
    if op is rc.IN:
        out = set()
        for kind, value in arg:
            if kind is rc.LITERAL:
                out.add(chr(value).lower())
            elif kind is rc.RANGE and value[1] - value[0] < 8:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return sorted(out) if len(out) <= 8 else None
    if op is rc.SUBPATTERN:
        return _product(arg[3])
    if op is rc.BRANCH:
        parts = [_product(x) for x in arg[1]]
        return sorted({s for p in parts for s in p}) if all(p is not None for p in parts) and sum(map(len, parts)) <= EXACT else None
    if op is rc.MAX_REPEAT and arg[1] <= 2:
        one = _product(arg[2])
        out = {""} if arg[0] == 0 else set()
        if one is None:
            return None
        runs = [""]
        for n in range(1, arg[1] + 1):
            runs = [a + b for a in runs for b in one]
            if n >= arg[0]:
                out |= set(runs)
        return sorted(out) if len(out) <= EXACT else None
    return None


def _product(nodes) -> list[str] | None:
    out = [""]
    for node in nodes:
        part = _strings(node)
        if part is None or len(out) * len(part) > EXACT:
            return None
        out = [a + b for a in out for b in part]
    return out


def _flush(strings: list[str], clauses: list) -> None:
    if strings and all(len(s) >= 3 for s in strings):
        clauses.append(tuple(sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}, key=sorted)))


def trigram_query(pattern: str) -> Query:
    """What any text that matches pattern must hold; empty if nothing is mandatory."""
    clauses: list = []

    def walk(nodes) -> None:
        run = [""]
        for node in nodes:
            part = _strings(node)
            if part is not None and len(run) * len(part) <= EXACT:
                run = [a + b for a in run for b in part]
                continue
            _flush(run, clauses)
            run = part if part is not None else [""]
            op, arg = node
            if part is None and op is rc.SUBPATTERN:
                walk(arg[3])
            elif part is None and op is rc.MAX_REPEAT and arg[0] >= 1:
                walk(arg[2])
        _flush(run, clauses)

    walk(rp.parse(pattern))
    return tuple(clauses)


def _any(options: list[Column]) -> Column:
    out = options[0]
    for x in options[1:]:
        out = out | x
    return out


def candidates(docs: DataFrame, rules: tuple[Rule, ...], key: str, text: str) -> DataFrame:
    """(key, _kinds): for each document with a candidate, the kinds of indexed rules whose trigram query it meets."""
    asked = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in asked.values() for clause in q for option in clause for g in option})
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    present = F.array(*[F.when(F.col("_lower").contains(g), F.lit(i)) for i, g in enumerate(grams)])
    postings = docs.select(key, lower.alias("_lower")).select(key, F.explode(F.array_compact(present)).alias("gram"))
    n_masks = len(grams) // 62 + 1
    at = [F.bit_or(F.when(F.floor(F.col("gram") / 62) == m, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("gram") % 62).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"m{m}") for m in range(n_masks)]
    masks = postings.groupBy(key).agg(*at)

    def met(option: frozenset[str]) -> Column:
        out = F.lit(True)
        for m in range(n_masks):
            need = sum(1 << (i % 62) for i, g in enumerate(grams) if g in option and i // 62 == m)
            if need:
                out = out & (F.col(f"m{m}").bitwiseAND(F.lit(need).cast("long")) == F.lit(need).cast("long"))
        return out

    kinds = []
    for kind, query in asked.items():
        ok = F.lit(True)
        for clause in query:
            ok = ok & _any([met(option) for option in clause])
        kinds.append(F.when(ok, F.lit(kind)))
    return masks.select(key, F.array_compact(F.array(*kinds)).alias("_kinds")).where(F.size("_kinds") > 0)


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """array<struct<start int, ord int, end int, kind string>> of the rule's matches."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    steps = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("hit"), part.alias("part"))
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(x["hit"].isNotNull() & (F.length(x["part"]) >= rule.least), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """docs with secrets: array<struct<start, ord, end, kind>> in the order of start, then of the rules."""
    rules = base + added
    keyed = docs.withColumns({"_text": F.coalesce(F.col("text").cast("string"), F.lit(""))})
    keyed = keyed.withColumn("_key", F.xxhash64(*[c for c in ("doc_id",) if c in docs.columns], "_text"))
    found = candidates(keyed, rules, "_key", "_text")
    joined = keyed.join(found, "_key", "left")
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    lists = []
    for i, rule in enumerate(rules):
        may = F.array_contains("_kinds", rule.kind) if trigram_query(rule.pattern) else F.col("_text").rlike(rule.pattern)
        lists.append(F.when(may, _spans(rule, i, F.col("_text"))).otherwise(none))
    return joined.withColumn("secrets", F.array_sort(F.concat(*lists))).drop("_text", "_key", "_kinds")


def digest(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by mark (overlapping ones by a single mark); other texts stay as they are."""

    def step(acc, s):
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    found = scan(docs)
    clean = F.aggregate("secrets", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.size("secrets") > 0, clean).otherwise(F.col("text")))
