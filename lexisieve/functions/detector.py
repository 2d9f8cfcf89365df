"""The detection kernel: candidates of every method, then one greedy fold per method.

Each method lists all its candidates (view start, end, term), keeps those whose
boundaries hold, and folds them in the order (longest term, original start,
term, view start, original end), taking each that overlaps neither a protected
nor a taken character, in the view or in the original.  Taking all candidates
and sorting gives the same spans as trying shorter terms only where longer ones
failed, because a shorter term at a start sorts after the longer one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import ahocorasick

from lexisieve.functions import views as V
from lexisieve.functions.lexicon import EXACT_TOKEN, Lexicon
from lexisieve.functions.settings import Settings, SettingsError

#: Particles that may follow a term inside its token.
PARTICLES = frozenset({
    "가", "까지", "께", "께서", "나", "는", "도", "든", "든지", "라도", "랑", "로", "를", "마다", "마저", "만", "만큼", "밖에", "보다", "부터",
    "뿐", "에", "에게", "에서", "와", "으로", "은", "을", "의", "이", "이나", "이든", "이든지", "이라도", "이랑", "조차", "처럼", "한테",
})
LONGEST_PARTICLE = max(map(len, PARTICLES))
SOLID = re.compile(r"[^\W_]+")  # letters and digits
REMEMBERED = 65_536  # tokens whose near terms a detector keeps, if they are as short as terms are
TOO_LONG, TOO_COSTLY = "input_too_long", "fuzzy_operation_limit"


@dataclass(frozen=True)
class Match:
    term: str
    matched_text: str
    start: int
    end: int
    method: str
    score: float = 1.0


class Scanner:
    """All occurrences of a set of strings, by an Aho-Corasick automaton."""

    def __init__(self, words):
        self.words = sorted(set(words))
        self.automaton = ahocorasick.Automaton()
        for w in self.words:
            self.automaton.add_word(w, w)
        if self.words:
            self.automaton.make_automaton()

    def all(self, text: str):
        """(start, end, word) of every occurrence."""
        if self.words:
            for last, w in self.automaton.iter(text):
                yield last + 1 - len(w), last + 1, w

    def any(self, text: str) -> bool:
        return next(self.all(text), None) is not None

    def longest(self, text: str) -> list[tuple[int, int, str]]:
        """The longest word at each start."""
        best: dict[int, tuple[int, int, str]] = {}
        for hit in self.all(text):
            if hit[0] not in best or hit[1] > best[hit[0]][1]:
                best[hit[0]] = hit
        return list(best.values())


class Edges:
    """Token boundaries of a view, looked up where they are asked for; marks belong to the character before them."""

    def __init__(self, text: str):
        self.text = text

    def after(self, i: int) -> int:
        """The first character from i on that is no mark."""
        while i < len(self.text) and V.extends(self.text[i]):
            i += 1
        return i

    def start(self, i: int) -> bool:
        """No letter or digit ends before i."""
        i -= 1
        while i >= 0 and V.extends(self.text[i]):
            i -= 1
        return i < 0 or not self.text[i].isalnum()

    def end(self, i: int) -> bool:
        """No letter or digit follows from i on."""
        i = self.after(i)
        return i == len(self.text) or not self.text[i].isalnum()

    def particle(self, i: int) -> bool:
        """A particle starts at i and ends its token."""
        for j in range(i + 1, min(len(self.text), i + LONGEST_PARTICLE) + 1):
            if self.text[i:j] in PARTICLES and self.after(j) == j and self.end(j):
                return True
        return False

    def closes(self, i: int) -> bool:
        i = self.after(i)
        return self.end(i) or self.particle(i)

    def hangul_to_end(self, i: int) -> bool:
        """From i on, the token is one or more Hangul syllables only."""
        k = i
        while k < len(self.text) and ((mark := V.extends(self.text[k])) or self.text[k].isalnum()):
            if not mark and not V.BASE <= ord(self.text[k]) <= V.LAST:
                return False
            k += 1
        return i < len(self.text) and V.BASE <= ord(self.text[i]) <= V.LAST

    def alias(self, s: int, e: int, mode: str) -> bool:
        e = self.after(e)
        return self.start(s) and (self.end(e) or (mode != EXACT_TOKEN and self.hangul_to_end(e)))


def _mark(mask: bytearray, s: int, e: int) -> None:
    mask[s:e] = b"\1" * (e - s)


def _hit(mask, s: int, e: int) -> bool:
    return mask.find(1, s, e) >= 0


def fold(text: str, v: V.View, candidates, method: str, guard: bytes, protected: bytes, taken: bytes | None = None, after=None, canonical=None) -> list[Match]:
    """Greedy choice among (start, end, term) of a view; `guard` and `protected` are the whitelist's characters in view and original."""
    ranked = []
    for s, e, term in candidates:
        stop = after(e) if after else e
        o, p = v.starts[s], v.ends[stop - 1]
        ranked.append((-len(term), o, term, s, p, e))
    if not ranked:
        return []
    ranked.sort()
    seen, used = bytearray(len(v.text)), bytearray(taken) if taken else bytearray(len(text))
    out = []
    for _, o, term, s, p, e in ranked:
        if _hit(guard, s, e) or _hit(protected, o, p) or _hit(seen, s, e) or _hit(used, o, p):
            continue
        _mark(seen, s, e)
        _mark(used, o, p)
        out.append(Match(canonical[term] if canonical else term, text[o:p], o, p, method))
    return sorted(out, key=lambda m: (m.start, m.end, m.term))


def deletions(word: str, most: int) -> set[str]:
    """word without any 0 to `most` of its characters."""
    return {"".join(c for i, c in enumerate(word) if i not in gone) for n in range(min(most, len(word)) + 1) for gone in map(set, combinations(range(len(word)), n))}


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, most + 1 if it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


class Detector:
    """Detects the terms of a lexicon under settings; build once, call often."""

    def __init__(self, lexicon: Lexicon, settings: Settings):
        if lexicon.unicode_form != settings.unicode_form:
            raise SettingsError("the lexicon has another Unicode form")
        self.lexicon, self.settings = lexicon, settings
        self.black, self.white = Scanner(lexicon.blacklist), Scanner(lexicon.whitelist)
        self.aliases = Scanner(lexicon.aliases) if settings.alias_matching else Scanner(())
        self.alias_terms = {a: t for a, (t, _) in lexicon.aliases.items()}
        self.initials = lexicon.initials() if settings.choseong_matching else {}
        self.initial_scan = Scanner(self.initials)
        spaced = [t for t in lexicon.blacklist if len(t) >= 2 and not any(c.isspace() for c in t)]
        self.blank_free = Scanner(spaced) if settings.whitespace_gap_matching else Scanner(())
        self.mixed = Scanner([t for t in lexicon.blacklist if len(t) >= 2 and t.isalnum()]) if settings.mixed_gap_matching else Scanner(())
        self.signatures: dict[str, set[str]] = {}
        self.tokens: dict[str, tuple[int, list[tuple[str, int]]]] = {}
        self.distant: set[str] = set()
        if settings.fuzzy_matching:
            entries = 0
            for t in lexicon.blacklist:
                if t.isalnum() and settings.fuzzy_min_term_length <= len(t) <= settings.fuzzy_max_term_length:
                    for s in deletions(t, settings.fuzzy_max_distance):
                        entries += 1
                        self.signatures.setdefault(s, set()).add(t)
            if entries > settings.fuzzy_max_index_entries:
                raise SettingsError("fuzzy_max_index_entries: the lexicon needs more")
            fuzzy = set().union(*self.signatures.values())
            lengths = [len(t) for t in fuzzy]
            d = settings.fuzzy_max_distance
            self.fuzzy_lengths = range(max(1, min(lengths) - d), max(lengths) + d + 1) if lengths else range(0)
            # of the d + 1 pieces of a term, d edits leave one whole
            self.pieces = Scanner([t[len(t) * k // (d + 1) : len(t) * (k + 1) // (d + 1)] for t in fuzzy for k in range(d + 1)])
            # no text costs more operations a character
            self.fuzzy_rate = max([(1 + n + (d - 1) * n * (n - 1) / 2 + n * len(fuzzy)) / n for n in self.fuzzy_lengths], default=0)

    def _holds(self, reading: str) -> bool:
        """Whether a reading's text holds a term of either list."""
        return self.black.any(reading) or self.white.any(reading)

    @staticmethod
    def _spells(scanner: Scanner, text: str, skipped: str) -> bool:
        """Whether a word of scanner shows once all skipped signs are gone; if not, no reading that leaves out some of them has one."""
        if not any(c in text for c in skipped):
            return False
        return scanner.any(text.translate(dict.fromkeys(map(ord, skipped))))

    def _over_blanks(self, text: str, v: V.View, edges: Edges):
        """Terms spelled across short single blanks, at least one of them."""
        if not self._spells(self.blank_free, v.text, " "):
            return
        widest = self.settings.max_whitespace_gap
        kept = [i for i in range(len(v.text)) if not V.short_blank(text, v, i, widest)]
        squeezed = "".join([v.text[i] for i in kept])
        for s, e, term in self.blank_free.all(squeezed):
            i, j = kept[s], kept[e - 1] + 1
            # every blank left out between two letters is one view character; two in a row end the word
            if j - i > len(term) and all(kept[k + 1] - kept[k] <= 2 for k in range(s, e - 1)) and edges.start(i) and edges.closes(j):
                yield i, j, term

    def _mixed(self, text: str, v: V.View, edges: Edges, protected: bytes, taken: bytes) -> list[Match]:
        """Terms spelled across at least one blank and one separator."""
        separators, widest = self.settings.obfuscation_separators, self.settings.max_whitespace_gap
        b, kept, blanks, signs = V._Builder(), [], [0], [0]
        blank = sign = False
        for i, c in enumerate(v.text):
            if c == " " and V.short_blank(text, v, i, widest):
                blank = bool(kept)
            elif c in separators:
                sign = bool(kept)
            else:
                end = v.ends[i]
                if c.isalnum() and edges.after(i + 1) > i + 1:
                    end = v.ends[edges.after(i + 1) - 1]
                b.put(c, v.starts[i], end)
                kept.append(i)
                blanks.append(blanks[-1] + blank)
                signs.append(signs[-1] + sign)
                blank = sign = False
        if not blanks[-1] or not signs[-1]:
            return []
        p = b.view()
        found = [(s, e, t) for s, e, t in self.mixed.all(p.text) if blanks[e] > blanks[s + 1] and signs[e] > signs[s + 1] and edges.start(kept[s]) and edges.closes(kept[e - 1] + 1)]
        return fold(text, p, found, "mixed", bytes(len(p.text)), protected, taken, Edges(p.text).after) if found else []

    def _near(self, token: str) -> tuple[int, list[tuple[str, int]]]:
        """The operations that a token costs and the terms near it with their distances; remembered for tokens that come again."""
        known = self.tokens.get(token)
        if known is None:
            own, most = deletions(token, self.settings.fuzzy_max_distance), self.settings.fuzzy_max_distance
            terms = set().union(*(self.signatures.get(s, ()) for s in own))
            near = [(t, d) for t in sorted(terms - {token}) if (d := edit_distance(t, token, most)) <= most]
            if len(self.tokens) >= REMEMBERED:
                self.tokens.clear()
            known = self.tokens[token] = len(own) + len(terms) * len(token), near
        return known

    def _close(self, text: str) -> set[str]:
        """The tokens near a term, which hold a piece of it; those that aren't are remembered."""
        out = set()
        for token in set(SOLID.findall(text)) - self.distant:
            if len(token) in self.fuzzy_lengths:
                if self.pieces.any(token) and self._near(token)[1]:
                    out.add(token)
                else:
                    if len(self.distant) >= REMEMBERED:
                        self.distant.clear()
                    self.distant.add(token)
        return out

    def _fuzzy(self, text: str, v: V.View, boundaries, guard: bytes, protected: bytes, taken: bytes) -> list[Match]:
        """Whole tokens at an edit distance of 1 to the most allowed; raises OverflowError past the operation limit."""
        least, cost, n = self.settings.fuzzy_min_score, 0, len(v.text)
        # where the limit is out of reach, only tokens near a term count
        close = self._close(v.text) if n * self.fuzzy_rate <= self.settings.fuzzy_max_operations else None
        if close is not None and not close:
            return []
        tokens = [(m.start(), m.end(), *self._near(m.group())) for m in SOLID.finditer(v.text) if m.end() - m.start() in self.fuzzy_lengths and (close is None or m.group() in close)]
        if sum([t[2] for t in tokens]) <= self.settings.fuzzy_max_operations and not any([t[3] for t in tokens]):
            return []
        edges, best = boundaries(), {}
        for i, j, spent, near in tokens:
            if not (edges.start(i) and edges.end(j)):
                continue
            cost += spent
            if cost > self.settings.fuzzy_max_operations:
                raise OverflowError
            for t, d in near:
                score = 1.0 - d / max(len(t), j - i)
                if score >= least:
                    o, p = v.starts[i], v.ends[j - 1]
                    rank = (-len(t), d, -(j - i), o, t, i, p, j, score)
                    best[t, o, p] = min(best.get((t, o, p), rank), rank)
        seen, used, out = bytearray(n), bytearray(taken), []
        for _, _, _, o, t, s, p, e, score in sorted(best.values()):
            if not (_hit(guard, s, e) or _hit(protected, o, p) or _hit(seen, s, e) or _hit(used, o, p)):
                _mark(seen, s, e)
                _mark(used, o, p)
                out.append(Match(t, text[o:p], o, p, "levenshtein", score))
        return sorted(out, key=lambda m: (m.start, m.end, m.term))

    def __call__(self, text: str, shared: dict | None = None) -> tuple[str | None, list[Match] | None, str | None]:
        """(normalised text, matches in the order of their spans, error).

        Detectors of one lexicon may be called with one `shared` dictionary for the same text: each reading is then made once.
        """
        on, shared = self.settings, {} if shared is None else shared

        separators, widest = on.obfuscation_separators, on.max_whitespace_gap
        rules = on.unicode_form, separators, widest, on.repeat_reduction_threshold

        def once(name: str, make):
            if (name, rules) not in shared:
                shared[name, rules] = make()
            return shared[name, rules]

        if len(text) > on.max_input_length:
            return None, None, TOO_LONG
        v = once("base", lambda: V.base_view(text, on.unicode_form))
        keys = on.keyboard_matching and V._LATIN.search(v.text) is not None
        # spans are made only for readings that hold a term, or a whitelisted one
        keyboard = once("keyboard", lambda: V.keyboard_view(v) if self._holds(V.keyboard_text(v.text)) else v) if keys else v
        jamo = once("jamo", lambda: V.jamo_view(text, v, on.unicode_form)) if on.jamo_composition_matching else v
        wide_keyboard, wide_jamo, wide_initials = keyboard, jamo, v
        source = keys or jamo is not v or (on.choseong_matching and any(c in text for c in V.ONSETS))
        if on.segmented_input_matching and source and (" " in v.text or not separators.isdisjoint(v.text)):
            if keys and once("holds", lambda: self._holds(V.keyboard_text(V.joined_text(text, v, separators, widest)))):
                wide_keyboard = once("wide keyboard", lambda: V.keyboard_view(V.joined_view(text, v, frozenset(V.KEYS), separators, widest)))
            if jamo is not v:
                wide_jamo = once("wide jamo", lambda: V.jamo_view(text, v, on.unicode_form, (separators, widest)))
            if on.choseong_matching:
                wide_initials = once("wide initials", lambda: V.joined_view(text, v, V.INITIALS, separators, widest))
        readings = {
            "base": v,
            "repeated": once("repeated", lambda: V.repeated_view(v, on.repeat_reduction_threshold)) if on.repeated_matching else v,
            "separator": once("separator", lambda: V.separator_view(v, separators)) if on.separator_matching else v,
            "keyboard": keyboard,
            "jamo": jamo,
            "wide keyboard": wide_keyboard,
            "wide jamo": wide_jamo,
            "wide initials": wide_initials,
        }
        guards, protected, made = {}, bytearray(len(text)), {}
        for name, r in readings.items():
            if id(r) not in made:
                if self.lexicon.whitelist and (spans := self.white.longest(r.text)):
                    made[id(r)] = guard = bytearray(len(r.text))
                    for s, e, _ in spans:
                        _mark(guard, s, e)
                        _mark(protected, r.starts[s], r.ends[e - 1])
                else:
                    made[id(r)] = bytearray(len(r.text))
            guards[name] = made[id(r)]
        groups: list[list[Match]] = []
        edges = None

        def boundaries() -> Edges:
            nonlocal edges
            edges = edges or Edges(v.text)
            return edges

        def plain(name: str, method: str, reference: V.View | None) -> None:
            r = readings[name]
            if reference is None or not r.same(reference):
                groups.append(fold(text, r, self.black.all(r.text), method, guards[name], protected))

        if on.exact_matching:
            plain("base", "exact", None)
        plain("repeated", "repeated", v)
        plain("separator", "separator", v)
        if on.whitespace_gap_matching and self._spells(self.blank_free, v.text, " "):
            groups.append(fold(text, v, self._over_blanks(text, v, boundaries()), "whitespace", guards["base"], protected, after=boundaries().after))
        plain("keyboard", "keyboard", v)
        plain("jamo", "jamo", v)
        plain("wide keyboard", "keyboard", keyboard)
        plain("wide jamo", "jamo", jamo)
        if found := list(self.aliases.all(v.text)):
            ok = [(s, e, a) for s, e, a in found if boundaries().alias(s, e, self.lexicon.aliases[a][1])]
            groups.append(fold(text, v, ok, "alias", guards["base"], protected, after=boundaries().after, canonical=self.alias_terms))
        for name in ("base", "wide initials"):
            r = readings[name]
            if (name == "base" or not r.same(v)) and (found := self.initial_scan.longest(r.text)):
                own = boundaries() if name == "base" else Edges(r.text)
                ok = [(s, e, t) for s, e, t in found if own.start(s) and own.closes(e)]
                groups.append(fold(text, r, ok, "choseong", guards[name], protected, after=own.after, canonical=self.initials))
        out, taken = [], bytearray(len(text))

        def merge(group: list[Match]) -> None:
            for m in group:
                if not _hit(taken, m.start, m.end):
                    _mark(taken, m.start, m.end)
                    out.append(m)

        for group in groups:
            merge(group)
        if on.mixed_gap_matching and self._spells(self.mixed, v.text, " " + "".join(separators)):
            merge(self._mixed(text, v, boundaries(), protected, taken))
        if self.signatures:
            try:
                merge(self._fuzzy(text, v, boundaries, guards["base"], protected, taken))
            except OverflowError:
                return None, None, TOO_COSTLY
        return v.text, sorted(out, key=lambda m: (m.start, m.end, m.term)), None
