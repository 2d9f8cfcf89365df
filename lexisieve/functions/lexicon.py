"""Term lists: blacklist, whitelist and aliases, normalised once and shipped to the kernel."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from lexisieve.functions.settings import LexiconError
from lexisieve.functions.views import BASE, LAST, ONSETS, base_view

EXACT_TOKEN, TOKEN_PREFIX = "exact_token", "token_prefix"


def _terms(entries: Iterable[str], form: str) -> frozenset[str]:
    out = set()
    for line in entries:
        if not isinstance(line, str):
            raise LexiconError("terms have to be strings")
        line = line.strip()
        if line and not line.startswith("#"):
            term = base_view(line, form).text.strip()
            if not term:
                raise LexiconError(f"nothing is left of {line!r}")
            out.add(term)
    return frozenset(out)


def parse_aliases(lines: Iterable[str]) -> list[tuple[str, str, str]]:
    """(alias, term, mode) of lines of three tab-separated fields; blank lines and comments are skipped."""
    out = []
    for n, line in enumerate(lines, 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        parts = [p.strip() for p in line.rstrip("\r\n").split("\t")]
        if len(parts) != 3 or not all(parts):
            raise LexiconError(f"line {n}: three tab-separated fields are needed")
        if parts[2] not in (EXACT_TOKEN, TOKEN_PREFIX):
            raise LexiconError(f"line {n}: mode {parts[2]!r}")
        out.append(tuple(parts))
    return out


def _normalised(rules: Iterable[tuple[str, str, str]], form: str) -> dict[str, tuple[str, str]]:
    out: dict[str, tuple[str, str]] = {}
    for alias, term, mode in rules:
        if mode not in (EXACT_TOKEN, TOKEN_PREFIX):
            raise LexiconError(f"mode {mode!r}")
        key, rule = base_view(alias, form).text.strip(), (base_view(term, form).text.strip(), mode)
        if not key or not rule[0]:
            raise LexiconError("an alias and its term must not be empty")
        if out.setdefault(key, rule) != rule:
            raise LexiconError(f"alias {key!r} has conflicting rules")
    return out


def longest_first(terms: Iterable[str]) -> list[str]:
    return sorted(terms, key=lambda t: (-len(t), t))


@dataclass(frozen=True)
class Lexicon:
    """Use Lexicon.build; all strings here are normalised already."""

    blacklist: frozenset[str]
    whitelist: frozenset[str] = frozenset()
    aliases: dict[str, tuple[str, str]] = field(default_factory=dict)
    unicode_form: str = "NFKC"

    @classmethod
    def build(cls, blacklist: Iterable[str] = (), whitelist: Iterable[str] = (), aliases: Iterable[tuple[str, str, str]] = (), unicode_form: str = "NFKC", defaults: Lexicon | None = None) -> Lexicon:
        """The union of the given lists, added to `defaults`; the terms of default aliases count as blacklisted, those of others have to be."""
        black, white, rules = set(_terms(blacklist, unicode_form)), set(_terms(whitelist, unicode_form)), {}
        if defaults:
            if defaults.unicode_form != unicode_form:
                raise LexiconError("the default lists have another Unicode form")
            black |= defaults.blacklist | {t for t, _ in defaults.aliases.values()}
            white |= defaults.whitelist
            rules = dict(defaults.aliases)
        own = _normalised(aliases, unicode_form)
        if missing := sorted({t for t, _ in own.values()} - black):
            raise LexiconError(f"alias terms that aren't blacklisted: {missing}")
        for key, rule in own.items():
            if rules.setdefault(key, rule) != rule:
                raise LexiconError(f"alias {key!r} has conflicting rules")
        return cls(frozenset(black), frozenset(white), rules, unicode_form)

    def initials(self) -> dict[str, str]:
        """Initial consonants of all-Hangul terms of two syllables or more; the first in (-length, term) order wins."""
        out: dict[str, str] = {}
        for term in longest_first(self.blacklist):
            if len(term) >= 2 and all(BASE <= ord(c) <= LAST for c in term):
                out.setdefault(base_view("".join(ONSETS[(ord(c) - BASE) // 588] for c in term), self.unicode_form).text, term)
        return out
