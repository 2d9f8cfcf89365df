"""Detection settings, the three profiles, and the errors raised on the driver."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from unicodedata import normalize

METHODS = ("exact", "repeated", "separator", "whitespace", "keyboard", "jamo", "alias", "choseong", "mixed", "levenshtein")


class SieveError(Exception):
    """Any error of this package."""


class SettingsError(SieveError, ValueError):
    """A setting is out of its range."""


class LexiconError(SieveError, ValueError):
    """Term lists that can't be used."""

#: The signs that may stand between the letters of a term, by default.
SEPARATORS = "!@#$%^&*_-+=~.·,"


@dataclass(frozen=True)
class Settings:
    """All knobs of detection; a bare Settings() turns every method on.  Names and defaults are fixed values."""

    max_input_length: int = 4096
    unicode_form: str = "NFKC"
    repeat_reduction_threshold: int = 2
    obfuscation_separators: frozenset[str] = frozenset(SEPARATORS)
    max_whitespace_gap: int = 3
    exact_matching: bool = True
    alias_matching: bool = True
    choseong_matching: bool = True
    repeated_matching: bool = True
    separator_matching: bool = True
    whitespace_gap_matching: bool = True
    mixed_gap_matching: bool = True
    keyboard_matching: bool = True
    jamo_composition_matching: bool = True
    segmented_input_matching: bool = True
    fuzzy_matching: bool = True
    fuzzy_min_term_length: int = 3
    fuzzy_max_term_length: int = 32
    fuzzy_max_distance: int = 1
    fuzzy_min_score: float = 0.0
    fuzzy_max_operations: int = 250_000
    fuzzy_max_index_entries: int = 100_000

    def __post_init__(self):
        def check(ok: bool, what: str) -> None:
            if not ok:
                raise SettingsError(what)

        least = {"max_input_length": 1, "repeat_reduction_threshold": 2, "max_whitespace_gap": 1, "fuzzy_min_term_length": 3, "fuzzy_max_operations": 1, "fuzzy_max_index_entries": 1}
        for name, low in least.items():
            value = getattr(self, name)
            check(type(value) is int and value >= low, f"{name}: an integer of {low} or more")
        for f in fields(self):
            if f.name.endswith("_matching"):
                check(type(getattr(self, f.name)) is bool, f"{f.name}: a boolean")
        check(self.unicode_form in ("NFC", "NFKC"), "unicode_form: NFC or NFKC")
        check(type(self.fuzzy_max_term_length) is int and self.fuzzy_max_term_length >= self.fuzzy_min_term_length, "fuzzy_max_term_length: an integer not under fuzzy_min_term_length")
        check(type(self.fuzzy_max_distance) is int and self.fuzzy_max_distance in (1, 2) and self.fuzzy_max_distance < self.fuzzy_min_term_length, "fuzzy_max_distance: 1 or 2, and under fuzzy_min_term_length")
        check(type(self.fuzzy_min_score) in (int, float) and 0 <= self.fuzzy_min_score <= 1, "fuzzy_min_score: a number from 0 to 1")
        check(isinstance(self.obfuscation_separators, frozenset) and all(isinstance(s, str) for s in self.obfuscation_separators), "obfuscation_separators: a frozenset of strings")
        folded = frozenset(normalize(self.unicode_form, s) for s in self.obfuscation_separators)
        check(all(len(s) == 1 and not s.isalnum() and not s.isspace() for s in folded), "obfuscation_separators: single signs, neither letters, digits nor white space")
        object.__setattr__(self, "obfuscation_separators", folded)
        object.__setattr__(self, "fuzzy_min_score", float(self.fuzzy_min_score))


_STRICT = {f.name: f.name in ("exact_matching", "alias_matching") for f in fields(Settings) if f.name.endswith("_matching")}


def profile(name: str, **changes) -> Settings:
    """strict: exact and alias; balanced: choseong too; aggressive: every method."""
    if name == "strict":
        out = Settings(**_STRICT)
    elif name == "balanced":
        out = Settings(**_STRICT | {"choseong_matching": True})
    elif name == "aggressive":
        out = Settings()
    else:
        raise SettingsError("profile: strict, balanced or aggressive")
    return replace(out, **changes) if changes else out
