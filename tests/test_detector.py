import itertools
import random

import pytest

from lexisieve.functions.detector import TOO_COSTLY, TOO_LONG, Detector, Scanner, deletions, edit_distance, fold
from lexisieve.functions.lexicon import Lexicon, parse_aliases
from lexisieve.functions.settings import LexiconError, Settings, SettingsError, profile
from lexisieve.functions.views import base_view


def found(detector, text):
    return [(m.term, m.start, m.end, m.method) for m in detector(text)[1]]


ALL = profile("aggressive")
BABO = Detector(Lexicon.build(["바보", "멍청이"], ["바보상자"], [("ㅂㅂㅇ", "바보", "exact_token"), ("빠보", "바보", "token_prefix")]), ALL)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("너 바보야", [("바보", 2, 4, "exact")]),
        ("바보상자", []),
        ("바보상자와 바보", [("바보", 6, 8, "exact")]),
        ("바아아보", [("바보", 0, 4, "repeated")]),
        ("바*보", [("바보", 0, 3, "separator")]),
        ("바  보", [("바보", 0, 4, "whitespace")]),
        ("바  보가", [("바보", 0, 4, "whitespace")]),
        ("바    보", []),
        ("가바 보", []),
        ("바 * 보", [("바보", 0, 5, "mixed")]),
        ("qkqh", [("바보", 0, 4, "keyboard")]),
        ("q k q h", [("바보", 0, 7, "keyboard")]),
        ("ㅁㅓㅇㅊㅓㅇㅇㅣ", [("멍청이", 0, 8, "jamo")]),
        ("ㅂㅂ", [("바보", 0, 2, "choseong")]),
        ("ㅂ ㅂ이", [("바보", 0, 3, "choseong")]),
        ("ㅂㅂㅇ", [("바보", 0, 3, "alias")]),
        ("빠보들", [("바보", 0, 2, "alias")]),
        ("멍텅이", [("멍청이", 0, 3, "levenshtein")]),
        ("멍​청이", [("멍청이", 0, 4, "exact")]),
        ("", []),
    ],
)
def test_methods(text, expected):
    assert found(BABO, text) == expected


def test_long_texts_and_costs_are_errors_of_the_row():
    assert BABO("x" * 4097) == (None, None, TOO_LONG)
    small = Detector(Lexicon.build(["abcd"]), profile("aggressive", fuzzy_max_operations=5))
    assert small("abce abcf abcg")[2] == TOO_COSTLY


def test_longest_term_wins_and_results_are_disjoint():
    d = Detector(Lexicon.build(["ab", "abc", "cd"]), profile("strict"))
    assert found(d, "abcd") == [("abc", 0, 3, "exact")]
    assert found(d, "abxabc") == [("ab", 0, 2, "exact"), ("abc", 3, 6, "exact")]


def lazy(text, terms, protected):
    """Shorter terms are tried only where a longer one failed and its start is still free."""
    taken, out = list(protected), []
    queue = []
    for s in range(len(text)):
        here = sorted((t for t in terms if text.startswith(t, s)), key=len, reverse=True)
        if here:
            queue.append((-len(here[0]), s, here))
    while queue:
        queue.sort()
        _, s, here = queue.pop(0)
        t = here[0]
        if not any(taken[s : s + len(t)]):
            taken[s : s + len(t)] = [1] * len(t)
            out.append((s, t))
        elif not taken[s] and len(here) > 1:
            queue.append((-len(here[1]), s, here[1:]))
    return sorted(out)


def test_eager_fold_equals_lazy_fallback():
    rng = random.Random(3)
    for _ in range(1500):
        terms = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 5))}
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        protected = bytes(rng.random() < 0.1 for _ in text)
        v = base_view(text)
        got = [(m.start, m.term) for m in fold(text, v, Scanner(terms).all(text), "exact", bytes(len(text)), protected)]
        assert got == lazy(text, terms, protected)


def test_fuzzy_is_complete_on_a_small_alphabet():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    terms = ["".join(t) for t in itertools.product("abc", repeat=3)]
    queries = ["".join(t) for n in (2, 3, 4) for t in itertools.product("abc", repeat=n)]
    off = {f"{m}_matching": False for m in ("exact", "repeated", "separator", "whitespace_gap", "mixed_gap", "alias", "keyboard", "jamo_composition", "segmented_input", "choseong")}
    for term in terms[::4]:
        d = Detector(Lexicon.build([term]), Settings(**off))
        for q in queries:
            assert bool(d(q)[1]) == (distance(term, q) == 1), (term, q)
    assert edit_distance("abcd", "acbd", 2) == 2 and edit_distance("abc", "xyz", 2) == 3
    assert deletions("ab", 1) == {"ab", "a", "b"}


def test_lexicon_rules():
    with pytest.raises(LexiconError):
        Lexicon.build(["a"], (), [("x", "b", "exact_token")])
    with pytest.raises(LexiconError):
        Lexicon.build(["a", "b"], (), [("x", "a", "exact_token"), ("x", "b", "exact_token")])
    with pytest.raises(LexiconError):
        parse_aliases(["x\ty"])
    lex = Lexicon.build([" a ", "# no", "", "ｂ"], defaults=Lexicon.build(["c"]))
    assert lex.blacklist == {"a", "b", "c"}


@pytest.mark.parametrize("bad", [{"max_input_length": 0}, {"unicode_form": "NFD"}, {"fuzzy_max_distance": 3}, {"exact_matching": 1}, {"obfuscation_separators": frozenset("a")}, {"fuzzy_min_score": True}, {"repeat_reduction_threshold": 1}])
def test_settings_are_checked(bad):
    with pytest.raises(SettingsError):
        Settings(**bad)


def test_profiles():
    assert not profile("strict").choseong_matching and profile("balanced").choseong_matching and profile("aggressive") == Settings()
    with pytest.raises(SettingsError):
        profile("other")
