import random
import unicodedata

import pytest

from lexisieve.functions import views as V


def check(v, text):
    assert len(v.text) == len(v.starts) == len(v.ends)
    assert all(0 <= s < e <= len(text) for s, e in zip(v.starts, v.ends))
    assert list(v.starts) == sorted(v.starts) and list(v.ends) == sorted(v.ends)


def test_blanks_collapse_and_keep_their_span():
    v = V.base_view("a \t b\n")
    assert v.text == "a b " and list(zip(v.starts, v.ends)) == [(0, 1), (1, 4), (4, 5), (5, 6)]


def test_format_characters_leave_no_trace_and_split_blanks():
    assert V.base_view("ab​c").text == "abc"
    assert V.base_view("a ​ b").text == "a  b"


def test_compatibility_and_jamo():
    assert V.base_view("ﬁ").text == "fi"
    assert V.base_view("ㅂㅏㄹ").text == "바" + unicodedata.normalize("NFKC", "ㄹ")
    v = V.base_view("가️나")
    assert v.text == "가나" and list(v.ends) == [2, 3]


@pytest.mark.parametrize("form", ["NFC", "NFKC"])
def test_fast_path_agrees_with_the_slow_one(form, monkeypatch):
    rng = random.Random(1)
    alphabet = ["a", "B", " ", "  ", "\n", "é", "é", "가", "ㅂ", "ㅏ", "ﬁ", "１", "​", "!", "ᄀ", "ᅡ", "ß", "́", "　"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    fast = [V.base_view(t, form) for t in texts]
    monkeypatch.setattr(V, "_fast", lambda *_: None)
    for t, f in zip(texts, fast):
        check(f, t)
        assert f.same(V.base_view(t, form)), t


def test_text_without_hangul_is_its_normal_form():
    rng = random.Random(2)
    for _ in range(2000):
        t = "".join(chr(rng.choice([rng.randint(33, 0x2FF), rng.randint(0x300, 0x36F), rng.randint(0x1E00, 0x1FFF)])) for _ in range(rng.randint(1, 8)))
        if not any(c.isspace() or unicodedata.category(c) == "Cf" for c in t):
            whole = unicodedata.normalize("NFKC", t)
            if " " not in whole:
                check(V.base_view(t), t)


def test_repeated_vowels():
    assert V.repeated_view(V.base_view("바아아보")).text == "바보"
    assert V.repeated_view(V.base_view("바아보")).text == "바아보"
    assert V.repeated_view(V.base_view("아아아보")).text == "아보"
    assert V.repeated_view(V.base_view("바오오보")).text == "바오오보"


def test_separators_go_between_letters_only():
    s = frozenset("*!")
    assert V.separator_view(V.base_view("i*d!!iot*"), s).text == "idiot*"
    assert V.separator_view(V.base_view("*a * b"), s).text == "*a * b"


def test_keyboard_and_jamo():
    assert V.keyboard_view(V.base_view("qkqh dkssud")).text == "바보 안녕"
    assert V.keyboard_view(V.base_view("rkqt")).text == "값"
    text = "ㅂㅏㅂㅂㅗ!"
    assert V.jamo_view(text, V.base_view(text)).text == "밥보!"
    text = "ㅂㅏ * ㅂㅗ"
    assert V.jamo_view(text, V.base_view(text), gaps=(frozenset("*"), 3)).text == "바보"
    assert V.jamo_view("ㅂㅏ     ㅂㅗ", V.base_view("ㅂㅏ     ㅂㅗ"), gaps=(frozenset("*"), 3)).text != "바보"
