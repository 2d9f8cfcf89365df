"""Row filters and signals on text, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.  Personal data: addresses of the web and of mail, phone and resident numbers, IPv4, long digit runs, handles.
SENSITIVE = (
    r"(?iU)(https?://|www\.|\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b|(?<!\d)01[016789][ -]?\d{3,4}[ -]?\d{4}(?!\d)"
    r"|(?<!\d)\d{6}[ -]?\d{7}(?!\d)|(?<!\d)(\d{1,3}\.){3}\d{1,3}(?!\d)|(?<!\d)\d{6,}(?!\d)|(?<!\w)@[A-Z0-9_]{2,})"
)

#: Name -> (Java pattern, weight), by falling weight.
SURFACE = {
    "modern-jamo": (r"[\x{1100}-\x{11FF}]", 100),
    "ascii-token": (r"[A-Za-z]{3,}", 90),
    "single-hangul-gap": (r"(?<![가-힣])[가-힣] {1,3}[가-힣](?![가-힣])", 80),
    "hangul-separator": (r"[가-힣][!#$%&*+,.=@^_~·-]+[가-힣]", 70),
    "choseong-run": (r"[ㄱ-ㅎ]{2,}", 60),
    "repeated-character": (r"(.)\1{2,}", 50),
    "quoted-marker": (r"[\"'“”‘’「」『』]", 40),
    "username-marker": (r"[@#][^\s]{2,}", 35),
    "non-bmp-unicode": (r"[\x{10000}-\x{10FFFF}]", 30),
    "compat-jamo": (r"[ㄱ-ㅎㅏ-ㅣ]", 20),
}


def is_sensitive(text: Column) -> Column:
    return text.rlike(SENSITIVE)


def surface_signals(text: Column) -> Column:
    """array<string> of the signals that text shows."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, (p, _) in SURFACE.items()]))


def surface_priority(signals: Column) -> Column:
    """Sum of the signals' weights."""
    total = F.lit(0)
    for name, (_, weight) in SURFACE.items():
        total = total + F.when(F.array_contains(signals, name), weight).otherwise(0)
    return total
