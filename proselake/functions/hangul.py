"""Hangul syllable arithmetic and particle choice, as Arrow functions (Spark's chr cannot build syllables)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIRST, LAST, VOWELS, FINALS = 0xAC00, 0xD7A3, 21, 28
RIEUL = 8
#: Particles as (after a consonant, after a vowel).
PARTICLES = [("으로", "로"), ("이랑", "랑"), ("이나", "나"), ("은", "는"), ("이", "가"), ("을", "를"), ("과", "와")]
#: Final consonant of the Sino-Korean reading of each digit (1 other, 8 rieul, 0 none).
DIGIT_FINALS = {"0": 21, "1": 8, "2": 0, "3": 16, "4": 0, "5": 0, "6": 1, "7": 8, "8": 8, "9": 0}


def is_syllable(ch: str) -> bool:
    return FIRST <= ord(ch) <= LAST


def split_syllable(ch: str) -> tuple[int, int, int]:
    """Initial, vowel and final index."""
    code = ord(ch) - FIRST
    return code // (VOWELS * FINALS), code // FINALS % VOWELS, code % FINALS


def join_syllable(initial: int, vowel: int, final: int = 0) -> str:
    return chr(FIRST + (initial * VOWELS + vowel) * FINALS + final)


def final_of(word: str) -> int | None:
    """The final consonant that decides a particle after this word, None where it cannot be told."""
    if not word:
        return None
    if is_syllable(word[-1]):
        return split_syllable(word[-1])[2]
    return DIGIT_FINALS.get(word[-1])


def fit_particle(word: str, particle: str) -> str:
    """The form of `particle` that fits `word`; unknown particles and words stay as they are."""
    final = final_of(word)
    for closed, open_ in PARTICLES:
        if particle in (closed, open_) and final is not None:
            to_open = final == 0 or (open_ == "로" and final == RIEUL)
            return open_ if to_open else closed
    return particle


@F.pandas_udf(T.StringType())
def fit_particle_udf(word: pd.Series, particle: pd.Series) -> pd.Series:
    return pd.Series([None if w is None or p is None else fit_particle(w, p) for w, p in zip(word, particle, strict=True)])


def final_index(ch: Column) -> Column:
    """Final consonant index of one syllable, null for other characters; stays in the JVM."""
    code = F.ascii(ch)
    return F.when(code.between(FIRST, LAST), (code - FIRST) % FINALS)
