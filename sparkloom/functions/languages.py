"""Language detection by character n-grams, and analysis by language: words, stop words, stems.

Python runs on Arrow batches here, as neither profiles nor stemmers are column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.vectors import col

BUCKETS = 1 << 16
UNKNOWN = "Unknown"


def _grams(text: str) -> np.ndarray:
    """Buckets of the bigrams and trigrams of a text's letters, lower-cased, with a blank for all else."""
    clean = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    c = np.frombuffer(clean.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, dtype=np.int64)
    two = c[:-1] * np.uint64(0x1F1F1F1F) + c[1:]
    three = two[:-1] * np.uint64(0x2545F491) + c[2:] + np.uint64(7)
    both = np.concatenate((two, three)) * np.uint64(0x9E3779B97F4A7C15)
    return (both >> np.uint64(48)).astype(np.int64)


@dataclass
class LanguageDetector:
    """Naive Bayes over n-gram profiles; under `min_confidence` the answer is "Unknown".

    priors: of some languages; others have `default_prior`; a prior of 0 rules a language out. Null and wordless
    texts are unknown.
    """

    languages: list[str]
    log_profiles: np.ndarray  # (BUCKETS, languages)
    min_confidence: float = 0.9
    priors: Mapping[str, float] = field(default_factory=dict)
    default_prior: float = 0.01

    def probabilities(self, text: str | None) -> np.ndarray | None:
        grams = _grams(text) if text else np.zeros(0, dtype=np.int64)
        if not len(grams):
            return None
        with np.errstate(divide="ignore"):
            prior = np.log(np.array([self.priors.get(x, self.default_prior) for x in self.languages]))
        score = self.log_profiles[grams].sum(axis=0) + prior
        if not np.isfinite(score).any():
            return None
        p = np.exp(score - score.max())
        return p / p.sum()

    def detect(self, text: str | None) -> str:
        p = self.probabilities(text)
        return self.languages[int(p.argmax())] if p is not None and p.max() >= self.min_confidence else UNKNOWN

    def column(self, text: Column) -> Column:
        @F.arrow_udf("string")
        def run(texts: pa.Array) -> pa.Array:
            return pa.array((self.detect(t.as_py()) for t in texts), pa.string())  # one text at a time as a Python string

        return run(text)

    def transform(self, df: DataFrame, text_col: str = "text", output: str = "language") -> DataFrame:
        return df.withColumn(output, self.column(col(text_col)))


def profiles_of(samples: Mapping[str, str], **how) -> LanguageDetector:
    """A detector trained on one text for each language."""
    names = sorted(samples)
    counts = np.stack([np.bincount(_grams(samples[n]), minlength=BUCKETS) for n in names], axis=1)
    return LanguageDetector(names, _logs(counts), **how)


def _logs(counts: np.ndarray) -> np.ndarray:
    smooth = 0.5
    return np.log((counts + smooth) / (counts.sum(axis=0) + smooth * BUCKETS))


def fit_language_profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang", **how) -> LanguageDetector:
    """A detector trained on all rows that name a language; what comes to the driver is one profile a language."""
    rows = df.select(col(lang_col).alias("lang"), col(text_col).alias("text")).where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                t = totals.setdefault(lang.as_py(), np.zeros(BUCKETS, dtype=np.int64))
                np.add.at(t, _grams(text.as_py()), 1)
        for lang, t in totals.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(t[at])], ["lang", "bucket", "n"])

    found = rows.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(set(found["lang"]))
    counts = np.zeros((BUCKETS, len(names)))
    for i, name in enumerate(names):
        own = found[found["lang"] == name]
        counts[own["bucket"].to_numpy(), i] = own["n"].to_numpy()
    return LanguageDetector(names, _logs(counts), **how)


_STOP = {
    "en": "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with",
    "de": "aber als am an auch auf aus bei bin bis bist da dadurch daher darum das dass dein deine dem den der des die dies dieser doch dort du durch ein eine einem einen einer eines er es euer für hatte hier ich ihr im in ist ja kann können mein mit nach nicht oder seid sein sich sie sind so über um und uns unser von war was wer wie wir zu zum zur",
    "fr": "au aux avec ce ces dans de des du elle en et eux il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous est sont été c d j l à m n s t y",
    "es": "a al algo ante antes como con contra cual cuando de del desde donde durante e el ella ellas ellos en entre era es esa ese eso esta este esto ha hay la las le les lo los más me mi muy no nos o para pero por que se ser si sin sobre su sus también te tu un una uno y ya yo",
    "ru": "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про них какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между",
}
_STOPS = {k: frozenset(v.split()) for k, v in _STOP.items()}


class _Porter:
    """The stemmer of Porter (1980), "An algorithm for suffix stripping"."""

    STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
    STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
    STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou", "ion"]

    @staticmethod
    def form(word: str) -> str:
        """v and c for each letter."""
        out = ""
        for i, ch in enumerate(word):
            vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
            out += "v" if vowel else "c"
        return out

    @classmethod
    def measure(cls, word: str) -> int:
        return len(re.findall("v+c+", cls.form(word)))

    @classmethod
    def cvc(cls, word: str) -> bool:
        return len(word) > 2 and cls.form(word)[-3:] == "cvc" and word[-1] not in "wxy"

    @classmethod
    def stem(cls, w: str) -> str:
        if len(w) < 3 or not w.isascii():
            return w
        m = cls.measure
        for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
            if w.endswith(end):
                w = w[: len(w) - len(end)] + new
                break
        if w.endswith("eed"):
            w = w[:-1] if m(w[:-3]) > 0 else w
        else:
            for end in ("ed", "ing"):
                if w.endswith(end) and "v" in cls.form(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and cls.form(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif m(w) == 1 and cls.cvc(w):
                        w += "e"
                    break
        if w.endswith("y") and "v" in cls.form(w[:-1]):
            w = w[:-1] + "i"
        for rules in (cls.STEP2, cls.STEP3):
            for end, new in rules:
                if w.endswith(end):
                    if m(w[: -len(end)]) > 0:
                        w = w[: -len(end)] + new
                    break
        for end in cls.STEP4:
            if w.endswith(end):
                rest = w[: -len(end)]
                if m(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                    w = rest
                break
        if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not cls.cvc(w[:-1]))):
            w = w[:-1]
        return w[:-1] if w.endswith("ll") and m(w) > 1 else w


#: Endings that a light stemmer takes off, if so many letters stay.
_ENDINGS = {
    "de": (4, ["ern", "en", "er", "es", "em", "e", "s", "n"]),
    "fr": (4, ["issements", "ements", "ement", "euses", "euse", "eaux", "ives", "ive", "aux", "ées", "ée", "és", "er", "es", "é", "e", "s", "x"]),
    "es": (4, ["amientos", "imientos", "aciones", "amente", "mente", "ación", "adas", "ados", "ada", "ado", "idas", "idos", "ida", "ido", "ando", "iendo", "ar", "er", "ir", "es", "os", "as", "o", "a", "e", "s"]),
    "ru": (3, ["иями", "ями", "ами", "ией", "иям", "ием", "иях", "ого", "его", "ому", "ему", "ыми", "ими", "ость", "ать", "ять", "ить", "еть", "ешь", "ишь", "ает", "яет", "ует", "ют", "ут", "ят", "ат", "ет", "ит", "ла", "ло", "ли", "ая", "яя", "ое", "ее", "ые", "ие", "ый", "ий", "ой", "ей", "ем", "им", "ым", "ом", "их", "ых", "ую", "юю", "ах", "ях", "ам", "ям", "ов", "ев", "ию", "ия", "ью", "ья", "а", "е", "и", "й", "о", "у", "ы", "ь", "ю", "я"]),
}
_FOLD = str.maketrans("áàâäéèêëíìîïóòôöúùûüñç", "aaaaeeeeiiiioooouuuunc")


@lru_cache(maxsize=200_000)
def stem(word: str, language: str) -> str:
    if language == "en":
        return _Porter.stem(word)
    if language not in _ENDINGS:
        return word
    least, endings = _ENDINGS[language]
    for end in endings:
        if word.endswith(end) and len(word) - len(end) >= least:
            word = word[: -len(end)]
            break
    return word if language == "ru" else word.translate(_FOLD)


_WORDS = re.compile(r"[^\W_]+(?:['’.][^\W_]+)*")


def analyse(text: str | None, language: str | None, default: str = "ru") -> list[str] | None:
    """Lower-cased stems of the words that aren't stop words; the default language's rules for one without any."""
    if text is None:
        return None
    own = language if language in _STOPS else default
    out = []
    for w in _WORDS.findall(text.lower()):
        if own == "en" and w.endswith(("'s", "’s")):
            w = w[:-2]
        if own == "fr":
            w = re.sub(r"^(?:[cdjlmnst]|qu)['’]", "", w)
        if w not in _STOPS[own]:
            out.append(stem(w, own))
    return out


def analysed(text: Column, language: Column, default: str = "ru") -> Column:
    """array<string>; null texts stay null."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([analyse(t, lang, default) for t, lang in zip(texts, languages)], dtype=object)

    return run(text, language)
