"""Language identification of mixed texts: script ranges, word scores and a Viterbi path.

Each word's script, by the code point range of its first character, narrows its languages. Those of the
training table are scored by the log-likelihood of the word's byte trigrams (2^16 buckets); a script that no
trained language uses has one language of its own. The Viterbi path over a text's words, at a penalty for
each switch, labels them; words of one label in a row are a span.

Training takes a bounded sample of rows that name a language: `per_language` each, those of the least
hashes of their ids, whole texts. Rows with a null id, text or language are left out of it. A text that is
null or has no word gets the language "und" and no spans; a tie goes to the language that is first in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import col, extended
from sparkloom.llm.textkernel import ALNUM, LETTER, Words, buffers, slices

BUCKETS = 1 << 16
#: Script numbers and the language that stands for a script which no trained language uses; 0: digits only.
SCRIPTS = ["", "und-Latn", "el", "ru", "hy", "he", "ar", "hi", "th", "ja", "zh", "ko", "und"]
_ALPHA = ALNUM & ~((np.arange(256) >= 48) & (np.arange(256) <= 57))


def _script_table() -> np.ndarray:
    """Script by the first two bytes of a character."""
    out = np.full((256, 256), 12, dtype=np.int8)
    out[:128] = 0
    out[_ALPHA] = 1
    out[0xC2:0xCA] = 1
    out[0xC2, 0x80:0xAA] = 0
    out[0xCD, 0xB0:] = out[0xCE] = out[0xCF] = 2
    out[0xD0:0xD4] = 3
    out[0xD4, :0xB0] = 3
    out[0xD4, 0xB0:] = out[0xD5] = 4
    out[0xD6, :0x90] = 4
    out[0xD6, 0x90:] = out[0xD7] = 5
    out[0xD8:0xDC] = 6
    out[0xE0, 0xA4:0xA6] = 7
    out[0xE0, 0xB8:0xBA] = 8
    out[0xE1, 0xB8:0xBC] = 1
    out[0xE2] = 0
    out[0xE3, 0x81:0x84] = 9
    out[0xE3, 0x90:] = 10
    out[0xE4:0xEA] = 10
    out[0xEA, 0xB0:] = out[0xEB:0xED] = 11
    out[0xED, :0x9F] = 11
    return out


_SCRIPT = _script_table()
_FOLDED = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint32)


def _scripts(words: Words) -> np.ndarray:
    second = words.raw[np.minimum(words.starts + 1, len(words.raw) - 1)]
    return _SCRIPT[words.raw[words.starts], second].astype(np.int64)


def _trigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the trigram around each letter, where each word's begin); words end in byte 0."""
    raw, n = words.raw, len(words.raw)
    inside = LETTER[raw]
    b = _FOLDED[raw]
    before, after = np.zeros(n, dtype=np.uint32), np.zeros(n, dtype=np.uint32)
    before[1:], after[:-1] = b[:-1], b[1:]
    before[words.starts] = 0
    after[words.ends - 1] = 0
    code = ((before << 16) | (b << 8) | after)[inside]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), np.cumsum(inside)[words.starts] - 1


@dataclass
class LanguageModel:
    languages: list[str]  # the trained ones, in order
    scores: np.ndarray  # (BUCKETS, trained)
    scripts: np.ndarray  # (len(SCRIPTS), states): whether a state has words of a script

    @property
    def states(self) -> list[str]:
        return self.languages + [s for s in SCRIPTS[1:]]


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 200) -> LanguageModel:
    rows = df.select(col(id_col).cast("string").alias("id"), col(lang_col).alias("lang"), col(text_col).alias("text")).where("id is not null and lang is not null and text is not null")
    first = rows.select("id", "lang").withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))).where(F.col("nth") <= per_language)
    sample = rows.join(F.broadcast(first.select("id", "lang").distinct()), ["id", "lang"]).select("lang", "text")  # at most per_language ids a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            raw, off = buffers(batch.column(1))
            for lo, hi in slices(off):
                words = Words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                if not len(words.starts):
                    continue
                bucket, at = _trigrams(words)
                per_word = np.diff(np.append(at, len(bucket)))
                row, script = words.row, _scripts(words)
                for name in set(names[lo:hi]):
                    own = names[lo:hi] == name
                    t = totals.setdefault(name, np.zeros(BUCKETS + len(SCRIPTS), dtype=np.int64))
                    t[:BUCKETS] += np.bincount(bucket[np.repeat(own[row], per_word)], minlength=BUCKETS)
                    t[BUCKETS:] += np.bincount(script[own[row]], minlength=len(SCRIPTS))
        for name, t in totals.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(t[at], pa.int64())], ["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names, bucket, n = np.array(counts["lang"].to_pylist(), dtype=object), counts["bucket"].to_numpy(), counts["n"].to_numpy()
    languages = sorted(set(names))
    scores = np.zeros((BUCKETS, len(languages)))
    states = len(languages) + len(SCRIPTS) - 1
    scripts = np.zeros((len(SCRIPTS), states), dtype=bool)
    for i, name in enumerate(languages):
        t = np.zeros(BUCKETS + len(SCRIPTS))
        t[bucket[names == name]] = n[names == name]
        scores[:, i] = np.log((t[:BUCKETS] + 0.1) / (t[:BUCKETS].sum() + 0.1 * BUCKETS))
        scripts[:, i] = t[BUCKETS:] > 0.05 * max(t[BUCKETS + 1 :].sum(), 1)
    for s in range(1, len(SCRIPTS)):
        if not scripts[s, : len(languages)].any():
            scripts[s, len(languages) + s - 1] = True
    scripts[0] = True
    return LanguageModel(languages, scores.astype(np.float32), scripts)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best state of each word; counts: words of each text, whose scores follow one another.

    All texts of the slice advance together, a word at a step.
    """
    n, states = scores.shape
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    active_at = np.searchsorted(-counts[order], -np.arange(counts.max(initial=0)), side="left")
    first = first[order]
    value = np.zeros((len(counts), states), dtype=np.float32)
    back = np.empty((n, states), dtype=np.int16)
    own = np.arange(states, dtype=np.int16)
    for t, a in enumerate(active_at):
        v = value[:a]
        best = v.argmax(1)
        switch = (v[np.arange(a), best] - np.float32(penalty))[:, None]
        at = first[:a] + t
        stay = v >= switch
        back[at] = np.where(stay, own, best[:, None].astype(np.int16))
        value[:a] = np.maximum(v, switch) + scores[at]
    state = value.argmax(1)
    out = np.empty(n, dtype=np.int64)
    for t in range(len(active_at) - 1, -1, -1):
        a = active_at[t]
        at = first[:a] + t
        out[at] = state[:a]
        state[:a] = back[at, state[:a]]
    return out


def label(words: Words, model: LanguageModel, penalty: float) -> np.ndarray:
    """The state of each word."""
    script = _scripts(words)
    states = len(model.states)
    used = np.flatnonzero(model.scripts[np.unique(script[script > 0])].any(0)) if (script > 0).any() else np.arange(min(states, 1))
    bucket, at = _trigrams(words)
    trained = used[used < len(model.languages)]
    scores = np.zeros((len(script), len(used)), dtype=np.float32)
    scores[:, : len(trained)] = np.add.reduceat(model.scores[:, trained][bucket], at) if len(trained) else 0
    # digits alone tell nothing; a state without the word's script is out
    scores[script == 0] = 0
    allowed = model.scripts[script][:, used]
    known = np.where(allowed[:, : len(trained)], scores[:, : len(trained)], -np.inf).max(1, initial=-np.inf)
    scores -= np.where(np.isfinite(known), known, 0)[:, None]
    scores[:, len(trained) :] = 0
    scores = np.where(allowed, np.maximum(scores, -12), np.float32(-60))
    state = used[viterbi(scores, words.count, penalty)]
    # a text of digits only is a tie, whatever its neighbours are
    state[np.bincount(words.row, script > 0, len(words.count))[words.row] == 0] = 0
    return state


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = 14.0) -> DataFrame:
    """(doc_id, lang, n_spans, spans), a row for each row of `df`.

    spans: start and end, in characters, and language of each stretch; lang: that of most of their bytes.
    """
    rows = df.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = np.array(model.states, dtype=object)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw_all, off_all = buffers(batch.column(1))
            for lo, hi in slices(off_all, 1 << 21):
                raw, off = raw_all[off_all[lo] : off_all[hi]], off_all[lo : hi + 1] - off_all[lo]
                words, n = Words(raw, off), hi - lo
                if len(words.starts):
                    state = label(words, shared.value, penalty)
                    new = np.concatenate(([True], (state[1:] != state[:-1]) | (words.row[1:] != words.row[:-1])))
                    at = np.flatnonzero(new)
                    row, lang = words.row[at], state[at]
                    start, end = words.starts[at], words.ends[np.append(at[1:], len(new)) - 1]
                    size = np.bincount(row * len(names) + lang, end - start, n * len(names)).reshape(n, len(names))
                    main = np.where(size.any(1), names[size.argmax(1)], "und")
                    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                    base = chars[off[row]]
                    span = pa.StructArray.from_arrays([pa.array(chars[start] - base, pa.int32()), pa.array(chars[end] - base, pa.int32()), pa.array(names[lang], pa.string())], ["start", "end", "lang"])
                    many = np.bincount(row, minlength=n)
                else:
                    span = pa.array([], pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                    main, many = np.full(n, "und", dtype=object), np.zeros(n, dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32()), span)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(main, pa.string()), pa.array(many, pa.int32()), lists], ["doc_id", "lang", "n_spans", "spans"])

    schema = extended(rows.select("doc_id").schema, "lang string, n_spans int, spans array<struct<start:int,end:int,lang:string>>")
    return rows.mapInArrow(scan, schema)
