"""Language identification: script ranges narrow the candidates, a word model scores them, and
Viterbi with a switching penalty labels the spans of a text.

A model has, for each language, smoothed log-frequencies of hashed character n-grams and the share of its
letters in each script. A word's candidates are the languages that use the word's script. The label path of
a text maximises the sum of word scores minus a penalty for each change of language; its language is the one
whose spans hold most letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillwatch.llm.common import find_words, map_rows, stored, unit_hash
from fillwatch.llm.ngrams import sums_by_word, word_ngrams

#: First code points of the script ranges, from the Unicode block list; 0 is "no script of its own".
SCRIPT_STARTS = [0x0000, 0x0041, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0900, 0x0980, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200,
                 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3130, 0x3190, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00]
SCRIPT_NAMES = ["none", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "indic", "thai", "lao", "georgian",
                "hangul", "other", "latin", "greek", "none", "kana", "kana", "bopomofo", "hangul", "none", "han", "other", "hangul",
                "other", "han", "other"]
SCRIPTS = sorted(set(SCRIPT_NAMES))
_RANGE_SCRIPT = np.array([SCRIPTS.index(n) for n in SCRIPT_NAMES])
LOW, HIGH = 1, 4
#: Texts labelled at once; a worker needs some 100 bytes for each of them.
SLICE_BYTES = 1 << 20
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket x language, log-frequency less the mean over languages
    scripts: np.ndarray  # script x language, whether the language uses the script
    bits: int
    penalty: float


def letters_only(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def word_script(words: list[str]) -> np.ndarray:
    """Script of each word's first letter."""
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return _RANGE_SCRIPT[np.searchsorted(SCRIPT_STARTS, first, side="right") - 1]


def _tally(bits: int):
    def count(batch: pa.RecordBatch) -> pa.Table:
        """Counts of n-grams (key >= 0) and of scripts (key < 0) for each language of the batch."""
        out = []
        texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
        for lang in sorted(set(langs)):
            words = pd.Series([w for k in np.flatnonzero(langs == lang) for w in map(letters_only, find_words(texts[k].lower())) if w])
            seen = words.value_counts(sort=False)
            if not len(seen):
                continue
            keys, begin = word_ngrams(list(seen.index), LOW, HIGH, bits)
            n = np.bincount(keys, np.repeat(seen.to_numpy(), np.diff(begin)), 1 << bits)
            at = np.flatnonzero(n)
            script = np.bincount(word_script(list(seen.index)), seen.to_numpy() * seen.index.str.len(), len(SCRIPTS))
            st = np.flatnonzero(script)
            out.append(pa.table({"lang": [lang] * (len(at) + len(st)), "key": np.concatenate([at, -1 - st]),
                                 "n": np.concatenate([n[at], script[st]])}))
        return pa.concat_tables(out) if out else pa.table({"lang": pa.array([], pa.string()), "key": pa.array([], pa.int64()), "n": pa.array([], pa.float64())})

    return count


def fit(labelled: DataFrame, *, rows_per_language: int = 3000, bits: int = 16, penalty: float = 12.0, min_script: float = 0.01,
        max_languages: int = 200) -> LanguageModel:
    """Model of ``labelled(doc_id, text, lang)``; rows without text or language are ignored.

    The sample is bounded: about ``rows_per_language`` whole texts of each language, picked by a hash of the row so that
    reruns agree. Of more than ``max_languages`` values of ``lang`` those with most rows are learned (ties: the smaller name). What reaches
    the driver is one count per language and bucket, at most ``max_languages * 2**bits`` numbers. Texts are not exchanged: the
    numbers of rows are counted without them and, a row per language, go to where the texts are read.
    ``min_script``: smallest share of a language's letters that makes a script one of its own.
    """
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    n = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages), "language-sizes")
    sample = rows.join(n, "lang").where(unit_hash("doc_id", F.lit("language")) * F.col("n") < rows_per_language)
    counts = map_rows(sample.select("text", "lang"), _tally(bits), "lang string, key long, n double") \
        .groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table, scripts = np.full((1 << bits, len(languages)), 0.5), np.zeros((len(SCRIPTS), len(languages)))
    for k, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        grams, other = own[own["key"] >= 0], own[own["key"] < 0]
        table[grams["key"], k] += grams["n"]
        scripts[-1 - other["key"].to_numpy(), k] = other["n"]
    if languages:
        table = np.log(table / table.sum(0))
        table -= table.mean(1, keepdims=True)
        scripts = scripts / np.maximum(scripts.sum(0), 1) >= min_script
    return LanguageModel(languages, table.astype(np.float32), scripts.astype(bool), bits, penalty)


def word_scores(model: LanguageModel, words: list[str]) -> np.ndarray:
    """Score of each distinct word (letters, lower case) for each language, candidates by script only."""
    keys, begin = word_ngrams(words, LOW, HIGH, model.bits)
    score = sums_by_word(model.table, keys, begin)
    allowed = model.scripts[word_script(words)]
    allowed |= ~allowed.any(1, keepdims=True)  # a script that no language uses narrows nothing
    return np.where(allowed, score, np.float32(-1e4))


def viterbi(scores: np.ndarray, size: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word. ``scores`` has the words of all texts one after the other, ``size`` the words of each text;
    the texts advance side by side, longest first."""
    begin = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    best = np.zeros((len(size), scores.shape[1]), np.float32)
    came = np.zeros(scores.shape, np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t, m in enumerate(alive):
        at = begin[:m] + t
        if t:
            top = best[:m].argmax(1)
            switch = best[:m][np.arange(m), top][:, None] - penalty
            came[at] = np.where(best[:m] >= switch, own, top[:, None])
            best[:m] = np.maximum(best[:m], switch)
        best[:m] += scores[at]
        best[:m] -= best[:m].max(1, keepdims=True)
    label = np.zeros(len(scores), np.int16)
    now = best.argmax(1).astype(np.int16)
    for t in range(len(alive) - 1, -1, -1):
        m = alive[t]
        at = begin[:m] + t
        label[at] = now[:m]
        now[:m] = came[at, now[:m]] if t else now[:m]
    return label


def label_batch(model: LanguageModel, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Language, score and spans of each text. A span is (first word, last word, language), words counted from 0
    among all words; words without letters belong to no span of their own."""
    words, place, size = [], [], []
    for text in texts:
        own = [(k, w) for k, w in enumerate(map(letters_only, find_words((text or "").lower()))) if w]
        words += [w for _, w in own]
        place += [k for k, _ in own]
        size.append(len(own))
    out: list = [(UNDETERMINED, 0.0, [])] * len(texts)
    if not words or not model.languages:
        return out
    code, distinct = pd.factorize(np.array(words, object))
    scores = word_scores(model, list(distinct))[code]
    length = np.fromiter(map(len, words), np.int64, len(words))
    size = np.array(size)
    label = viterbi(scores, size, model.penalty)
    place, begin = np.array(place), np.cumsum(size) - size
    change = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
    for k in np.flatnonzero(size):
        a, b = begin[k], begin[k] + size[k]
        share = np.bincount(label[a:b], length[a:b], len(model.languages))
        lang = int(share.argmax())
        edges = np.concatenate([[a], change[np.searchsorted(change, a, side="right"):np.searchsorted(change, b)], [b]])
        spans = [(int(place[i]), int(place[j - 1]), model.languages[label[i]]) for i, j in zip(edges, edges[1:])]
        out[k] = (model.languages[lang], float(share[lang] / share.sum()), spans)
    return out


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", spans: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and, if wanted, ``spans`` (first and last word, language).

    ``score`` is the share of the text's letters inside spans of ``lang_pred``. Null texts and texts without a letter are
    ``und`` with score 0; so is every text if nothing could be learned. The prediction reads ``text`` only. Repeated
    rows stay, extra columns are carried, an empty table gives an empty result. Map-only: the model is a table of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits rows, a float for each language

    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = label_batch(shared.value, batch.column(text).to_pylist())
        cols = [*batch.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]
        names = [*batch.schema.names, "lang_pred", "score"]
        if spans:
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))
            cols.append(pa.array([[{"first": a, "last": b, "lang": c} for a, b, c in x[2]] for x in got], kind))
            names.append("spans")
        return pa.record_batch(cols, names)

    kept = docs.drop("lang_pred", "score", "spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", lang_pred string, score double" \
        + ", spans array<struct<first:long,last:long,lang:string>>" * spans
    return map_rows(kept, label, schema)


def labels(docs: DataFrame, model: LanguageModel) -> Column:
    """``lang_pred`` and ``score`` of the texts of ``docs`` as one struct column. Only texts reach the Python workers, at most about
    ``SLICE_BYTES`` of them at once; the other columns stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        size, rows = texts.str.len().fillna(0).cumsum().to_numpy(), texts.tolist()
        cuts = np.flatnonzero(np.diff(size // SLICE_BYTES)) + 1
        got = [x[:2] for part in np.split(np.arange(len(rows)), cuts) for x in label_batch(shared.value, [rows[k] for k in part])]
        return pd.DataFrame(got, columns=["lang_pred", "score"])

    return label("text")
