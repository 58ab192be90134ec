"""Language ID: spans of one language in each text, and the language of the whole.

A word's scores are sums of log-probabilities of its three-byte pieces and of the
word itself, per language. Languages that do not use a word's script are out.
Viterbi's algorithm labels the words of a text so that the scores less a penalty
per switch are greatest. The texts of a batch take its steps together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsukiori.llm import textbytes as tb

#: Labelled texts to learn from for each language, about; with fewer, all.
SAMPLE = 20_000
#: What a switch of language costs, in nats.
PENALTY = 12.0
#: A language uses the scripts of at least this share of its letters.
SCRIPT_SHARE = 0.001
#: Named in place of a language.
UNKNOWN = "und"

_PIECES = 1 << 16
_WORDS = 1 << 15
_RULED_OUT = np.float32(-1e4)

#: First code points of script ranges. 0 is no script of its own.
SCRIPTS = [
    (0x0000, 0), (0x0041, 1), (0x005B, 0), (0x0061, 1), (0x007B, 0), (0x00AA, 1), (0x00AB, 0),
    (0x00B5, 0), (0x00BA, 1), (0x00BB, 0), (0x00C0, 1), (0x00D7, 0), (0x00D8, 1), (0x00F7, 0),
    (0x00F8, 1), (0x02B0, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6),
    (0x0700, 7), (0x0900, 8), (0x0980, 9), (0x0A00, 10), (0x0A80, 11), (0x0B00, 12), (0x0B80, 13),
    (0x0C00, 14), (0x0C80, 15), (0x0D00, 16), (0x0D80, 17), (0x0E00, 18), (0x0E80, 19),
    (0x0F00, 20), (0x1000, 21), (0x10A0, 22), (0x1100, 23), (0x1200, 24), (0x13A0, 0),
    (0x1780, 25), (0x1800, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 26), (0x3100, 0),
    (0x3400, 27), (0xA000, 0), (0xAC00, 23), (0xD7B0, 0), (0xF900, 27), (0xFB00, 0),
    (0x20000, 27), (0x30000, 0),
]
_FIRST = np.array([first for first, _ in SCRIPTS])
_SCRIPT = np.array([script for _, script in SCRIPTS])
_N_SCRIPTS = 28
_FEATURES = _PIECES + _WORDS + _N_SCRIPTS

_WORD_BYTE = tb.byte_table(lambda b: b >= 0x80 or 65 <= b <= 90 or 97 <= b <= 122)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # log-probability by language and feature
    scripts: np.ndarray  # by language: a bit per script


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i]:bounds[i + 1]
    codes: np.ndarray  # a piece for each byte of each word
    first_code: np.ndarray  # of each word
    whole: np.ndarray  # the feature of the word itself
    script: np.ndarray  # bits


def _lower(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data)))
    return tb.utf8(pc.utf8_lower(texts))


def _scripts(data: np.ndarray) -> np.ndarray:
    """The script of the character at each lead byte; 0 elsewhere."""
    wide = data.astype(np.int32)
    after = np.concatenate([wide[1:], np.zeros(3, np.int32)])[: len(wide) + 2] & 0x3F
    point = np.where(data < 0x80, wide, 0)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = wide[lead]
        a1, a2, a3 = after[lead], after[np.minimum(lead + 1, len(after) - 1)], after[np.minimum(lead + 2, len(after) - 1)]
        point[lead] = np.where(
            b < 0xE0, (b & 0x1F) << 6 | a1,
            np.where(b < 0xF0, (b & 0x0F) << 12 | a1 << 6 | a2, (b & 0x07) << 18 | a1 << 12 | a2 << 6 | a3),
        )
    return _SCRIPT[np.searchsorted(_FIRST, point, "right") - 1]


def read_words(rolling: tb.Rolling, data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of letters and non-ASCII characters, lower-cased, and their features."""
    data, offsets = _lower(data, offsets)
    inside = _WORD_BYTE[data]
    starts, ends = tb.runs(inside, offsets)
    at = np.flatnonzero(inside)
    before = np.full(len(data), 0x20, np.uint64)
    before[1:] = data[:-1]
    before[starts] = 0x20
    after = np.full(len(data), 0x20, np.uint64)
    after[:-1] = data[1:]
    after[ends - 1] = 0x20
    codes = before[at] << np.uint64(16) | data[at].astype(np.uint64) << np.uint64(8) | after[at]
    first = np.cumsum(ends - starts) - (ends - starts)
    whole = rolling.between(rolling.prefix(data), starts, ends) >> np.uint64(64 - 15)
    bits = np.left_shift(1, _scripts(data)) & ~1
    return Words(
        starts, ends, tb.owners(starts, offsets), (tb.mix(codes) >> np.uint64(48)).astype(np.int64), first,
        whole.astype(np.int64) + _PIECES, np.bitwise_or.reduceat(bits[at], first) if len(first) else np.zeros(0, np.int64),
    )


def train(labelled: DataFrame, *, text: str = "text", language: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from about ``sample`` distinct texts of each language, or all if there are fewer.

    So every language with a labelled text is learned, whatever the others have,
    and copies count once. The texts of a language are those of least hash, up to
    a bound from its estimated number of distinct ones. What comes to the driver
    is a count per language and feature.
    """
    rows = labelled.select(
        labelled[f"`{text}`"].cast("string").alias("text"), labelled[f"`{language}`"].cast("string").alias("lang")
    ).where("text IS NOT NULL AND lang IS NOT NULL")
    distinct = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("every"))
    place = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1))
    sampled = (F.col("every") <= sample) | (place < F.lit(float(sample)) / F.col("every") * float(1 << 62))
    rows = rows.join(F.broadcast(distinct), "lang").where(sampled).select("text", "lang").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, totals = tb.Rolling(6), {}
        for batch in batches:
            for start, stop in tb.slices(batch.column(0)):
                part = batch.slice(start, stop - start)
                words = read_words(rolling, *tb.utf8(part.column(0)))
                names = part.column(1).to_pylist()
                n_words = np.diff(words.bounds)
                for name in set(names):
                    own = np.repeat(np.array([n == name for n in names]), n_words)
                    mine = np.repeat(own, words.ends - words.starts)
                    total = totals.setdefault(name, np.zeros(_FEATURES, np.int64))
                    total[:_PIECES] += np.bincount(words.codes[mine], minlength=_PIECES)
                    total += np.bincount(words.whole[own], minlength=_FEATURES)
                    for script in range(1, _N_SCRIPTS):
                        total[_PIECES + _WORDS + script] += np.count_nonzero(words.script[own] >> script & 1)
        for name, total in totals.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())],
                names=["lang", "feature", "n"],
            )

    counts = rows.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # not a Row for each count
    languages = sorted(table["lang"].unique().to_pylist())
    seen = np.zeros((len(languages), _FEATURES))
    at = pc.index_in(table["lang"], value_set=pa.array(languages, pa.string()))
    np.add.at(seen, (at.to_numpy(), table["feature"].to_numpy()), table["n"].to_numpy())
    parts = seen[:, :_PIECES] + 0.5, seen[:, _PIECES : _PIECES + _WORDS] + 0.5
    weights = np.concatenate([np.log(part / part.sum(axis=1, keepdims=True)) for part in parts], axis=1)
    used = seen[:, _PIECES + _WORDS :]
    uses = used >= SCRIPT_SHARE * np.maximum(used.sum(axis=1, keepdims=True), 1)
    scripts = (uses & (used > 0)) @ (1 << np.arange(_N_SCRIPTS))
    return Model(languages, weights.astype(np.float32), scripts)


def scores_of(model: Model, words: Words) -> np.ndarray:
    """A row of scores per word; languages of other scripts are ruled out, unless all would be."""
    out = np.empty((len(words.starts), len(model.languages)), np.float32)
    for i, weights in enumerate(model.weights):
        out[:, i] = np.add.reduceat(weights[words.codes], words.first_code) if len(out) else 0
        out[:, i] += weights[words.whole]
    allowed = (words.script[:, None] & model.scripts[None, :]) != 0
    none = ~allowed.any(axis=1)
    out += np.where(allowed | none[:, None], np.float32(0), _RULED_OUT)
    return out - out.max(axis=1, keepdims=True)


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of each word: greatest sum of scores, less the penalty a switch.

    Ties go to staying, then to the first language.
    """
    n_words = np.diff(bounds)
    order = np.argsort(-n_words, kind="stable")
    first, n_words = bounds[:-1][order], n_words[order]
    going = np.searchsorted(-n_words, -np.arange(n_words[0] if len(n_words) else 0), "left")
    value = np.zeros((len(order), scores.shape[1]), np.float32)
    stays = np.ones(scores.shape, bool)
    came = np.zeros(len(scores), np.int32)
    for step, active in enumerate(going):
        at, best = first[:active] + step, value[:active]
        came[at] = best.argmax(axis=1)
        least = best.max(axis=1, keepdims=True) - np.float32(penalty)
        stays[at] = best >= least
        now = np.maximum(best, least) + scores[at]
        value[:active] = now - now.max(axis=1, keepdims=True)
    label = np.zeros(len(scores), np.int32)
    state = value.argmax(axis=1).astype(np.int32)
    for step in range(len(going) - 1, -1, -1):
        active = going[step]
        at = first[:active] + step
        label[at] = state[:active]
        state[:active] = np.where(stays[at, label[at]], label[at], came[at])
    return label


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Does each text have a letter of any alphabet?"""
    lower = data | 0x20
    plain = np.concatenate([[0], np.cumsum((lower >= 97) & (lower <= 122) & (data < 0x80))])
    other = np.concatenate([[0], np.cumsum(data >= 0x80)])
    has = plain[offsets[1:]] > plain[offsets[:-1]]
    for i in np.flatnonzero(~has & (other[offsets[1:]] > other[offsets[:-1]])):
        has[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return has


def label_spans(
    docs: DataFrame, model: Model, *, text: str = "text", keep: Iterable[str] = ("doc_id",), penalty: float = PENALTY
) -> DataFrame:
    """The kept columns of each document, its language, and its spans of one language.

    Adds ``lang_pred`` (the language with most bytes of words; ties: the first by
    name), ``score`` (its share of them, 0 to 1) and ``spans`` (array of struct
    of start, end, lang: from a span's first to after its last word, in
    characters) and ``fits`` (does any word have a script that a learned language
    uses?). A text that is null or has no letter, or any text under a model that
    has learned no language, is ``und``, with score 0 and no spans, and fits not.

    Repeated documents each get their row; other columns are not looked at, and
    kept ones with the added names are replaced. No shuffle; the model, of fixed
    size per language, goes along with the tasks.
    """

    def make() -> tb.Work:
        rolling = tb.Rolling(6)
        names = np.array([*model.languages, UNKNOWN], object)
        n = len(model.languages)
        used = int(np.bitwise_or.reduce(model.scripts)) if n else 0

        def work(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            count = len(offsets) - 1
            starts, ends = tb.runs(_WORD_BYTE[data], offsets)
            words = read_words(rolling, data, offsets)
            known = _has_letter(data, offsets) & (n > 0)
            label = viterbi(scores_of(model, words), words.bounds, penalty) if n else np.zeros(len(starts), np.int32)
            doc = np.repeat(np.arange(count), np.diff(words.bounds))
            share = np.bincount(doc * max(n, 1) + label, weights=ends - starts, minlength=count * max(n, 1)).reshape(count, -1)
            best = np.where(known, share.argmax(axis=1), n)
            score = np.where(known, share.max(axis=1) / np.maximum(share.sum(axis=1), 1), 0.0)
            fits = known & (np.bincount(doc[(words.script & used) != 0], minlength=count) > 0)
            opens = np.ones(len(doc), bool)
            opens[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
            opens = np.flatnonzero(opens)
            closes = np.append(opens[1:], len(doc)) - 1 if len(opens) else opens
            opens, closes = opens[known[doc[opens]]], closes[known[doc[opens]]]
            character = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            base = character[offsets[doc[opens]]]
            spans = pa.StructArray.from_arrays(
                [
                    pa.array(character[starts[opens]] - base, pa.int64()),
                    pa.array(character[ends[closes]] - base, pa.int64()),
                    pa.array(names[label[opens]], pa.string()),
                ],
                names=["start", "end", "lang"],
            )
            bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[opens], minlength=count))]).astype(np.int32)
            return [
                pa.array(names[best], pa.string()),
                pa.array(score, pa.float64()),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans),
                pa.array(fits, pa.bool_()),
            ]

        return work

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])
    outputs = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(span)),
        T.StructField("fits", T.BooleanType()),
    ]
    return tb.per_document(docs, text, keep, outputs, make)
