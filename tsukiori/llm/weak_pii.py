"""Personal data by weak supervision: labelers vote on spans, a model weighs the votes.

Base spans come from four fixed patterns. Other spans are candidates: texts with
digits, names after a title, values after a cue word, listed given names with a
capitalised word, and numbers with the name of a street. Patterns, word lists and
context vote for or against each. Expectation-maximisation over the counts of
vote patterns estimates how reliable each labeler is, and with that how likely
each pattern means personal data; a logistic model of votes and shape, trained
on these likelihoods, decides which candidates are spans.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsukiori.llm import textbytes as tb
from tsukiori.scratch import stage

#: Kinds of base spans, in the order of results; kinds of added spans follow by name.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("address", "id", "name", "secret", "telephone")

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """What the e-mail pattern matches, found from the at signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _EMAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            yield "email", start, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def _addresses(text: str) -> Iterator[Span]:
    """What the pattern of an ip matches: of numbers joined by dots, each four in turn."""
    for match in _DOTTED.finditer(text):
        parts, start = match[0].split("."), match.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in four):
                yield "ip", start, end
            start = end + 1


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind, then start; time grows with the text's length."""
    found = [*_emails(text), *_addresses(text)]
    for match in _CARD.finditer(text):
        digits = match[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *match.span()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in match[0]) <= 15:
                found.append(("phone", *match.span()))
    return found


# ---------------------------------------------------------------------------
# Candidates and the labelers that vote on them: 1 for personal, -1 against, 0 no vote

_DIGITS = re.compile(r"[0-9]+")
_STOP = frozenset(" \t\n\r\v\f\"'`<>()[]{}|,;")
_TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Mme", "Mlle", "Herr", "Frau", "Señor", "Señora", "Sr", "Sra")
_TITLED = re.compile(rf"\b(?:{'|'.join(_TITLES)})\.? ([A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+){{0,2}})")
_CUED = re.compile(r"\b(?:password|passwd|pwd|secret|token|api[_ -]?key|access[_ -]?key)\b[\x20\"']{0,2}[:=][\x20\"']{0,2}([^\s\"',;]{6,})", re.I)
_GIVEN = frozenset(
    "anna bernd carlos claire david elena emma francois hans ines jane john jose juan julia karl laura lena lucas maria "
    "marie mark martin mary michael miguel paul peter pierre robert sarah sofia susan thomas".split()
)
_STREETS = frozenset("street st. avenue ave road rd. lane drive straße strasse platz rue calle avenida plaza".split())
_CAPITAL = r"[A-ZÀ-Þ][\w'-]+"
_NAMED = re.compile(rf"\b(?:{'|'.join(name.title() for name in sorted(_GIVEN))})\b(?: {_CAPITAL}){{1,2}}")
_PLACED = re.compile(
    rf"\b[0-9]{{1,5}}[a-z]?,? (?:{_CAPITAL} ){{1,3}}(?:Street|Avenue|Ave|Road|Drive|Lane|St\.|Rd\.)"
    rf"|\b[0-9]{{1,5}},? (?:rue|avenue|calle|avenida|plaza)(?: de| du| del)?(?: la)? {_CAPITAL}"
    rf"|\b[A-ZÀ-Þ]\w{{2,30}}?(?:straße|strasse|platz) [0-9]{{1,4}}\b"
)
_CUES = frozenset(
    "password passwd pwd secret token key login phone tel telephone call mobile fax contact ssn passport account iban "
    "customer patient born birth dob id name address".split()
)
_PLAIN = frozenset("version license licensed page chapter section figure table vol year copyright since in from".split())

_TELEPHONE = re.compile(r"\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}")
_SOCIAL = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_ACCESS = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z]{20,}")
_HEXADECIMAL = re.compile(r"[0-9a-f]{16,}")
_NUMBER = re.compile(r"[0-9]{1,4}(?:[.,:/][0-9]{1,4})*")
_WORDS = re.compile(r"[^\W\d_]+\.?")


def candidates(text: str) -> list[Span]:
    """Spans worth a vote, none empty and none overlapping another."""
    found: list[Span] = [("name", *match.span(1)) for match in _TITLED.finditer(text)]
    found += [("name", *match.span()) for match in _NAMED.finditer(text)]
    found += [("address", *match.span()) for match in _PLACED.finditer(text)]
    found += [("secret", *match.span(1)) for match in _CUED.finditer(text)]
    done = 0
    for match in _DIGITS.finditer(text):
        start, end = match.span()
        if start < done:
            continue
        number = _TELEPHONE.match(text, start - (start > 0 and text[start - 1] == "("))
        if number:
            found.append(("telephone", *number.span()))
            done = number.end()
            continue
        while start > done and text[start - 1] not in _STOP and text[start - 1] != "=":
            start -= 1
        while end < len(text) and text[end] not in _STOP:
            end += 1
        done = end
        while end > start and text[end - 1] in ".:!?=":
            end -= 1
        value = text[start:end]
        if len(value) < 2:
            continue
        kind = "id"
        if _ACCESS.search(value) or _HEXADECIMAL.search(value) and not value.isdigit():
            kind = "secret"
        elif _WORDS.match(text, end + 1) and _next_word(text, end) in _STREETS:
            kind = "address"
        found.append((kind, start, end))
    found.sort(key=lambda span: (span[1], -span[2]))
    out: list[Span] = []
    for span in found:
        if span[1] < span[2] and (not out or span[1] >= out[-1][2]):
            out.append(span)
    return out


def _next_word(text: str, end: int) -> str:
    match = _WORDS.search(text, end, end + 24)
    return match[0].lower() if match else ""


def _before(text: str, start: int) -> list[str]:
    """The words shortly before, lower-cased; the last one first."""
    return [word.lower().rstrip(".") for word in reversed(_WORDS.findall(text[max(0, start - 32) : start])[-3:])]


def _regex(kind: str, value: str, before: list[str], text: str, span: Span) -> int:
    if _ACCESS.fullmatch(value) or _SOCIAL.fullmatch(value) or _TELEPHONE.fullmatch(value) or _IBAN.fullmatch(value):
        return 1
    return -1 if _NUMBER.fullmatch(value) else 0


def _random(kind: str, value: str, before: list[str], text: str, span: Span) -> int:
    """Long and of mixed characters, as a generated value is."""
    if len(value) >= 16 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and value.isalnum():
        return 1
    return -1 if len(value) < 6 else 0


def _gazetteer(kind: str, value: str, before: list[str], text: str, span: Span) -> int:
    words = {word.lower() for word in _WORDS.findall(value)}
    if words & _GIVEN or _next_word(text, span[2]) in _STREETS or kind == "address" and any(w.endswith(tuple(_STREETS)) for w in words):
        return 1
    return -1 if words & _PLAIN else 0


def _cue(kind: str, value: str, before: list[str], text: str, span: Span) -> int:
    return 1 if _CUES.intersection(before) else 0


def _assignment(kind: str, value: str, before: list[str], text: str, span: Span) -> int:
    return 1 if text[max(0, span[1] - 3) : span[1]].rstrip(" \"'")[-1:] in ("=", ":") and bool(before) else 0


def _plain(kind: str, value: str, before: list[str], text: str, span: Span) -> int:
    return -1 if before and before[0] in _PLAIN else 0


def _title(kind: str, value: str, before: list[str], text: str, span: Span) -> int:
    return 1 if kind == "name" else 0


LABELERS = (_regex, _random, _gazetteer, _cue, _assignment, _plain, _title)


def _shape(value: str) -> str:
    """Length and share of digits, each in four steps."""
    digits = sum(c.isdigit() for c in value) / len(value)
    return f"{min(3, len(value) // 6)}{min(3, int(digits * 4))}"


def votes(text: str, span: Span, base: bool) -> str:
    """A letter for each labeler's vote (p, n or 0), the base patterns' first, and the shape."""
    kind, start, end = span
    value, before = text[start:end], _before(text, start)
    cast = [1 if base else 0] + [labeler(kind, value, before, text, span) for labeler in LABELERS]
    return "".join("0pn"[vote] for vote in cast) + _shape(value)


# ---------------------------------------------------------------------------
# The model


@dataclass
class Model:
    reliability: np.ndarray  # by class, labeler and vote (none, for, against): probability
    probability: dict[str, float]  # of a vote pattern: that it is personal data


def _matrix(patterns: list[str]) -> np.ndarray:
    return np.array([["0pn".index(c) for c in p[:-2]] for p in patterns], np.int64).reshape(len(patterns), len(LABELERS) + 1)


def fit(counts: dict[str, int], rounds: int = 50) -> Model:
    """Reliabilities by EM over pattern counts, then the final classifier.

    At the start a majority of the votes decides. Labelers count as independent
    given the class.
    """
    patterns = sorted(counts)
    if not patterns:
        return Model(np.zeros((2, len(LABELERS) + 1, 3)), {})
    weight = np.array([counts[p] for p in patterns], float)
    cast = _matrix(patterns)
    onehot = np.eye(3)[cast]
    sums = (cast == 1).sum(axis=1) - (cast == 2).sum(axis=1)
    personal = np.clip(0.5 + 0.45 * np.sign(sums), 0.05, 0.95)
    for _ in range(rounds):
        share = np.stack([1 - personal, personal])
        mass = np.einsum("cn,n,nlv->clv", share, weight, onehot) + 1
        reliability = mass / mass.sum(axis=2, keepdims=True)
        prior = (share @ weight + 1) / (weight.sum() + 2)
        joint = np.log(prior)[:, None] + np.einsum("nlv,clv->cn", onehot, np.log(reliability))
        personal = 1 / (1 + np.exp(np.clip(joint[0] - joint[1], -500, 500)))
    shape = np.array([[int(p[-2]), int(p[-1])] for p in patterns])
    features = np.concatenate([onehot[:, :, 1:].reshape(len(patterns), -1), np.eye(4)[shape].reshape(len(patterns), -1), np.ones((len(patterns), 1))], axis=1)
    beta = np.zeros(features.shape[1])
    scaled = weight / weight.sum()
    for _ in range(25):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        slope = features.T @ (scaled * (personal - p)) - 1e-4 * beta
        curve = (features * (scaled * p * (1 - p))[:, None]).T @ features + 1e-4 * np.eye(len(beta))
        beta += np.linalg.solve(curve, slope)
    final = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
    return Model(reliability, dict(zip(patterns, final.tolist(), strict=True)))


# ---------------------------------------------------------------------------
# The operator


def _found(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Base spans and candidates of each document, one row each, in one pass."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.string()), ("base", pa.bool_())])

    def make() -> tb.Work:
        def work(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            whole, out = data.tobytes(), []
            for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                one = whole[start:end].decode()
                base = base_spans(one)
                taken = sorted((s, e) for _, s, e in base)
                rows = [{"kind": s[0], "start": s[1], "end": s[2], "pattern": votes(one, s, True), "base": True} for s in base]
                for s in _apart(candidates(one), taken):
                    rows.append({"kind": s[0], "start": s[1], "end": s[2], "pattern": votes(one, s, False), "base": False})
                out.append(rows)
            return [pa.array(out, pa.list_(span))]

        return work

    return tb.per_document(docs, text, keep, [T.StructField("__found", _FOUND)], make)


_FOUND = T.ArrayType(
    T.StructType([
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("base", T.BooleanType()),
    ])
)


def _apart(spans: list[Span], taken: list[tuple[int, int]]) -> Iterator[Span]:
    """The spans, in order, that overlap none of the taken ranges, in order of their starts."""
    i, reach = 0, 0
    for span in spans:
        while i < len(taken) and taken[i][0] < span[2]:
            reach = max(reach, taken[i][1])
            i += 1
        if span[1] >= reach:
            yield span


def find_personal_data(
    docs: DataFrame, *, text: str = "text", keep: Iterable[str] = ("doc_id",), threshold: float = 0.5
) -> DataFrame:
    """The kept columns of each document, and its spans of personal data.

    Adds ``spans``: an array of struct of kind, start, end (in characters, end
    exclusive), base and score, ordered by kind (``BASE_KINDS``, then
    ``ADDED_KINDS``), then start. All base spans are in it, with score 1.
    Candidates whose classifier score is at least ``threshold`` are added; none
    overlaps a base span.

    One pass reads the texts and writes spans, votes and shapes; counts of their
    patterns, of which there are at most some ten thousand, train the model; a
    second pass over the small table applies it. There is no other shuffle.

    Null and empty texts have no spans. Repeated documents each get their row.
    Without candidates nothing is added. Other columns are not looked at, and a
    kept one named ``spans`` is replaced.
    """
    keep = [name for name in dict.fromkeys(keep) if name.lower() != "spans"]
    found = stage(_found(docs, text, keep), "personal-data")
    rows = found.select(F.explode("__found").alias("s")).groupBy("s.pattern").count().collect()
    model = fit({row["pattern"]: row["count"] for row in rows})
    accepted = {p: score for p, score in model.probability.items() if score >= threshold}
    score = F.from_json(F.lit(json.dumps(accepted)), "map<string,double>")
    kinds = F.array(*[F.lit(kind) for kind in (*BASE_KINDS, *ADDED_KINDS)])

    def place(s: Column) -> Column:
        return F.struct(
            F.array_position(kinds, s["kind"]).alias("rank"), s["start"], s["end"], s["kind"], s["base"],
            F.when(s["base"], F.lit(1.0)).otherwise(F.try_element_at(score, s["pattern"])).alias("score"),
        )

    scored = F.filter(F.transform("__found", place), lambda s: s["score"].isNotNull())
    ordered = F.transform(
        F.array_sort(scored), lambda s: F.struct(s["kind"], s["start"], s["end"], s["base"], s["score"])
    )
    return found.select(*[f"`{c}`" for c in keep], ordered.alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
