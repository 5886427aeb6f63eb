"""Personal data: patterns propose spans, checks confirm them, context moves the score.

Kinds and how each is confirmed:

* ``email``, ``ip`` (parts at most 255), ``card`` (16 to 19 digits, Luhn) and
  ``phone`` (8 to 15 digits, leading plus) are the base kinds. A span that passes
  its check is always reported; context only moves its score.
* ``iban`` (15 to 34 characters, mod 97) needs no context either.
* ``ssn`` (3-2-4 digits) has no checksum, so it is reported only where a
  context word within ``CONTEXT`` characters lifts its score to ``THRESHOLD``.
* ``secret``: tokens of known issuers and values assigned to a name such as ``password``
  are reported as they are, runs of 32 to 64 hexadecimal digits where context lifts them.

Context words count as whole words only. Spans of one kind never overlap; spans of different kinds may.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import few_rows_at_once

# Kinds in reporting order, local-part characters, context words.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "secret": 0.3}
NAMED_SECRET = 0.6
CONTEXT_WORDS = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "telephone", "call", "tel", "mobile", "cell", "fax"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social security", "tax id"),
    "secret": ("password", "passwd", "pwd", "secret", "token", "key", "credential", "credentials", "bearer", "authorization"),
}
CONTEXT, LIFT, THRESHOLD = 40, 0.3, 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is consumed whole, so a long run is read once.
_IP = re.compile(r"[0-9]+(?:\.[0-9]+\.[0-9]+\.[0-9]+)?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_HEX = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])")
_ISSUED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+)")
_ASSIGNED = re.compile(r"(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"'<>]{8,})", re.I)
_CONTEXT = {kind: re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, words)) + r")(?![a-z])") for kind, words in CONTEXT_WORDS.items()}
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str):
    """Leftmost matches of local@domain, found from each @ so that long words cost nothing."""
    at, free = text.find("@"), 0
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def _proposed(text: str):
    for start, end in _emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        if "." in m[0] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        if mod97(m[0]):
            yield "iban", m.start(), m.end()
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end()


def _secrets(text: str):
    """(start, end, score before context) of secrets, leftmost first, none within another."""
    found = [(*m.span(), SCORES["secret"]) for m in _HEX.finditer(text) if not m[0].isdigit() and not m[0].isalpha()]
    found += [(*m.span(), NAMED_SECRET) for m in _ISSUED.finditer(text)]
    # A value of letters alone is a word of a sentence.
    found += [(*m.span(1), NAMED_SECRET) for m in _ASSIGNED.finditer(text) if not m[1].strip(".,;:!?()").isalpha()]
    free = 0
    for start, end, score in sorted(found, key=lambda s: (s[0], -s[2])):
        if start >= free:
            yield start, end, score
            free = end


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; offsets in code points, end exclusive."""
    found, text = [], text or ""
    proposed = [(kind, start, end, SCORES[kind]) for kind, start, end in _proposed(text)]
    for kind, start, end, score in proposed + [("secret", *s) for s in _secrets(text)]:
        near = text[max(0, start - CONTEXT) : start].lower() + "\n" + text[end : end + CONTEXT].lower()
        score = min(1.0, score + LIFT * bool(_CONTEXT[kind].search(near)))
        if kind in BASE_KINDS or score >= THRESHOLD:
            found.append((kind, start, end, score))
    return found


def redact_text(text: str | None, spans) -> str | None:
    """``text`` with each run of overlapping spans replaced by the first one's [KIND]."""
    if text is None:
        return None
    out, at = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPAN_TYPE = "array<struct<kind:string,start:long,end:long,score:double>>"
DIGEST_TYPE = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"


def _spans_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [dict(zip(("kind", "start", "end", "score"), s)) for s in find_spans(t)])


def _redacted(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: redact_text(t, find_spans(t)))


def _digests(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        spans = find_spans(t)
        count = [sum(s[0] == k for s in spans) for k in BASE_KINDS]
        as_text = [f"{k}:{a}:{b}" for k, a, b, _ in spans]
        base = ",".join(x for x, s in zip(as_text, spans) if s[0] in BASE_KINDS)
        rows.append((*count, hashlib.sha256(base.encode()).hexdigest(), ",".join(as_text), ",".join(f"{s[3]:.2f}" for s in spans)))
    return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])


def detect(df: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """Adds ``into``: the spans of ``text`` with their scores.

    Null and empty texts have none. A column already named ``into`` is replaced;
    every other column, and repeated rows, stay as they are.
    """
    few_rows_at_once(df.sparkSession)
    return df.withColumn(into, F.pandas_udf(_spans_of, SPAN_TYPE)(text))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every reported span of ``text`` by its kind in brackets; null stays null."""
    few_rows_at_once(df.sparkSession)
    return df.withColumn(text, F.pandas_udf(_redacted, "string")(text))


def digest(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, sha256 of the base spans, all spans and their scores as text."""
    few_rows_at_once(df.sparkSession)
    return df.select("doc_id", F.pandas_udf(_digests, DIGEST_TYPE)(text).alias("d")).select("doc_id", "d.*")
