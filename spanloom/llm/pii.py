"""Personal data by a semi-Markov conditional random field over whole spans.

Base spans come from four fixed patterns (e-mail, IPv4, payment card, phone), each leftmost and non-overlapping. Beside them a
semi-Markov CRF chooses segments: a candidate is a run of up to LONGEST neighbouring tokens, scored by features of the whole
run (its shape, digits, checksum, separators, the word before it), and dynamic programming over bounded segments chooses boundaries and
kinds jointly. A segment's tokens must each hold a digit or an at sign, so texts fall into islands of such tokens, and
decoding island by island is exact. The model is trained by maximum likelihood (forward-backward over segmentations) on
generated sentences with a fixed seed: a training set of fixed size that doesn't grow with the data.

Chosen spans that overlap no base span are added; base spans always stay. Null text counts as empty. Very long texts are scanned in linear
time. Repeated rows give equal results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import ids_and_texts, lean

#: Kinds in their order; the model's own ones come last.
KINDS = ["email", "ip", "card", "phone", "secret", "account"]
LONGEST = 6
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_EVIDENT = re.compile(r"[^\s]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern; grown from each at sign, so long runs of letters cost nothing."""
    out, past, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            past = m.end()
        else:
            past = max(past, at + 1)
        at = text.find("@", max(at + 1, past))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, sorted."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _SIGN.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def islands(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring tokens (start, end) that each hold a digit or an at sign; single blanks between them."""
    out: list[list[tuple[int, int]]] = []
    at = 0
    while m := _SIGN.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = _EVIDENT.match(text, start).end()
        if out and start - out[-1][-1][1] == 1 and text[start - 1] == " ":
            out[-1].append((start, end))
        else:
            out.append([(start, end)])
        at = end
    return out


_TRIM_LEFT, _TRIM_RIGHT = "([{<\"'.,;:!?|*#$%&", ")]}>\"'.,;:!?|*#$%&"


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without the punctuation around it, but for a bracket that closes one inside."""
    while start < end and text[start] in _TRIM_LEFT and not (text[start] == "(" and ")" in text[start:end]):
        start += 1
    while start < end and text[end - 1] in _TRIM_RIGHT and not (text[end - 1] == ")" and "(" in text[start:end]):
        end -= 1
    return start, end


def _bucket(n: int) -> str:
    return str(n) if n < 4 else f"{n // 3 * 3}+" if n < 24 else "24+"


#: Words before a secret or an account number.
SECRET_WORDS = frozenset("key token secret password passwd api apikey auth credential credentials bearer".split())
ACCOUNT_WORDS = frozenset("account acct iban no number passport ssn id patient customer member policy".split())


def features(span: str, before: str, tokens: int) -> list[str]:
    """Of a whole candidate segment."""
    digits = sum(c in "0123456789" for c in span)
    letters = sum(c.isalpha() for c in span)
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "9", span)))
    out = [
        f"shape={shape if len(shape) < 16 else 'long'}",
        f"digits={_bucket(digits)}",
        f"letters={_bucket(letters)}",
        f"tokens={tokens}",
        f"at={'@' in span}",
        f"dots={min(span.count('.'), 4)}",
        f"plus={span[:1] == '+'}",
        f"only={'digits' if digits == len(span) else 'letters and digits' if digits + letters == len(span) else 'digits and separators' if not letters else 'other'}",
        f"turns={_bucket(len(shape))}",
        f"sign={'=' in span}",
    ]
    bare = "".join(c for c in span if c in "0123456789")
    if not letters and 12 <= len(bare) <= 19:
        out.append(f"luhn={luhn(bare)}")
    parts = span.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts):
        out.append("quad")
    word = re.sub(r"[^a-z]", "", before.lower())
    if word in SECRET_WORDS:
        out.append("before=secret")
    if word in ACCOUNT_WORDS:
        out.append("before=account")
    return out


class SemiCrf:
    """Labels: 0 is outside (single tokens), then KINDS. Weights by feature and label, and by pairs of labels."""

    def __init__(self):
        self.labels = 1 + len(KINDS)
        self.index: dict[str, int] = {}
        self.weights = np.zeros((1, self.labels))
        self.pairs = np.zeros((self.labels, self.labels))
        self.scores: dict = {}

    def scored(self, span: str, before: str, tokens: int) -> list[float]:
        """The score of a segment for each label; outside is for single tokens only."""
        key = (span, before, tokens)
        found = self.scores.get(key)
        if found is None:
            ids = [self.index[f] for f in features(span, before, tokens) if f in self.index]
            found = self.weights[ids].sum(0)
            if tokens > 1:
                found[0] = -math.inf
            found = found.tolist()
            if len(self.scores) > 50_000:
                self.scores.clear()
            self.scores[key] = found
        return found

    def segments(self, text: str, island: list[tuple[int, int]]):
        """For each end, the candidate segments (first token, span start, span end, scores)."""
        for j in range(len(island)):
            out = []
            for i in range(max(0, j - LONGEST + 1), j + 1):
                s, e = trimmed(text, island[i][0], island[j][1])
                if s < e:
                    head = text[max(0, island[i][0] - 24) : island[i][0]].split()
                    out.append((i, s, e, self.scored(text[s:e], head[-1] if head else "", j - i + 1)))
                elif i == j:
                    out.append((i, s, e, [0.0] + [-math.inf] * (self.labels - 1)))
            yield out

    def decode(self, text: str, island: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """The best segmentation's entities as (start, kind, end)."""
        pairs = self.pairs.tolist()
        best: list[list[float]] = [[0.0] + [-math.inf] * (self.labels - 1)]
        back: list[list] = [[]]
        for j, segments in enumerate(self.segments(text, island)):
            row, how = [-math.inf] * self.labels, [None] * self.labels
            for i, s, e, scores in segments:
                before = best[i]
                for y, score in enumerate(scores):
                    if score == -math.inf:
                        continue
                    for x in range(self.labels):
                        v = before[x] + score + pairs[x][y]
                        if v > row[y]:
                            row[y], how[y] = v, (i, x, s, e)
            best.append(row)
            back.append(how)
        out, j = [], len(island)
        y = max(range(self.labels), key=lambda k: best[j][k])
        while j:
            i, x, s, e = back[j][y]
            if y:
                out.append((s, y - 1, e))
            j, y = i, x
        return out[::-1]

    def fit(self, data: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 30, rate: float = 0.5, penalty: float = 1e-3) -> "SemiCrf":
        """Maximum likelihood by gradient steps; data: texts and their entities (start, kind, end)."""
        cases = []
        for text, gold in data:
            kinds = {(s, e): k for s, k, e in gold}
            for island in islands(text):
                lattice = []
                for j in range(len(island)):
                    row = []
                    for i in range(max(0, j - LONGEST + 1), j + 1):
                        s, e = trimmed(text, island[i][0], island[j][1])
                        if s < e or i == j:
                            head = text[max(0, island[i][0] - 24) : island[i][0]].split()
                            ids = [self.index.setdefault(f, len(self.index)) for f in features(text[s:e], head[-1] if head else "", j - i + 1)]
                            row.append((i, np.array(ids), (s, e)))
                    lattice.append(row)
                path, j = [], len(island)
                while j:
                    i, ids, span = next((c for c in lattice[j - 1] if c[2] in kinds), None) or next(c for c in lattice[j - 1] if c[0] == j - 1)
                    path.append((i, j, ids, kinds.get(span, -1) + 1))
                    j = i
                cases.append((lattice, path[::-1]))
        n, L = len(self.index), self.labels
        self.weights = np.zeros((n, L))
        square = np.full((n, L), 1e-8), np.full((L, L), 1e-8)
        for _ in range(rounds):
            gw, gp = np.zeros((n, L)), np.zeros((L, L))
            for lattice, path in cases:
                last = 0
                for _, _, ids, y in path:
                    gw[ids, y] += 1
                    gp[last, y] += 1
                    last = y
                N = len(lattice)
                score = [[(i, ids, self._open(self.weights[ids].sum(0), j - i)) for i, ids, _ in row] for j, row in enumerate(lattice)]
                alpha = np.full((N + 1, L), -np.inf)
                alpha[0, 0] = 0
                for j in range(N):
                    alpha[j + 1] = np.logaddexp.reduce([np.logaddexp.reduce(alpha[i][:, None] + self.pairs, axis=0) + s for i, _, s in score[j]], axis=0)
                beta = np.full((N + 1, L), -np.inf)
                beta[N] = 0
                for j in range(N - 1, -1, -1):
                    for i, _, s in score[j]:
                        beta[i] = np.logaddexp(beta[i], np.logaddexp.reduce(self.pairs + (s + beta[j + 1])[None, :], axis=1))
                total = np.logaddexp.reduce(alpha[N])
                for j in range(N):
                    for i, ids, s in score[j]:
                        p = np.exp(alpha[i][:, None] + self.pairs + (s + beta[j + 1])[None, :] - total)
                        gp -= p
                        np.subtract.at(gw, ids, p.sum(0)[None, :])
            for w, g, q in ((self.weights, gw, square[0]), (self.pairs, gp, square[1])):
                g = g / len(cases) - penalty * w
                q += g * g
                w += rate * g / np.sqrt(q)
        self.scores = {}
        return self

    @staticmethod
    def _open(scores: np.ndarray, longer: int) -> np.ndarray:
        if longer:
            scores = scores.copy()
            scores[0] = -np.inf
        return scores


SENTENCES, SEED = 500, 11


def training_data(n: int = SENTENCES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated sentences with entities of each kind, and harmless numbers."""
    R = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda cs, a, b: "".join(R.choice(cs) for _ in range(R.randint(a, b)))

    def card() -> str:
        body = some(dig, 15, 15)
        body += next(d for d in dig if luhn(body + d))
        sep = R.choice(["", " ", "-"])
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def entity() -> tuple[str, int, str]:
        k = R.randrange(len(KINDS))
        if k == 0:
            return "", k, f"{some(low, 2, 8)}{R.choice(['.', '_', ''])}{some(low + dig, 1, 5)}@{some(low, 3, 7)}{R.choice(['', some(dig, 1, 2)])}.{R.choice(['com', 'org', 'example.com', 'net'])}"
        if k == 1:
            return "", k, ".".join(str(R.randint(0, 255)) for _ in range(4))
        if k == 2:
            return "", k, card()
        if k == 3:
            return "", k, R.choice([f"+{R.randint(1, 99)} ({some(dig, 3, 3)}) {some(dig, 3, 3)}-{some(dig, 4, 4)}", f"+{some(dig, 11, 12)}", f"({some(dig, 3, 3)}) {some(dig, 3, 3)}-{some(dig, 4, 4)}", f"+{R.randint(1, 99)} {some(dig, 3, 3)} {some(dig, 3, 3)} {some(dig, 4, 4)}"])
        if k == 4:
            name = R.choice(["token", "api_key", "secret", "key", "password"])
            value = some(low + dig + dig, 14, 40) + R.choice(dig)
            return R.choice([("", k, f"{name}={value}"), ("", k, f'"{value}"'), (R.choice(["token ", "key ", "secret "]), k, value), ("", k, "AK" + some(up + dig, 13, 18) + R.choice(dig))])
        return R.choice(["account ", "iban ", "passport ", "ssn "]), k, R.choice([f"{some(up, 2, 2)}{some(dig, 14, 20)}", some(dig, 8, 11), f"{some(dig, 3, 3)}-{some(dig, 2, 2)}-{some(dig, 4, 4)}"])

    def harmless() -> str:
        return R.choice([str(R.randint(0, 2100)), f"{R.randint(0, 99)}.{R.randint(0, 9)}", f"{R.randint(1, 9)}.", some(dig, 1, 4), f"{R.randint(1, 31)}.{R.randint(1, 12)}.{R.randint(1900, 2100)}", f"{R.randint(1, 12)}:{some('012345', 2, 2)}", f"{some(low, 1, 3)}{R.randint(0, 99)}", f"{R.randint(1, 99)}%", f"v{R.randint(0, 9)}.{R.randint(0, 20)}.{R.randint(0, 9)}", some(dig, 5, 8), f"{R.randint(1900, 2100)}-{R.randint(10, 12)}-{R.randint(10, 28)}"])

    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(R.randint(2, 6)):
            text += some(low, 1, 8) + " "
            if R.random() < 0.35:
                lead, k, value = entity()
                text += lead
                start, end = trimmed(value, 0, len(value))
                gold.append((len(text) + start, k, len(text) + end))
                text += value + R.choice([" ", ". ", ", "])
            elif R.random() < 0.4:
                text += harmless() + R.choice([" ", ". ", ", "])
        out.append((text + some(low, 2, 6) + ".", gold))
    return out


_MODEL: list[SemiCrf] = []


def model() -> SemiCrf:
    """The trained model; each worker trains it once, always to the same weights."""
    if not _MODEL:
        _MODEL.append(SemiCrf().fit(training_data()))
    return _MODEL[0]


def all_spans(text: str, crf: SemiCrf, base: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
    """Base spans and the model's that overlap none of them, sorted."""
    base = base_spans(text) if base is None else base
    added, at = [], 0
    for island in islands(text):
        for span in crf.decode(text, island):
            while at < len(base) and base[at][2] <= span[0] and base[at][0] <= span[0]:
                at += 1
            if not any(s < span[2] and span[0] < e for s, _, e in base[max(0, at - 3) : at + 4]):
                added.append(span)
    return sorted(base + added)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, or run of overlapping spans, becomes its first one's kind in brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_sha256 and all spans of each whole text."""
    weights = model()

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                spans = all_spans(text, weights, base) if _SIGN.search(text) else base
                for col, k in zip(cols, range(4)):
                    col.append(sum(x[1] == k for x in base))
                cols[4].append(hashlib.sha256(listed(base).encode()).hexdigest())
                cols[5].append(listed(spans))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return ids_and_texts(docs).mapInArrow(lean(run), _FOUND)


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced in their text; null text stays null, other columns as they are."""
    weights = model()

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact(t, all_spans(t, weights)) if t is not None and _SIGN.search(t) else t)

    return docs.withColumn("text", clean(F.col("text").cast("string")))
