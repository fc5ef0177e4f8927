"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns find e-mail addresses, network addresses, card and phone numbers. The field adds what they miss, such as phone
numbers without a plus sign or addresses written with "at" and "dot". It is trained from a small labelled table built from
the templates below, by gradient steps on the likelihood, and decoded by Viterbi over numpy batches of sequences.

A token can only carry a label if it has a digit or an at sign or stands next to a spelled-out address sign, so lines without any are all "other"
and are not decoded. A span found by the field is kept if it touches no span of the patterns.

Null or empty texts have no spans. Null keys are kept, repeated rows give repeated results, an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_task, text_of

# The kinds in the order in which they are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_DIGIT = re.compile("[0-9]")
_HINT = re.compile(r"[0-9@]|[(\[]at[)\]]|\bat [^ ]+ dot ", re.I)

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _holds(kind: str, match: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))
    digits = "".join(_DIGIT.findall(match))
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the patterns, by kind and start."""
    found: list[Span] = []
    digits = _DIGIT.search(text) is not None
    for n, kind in enumerate(KINDS):
        if "@" in text if kind == "email" else digits and (kind != "phone" or "+" in text):
            found += [(n, m.start(), m.end()) for m in PATTERNS[kind].finditer(text) if _holds(kind, m.group())]
    return found


# Labels: 0 is "other"; each kind has a first-token and an inner-token label.
LABELS = 1 + 2 * len(KINDS)
_TOKEN = re.compile(r"\S+")
_CORE = re.compile(r"[+(\[]*[^\W_].*[^\W_][)\]]*|[^\W_]", re.S)


@lru_cache(50_000)
def _features(token: str) -> tuple[str, ...]:
    core = _core(token)
    body = token[core[0] : core[1]]
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[^\W\d_]", lambda m: "A" if m.group().isupper() else "a", re.sub(r"[0-9]", "0", body))))
    n = sum(c.isdigit() for c in body)
    word = body.lower() if body.isalpha() and len(body) <= 12 else ""
    return (
        f"shape={shape[:24]}", f"short={re.sub('0+', '0', shape)[:16]}", f"digits={min(n, 20)}", f"dots={min(body.count('.'), 4)}",
        f"at={'@' in body}", f"first={body[:1] if not body[:1].isalnum() else 'x'}", f"word={word}",
    )


def _core(token: str) -> tuple[int, int]:
    """The part of a token that a span covers: without quotes and marks around it."""
    m = _CORE.search(token)
    return m.span() if m else (0, len(token))


def _may_carry(token: str) -> bool:
    return _DIGIT.search(token) is not None or "@" in token


def sequence_features(tokens: list[str]) -> list[list[str]]:
    own = [_features(t) for t in tokens]
    rows = []
    for i, f in enumerate(own):
        row = [*f, "bias"]
        for d in (-2, -1, 1, 2):
            row += [f"{d}:{x}" for x in (own[i + d][1:3] + own[i + d][-1:] if 0 <= i + d < len(own) else ("edge",))]
        rows.append(row)
    return rows


def allowed(tokens: list[str]) -> np.ndarray:
    """Which tokens may carry a label other than 0: those with digits or an at sign, and up to four next to a spelled-out at sign."""
    marks = np.array([_may_carry(t) for t in tokens], bool)
    for i, t in enumerate(tokens):
        spelled = t.lower() == "at" and "dot" in (x.lower() for x in tokens[i + 1 : i + 4])
        if spelled or t.lower() in ("(at)", "[at]"):
            marks[max(0, i - 1) : i + 5] = True
    return marks


class Field:
    """Weights of features by label, and of neighbouring labels."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def scores(self, tokens: list[str]) -> np.ndarray:
        out = np.zeros((len(tokens), LABELS))
        for i, row in enumerate(sequence_features(tokens)):
            at = [self.names[x] for x in row if x in self.names]
            out[i] = self.emit[at].sum(0)
        out[~allowed(tokens), 1:] = -1e9
        return out

    def decode(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        """Best label sequences (Viterbi), all sequences of a batch at once, padded to the longest."""
        if not batch:
            return []
        sizes = np.array([len(s) for s in batch])
        longest = sizes.max()
        scores = np.zeros((len(batch), longest, LABELS))
        for b, s in enumerate(batch):
            scores[b, : len(s)] = s
        best = scores[:, 0] + START_MOVE
        back = np.zeros((len(batch), longest, LABELS), np.int8)
        for t in range(1, longest):
            step = best[:, :, None] + self.move
            back[:, t] = step.argmax(1)
            best = np.where((t < sizes)[:, None], step.max(1) + scores[:, t], best)
        label = best.argmax(1)
        paths = np.zeros((len(batch), longest), np.int8)
        for t in range(longest - 1, -1, -1):
            paths[:, t] = label
            inside = (t < sizes) & (t > 0)
            label = np.where(inside, back[np.arange(len(batch)), t, label], label)
        return [p[:n] for p, n in zip(paths, sizes)]


# An inner label only follows the first or inner label of its kind, so it cannot begin a sequence.
START_MOVE = np.array([0.0] + [0.0, -1e9] * len(KINDS))
FORBIDDEN = np.zeros((LABELS, LABELS), bool)
for _k in range(len(KINDS)):
    FORBIDDEN[:, 2 + 2 * _k] = True
    FORBIDDEN[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = False


def fit(table: list[tuple[list[str], list[int]]], steps: int = 200, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Maximum likelihood by AdaGrad on whole-table gradients (forward-backward)."""
    names: dict[str, int] = {}
    rows = [[[names.setdefault(x, len(names)) for x in row] for row in sequence_features(tokens)] for tokens, _ in table]
    marks = [allowed(tokens) for tokens, _ in table]
    emit, move = np.zeros((len(names), LABELS)), np.zeros((LABELS, LABELS))
    emit_sum, move_sum = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    for _ in range(steps):
        emit_grad, move_grad = -decay * emit, -decay * move
        held = np.where(FORBIDDEN, -1e9, move)
        for (_, labels), features, mark in zip(table, rows, marks):
            s = np.array([emit[f].sum(0) for f in features])
            s[~mark, 1:] = -1e9
            n = len(labels)
            forward, backward = np.zeros((n, LABELS)), np.zeros((n, LABELS))
            forward[0] = s[0] + START_MOVE
            for t in range(1, n):
                forward[t] = s[t] + np.logaddexp.reduce(forward[t - 1][:, None] + held, 0)
            for t in range(n - 2, -1, -1):
                backward[t] = np.logaddexp.reduce(held + s[t + 1] + backward[t + 1], 1)
            whole = np.logaddexp.reduce(forward[-1])
            p = np.exp(forward + backward - whole)
            for t, f in enumerate(features):
                gradient = -p[t]
                gradient[labels[t]] += 1
                emit_grad[f] += gradient
                if t:
                    move_grad -= np.exp(forward[t - 1][:, None] + held + s[t] + backward[t] - whole)
                    move_grad[labels[t - 1], labels[t]] += 1
        emit_sum += emit_grad**2
        move_sum += move_grad**2
        emit += rate * emit_grad / np.sqrt(emit_sum)
        move += rate * move_grad / np.sqrt(move_sum)
    return Field(names, emit, np.where(FORBIDDEN, -1e9, move))


# The labelled table: {kind text} marks a span. Numbers are varied by rule, so each template gives several lines.
TEMPLATES = (
    "please call {phone (555) 010-2233} before noon", "call {phone (555) 010-2233} now", "or {phone (555) 010-2233} today", "the {phone (555) 010-2233} of", "tel {phone 555-010-2233} or write", "my phone is {phone 555 010 2233} thanks",
    "reach us at {phone +1 (555) 010-2233} today", "phone: {phone (555) 010-2233}", "call {phone +44 20 7946 0958} now", "fax {phone 555.010.2233} office",
    "write to {email jane.roe@mail.example.com} please", "mail {email jane at example dot com} for more", "contact {email jane (at) example.com} today",
    "e-mail {email j.roe [at] mail [dot] example [dot] org} thanks", "address {email info@example.org}, or come", "the host {ip 192.0.2.17} answered",
    "from {ip 198.51.100.4} to {ip 203.0.113.9} at once", "server {ip 192.0.2.17}: down", "card {card 4111 1111 1111 1111} was charged",
    "paid with {card 4111-1111-1111-1111} today", "card number {card 4111111111111111} expires", "we met at the house and it was late", "look at 10 items on page 24",
    "in 1999 there were 1200 of them", "order 48213 shipped on 2021-03-04", "version 1.2.3 came out at 10:30", "the price is 1,250.00 for 3 units", "total 123456 of 4567890 rows",
    "section 4.1 and table 7 at the end", "number 1234567890123456 is not valid", "id 2123465659789240 in the list", "hash 24be64439e3e49cf46b2d7c90f36 was found",
    "token = \"f33e61083db5dbdf4bd2\" in the file", "width 300x200 and 12% of 48", "a1 b2 c3 d4 e5", "of 380592391139 and of others", "serial 47853805923 ends here", "at 5 pm we left for 2 days",
)


def labelled_table(copies: int = 2) -> list[tuple[list[str], list[int]]]:
    """Tokens and labels of every template, with its digits turned ``copies`` ways."""
    table = []
    for template in TEMPLATES:
        for turn in range(copies):
            tokens, labels = [], []
            for part in re.split(r"(\{[^}]*\})", template):
                kind = 0
                if part.startswith("{"):
                    name, part = part[1:-1].split(" ", 1)
                    kind = KINDS.index(name) + 1
                part = re.sub(r"\d", lambda m: str((int(m.group()) + turn * (m.start() + 3)) % 10), part) if kind != 2 and kind != 3 else part
                for i, token in enumerate(part.split()):
                    if kind == 0 and i == 0 and tokens and not re.match(r"\w", token):
                        tokens[-1] += token
                        continue
                    tokens.append(token)
                    labels.append(0 if not kind else 2 * kind - 1 if i == 0 else 2 * kind)
            table.append((tokens, labels))
    return table


def _plausible(kind: str, text: str) -> bool:
    """What the field may add: the same counts of digits as the patterns ask for, or a spelled-out address."""
    digits = _DIGIT.findall(text)
    if kind == "phone":
        return 8 <= len(digits) <= 15 and not text.isdigit()
    if kind in ("ip", "card"):
        return _holds(kind, text) if kind == "card" else re.fullmatch(r"\d+(\.\d+){3}", text) is not None and _holds(kind, text)
    return re.search(r"(@|[(\[]at[)\]]).+\w|\bat\b.+\bdot\b", text, re.I) is not None


def added_spans(field: Field, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Spans of the field in each text that touch no span of the patterns."""
    found: list[list[Span]] = [[] for _ in texts]
    lines: list[tuple[int, list[tuple[int, int, str]]]] = []
    for n, text in enumerate(texts):
        if _HINT.search(text) is None:
            continue
        at = 0
        for line in text.split("\n"):
            if _HINT.search(line):
                tokens = [(at + m.start(), at + m.end(), m.group()) for m in _TOKEN.finditer(line)]
                marks = allowed([t[2] for t in tokens])
                lines += [(n, tokens[a:b]) for a, b in _stretches(marks)]
            at += len(line) + 1
    lines.sort(key=lambda x: len(x[1]))
    for i in range(0, len(lines), 512):
        some = lines[i : i + 512]
        paths = field.decode([field.scores([t[2] for t in tokens]) for _, tokens in some])
        for (n, tokens), path in zip(some, paths):
            t = 0
            while t < len(path):
                if path[t] % 2 == 1:
                    kind, end = path[t] // 2, t + 1
                    while end < len(path) and path[end] == 2 * kind + 2:
                        end += 1
                    a = tokens[t][0] + _core(tokens[t][2])[0]
                    b = tokens[end - 1][0] + _core(tokens[end - 1][2])[1]
                    if _plausible(KINDS[kind], texts[n][a:b]) and not any(s < b and a < e for _, s, e in base[n]):
                        found[n].append((int(kind), a, b))
                    t = end
                else:
                    t += 1
    return found


def _stretches(marks: np.ndarray, around: int = 2) -> list[tuple[int, int]]:
    """Runs of tokens around those that may carry a label. Between runs every label is 0, so they decode apart."""
    at = np.flatnonzero(marks)
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > 2 * around + 1)
    firsts, lasts = at[np.concatenate([[0], cuts + 1])], at[np.concatenate([cuts, [len(at) - 1]])]
    return [(max(0, a - around), min(len(marks), b + around + 1)) for a, b in zip(firsts.tolist(), lasts.tolist())]


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


RESULT = T.StructType([
    *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
])


def find(df: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, masked: str | None = None) -> DataFrame:
    """(key or ``keep``, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every text.

    Counts and digest are of the patterns, ``spans`` holds all. With ``masked``, the result is the kept columns and one of that name: the
    text with each span replaced by its kind in angle brackets.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = keep if keep is not None else [key]
    schema = T.StructType([*(df.schema[c] for c in columns), *([T.StructField(masked, T.StringType())] if masked else RESULT)])
    arrow = to_arrow_schema(schema)
    field = fit(labelled_table())

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(columns)).to_pylist()
            base = [base_spans(t) for t in texts]
            every = [sorted(b + a) for b, a in zip(base, added_spans(field, texts, base))]
            made = list(batch.columns[: len(columns)])
            if masked:
                made.append(pa.array([mask(t, s) for t, s in zip(texts, every)], pa.string()))
            else:
                made += [pa.array([sum(k == n for k, _, _ in b) for b in base], pa.int64()) for n in range(len(KINDS))]
                made.append(pa.array([hashlib.sha256(spans_text(b).encode()).hexdigest() for b in base], pa.string()))
                made.append(pa.array([spans_text(s) for s in every], pa.string()))
            yield pa.RecordBatch.from_arrays(made, schema=arrow)

    return df.select(*columns, text_of(text).alias("_text_")).mapInArrow(in_task(over), schema)


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the first kind found names the whole."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], s[0])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])
