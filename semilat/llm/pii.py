"""Personal data by a semi-Markov conditional random field over candidate spans.

The text around digits and mail marks is cut into tokens. Every run of at most LONGEST tokens that loosely looks like a
mail address, network address, card or phone number is a candidate segment, scored for each type by features of the whole
span (digit counts and groups, separators, checks, the word before). Dynamic programming over the tokens chooses
boundaries and types together. The weights maximise the likelihood of generated labelled sentences (EXAMPLES of them, a
fixed seed), trained on the driver by forward-backward.

Spans of the strict patterns below are certain: they are kept whatever the model says, and it adds spans that touch none
of them. Text outside the islands of candidates can only be left unlabelled, so only islands are decoded.

Nulls: a null text is an empty one. Any other column passes through; repeated rows are rows of their own. Texts are
searched whole, whatever their length.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# The strict patterns. A mail address is found from its mark, and a network address only at the first digit
# of a run (from a later one it would fail alike), so that a long run without either is not searched from each character.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")

LONGEST, EXAMPLES, ROUNDS, SEED = 24, 1200, 40, 8
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s|[^\w\s]|_|\w")
#: Where candidates can be: numbers of seven digits or more with separators, and the marks of spelt mail addresses.
NUMBER = re.compile(r"[(+]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
MARK = re.compile(r"[\[({]at[\])}]|@", re.I)
LONGEST_LOCAL, LONGEST_MAIL = 64, 320
LOOSE_NUMBER = re.compile(r"[(+]?[0-9](?:[\x20().-]{0,2}[0-9]){6,19}")
LOOSE_MAIL = re.compile(r"[\w.+-]+\x20?(?:[\[({]at[\])}]|@)\x20?[\w-]+(?:\x20?(?:[\[({]dot[\])}]|\.)\x20?[\w-]+)+", re.I)
MORE = re.compile(r"\x20?(?:[\[({]dot[\])}]|\.)\x20?\w", re.I)
CUES = (("phone", "tel telephone phone call fax mobile cell whatsapp telefon telefono appel"), ("card", "card visa mastercard amex credit carte tarjeta karte"), ("ip", "ip host server address"), ("email", "mail email contact write"))
CUE = {w: f"cue_{k}" for k, words in CUES for w in words.split()}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def strict_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end): leftmost matches of each pattern that pass its check."""
    out, done, mark = [], 0, text.find("@")
    while mark >= 0:
        start = mark
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < mark and (m := DOMAIN.match(text, mark + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        else:
            done = mark + 1
        mark = text.find("@", done)
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def features(text: str, start: int, end: int) -> list[str]:
    """Names of the features of a whole span in its text."""
    span = text[start:end]
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    seps = {c for c in span if not c.isalnum()}
    shape = "-".join(str(len(g)) for g in groups) if len(groups) <= 6 else "many"
    out = ["bias", f"digits_{min(len(digits), 20)}", f"groups_{min(len(groups), 6)}", f"shape_{shape}", "seps_" + "".join(sorted(s for s in seps if s in " -.()+@[]")), f"starts_{span[0] if not span[0].isalnum() else 'w'}"]
    if 13 <= len(digits) <= 19 and len(groups) <= 5:
        out.append(f"luhn_{luhn(digits)}")
    if len(groups) == 4 and seps == {"."}:
        out.append(f"octets_{all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    if LOOSE_MAIL.fullmatch(span):
        last = re.findall(r"\w+", span)[-1]
        out += ["mail", "mail_tld" if last.isalpha() and 2 <= len(last) <= 6 else "mail_end"]
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    out += [f"left_{'w' if before.isalnum() else before if before in '.-+/#$' else 'none'}", f"right_{'w' if after.isalnum() else 'sep' if after in ('-', '/', '%') else 'none'}"]
    if MORE.match(text, end):
        out.append("right_more")
    words = re.findall(r"[^\W\d_]+", text[max(0, start - 24) : start].lower())
    out += [CUE[w] for w in words[-2:] if w in CUE]
    return out


class Field:
    """The conditional random field: a weight for each feature and type, and dynamic programming over segments."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.weights = np.zeros((0, len(KINDS)))

    def island(self, text: str, start: int, end: int) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Token count, tokens' places, and candidates (first token, token after the last, start, end)."""
        tokens = [m.span() for m in TOKEN.finditer(text, start, end)]
        out = []
        for i, (s, _) in enumerate(tokens):
            if text[s].isspace():
                continue
            for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
                e = tokens[j - 1][1]
                span = text[s:e]
                if not text[e - 1].isspace() and (LOOSE_NUMBER.fullmatch(span) or LOOSE_MAIL.fullmatch(span)):
                    out.append((i, j, s, e))
        return len(tokens), tokens, out

    def scores(self, text: str, candidates) -> np.ndarray:
        out = np.zeros((len(candidates), len(KINDS)))
        for n, (_, _, s, e) in enumerate(candidates):
            known = [self.number[f] for f in features(text, s, e) if f in self.number]
            out[n] = self.weights[known].sum(axis=0)
        return out

    def decode(self, text: str, start: int, end: int, taken: bytearray | None = None) -> list[tuple[int, int, int]]:
        """The best segmentation of an island by candidates that touch no taken (marked) place of the text."""
        n, _, candidates = self.island(text, start, end)
        if taken is not None:
            candidates = [c for c in candidates if taken.find(1, c[2], c[3]) < 0]
        if not candidates:
            return []
        score = self.scores(text, candidates)
        best, back = np.zeros(n + 1), [None] * (n + 1)
        ending: dict[int, list[int]] = {}
        for c, (_, j, _, _) in enumerate(candidates):
            ending.setdefault(j, []).append(c)
        for t in range(1, n + 1):
            best[t] = best[t - 1]
            for c in ending.get(t, ()):
                kind = int(score[c].argmax())
                if (value := best[candidates[c][0]] + score[c, kind]) > best[t]:
                    best[t], back[t] = value, (c, kind)
        out, t = [], n
        while t:
            if back[t]:
                c, kind = back[t]
                out.append((kind, candidates[c][2], candidates[c][3]))
                t = candidates[c][0]
            else:
                t -= 1
        return out[::-1]

    def fit(self, examples: list[tuple[str, list[tuple[int, int, int]]]], rounds: int) -> Field:
        """Maximise the likelihood of labelled texts by AdaGrad, with an L2 penalty."""
        data = []
        for text, gold in examples:
            n, _, candidates = self.island(text, 0, len(text))
            if not candidates:
                continue
            rows = [[self.number.setdefault(f, len(self.number)) for f in features(text, s, e)] for _, _, s, e in candidates]
            truth = np.zeros((len(candidates), len(KINDS)))
            for kind, s, e in gold:
                for c, x in enumerate(candidates):
                    truth[c, kind] += x[2:] == (s, e)
            data.append((n, candidates, rows, truth))
        owner = np.repeat(np.arange(sum(len(d[2]) for d in data)), [len(r) for d in data for r in d[2]])
        column = np.array([f for d in data for r in d[2] for f in r])
        self.weights, seen = np.zeros((len(self.number), len(KINDS))), np.full((len(self.number), len(KINDS)), 1e-6)
        starts = np.cumsum([0] + [len(d[1]) for d in data])
        for _ in range(rounds):
            score = np.zeros((starts[-1], len(KINDS)))
            np.add.at(score, owner, self.weights[column])
            off = np.concatenate([d[3] - expected(d[0], d[1], score[a:b]) for d, a, b in zip(data, starts, starts[1:])])
            gradient = np.zeros_like(self.weights)
            np.add.at(gradient, column, off[owner])
            gradient -= 0.02 * self.weights
            seen += gradient**2
            self.weights += 0.5 * gradient / np.sqrt(seen)
        return self


def expected(n: int, candidates, score: np.ndarray) -> np.ndarray:
    """Each candidate's probability of each type, by forward-backward over the tokens."""
    whole = np.logaddexp.reduce(score, axis=1)
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0
    for t in range(1, n + 1):
        forward[t] = np.logaddexp.reduce([forward[t - 1]] + [forward[i] + whole[c] for c, (i, j, _, _) in enumerate(candidates) if j == t])
    for t in range(n - 1, -1, -1):
        backward[t] = np.logaddexp.reduce([backward[t + 1]] + [backward[j] + whole[c] for c, (i, j, _, _) in enumerate(candidates) if i == t])
    place = np.array([(forward[i] + backward[j]) for i, j, _, _ in candidates])
    return np.exp(place[:, None] + score - forward[n])


def example(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated sentence with one item that is personal data of a kind, or only looks like it."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("aeioulnrstmd") for _ in range(rng.randint(2, 8)))

    def card(n: int) -> str:
        body = rng.choice("3456") + d(n - 2)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def bad(n: int) -> str:
        return next(x for x in iter(lambda: d(n), None) if not luhn(x))

    def cut(x: str, sizes, sep: str) -> str:
        at = np.cumsum([0, *sizes])
        return sep.join(x[a:b] for a, b in zip(at, at[1:]))

    area, sep = rng.choice("23456789") + d(2), rng.choice(" -.")
    at, dot = rng.choice([("[at]", "[dot]"), ("(at)", "(dot)"), ("{at}", "{dot}"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("[at]", "."), (" @ ", ".")])
    tld = rng.choice(["com", "org", "net", "de", "fr", "es", "io"])
    kind, item = rng.choice([
        (0, f"{word()}{at}{word()}{dot}{tld}"), (0, f"{word()}.{word()}{at}{word()}{dot}{tld}"), (0, f"{word()}{at}{word()}{dot}{word()}{dot}{tld}"),
        (1, ".".join(str(rng.randint(0, 255)) for _ in range(4))), (2, card(16)), (2, cut(card(16), (4,) * 4, rng.choice(" -"))), (2, cut(amex(rng), (4, 6, 5), rng.choice(" -"))),
        (3, f"({area}) {d(3)}-{d(4)}"), (3, f"{area}-{d(3)}-{d(4)}"), (3, f"{area}.{d(3)}.{d(4)}"), (3, f"({area}) {d(3)} {d(4)}"), (3, f"+{rng.randint(1, 99)} ({area}) {d(3)}-{d(4)}"), (3, f"+{rng.randint(1, 99)}{sep}{area}{sep}{d(3)}{sep}{d(4)}"), (3, f"00{rng.randint(30, 49)} {d(3)} {d(7)}"),
        *[(None, x) for x in (bad(16), bad(15), bad(13), cut(bad(16), (4,) * 4, " "), d(7), d(8), d(9), d(10), d(11), d(12), d(20), d(24), f"20{d(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"19{d(2)}-20{d(2)}", f"978-3-{d(2)}-{d(6)}-{d(1)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(4)} {d(4)}", f"{d(3)}-{d(4)}", f"{d(6)}.{d(2)}", f"{d(1)}.{d(8)}", f"{d(4)}-{d(4)}-{d(4)}", f"{d(3)}.{d(3)}.{d(3)}", f"300.{d(3)}.{d(3)}.999", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(5)}-{d(4)}", f"{d(2)}-{d(7)}", f"{d(1)} {d(1)} {d(1)} {d(1)} {d(1)} {d(1)} {d(1)}", f"{word()} {word()}")],
    ])
    cue = rng.choice([None, None, None, *(w for k, words in CUES if kind is not None and k == KINDS[kind] for w in words.split())])
    before = " ".join([word() for _ in range(rng.randint(0, 3))] + ([cue + rng.choice(["", ":"])] if cue else []))
    before += " " if before else ""
    after = rng.choice(["", ".", " " + word(), ", " + word(), " " + word() + " " + d(rng.randint(1, 4))])
    return before + item + after, [] if kind is None else [(kind, len(before), len(before) + len(item))]


def amex(rng: random.Random) -> str:
    body = "37" + "".join(rng.choice("0123456789") for _ in range(12))
    return body + next(c for c in "0123456789" if luhn(body + c))


@lru_cache(1)
def trained(examples: int = EXAMPLES, rounds: int = ROUNDS, seed: int = SEED) -> Field:
    rng = random.Random(seed)
    return Field().fit([example(rng) for _ in range(examples)], rounds)


def islands(text: str):
    """(start, end) of the parts of a text that can hold candidates; they may overlap."""
    for m in NUMBER.finditer(text):
        yield m.span()
    for m in MARK.finditer(text):
        start = m.start() - (text[m.start() - 1 : m.start()] == " ")
        least = max(0, start - LONGEST_LOCAL)
        while start > least and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
            start -= 1
        if found := LOOSE_MAIL.match(text, start, min(len(text), start + LONGEST_MAIL)):
            yield found.span()


def added_spans(text: str, strict: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """Spans that the field finds besides the strict ones, touching none of them nor each other."""
    out, taken = [], bytearray(len(text))
    for _, s, e in strict:
        taken[s:e] = b"\1" * (e - s)
    for start, end in islands(text):
        a, b = max(0, start - 24), min(len(text), end + 8)  # the features look no further
        for k, s, e in field.decode(text[a:b], start - a, end - a, taken[a:b]):
            out.append((k, s + a, e + a))
            taken[s + a : e + a] = b"\1" * (e - s)
    return out


def show(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def found(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), field: Field | None = None) -> DataFrame:
    """The kept columns, with strict and spans, both arrays of (kind, start, end) in code points, in order."""
    field = field or trained()
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    names = ("kind", "start", "end")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        strict, every = [], []
        for text in batch.column("__text").to_pylist():
            base = sorted(strict_spans(text or ""))
            strict.append([dict(zip(names, s)) for s in base])
            every.append([dict(zip(names, s)) for s in sorted(base + added_spans(text or "", base, field))])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(strict, kind), pa.array(every, kind)], [*keep, "strict", "spans"])

    chosen = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    spans = "array<struct<kind: int, start: int, end: int>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return map_batches(chosen, run, f"{schema}, strict {spans}, spans {spans}")


def redacted(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars", field: Field | None = None) -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets; overlapping spans become one."""
    field = field or trained()
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, sizes = [], []
        for text in batch.column(names.index(text_col)).to_pylist():
            if text is not None:
                base = strict_spans(text)
                parts, at = [], 0
                for kind, s, e in sorted(base + added_spans(text, base, field), key=lambda x: (x[1], -x[2])):
                    if s >= at:
                        parts += [text[at:s], f"<{KINDS[kind].upper()}>"]
                    at = max(at, e)
                text = "".join(parts) + text[at:]
            out.append(text)
            sizes.append(len(text or ""))
        columns = list(batch.columns)
        columns[names.index(text_col)] = pa.array(out, batch.schema.field(names.index(text_col)).type)
        if count_col in names:
            columns[names.index(count_col)] = pa.array(sizes, pa.int64()).cast(batch.schema.field(names.index(count_col)).type)
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(docs, run, docs.schema)
