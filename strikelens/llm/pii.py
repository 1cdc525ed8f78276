"""Personal data: exact base patterns, and a semi-Markov CRF that adds spans they miss.

The CRF scores whole candidate segments (shape, digit count, checksums, neighbours) of at most
``MAX_TOKENS`` tokens and ``MAX_CHARS`` characters, and a dynamic program chooses boundaries and
types together. A segment has to hold a digit, an at sign or a written-out one ("(at)", "[at]", or
"at" with a "dot" after the next word), and has to be valid for its kind: a card passes Luhn, an
address has four parts of at most 255, a phone 7 to 15 digits, an email reads as one once its signs
are put back. So only the words around such marks are decoded, across single spaces and line ends;
that is exact and keeps the work linear in the text.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strikelens.llm.common import documents, map_batches

# The kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then kind; leftmost and without overlap within a kind.

    Emails are found from their at signs, so long runs without one cost nothing; the other
    patterns cannot begin inside a run of digits that failed, and are linear as well.
    """
    found = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end(), "email"))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(map(_octet, m.groups())):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the semi-Markov model ------------------------------------------------------------------

TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
MAX_TOKENS = 18
#: Longer runs of characters are no entity; a segment never reaches over this many.
MAX_CHARS = 80
#: A written-out at sign or dot: in brackets, or between two spaces.
HIDDEN_AT = re.compile(r"[ \t]{0,2}[(\[{<](?:at|At|AT)[)\]}>][ \t]{0,2}|[ \t](?:at|AT)[ \t](?=[A-Za-z0-9-]{1,63}[ \t](?:dot|DOT)[ \t])")
HIDDEN_DOT = re.compile(r"[ \t]{0,2}[(\[{<](?:dot|Dot|DOT)[)\]}>][ \t]{0,2}|[ \t](?:dot|DOT)[ \t]")
#: What a segment has to hold: a digit, an at sign, or the letters of a written-out one.
MARKS = re.compile(r"[0-9@]+|(?<=[(\[{<])(?:at|At|AT)(?=[)\]}>])|(?<=[ \t])(?:at|AT)(?=[ \t][A-Za-z0-9-]{1,63}[ \t](?:dot|DOT)[ \t])")
#: What may stand between the parts of one entity.
JOIN = re.compile(r"[ \t]{0,2}(?:\r?\n)?[ \t]{0,2}")
SPACE = re.compile(r"\s")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def _word(text: str, at: int, step: int) -> int:
    """The end of the word that begins (or, going back, ends) at a place, at most ``MAX_CHARS`` on."""
    if step < 0:
        low = max(0, at - MAX_CHARS)
        spaces = [m.end() for m in SPACE.finditer(text, low, at)]
        return spaces[-1] if spaces else low
    found = SPACE.search(text, at, at + MAX_CHARS)
    return found.start() if found else min(len(text), at + MAX_CHARS)


def regions(text: str) -> list[tuple[int, int, set[int]]]:
    """(start, end, places of marks) of what is decoded: the words with a mark, those on both sides
    of a written-out sign, and what stands next to them."""
    found: list[tuple[int, int, set[int]]] = []
    for m in MARKS.finditer(text):
        if found and m.start() < found[-1][1]:
            found[-1][2].add(m.start())
            start, end = found[-1][0], max(found[-1][1], _word(text, m.end(), 1))
            if end > found[-1][1]:
                found[-1] = (start, end, found[-1][2])
        else:
            start, end = _word(text, m.start(), -1), _word(text, m.end(), 1)
            if text[m.start()].isalpha():  # a written-out at sign: the words around it, and dots after these
                sign = HIDDEN_AT.search(text, max(0, m.start() - 3), m.end() + 80)
                if sign is None:
                    continue
                start, end = _word(text, sign.start(), -1), _word(text, sign.end(), 1)
            found.append((start, end, {m.start()}))
        while dot := HIDDEN_DOT.match(text, found[-1][1]):
            found[-1] = (found[-1][0], _word(text, dot.end(), 1), found[-1][2])
    joined: list[tuple[int, int, set[int]]] = []
    for start, end, marks in found:
        if joined and (start <= joined[-1][1] or (start - joined[-1][1] <= 6 and JOIN.fullmatch(text, joined[-1][1], start))):
            before = joined.pop()
            start, end, marks = before[0], max(before[1], end), before[2] | marks
        joined.append((start, end, marks))
    return joined


def valid(span: str) -> list[bool]:
    """Whether a segment can be of each kind at all."""
    digits = NOT_DIGIT.sub("", span)
    letters = any(map(str.isalpha, span))
    parts = span.split(".")
    address = len(parts) == 4 and all(p.isascii() and p.isdigit() and _octet(p) for p in parts)
    plain = HIDDEN_DOT.sub(".", HIDDEN_AT.sub("@", span))
    return [
        EMAIL.fullmatch(plain) is not None,
        address,
        not letters and 13 <= len(digits) <= 19 and luhn(digits),
        not letters and 7 <= len(digits) <= 15,
    ]


def _shape(text: str) -> str:
    text = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", lambda m: f"d{min(len(m.group()), 9)}", text))
    return re.sub(r"[ \t]*\r?\n[ \t]*", "|", text)


def span_features(text: str, start: int, end: int) -> list[str]:
    """What the model sees of a whole segment and its two neighbours."""
    span = text[start:end]
    digits = NOT_DIGIT.sub("", span)
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    goes_on = HIDDEN_DOT.match(text, end) is not None or HIDDEN_AT.match(text, end) is not None
    shape = _shape(span)
    found = [
        "bias",
        f"shape {shape}",
        f"coarse {re.sub('d[0-9]', 'd', shape)}",
        f"digits {min(len(digits), 20)} {any(map(str.isalpha, span))}",
        f"before {'a' if before.isalnum() else before or '^'}",
        f"after {'sign' if goes_on else 'a' if after.isalnum() else after or '$'}",
    ]
    return found + [f"valid {kind}" for kind, ok in zip(KINDS, valid(span), strict=True) if ok]


def _candidates(
    text: str, lo: int, hi: int, marks: set[int] | None = None
) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """Tokens of a region, and its possible entities as (first, last + 1, start, end)."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, lo, hi)]
    marks = marks or set()
    spans = []
    for i, (start, _) in enumerate(tokens):
        if not (text[start].isalnum() or text[start] in "+("):
            continue
        marked = 0
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            end = tokens[j][1]
            if end - start > MAX_CHARS:
                break
            first = text[tokens[j][0]]
            marked |= 1 if "0" <= first <= "9" or first == "@" or tokens[j][0] in marks else 0
            if marked and end - start >= 6 and text[end - 1].isalnum() and any(valid(text[start:end])):
                spans.append((i, j + 1, start, end))
    return tokens, spans


def _arcs(spans: list[tuple[int, int, int, int]], n: int) -> list[list[tuple[int, int]]]:
    """For each end position the (begin position, segment number) that reach it."""
    into: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for k, (i, j, _, _) in enumerate(spans):
        into[j].append((i, k))
    return into


class SemiCrf:
    """Weights by feature; a plain token scores 0, so a segment needs a positive score."""

    def __init__(self, weights: dict[str, list[float]]) -> None:
        self.weights = weights

    def scores(self, text: str, start: int, end: int) -> list[float]:
        total = [0.0 if ok else -math.inf for ok in valid(text[start:end])]
        for feature in span_features(text, start, end):
            for k, w in enumerate(self.weights.get(feature, ())):
                total[k] += w
        return total

    def decode(self, text: str) -> list[Span]:
        """The best segmentation of every region: (start, end, kind)."""
        found: list[Span] = []
        for region in regions(text):
            tokens, spans = _candidates(text, *region)
            if not spans:
                continue
            into = _arcs(spans, len(tokens))
            best = [0.0] * (len(tokens) + 1)
            back: list[tuple[int, int, int] | None] = [None] * (len(tokens) + 1)
            for j in range(1, len(tokens) + 1):
                best[j] = best[j - 1]
                for i, k in into[j]:
                    for kind, score in enumerate(self.scores(text, *spans[k][2:])):
                        if best[i] + score > best[j]:
                            best[j], back[j] = best[i] + score, (i, k, kind)
            j, chosen = len(tokens), []
            while j > 0:
                if back[j] is None:
                    j -= 1
                else:
                    i, k, kind = back[j]
                    chosen.append((*spans[k][2:], KINDS[kind]))
                    j = i
            found += chosen[::-1]
        return found


def _variants(span: str, kind: str) -> list[str]:
    """Other ways to write the same thing, which the base patterns miss."""
    digits = NOT_DIGIT.sub("", span)
    if kind == "phone":
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        forms = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}) {b}\n{c}", f"{a}-{b}\n{c}", f"{a}\n{b}-{c}"]
    elif kind == "email":
        local, _, domain = span.partition("@")
        dotted = {sign: domain.replace(".", sign) for sign in (" [dot] ", " (dot) ", " dot ")}
        forms = [f"{local} (at) {domain}", f"{local} [at] {domain}", f"{local}(at){domain}", f"{local}[at]{domain}",
                 f"{local} [at] {dotted[' [dot] ']}", f"{local} (at) {dotted[' (dot) ']}", f"{local} at {dotted[' dot ']}"]
    elif kind == "card":
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        middle = len(groups) // 2
        halves = [sign.join(groups[:middle]) + "\n" + sign.join(groups[middle:]) for sign in (" ", "-")]
        forms = [*halves, ".".join(groups), "  ".join(groups)]
    else:
        forms = []
    return [form for form in forms if not base_spans(form)]


def _refused(text: str) -> list[Span]:
    """What looks like a base span and isn't: cards that fail Luhn, addresses out of range."""
    found = []
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and not luhn(digits):
            found.append((m.start(), m.end(), "card"))
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if not all(map(_octet, m.groups()))]
    return found


def _distractor(rng: random.Random) -> str:
    """Digits that belong to nobody: dates, versions, amounts, hashes, long numbers."""
    n = rng.randrange
    return rng.choice(
        [f"{n(1900, 2100)}-{n(10, 13)}-{n(10, 29)}", f"{n(10)}.{n(10)}.{n(10)}", f"{n(1000)},{n(100, 1000)}.{n(10, 100)}",
         f"{n(256, 999)}.{n(999)}.{n(999)}.{n(256, 999)}", "".join(rng.choices("0123456789abcdef", k=40)),
         str(n(10**9, 10**12)), f"{n(10, 24)}:{n(10, 60)}:{n(10, 60)}",
         f"{n(1900, 2100)}-{n(10, 13)}-{n(10, 29)} at {n(10, 24)}:{n(10, 60)}:{n(10, 60)}", f"#{n(10**6)}", f"{n(10**13, 10**14)}7x",
         f"{n(10**7, 10**8)}\n{n(10**7, 10**8)}", f"{n(100, 999)}\n{n(100, 999)}\n{n(1000, 9999)}", f"{n(10)}.{n(100)}  {n(10)}.{n(100)}",
         f"look at page {n(1000)}", f"{n(1000, 9999)} {n(1000, 9999)} {n(1000, 9999)}", f"{n(100)}\n{n(10**6)} {n(10**6)}"]
    )


#: Characters on each side of a span that go along.
CONTEXT = 24
#: (what stands before, the span, what stands after, its kind or nothing where it is none)
Passage = tuple[str, str, str, str]


def passages(text: str) -> list[Passage]:
    """The base spans of a text and what was refused as one, each with its neighbourhood."""
    found = [(s, e, k) for s, e, k in base_spans(text)] + [(s, e, "") for s, e, _ in _refused(text) if e - s <= MAX_CHARS]
    return [(text[max(0, s - CONTEXT) : s], text[s:e], text[e : e + CONTEXT], k) for s, e, k in found]


def training_text(held: list[Passage], seed: int = 17) -> list[tuple[str, list[Span]]]:
    """Short labelled passages: base spans with their context, every rewritten form of them, what
    was refused, and distractors."""
    rng = random.Random(seed)
    made = []
    for left, span, right, kind in held:
        if MARKS.search(left + right):
            left, right = "see ", " for"
        made.append((left + span + right, [(len(left), len(left) + len(span), kind)] if kind else []))
        if kind:
            forms = _variants(span, kind)
            for form in rng.sample(forms, min(2, len(forms))):
                made.append((left + form + right, [(len(left), len(left) + len(form), kind)]))
            made.append((f"{left}{_distractor(rng)}{right}", []))
    return made


def fit(held: list[Passage], epochs: int = 12, rate: float = 0.5, decay: float = 1e-3) -> SemiCrf:
    """Maximum likelihood by AdaGrad; the expectations come from the forward-backward sums."""
    index: dict[str, int] = {}
    cases = []
    for text, gold in training_text(held):
        for region in regions(text):
            tokens, spans = _candidates(text, *region)
            if not spans:
                continue
            wanted = {(s, e): KINDS.index(k) for s, e, k in gold}
            rows = [[index.setdefault(f, len(index)) for f in span_features(text, s, e)] for _, _, s, e in spans]
            target = [wanted.get((s, e), -1) for _, _, s, e in spans]
            barred = np.array([[0.0 if ok else -np.inf for ok in valid(text[s:e])] for _, _, s, e in spans])
            cases.append((len(tokens), spans, rows, np.array(target), barred))
    weights = np.zeros((len(index) + 1, len(KINDS)))
    sums = np.full_like(weights, 1e-6)
    for _ in range(epochs):
        for n, spans, rows, target, barred in cases:
            score = np.array([weights[r].sum(axis=0) for r in rows]) + barred
            joint = np.logaddexp.reduce(score, axis=1)
            forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
            into = _arcs(spans, n)
            for j in range(1, n + 1):
                total = forward[j - 1]
                for i, k in into[j]:
                    total = np.logaddexp(total, forward[i] + joint[k])
                forward[j] = total
            out: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
            for k, (i, j, _, _) in enumerate(spans):
                out[i].append((j, k))
            for i in range(n - 1, -1, -1):
                total = backward[i + 1]
                for j, k in out[i]:
                    total = np.logaddexp(total, backward[j] + joint[k])
                backward[i] = total
            for k, (i, j, _, _) in enumerate(spans):
                gap = -np.exp(score[k] + forward[i] + backward[j] - forward[n])
                if target[k] >= 0:
                    gap[target[k]] += 1
                if np.abs(gap).max() < 1e-3:
                    continue
                step = gap - decay * weights[rows[k]]
                sums[rows[k]] += step**2
                weights[rows[k]] += rate * step / np.sqrt(sums[rows[k]])
    return SemiCrf({f: weights[i].round(6).tolist() for f, i in index.items()})


def all_spans(text: str, model: SemiCrf, base: list[Span] | None = None) -> list[Span]:
    """The base spans, and those of the model that touch none of them."""
    base = base_spans(text) if base is None else base
    taken: list[list[int]] = []
    for start, end, _ in base:
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(end, taken[-1][1])
        else:
            taken.append([start, end])
    added, at = [], 0
    for start, end, kind in model.decode(text):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at == len(taken) or taken[at][0] >= end:
            added.append((start, end, kind))
    return sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def fit_on(df: DataFrame, sample_docs: int = 2000, sample_spans: int = 300) -> SemiCrf:
    """Fit on at most ``sample_spans`` passages of at most ``sample_docs`` documents that hold a digit
    or an at sign, of any length.

    The documents are those with the smallest hashes of ``doc_id`` and text, the passages those
    with the smallest hashes of what they hold: the same rows give the same model, whatever
    their order or partitions; equal rows count once. Hashes alone are ordered, passages are cut
    out by the workers, and the driver sees no whole text.
    """
    rows = documents(df).where("text rlike '[0-9@]'").select(F.xxhash64("doc_id", "text").alias("h"), "doc_id", "text")
    least = rows.select(F.col("h").alias("of")).distinct().orderBy("of").limit(sample_docs)
    chosen = rows.join(F.broadcast(least), F.col("h") == F.col("of")).select("h", "text")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [p for text in batch.column("text").to_pylist() for p in passages(text)]
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["before", "span", "after", "kind"])

    names = ["before", "span", "after", "kind"]
    cut = map_batches(chosen, job, ", ".join(f"{n} string" for n in names)).distinct()
    # Of each kind, and of what was refused, a like number: one that is everywhere doesn't crowd out the others.
    place = Window.partitionBy("kind").orderBy(F.xxhash64(*names), *names)
    share = max(1, sample_spans // (len(KINDS) + 1))
    few = cut.withColumn("place", F.row_number().over(place)).where(F.col("place") <= share).orderBy("kind", "place")
    return fit([tuple(r) for r in few.select(*names).collect()])


def find_pii(df: DataFrame, model: SemiCrf) -> DataFrame:
    """One row per input row: ``doc_id``, ``base`` and ``spans`` as arrays of (kind, start, end).

    Null texts are empty. Repeated rows give repeated results; a null ``doc_id`` stays null.
    An empty table gives an empty result. Offsets are code points, ends are exclusive.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            rows: list[list] = [[], []]
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                for out, spans in zip(rows, (base, all_spans(text, model, base)), strict=True):
                    out.append([{"kind": k, "start": s, "end": e} for s, e, k in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(r, pa.list_(kind)) for r in rows)],
                names=["doc_id", "base", "spans"],
            )

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_batches(documents(df), job, f"doc_id long, base {span}, spans {span}")


def masked(df: DataFrame, model: SemiCrf) -> DataFrame:
    """``df`` with every span in ``text`` replaced by its kind in angle brackets; same columns.

    Of overlapping spans the one that starts first decides. Null texts stay null.
    """
    columns, at = df.columns, df.columns.index("text")

    def mask(text: str | None) -> str | None:
        if text is None:
            return None
        out, done = [], 0
        for start, end, kind in all_spans(text, model):
            if end <= done:
                continue
            if start >= done:
                out += [text[done:start], f"<{kind}>"]
            done = end
        return "".join(out) + text[done:] if out else text

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([mask(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [texts if i == at else c for i, c in enumerate(batch.columns)], names=columns
            )

    return map_batches(df, job, df.schema)


def digest(df: DataFrame, model: SemiCrf) -> DataFrame:
    """Counts per kind, the SHA-256 of the base spans, and all spans in writing."""
    named = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ","
    )
    found = find_pii(df, model)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(named("base"), 256).alias("base_sha256"), named("spans").alias("spans")
    )

