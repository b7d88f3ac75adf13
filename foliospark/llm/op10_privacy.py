"""Personal data in texts: exact base rules, and a semi-Markov conditional random field that adds the spans they miss.

The base rules match leftmost and greedily, so two neighbours (a card number after a phone number, say) can spoil each
other. The model looks at regions of digits and marks, and at words with an @. Candidate segments run over up to
``MOST`` tokens; features of the whole segment (digit count, groups, separators, check digit, ranges, neighbours)
score it as each kind; forward sums over all segmentations train the weights, and the best segmentation, found by
dynamic programming over segments of bounded length, chooses boundaries and kinds together. Learning regions are those
of a bounded, documented sample of documents (about ``SAMPLE``, those with the smallest id hashes, at most
``REGIONS`` regions, of one pattern of digits, marks and kinds at most ``PATTERN``) in which the base rules had nothing
to drop; their labels are the base spans. A model span is
added if no base span overlaps it and its share of the probability is at least ``SURE``.

Null and empty texts have no spans. Without learning regions only base spans are found. Rows are independent; copies,
ties and extra columns change nothing. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.shared import byte_table, documents, per_text, pieces, text_bytes

KINDS = ("email", "ip", "card", "phone")
MOST = 14
SAMPLE = 40_000
REGIONS = 2_000
PATTERN = 50
SURE = 0.9
EPOCHS = 6
#: Fixed character sets and patterns of the base rules. Digit runs are possessive: what follows can't be a digit.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBERS = re.compile(r"[+(]?[0-9][\x20().+0-9-]*[0-9]")
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.DOTALL)
SPACE = re.compile(r"[ \t\n\r\x0b\f]")
DIGITS, LETTERS = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]+")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum((2 * v) // 10 + (2 * v) % 10 for v in values[1::2])) % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def small_parts(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """The base rules' spans in order, and the stretches that a rule matched but dropped."""
    found, dropped = [], []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:  # no @ is among them, so each character is passed once
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            found.append((start, domain.end(), "email"))
            end = domain.end()
        at = text.find("@", max(at + 1, end))
    if "." in text:
        for m in IP.finditer(text):
            (found if small_parts(m[0]) else dropped).append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
        elif len(digits) > 19 or len(digits) >= 12 and len(digits) < len(m[0]):
            dropped.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            n = len(digits_of(m[0]))
            if 9 <= n <= 15:
                found.append((*m.span(), "phone"))
            elif n > 15:
                dropped.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]))), [s[:2] for s in dropped]


def regions(text: str) -> list[tuple[int, int]]:
    """Where the model looks: stretches of at least 7 digits with marks between them, and words with an @."""
    out = [m.span() for m in NUMBERS.finditer(text) if m.end() - m.start() >= 7 and len(digits_of(m[0])) >= 7]
    end, at = 0, text.find("@")
    while at >= 0:
        start = max(end, 1 + max(text.rfind(c, end, at) for c in " \t\n\r\x0b\f"))
        space = SPACE.search(text, at)
        end = space.start() if space else len(text)
        out.append((start, end))
        at = text.find("@", end)
    return out


def side(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return "digit" if c in "0123456789" else "letter" if c.isalpha() else "space" if c.isspace() else c if c in "+-.()@_" else "mark"


class Region:
    """Tokens of a region and the features of its candidate segments: (first token, last token, kind) -> feature names."""

    def __init__(self, text: str, start: int, end: int):
        self.places = [(start + m.start(), start + m.end()) for m in TOKEN.finditer(text[start:end])]
        self.segments: list[tuple[int, int, str, list[str]]] = []
        words = [text[a:b] for a, b in self.places]
        mail = "@" in text[start:end]
        for i, word in enumerate(words):
            if not (word.isascii() and word.isalnum() if mail else word[0] in "+0123456789"):
                continue
            for j in range(i, min(i + MOST, len(words))):
                if words[j].isascii() and words[j].isalnum() and (mail or words[j][0] in "0123456789"):
                    self.add(text, words, i, j, mail)

    def add(self, text: str, words: list[str], i: int, j: int, mail: bool) -> None:
        a, b = self.places[i][0], self.places[j][1]
        part = words[i : j + 1]
        common = [f"left={side(text, a - 1)}", f"right={side(text, b)}"]
        if mail:
            if part.count("@") != 1:
                return
            domain = text[a:b].partition("@")[2]
            common += [f"dots={min(domain.count('.'), 3)}", f"whole={bool(DOMAIN.fullmatch(domain))}", f"letters={part[-1].isalpha()}", f"last={min(len(part[-1]), 8)}", f"double={'..' in text[a:b]}"]
            kinds = KINDS[:1]
        else:
            groups = [w for w in part if w[0] in "0123456789"]
            n = sum(map(len, groups))
            if n > 40 or n < 4:
                return
            marks = "".join(sorted({w for w in part if w[0] not in "0123456789"}))
            shape = "".join("9" * min(len(w), 5) if w[0] in "0123456789" else w for w in part) if len(part) <= 10 else "long"
            common += [f"digits={n}", f"groups={min(len(groups), 6)}", f"marks={marks}", f"shape={shape}", f"luhn={12 <= n <= 19 and luhn(''.join(groups))}", f"plus={part[0] == '+'}"]
            common.append(f"parts={len(groups) == 4 and marks == '.' and small_parts(text[a:b])}")
            kinds = KINDS[1:]
        for kind in kinds:
            self.segments.append((i, j, kind, [kind, *(f"{kind}:{c}" for c in common)]))


class Model:
    """Feature weights; a token outside of all segments scores 0."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def scores(self, region: Region) -> np.ndarray:
        return np.array([sum(self.weights.get(f, 0.0) for f in s[3]) for s in region.segments])

    def posterior(self, region: Region, scores: np.ndarray) -> np.ndarray:
        """Probability of each segment, by forward and backward sums over all segmentations."""
        n = len(region.places)
        forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        forward[0] = backward[n] = 0.0
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        beginning: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j, _, _) in enumerate(region.segments):
            ending[j + 1].append(k)
            beginning[i].append(k)
        for t in range(1, n + 1):
            forward[t] = np.logaddexp.reduce([forward[t - 1], *(forward[region.segments[k][0]] + scores[k] for k in ending[t])])
        for t in range(n - 1, -1, -1):
            backward[t] = np.logaddexp.reduce([backward[t + 1], *(backward[region.segments[k][1] + 1] + scores[k] for k in beginning[t])])
        return np.exp([forward[i] + scores[k] + backward[j + 1] - forward[n] for k, (i, j, _, _) in enumerate(region.segments)])

    def best(self, region: Region, scores: np.ndarray) -> list[int]:
        """The segments of the best segmentation."""
        n = len(region.places)
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        for k, s in enumerate(region.segments):
            ending[s[1] + 1].append(k)
        top, back = [0.0] * (n + 1), [-1] * (n + 1)
        for t in range(1, n + 1):
            top[t] = top[t - 1]
            for k in ending[t]:
                if (value := top[region.segments[k][0]] + scores[k]) > top[t]:
                    top[t], back[t] = value, k
        out, t = [], n
        while t > 0:
            if back[t] >= 0:
                out.append(back[t])
                t = region.segments[back[t]][0]
            else:
                t -= 1
        return out[::-1]

    def spans(self, text: str) -> list[Span]:
        out = []
        for start, end in regions(text):
            region = Region(text, start, end)
            if region.segments:
                scores = self.scores(region)
                chosen = self.best(region, scores)
                if chosen:
                    sure = self.posterior(region, scores)
                    out += [(region.places[i][0], region.places[j][1], kind) for k in chosen if sure[k] >= SURE for i, j, kind, _ in [region.segments[k]]]
        return out


def fit(examples: list[tuple[str, list[Span]]], epochs: int = EPOCHS, rate: float = 0.5, shrink: float = 1e-4) -> Model:
    """Weights by adaptive gradient steps on the log-likelihood of the labelled segmentations."""
    model, squares = Model(), {}
    prepared = []
    for text, labels in examples:
        for start, end in regions(text):
            region = Region(text, start, end)
            own = {s for s in labels if start <= s[0] and s[1] <= end}
            gold = np.array([(region.places[i][0], region.places[j][1], kind) in own for i, j, kind, _ in region.segments], float)
            if len(gold) and gold.sum() == len(own):
                prepared.append((region, gold))
    for _ in range(epochs):
        for region, gold in prepared:
            gradient: dict[str, float] = {}
            for (_, _, _, features), g in zip(region.segments, gold - model.posterior(region, model.scores(region)), strict=True):
                if abs(g) > 1e-3:
                    for f in features:
                        gradient[f] = gradient.get(f, 0.0) + g
            for f, g in gradient.items():
                g -= shrink * model.weights.get(f, 0.0)
                squares[f] = squares.get(f, 0.0) + g * g
                model.weights[f] = model.weights.get(f, 0.0) + rate * g / (1e-6 + squares[f] ** 0.5)
    return model


def learning_regions(docs: DataFrame, sample: int, most: int) -> list[tuple[str, list[Span]]]:
    """Regions with ten characters around them and their base spans, from a sample of documents; of one pattern (digits and
    letters made alike) and kinds those ``PATTERN`` that come first by the hash of their document."""
    known = docs.filter("doc_id is not null and text is not null").select(F.xxhash64("doc_id").alias("place"), "text")
    count = known.count()
    limit = min(1.0, sample / max(count, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            out = []
            for place, text in zip(piece.column("place").to_pylist(), piece.column("text").to_pylist(), strict=True):
                found, dropped = base_spans(text)
                taken: list[Span] = []
                for s in found:
                    if not taken or s[0] >= taken[-1][1]:
                        taken.append(s)
                for start, end in regions(text):
                    if end - start <= 200 and not any(a < end and start < b for a, b in dropped):
                        low, high = max(start - 10, 0), min(end + 10, len(text))
                        own = [s for s in taken if start <= s[0] and s[1] <= end]
                        shape = LETTERS.sub("a", DIGITS.sub("0", text[start:end])) + " " + " ".join(k for _, _, k in own)
                        out.append((place, low, text[low:high], [f"{a - low}:{b - low}:{k}" for a, b, k in own], shape))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["place", "low", "part", "labels", "shape"])

    share = F.pmod("place", F.lit(1 << 40)) / float(1 << 40)
    rows = known.filter(share < limit).mapInArrow(run, "place long, low long, part string, labels array<string>, shape string").distinct()
    alike = Window.partitionBy("shape").orderBy("place", "low", "part")
    rows = rows.withColumn("nth", F.row_number().over(alike)).filter(F.col("nth") <= PATTERN)
    rows = rows.orderBy("place", "low", "part").limit(most).collect()
    return [(r["part"], [(int(a), int(b), k) for a, b, k in (x.split(":") for x in r["labels"])]) for r in rows]


def all_spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the model's too where no base span overlaps."""
    base, _ = base_spans(text)
    added = [s for s in model.spans(text) if not any(a < s[1] and s[0] < b for a, b, _ in base)] if model.weights else []
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def worth_reading(piece: pa.RecordBatch) -> np.ndarray:
    """Texts with a digit or an @."""
    data, bounds = text_bytes(piece.column("text"))
    return per_text(byte_table(b"0123456789@")[data], bounds) > 0


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def private_spans(docs: DataFrame, sample: int = SAMPLE, most: int = REGIONS) -> DataFrame:
    """One row per document: base counts and digest, and all spans."""
    model = fit(learning_regions(docs, sample, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = ([], [])
        for piece in pieces(batches):
            texts = piece.column("text")
            found = [all_spans(texts[k].as_py(), model) if w else nothing for k, w in enumerate(worth_reading(piece).tolist())]
            counts = [pa.array([sum(s[2] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
            digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([written(every) for _, every in found], pa.string())
            added = pa.array([len(every) - len(base) for base, every in found], pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), *counts, digests, spans, added], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redacted_text(text: str, spans: list[Span]) -> str:
    """The text with a mark in place of each span; spans that overlap get the mark of the first."""
    out, end = [], 0
    for k, (a, b, kind) in enumerate(spans):
        if a >= end or not k:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, sample: int = SAMPLE, most: int = REGIONS) -> DataFrame:
    """The documents with every span replaced, and n_chars, where they have it, as it is then."""
    model = fit(learning_regions(docs, sample, most))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            texts = piece.column("text")
            new = {k: redacted_text(t, all_spans(t, model)[1]) for k, w in enumerate(worth_reading(piece).tolist()) if w for t in [texts[k].as_py()]}
            columns = dict(zip(names, piece.columns, strict=True))
            columns["text"] = pa.array([new.get(k, x) for k, x in enumerate(texts.to_pylist())], texts.type)
            if "n_chars" in columns:
                chars = columns["n_chars"]
                columns["n_chars"] = pa.array([len(new[k]) if k in new and x is not None else x for k, x in enumerate(chars.to_pylist())], chars.type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return docs.mapInArrow(run, docs.schema)


def op10_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_spans(documents(spark, sf_dir))
