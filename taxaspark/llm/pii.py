"""Personal data: high-recall candidates judged by boosted trees, beside the exact base patterns.

The base patterns of each kind find spans that always stay. Generators propose further spans that
may overlap: written-out or spaced addresses, numbers without a leading plus, card numbers with
other separators or lengths. Gradient boosted trees score a candidate by its format and by the
words around it, and a threshold per kind selects those that are added.

There are no labels. Examples of a text are its base spans and their rewritten forms in their own
context, plain numbers and dates drawn into it, and the candidates that it has besides: these are
unlabelled, so they count little against, and not at all where they pass a kind's own check. The trees
learn from a bounded sample of texts, drawn for each kind from those that seem to hold it; thresholds are
calibrated on the examples of every held-out text of the table, by a histogram of their scores.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark.llm.common import parts

#: The kinds in order, and their base patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # inside a run of digits no match starts that its first digit doesn't give
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Runs that an e-mail address can't leave, and what follows its at sign.
MAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]++")
MAIL_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
GENERATORS = (
    ("email", re.compile(r"(?i)\b[a-z0-9][a-z0-9._%+-]{0,63}\s?(?:\(at\)|\[at\]|\{at\}|<at>|\sat\s|@)\s?[a-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?[a-z0-9-]{1,63}){0,3}\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?[a-z]{2,24}\b")),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}(?:\s?\.\s?|\[\.\]|\(\.\)|\s?\(?dot\)?\s?)\d{1,3}(?:(?:\s?\.\s?|\[\.\]|\(\.\)|\s?\(?dot\)?\s?)\d{1,3}){2}(?![\d.]\d)")),
    ("ip", re.compile(r"(?i)(?<![0-9a-f:.])(?:[0-9a-f]{1,4}:){3,7}:?[0-9a-f]{1,4}(?![0-9a-f:])")),
    ("card", re.compile(r"(?<![\d.+])\d{4}(?:[ ./_-]{1,2}\d{3,6}){2,4}(?!\d)")),
    ("card", re.compile(r"(?<![\d.+])\d{13,19}(?!\d)")),
    ("phone", re.compile(r"(?<![\d+.\w])(?:00[\s.-]?)?\(?\d{2,5}\)?(?:[\s./-]{1,2}\(?\d{2,5}\)?){1,5}(?![\d\w])")),
    ("phone", re.compile(r"\+\s?\d(?:[\s()./-]{0,2}\d){6,14}(?!\d)")),
)
CUES = {
    "email": re.compile(r"(?i)e-?mail|contact|write|reach|correo|courriel|mailto|adress"),
    "ip": re.compile(r"(?i)\bip\b|address|server|host|login|ipv[46]"),
    "card": re.compile(r"(?i)card|visa|master|amex|credit|tarjeta|carte|karte|payment|iban"),
    "phone": re.compile(r"(?i)phone|call|tel|mobile|cell|fax|whatsapp|sms|teléfono|telefon|numéro|número|ring"),
}
NAY = re.compile(r"(?i)version|isbn|\bid\b|order|section|token|key|license|page|figure|table|price|year|total")
MODEL_FEATURES = 23


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _mails(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Leftmost matches of EMAIL within one run, in one pass: each at sign ends one user name."""
    found, at = [], text.find("@", start, end)
    while at >= 0:
        host = MAIL_HOST.match(text, at + 1, end) if at > start else None
        if host:
            found.append((start, host.end()))
        start = host.end() if host else at + 1
        at = text.find("@", start, end)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns' matches that pass their checks, by kind and start."""
    found = []
    if "@" in text:
        found += [(0, a, b) for run in MAIL_RUN.finditer(text) if "@" in run[0] for a, b in _mails(text, *run.span())]
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) that the generators propose; they may overlap."""
    found = set()
    has_digit = re.search(r"\d", text) is not None
    for kind, pattern in GENERATORS:
        if kind == "email":
            if "@" not in text and not re.search(r"(?i)\bat\b", text) or not re.search(r"(?i)\.|dot", text):
                continue
        elif not has_digit:
            continue
        found |= {(KINDS.index(kind), m.start(), m.end()) for m in pattern.finditer(text)}
    return sorted(found)


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format of a candidate and what stands around it."""
    span, digits = text[start:end], _digits(text[start:end])
    before, after = text[max(0, start - 40) : start], text[end : end + 25]
    groups = re.split(r"\D+", span.strip("()[] "))
    numbers = [int(g) for g in groups if g and len(g) < 6]
    return [
        kind, len(span), len(digits), luhn(digits) if digits else 0, span.count("."), span.count("-"), span.count(" "), span.count("("),
        "@" in span, bool(re.search(r"(?i)[(\[{<]at|\sat\s", span)), bool(re.search(r"(?i)[(\[{<]dot|\sdot\s", span)), bool(re.search(r"(?i)[.\s)}\]](com|net|org|edu|gov|info|io|co|uk|de|fr|es|it|nl|example)$", span)), "\n" in span,
        len(groups), max((len(g) for g in groups), default=0), max(numbers, default=0) > 255, span.startswith("+"), digits[:2] in ("19", "20") and len(groups) == 3 and len(digits) == 8,
        bool(CUES[KINDS[kind]].search(before)), bool(NAY.search(before)), bool(before[-1:].isalnum()), bool(after[:1].isalnum()), sum(c.isalpha() for c in span),
    ]


@dataclass
class Trees:
    """Gradient boosted regression trees of depth 3 for logistic loss, in arrays."""

    bias: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # split feature, threshold, value of 15 nodes

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(3):
                go = feature[node] >= 0
                right = x[np.arange(len(x)), np.maximum(feature[node], 0)] > threshold[node]
                node = np.where(go, 2 * node + 1 + right, node)
            out += value[node]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, rate: float = 0.2, least: int = 5) -> Trees:
    p = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(p / (1 - p))), [])
    odds = np.full(len(y), model.bias)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 17)[:-1])) for c in x.T]
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-odds))
        grad, hess = weight * (y - q), weight * q * (1 - q) + 1e-6
        feature, threshold, value = np.full(15, -1), np.zeros(15), np.zeros(15)
        rows = {0: np.arange(len(y))}
        for node in range(15):
            at = rows.get(node)
            if at is None:
                continue
            g, h = grad[at], hess[at]
            value[node] = rate * g.sum() / (h.sum() + 1)
            best = (1e-3, -1, 0.0)
            for f in range(x.shape[1]) if node < 7 and len(at) >= 2 * least else ():
                for t in cuts[f]:
                    right = x[at, f] > t
                    n = int(right.sum())
                    if least <= n <= len(at) - least:
                        gr, hr = g[right].sum(), h[right].sum()
                        gl, hl = g.sum() - gr, h.sum() - hr
                        gain = gr**2 / (hr + 1) + gl**2 / (hl + 1) - g.sum() ** 2 / (h.sum() + 1)
                        if gain > best[0]:
                            best = (gain, f, t)
            if best[1] >= 0:
                feature[node], threshold[node] = best[1], best[2]
                right = x[at, best[1]] > best[2]
                rows[2 * node + 1], rows[2 * node + 2] = at[~right], at[right]
        model.trees.append((feature, threshold, value))
        odds = odds + Trees(0.0, [model.trees[-1]]).odds(x)
    return model


def rewritten(kind: int, span: str, r: random.Random) -> str:
    """Another way to write a span of a kind; names and hosts are sometimes others, as those of one
    collection are often alike."""
    d = _digits(span)
    if kind == 0:
        user, _, host = span.partition("@")
        word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
        if r.random() < 0.6:
            user = r.choice([word(), f"{word()}.{word()}", f"{word()}{r.randint(0, 99)}", f"{word()}_{word()}"])
        if r.random() < 0.6:
            host = ".".join([word() for _ in range(r.randint(1, 2))] + [r.choice(["com", "net", "org", "edu", "io", "de", "fr", "es"])])
        at, dot = r.choice([(" at ", " dot "), (" at ", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", "."), (" @ ", "."), ("@ ", "."), ("{at}", "{dot}"), ("(at)", ".")])
        return user + at + host.replace(".", dot)
    if kind == 1:
        return span.replace(".", r.choice(["[.]", " . ", "(.)", " dot "]))
    if kind == 2:
        sep = r.choice([" ", "-", ".", "/", "  "])
        return sep.join(d[k : k + 4] for k in range(0, len(d), 4))
    d = d[-10:].rjust(10, "5")
    if r.random() < 0.5:
        area = r.choice(["({})", "{}", "{}"]).format(d[:3])
        return area + r.choice(" -./") + d[3:6] + r.choice(" -./") + d[6:]
    p = [d[:1], *(d[k : k + 2] for k in (2, 4, 6, 8))]
    return r.choice([f"00 1 {d[:3]} {d[3:6]} {d[6:]}", f"0{d[:3]} {d[3:]}", f"(0{d[:3]}) {d[3:6]} {d[6:]}", f"0{d[:3]}/{d[3:]}", f"0{d[:2]} {d[2:6]} {d[6:]}", "0" + " ".join(p)])


def plain_numbers(r: random.Random) -> str:
    """A number, date, time, version or code as any text may have."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    date = (r.randint(1900, 2030), r.randint(1, 12), r.randint(1, 28))
    return r.choice([
        lambda: "{}-{:02}-{:02}".format(*date), lambda: "{2}/{1}/{0}".format(*date), lambda: "{2:02}.{1:02}.{0}".format(*date), lambda: "{0} {1:02} {2:02}".format(*date), lambda: f"{date[0]} - {date[0] + r.randint(1, 9)}",
        lambda: f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}", lambda: f"{r.randint(0, 30)}.{r.randint(0, 30)}.{r.randint(0, 9)}", lambda: n(r.randint(13, 19)), lambda: f"{n(4)} {n(4)}", lambda: f"{n(3)} {n(2)}",
        lambda: f"{r.randint(300, 999)}.{n(3)}.{n(3)}.{n(3)}", lambda: f"{n(4)}-{n(4)}-{n(4)}-{n(4)}", lambda: f"{n(4)} {n(4)} {n(4)} {n(4)}", lambda: f"{n(2)} - {n(2)}", lambda: f"{r.randint(1, 99)} {n(3)} {n(3)}", lambda: f"{r.randint(1, 99)}.{n(3)}.{n(3)}",
        lambda: f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", lambda: f"{n(5)} {n(5)}", lambda: f"{n(2)}-{n(5)}", lambda: f"{n(3)}/{n(2)}", lambda: f"{n(2)} {n(2)} {n(2)}",
    ])()


#: What an unlabelled candidate counts against.
UNLABELLED = 0.5
CUE_WORDS = ("email: ", "IP ", "card ", "call ")


def _passes(kind: int, span: str) -> bool:
    """A kind's own check, where it has one that numbers seldom pass."""
    return kind == 2 and 16 <= len(d := _digits(span)) <= 19 and luhn(d)


def examples(text: str) -> Iterator[tuple[list[float], int, int, float]]:
    """(features, kind, label, weight) of a text; the same for the same text."""
    r = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
    base = base_spans(text)
    for kind, a, b in base:
        yield features(text, kind, a, b), kind, 1, 0.5
        for _ in range(4):
            new = rewritten(kind, text[a:b], r)
            cue = r.choice(["", "", "", CUE_WORDS[kind]])
            start = max(0, a - 60)
            full = text[start:a] + cue + new + text[b : b + 40]
            at = a - start + len(cue)
            for c in candidates(full):
                whole = abs(c[1] - at) <= 1 and abs(c[2] - at - len(new)) <= 1
                if c[1] < at + len(new) and at < c[2] and (whole or c[0] != kind):  # its own kind cut otherwise is neither right nor wrong
                    yield features(full, *c), c[0], int(c[0] == kind), 1.0
    free = _Taken(base)
    for c in candidates(text):
        if free.clear(c[1], c[2]) and not _passes(c[0], text[c[1] : c[2]]):
            yield features(text, *c), c[0], 0, UNLABELLED
    for _ in range(2 if text.strip() else 0):
        at = r.randrange(len(text))
        cue = r.choice(["", "", "in ", "No. ", "page ", "from "])
        full = text[max(0, at - 50) : at] + " " + cue + plain_numbers(r) + " " + text[at : at + 30]
        for c in candidates(full):
            if not _passes(c[0], full[c[1] : c[2]]):
                yield features(full, *c), c[0], 0, 1.0


class _Taken:
    """Spans of a text that are taken, as sorted disjoint stretches."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def clear(self, a: int, b: int) -> bool:
        k = bisect_right(self.ends, a)
        return k == len(self.starts) or b <= self.starts[k]

    def take(self, a: int, b: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


@dataclass
class Detector:
    trees: Trees
    thresholds: list[float]

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Selected candidates that overlap no base span; of overlapping ones the likelier stays."""
        taken = _Taken(base)
        found = [c for c in candidates(text) if taken.clear(c[1], c[2])]
        if not found or not self.trees.trees:
            return []
        odds = self.trees.odds(np.array([features(text, *c) for c in found], float))
        out = []
        for o, c in sorted(zip(odds.tolist(), found, strict=True), key=lambda z: (-z[0], z[1])):
            if o >= self.thresholds[c[0]] and taken.clear(c[1], c[2]):
                out.append(c)
                taken.take(c[1], c[2])
        return sorted(out)


#: Scores are counted in steps of a tenth between these.
STEP, LEAST, MOST = 0.1, -10.0, 10.0


def _bin(odds: float) -> int:
    return int(np.floor((min(max(odds, LEAST), MOST) - LEAST) / STEP))


def train(texts: list[str]) -> Trees:
    """Trees from the examples of ``texts``; none if these have but one label."""
    rows = [(*x, y, w) for text in texts for x, _, y, w in examples(text)]
    data = np.array(rows, float).reshape(-1, MODEL_FEATURES + 2)
    x, y, weight = data[:, :MODEL_FEATURES], data[:, -2], data[:, -1]
    if len(y) < 50 or y.min() == y.max():
        return Trees(0.0, [])
    return boost(x, y, weight)


def score_counts(trees: Trees, texts: list[str]) -> Counter[tuple[int, int, int]]:
    """By (kind, label, step of the score): weight of the examples, in hundredths."""
    found, x = [], []
    for text in texts:
        for f, kind, y, w in examples(text):
            found.append((kind, y, round(100 * w)))
            x.append(f)
    out: Counter[tuple[int, int, int]] = Counter()
    if x and trees.trees:
        for (kind, y, w), o in zip(found, trees.odds(np.array(x, float)).tolist(), strict=True):
            out[kind, y, _bin(o)] += w
    return out


def thresholds(counts: dict[tuple[int, int, int], int], precision: float = 0.98, least: float = 0.0) -> list[float]:
    """Of each kind the least score from which on the examples have the precision.

    A kind whose examples never reach it, as it has few or none, takes the threshold of all kinds'
    examples together; if these don't reach it either, the score that stands for the precision.
    """
    pooled: Counter[tuple[int, int, int]] = Counter()
    for (_, y, step), n in counts.items():
        pooled[len(KINDS), y, step] += n
    out = [_threshold(counts, kind, precision, least) for kind in range(len(KINDS))]
    common = _threshold(pooled, len(KINDS), precision, least)
    common = common if np.isfinite(common) else max(least, float(np.log(precision / (1 - precision))))
    return [x if np.isfinite(x) else common for x in out]


def _threshold(counts: dict[tuple[int, int, int], int], kind: int, precision: float, least: float) -> float:
    best, right, wrong = np.inf, 0, 0
    for step in range(_bin(MOST), _bin(least) - 1, -1):
        here = counts.get((kind, 1, step), 0)
        right, wrong = right + here, wrong + counts.get((kind, 0, step), 0)
        if here and right >= precision * (right + wrong):
            best = max(least, LEAST + step * STEP)
    return float(best)


def held_out(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(4)) == 0


#: What texts that hold a kind's base spans have at least, for the sample.
MARKS = (r"[A-Za-z0-9]@[A-Za-z0-9]", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"([0-9][\x20-]?){15}[0-9]", r"\+[0-9]", r"[0-9@]")


def sample_texts(docs: DataFrame, most: int, longest: int) -> list[str]:
    """At most about ``most`` different texts of at most ``longest`` bytes that aren't held out: a fifth
    for each of the marks, by a digest of text."""
    texts = docs.select("text").filter((F.octet_length("text") <= longest) & ~held_out(F.col("text")) & F.col("text").rlike(MARKS[-1]))
    each, at = most // len(MARKS), F.pmod(F.shiftright(F.xxhash64("text"), 2), F.lit(1_000_000))
    n = texts.agg(*[F.count_if(F.col("text").rlike(m)).alias(f"n{k}") for k, m in enumerate(MARKS)]).first()
    drawn = [F.col("text").rlike(m) & (at < 950_000 * each / max(1, n[k])) for k, m in enumerate(MARKS)]
    mark = F.coalesce(*[F.when(d, F.lit(k)) for k, d in enumerate(drawn)])
    return sorted({r["text"] for r in texts.filter(mark.isNotNull()).distinct().orderBy(F.xxhash64("text")).limit(most).toLocalIterator()})


def calibrated(docs: DataFrame, trees: Trees, precision: float) -> list[float]:
    """Thresholds from the examples of all held-out texts; a few thousand counts reach the driver."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, 0):
                found = score_counts(trees, batch.column(0).to_pylist())
                keys = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int32()) for k in keys), pa.array(found.values(), pa.int64())], ["kind", "label", "step", "n"])

    texts = docs.select("text").filter(held_out(F.col("text")) & F.col("text").rlike(MARKS[-1]))
    counts = texts.mapInArrow(of, "kind int, label int, step int, n long").groupBy("kind", "label", "step").agg(F.sum("n").alias("n")).collect()
    return thresholds({(r["kind"], r["label"], r["step"]): r["n"] for r in counts}, precision)


def fit(docs: DataFrame, most: int = 2000, longest: int = 1 << 15, precision: float = 0.98) -> Detector:
    """``most``, ``longest``: bounds, in rows and in bytes of a text, of the sample that the driver trains
    the trees on; thresholds and detection cover all rows and whole texts."""
    trees = train(sample_texts(docs, most, longest))
    return Detector(trees, calibrated(docs, trees, precision) if trees.trees else [np.inf] * len(KINDS))


SPANS = "struct<base:array<struct<kind:int,start:bigint,end:bigint>>,added:array<struct<kind:int,start:bigint,end:bigint>>>"


def find(text: Column, detector: Detector) -> Column:
    """Struct of base and added spans (kind, start, end), both by kind and start, of a whole text."""

    def of(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            base = base_spans(text or "")
            added = detector.added(text or "", base)
            out.append({"base": _named(base), "added": _named(added)})
        span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.array(out, pa.struct([("base", span), ("added", span)]))

    return F.arrow_udf(of, SPANS)(text)


def _named(spans: list[tuple[int, int, int]]) -> list[dict[str, int]]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, text, base, spans.

    base: spans of the base patterns; spans: these and the added ones, by kind and start. Null
    counts as empty and has none. Repeated rows are returned as often as they come; other columns
    are ignored. An empty table, or one without base spans, adds nothing.
    """
    found = docs.select("doc_id", "text", find(F.col("text"), detector or fit(docs)).alias("f"))
    return found.select("doc_id", "text", F.col("f.base").alias("base"), F.sort_array(F.concat("f.base", "f.added")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets."""

    def of(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts.to_pylist(), found.to_pylist(), strict=True):
            end = len(text or "")
            for s in sorted(spans or [], key=lambda s: -s["start"]):
                if s["end"] <= end:
                    text, end = f"{text[: s['start']]}[{KINDS[s['kind']].upper()}]{text[s['end'] :]}", s["start"]
            out.append(text)
        return pa.array(out, pa.string())

    return F.arrow_udf(of, "string")(text, spans)
