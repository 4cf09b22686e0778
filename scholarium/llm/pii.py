"""Personal data by candidate gradient boosting.

Generators with high recall propose spans, which may overlap; those that pass the base checks are kept whatever a model
says. The rest, looser forms such as `name (at) host dot com`, cards with dots, numbers without a plus sign or quoted
credentials, are judged by boosted trees on format and context, and of overlapping ones the likeliest stays.

The trees learn from all documents; lessons that are alike are one row with their number as its weight, so that rows grow much
slower than documents. Lessons of label 1 are base spans in looser forms, at their own
places (of credentials: values quoted behind a name for one). Lessons of label 0 are what the checks refuse, and hard
negatives: forms that look alike but are none, as versions, ISBNs, dates, order numbers, checksums or `look at x.com`,
with the words that come before them, at places in the same documents. The quarter of the documents that the trees do not see
sets each kind's threshold, as the least probability (of GRID steps) whose precision there is high; a kind without both labels
there adds nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from hashlib import md5
from itertools import groupby
from math import isqrt

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarium.llm.frames import materialise

#: Kinds with base checks, and those that only the model finds.
KINDS = ["email", "ip", "card", "phone"]
ALL_KINDS = [*KINDS, "secret"]
#: Of a threshold: precision, lessons of each label, and steps of the probability.
PRECISION, SUPPORT, GRID = 0.98, 20, 10_000
#: Different lessons that a task counts before it sends them, and those of a partition of the fit.
COUNTED, LESSONS = 20_000, 50_000
#: Cut points of a feature. MLlib chooses them from max(10,000, bins squared) rows, so that more rows get more bins.
BINS, BINS_FOR = 64, 10_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Looser forms. An address is looked for from its `at`, so that the text before it costs nothing.
_AT = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}) ?| at | @ | @|@ ", re.I)
_DOTTED = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot | \. |\.)[A-Za-z0-9-]{2,63})+(?![\w-])", re.I)
_NAME = re.compile(r"[\w.+-]{1,64}\Z")
_FIRST_AT = re.compile(r"\bat\b|@")
_LOOSE = [
    (1, re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?: ?\[\.\] ?| ?\(\.\) ?| ?[\[(]dot[\])] ?| dot | \. )[0-9]{1,3}){3}(?![\w])", re.I)),
    (2, re.compile(r"(?<![\w.,-])[0-9]{4}(?: ?[._/] ?|  | - )[0-9]{4,6}(?:(?: ?[._/] ?|  | - )[0-9]{3,5}){1,3}(?![\w])")),
    (3, re.compile(r"(?<![\w+.-])00[1-9][0-9 ().-]{7,20}[0-9](?![\w])")),
    (3, re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])")),
    (4, re.compile(r"(?<=[\"'])[A-Za-z0-9_+/=-]{16,200}(?=[\"'])")),
    (4, re.compile(r"(?<![\w+/=-])(?=[A-Za-z_+/=-]*[0-9])[A-Za-z0-9_+/=-]{24,200}(?![\w+/=-])")),
]
# Words that announce such data, words that announce something else, and names of credentials.
_CUES = re.compile(r"(?i)(?:\b(?:e-?mail|mail|contact|write|reach|tel|phone|fon|call|mobile|fax|card|visa|credit|pay|account|ip|host|server|address|ping|from)\b)[^.]{0,24}\Z")
_OTHERS = re.compile(r"(?i)(?:\b(?:isbn|order|part|invoice|serial|version|section|chapter|pages?|sku|article|item|no|sha\d*|md5|checksum|commit|hash|uuid|digest|build|ref|tracking|look|see|buy|visit|hosted|arrive|meet|sold|date|price)\b)[^.]{0,12}\Z")
_CREDENTIAL = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|credential)s?[\"']?\s*[=:]\s*[\"']?\Z")
_SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?\s*[=:]\s*([\"'])([A-Za-z0-9_+/=-]{16,200})\1")
# Hard negatives of each kind, as (words before, form); # is a digit, h a hexadecimal one.
_HARD = {
    0: [("look ", "at example.com"), ("please see ", "at news.org"), ("to buy ", "at shop dot com"), ("is hosted ", "at server.net"), ("we arrive ", "at noon dot then"), ("it lay ", "at home.Then it"), ("all ", "@ home . today"), ("we meet ", "at ###.## today"), ("was sold ", "at #.## each")],
    1: [("version ", "## . # . # . ###"), ("section ", "# . ## . # . #"), ("build ", "#[.]#[.]##[.]###"), ("chapter ", "# dot # dot # dot ##"), ("article ", "## . ## . ## . ##")],
    2: [("tracking ", "####.####.####.####"), ("serial ", "####/####/####/####"), ("part no ", "####_####_####_###"), ("ref ", "#### - #### - #### - ####"), ("order ", "####.######.#####")],
    3: [("ISBN ", "###-###-####"), ("order no ", "###-###-####"), ("part ", "###.###.####"), ("invoice ", "00##########"), ("serial ", "00### ### ### ###"), ("pages ", "### ### ####"), ("sku ", "###.###.####"), ("item ", "00#.###.####")],
    4: [("commit ", "hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh"), ("md5: ", "hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh"), ("uuid ", "hhhhhhhh-hhhh-hhhh-hhhh-hhhhhhhhhhhh"), ("sha256 = '", "hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh"), ("build ref ", "release_####-##-##_hhhhhhhhhhhh"), ("the checksum is '", "hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh")],
}
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(double[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, driven by the @ signs so that long runs of letters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        if at >= done:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            host = _HOST.match(text, at) if start < at else None
            if host:
                yield start, host.end()
                done = host.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the proposals that pass the base checks, and of those that don't."""
    good, refused = [(s, 0, e) for s, e in _emails(text)], []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))
            (good if ok else refused).append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub("[ -]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                good.append((m.start(), 2, m.end()))
            elif 12 <= len(digits) <= 24:
                refused.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            (good if 10 <= sum(c.isascii() and c.isdigit() for c in m.group()) <= 15 else refused).append((m.start(), 3, m.end()))
    return sorted(good), refused


def _before_at(low: str) -> str:
    """What comes before the first @ or `at`, without what is no letter or digit at its end."""
    m = _FIRST_AT.search(low)
    end = m.start() if m else len(low)
    while m and end and not (low[end - 1].isalnum() or low[end - 1] == "_"):
        end -= 1
    return low[:end]


def _features(kind: int, span: str, before: str, after: str) -> list[float]:
    digits, low = [c for c in span if c.isascii() and c.isdigit()], span.lower()
    local = _before_at(low)
    groups = re.findall(r"[0-9]+", span)
    return [
        float(kind), float(len(span)), len(digits) / len(span), float(sum(c in " -.()" for c in span)), float(span.count("(") + span.count("[")), float("@" in span), float(" at " in low), float("dot" in low),
        float(len(local)), float(any(c in "0123456789._+" for c in local)), float(span.startswith("+")), float(span.startswith("00")), float(len(re.split(r"[^a-z]+", low)[-1])),
        float(max(map(len, groups), default=0)), float(max((int(g[:6]) for g in groups), default=0) if kind == 1 else 0), float(len(digits)), float(kind == 2 and luhn("".join(digits))), float(len(set(low))), float(bool(re.search("[g-z]", low))),
        float(bool(_CUES.search(before))), float(bool(_OTHERS.search(before))), float(bool(_CREDENTIAL.search(before))), float(before[-1:].isalnum()), float(before[-1:] in "\"'=/#"), float(after[:1].isalnum()), float(after[:1] in "\"'/%"),
    ]


def _looser(kind: int, span: str) -> list[str]:
    """A base span in looser forms."""
    if kind == 0:
        return [span.replace("@", " at ").replace(".", " dot "), span.replace("@", " (at) ").replace(".", " (dot) "), span.replace("@", "[at]"), span.replace("@", " @ ").replace(".", " . ")]
    if kind == 1:
        return [span.replace(".", "[.]"), span.replace(".", " dot "), span.replace(".", " . "), span.replace(".", "(.)")]
    if kind == 2:
        d = re.sub("[ -]", "", span)
        return [mark.join([d[:4], d[4:8], d[8:12], d[12:]]) for mark in (".", "/", "_", " - ")]
    return [*(["00" + span[1:]] if span[1:2] != "0" else []), *([re.sub(r"^\+[0-9]{1,3}[ .-]", "", span)] * 2 if re.match(r"\+[0-9]{1,3}[ .-]\(?[0-9]{3}", span) else [])]


def _filled(form: str, seed: str) -> str:
    """The form with digits from a hash of the seed."""
    noise = iter(md5(seed.encode()).hexdigest() * 4)
    return "".join(str(int(next(noise), 16) % 10) if c == "#" else next(noise) if c == "h" and set(form) & {"h"} and form.count("h") > 3 else c for c in form)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all looser forms; they may overlap."""
    out = set()
    for m in _AT.finditer(text):
        host = _DOTTED.match(text, m.end())
        name = _NAME.search(text, max(0, m.start() - 64), m.start()) if host else None
        if name and name.end() == m.start():
            out.add((name.start(), 0, host.end()))
            inner = re.match(r"[A-Za-z0-9-]{1,63}(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot |\.)[A-Za-z]{2,24})+", host.group(), re.I)
            if inner and inner.end() < len(host.group()):
                out.add((name.start(), 0, m.end() + inner.end()))
    if _DIGIT.search(text):
        for kind, pattern in _LOOSE:
            for m in pattern.finditer(text):
                digits = sum(c.isascii() and c.isdigit() for c in m.group())
                if kind != 2 or 14 <= digits <= 19:
                    out.add((m.start(), kind, m.end()))
    return sorted(out)


def merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that sorted spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for s, _, e in spans:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def covered(stretches: tuple[list[int], list[int]], start: int, end: int) -> bool:
    """Whether a span meets one of the stretches."""
    at = bisect_right(stretches[0], start)
    return (at > 0 and stretches[1][at - 1] > start) or (at < len(stretches[0]) and stretches[0][at] < end)


def _lessons(text: str, good: list[tuple[int, int, int]], refused: list[tuple[int, int, int]]) -> Iterator[tuple[float, list[float]]]:
    """(label, features) of the lessons of a text."""
    around = lambda s, e: (text[max(0, s - 40) : s], text[e : e + 10])
    yield from ((0.0, _features(k, text[s:e], *around(s, e))) for s, k, e in refused)
    found = good + [(m.start(2), 4, m.end(2)) for m in _SECRET.finditer(text)]
    for s, k, e in found:
        before, after = around(s, e)
        for form in [text[s:e]] if k == 4 else _looser(k, text[s:e]):
            yield 1.0, _features(k, form, before, after)
        for i, (words, form) in enumerate(_HARD[k]):
            seed = f"{s}:{i}:{text[s:e]}"
            at = int(md5(seed.encode()).hexdigest()[:8], 16) % len(text)
            filled = _filled(form, seed)
            if k == 0:
                words, filled = "", words + filled
            yield 0.0, _features(k, filled, text[max(0, at - 40) : at] + " " + words, " " + text[at : at + 9])


_SPAN = "array<struct<start:int,kind:int,end:int>>"
_ROWS = f"doc_id long, base {_SPAN}, loose {_SPAN}, features array<array<double>>"
_LESSONS = "kept_out boolean, label double, features array<double>, n long"


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        out = []
        for text in batch.column(1):
            text = text.as_py() or ""
            good, refused = base_spans(text)
            taken = merged(good)
            loose = sorted({x for x in proposals(text) + refused if not covered(taken, x[0], x[2])})
            features = [_features(k, text[s:e], text[max(0, s - 40) : s], text[e : e + 10]) for s, k, e in loose]
            named = lambda spans: [dict(zip(("start", "kind", "end"), x, strict=True)) for x in spans]
            out.append((named(good), named(loose), features))
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        kinds = (span, span, pa.list_(pa.list_(pa.float64())))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "base", "loose", "features"])


def _teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (kept_out, text) as lessons with their number."""
    counts: Counter = Counter()

    def counted() -> pa.RecordBatch:
        kept_out, label, features = zip(*counts, strict=True)
        kinds = (pa.bool_(), pa.float64(), pa.list_(pa.float64()), pa.int64())
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((kept_out, label, features, list(counts.values())), kinds, strict=True)], names=["kept_out", "label", "features", "n"])
        counts.clear()
        return out

    for batch in batches:
        for kept_out, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            for label, features in _lessons(text, *base_spans(text)):
                counts[kept_out, label, tuple(features)] += 1
                if len(counts) >= COUNTED:
                    yield counted()
    if counts:
        yield counted()


def _likeliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the spans (loose, p) of each row those that meet none likelier (then longer, then earlier)."""
    for batch in batches:
        out = []
        for spans, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            stretches: tuple[list[int], list[int]] = ([], [])
            done = []
            for span, _ in sorted(zip(spans, p, strict=True), key=lambda x: (-x[1], x[0]["start"] - x[0]["end"], x[0]["start"], x[0]["kind"])):
                if not covered(stretches, span["start"], span["end"]):
                    at = bisect_right(stretches[0], span["start"])
                    stretches[0].insert(at, span["start"])
                    stretches[1].insert(at, span["end"])
                    done.append(span)
            out.append(done)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["row", "added"])


def _thresholds(model, checked: DataFrame) -> dict[int, int]:
    """Per kind with both labels among the kept-out lessons (kind, label, n, features) the least step of the probability from
    which on they are right often enough. The driver gets a row a kind and step at most."""
    step = F.floor(vector_to_array("probability")[1] * GRID).alias("step")
    right = F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("right")
    steps = model.transform(checked).groupBy("kind", step).agg(right, F.sum("n").alias("n")).orderBy("kind", F.desc("step")).collect()
    out = {}
    for kind, of_kind in groupby(steps, lambda r: r["kind"]):
        part = list(of_kind)
        positive, total, n, sum_right = sum(r["right"] for r in part), sum(r["n"] for r in part), 0, 0
        if min(positive, total - positive) < SUPPORT:
            continue
        for r in part:
            n, sum_right = n + r["n"], sum_right + r["right"]
            if sum_right >= max(SUPPORT, PRECISION * n):
                out[kind] = max(GRID // 2, r["step"])
    return out


def lessons_of(docs: DataFrame) -> DataFrame:
    """(kept_out, label, features, n): how often each lesson comes in docs (doc_id, text), in all of them."""
    kept_out = (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 0).alias("kept_out")
    taught = docs.select(kept_out, "text").mapInArrow(_teach, _LESSONS)
    return taught.groupBy("kept_out", "label", "features").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame):
    """The trees and each kind's threshold, from the lessons of docs (doc_id, text); None and no thresholds where lessons are
    too few."""
    counted = materialise(lessons_of(docs))
    counts = {(r.kept_out, r.label): r for r in counted.groupBy("kept_out", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()}
    if not all((k, v) in counts and counts[k, v].n >= SUPPORT for k in (True, False) for v in (0.0, 1.0)):
        return None, {}
    rows = sum(r.rows for r in counts.values())
    ordered = counted.coalesce(max(2, -(-rows // LESSONS))).sortWithinPartitions("features", "label", "kept_out")
    kind, n = F.get("features", F.lit(0)).cast("int").alias("kind"), F.col("n").cast("double").alias("weight")
    lessons = ordered.select("kept_out", "label", kind, "n", n, array_to_vector("features").alias("features")).persist()
    bins = BINS if rows <= BINS_FOR else max(BINS, isqrt(rows) + 1)
    model = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.3, seed=7, maxBins=bins, weightCol="weight").fit(lessons.where("not kept_out"))
    limits = _thresholds(model, lessons.where("kept_out"))
    lessons.unpersist()
    return model, limits


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind, end) in code points, ordered by start, then kind as in ALL_KINDS.

    spans holds base and what the model adds; what it adds overlaps nothing of base, nor each other. A null text is empty.
    A very long text takes time in proportion. Rows without doc_id are left out; repeated rows are answered one by one.
    Without enough lessons of both labels a kind adds nothing. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    model, limits = learn(docs)
    rows = materialise(docs.mapInArrow(_propose, _ROWS).withColumn("row", F.monotonically_increasing_id()))
    if not limits:
        return rows.select("doc_id", "base", F.col("base").alias("spans"))
    asked = rows.where(F.size("loose") > 0).select("row", F.explode(F.arrays_zip("loose", "features")).alias("c"))
    judged = model.transform(asked.select("row", "c.loose", array_to_vector("c.features").alias("features"))).select("row", "loose", vector_to_array("probability")[1].alias("p"))
    limit = F.coalesce(*[F.when(F.col("loose.kind") == k, F.lit(v)) for k, v in limits.items()], F.lit(2 * GRID))
    found = judged.where(F.floor(F.col("p") * GRID) >= limit).groupBy("row").agg(F.collect_list("loose").alias("loose"), F.collect_list("p").alias("p"))
    added = found.mapInArrow(_likeliest, f"row long, added {_SPAN}")
    return rows.select("row", "doc_id", "base").join(added, "row", "left").select("doc_id", "base", F.sort_array(F.concat("base", F.coalesce("added", F.array().cast(_SPAN)))).alias("spans"))


def as_text(spans: str):
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text, spans):
    """text with every span replaced by its kind in brackets; of overlapping spans the first stays, of an overlapping one only the rest goes."""
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.get(kinds, s["kind"]))).otherwise(a["out"]).alias("out"))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))).otherwise(text)
