"""Secret scans: base patterns plus sliding-window Shannon entropy per character class.

The base rules find assignments, access keys and hex strings. Beside them, candidate strings
(runs of key characters) are cut into their character classes' runs (hex digits, base-64 signs);
a window slides over each run, the window's character counts are kept up by one increment and one
decrement a step, and the entropy follows from the running sum of n log n. A run whose best window
reaches its class's threshold is a span, unless the allow list names it. What base spans cover of a
candidate is cut out first, and what hex runs cover of it before the runs of the next class.

Positions are code points. Defined results: a null text is empty (no spans); repeated rows give
repeated rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "entropy")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
ASSIGN = re.compile(rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Class: characters, window, least entropy in bits, whether letters and digits must both occur.
CLASSES = {
    "hex": (re.compile(r"[0-9A-Fa-f]{20,}"), 20, 3.0),
    "base64": (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.9),
}
#: Strings that look random but are public: dashed identifiers, digests named as such, placeholders.
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"(?:sha(?:1|256|384|512)|md5)[-_=].*", re.I),
    re.compile(r".*(?:example|placeholder|xxxx|0123456789|abcdefgh).*", re.I),
)
_JOINTS = frozenset("+/_=-")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")


def best_entropy(run: str, window: int) -> float:
    """The largest Shannon entropy in bits over the windows of ``run``, by incremental counts."""
    n = min(window, len(run))
    counts: dict[str, int] = {}
    weighted = 0.0  # sum of c log2 c

    def log(c: int) -> float:
        return c * math.log2(c) if c > 1 else 0.0

    best = math.inf
    for i, char in enumerate(run):
        c = counts.get(char, 0)
        weighted += log(c + 1) - log(c)
        counts[char] = c + 1
        if i >= n:
            old = run[i - n]
            c = counts[old]
            weighted += log(c - 1) - log(c)
            counts[old] = c - 1
        if i >= n - 1:
            best = min(best, weighted)
    return math.log2(n) - best / n if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by kind as listed."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    found.sort(key=lambda s: (s[0], s[2]))
    return [(a, b, KINDS[k]) for a, b, k in found]


def _without(start: int, end: int, holes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What sorted, disjoint ``holes`` leave of a stretch."""
    out = []
    for a, b in holes:
        if a > start:
            out.append((start, min(a, end)))
        start = max(start, b)
    if start < end:
        out.append((start, end))
    return out


def entropy_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that the entropy rules add to ``base`` (sorted); both are walked once from left to right."""
    taken: list[tuple[int, int]] = []  # what base spans cover, disjoint
    for a, b, _ in base:
        if taken and a <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    out, first = [], 0
    for candidate in CANDIDATE.finditer(text):
        start, end = candidate.span()
        while first < len(taken) and taken[first][1] <= start:
            first += 1
        whole = candidate[0]
        if _DIGIT.search(whole) is None or _LETTER.search(whole) is None or any(a.fullmatch(whole) for a in ALLOW):
            continue
        last = first
        while last < len(taken) and taken[last][0] < end:
            last += 1
        free = _without(start, end, taken[first:last])
        for characters, window, least in CLASSES.values():
            rest = []
            for a, b in free:
                if (a, b) != (start, end):  # signs that joined it with what was cut out
                    while a < b and text[a] in _JOINTS:
                        a += 1
                    while b > a and text[b - 1] in _JOINTS:
                        b -= 1
                found = [
                    m.span()
                    for m in characters.finditer(text, a, b)
                    if _DIGIT.search(m[0]) and _LETTER.search(m[0]) and best_entropy(m[0], window) >= least and not any(x.fullmatch(m[0]) for x in ALLOW)
                ]
                out += [(x, y, "entropy") for x, y in found]
                rest += _without(a, b, found)
            free = rest
    out.sort()
    return out


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text, base and added, by start, then by kind."""
    if not text:
        return []
    base = base_spans(text)
    return sorted([*base, *entropy_spans(text, base)], key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """``text`` with each stretch of spans replaced by one mark."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, spans``: an array of (start, end, kind, value) for every row."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                content = value.as_py()
                rows.append([{"start": a, "end": b, "kind": k, "value": content[a:b]} for a, b, k in scan(content)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=[key, "spans"])

    span = T.StructType(
        [T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]
    )
    return docs.select(key, text).mapInArrow(run, T.StructType([docs.schema[key], T.StructField("spans", T.ArrayType(span))]))


def redact_secrets(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by a mark, and ``n_chars`` (if given) brought in line."""
    names = docs.columns
    at, size_at = names.index(text), names.index(n_chars) if n_chars in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = columns[at].to_pylist()
            found = {i: s for i, t in enumerate(texts) if (s := scan(t))}
            if found:
                sizes = columns[size_at].to_pylist() if size_at is not None else None
                for i, spans in found.items():
                    texts[i] = redact(texts[i], spans)
                    if sizes is not None:
                        sizes[i] = len(texts[i])
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                if sizes is not None:
                    columns[size_at] = pa.array(sizes, batch.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # mapInArrow does not take names with dots
    return plain.mapInArrow(run, plain.schema).toDF(*names)
