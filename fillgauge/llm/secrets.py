"""Secret scan with multipart credential linking.

Three kinds are reported by themselves: assignments of a long value to a name
like ``password``, access identifiers, and long runs of hexadecimal digits.

Others are weak: the parts of a credential that prove nothing alone. They are

* ``id``: an access identifier too short or too odd for the rule above, or a
  client id given as such;
* ``key``: forty characters of base64 that mix cases and digits, as secret keys do;
* ``host``: the address of a service with user information, or an API endpoint; of a
  scheme the last 32 signs count.

A weak part is reported only when a complementary part lies in the same scope:
an identifier with a key, a key with an identifier or an endpoint, an endpoint
with a key. The parts of a scope that are spans already found count as
identifiers (``access``) or keys (``assign``, ``hex``). A scope is an interval of
``SCOPE`` code points around the part, within one document. The interval join
keeps, for each class of parts, the sorted starts and ends, so a part finds its
complement by bisection; no pairs are formed, however many parts a text holds.

A document is a scope of its own, so texts are scanned where they are: nothing is
shuffled and no key can be hot. Results in special cases: a null or empty text has
no spans; overlapping spans of different kinds all stay; repeated rows and null
ids stay; other columns are not carried by ``scan``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillgauge.llm import common

#: Code points on either side of a weak part in which its complement counts.
SCOPE = 400

# The patterns of the kinds reported by themselves, and their least lengths.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "id", "key", "host")
BASE = KINDS[:3]

WEAK_ID = re.compile(r"""\b(?:A[KS]IA[A-Z0-9]{8,}|(?i:client_id|access_key_id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._-]{6,})""", re.ASCII)
WEAK_KEY = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
#: Addresses are looked for from their ``://`` on: a scheme of bounded length before it, then user information or an endpoint.
SCHEME = re.compile(r"[a-z][a-z0-9+.-]*\Z", re.ASCII)
SCHEME_CHARS = 32
TO_STOP, TO_HOST_END = re.compile(r"""[^\s/@"']*""", re.ASCII), re.compile(r"""[^\s/"']+""", re.ASCII)
WEB = re.compile(r"https?\Z")
ENDPOINT = re.compile(r"""(?:api|auth|login|s3)[.-][^\s/"']+""", re.ASCII)
#: What completes a weak part, by kind.
COMPLEMENTS = {"id": ("key", "assign", "hex"), "key": ("id", "access", "host"), "host": ("key", "assign", "hex")}
#: A text without any of these holds no weak part but a key.
MIXED = (re.compile("[A-Z]"), re.compile("[a-z]"), re.compile("[0-9]"))

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Assignments, access identifiers and hexadecimal runs, each kind without overlaps."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    # a run of 16 or more starts where the run starts, so shorter runs need not be looked at
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def hosts(text: str) -> list[tuple[int, int]]:
    """Addresses with user information, and endpoints of services, from left to right without overlaps.

    Each address is walked once, up to its end.
    """
    out, at, done = [], -1, 0
    while (at := text.find("://", at + 1)) >= 0:
        scheme = SCHEME.search(text, max(done, at - SCHEME_CHARS), at)
        if not scheme:
            continue
        start, rest = scheme.start(), None
        user = TO_STOP.match(text, at + 3)
        if text.startswith("@", user.end()) and ":" in user.group()[1:-1]:
            rest = TO_HOST_END.match(text, user.end() + 1)
        if not rest and (web := WEB.search(text, max(done, at - 5), at)):
            start, rest = web.start(), ENDPOINT.match(text, at + 3)
        if rest:
            done = rest.end()
            out.append((start, done))
    return out


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Parts that count only with a complement; those within a span already found are left out."""
    starts = sorted((a, b) for _, a, b in base)
    ends = [a for a, _ in starts]
    reach = []
    for _, b in starts:
        reach.append(max(b, reach[-1] if reach else b))

    def covered(a: int, b: int) -> bool:
        k = bisect_right(ends, a) - 1
        return k >= 0 and reach[k] >= b

    found = [("id", *m.span()) for m in WEAK_ID.finditer(text)]
    found += [("key", *m.span()) for m in WEAK_KEY.finditer(text) if all(p.search(m.group()) for p in MIXED)]
    found += [("host", a, b) for a, b in hosts(text)]
    return [(kind, a, b) for kind, a, b in found if not covered(a, b)]


def linked(weak: list[Span], base: list[Span], scope: int) -> list[Span]:
    """The weak parts with a complementary part within ``scope`` code points."""
    by_kind = {k: sorted((a, b) for kind, a, b in (*weak, *base) if kind == k) for k in KINDS}
    starts = {k: [a for a, _ in spans] for k, spans in by_kind.items()}
    reach: dict[str, list[int]] = {}
    for k, spans in by_kind.items():
        reach[k] = []
        for _, b in spans:
            reach[k].append(max(b, reach[k][-1] if reach[k] else b))

    def near(kind: str, a: int, b: int) -> bool:
        # spans that start before b + scope; does one of them end after a - scope?
        k = bisect_left(starts[kind], b + scope)
        return k > 0 and reach[kind][k - 1] > a - scope

    return [(kind, a, b) for kind, a, b in weak if any(near(other, a, b) for other in COMPLEMENTS[kind])]


def spans_of(text: str, scope: int = SCOPE) -> list[Span]:
    """All spans by start, then kind."""
    base = base_spans(text)
    found = base + linked(weak_spans(text, base), base, scope)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every stretch covered by spans replaced by the first one's kind."""
    out, at = [], 0
    for kind, a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch], scope: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        found = [spans_of(t, scope) for t in texts]
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found]
        clean = [redacted(t, s) if s else None for t, s in zip(texts, found)]
        yield pa.record_batch([batch.column("doc_id"), pa.array(spans, SPANS), pa.array(clean, pa.string())], names=["doc_id", "spans", "redacted"])


KIND = "array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``doc_id, spans, redacted``: the spans of each text, and the text without them (null: as it was).

    Starts and ends count code points; an end is the first one after the span.
    """
    common.prepare(docs.sparkSession)
    rows = common.texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(lambda b: _scan(b, scope), f"doc_id long, spans {KIND}, redacted string")


def redact(docs: DataFrame, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """The documents with their secrets replaced by ``[KIND]``; all rows and columns stay."""

    @F.pandas_udf("string")
    def without(texts):
        return texts.map(lambda t: redacted(t, spans_of(t, scope)) if t else t)

    common.prepare(docs.sparkSession)
    return docs.withColumn(text_col, without(common.column(text_col)))
