"""Secret scans with multipart credential linking (operator 1).

Single patterns find what is a secret by its own form.  Many credentials are not: a user name,
a bare random string and a host mean little alone and give access together.  The operator
therefore collects *parts* (access identifiers, secrets, endpoints) of every text, and joins
them on overlapping intervals inside a *scope* (a paragraph: text between blank lines).  A weak
part is reported only when complementary parts stand within ``reach`` characters of it.

Defined results: a null or empty text has no findings; a text of any length is scanned whole;
repeated rows each get their own result; other columns of the input pass through unchanged.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .io import table

# The three base patterns and their smallest lengths.
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
BASE_KINDS = ("assign", "access", "hex")

#: Words without which ASSIGN can't match; looking for them is much faster than matching.
_ASSIGN_HINT = ("passw", "secret", "token", "key")

# Weak parts: each means nothing alone.
IDENTITY = re.compile(r"(?i:\b(?:user(?:name)?|login|client_?id|account|access_?key_?id))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]{3,})", re.ASCII)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"(?:[a-z][a-z0-9+]{1,12}://[^\s\"'<>]{4,}|(?i:\b(?:host|server|endpoint|url)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9.-]{4,}))")
_IDENTITY_HINT = ("user", "login", "client", "account", "access")
_ENDPOINT_HINT = ("://", "host", "server", "endpoint", "url")
_HAS_DIGIT = re.compile(r"[0-9]")

LINKED_KINDS = ("identity", "opaque", "endpoint", "short")
KIND_ORDER = {k: i for i, k in enumerate(BASE_KINDS + LINKED_KINDS)}
ROLE = {"assign": "secret", "hex": "secret", "opaque": "secret", "short": "secret", "access": "identity", "identity": "identity", "endpoint": "endpoint"}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base findings, by start and then kind."""
    found = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINT):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if _HAS_DIGIT.search(text) or re.search("[a-f]{16}", text):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KIND_ORDER[s[2]]))


def weak_parts(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower()
    if any(h in low for h in _IDENTITY_HINT):
        found += [(m.start(1), m.end(1), "identity") for m in IDENTITY.finditer(text)]
    if any(h in low for h in _ENDPOINT_HINT):
        found += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    if any(h in low for h in _ASSIGN_HINT):
        found += [(m.start(), m.end(), "short") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) < ASSIGN_LEAST]
    if _HAS_DIGIT.search(text):
        found += [(m.start(), m.end(), "opaque") for m in OPAQUE.finditer(text)]
    return found


class Intervals:
    """Distinct spans ordered by start, with the two furthest ends of every prefix.

    The join of one interval with all of them is two lookups: the spans that start early enough
    are a prefix, and one of them reaches far enough if the furthest end does.
    """

    def __init__(self, spans):
        self.spans = sorted(set(spans))
        self.starts = [s for s, _ in self.spans]
        self.furthest = []  # (end, span) and the same of all other spans
        one = two = (float("-inf"), None)
        for span in self.spans:
            here = (span[1], span)
            if here[0] > one[0]:
                one, two = here, one
            elif here[0] > two[0]:
                two = here
            self.furthest.append((one, two))

    def meets(self, start: int, end: int, but: tuple[int, int] | None = None) -> bool:
        """Whether a span other than ``but`` shares a point with [start, end]."""
        n = bisect_right(self.starts, end)
        if not n:
            return False
        one, two = self.furthest[n - 1]
        return (two if one[1] == but else one)[0] >= start


def linked_spans(text: str, base: list[tuple[int, int, str]], reach: int) -> list[tuple[int, int, str]]:
    """Weak parts that a complementary part makes a credential.

    Interval join inside a scope: each part's interval, widened by ``reach``, is joined with the
    intervals of the parts of other roles.  A weak identity needs a secret, a weak secret
    needs an identity, and an endpoint needs both.  Parts are sorted once and each join is a binary
    search, so a text with many parts costs n log n.  A weak part that overlaps a base span is none,
    but for endpoints, which may hold one.
    """
    weak = weak_parts(text)
    if not weak:
        return []
    taken = Intervals((s, e) for s, e, _ in base)
    weak = [w for w in weak if w[2] == "endpoint" or not taken.meets(w[0] + 1, w[1] - 1)]
    breaks = [m.start() for m in re.finditer(r"\n[ \t]*\n", text)]
    parts: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for s, e, kind in base + weak:
        parts.setdefault((ROLE[kind], bisect_left(breaks, s)), []).append((s, e))
    scopes = {k: Intervals(v) for k, v in parts.items()}

    def beside(span, role) -> bool:
        near = scopes.get((role, bisect_left(breaks, span[0])))
        return near is not None and near.meets(span[0] - reach, span[1] + reach, (span[0], span[1]))

    needs = {"identity": ("secret",), "opaque": ("identity",), "short": ("identity",), "endpoint": ("identity", "secret")}
    return [w for w in weak if all(beside(w, role) for role in needs[w[2]])]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


FINDINGS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType())]))


def find_secrets(df: DataFrame, text: str = "text", out: str = "findings", reach: int = 200) -> DataFrame:
    """``df`` with ``out``: all findings of ``text`` as structs (kind, start, end, value).

    Kinds ``assign``, ``access`` and ``hex`` stand alone; ``identity``, ``opaque``, ``endpoint``
    and ``short`` (an assigned value too short for ``assign``) are weak parts that complementary parts within ``reach`` code points of the
    same paragraph confirm.  Positions are code points, the end is exclusive.
    """

    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, FINDINGS)])

    def scan(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for batch in batches:
            found = []
            for value in batch.column(text):
                t = value.as_py() or ""
                base = base_spans(t)
                every = sorted(base + linked_spans(t, base, reach), key=lambda s: (s[0], KIND_ORDER[s[2]], s[1]))
                found.append([{"kind": k, "start": s, "end": e, "value": t[s:e]} for s, e, k in every])
            keep = [i for i, n in enumerate(batch.schema.names) if n != out]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(found, kind)], names=[batch.schema.names[i] for i in keep] + [out])

    return df.mapInArrow(scan, schema)


def redact(df: DataFrame, text: str = "text", findings: str = "findings", mask: str = "[secret]") -> DataFrame:
    """``df`` with every found span of ``text`` replaced by ``mask`` (overlaps count as one span)."""

    def cut(batches):
        for batch in batches:
            texts = []
            for t, spans in zip(batch.column(text).to_pylist(), batch.column(findings).to_pylist(), strict=True):
                if t and spans:
                    at, parts = 0, []
                    for x in sorted(spans, key=lambda x: (x["start"], x["end"])):
                        if x["start"] >= at:
                            parts += [t[at : x["start"]], mask]
                        at = max(at, x["end"])
                    t = "".join(parts) + t[at:]
                texts.append(t)
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(texts, pa.string()))

    return df.mapInArrow(cut, df.schema)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of all findings of every document."""
    docs = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    listed = lambda found: F.array_join(F.transform(found, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    base = F.filter("findings", lambda x: x.kind.isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("findings", lambda x: x.kind == kind)).cast("long")
    return docs.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("findings")).alias("spans"),
        F.size(F.filter("findings", lambda x: ~x.kind.isin(*BASE_KINDS))).cast("long").alias("n_linked"),
    )
