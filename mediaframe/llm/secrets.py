"""Secrets in texts: one combined automaton scans the bytes of every text once for all rules.

Defined cases: null and empty texts have no spans; spans are in code points, end exclusive; equal texts
and repeated rows get equal results, one row each; an empty table gives an empty result. A text of any
length is scanned whole, in memory of its own size.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import Scanner
from .common import bytes_of, field, map_texts

BASE = ("assign", "access", "hex")
#: (kind, pattern, letters in either case). Base kinds first, in the order they are listed.
RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True),
    ("access", r"AKIA[A-Z0-9]+", False),
    ("hex", r"[0-9a-f]{24,}", False),
    ("forge", r"gh[pousr]_[A-Za-z0-9]+", False),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]+", False),
    ("webtoken", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False),
]
LEAST_VALUE = 6
#: Least bytes of a whole match, checked after the scan: a counter for each rule in the automaton would
#: multiply its states. Only hex digits are counted inside it, as ordinary letters would end a match there.
LEAST = {"access": 20, "forge": 34, "chat": 15, "webtoken": 30}


def kept(kind: str, match: bytes) -> bool:
    """False for a match that is too short, or an assignment whose value is under six characters."""
    if kind != "assign":
        return len(match) >= LEAST.get(kind, 0)
    sign = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    return len(match[sign + 1 :].lstrip(b" ").lstrip(b"\"'")) >= LEAST_VALUE


def spans(runner, data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then in the order of the rules."""
    found = sorted((s, r, e) for s, e, r in runner.scan(data) if kept(runner.kinds[r], data[s:e]))
    if not found:
        return []
    out, at, points = [], 0, 0
    plain = data.isascii()
    for s, r, e in found:
        points = s if plain else points + len(data[at:s].decode("utf-8", "replace"))
        at = s
        out.append((runner.kinds[r], points, points + e - s))
    return out


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[tuple[str, str, bool]] = RULES) -> DataFrame:
    """(id, spans): every text's secrets as kind:start:end joined by commas; one row per row."""
    scanner = Scanner(rules)

    def make():
        runner = scanner.compiled()

        def work(part: pa.RecordBatch) -> dict:
            return {"spans": [joined(spans(runner, b)) for b in bytes_of(part, 1)]}

        return work

    return map_texts(docs, id_col, text_col, make, [field("spans", "string")])


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts and hash of the base spans, all spans)."""
    scanner = Scanner(RULES)

    def make():
        runner = scanner.compiled()

        def work(part: pa.RecordBatch) -> dict:
            rows = [spans(runner, b) for b in bytes_of(part, 1)]
            base = [[x for x in row if x[0] in BASE] for row in rows]
            out = {f"n_{k}": [sum(x[0] == k for x in row) for row in base] for k in BASE}
            out["base_sha256"] = [hashlib.sha256(joined(row).encode()).hexdigest() for row in base]
            out["spans"] = [joined(row) for row in rows]
            return out

        return work

    fields = [field(f"n_{k}", "bigint") for k in BASE] + [field("base_sha256", "string"), field("spans", "string")]
    return map_texts(docs, id_col, text_col, make, fields)
