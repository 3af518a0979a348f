"""Secret scans with structural confirmation.

Base patterns give spans of kinds assign, access and hex.  Further candidates (PEM armour,
long base64 or hex runs, dotted tokens) are decoded, and reported only if their inner
structure holds: DER lengths that nest exactly, SSH length-prefixed fields, a signed token's
JSON header with an algorithm; of a PEM key under a passphrase the headers, and a body of whole
cipher blocks.  Successive lines are also decoded as one, from the start of
each line and after each separator (``/ + _ -``), and hex with or without ``0x``; a key found so
ends where its lengths say.  Spans count code points, end exclusive.

Nulls: null text counts as empty and gives no spans.  Each row is judged by itself, so
repeated rows, ties and other columns need no care; whole texts are scanned.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from slotgram.llm.common import table

KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----([A-Za-z0-9+/=\s\\]+)-----END \1-----")
#: A key that a passphrase protects: its headers name the cipher and its first block.
SEALED = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----(?:\s|\\[rn])*Proc-Type: 4,ENCRYPTED(?:\s|\\[rn])+DEK-Info: [A-Z0-9-]+,((?:[0-9A-Fa-f]{16}){1,2})(?:\s|\\[rn])+([A-Za-z0-9+/=\s\\]+)-----END \1-----")
RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])(ey[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
BREAK = re.compile(r"(?:\\r)?\\n|[ \t]*\r?\n[ \t]*")
BLOCK = re.compile(rf"[A-Za-z0-9+/_-]{{40,}}(?:(?:{BREAK.pattern})[A-Za-z0-9+/_-]{{40,}})*(?:(?:{BREAK.pattern})[A-Za-z0-9+/_-]+)?={{0,2}}")
#: How DER sequences and SSH keys begin in base64 and in hex.
BEGINS = re.compile(r"M[A-P]|b3BlbnNz|AAAA|(?:0[xX])?(?:30|6[fF]70656[eE]|000000)")
HEX_RUN = re.compile(r"(?:0[xX])?([0-9A-Fa-f]+)")
ALL_HEX = re.compile(r"[0-9A-Fa-f]+")
MAX_DEPTH = 16


def unbase64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_end(data: bytes, at: int, limit: int, depth: int = 0) -> int:
    """End of the DER element at ``at`` if its lengths nest exactly inside ``limit``, else -1."""
    if at + 2 > limit or depth > MAX_DEPTH:
        return -1
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > limit:
            return -1
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    end = at + n
    if end > limit:
        return -1
    if tag & 0x20:
        while at < end:
            at = der_end(data, at, end, depth + 1)
            if at < 0:
                return -1
    return end


def is_der(data: bytes) -> bool:
    """A DER sequence of at least two elements that fills ``data``."""
    if len(data) < 16 or data[0] != 0x30 or der_end(data, 0, len(data)) != len(data):
        return False
    at = 2 + (data[1] & 0x7F if data[1] & 0x80 else 0)
    first = der_end(data, at, len(data))
    return data[at] in (0x02, 0x30, 0x06) and at < first < len(data)


def ssh_fields(data: bytes, at: int, most: int) -> tuple[list[bytes], int]:
    """Up to ``most`` whole length-prefixed fields from ``at`` on, and where they end."""
    found = []
    while len(found) < most and at + 4 <= len(data) and at + 4 + (n := int.from_bytes(data[at : at + 4], "big")) <= len(data):
        found.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return found, at


def is_ssh(data: bytes) -> bool:
    """An OpenSSH private key (names, number of keys, public blobs and private block), or a public
    blob, whose length-prefixed fields fill ``data``."""
    if data.startswith(b"openssh-key-v1\0"):
        head, at = ssh_fields(data, 15, 3)  # cipher, key derivation and its options
        keys = int.from_bytes(data[at : at + 4], "big") if len(head) == 3 else 0
        rest, at = ssh_fields(data, at + 4, keys + 1) if 0 < keys <= 16 else ([], 0)
        return len(rest) == keys + 1 > 1 and at == len(data) and bool(rest[-1]) and all(is_ssh(x) for x in rest[:-1])
    fields, at = ssh_fields(data, 0, 32)
    return at == len(data) and len(fields) >= 2 and fields[0].startswith((b"ssh-", b"ecdsa-sha2-", b"sk-"))


def is_token(header: str, payload: str) -> bool:
    try:
        head, body = json.loads(unbase64(header) or b"x"), unbase64(payload)
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and body is not None


def der_size(data: bytes) -> int:
    """Bytes of the DER sequence that begins ``data``, by its header; else -1."""
    if len(data) < 2 or data[0] != 0x30:
        return -1
    size = data[1] & 0x7F if data[1] & 0x80 else 0
    if size > 4 or len(data) < 2 + size or data[1] == 0x80:
        return -1
    return 2 + (size + int.from_bytes(data[2 : 2 + size], "big") if size else data[1])


def key_at(text: str, at: int, cuts: list[int]) -> tuple[int, str] | None:
    """End and kind of a key that begins at ``at`` of joined lines and ends at a separator or at
    one of ``cuts`` (starts of lines and the end of ``text``)."""
    last = cuts[bisect.bisect_right(cuts, at) :]

    def whole(end: int) -> bool:
        return text[end : end + 1] in ("", *"/+_-") or end in last

    for first, run_end, width, raw in (
        *((m.start(1), m.end(), 2, lambda x: bytes.fromhex(x) if len(x) % 2 == 0 else None) for m in [HEX_RUN.match(text, at)] if m),
        (at, len(text), 4 / 3, unbase64),
    ):
        begin = raw(text[first : min(first + 24, first + (run_end - first) // 4 * 4)]) or b""
        n = der_size(begin)
        if n >= 0:
            end = first + (2 * n if width == 2 else -(-4 * n // 3))
            if end <= run_end and (data := raw(text[first:end])) and is_der(data):
                while width != 2 and end < len(text) and text[end] == "=":
                    end += 1
                if whole(end):
                    return end, "der"
        elif begin.startswith(b"openssh-") or begin[4:].startswith((b"ssh-", b"ecdsa-", b"sk-")):
            for end in sorted({*(c for c in last if c <= run_end), run_end}, reverse=True):
                if whole(end) and (data := raw(text[first:end])) and is_ssh(data):
                    return end, "ssh"
    return None


def block_keys(block: str, escaped: bool) -> list[tuple[int, int, str]]:
    """Keys in successive lines; ``escaped``: a backslash stands before ``block``."""
    starts, ends = [0], []
    for m in BREAK.finditer(block):
        starts.append(m.end())
        ends.append(m.start())
    ends.append(len(block))
    if len(starts) > 1 and block.startswith("--", starts[-1]):  # the armour's last line
        del starts[-1], ends[-1]
    text = "".join(block[a:b] for a, b in zip(starts, ends, strict=True))
    lines = [0]
    for a, b in zip(starts, ends, strict=True):
        lines.append(lines[-1] + b - a)

    def place(i: int) -> int:
        k = bisect.bisect_right(lines, i) - 1
        return starts[k] + i - lines[k]

    found, done = [], 0
    for at in sorted({*lines[:-1], *(m.end() for m in re.finditer("[/+_-]", text)), *([1] if escaped and text[0] in "nrt" else [])}):
        if at >= done and BEGINS.match(text, at) and (key := key_at(text, at, lines)):
            done = key[0]
            found.append((place(at), place(done - 1) + 1, key[1]))
    return found


def structural(text: str) -> list[tuple[int, int, str]]:
    found = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            body = unbase64(re.sub(r"\s|\\[nr]", "", m[2]))
            if body and (is_der(body) or is_ssh(body)):
                found.append((m.start(), m.end(), "pem"))
        for m in SEALED.finditer(text):
            body = unbase64(re.sub(r"\s|\\[nr]", "", m[3]))
            if body and len(body) % (len(m[2]) // 2) == 0:
                found.append((m.start(), m.end(), "pem"))
    taken = list(found)
    if "ey" in text:
        for m in DOTTED.finditer(text):
            if is_token(m[1], m[2]):
                found.append((m.start(), m.end(), "jwt"))
    for b in BLOCK.finditer(text):
        if BEGINS.search(b[0]) and not any(s <= b.start() < e for s, e, _ in taken):
            more = [(b.start() + s, b.start() + e, k) for s, e, k in block_keys(b[0], text[b.start() - 1 : b.start()] == "\\")]
            found, taken = found + more, taken + more
    for m in RUN.finditer(text):
        if any(s < m.end() and m.start() < e for s, e, _ in taken):
            continue
        run = m[0]
        data = bytes.fromhex(run) if len(run) % 2 == 0 and ALL_HEX.fullmatch(run) else unbase64(run)
        kind = data and ("der" if is_der(data) else "ssh" if is_ssh(data) else None)
        if kind:
            found.append((m.start(), m.end(), kind))
    return found


def base(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and structural spans, each (start, end, kind), sorted."""
    order = lambda x: (x[0], KINDS.index(x[2]))
    return (sorted(base(text), key=order), sorted(structural(text), key=order)) if text else ([], [])


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("confirmed", StringType())]))
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("confirmed", pa.string())]))


def find_secrets(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) with ``secrets``: spans sorted by start, then kind;
    ``confirmed`` is ``pattern`` or ``structure``."""
    keep = [c for c in (keep or docs.columns) if c != "secrets"]
    docs = docs.select(*dict.fromkeys([*keep, "text"]))

    def scanned(batches):
        for batch in batches:
            rows = []
            for t in batch.column("text").to_pylist():
                plain, more = scan(t)
                rows.append([{"kind": k, "start": s, "end": e, "confirmed": how} for s, e, k, how in sorted([(*x, "pattern") for x in plain] + [(*x, "structure") for x in more], key=lambda x: (x[0], KINDS.index(x[2])))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, _SPANS_ARROW)], [*keep, "secrets"])

    return docs.mapInArrow(scanned, StructType([*docs.select(*keep).schema.fields, StructField("secrets", SPANS)]))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the union of each text's secret spans replaced by ``mark``."""

    def cleaned(batches):
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                parts, at = [], 0
                for s, e, _ in sorted(sum(scan(t), [])):
                    if e > at:
                        parts += [t[at:s], mark] if s >= at else []
                        at = e
                out.append("".join([*parts, t[at:]]) if at else t)
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array(out, batch.schema.field(i).type))

    return docs.mapInArrow(cleaned, docs.schema)


def _joined(spans) -> str:
    return ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in spans)


def query(spark, sf_dir) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])

    def digested(batches):
        for batch in batches:
            rows = batch.column("secrets").to_pylist()
            plain = [[x for x in r if x["confirmed"] == "pattern"] for r in rows]
            counts = [pa.array([sum(x["kind"] == k for x in r) for r in plain], pa.int64()) for k in KINDS[:3]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array([hashlib.sha256(_joined(r).encode()).hexdigest() for r in plain], pa.string()), pa.array([_joined(r) for r in rows], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.mapInArrow(digested, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
