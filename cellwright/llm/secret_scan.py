"""Secret scans with structural confirmation.

Candidates come from whole texts: assignments to secret-like names, access-key ids and long hex runs (the base kinds), and
long base64 runs, armoured keys and dotted tokens. A candidate of the latter is reported only if what it decodes to has
the structure of a secret: key encodings whose nested lengths add up (``der``), length-prefixed public-key blobs and
private-key containers (``sshkey``), armoured blocks with such a body (``pem``), or a signed token whose header is JSON
with an algorithm (``jwt``). Lines of one encoding, broken by line ends or by escaped ones, are decoded as one; encodings
that start within a run, glued to other text, are tried from each place that can open one and end where their structure
ends; hex of either case is decoded, while the base kind is lower case. Base spans stay whether confirmed or not; ``confirmed`` lists those spans that decode.

Defined results: null text is empty, an empty text has no spans and the digest of the empty string; offsets are code
points, ends exclusive; repeated rows give repeated results; an empty table gives no rows; other columns are carried.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cellwright.llm import textkit as tk

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
#: Maximal runs of base64 (either alphabet) characters; hex runs and encoded keys lie within them.
RUN = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Line ends, written out or escaped (once or more often), with what indents the next line.
BREAK = r"[ \t]*(?:\r\n?|\n|(?:\\+r)?\\+n)[ \t]*"
#: Runs of one or more lines: all but the last have 32 characters or more.
LINES = re.compile(rf"[A-Za-z0-9+/_-]{{32,}}(?:{BREAK}[A-Za-z0-9+/_-]{{32,}})*(?:{BREAK}[A-Za-z0-9+/_-]+)?={{0,2}}")
BREAKS = re.compile(BREAK)
#: Places that can open a key in base64 (a sequence, a public-key blob, a container) and in hex of either case.
OPENS = re.compile(r"(?=M[B-I]|AAAA[A-E]|b3Bl)")
ANY_HEX = re.compile(r"[0-9A-Fa-f]{32,}")
OPENS_HEX = re.compile(r"(?=30(?:8[1-4]|[1-7][0-9A-Fa-f])|000000(?:07|0[Bb]|13)|6[Ff]70656[Ee]7373)")
JWT = re.compile(r"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----([A-Za-z0-9+/=\s\\]+)-----END \1-----")
KINDS = ("assign", "access", "hex", "pem", "der", "sshkey", "jwt")
#: The tags of ASN.1 that nest, and the names that open a public-key blob.
NESTED = {0x30, 0x31, *range(0xA0, 0xB0)}
BLOBS = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-")
CONTAINER = b"openssh-key-v1\x00"
FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3}


def _elements(data: bytes, depth: int = 0) -> list[int] | None:
    """The tags at one level of DER, if every length, nested ones too, fills its parent exactly."""
    tags, i, n = [], 0, len(data)
    while i < n:
        if i + 2 > n or depth > 12:
            return None
        tag, size = data[i], data[i + 1]
        i += 2
        if size >= 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or i + more > n:
                return None
            size = int.from_bytes(data[i : i + more], "big")
            i += more
        if i + size > n or (tag in NESTED and _elements(data[i : i + size], depth + 1) is None):
            return None
        tags.append(tag)
        i += size
    return tags


def _is_der(data: bytes) -> bool:
    """One sequence that starts with an integer or a sequence, as private and public keys do, and fills the data."""
    if len(data) < 24 or data[0] != 0x30 or _elements(data) != [0x30]:
        return False
    skip = 2 + (data[1] & 0x7F if data[1] >= 0x80 else 0)
    inner = _elements(data[skip:])
    return bool(inner) and len(inner) >= 2 and inner[0] in (0x02, 0x30)


def _is_blob(data: bytes) -> bool:
    if data.startswith(CONTAINER):
        # names, options and keys fill it exactly, and the first public key is one
        if _size(data, lambda: data) != len(data):
            return False
        key = _fields(data, len(CONTAINER), 3) + 4
        return _is_blob(data[key + 4 : _fields(data, key, 1)])
    fields, i = [], 0
    while i + 4 <= len(data):
        (size,) = struct.unpack(">I", data[i : i + 4])
        if i + 4 + size > len(data):
            return False
        fields.append(data[i + 4 : i + 4 + size])
        i += 4 + size
    return i == len(data) and len(fields) >= 2 and fields[0].startswith(BLOBS)


def _fields(data: bytes, i: int, n: int) -> int | None:
    """Where ``n`` length-prefixed fields from ``i`` on end, if they do within the data."""
    for _ in range(n):
        if i + 4 > len(data):
            return None
        i += 4 + int.from_bytes(data[i : i + 4], "big")
    return i if i <= len(data) else None


def _size(head: bytes, decode) -> int | None:
    """How many bytes the key that opens with ``head`` takes, by its own lengths; ``decode`` gives all that follows."""
    if head[:1] == b"\x30" and len(head) >= 8:
        more = head[1] & 0x7F if head[1] >= 0x80 else 0
        if more > 4 or head[1] == 0x80:
            return None
        inner = head[2 + more :]
        # a version or an algorithm opens short keys; lengths alone would say too little there
        if inner[:1] not in (b"\x02", b"\x30") or not (more or inner[:3] in (b"\x02\x01\x00", b"\x02\x01\x01") or (inner[:1] == b"\x30" and inner[2:3] == b"\x06")):
            return None
        return 2 + more + (int.from_bytes(head[2 : 2 + more], "big") if more else head[1])
    if head.startswith(CONTAINER[:8]):
        data = decode()
        i = _fields(data, len(CONTAINER), 3) if data.startswith(CONTAINER) else None
        keys = int.from_bytes(data[i : i + 4], "big") if i is not None and i + 4 <= len(data) else 0
        return _fields(data, i + 4, keys + 1) if 1 <= keys <= 64 else None
    if head[:4] in (b"\0\0\0\x07", b"\0\0\0\x0b", b"\0\0\0\x13") and head[4:8] in (b"ssh-", b"ecds"):
        data = decode()
        return _fields(data, 0, FIELDS.get(data[4 : 4 + data[3]], 99))
    return None


def _keys_within(text: str, opens: re.Pattern, of) -> list[tuple[int, int, str]]:
    """Start, end and kind of the keys that open at some place of ``text`` and end where their lengths say; none overlap.

    ``of`` is (characters, bytes they stand for, decoder).
    """
    chars, size, decode = of
    found, done = [], 0
    for m in opens.finditer(text):
        a = m.start()
        if a < done:
            continue
        n = _size(decode(text[a : a + 12 * chars // size]) or b"", lambda a=a: decode(text[a : len(text) - ((len(text) - a) % chars == 1)]) or b"")
        b = a + -(-(n or 0) * chars // size)
        if not n or b > len(text):
            continue
        kind = _structure(decode(text[a:b]))
        if kind:
            found.append((a, b, kind))
            done = b
    return found


def _unhex(text: str) -> bytes:
    return bytes.fromhex(text[: len(text) // 2 * 2])


def _unbase64(text: str) -> bytes | None:
    body = re.sub(r"\\+[nrt]|\\+(?=/)|[\s=]", "", text).replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _structure(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if _is_der(data) else "sshkey" if _is_blob(data) else None


def _is_jwt(token: str) -> bool:
    head = _unbase64(token.split(".", 1)[0])
    try:
        head = json.loads(head.decode("utf-8")) if head else None
    except (UnicodeDecodeError, ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def _decoded_keys(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of keys in base64 or hex, over the lines of one encoding and from any place that can open one."""
    out = []
    for lines in LINES.finditer(text):
        body, starts, places, at = [], [], [], 0
        i = 0
        for m in [*BREAKS.finditer(lines[0]), None]:
            piece = lines[0][i : m.start() if m else len(lines[0])].rstrip("=")
            body.append(piece)
            starts.append(at)
            places.append(lines.start() + i)
            at += len(piece)
            i = m.end() if m else i
        joined = "".join(body)

        def place(k, starts=starts, places=places):
            j = bisect.bisect_right(starts, k) - 1
            return places[j] + k - starts[j]

        keys = _keys_within(joined, OPENS, (4, 3, _unbase64))
        for m in ANY_HEX.finditer(joined):
            keys += [(m.start() + a, m.start() + b, kind) for a, b, kind in _keys_within(m[0], OPENS_HEX, (2, 1, _unhex))]
        for a, b, kind in keys:
            end = place(b - 1) + 1
            while end < lines.end() and text[end] == "=":
                end += 1
            out.append((place(a), end, kind))
    return out


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], set[tuple[int, int, int]]]:
    """Spans (start, place of the kind in KINDS, end) in order, and those of them that decode to a secret's structure."""
    found, sure = [], set()
    if len(text) < 8:
        return found, sure
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            found.append(s := (m.start(), 0, m.end()))
            value = m[2]
            if _is_jwt(value) or _structure(_unbase64(value)):
                sure.add(s)
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    keys = _decoded_keys(text)
    for run in RUN.finditer(text):
        for m in HEX.finditer(run[0]):
            found.append(s := (run.start() + m.start(), 2, run.start() + m.end()))
            kind = _structure(bytes.fromhex(m[0][: len(m[0]) // 2 * 2]))
            if kind:
                sure.add(s)
                found.append(s := (s[0], KINDS.index(kind), s[2]))
                sure.add(s)
        kind = _structure(_unbase64(run[0]))
        if kind and not any(a <= run.start() and run.end() <= b for a, b, _ in keys):
            found.append(s := (run.start(), KINDS.index(kind), run.end()))
            sure.add(s)
    for a, b, kind in keys:
        found.append(s := (a, KINDS.index(kind), b))
        sure.add(s)
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            if _structure(_unbase64(m[2])):
                found.append(s := (m.start(), 3, m.end()))
                sure.add(s)
    if "ey" in text and "." in text:
        for m in JWT.finditer(text):
            if _is_jwt(m[0]):
                found.append(s := (m.start(), 6, m.end()))
                sure.add(s)
    return sorted(set(found)), sure


def _written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches):
    for batch in batches:
        counts, digests, all_spans, confirmed = [[], [], []], [], [], []
        for text in batch.column("text"):
            spans, sure = scan_text(text.as_py() or "")
            base = [s for s in spans if s[1] < 3]
            for k in range(3):
                counts[k].append(sum(s[1] == k for s in base))
            digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
            all_spans.append(_written(spans))
            confirmed.append(_written(s for s in spans if s in sure))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), *(pa.array(c, pa.int64()) for c in counts), *(pa.array(c, pa.string()) for c in (digests, all_spans, confirmed))],
            names=["row", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "confirmed"],
        )


def secret_scan(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the carried columns, all by default), counts of the base kinds, their digest, all spans, confirmed spans."""
    extra = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, confirmed string"
    rows = tk.carried(docs, text_col, carry)
    return rows.mapInArrow(_scan, tk.carried_schema(rows, extra))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(tk.table_of(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("row.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "confirmed")
