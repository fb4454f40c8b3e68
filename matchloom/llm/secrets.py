"""Secret scans with structural confirmation.

Three plain kinds (assignments, access keys, long hex runs) are matched as they stand. Further candidates are
reported only if what they decode to has the structure they claim: private keys in PEM armour or as bare base64
or hex whose nested DER lengths add up, OpenSSH keys with their magic and length-prefixed fields, and signed
tokens whose header is a JSON object that names an algorithm. Keys may be broken into lines, also by escapes (a
backslash and n), as in strings of program text; what follows a key in the same run of letters is cut off by its length.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import release, ship, table, tidied

#: The kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
BEGIN = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ ){0,3}PRIVATE KEY)-----")
#: A line break, plain or escaped; base64 that starts like a DER sequence, over lines; what OpenSSH's magic starts with.
BREAK = r"(?:\r?\n[ \t]*|(?:\\r)?\\n)"
BASE64 = re.compile(rf"(?:(?<![A-Za-z0-9+/])|(?<=\\n)|(?<=\\r))M[A-Z][A-Za-z0-9+/]{{38,}}(?:{BREAK}[A-Za-z0-9+/]+)*={{0,2}}")
HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}")
OPENSSH = re.compile(rf"b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/]{{20,}}(?:{BREAK}[A-Za-z0-9+/]+)*={{0,2}}")
BREAKS = re.compile(BREAK)
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
#: Some spelling of one of these is in every text with an assignment.
WORDS = ("passw", "secret", "token", "apikey", "api_key")


def der_children(b: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the elements that fill b exactly, else None."""
    out, i = [], 0
    while i < len(b):
        if i + 2 > len(b):
            return None
        tag, n, i = b[i], b[i + 1], i + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or i + k > len(b):
                return None
            n, i = int.from_bytes(b[i : i + k], "big"), i + k
        if i + n > len(b):
            return None
        out.append((tag, b[i : i + n]))
        i += n
    return out


def sequence_parts(b: bytes) -> list[tuple[int, bytes]]:
    """The elements of the one DER sequence that b is, else none."""
    top = der_children(b)
    return (der_children(top[0][1]) or []) if top and len(top) == 1 and top[0][0] == 0x30 else []


#: Object identifiers of key kinds (encoded), and what those of password-based encryption start with.
RSA, EC, EDWARDS, BY_PASSWORD = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"), bytes.fromhex("2b65"), (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c"))


def is_plain_key(b: bytes) -> bool:
    """Whether b is one DER sequence laid out as PKCS#1, its like of DSA, or SEC 1."""
    parts = sequence_parts(b)
    tags = [t for t, _ in parts]
    if tags[:1] == [0x02] and len(tags) in (6, 9, 10) and set(tags[:9]) == {0x02}:  # DSA, RSA
        return True
    return tags[:2] == [0x02, 0x04] and parts[0][1] == b"\x01"  # SEC 1


def is_inner_key(kind: bytes, b: bytes) -> bool:
    """Whether the octets within PKCS#8 are a key of the kind that its algorithm names. Another PKCS#8 is none: it nests once."""
    parts = der_children(b)
    if not parts:
        return False
    if kind == RSA or kind == EC:
        return is_plain_key(b)
    return kind[:2] != EDWARDS or len(parts) == 1 and parts[0][0] == 0x04 and len(parts[0][1]) >= 32


def is_private_key(b: bytes) -> bool:
    """Whether b is one DER sequence laid out as PKCS#1, PKCS#8 with a key inside, encrypted PKCS#8 or SEC 1."""
    parts = sequence_parts(b)
    tags = [t for t, _ in parts]
    if tags[:3] == [0x02, 0x30, 0x04]:  # PKCS#8
        kind = der_children(parts[1][1])
        return bool(kind) and kind[0][0] == 0x06 and is_inner_key(kind[0][1], parts[2][1])
    if tags == [0x30, 0x04]:  # encrypted
        kind = der_children(parts[0][1])
        return bool(kind) and kind[0][0] == 0x06 and kind[0][1].startswith(BY_PASSWORD) and len(parts[1][1]) >= 8
    return is_plain_key(b)


def der_length(b: bytes) -> int | None:
    """Bytes of the element that b begins with, by its own header."""
    if len(b) < 2:
        return None
    k = b[1] & 0x7F if b[1] & 0x80 else 0
    if b[1] & 0x80 and not 1 <= k <= 4 or len(b) < 2 + k:
        return None
    return 2 + k + (int.from_bytes(b[2 : 2 + k], "big") if k else b[1])


def openssh_length(b: bytes) -> int | None:
    """Bytes of the OpenSSH key that b begins with: the magic; cipher, derivation and its options, each after its length;
    the number of keys; so many public keys and the private part, each after its length. None if they aren't there."""
    if not b.startswith(b"openssh-key-v1\0"):
        return None
    i = 15

    def skipped(i: int) -> int | None:
        end = i + 4 + int.from_bytes(b[i : i + 4], "big")
        return end if i + 4 <= len(b) and end <= len(b) else None

    for _ in range(3):
        if (i := skipped(i)) is None:
            return None
    count = int.from_bytes(b[i : i + 4], "big")
    i += 4
    if i > len(b) or not 1 <= count <= 64:
        return None
    for _ in range(count + 1):
        if (i := skipped(i)) is None:
            return None
    return i


def cut_to_key(text: str, start: int, end: int, length_of) -> tuple[bytes, int] | None:
    """What the base64 at start..end decodes to, cut to the length that it tells itself, and where that ends in the text."""
    letters, at, i = [], [], start
    for m in BREAKS.finditer(text, start, end):
        letters.append(text[i : m.start()])
        at.append(range(i, m.start()))
        i = m.end()
    letters.append(text[i:end])
    at.append(range(i, end))
    run = "".join(letters).rstrip("=")
    b = from_base64(run[: len(run) - (len(run) % 4 == 1)])
    n = length_of(b) if b else None
    if n is None or n > len(b):
        return None
    used = -(-4 * n // 3)
    for r in at:
        if used <= len(r):
            stop = r.start + used
            while stop < end and text[stop] == "=":
                stop += 1
            return b[:n], stop
        used -= len(r)
    return None


def from_base64(s: str, urlsafe: bool = False) -> bytes | None:
    s = re.sub(r"\s+", "", s).rstrip("=")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), altchars=b"-_" if urlsafe else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_key_armour(body: str) -> bool:
    """Base64 of a key after optional header lines; encrypted bodies (Proc-Type) have no structure to read but their blocks."""
    lines = BREAKS.sub("\n", body).split("\n")
    head = [x for x in lines if ":" in x]
    b = from_base64("".join(x for x in lines if ":" not in x))
    if not b:
        return False
    if any(x.strip().startswith("Proc-Type") and "ENCRYPTED" in x for x in head):
        return any(x.strip().startswith("DEK-Info") for x in head) and len(b) % 8 == 0
    return is_private_key(b) or openssh_length(b) is not None


def armoured(text: str) -> Iterator[tuple[int, int]]:
    """Spans from a BEGIN line to the END line of the same kind with nothing of the sort between, that hold a key."""
    begun = None
    for m in BEGIN.finditer(text):
        if m[1] == "END" and begun and begun[2] == m[2] and is_key_armour(text[begun.end() : m.start()]):
            yield begun.start(), m.end()
        begun = m if m[1] == "BEGIN" else None


def is_signed_token(s: str) -> bool:
    head = from_base64(s.split(".", 1)[0], urlsafe=True)
    try:
        found = json.loads(head) if head else None
    except (ValueError, RecursionError):
        return False
    return isinstance(found, dict) and isinstance(found.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of assignments, access keys and hex runs."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates that decode to what they claim to be."""
    out = []
    if "PRIVATE KEY" in text:
        out += [(a, 3, b) for a, b in armoured(text)]
    for m in BASE64.finditer(text):
        if (got := cut_to_key(text, m.start(), m.end(), der_length)) and is_private_key(got[0]):
            out.append((m.start(), 4, got[1]))
    for m in HEX_DER.finditer(text):
        n = der_length(bytes.fromhex(m[0][:12]))
        if n and 2 * n <= len(m[0]) and is_private_key(bytes.fromhex(m[0][: 2 * n])):
            out.append((m.start(), 4, m.start() + 2 * n))
    if "b3BlbnNzaC1rZXktdjE" in text:
        out += [(m.start(), 5, got[1]) for m in OPENSSH.finditer(text) if (got := cut_to_key(text, m.start(), m.end(), openssh_length))]
    if "eyJ" in text:
        out += [(m.start(), 6, m.end()) for m in TOKEN.finditer(text) if is_signed_token(m[0])]
    return out


def spelt(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed for each row of docs(doc_id, text).

    Positions are code points, ends exclusive. Null text counts as empty: no spans, the digest of nothing.
    Repeated rows stay repeated, an empty table gives no rows; other columns are not read; texts are scanned whole. Spans
    that start together are listed by kind."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                more = confirmed_spans(text or "")
                kinds = [k for _, k, _ in base]
                row = (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(spelt(base).encode()).hexdigest(), spelt(base + more), len(more))
                for c, v in zip(cols, row):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, types)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def masked_text(text: str, mask: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by the mask."""
    out, at = [], 0
    end = -1
    for a, _, b in sorted(base_spans(text) + confirmed_spans(text)):
        if a >= end:
            out += [text[at:a], mask]
        end = max(end, b)
        at = max(at, end)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with the secrets of `text` masked, all rows kept, repeated ones too; n_chars, if there, follows. Null stays null,
    texts are scanned whole, overlapping spans become one mask. An empty table stays empty; other columns are kept as they are."""
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def hide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                yield pa.array([None if t is None else masked_text(t, mask) for t in map(pa.StringScalar.as_py, texts)], pa.string())
        finally:
            release()

    out = docs.withColumn("text", hide(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans every document; see scan() for odd rows."""
    return scan(table(spark, sf_dir, "documents")).drop("n_confirmed")
