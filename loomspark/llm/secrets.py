"""Secret scan: keyword automaton, then patterns anchored at its hits, then checksums inside the token.

One pass of an Aho-Corasick automaton over a text finds the keywords; each pattern is tried only where its
keyword ends or begins. Tokens that carry a checksum count only if it holds. Hex runs and access keys of the
base kinds are part of the contract and are matched as defined.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
BASE = ("assign", "access", "hex")
_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(body: str, tail: str) -> bool:
    """The last six characters are the CRC-32 of the rest, in base 62 (as in published token formats)."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = _B62[r] + out
    return out.rjust(6, "0") == tail


def _prefixed(token: str) -> bool:
    return crc_base62(token.split("_", 1)[1][:-6], token[-6:])


def _fine(token: str) -> bool:
    """Fine-grained form: the checksum closes the last part."""
    last = token.rsplit("_", 1)[1]
    return crc_base62(last[:-6], last[-6:]) or crc_base62(token[:-6], token[-6:])


def _jwt(token: str) -> bool:
    try:
        head, body, _ = token.split(".")
        return all(isinstance(json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))), dict) for x in (head, body))
    except (ValueError, binascii.Error, RecursionError):  # nested too deeply for any real token
        return False


#: kind, keyword (lower case), anchored pattern, check
EXTRA = [
    *((f"{p}_token", f"{p}_", re.compile(rf"{p}_[A-Za-z0-9]{{36}}(?![A-Za-z0-9])"), _prefixed) for p in ("ghp", "gho", "ghu", "ghs", "ghr", "npm")),
    ("github_pat", "github_pat_", re.compile(r"github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}(?![A-Za-z0-9])"), _fine),
    ("google_key", "aiza", re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"), None),
    ("slack_token", "xox", re.compile(r"xox[abeoprs]-[0-9]{8,}-[A-Za-z0-9-]{16,}"), None),
    ("stripe_key", "k_live_", re.compile(r"[sr]k_live_[A-Za-z0-9]{24,}"), None),
    ("jwt", "eyj", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"), _jwt),
    ("private_key", "-----begin ", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), None),
]
_KINDS = {k: i for i, k in enumerate((*BASE, *(x[0] for x in EXTRA)))}
_RUN = re.compile(r"[A-Za-z0-9_-]*")
_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        a = ahocorasick.Automaton()
        for w in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            a.add_word(w, (len(w), ASSIGN, "assign", None, 0))
        a.add_word("akia", (4, ACCESS, "access", None, 0))
        for kind, word, pattern, test in EXTRA:
            a.add_word(word, (len(word), pattern, kind, test, 1 if kind == "stripe_key" else 0))
        a.make_automaton()
        _automaton = a
    return _automaton


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret by start, then kind as listed; ends are exclusive code points."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):
        low = text.replace("İ", "i").lower()  # the one character that lower() makes longer
    found, until = [], {}
    for end, (n, pattern, kind, test, back) in automaton().iter(low):
        at = end - n + 1 - back
        if at < until.get(kind, 0):
            continue
        m = pattern.match(text, at)
        if not m:
            if kind == "jwt":  # a later start in the same run of characters ends at the same place
                until[kind] = _RUN.match(text, at).end()
            continue
        until[kind] = m.end()
        if kind == "assign" and m.end(2) - m.start(2) < 8 or kind == "access" and m.end() - m.start() < 16:
            continue
        if test is None or test(m[0]):
            found.append((m.start(), m.end(), kind))
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], _KINDS[x[2]], x[1]))


SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,stop:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def secret_spans(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, spans``: all secrets of each whole text.

    A null or empty text has none; null and repeated ids stay as they are and each row gets a row; of overlapping
    matches of one kind the leftmost counts, kinds may overlap; very long texts are read whole, in time linear in their
    length; other columns are ignored; an empty table gives an empty result. Texts stay in their partition; nothing is
    shuffled.
    """

    def run(batches):
        for b in batches:
            spans = [[{"kind": k, "start": s, "stop": e} for s, e, k in scan(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Counts, joined spans and the hash of the base spans."""

    def said(x):
        return F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))

    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))

    def number(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, BASE), F.sha2(F.concat_ws(",", F.transform(base, said)), 256).alias("base_sha256"), F.concat_ws(",", F.transform("spans", said)).alias("spans"))


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one."""
    if text is None:
        return None
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{k}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


__all__ = ["scan", "secret_spans", "digest", "redact", "crc_base62"]
