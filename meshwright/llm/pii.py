"""Personal data: regular expressions propose, checksums confirm, context words adjust.

Five kinds are always found by fixed rules: email, ip, card, phone (the base) and,
by the method, iban (mod-97) and local_phone (a national number that only nearby
words make likely). Every proposal has a score: the prior of its kind, raised by a
passed checksum and by context words within CONTEXT characters. Base spans stay
whatever their score; added kinds need ACCEPT.

Proposals of a kind are leftmost and don't overlap; one that fails its validator is
dropped without a retry. Offsets are code points, end exclusive. Defined cases: null
and empty texts have no spans; repeated rows each get their own row; added spans
that overlap a base span are dropped. Each pattern is anchored so that it takes
time in proportion to the text, even where the text is one run of digits.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx

Span = tuple[str, int, int, float]
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "local_phone")
CONTEXT = 48
ACCEPT = 0.5

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits can begin a match at its first digit only, so later ones aren't tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![\w+])\(?0?[0-9]{2,4}\)?[ /-][0-9]{3,4}[ -][0-9]{3,5}(?![\w])")
#: Words near a span that make a kind likelier.
_WORDS = {
    "email": ("mail", "email", "contact"),
    "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("call", "phone", "tel", "mobile", "telefon", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "local_phone": ("call", "phone", "tel", "mobile", "telefon", "fax"),
}
_PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.5, "local_phone": 0.2}
_NEAR = {kind: re.compile(rf"\b(?:{'|'.join(words)})\b", re.IGNORECASE) for kind, words in _WORDS.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _emails(text: str) -> list[tuple[int, int]]:
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        begin = floor + len(text[floor:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            found.append((begin, domain.end()))
            floor = domain.end()
            at = text.find("@", floor)
        else:
            floor = at + 1  # no address reaches over this sign
            at = text.find("@", floor)
    return found


def _matches(pattern: re.Pattern, text: str, valid: Callable[[str], bool]) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text) if valid(m[0])]


def _score(kind: str, text: str, begin: int, end: int, checked: bool) -> float:
    near = text[max(0, begin - CONTEXT) : begin] + " " + text[end : end + CONTEXT]
    return min(1.0, _PRIOR[kind] + 0.3 * checked + 0.3 * bool(_NEAR[kind].search(near)))


def _overlaps(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a stretch meets any of the spans: of those that begin before its end, one reaches beyond its start."""
    order = sorted(spans)
    begins, reach = [b for b, _ in order], list(accumulate((e for _, e in order), max))

    def meets(begin: int, end: int) -> bool:
        k = bisect_left(begins, end)
        return k > 0 and reach[k - 1] > begin

    return meets


def find(text: str) -> list[Span]:
    """(kind, start, end, score), by kind as in KINDS and then by start."""
    if not text:
        return []
    base = {"email": _emails(text), "ip": [], "card": [], "phone": []}
    added = {"iban": [], "local_phone": []}
    if any_digit(text):
        base["ip"] = _matches(_IP, text, lambda m: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.split(".")))
        base["card"] = _matches(_CARD, text, lambda m: 13 <= len(d := _digits(m)) <= 19 and luhn(d))
        if "+" in text:
            base["phone"] = _matches(_PHONE, text, lambda m: 9 <= len(_digits(m)) <= 15)
        added["iban"] = _matches(_IBAN, text, lambda m: 15 <= len(v := m.replace(" ", "")) <= 34 and mod97(v))
        added["local_phone"] = _matches(_NATIONAL, text, lambda m: 9 <= len(_digits(m)) <= 13)
    out = [(k, b, e, _score(k, text, b, e, k == "card")) for k in BASE_KINDS for b, e in base[k]]
    taken = [x[1:3] for x in out]
    for kind, spans in added.items():
        meets = _overlaps(taken)
        fresh = [(b, e) for b, e in spans if not meets(b, e)]
        scored = [(kind, b, e, _score(kind, text, b, e, kind == "iban")) for b, e in fresh]
        out += [x for x in scored if x[3] >= ACCEPT]
        taken += fresh
    return out


def any_digit(text: str, _digit=re.compile("[0-9]")) -> bool:
    return _digit.search(text) is not None


_SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id and all spans with their scores, a row per document."""

    def task():
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find(t or "")] for t in batch.column(1).cast(pa.string()).to_pylist()]
            return pa.record_batch([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return tx.map_slices(rows, "text", task, f"doc_id long, spans {_SPANS}")


def _joined(kinds: tuple[str, ...]):
    chosen = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(chosen, one), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts, base digest and all spans of every document."""
    found = find_spans(tx.documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(_joined(BASE_KINDS).cast("binary"), 256).alias("base_sha256"), _joined(KINDS).alias("spans"))
