"""Operator 3: personal data by anchor expansion."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from ipaddress import AddressValueError, IPv6Address
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import kept_by_worker, on_workers

#: In the order in which spans at the same place are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "url", "account", "secret", "ipv6")
BASE = 4

# Cues that stand before an account or a secret, in lower case.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "kontonummer", "cuenta", "compte", "passport", "ssn", "routing", "sort code", "tax id", "customer no", "member id")
SECRET_CUES = ("token", "api_key", "api-key", "apikey", "secret", "password", "passwd", "pwd", "access_key", "private_key", "bearer")

_EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_REST = re.compile(r"://(?:[^\s/@\"'<>]+@)?(?:\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?)(?::[0-9]{1,5})?(?:[/?#][^\s\"'<>]*)?")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*")
_AFTER_CUE = re.compile(r"(?:\s?(?:no|nr|num|number|nummer|id|code)\b)?\.?\s{0,2}[:=#]?\s{0,2}[\"']?", re.I)
_ACCOUNT = re.compile(r"[A-Za-z]{0,4}[0-9][A-Za-z0-9]*(?:[\x20-][A-Za-z0-9]*[0-9][A-Za-z0-9]*)*")
_SECRET_SIGN = re.compile(r"[\"']?\s{0,2}(?:[:=]\s{0,2}|\x20)[\"']?")
_SECRET = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
_V6 = re.compile(r"[0-9A-Fa-f:]+")
_HEX = frozenset("0123456789abcdefABCDEF")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "").replace("-", "").upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class AnchorExpander:
    """Finds anchors in a pass of an Aho-Corasick automaton each for signs and for cues, then parses outwards from each.

    Anchors of a kind come in order of place. A kind's cursor is the end of its last match, valid or not: anchors
    before it are inside a match already, so a kind's matches are leftmost and don't overlap.
    """

    def __init__(self):
        import ahocorasick

        self.signs, self.cues = ahocorasick.Automaton(), ahocorasick.Automaton()
        signs = {"@": "email", "+": "phone", "://": "url", ":": "ipv6"} | dict.fromkeys("0123456789", "digit")
        cues = dict.fromkeys(ACCOUNT_CUES, "account") | dict.fromkeys(SECRET_CUES, "secret")
        for automaton, anchors in ((self.signs, signs), (self.cues, cues)):
            for anchor, kind in anchors.items():
                automaton.add_word(anchor, (kind, len(anchor)))
            automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind's place in KINDS, end) in order; places are in code points and end is exclusive."""
        at = dict.fromkeys(KINDS, 0)
        out = []

        def found(kind: str, start: int, end: int, valid: bool) -> None:
            at[kind] = end
            if valid:
                out.append((start, KINDS.index(kind), end))

        lower = text.lower() if text.isascii() else text.translate(_LOWER)  # cues in any case, at the same places
        for last, (kind, size) in chain(self.signs.iter(text), self.cues.iter(lower)):
            i = last + 1 - size
            if kind == "digit":
                if i >= at["ip"]:
                    if m := _IP.match(text, i):
                        parts = [p.lstrip("0") for p in m[0].split(".")]
                        found("ip", i, m.end(), all(len(p) < 4 and int(p or 0) <= 255 for p in parts))
                    else:
                        at["ip"] = _DIGITS.match(text, i).end()
                if i >= at["card"] and (m := _CARD.match(text, i)):
                    digits = m[0].replace(" ", "").replace("-", "")
                    found("card", i, m.end(), 14 <= len(digits) <= 19 and luhn(digits))
            elif kind == "email":
                start = i
                while start > at["email"] and text[start - 1] in _LOCAL:
                    start -= 1
                if start < i and (m := _EMAIL_DOMAIN.match(text, i)):
                    found("email", start, m.end(), True)
            elif kind == "phone":
                if i >= at["phone"] and (m := _PHONE.match(text, i)):
                    found("phone", i, m.end(), 10 <= sum(c.isdigit() for c in m[0]) <= 15)
            elif kind == "url":
                start = i
                while start > at["url"] and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "+.-"):
                    start -= 1
                if (s := _SCHEME.search(text, start, i)) and s.end() == i and (m := _URL_REST.match(text, i)):
                    end = m.end()
                    while text[end - 1] in ".,;:!?)":
                        end -= 1
                    found("url", s.start(), end, True)
            elif kind == "ipv6":
                if i >= at["ipv6"]:  # the first colon of a run of hex digits and colons
                    start = i
                    while start > at["ipv6"] and text[start - 1] in _HEX:
                        start -= 1
                    m = _V6.match(text, start)
                    end = m.end() - (m[0].endswith(":") and not m[0].endswith("::"))
                    apart = not text[start - 1 : start].isalnum() and not text[end : end + 1].isalnum()
                    found("ipv6", start, end, apart and end - start <= 39 and _is_v6(text[start:end]))
                    at["ipv6"] = m.end()
            elif i >= at[kind] and not text[i - 1 : i].isalnum():
                if kind == "account" and not text[i + size : i + size + 1].isalpha():
                    m = _ACCOUNT.match(text, _AFTER_CUE.match(text, i + size).end())
                    if m and (6 <= sum(c.isdigit() for c in m[0]) and len(m[0]) <= 42):
                        iban = re.match(r"[A-Za-z]{2}[0-9]{2}", m[0])
                        found("account", m.start(), m.end(), not iban or iban_valid(m[0]))
                elif kind == "secret" and (sign := _SECRET_SIGN.match(text, i + size)) and (m := _SECRET.match(text, sign.end())):
                    found("secret", m.start(), m.end(), any(c.isdigit() for c in m[0]))
        out.sort()
        return out


def _is_v6(text: str) -> bool:
    """An address; one written in full has a group of three digits at least, unlike times and keys in pairs of digits."""
    try:
        return len(text) > 4 and bool(IPv6Address(text)) and ("::" in text or max(map(len, text.split(":"))) > 2)
    except (AddressValueError, ValueError):
        return False


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def personal_data(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: counts of the base kinds, a digest of the base spans, all spans, and how many were added and are in all.

    Reads doc_id and text, ignores other columns. Null counts as the empty text, which has no span.
    Repeated rows are searched each, a null doc_id stays null, no row gives no result. Kinds don't
    exclude each other: a span may lie in one of another kind. One pass without a shuffle.
    """
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expander = kept_by_worker("expander", AnchorExpander)
        schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in SCHEMA.split(", "))])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                spans = expander.spans(text or "")
                base = [s for s in spans if s[1] < BASE]
                rows.append((doc_id, *(sum(s[1] == k for s in base) for k in range(BASE)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base), len(spans)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
