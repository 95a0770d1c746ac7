import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.pii import AnchorExpander, iban_valid, luhn, personal_data

FINDER = AnchorExpander()
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", "a@b.c", ".", "-", " ", "+", "1", "25", "300", "1.2.3.4", "0001", "4111111111111111", "4111 1111 1111 1111", "+1 (743) 555-3824", "::", "://", "http", "é", "token", "=", "x@y", "00"]), max_size=25))
def test_base_equals_the_patterns(parts):
    text = "".join(parts)
    assert [s for s in FINDER.spans(text) if s[1] < 4] == brute(text)


def kinds(text):
    return {(k, text[s:e]) for s, k, e in FINDER.spans(text) if k > 3}


def test_added_spans():
    assert iban_valid("DE89 3704 0044 0532 0130 00") and not iban_valid("DE88 3704 0044 0532 0130 00")
    assert kinds("see https://user:pw@example.org:80/a?b=1.") == {(4, "https://user:pw@example.org:80/a?b=1")}
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00, please") == {(5, "DE89 3704 0044 0532 0130 00")}
    assert kinds("IBAN: DE88 3704 0044 0532 0130 00, please") == set()
    assert kinds("account no. 12345678 is closed") == {(5, "12345678")}
    assert kinds('token = "f33e61083db5dbdf4bd2369d2f80176e"') == {(6, "f33e61083db5dbdf4bd2369d2f80176e")}
    assert kinds("tokenisation of the accountant 12345678") == set()
    assert kinds("at fe80::1ff:fe23:4567:890a it") == {(7, "fe80::1ff:fe23:4567:890a")}
    assert kinds("at 2001:0db8:85a3:0000:0000:8a2e:0370:7334, it") == {(7, "2001:0db8:85a3:0000:0000:8a2e:0370:7334")}
    assert kinds("12:30:45 00:1b:44:11:3a:b7 00:11:22:33:44:55:66:77 " + "a:" * 5000) == set()
    assert kinds("Sort Code: 40-47-84 59") == {(5, "40-47-84 59")} == kinds("ŞORT sOrT cOdE: 40-47-84 59")
    assert kinds("Api_Key=f33e61083db5dbdf4bd2369d2f80176e") == {(6, "f33e61083db5dbdf4bd2369d2f80176e")}
    assert kinds("a" * 40 + "://b.c") == {(4, "a" * 40 + "://b.c")}
    assert kinds("std::vector and a :: b") == set()


def test_query(spark, sf, odd, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in personal_data(docs).collect()}
    for r in docs.collect():
        b = brute(r.text)
        g = got[r.doc_id]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(x[1] == k for x in b) for k in range(4)]
        text = ",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in b)
        assert g.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(g.spans.split(","))
    assert personal_data(odd).count() == 11 and personal_data(nothing).count() == 0
    assert all(r.spans == "" for r in personal_data(odd).where("doc_id IN (3, 4, 5)").collect())
