import hashlib
import random
import re

import pytest

from starloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    values = [int(c) for c in digits][::-1]
    return sum(values[::2] + [sum(divmod(2 * d, 10)) for d in values[1::2]]) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = {k: [m for m in p.finditer(text)] for k, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))}
    found["ip"] = [m for m in found["ip"] if all(int(x) <= 255 for x in m[0].split("."))]
    found["card"] = [m for m in found["card"] if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found["phone"] = [m for m in found["phone"] if 8 <= len(digits(m)) <= 15]
    return {k: [m.span() for m in v] for k, v in found.items()}


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = ["@", ".", "-", " ", "+", "1", "23", "255", "256", "0", "a", "b.c", "é", "(", ")", "%", "_", "4111 1111 1111 1111", "4111111111111111", "10.0.0.1", "+49 30 1234567", "joe@ex.org", "\n", "..", "--", "٣", "😀"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_equal_the_patterns(seed):
    for t in random_texts(3000, seed):
        got = pii.spans(t)
        assert {k: got[k] for k in pii.BASE} == brute(t), t


def test_long_texts():
    t = ("a" * 20_000 + "@") * 2 + "1." * 50_000 + "+" + "1" * 100_000
    got = pii.spans(t)
    assert {k: got[k] for k in pii.BASE} == brute(t)


def test_added_kinds():
    t = "see https://a.example.org/x?y=1). IBAN: DE89 3704 0044 0532 0130 00, Account No: 12345678 mailto:x@y.org"
    got = pii.spans(t)
    assert [t[a:b] for a, b in got["url"]] == ["https://a.example.org/x?y=1", "mailto:x@y.org"]
    assert [t[a:b] for a, b in got["account"]] == ["DE89 3704 0044 0532 0130 00", "12345678"]


def test_secrets():
    key = "9f" * 20
    t = f"access_token = \"{key}\"; PASSWORD: aB3{'x' * 13}, Api key=>A1{'b' * 20}== token: abc1 secret = {'z' * 30} mytoken={key} token ({key})"
    assert [t[a:b] for a, b in pii.spans(t)["secret"]] == [key, "aB3" + "x" * 13, "A1" + "b" * 20 + "=="]
    assert pii.redact(f"token='{key}'", pii.spans(f"token='{key}'")) == "token='[SECRET]'"
    assert not any(pii.spans("The secret key to the token economy: a password, kept well.").values())


def test_repeated_cues_take_linear_time():
    t = "token " * 50_000 + "token:" * 50_000 + "token=" + "a" * 100_000
    assert pii.spans(t)["secret"] == []


def test_tables(spark, make_docs):
    given = [*random_texts(40, 9), None, ""]
    docs = make_docs(given).withColumnRenamed("lang", "spans")
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    for i, t in enumerate(given):
        want = brute(t or "")
        listed = ",".join(f"{k}:{a}:{b}" for k in pii.BASE for a, b in want[k])
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [len(want[k]) for k in pii.BASE]
        assert got[i]["spans"].startswith(listed)
    clean = {r["doc_id"]: r["text"] for r in pii.redact_pii(docs).collect()}
    assert clean[40] is None and clean[41] == ""
    assert all(not any(brute(t or "").values()) or t != given[i] for i, t in clean.items())
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_redaction_joins_overlaps():
    t = "mail joe@ex.org or mailto:ann@ex.org now"
    assert pii.redact(t, pii.spans(t)) == "mail [EMAIL] or [URL] now"
