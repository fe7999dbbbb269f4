import datetime as dt
import hashlib
import re

import pytest

from tallyframe.llm import pii

from .helpers import corpus, docs, save

KEY = "a key of the tests"


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def changed(spark, texts):
    return [r for r in pii.pseudonymise(docs(spark, list(enumerate(texts))), KEY).orderBy("doc_id").collect()]


def test_cards(spark):
    a, b, bad = changed(spark, ["x 4111 1111 1111 1111, 4111-1111-1111-1111 y", "4111111111111111.", "4111111111111112 12345678"])
    p = [re.sub(r"\D", "", x) for x in a.pseudonyms + b.pseudonyms]
    assert len(set(p)) == 1 and p[0] != "4111111111111111" and luhn(p[0]) and p[0][0] == "4" and len(p[0]) == 16
    assert re.fullmatch(r"x \d{4} \d{4} \d{4} \d{4}, \d{4}-\d{4}-\d{4}-\d{4} y", a.text) and b.text[-1] == "."
    assert bad.n_replaced == 0 and bad.text.startswith("4111111111111112")


def test_other_numbers(spark):
    out = changed(spark, ["IBAN DE89370400440532013000 and GB82 WEST 1234 5698 7654 32.", "ip 10.0.0.1 300.1.1.1", "+1 (017) 555-7713 (212) 555-1234 +44 20 7946 0958", "123-45-6789 000-12-3456 666-12-3456"])
    iban = [x.replace(" ", "") for x in out[0].pseudonyms]
    assert out[0].kinds == ["iban"] * 2 and all(mod97(x) == 1 for x in iban) and iban[0][:2] == "DE" and iban[1][4:8] == "WEST"
    assert out[1].kinds == ["ip"] and all(int(x) < 256 for x in out[1].pseudonyms[0].split(".")) and "300.1.1.1" in out[1].text
    assert out[2].kinds == ["phone"] * 3 and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} \(\d{3}\) \d{3}-\d{4} \+44 \d\d \d{4} \d{4}", out[2].text)
    assert out[3].kinds == ["ssn"] and re.fullmatch(r"\d{3}-\d{2}-\d{4} 000-12-3456 666-12-3456", out[3].text)


def test_dates(spark):
    (r,) = changed(spark, ["2021-02-30 2021-02-28 31/12/1999 12/31/1999 1.2.2003"])
    new = r.text.split()
    assert new[0] == "2021-02-30" and r.n_replaced == 4
    for x, f in zip(new[1:], ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d.%m.%Y"), strict=True):
        assert 1900 <= dt.datetime.strptime(x, f).year <= 2099
    assert dt.datetime.strptime(new[2], "%d/%m/%Y") == dt.datetime.strptime(new[3], "%m/%d/%Y")


@pytest.mark.parametrize("kind", ["ip", "date", "ssn", "email", "card"])
def test_permutations(spark, kind):
    if kind == "ip":
        values = [f"10.1.{i // 256}.{i % 256}" for i in range(1500)]
    elif kind == "date":
        values = [str(dt.date(2000, 1, 1) + dt.timedelta(i)) for i in range(1500)]
    elif kind == "ssn":
        values = [f"{660 + i // 100:03d}-{i % 99 + 1:02d}-{i + 1:04d}" for i in range(600)] + [f"665-01-{i:04d}" for i in range(1, 500)]
        values = [v for v in dict.fromkeys(values) if not v.startswith("666")]
    elif kind == "email":
        values = [f"ab{i}.x@d.org" for i in range(1500)]
    else:
        values = [v for v in (f"4{i:015d}" for i in range(9000)) if luhn(v)]
    out = changed(spark, values)
    new = [r.text for r in out]
    assert all(r.kinds == [kind] for r in out)
    assert len(set(new)) == len(set(values)) and sum(a == b for a, b in zip(new, values, strict=True)) < 10
    if kind == "card":
        assert all(luhn(x) for x in new)


def test_key_matters_and_text_stays(spark):
    t = [(1, "mail a.b@c.de at 10.0.0.1 " + "z" * 50000)]
    a, b = (pii.pseudonymise(docs(spark, t), key=k).first().text for k in ("one", "two"))
    assert a != b and a.endswith("z" * 50000) and re.match(r"mail [a-z]\.[a-z]@c\.de at \d+\.\d+\.\d+\.\d+ z", a)


def test_query_and_cases(spark, tmp_path):
    rows = corpus()
    out = pii.op5_pii(spark, save(docs(spark, rows), tmp_path)).collect()
    assert {r.doc_id: r.text for r in out} == dict(rows)
    assert all(r.n_replaced == (None if r.text is None else 0) for r in out)
    assert pii.pseudonymise(docs(spark, []), KEY).count() == 0
    clash = docs(spark, [(None, "10.0.0.1"), (1, "10.0.0.1")]).selectExpr("*", "1 AS kinds", "2 AS m")
    got = pii.pseudonymise(clash, KEY).collect()
    assert len({r.text for r in got}) == 1 and got[0].kinds == ["ip"]


def test_plan_is_native(spark):
    plan = pii.pseudonymise(docs(spark, [(1, "a")]), KEY)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def feistel(kind, a, b, ma, mb):
    """The permutation, written anew."""
    for i in range(pii.ROUNDS):
        m = ma if i % 2 == 0 else mb
        draw = int(hashlib.sha256(f"{KEY}|{kind}|{ma}|{mb}|{i}|{b}".encode()).hexdigest()[:15], 16)
        a, b = b, (a + draw) % m
    return a, b


def test_numbers_against_a_plain_version(spark):
    ips = ["10.0.0.1", "192.168.3.250", "8.8.8.8"]
    cards = ["4111111111111111", "5500005555555559", "378282246310005"]
    phones = ["+353861234567", "+442079460958", "+12125551234", "+79161234567", "(212) 555-1234"]
    days = ["2021-02-28", "1999-12-31"]
    want = []
    for x in ips:
        o = [int(n) for n in x.split(".")]
        a, b = feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        want.append(f"{a >> 8}.{a % 256}.{b >> 8}.{b % 256}")

    def core(kind, digits):
        cut = len(digits) // 2
        a, b = feistel(kind, int(digits[:cut]), int(digits[cut:]), 10**cut, 10 ** (len(digits) - cut))
        return f"{a:0{cut}d}{b:0{len(digits) - cut}d}"

    for x in cards:
        start = x[0] + core("card", x[1:-1])
        want.append(next(start + str(c) for c in range(10) if luhn(start + str(c))))
    for x, code in zip(phones, (3, 2, 1, 1, 0), strict=True):
        d = re.sub(r"\D", "", x)
        new = iter(d[:code] + core("phone", d[code:]))
        want.append("".join(next(new) if c.isdigit() else c for c in x))
    for x in days:
        n = (dt.date.fromisoformat(x) - dt.date(1900, 1, 1)).days
        a, b = feistel("date", n // 4297, n % 4297, 17, 4297)
        want.append(str(dt.date(1900, 1, 1) + dt.timedelta(a * 4297 + b)))
    got = [p for r in changed(spark, [f"see {x} now" for x in ips + cards + phones + days]) for p in r.pseudonyms]
    assert got == want


def test_country_codes_stay(spark):
    (r,) = changed(spark, ["+353 86 123 4567 x +353 86 123 4568 +30 21 0123 4567"])
    assert re.fullmatch(r"\+353 \d\d \d{3} \d{4} x \+353 \d\d \d{3} \d{4} \+30 \d\d \d{4} \d{4}", r.text)


def test_a_key_is_required_and_columns_keep_their_values(spark):
    with pytest.raises(TypeError):
        pii.pseudonymise(docs(spark, [(1, "a")]))
    clash = docs(spark, [(1, "ip 10.0.0.1")]).selectExpr("*", "1 AS _found", "2 AS _new", "3 AS _VALID", "4 AS __valid")
    r = pii.pseudonymise(clash, KEY).first()
    assert (r._found, r._new, r["_VALID"], r["__valid"], r.n_replaced) == (1, 2, 3, 4, 1)
