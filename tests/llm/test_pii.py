import datetime
import hashlib
import random
import re

import pytest

from corpusflow.llm import pii

KEY = "test key 'quoted' \\"
SECRET = hashlib.sha256(KEY.encode()).hexdigest()


def feistel(left, right, a, b, tweak):
    for i in range(pii.ROUNDS):
        f = lambda v: int(hashlib.sha256(f"{SECRET}|{tweak}|{i}|{v}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            left = (left + f(right)) % a
        else:
            right = (right + f(left)) % b
    return left, right


def digits(d, tweak):
    h = len(d) // 2
    q = feistel(int(d[:h]), int(d[h:]), 10 ** h, 10 ** (len(d) - h), tweak)
    return f"{q[0]:0{h}d}{q[1]:0{len(d) - h}d}"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10


def refill(piece, new):
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in piece)


def card(x):
    d = re.sub(r"\D", "", x)
    if luhn(d):
        return x
    p = digits(d[:-1], f"card{len(d)}")
    return refill(x, p + str((10 - luhn(p + "0")) % 10))


def phone(x):
    d = re.sub(r"\D", "", x)
    return refill(x, d[:-10] + digits(d[-10:], "phone"))


def ip(x):
    o = [int(v) for v in x.split(".")]
    if max(o) > 255:
        return x
    a, b = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def day(x, fmt):
    try:
        n = (datetime.datetime.strptime(x, fmt).date() - datetime.date(1800, 1, 1)).days
    except ValueError:
        return x
    if not 0 <= n < 146097:
        return x
    a, b = feistel(n // 773, n % 773, 189, 773, "date")
    return (datetime.date(1800, 1, 1) + datetime.timedelta(a * 773 + b)).strftime(fmt)


def one(spark, texts, fn=pii.pseudonymise):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r[-1]) for r in fn(df, KEY).orderBy("doc_id").collect()]


def test_equals_brute_force(spark):
    r = random.Random(9)
    num = lambda n: "".join(r.choices("0123456789", k=n))
    found = []
    for _ in range(120):
        found.append((num(16), card))
        p = num(r.randint(12, 18))
        found.append((p + str((10 - luhn(p + "0")) % 10), card))
        found.append((f"+1 ({num(3)}) 555-{num(4)}", phone))
        found.append((".".join(str(r.randint(0, 299)) for _ in range(4)), ip))
        found.append((f"{r.randint(1700, 2300)}-{r.randint(0, 13):02d}-{r.randint(0, 32):02d}", lambda x: day(x, "%Y-%m-%d")))
        found.append((f"{r.randint(1, 31):02d}.{r.randint(1, 12):02d}.{r.randint(1800, 2199)}", lambda x: day(x, "%d.%m.%Y")))
    p = "411111111111111"
    found += [("4111 1111 1111 1111", card), ("4111-1111-1111-1111", card), ("3782 822463 10005", card), (p + "1", card)]
    got = one(spark, [f"été {x}, tail" for x, _ in found])
    for (x, rule), (text, n) in zip(found, got):
        want = rule(x)
        assert text == f"été {want}, tail", x
        assert n == (want != x)


def test_round_trip_and_links(spark):
    texts = ["+44 212 555 0100 and (212) 555-0199, 212-555-0100; 10.0.0.1 123-45-6789 000-11-2222 666-11-2222 899-99-9999 001-01-0001 2024-02-29 31/12/1999 2001/09/11",
             'token = "1eb9c654e721b4f812088970e66a6345cee33dd6" SECRET: ABCDEF0123456789ABCDEF0123456789 password=' + "0a" * 21 + "b",
             "7536784127813050 4845168114407329", "a\x01b 10.0.0.1 \x01 4845168114407329\x01", "10.0.0.1", "4845168114407329"]
    out = one(spark, texts)
    back = one(spark, [t for t, _ in out], pii.restore)
    assert [t for t, _ in back] == texts
    assert [len(a) for a, _ in out] == [len(t) if "10.0.0.1" not in t else len(a) for (a, _), t in zip(out, texts)]
    mapped = out[4][0]
    assert mapped in out[0][0] and mapped in out[3][0] and mapped != "10.0.0.1"
    assert out[5][0] in out[3][0] and out[5][0] in out[2][0]
    assert "000-11-2222 666-11-2222" in out[0][0]
    assert luhn(out[5][0]) == 0
    assert re.search(r"token = \"[0-9a-f]{40}\" SECRET: [0-9A-F]{32} password=[0-9a-f]{43}$", out[1][0])


def test_emails(spark):
    (a, n), (b, _), (c, _) = one(spark, ["that.92@mail2.example.com### x", "THAT.92@MAIL2.EXAMPLE.COM!!", "çé.x+1@a-b.org, @handle a@b c"])
    assert n == 1 and "that.92" not in a and "mail2" not in a and a.endswith("### x")
    assert a.split("#")[0] == b.split("!")[0]
    assert re.fullmatch(r"u[0-9a-f]{12}@[0-9a-f]{8}\.example, @handle a@b c", c)


def test_left_alone(spark):
    texts = ["Version 2.0 of 1,234,567 in 3.14159265358979 and 1.2.3", "4111111111111112", "300.1.1.1 1.2.3.4.5", "2023-02-29 12345678-1-1", "no digits here", "", "1234567",
             "deadbeefdeadbeefdeadbeefdeadbeef", "+1 555 1234", "12345678901234567890123"]
    assert one(spark, texts) == [(t, 0) for t in texts]


def test_rows_of_every_kind(spark):
    rows = [(1, None, "a"), (1, "10.0.0.1", None), (1, "10.0.0.1", None), (None, "x " * 100_000 + "10.0.0.1", "b"), (2, "", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_pseudonyms string")
    out = pii.pseudonymise(df, KEY)
    assert out.columns == ["doc_id", "text", "n_pseudonyms"]
    got = out.collect()
    assert [r.n_pseudonyms for r in got] == [0, 1, 1, 1, 0] and got[0].text is None and got[4].text == ""
    assert got[1].text == got[2].text and got[3].text.endswith(got[1].text)
    assert pii.pseudonymise(df.limit(0), KEY).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("n", range(2, 5))
def test_permutes_whole_domains(spark, n):
    df = spark.range(10 ** n).selectExpr(f"lpad(cast(id AS string), {n}, '0') AS d")
    got = df.selectExpr("d", pii._digits("d", "'t'", SECRET, False) + " AS p")
    assert got.select("p").distinct().count() == 10 ** n
    assert got.selectExpr("d", pii._digits("p", "'t'", SECRET, True) + " AS b").filter("b <> d").count() == 0
