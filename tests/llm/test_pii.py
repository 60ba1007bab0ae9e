"""Pseudonyms against a plain Python version, round trips and edge rows."""

import datetime
import hashlib
import re

from quire.llm import pii

KEY = "k"
SCHEMA = "doc_id long, text string, n_pii string, extra int"


def draw(label, side, i, value, mod):
    digest = hashlib.sha256("|".join([KEY, label, side, str(i), str(value)]).encode()).hexdigest()
    return int(digest[:15], 16) % mod


def feistel(v, left, right, label):
    a, b = divmod(v, right)
    for i in range(2 * pii.ROUNDS):
        if i % 2 == 0:
            a = (a + draw(label, "a", i, b, left)) % left
        else:
            b = (b + draw(label, "b", i, a, right)) % right
    return a * right + b


def digits(s, label):
    low = len(s) // 2
    return str(feistel(int(s), 10 ** (len(s) - low), 10**low, label + str(len(s)))).zfill(len(s))


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total


def card(s):
    body = s[0] + digits(s[1:-1], "card")
    return body + str(-luhn(body + "0") % 10)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)], SCHEMA)
    out = pii.pseudonymize(df, KEY, **kw)
    assert out.columns == ["doc_id", "text", "extra", "n_pii", *[f"n_{k}" for k in pii.KINDS]]
    return [r.asDict() for r in out.orderBy("doc_id").collect()]


def test_values(spark):
    got = run(spark, [
        "pay 4041894974608795 now", "call +1 (499) 555-6503%%%", "at 97.51.17.173.", "born 1984-02-29, id 123-45-6789",
        "réeux.09@mail8.example.com et", "4041894974608796 1984-02-30 1.2.3.999 v2.0 a12345 2099-12-31",
    ])
    text = [r["text"] for r in got]
    assert text[0] == f"pay {card('4041894974608795')} now" and luhn(text[0].split()[1]) % 10 == 0
    p = digits("4995556503", "phone")
    assert text[1] == f"call +1 ({p[:3]}) {p[3:6]}-{p[6:]}%%%"
    v = feistel(((97 * 256 + 51) * 256 + 17) * 256 + 173, 65536, 65536, "ip")
    assert text[2] == f"at {v >> 24}.{v >> 16 & 255}.{v >> 8 & 255}.{v & 255}."
    assert re.fullmatch(r"born \d{4}-\d{2}-\d{2}, id \d{3}-\d{2}-\d{4}", text[3]) and "1984-02-29" not in text[3]
    assert digits("123456789", "ssn") == re.sub(r"\D", "", text[3].split("id ")[1])
    assert re.fullmatch(r"user\.[0-9a-f]{12}@mail8\.example\.com et", text[4])
    assert text[5].startswith("4041894974608796 1984-02-30 1.2.3.999") and got[5]["n_pii"] == 0
    assert [r["n_pii"] for r in got] == [1, 1, 1, 2, 1, 0]


def test_linked_and_inverse(spark):
    rows = ["a 4041894974608795 b 10.0.0.1", "x 10.0.0.1, 1999-12-31 4041894974608795", "+1 (017) 555-7713 111-22-3333"]
    once = run(spark, rows)
    words = [re.findall(r"[\d.-]{8,}", r["text"]) for r in once]
    assert words[0][0] == words[1][2] and words[0][1] == words[1][0].rstrip(".")
    assert [r["text"] for r in run(spark, [r["text"] for r in once], inverse=True)] == rows


def test_edges(spark):
    long = "word " * 50_000 + "1.2.3.4" + " x" * 10
    got = run(spark, [None, "", "no numbers", "9" * 100_000, "a" * 100_000 + "@", long, long])
    assert got[0]["text"] is None and got[0]["n_pii"] == 0
    assert [r["text"] for r in got[1:5]] == ["", "no numbers", "9" * 100_000, "a" * 100_000 + "@"]
    assert got[5]["text"] == got[6]["text"] and got[5]["n_ip"] == 1 and "1.2.3.4" not in got[5]["text"]
    assert run(spark, []) == []


def test_card_groupings_and_early_dates(spark):
    rows = ["a 3782 822463 10005 b", "3782-822463-10005", "378282246310005", "3056 930902 5904", "3782 822463 10006", "1876-03-02", "0001-01-01 1899-12-31 1900-01-01"]
    got = run(spark, rows)
    v = card("378282246310005")
    assert [r["text"] for r in got[:3]] == [f"a {v[:4]} {v[4:10]} {v[10:]} b", f"{v[:4]}-{v[4:10]}-{v[10:]}", v]
    w = card("30569309025904")
    assert got[3]["text"] == f"{w[:4]} {w[4:10]} {w[10:]}" and luhn(w) % 10 == 0
    assert got[4]["text"] == rows[4] and [r["n_card"] for r in got[:5]] == [1, 1, 1, 1, 0]
    left, right = pii.EARLY_DAYS
    first = datetime.date(1, 1, 1)
    assert left * right == (datetime.date(1900, 1, 1) - first).days
    n = (datetime.date(1876, 3, 2) - first).days
    assert got[5]["text"] == str(first + datetime.timedelta(feistel(n, left, right, "early date")))
    early, last, late = got[6]["text"].split()
    assert early < "1900-01-01" and last < "1900-01-01" <= late and got[6]["n_date"] == 3
    assert [r["text"] for r in run(spark, [r["text"] for r in got], inverse=True)] == rows
