import datetime as dt
import hashlib
import random
import re

from heliograph.llm import pii
from heliograph.llm.common import read_text

KEY = "k"


def h(tweak, r, n, x):
    return hashlib.sha256(f"{KEY}|{tweak}|{r}|{n}|{x}".encode()).hexdigest()


def feistel(s, alphabet, tweak):
    k, n = len(s) // 2, len(s)
    a, b = s[:k], s[k:]
    move = lambda x, f: "".join(alphabet[(alphabet.index(c) + int(f[2 * (i % 32) : 2 * (i % 32) + 2], 16)) % len(alphabet)] for i, c in enumerate(x))
    for r in range(pii.ROUNDS):
        if r % 2 == 0:
            a = move(a, h(tweak, r, n, b))
        else:
            b = move(b, h(tweak, r, n, a))
    return a + b


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (2 if i % 2 else 1)
        t += d - 9 * (d > 9)
    return t % 10


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def back(form, new, kept):
    it = iter(new)
    return re.sub(f"[{kept}]", lambda _: next(it), form)


def permuted(n, a, b, tweak):
    x, y = divmod(n, b)
    for r in range(pii.ROUNDS):
        if r % 2 == 0:
            x = (x + int(h(tweak, r, a * b, y)[:8], 16)) % a
        else:
            y = (y + int(h(tweak, r, a * b, x)[:8], 16)) % b
    return x * b + y


def era(n, a, b, tweak):
    e, r = divmod(n, a * b)
    return e * a * b + permuted(r, a, b, f"{tweak}{e}") if -9 <= e < 40 else None


FIRST = dt.date(1900, 1, 1)
MONTHS = [dt.date(y, m, 1) for y in range(1880, 2140) for m in range(1, 13)]
LATE = [(d - FIRST).days - 12 * ((d.year - 1900) * 12 + d.month - 1) for d in MONTHS]  # days after the 12th before each month


def date(m):
    for form, late in (("%Y-%m-%d", False), ("%d/%m/%Y", False), ("%m/%d/%Y", True), ("%d.%m.%Y", False), ("%m.%d.%Y", True)):
        try:
            d = dt.datetime.strptime(m, form).date()
        except ValueError:
            continue
        if not late:
            n = era((d - FIRST).days, 270, 270, "date")
            return m if n is None else (FIRST + dt.timedelta(n)).strftime(form).rjust(10, "0")
        n = era(LATE[MONTHS.index(d.replace(day=1))] + d.day - 13, 210, 210, "late date")
        k = max(k for k in range(len(LATE)) if LATE[k] <= n)
        return MONTHS[k].replace(day=n - LATE[k] + 13).strftime(form)
    return m


def ssn(d):
    a, g, s = int(d[:3]), int(d[3:5]), int(d[5:])
    if a >= 900:
        return "9" + feistel(d[1:], pii.DIGITS, "taxpayer")
    if a in (0, 666) or not g or not s:
        return d
    areas = [x for x in range(1, 900) if x != 666]
    x, rest = divmod(permuted(areas.index(a) * 99 * 9999 + (g - 1) * 9999 + s - 1, 898, 99 * 9999, "ssn"), 99 * 9999)
    return f"{areas[x]:03d}{rest // 9999 + 1:02d}{rest % 9999 + 1:04d}"


def phone(m, d):
    plus = m.startswith("+")
    if plus and not 7 <= len(d) <= 15:
        return d
    code = "" if not plus else d[:1] if d[0] in "17" else d[:2] if d[:2] in pii.TWO_DIGIT_CODES else d[:3]
    if len(code) == 3 and not re.fullmatch(pii.THREE_DIGIT_CODES, code):
        return d
    n = d[len(code) :]
    if len(n) == 10 and code in ("", "1"):
        r = feistel(n[1:3] + n[4:], pii.DIGITS, "phone")
        lead = lambda c, k: str((int(c) - 2 + int(h("phone", k, 10, r)[:8], 16)) % 8 + 2 if c > "1" else (int(c) + int(h("phone", k, 10, r)[:8], 16)) % 2)
        return code + lead(n[0], pii.ROUNDS) + r[:2] + lead(n[3], pii.ROUNDS + 1) + r[2:]
    return code + feistel(n, pii.DIGITS, "phone" + code)


def one(m):
    kind = next(k for k in ("email", "iban", "secret", "ip", "date", "ssn", "card", "phone") if re.fullmatch(pii.KINDS[k], m))
    d = re.sub("[^0-9]", "", m)
    if kind == "email":
        local, host = m.lower().split("@")[0], m.split("@")[-1]
        return back(local, feistel(re.sub("[^0-9a-z]", "", local), pii.ALNUM, "email"), "0-9a-z") + "@" + host
    if kind == "iban":
        if mod97(m[4:] + m[:4]) != 1 or not 2 <= int(m[2:4]) <= 98:
            return m
        rest = back(m[4:], feistel(re.sub("[^0-9]", "", m[4:]), pii.DIGITS, "iban"), "0-9")
        return m[:2] + f"{98 - mod97(rest + m[:2] + '00'):02d}" + rest
    if kind == "secret":
        new = feistel(m.lower(), pii.HEX, "secret")
        return new.upper() if re.search("[A-F]", m) else new
    if kind == "ip":
        x = feistel("".join(f"{int(o):02x}" for o in m.split(".")), pii.HEX, "ip")
        return ".".join(str(int(x[i : i + 2], 16)) for i in range(0, 8, 2))
    if kind == "date":
        return date(m)
    if kind == "ssn":
        return back(m, ssn(d), "0-9")
    if kind == "card":
        if luhn(d):
            return m
        body = feistel(d[:-1], pii.DIGITS, "card")
        return back(m, body + str((10 - luhn(body + "0")) % 10), "0-9")
    return back(m, phone(m, d), "0-9")


def brute(text):
    n = 0

    def sub(m):
        nonlocal n
        new = one(m[0])
        n += new != m[0]
        return new

    return (None, 0) if text is None else (re.sub(pii.PATTERN, sub, text), n)


CASES = ["a.B+c@mail.example.com", "x@y.zz.", "4532015112830366", "4532 0151 1283 0366", "4532015112830367", "3782-822463-10005", "+1 (974) 555-3436", "+49 30 1234 5678", "974-555-3436", "152.143.123.131", "256.1.1.1", "1.2.3.4.5", "123-45-6789",
         "GB82WEST12345698765432", "GB83WEST12345698765432", "DE89370400440532013000", "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde", "2ABC3FF2CA8FB1E4C565A0EB63815530A948BDDE", "2aBC3FF2CA8FB1E4C565A0EB63815530A948BDDE", "+353 1 234 5678", "+44 20 7946 0958", "+12 34 56", "054-155-3436", "666-12-3456", "900-70-1234", "000-12-3456", "665-01-0001", "899-99-9999", "12/13/2023", "13.12.1899", "02/29/2000", "07/31/2024", "0050-01-01", "2024-02-29", "2023-02-29", "31/12/1999", "12/31/1999", "01.02.2003", "1850-01-01", "2099-12-31", "99/99/9999", "1234567890123"]


def test_brute_force_and_edge_cases(spark):
    random.seed(4)
    rows = [(i, c) for i, c in enumerate(CASES)] + [(100 + i, " ".join(random.choice([*CASES, "the", "é,", "\n", "42"]) for _ in range(12))) for i in range(40)]
    rows += [(200, None), (201, ""), (202, "word " * 30000 + CASES[0]), (None, CASES[2]), (5, CASES[2]), (5, CASES[2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n_replaced int")
    got = sorted(map(tuple, pii.pseudonymise(df, KEY).collect()), key=repr)
    want = sorted([(i, *brute(t)) for i, t in rows], key=repr)
    for g, w in zip(got, want):
        assert g == w
    assert pii.replace_text(df, KEY).columns == df.columns
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id bigint, text string"), KEY).count() == 0


def test_one_to_one():
    assert len({one(f"{a:03d}-{b:02d}-0007") for a in range(60) for b in range(30)}) == 1800
    assert len({permuted(n, 270, 270, "date0") for n in range(72900)}) == 72900
    areas = {one(f"{a:03d}-12-3456")[:3] for a in (*range(1, 666), *range(667, 900))}
    assert not areas & {"000", "666"} and max(areas) < "900"
    phones = [one(f"+1 ({a}) {e}-3436") for a in range(200, 900, 50) for e in (205, 555, 999)]
    assert len(set(phones)) == 42 and all(re.fullmatch(r"\+1 \([2-9]..\) [2-9]..-....", x) for x in phones) and one("+49 30 1234 5678").startswith("+49 ")


def test_days_of_all_forms_are_permuted_one_to_one(spark):
    """Both readings of slashed and dotted dates, for every day of 200 years, by the operator itself."""
    days = spark.sql("SELECT explode(sequence(DATE '1900-01-01', DATE '2099-12-31')) AS d")
    forms = days.selectExpr("date_format(d, 'dd/MM/yyyy') AS text").unionByName(days.selectExpr("date_format(d, 'MM/dd/yyyy') AS text")).distinct()
    table = forms.selectExpr("CAST(0 AS BIGINT) AS doc_id", "text")
    out = pii.pseudonymise(table, "k").select("text")
    n = table.count()
    assert n > 73_000 and out.distinct().count() == n
    late = out.where("substr(text, 4, 2) > '12'").count()
    assert late == table.where("substr(text, 4, 2) > '12'").count()


def test_key(spark, tmp_path):
    df = spark.createDataFrame([(1, "x@y.zz", "a", "b", "c")], "doc_id bigint, text string, `new` string, `key` string, `__new` string")
    import pytest

    with pytest.raises(ValueError, match="no key"):
        pii.pseudonymise(df)
    (tmp_path / "key").write_text("a very secret key\n")
    one_ = pii.replace_text(df, key_file=str(tmp_path / "key"))
    assert one_.columns == df.columns and one_.collect() == pii.replace_text(df, "a very secret key").collect()
    for out in (one_, pii.pseudonymise(df, "a very secret key")):
        assert "very secret" not in out._jdf.queryExecution().toString()
    assert pii.own_key_file(spark) == pii.own_key_file(spark)


def test_only_valid_values_get_pseudonyms(spark):
    """Check digits that pass modulo 97 beside the right ones; country codes that nobody has."""
    pairs = []
    for odd, right in (("00", "97"), ("01", "98"), ("99", "02")):
        body = next(f"{k:018d}" for k in range(10**6) if mod97(f"{k:018d}DE{odd}") == 1)
        assert mod97(body + "DE" + right) == 1
        pairs.append((f"DE{odd}{body}", f"DE{right}{body}"))
    stay = ["+0 12 34 567", "+999 1234 5678", "+210 123 4567", "+384 123 4567", "+671 123 4567"]
    change = ["+44 20 7946 0958", "+353 86 123 4567", "+998 71 123 4567", "+7 495 123 4567"]
    texts = [x for p in pairs for x in p] + stay + change
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(df, "k").collect()}
    got = {t: got[i] for i, t in enumerate(texts)}
    for odd, right in pairs:
        assert got[odd] == odd and got[right] != right
    assert len(set(got.values())) == len(texts)
    assert [t for t in stay if got[t] != t] == [] == [t for t in change if got[t] == t]


def test_the_own_key_is_its_owners(spark):
    import os

    path = pii.own_key_file(spark).removeprefix("file://")
    if os.path.exists(path):
        assert os.stat(path).st_mode & 0o77 == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    global KEY
    KEY = read_text(spark, pii.own_key_file(spark)).strip()
    got = pii.op3_pii(spark, sf)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and KEY not in plan
    rows = got.collect()
    assert len(rows) == len(docs) and sum(r.n_replaced for r in rows) > 0
    for r in rows:
        assert (r.text, r.n_replaced) == brute(docs[r.doc_id])
    KEY = "k"
