"""Format-preserving pseudonyms, in DataFrame operations only.

One pattern finds addresses, numbers, tokens and dates; each find is validated by its kind, and a keyed Feistel network permutes it
within its kind's format. Each permutation is one to one and stays in its form, so equal values get equal pseudonyms in all
documents and different values different ones.

- E-mail: letters and digits of the local part; its case is dropped.
- Payment card numbers with a right Luhn digit; that digit is kept right.
- Phone numbers: with a plus sign 7 to 15 digits and an assigned country code, which stays. North American ones (10 digits, or 11 after +1): the
  first digits of area and exchange stay within 2-9, or within 0-1, so that dialled numbers remain such.
- IPv4; IBAN with right check digits from 02 to 98 (00, 01 and 99 are what 97, 98 and 02 are, modulo 97, and nobody's), of which the
  digits change and the check digits are kept right.
- US social security numbers that can be given out, among those; taxpayer numbers (9xx) among those; others (area 000 or 666, group 00,
  serial 0000) are nobody's and stay.
- Hexadecimal secrets of 32 to 64 digits, in lower or upper case.
- Dates that the calendar has: yyyy-mm-dd, dd/mm/yyyy, dd.mm.yyyy, or month first where only that is a date. They are permuted in
  eras of 72,900 days; month-first ones among the days after the 12th, in eras of 44,100 such days, so that the two readings
  cannot meet. The first and last years of the calendar (up to 106, from 9873 on) stay.

What fails its validation stays. The key is read as a table of one row, so that it stands in no plan. It comes from the
text file that ``heliograph.pii.key.file`` names; without a key there is an error. The query makes a key of its own, once for the shared folder.

Cases: null text stays null with no finds; empty texts stay; texts of any length are read whole; equal rows give equal rows;
an empty table gives an empty table; other columns, whatever their names, are ignored by :func:`pseudonymise` and kept by
:func:`replace_text`.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import claim_text, claimed_text, documents, exists, only, read_text, shared_root

ROUNDS = 8
FIRST_DAY = "1900-01-01"
#: Halves of an era of days, and of days after the 12th; eras that lie within the calendar; months of the mean length of
#: 146,097 days in 4,800 have so many days after the 12th; the country codes of two digits (1 and 7 have one, all others three).
DAYS, LATE_DAYS, ERAS, LATE_A_MONTH = (270, 270), (210, 210), (-9, 40), 146097 / 4800 - 12
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Assigned country codes of three digits.
THREE_DIGIT_CODES = "21[12368]|2[2346][0-9]|25[0-8]|29[01789]|35[0-9]|37[0-9]|38[0-35-79]|42[013]|50[0-9]|59[0-9]|67[02-9]|68[0-35-9]|69[0-2]|80[08]|85[02356]|87[08]|88[0-368]|96[0-8]|97[0-79]|99[2-68]"
SSN_AREAS, SSN_REST = 898, 99 * 9999
DIGITS, HEX, ALNUM = "0123456789", "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz"
#: The kinds' patterns. They are tried in this order where several fit.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
    "phone": r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}(?![0-9])|(?<![0-9A-Za-z(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,7}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
PATTERN = "|".join(KINDS.values())
#: What every find has in it.
GATE = "[@0-9]|[a-f]{32}|[A-F]{32}"


def char(s: Column, i: Column) -> Column:
    return F.substring(s, i, F.lit(1))


def let(value: Column, f) -> Column:
    """``f(value)`` with the value worked out once."""
    return F.transform(F.array(value), f)[0]


def each_char(s: Column, f) -> Column:
    """``f(character, its place from 1)`` for all characters of ``s`` (a column or lambda variable), joined."""
    return F.when(F.length(s) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: f(char(s, i), i)), "")).otherwise("")


def round_key(key: Column, tweak: Column | str, r: Column, size: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, tweak if isinstance(tweak, Column) else F.lit(tweak), r.cast("string"), size.cast("string"), half), 256)


def shift(s: Column, by: Column, alphabet: str) -> Column:
    """``s`` with each character moved along the alphabet by two hex digits of ``by``."""
    step = lambda by, i: F.conv(F.substring(by, (2 * ((i - 1) % 32) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    place = lambda c: F.instr(F.lit(alphabet), c) - 1
    moved = lambda by: each_char(s, lambda c, i: F.substring(F.lit(alphabet), ((place(c) + step(by, i)) % len(alphabet) + 1).cast("int"), F.lit(1)))
    return let(by, moved)


def feistel(s: Column, alphabet: str, key: Column, tweak: Column | str) -> Column:
    """A keyed permutation of the strings of one length over the alphabet."""
    return let(s, lambda v: _feistel(v, alphabet, key, tweak))


def _feistel(s: Column, alphabet: str, key: Column, tweak: Column | str) -> Column:
    n, half = F.length(s), F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("a"), F.substring(s, half + 1, n).alias("b"))

    def step(st: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, shift(st["a"], round_key(key, tweak, r, n, st["b"]), alphabet)).otherwise(st["a"]).alias("a"),
            F.when(even, st["b"]).otherwise(shift(st["b"], round_key(key, tweak, r, n, st["a"]), alphabet)).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda st: F.concat(st["a"], st["b"]))


def put_back(form: Column, new: Column, kept: str) -> Column:
    """``form`` with its k-th character of class ``kept`` replaced by the k-th of ``new``."""
    place = lambda i: F.length(F.regexp_replace(F.substring(form, F.lit(1), i), f"[^{kept}]", ""))
    return let(new, lambda v: each_char(form, lambda c, i: F.when(c.rlike(f"[{kept}]"), char(v, place(i))).otherwise(c)))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_sum(s: Column, doubled_last: bool) -> Column:
    """The Luhn sum of a digit string whose last digit is doubled or not."""

    def total(v: Column) -> Column:
        def add(t: Column, i: Column) -> Column:
            d = char(v, i).cast("int")
            twice = (F.length(v) - i) % 2 == F.lit(0 if doubled_last else 1)
            return t + F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), F.length(v)), F.lit(0), add)

    return let(s, total)


def mod97(s: Column) -> Column:
    """The value of an IBAN-like string (A is 10) modulo 97."""

    def total(v: Column) -> Column:
        def add(r: Column, i: Column) -> Column:
            d = F.instr(F.lit(ALNUM.upper()), char(v, i)) - 1
            return F.when(d < 10, (r * 10 + d) % 97).otherwise((r * 100 + d) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(v)), F.lit(0), add)

    return let(s, total)


def permuted(n: Column, halves: tuple[int, int], key: Column, tweak: Column | str) -> Column:
    """A keyed permutation of the numbers below the product of two others."""
    a, b = halves
    start = F.struct(F.floor(n / b).cast("int").alias("a"), (n % b).cast("int").alias("b"))
    draw = lambda r, x: F.conv(F.substring(round_key(key, tweak, r, F.lit(a * b), x.cast("string")), F.lit(1), F.lit(8)), 16, 10).cast("bigint")

    def step(st: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, ((st["a"] + draw(r, st["b"])) % a).cast("int")).otherwise(st["a"]).alias("a"),
            F.when(even, st["b"]).otherwise(((st["b"] + draw(r, st["a"])) % b).cast("int")).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda st: st["a"] * b + st["b"])


def in_era(n: Column, halves: tuple[int, int], key: Column, tweak: str, otherwise, then) -> Column:
    """``then`` of a number (below zero, too) permuted in its era; ``otherwise`` beyond the eras."""
    size = halves[0] * halves[1]
    era = F.floor(n / size).cast("int")
    inside = (era >= ERAS[0]) & (era < ERAS[1])
    return F.when(inside, let(era * size + permuted(F.pmod(n, F.lit(size)), halves, key, F.concat(F.lit(tweak), era.cast("string"))), then)).otherwise(otherwise)


def date(m: Column, key: Column) -> Column:
    """The pseudonym of a date, or what is no date itself."""
    first = F.to_date(F.lit(FIRST_DAY))
    read = lambda form: F.try_to_timestamp(m, F.lit(form)).cast("date")
    out = m
    for sep, sign in ((".", r"\."), ("/", "/")):
        day_first, month_first = f"dd{sep}MM{sep}yyyy", f"MM{sep}dd{sep}yyyy"

        def early(day: Column, form: str = day_first) -> Column:
            return in_era(F.datediff(day, first), DAYS, key, "date", m, lambda n: F.date_format(F.date_add(first, n.cast("int")), form))

        def late(day: Column, form: str = month_first) -> Column:
            # days after the 12th, counted on from month to month
            month = (F.year(day) - 1900) * 12 + F.month(day) - 1
            begin = lambda k: F.datediff(F.add_months(first, k), first) - 12 * k

            def back(n: Column) -> Column:
                guess = F.floor(n / LATE_A_MONTH).cast("int")
                k = F.array_max(F.filter(F.sequence(guess - 2, guess + 2), lambda k: begin(k) <= n))
                return let(k, lambda k: F.date_format(F.date_add(F.add_months(first, k), (n - begin(k) + 12).cast("int")), form))

            return let(month, lambda k: in_era(begin(k) + F.dayofmonth(day) - 13, LATE_DAYS, key, "late date", m, back))

        either = let(read(day_first), lambda d: F.when(d.isNotNull(), early(d)).otherwise(let(read(month_first), lambda e: F.when(e.isNotNull(), late(e)).otherwise(m))))
        out = F.when(m.rlike(sign), either).otherwise(out)
    iso = let(read("yyyy-MM-dd"), lambda d: F.when(d.isNotNull(), in_era(F.datediff(d, first), DAYS, key, "date", m, lambda n: F.date_format(F.date_add(first, n.cast("int")), "yyyy-MM-dd"))).otherwise(m))
    return F.when(m.rlike("^[0-9]{4}-"), iso).otherwise(out)


def phone(m: Column, key: Column) -> Column:
    d = digits_of(m)
    plus = m.startswith("+")
    code = F.when(~plus, F.lit("")).when(d.rlike("^[17]"), F.substring(d, 1, 1)).when(F.substring(d, 1, 2).isin(TWO_DIGIT_CODES), F.substring(d, 1, 2)).otherwise(F.substring(d, 1, 3))

    def american(n: Column) -> Column:
        rest = feistel(F.concat(F.substring(n, 2, 2), F.substring(n, 5, 6)), DIGITS, key, "phone")

        def whole(r: Column) -> Column:
            def lead(c: Column, place: int) -> Column:
                by = F.conv(F.substring(round_key(key, "phone", F.lit(place), F.lit(10), r), F.lit(1), F.lit(8)), 16, 10).cast("bigint")
                x = c.cast("int")
                return F.when(x >= 2, (x - 2 + by) % 8 + 2).otherwise((x + by) % 2).cast("string")

            return F.concat(lead(F.substring(n, 1, 1), ROUNDS), F.substring(r, 1, 2), lead(F.substring(n, 4, 1), ROUNDS + 1), F.substring(r, 3, 6))

        return let(rest, whole)

    def placed(c: Column) -> Column:
        national = F.substring(d, F.length(c) + 1, F.length(d))
        new = F.when((F.length(national) == 10) & (~plus | (c == "1")), let(national, american)).otherwise(feistel(national, DIGITS, key, F.concat(F.lit("phone"), c)))
        return put_back(m, F.concat(c, new), "0-9")

    assigned = F.length(code).between(1, 2) | code.rlike(f"^(?:{THREE_DIGIT_CODES})$")
    return F.when(~plus | F.length(d).between(7, 15) & assigned, let(code, placed)).otherwise(m)


def ssn(m: Column, key: Column) -> Column:
    d = digits_of(m)
    area, group, serial = (F.substring(d, a, n).cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
    given = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = (area - 1 - (area > 666).cast("int")).cast("bigint") * SSN_REST + (group - 1) * 9999 + serial - 1

    def number(x: Column) -> Column:
        a, rest = F.floor(x / SSN_REST), x % SSN_REST
        pad = lambda v, n: F.lpad(v.cast("int").cast("string"), n, "0")
        return F.concat(pad(a + 1 + (a >= 665).cast("int"), 3), F.lit("-"), pad(F.floor(rest / 9999) + 1, 2), F.lit("-"), pad(rest % 9999 + 1, 4))

    new = let(permuted(index, (SSN_AREAS, SSN_REST), key, "ssn"), number)
    tax = put_back(m, F.concat(F.lit("9"), feistel(F.substring(d, 2, 8), DIGITS, key, "taxpayer")), "0-9")
    return F.when(given, new).when(area >= 900, tax).otherwise(m)


def pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of one find, or the find itself where it is not valid."""
    is_kind = lambda k: m.rlike("^(?:" + KINDS[k] + ")$")
    # e-mail
    local = F.lower(F.substring_index(m, "@", 1))
    email = F.concat(put_back(local, feistel(F.regexp_replace(local, "[^0-9a-z]", ""), ALNUM, key, "email"), "0-9a-z"), F.lit("@"), F.substring_index(m, "@", -1))
    # cards
    d = digits_of(m)
    body = feistel(F.substring(d, F.lit(1), F.length(d) - 1), DIGITS, key, "card")
    card = put_back(m, let(body, lambda b: F.concat(b, ((10 - luhn_sum(b, True) % 10) % 10).cast("string"))), "0-9")
    # IPv4 as eight hex digits
    octets = F.array_join(F.transform(F.split(m, r"\."), lambda o: F.lpad(F.lower(F.conv(o, 10, 16)), 2, "0")), "")
    ip = let(feistel(octets, HEX, key, "ip"), lambda x: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7), F.lit(2)), lambda i: F.conv(F.substring(x, i, F.lit(2)), 16, 10)), "."))
    # IBAN
    rest = F.substring(m, F.lit(5), F.length(m))
    new_rest = put_back(rest, feistel(digits_of(rest), DIGITS, key, "iban"), "0-9")
    country = F.substring(m, 1, 2)
    iban = let(new_rest, lambda r: F.concat(country, F.lpad((98 - mod97(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0"), r))
    secret = feistel(F.lower(m), HEX, key, "secret")
    return (
        F.when(is_kind("email"), email)
        .when(is_kind("iban"), F.when(F.substring(m, 3, 2).between("02", "98") & (mod97(F.concat(rest, F.substring(m, 1, 4))) == 1), iban).otherwise(m))
        .when(is_kind("secret"), F.when(m.rlike("[A-F]"), F.upper(secret)).otherwise(secret))
        .when(is_kind("ip"), ip)
        .when(is_kind("date"), date(m, key))
        .when(is_kind("ssn"), ssn(m, key))
        .when(is_kind("card"), F.when(luhn_sum(d, False) % 10 == 0, card).otherwise(m))
        .otherwise(phone(m, key))
    )


def replaced(text: Column, key: Column) -> Column:
    """A struct of the text with pseudonyms and how many values were replaced."""
    # Only texts that pass the gate are searched; the finds stand between the pieces that the pattern splits off.
    finds = F.regexp_extract_all(text, F.lit(f"({PATTERN})"), 1)

    def rebuilt(old: Column, new: Column) -> Column:
        joined = F.array_join(F.flatten(F.zip_with(F.split(text, PATTERN, -1), new, lambda p, v: F.array(p, F.coalesce(v, F.lit(""))))), "")
        changed = F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x)).cast("bigint")
        return F.struct(joined.alias("text"), changed.alias("n"))

    same = F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("n"))
    search = let(finds, lambda old: F.when(F.size(old) > 0, let(F.transform(old, lambda m: pseudonym(m, key)), lambda new: rebuilt(old, new))).otherwise(same))
    return F.when(text.rlike(GATE), search).otherwise(same)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (stem + "_" * k for k in range(len(taken) + 1)) if n not in taken)


def key_table(spark: SparkSession, key: str | None = None, key_file: str | None = None) -> DataFrame:
    """The key as a table of one row."""
    if key:
        return spark.createDataFrame([(key,)], "value string")
    path = key_file or spark.conf.get("heliograph.pii.key.file", None)
    if not path:
        raise ValueError("there is no key; name a file with one line in heliograph.pii.key.file")
    if not read_text(spark, path).strip():
        raise ValueError(f"there is no key in {path}")
    return spark.read.text(path).where("trim(value) != ''").agg(F.min("value").alias("value"))


def own_key_file(spark: SparkSession) -> str:
    """The configured key file, or a file in the shared folder that gets a new key the first time. One writer alone can create it,
    nobody replaces it, and only its owner can read it; executors run as that user."""
    path = spark.conf.get("heliograph.pii.key.file", None) or f"{shared_root(spark)}/pii-key"
    if not exists(spark, path):
        claim_text(spark, path, secrets.token_hex(32))
    claimed_text(spark, path)  # another writer may still be at it
    return path


def with_new(df: DataFrame, key: DataFrame) -> tuple[DataFrame, str]:
    """The table with a column of the new text and the number of finds replaced, worked out once a row."""
    k = free_name(df, "key")
    keyed = df.withColumn(k, key.scalar())
    new = free_name(keyed, "new")
    return keyed.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(F.array(replaced(F.col("text"), F.col(k)))).alias(new)), new


def pseudonymise(docs: DataFrame, key: str | None = None, key_file: str | None = None) -> DataFrame:
    """doc_id, text with pseudonyms, and the number of values that got one."""
    src = only(docs, "doc_id", "text")
    done, new = with_new(src.select(src["doc_id"].cast("bigint").alias("doc_id"), "text"), key_table(docs.sparkSession, key, key_file))
    return done.select("doc_id", F.col(f"{new}.text").alias("text"), F.col(f"{new}.n").alias("n_replaced"))


def replace_text(docs: DataFrame, key: str | None = None, key_file: str | None = None) -> DataFrame:
    """The documents, whatever their columns, with pseudonyms in their texts."""
    done, new = with_new(docs, key_table(docs.sparkSession, key, key_file))
    return done.select(*[F.col(f"{new}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir), key_file=own_key_file(spark))
