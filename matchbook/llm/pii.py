"""Format-preserving pseudonyms for personal data.

One pattern finds the candidates of a text from left to right; a validated
value is replaced in place by a keyed permutation of itself within its format,
so equal values stay equal (linked) in every document and different values of
one format stay different:

* card numbers whose issuer, length and Luhn check digit are right, in one piece or
  in the groups they are printed in: the first four digits, which name the issuer,
  stay, the digits between are permuted, the check digit is computed anew.  Other
  long numbers (time stamps, order numbers) stay as they are
* IBANs whose check digits are right, in one piece or printed in groups of four:
  the account part is permuted, the check digits are computed anew, the groups
  stay, so both spellings of one account stay linked
* phone numbers of the North American plan (3-3-4 with separators, or ``+1`` before
  it; ten digits in one piece only after a word like ``call``, ``phone`` or ``tel``, and if
  area code and exchange begin with 2 to 9) and international ones (``+``, 7 to 15
  digits in any groups): the digits after the country code are permuted and put back
  in their places, so the spellings of one number stay linked.  Country codes, a
  trunk ``(0)`` and whether area code and exchange begin with 0 or 1 stay
* social-security numbers that can have been given out (area 001 to 899 without 666,
  group from 01, serial from 0001): a permutation of these numbers
* the local part of e-mail addresses: digits, lower-case and upper-case letters stay
  in their class, the rest stays
* IPv4 addresses with octets up to 255: a permutation of the 2^32 addresses
* real dates (``yyyy-mm-dd``, ``dd.mm.yyyy``, ``mm/dd/yyyy``) of 1800 to 2199:
  a permutation of the 146,097 days of that calendar cycle

The network is a Feistel network: half of the value shifts the other half by
a SHA-256 stream of key, kind, round and half.  Everything is built-in
functions in the row: no shuffle, no Python.

Who has the key can undo the permutation.  ``pseudonymise`` takes it from its
caller; the query reads ``KEY_CONF`` of the session and falls back to ``DEMO_KEY``,
which is public and protects nothing.

Defined cases: null text stays null with no findings; an empty text is
unchanged; values that fail validation (impossible dates, octets over 255,
wrong check digits, unknown issuers, social-security numbers never given out)
stay as they are, as do national phone numbers of other
plans without their country code; digits that follow an international number
after a single space count as part of it up to 15; a text is worked on whole, in
memory of a few times its length; repeated rows get equal results and all stay; an
empty table gives an empty result; extra columns pass through, ``n_pii`` and
``pii_kinds`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.llm.common import table
from matchbook.llm.spans import let

KEY_CONF = "spark.matchbook.pii.key"
DEMO_KEY = "matchbook-pseudonyms"
ROUNDS = 8                     # even, so the halves end in their places
NOT_IN = r"(?<![A-Za-z0-9])"
NOT_ON = r"(?![A-Za-z0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
ISO_DATE = r"(?<![A-Za-z0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![A-Za-z0-9-])"
DAY_DATE = NOT_IN + r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}" + NOT_ON
US_DATE = NOT_IN + r"[0-9]{2}/[0-9]{2}/[0-9]{4}" + NOT_ON
IP = r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9])(?!\.[0-9])"
SSN = r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"
PLUS_ONE = r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ ./-]?[0-9]{3}[ ./-]?[0-9]{4}"
DIALLED = (r"\+(?=(?:[^0-9A-Za-z+]{0,3}[0-9]){7})[1-9](?:[ ./-]?[0-9]){0,3}(?: ?\((?:0|[0-9]{2,5})\))?"
           r"(?:[ ./-]?[0-9]){4,11}")
SPLIT_PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}"
PLAIN_PHONE = r"1?[2-9][0-9]{2}[2-9][0-9]{6}"
# words before a number without separators that say it is a phone number
CALL_WORDS = ("call tel phone telephone mobile cell fax sms whatsapp telefon handy mobil anrufen rufnummer "
              "téléphone portable appelez teléfono telefono móvil movil llame").split()
AFTER_WORD = r"(?<=(?<![\p{L}0-9])(?iu:" + "|".join(CALL_WORDS) + r")[ .:#]{1,3})"
PHONE_FORMS = "(?:" + "|".join(p + NOT_ON for p in (PLUS_ONE, DIALLED, SPLIT_PHONE, PLAIN_PHONE)) + ")"
PHONE = NOT_IN + "(?:" + "|".join(p + NOT_ON for p in (PLUS_ONE, DIALLED, SPLIT_PHONE, "(?=1?[2-9])" + AFTER_WORD + PLAIN_PHONE)) + ")"
# country codes of one and two digits; all others have three
SHORT_CODES = "^[17]"
TWO_DIGIT_CODES = "^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
# countries by the length of their IBAN
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
                21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
                24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
                28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
                32: "LC", 33: "RU"}
GROUPED_IBAN = NOT_IN + "(?=[A-Z]{2}[0-9]{2} )(?:" + "|".join(
    f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, countries in IBAN_LENGTHS.items()) + ")" + NOT_ON
IBAN = NOT_IN + r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}" + NOT_ON
# first digits of card issuers and the lengths of their numbers
ISSUERS = {"4": (13, 16, 19), "5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)": (16,), "3[47]": (15,),
           "3(?:0[0-5]|[689])": (14,), "6(?:011|4[4-9]|5|2)|35(?:2[89]|[3-8])": (16, 17, 18, 19)}
CARD_GROUPS = {14: "[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{4}", 15: "[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}",
               16: "[0-9]{4}(?:[ -]?[0-9]{4}){3}"}
CARD = NOT_IN + "(?:" + "|".join(
    f"(?={first})(?:" + "|".join(CARD_GROUPS.get(n, f"[0-9]{{{n}}}") + NOT_ON for n in lengths) + ")"
    for first, lengths in ISSUERS.items()) + ")"
# what begins like no number and no IBAN is only tried as an address
ANY = (EMAIL + "|(?=[0-9+(])(?:" + "|".join((ISO_DATE, DAY_DATE, US_DATE, IP, SSN, CARD, PHONE)) + ")"
       "|(?=[A-Z]{2}[0-9]{2})(?:" + GROUPED_IBAN + "|" + IBAN + ")")

FIRST_DAY, DAY_A, DAY_B = "1800-01-01", 27, 5411      # 27 * 5411 = 146,097 days
KINDS = ("email", "date", "ip", "ssn", "phone", "card", "iban")


def _number(key: str, kind: str, r: Column, half: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")


def _rounds(inverse: bool) -> Column:
    return F.array(*[F.lit(r) for r in (range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS))])


def _shift(half: Column, stream: Column, sign: int) -> Column:
    """Every letter and digit of ``half`` moved within its class."""
    def move(ch: Column, i: Column) -> Column:
        k = F.conv(F.substring(stream, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")

        def within(first: int, n: int) -> Column:
            return F.char(F.lit(first) + F.pmod(F.ascii(ch) - first + sign * k, F.lit(n)))
        return (F.when(ch.between("0", "9"), within(48, 10)).when(ch.between("a", "z"), within(97, 26))
                 .when(ch.between("A", "Z"), within(65, 26)).otherwise(ch))
    chars = F.filter(F.split(half, ""), lambda ch: ch != "")
    return F.array_join(F.transform(chars, move), "")


def permute_text(value: Column, kind: str, key: str, inverse: bool = False) -> Column:
    """Keyed permutation of the strings with the character classes of ``value``."""
    cut = F.floor(F.length(value) / 2).cast("int")
    halves = F.struct(F.substring(value, F.lit(1), cut).alias("a"),
                      F.substring(value, cut + 1, F.length(value)).alias("b"))

    def stream(r: Column, half: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), half), 256)

    def forth(acc: Column, r: Column) -> Column:
        return F.struct(acc["b"].alias("a"), _shift(acc["a"], stream(r, acc["b"]), 1).alias("b"))

    def back(acc: Column, r: Column) -> Column:
        return F.struct(_shift(acc["b"], stream(r, acc["a"]), -1).alias("a"), acc["a"].alias("b"))
    return F.aggregate(_rounds(inverse), halves, back if inverse else forth,
                       lambda acc: F.concat(acc["a"], acc["b"]))


def permute_pair(a: Column, b: Column, n_a: int | Column, n_b: int | Column, kind: str, key: str,
                 inverse: bool = False) -> Column:
    """Keyed permutation of the pairs (a, b) with a < n_a, b < n_b."""
    sign = -1 if inverse else 1

    def shift_a(acc: Column, r: Column) -> Column:
        return F.pmod(acc["a"] + sign * F.pmod(_number(key, kind, 2 * r, acc["b"]), F.lit(n_a)), F.lit(n_a))

    def step(acc: Column, r: Column) -> Column:
        def after_a(x: Column) -> Column:
            y = F.pmod(acc["b"] + sign * F.pmod(_number(key, kind, 2 * r + 1, x), F.lit(n_b)), F.lit(n_b))
            return F.struct(x.alias("a"), y.alias("b"))

        def after_b(y: Column) -> Column:
            x = F.pmod(acc["a"] + sign * F.pmod(_number(key, kind, 2 * r, y), F.lit(n_a)), F.lit(n_a))
            return F.struct(x.alias("a"), y.alias("b"))
        if inverse:
            return let(F.pmod(acc["b"] + sign * F.pmod(_number(key, kind, 2 * r + 1, acc["a"]), F.lit(n_b)),
                              F.lit(n_b)), after_b)
        return let(shift_a(acc, r), after_a)
    zero = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(_rounds(inverse), zero, step)


def _luhn_digit(digits: Column) -> Column:
    """The check digit that belongs after ``digits``."""
    def add(ch: Column, i: Column) -> Column:
        d = ch.cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)
    chars = F.filter(F.split(F.reverse(digits), ""), lambda ch: ch != "")
    total = F.aggregate(F.transform(chars, add), F.lit(0), lambda acc, d: acc + d)
    return F.pmod(-total, F.lit(10))


def _refill(shape: Column, digits: Column, place=lambda ch: ch.between("0", "9")) -> Column:
    """``shape`` with its digits (or other places) replaced by ``digits`` in order."""
    chars = F.filter(F.split(shape, ""), lambda ch: ch != "")
    zero = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def put(acc: Column, ch: Column, digits: Column) -> Column:
        return F.struct((acc["i"] + place(ch).cast("int")).alias("i"), F.concat(
            acc["out"], F.when(place(ch), F.substring(digits, acc["i"] + 1, F.lit(1))).otherwise(ch)).alias("out"))
    return let(digits, lambda made: F.aggregate(chars, zero, lambda acc, ch: put(acc, ch, made), lambda acc: acc["out"]))


def permute_nanp(digits: Column, key: str, inverse: bool = False) -> Column:
    """Keyed permutation of the 10 digits of a number of the North American
    plan; area code and exchange that begin with 2 to 9 go on doing so."""
    def work(d: Column) -> Column:
        def first(at: int) -> Column:
            return F.when(F.substring(d, at, 1) >= "2", 2).otherwise(0)

        def n(at: int) -> Column:
            return F.when(F.substring(d, at, 1) >= "2", 8).otherwise(2)
        a = F.substring(d, 1, 3).cast("long") - first(1) * 100
        b = F.substring(d, 4, 7).cast("long") - first(4) * 1_000_000
        pair = permute_pair(a, b, n(1) * 100, n(4) * 1_000_000, "phone", key, inverse)
        return let(pair, lambda p: F.concat(F.lpad((p["a"] + first(1) * 100).cast("string"), 3, "0"),
                                            F.lpad((p["b"] + first(4) * 1_000_000).cast("string"), 7, "0")))
    return let(digits, work)


def permute_phone(value: Column, key: str, inverse: bool = False) -> Column:
    shape = F.regexp_replace(value, r"\(0\)", "(o)")

    def work(digits: Column) -> Column:
        american = ~value.startswith("+") | digits.rlike("^[01]")
        code = (F.when(american & (F.length(digits) >= 10), F.length(digits) - 10)
                 .when(digits.rlike(SHORT_CODES), 1).when(digits.rlike(TWO_DIGIT_CODES), 2).otherwise(3))
        # +1 and other than ten digits is no American number
        code = F.when(value.startswith("+1") & (F.length(digits) != 11), 1).otherwise(code)
        rest = F.substring(digits, code + 1, F.length(digits))
        new = F.when(american & (F.length(rest) == 10), permute_nanp(rest, key, inverse)).otherwise(
            permute_text(rest, "phone", key, inverse))
        return F.concat(F.substring(digits, F.lit(1), code), new)
    made = let(F.regexp_replace(shape, "[^0-9]", ""), lambda digits: _refill(shape, work(digits)))
    return F.regexp_replace(made, r"\(o\)", "(0)")


def permute_card(value: Column, key: str, inverse: bool = False) -> Column:
    """Of a number whose last digit is its Luhn check digit; others stay."""
    def work(digits: Column) -> Column:
        body = F.substring(digits, F.lit(1), F.length(digits) - 1)
        valid = _luhn_digit(body) == F.right(digits, F.lit(1)).cast("int")
        between = permute_text(F.substring(body, F.lit(5), F.length(body)), "card", key, inverse)
        renewed = let(F.concat(F.substring(body, 1, 4), between),
                      lambda new: _refill(value, F.concat(new, _luhn_digit(new).cast("string"))))
        return F.when(valid, renewed).otherwise(value)
    return let(F.regexp_replace(value, "[^0-9]", ""), work)


def permute_ssn(value: Column, key: str, inverse: bool = False) -> Column:
    """Of a social-security number that can have been given out; others stay."""
    area, group, serial = (F.substring(value, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    pair = permute_pair(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1,
                        898, 99 * 9999, "ssn", key, inverse)
    moved = let(pair, lambda p: F.concat_ws(
        "-", F.lpad((p["a"] + F.when(p["a"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
        F.lpad((F.floor(p["b"] / 9999) + 1).cast("string"), 2, "0"),
        F.lpad((p["b"] % 9999 + 1).cast("string"), 4, "0")))
    return F.when(valid, moved).otherwise(value)


def _mod97(text: Column) -> Column:
    """Value modulo 97 of a text whose letters stand for 10 to 35."""
    def add(acc: Column, ch: Column) -> Column:
        v = F.when(ch.between("0", "9"), ch.cast("int")).otherwise(F.ascii(ch) - 55)
        return F.pmod(acc * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)).cast("int")
    chars = F.filter(F.split(text, ""), lambda ch: ch != "")
    return F.aggregate(chars, F.lit(0), add)


def permute_iban(value: Column, key: str, inverse: bool = False) -> Column:
    """Of an IBAN in one piece or in groups."""
    return let(F.regexp_replace(value, " ", ""), lambda whole: _refill(
        value, _permute_iban(whole, key, inverse), lambda ch: ch != " "))


def _permute_iban(value: Column, key: str, inverse: bool) -> Column:
    country, account = F.substring(value, 1, 2), F.substring(value, F.lit(5), F.length(value))
    valid = _mod97(F.concat(account, country, F.substring(value, 3, 2))) == 1
    renewed = let(permute_text(account, "iban", key, inverse), lambda new: F.concat(
        country, F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0"), new))
    return F.when(valid, renewed).otherwise(value)


def permute_ip(value: Column, key: str, inverse: bool = False) -> Column:
    def work(o: Column) -> Column:
        pair = permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip", key, inverse)
        return let(pair, lambda p: F.concat_ws(".", *[x.cast("string") for x in (
            F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)]))
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    return F.when(F.exists(octets, lambda x: x > 255), value).otherwise(let(octets, work))


def permute_date(value: Column, fmt: str, key: str, inverse: bool = False) -> Column:
    day = F.try_to_timestamp(value, F.lit(fmt)).cast("date")
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    moved = let(permute_pair(F.floor(n / DAY_B), n % DAY_B, DAY_A, DAY_B, "date", key, inverse),
                lambda p: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"),
                                                   (p["a"] * DAY_B + p["b"]).cast("int")), fmt))
    return F.when(n.between(0, DAY_A * DAY_B - 1), moved).otherwise(value)


def kind_of(value: Column) -> Column:
    def whole(p: str) -> Column:
        return value.rlike("^(?:" + p + ")$")
    date = whole(ISO_DATE) | whole(DAY_DATE) | whole(US_DATE)
    return (F.when(F.instr(value, "@") > 0, "email").when(date, "date").when(whole(IP), "ip")
             .when(whole(SSN), "ssn").when(whole(CARD), "card").when(whole(PHONE_FORMS), "phone").otherwise("iban"))


def pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of one found value (``inverse`` gives the value back)."""
    at = F.instr(value, "@")
    mail = F.concat(permute_text(F.substring(value, F.lit(1), at - 1), "email", key, inverse),
                    F.substring(value, at, F.length(value)))
    date = (F.when(F.substring(value, 5, 1) == "-", permute_date(value, "yyyy-MM-dd", key, inverse))
             .when(F.substring(value, 3, 1) == ".", permute_date(value, "dd.MM.yyyy", key, inverse))
             .otherwise(permute_date(value, "MM/dd/yyyy", key, inverse)))
    return let(kind_of(value), lambda kind: (
        F.when(kind == "email", mail).when(kind == "date", date)
         .when(kind == "ip", permute_ip(value, key, inverse))
         .when(kind == "card", permute_card(value, key, inverse))
         .when(kind == "iban", permute_iban(value, key, inverse))
         .when(kind == "ssn", permute_ssn(value, key, inverse))
         .otherwise(permute_phone(value, key, inverse))))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """``docs`` with the values in ``text_col`` replaced, plus ``n_pii`` (values
    replaced) and ``pii_kinds`` (their kinds in order, comma-joined)."""
    text = F.col(text_col)
    # without a digit or @ there is nothing to find
    found = docs.withColumn("_found", F.coalesce(F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))),
                                                 F.array().cast("array<string>")))
    changed = F.transform("_found", lambda v: F.struct(
        v.alias("old"), pseudonym(v, key, inverse).alias("new"), kind_of(v).alias("kind")))
    found = found.withColumn("_found", changed)
    pieces = F.zip_with(F.split(text, ANY, -1), F.col("_found"),
                        lambda gap, v: F.concat(gap, F.coalesce(v["new"], F.lit(""))))
    real = F.filter("_found", lambda v: v["old"] != v["new"])
    return (found.withColumns({
        text_col: F.when(F.size("_found") == 0, text).otherwise(F.array_join(pieces, "")),
        "n_pii": F.size(real).cast("long"),
        "pii_kinds": F.array_join(F.transform(real, lambda v: v["kind"]), ",")}).drop("_found"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, spark.conf.get(KEY_CONF, DEMO_KEY)).select("doc_id", "text", "n_pii", "pii_kinds")
