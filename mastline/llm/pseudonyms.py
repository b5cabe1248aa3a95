"""Personal data: format-preserving Feistel pseudonyms.

Card numbers, IBANs, national and telephone numbers, IP addresses, dates, the local parts of
e-mail addresses and hexadecimal secrets are found by one pattern and, where they can be
validated, checked (Luhn, modulo 97, octets, calendar). Each is permuted within its own
format by a keyed Feistel network: lengths, separators, letter case, check digits and
calendar validity stay, equal values get equal pseudonyms in every document, and ``restore``
with the same key gives the texts back. What fails its check is left alone.

Numbers may stand beside a card: the first and longest run of groups that is a card counts.
Where a pseudonym would be read together with such a neighbour, the next one is taken. An
IBAN ends where its country says. Separated digits behind a telephone number that begins
with ``+`` cannot be told from it, up to 15 digits in all.

Only built-in column functions are used; texts without a digit or ``@`` are not searched.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_YEAR, _MONTH, _DAY = r"(?:1[89]|2[01])[0-9]{2}", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12][0-9]|3[01])"
_NAME = r"\p{L}\p{M}\p{N}._%+\-"

#: countries by the length of their IBANs
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}


def _iban_of(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    tail = f"(?: ?[A-Z0-9]{{{rest}}})" if rest else ""
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{tail}(?![0-9A-Za-z])"


_IBANS = "|".join(_iban_of(n, c) for n, c in _IBAN_LENGTHS.items())

# what begins another value behind a separator; formats alone, which pseudonyms keep
_OTHER = (
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])|[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?![0-9])|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"
    r"|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5}(?![0-9])"
    # groups of four in fours
    r"|[0-9]{4}(?:[ \-][0-9]{4}){3}(?:(?:[ \-][0-9]{4}){4})*+(?![ \-][0-9]{4}(?![0-9]))(?![0-9])"
    rf"|[{_NAME}]{{1,64}}+@|[0-9a-f]{{32,128}}(?![0-9A-Za-z])|[0-9A-F]{{32,128}}(?![0-9A-Za-z])"
)
_NEXT = rf"{_OTHER}|(?:1[ .\-])?(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[ .\-])[0-9]{{3}}[ .\-][0-9]{{4}}(?![0-9])"

#: kind -> pattern; the first that fits at a place counts
PATTERNS = {
    "email": rf"(?<![{_NAME}])[{_NAME}]{{1,64}}+@[\p{{L}}\p{{N}}\-]{{1,63}}(?:\.[\p{{L}}\p{{N}}\-]{{1,63}}){{1,8}}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "iban": rf"(?<![0-9A-Za-z])(?:{_IBANS}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![0-9A-Za-z]))",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9])(?!\.[0-9])",
    "date": rf"(?<![0-9./\-])(?:{_YEAR}-{_MONTH}-{_DAY}|{_DAY}[./]{_MONTH}[./]{_YEAR})(?![0-9])(?![./\-][0-9])",
    "national": r"(?<![0-9\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9])(?!-[0-9])",
    "phone": r"\+1[ .\-]?\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}(?![0-9])"
    r"|(?<![0-9+])(?:\+?1[ .\-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])"
    r"|\+[1-9][0-9]{8,14}(?![0-9])"
    rf"|\+[1-9](?:(?:[ \-/](?!{_OTHER}))?\(?[0-9]\)?){{7}}(?:(?:[ \-/](?!{_NEXT}))?\(?[0-9]\)?){{0,7}}(?![0-9])"
    r"|\+(?=(?:\.?[0-9]){8,15}(?!\.?[0-9]))(?![0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![.0-9]))[1-9][0-9]{0,2}(?:\.[0-9]{1,8}){2,6}"
    r"|\+[1-9][0-9]{6,14}(?![0-9])",
    "card": rf"(?<![0-9])[0-9](?:[ \-]?[0-9]){{12}}(?:[0-9]|[ \-](?!{_NEXT})[0-9]){{0,6}}(?![0-9])",
}
#: groups of a card that stands among other numbers
_CARD_FORM = (
    r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}(?:[ \-][0-9]{1,3})?|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5}"
    r"|[0-9]{4}(?:[ \-][0-9]{3}){3})$"
)
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _alphabet(c: Column) -> Column:
    return (
        F.when(c.between("0", "9"), _DIGITS)
        .when(c.between("a", "z"), _LOWER)
        .when(c.between("A", "Z"), _UPPER)
    )


def _hex_alphabet(c: Column) -> Column:
    """Digits of lower-case hex; upper-case ones are turned before."""
    return F.lit("0123456789abcdef")


def _chars(text: Column) -> Column:
    return F.array_remove(F.split(text, ""), "")


def _digest(key: str, kind: str, turn: Column, value: Column, bits: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value), bits)


def _turns(restore: bool) -> Column:
    order = range(ROUNDS - 1, -1, -1) if restore else range(ROUNDS)
    return F.array(*map(F.lit, order))


def _permuted(chars: Column, key: str, kind: str, restore: bool, alphabet=_alphabet) -> Column:
    """The characters, each in its alphabet, permuted: two halves mask each other in turn."""
    n = F.size(chars)
    half = F.floor(n / 2).cast("int")

    def masked(part: Column, other: Column, turn: Column) -> Column:
        value = F.concat_ws("|", F.size(part).cast("string"), F.array_join(other, ""))
        masks = F.regexp_extract_all(_digest(key, kind, turn, value, 512), F.lit("[0-9a-f]{4}"), F.lit(0))
        masks = F.slice(F.flatten(F.array_repeat(masks, 4)), F.lit(1), F.size(part))
        sign = -1 if restore else 1
        return F.zip_with(
            part,
            masks,
            lambda c, m: F.substring(
                alphabet(c),
                F.pmod(
                    F.position(c, alphabet(c)) - 1 + sign * F.conv(m, 16, 10).cast("int"),
                    F.length(alphabet(c)),
                )
                + 1,
                F.lit(1),
            ),
        )

    def step(pair: Column, turn: Column) -> Column:
        left, right = pair["l"], pair["r"]
        even = turn % 2 == 0
        return F.struct(
            F.when(even, masked(left, right, turn)).otherwise(left).alias("l"),
            F.when(even, right).otherwise(masked(right, left, turn)).alias("r"),
        )

    start = F.struct(
        F.slice(chars, F.lit(1), half).alias("l"), F.slice(chars, half + 1, n - half).alias("r")
    )
    done = F.aggregate(_turns(restore), start, step)
    return F.concat(done["l"], done["r"])


def _refilled(text: Column, new: Column, alphabet=_alphabet) -> Column:
    """``text`` with the characters that have an alphabet replaced by ``new``, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(at: Column, c: Column) -> Column:
        own = alphabet(c).isNotNull()
        return F.struct(
            F.concat(at["out"], F.when(own, F.get(new, at["k"])).otherwise(c)).alias("out"),
            (at["k"] + own.cast("int")).alias("k"),
        )

    return F.aggregate(_chars(text), start, step)["out"]


def _pair(a: Column, b: Column, sizes: tuple[int, int], key: str, kind: str, restore: bool) -> Column:
    """A number below sizes[0] and one below sizes[1], permuted together."""
    sign = -1 if restore else 1

    def mask(turn: Column, value: Column) -> Column:
        word = F.substring(_digest(key, kind, turn, value.cast("string"), 256), 1, 12)
        return sign * F.conv(word, 16, 10).cast("long")

    def step(pair: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        return F.struct(
            F.when(even, F.pmod(pair["a"] + mask(turn, pair["b"]), F.lit(sizes[0]))).otherwise(pair["a"]).alias("a"),
            F.when(even, pair["b"]).otherwise(F.pmod(pair["b"] + mask(turn, pair["a"]), F.lit(sizes[1]))).alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(_turns(restore), start, step)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of digits, the last one counted once."""
    terms = F.transform(
        F.reverse(_chars(digits)),
        lambda c, i: F.when(
            i % 2 == 1, F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int"))
        ).otherwise(c.cast("int")),
    )
    return F.aggregate(terms, F.lit(0), lambda s, x: s + x)


def _card_span(text: Column) -> Column:
    """Place and length of the card in a stretch of groups, the first and of these the longest; or null."""
    n = F.length(text)
    digit = lambda i: F.substring(text, i, F.lit(1)).between("0", "9")
    places = F.sequence(F.lit(1), n)
    starts = F.filter(places, lambda i: digit(i) & ((i == 1) | ~digit(i - 1)))
    ends = F.filter(F.reverse(places), lambda i: digit(i) & ((i == n) | ~digit(i + 1)))
    spans = F.flatten(
        F.transform(
            starts, lambda a: F.transform(ends, lambda b: F.struct(a.alias("at"), (b - a + 1).alias("n")))
        )
    )

    def valid(span: Column) -> Column:
        value = F.substring(text, span["at"], span["n"])
        digits = _digits(value)
        return (
            (span["n"] >= 13)
            & ((span["n"] == n) | value.rlike(_CARD_FORM))
            & F.length(digits).between(13, 19)
            & (_luhn(digits) % 10 == 0)
        )

    return F.get(F.filter(spans, valid), F.lit(0))


def _card(text: Column, key: str, restore: bool) -> Column:
    def turned(value: Column) -> Column:
        digits = _digits(value)
        body = F.substring(digits, F.lit(1), F.length(digits) - 1)
        new = _permuted(_chars(body), key, "card", restore)
        check = F.pmod(-_luhn(F.concat(F.array_join(new, ""), F.lit("0"))), F.lit(10)).cast("string")
        return _refilled(value, F.concat(new, F.array(check)))

    def replaced(span: Column) -> Column:
        head = F.substring(text, F.lit(1), span["at"] - 1)
        tail = F.substring(text, span["at"] + span["n"], F.length(text))

        def step(state: Column, turn: Column) -> Column:
            # a pseudonym that its neighbours would hide is turned again; so is its way back
            new = F.transform(
                F.array(turned(state["value"])),
                lambda v: F.struct(
                    v.alias("value"),
                    F.coalesce(_card_span(F.concat(head, v, tail)) == span, F.lit(False)).alias("found"),
                ),
            )
            return F.when(state["found"], state).otherwise(F.get(new, F.lit(0)))

        start = F.struct(
            F.substring(text, span["at"], span["n"]).alias("value"), F.lit(False).alias("found")
        )
        done = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step)
        return F.concat(head, done["value"], tail)

    found = F.transform(
        F.array(_card_span(text)), lambda span: F.when(span.isNull(), text).otherwise(replaced(span))
    )
    return F.get(found, F.lit(0))


def _rest_97(text: Column) -> Column:
    def step(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.between("0", "9"), (rest * 10 + c.cast("int")) % 97).otherwise(
            (rest * 100 + letter) % 97
        )

    return F.aggregate(_chars(text), F.lit(0), step)


def _iban(text: Column, key: str, restore: bool) -> Column:
    plain = F.replace(text, F.lit(" "), F.lit(""))
    country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    new = F.array_join(_permuted(_chars(body), key, "iban", restore), "")
    check = F.lpad((98 - _rest_97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    valid = F.length(plain).between(15, 34) & (
        _rest_97(F.concat(body, F.substring(plain, 1, 4))) == 1
    )
    return F.when(valid, _refilled(text, _chars(F.concat(country, check, new)))).otherwise(text)


def _ip(text: Column, key: str, restore: bool) -> Column:
    part = lambda i: F.split_part(text, F.lit("."), F.lit(i)).cast("long")
    done = _pair(part(1) * 256 + part(2), part(3) * 256 + part(4), (1 << 16, 1 << 16), key, "ip", restore)
    parts = F.transform(
        F.array(done),
        lambda p: F.concat_ws(
            ".",
            *(F.floor(p[x] / 256).cast("string") if high else (p[x] % 256).cast("string") for x in "ab" for high in (1, 0)),
        ),
    )
    return F.get(parts, F.lit(0))


def _date(text: Column, key: str, restore: bool) -> Column:
    """Days since 1800-01-01; the 146,097 days of 400 years are 189 times 773."""
    first = text.rlike("^[0-9]{4}")
    d = _digits(text)
    iso = F.when(first, d).otherwise(
        F.concat(F.substring(d, 5, 4), F.substring(d, 3, 2), F.substring(d, 1, 2))
    )
    day = F.try_to_date(iso, "yyyyMMdd")
    number = F.datediff(day, F.lit("1800-01-01").cast("date"))
    done = _pair(F.floor(number / 773), number % 773, (189, 773), key, "date", restore)
    new = F.transform(
        F.array(done),
        lambda p: F.date_format(
            F.date_add(F.lit("1800-01-01").cast("date"), (p["a"] * 773 + p["b"]).cast("int")), "yyyyMMdd"
        ),
    )[0]
    new = F.when(first, new).otherwise(
        F.concat(F.substring(new, 7, 2), F.substring(new, 5, 2), F.substring(new, 1, 4))
    )
    return F.when(day.isNotNull(), _refilled(text, _chars(new))).otherwise(text)


def _national(text: Column, key: str, restore: bool) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""
    d = _digits(text)
    area, group, serial = (F.substring(d, *x).cast("long") for x in ((1, 3), (4, 2), (6, 4)))
    area = F.when(area > 666, area - 2).otherwise(area - 1)
    done = _pair(area, (group - 1) * 9_999 + serial - 1, (898, 99 * 9_999), key, "national", restore)
    new = F.transform(
        F.array(done),
        lambda p: F.concat(
            F.lpad(F.when(p["a"] >= 665, p["a"] + 2).otherwise(p["a"] + 1).cast("string"), 3, "0"),
            F.lpad((F.floor(p["b"] / 9_999) + 1).cast("string"), 2, "0"),
            F.lpad((p["b"] % 9_999 + 1).cast("string"), 4, "0"),
        ),
    )[0]
    return _refilled(text, _chars(new))


def _phone(text: Column, key: str, restore: bool) -> Column:
    """All digits but a leading country code 1 of ten-digit numbers, or the first digit."""
    digits = _digits(text)
    separated = text.rlike(r"^\+.*[^0-9]")  # its first digit is not zero
    kept = F.when((F.length(digits) == 10) & ~separated, 0).otherwise(1)
    body = _chars(F.substring(digits, kept + 1, F.length(digits)))
    new = _permuted(body, key, "phone", restore)
    return _refilled(text, F.concat(_chars(F.substring(digits, F.lit(1), kept)), new))


def _email(text: Column, key: str, restore: bool) -> Column:
    at = F.locate("@", text)
    local = F.substring(text, F.lit(1), at - 1)
    own = F.filter(_chars(local), lambda c: _alphabet(c).isNotNull())
    new = _refilled(local, _permuted(own, key, "email", restore))
    return F.concat(new, F.substring(text, at, F.length(text)))


def _secret(text: Column, key: str, restore: bool) -> Column:
    upper = text.rlike("[A-F]")
    new = F.array_join(_permuted(_chars(F.lower(text)), key, "secret", restore, _hex_alphabet), "")
    # a pseudonym of one case stays of that case; without letters it counts as lower
    return F.when(upper, F.upper(new)).otherwise(new)


_KINDS = {
    "email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date,
    "national": _national, "phone": _phone, "card": _card,
}


def _replaced(found: Column, key: str, restore: bool) -> Column:
    """The pseudonym of one value that the pattern found."""
    out = F.lit(None).cast("string")
    for kind in reversed(PATTERNS):
        whole = found.rlike(f"^(?:{PATTERNS[kind]})$")
        out = F.when(whole, _KINDS[kind](found, key, restore)).otherwise(out)
    return F.coalesce(out, found)


def _applied(docs: DataFrame, key: str, text_column: str, count_column: str | None, restore: bool) -> DataFrame:
    text = F.col("text")
    looked = text.rlike("[0-9@]")
    found = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[text_column].alias("text")
    ).select(
        "row", "text", F.when(looked, F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).alias("values")
    )
    some = F.size("values") > 0
    new = found.select(
        "row",
        "text",
        "values",
        F.when(some, F.transform("values", lambda x: _replaced(x, key, restore))).alias("names"),
        F.when(some, F.split(text, _ANY, -1)).alias("gaps"),
    )
    joined = F.array_join(
        F.flatten(F.zip_with("gaps", "names", lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))), ""
    )
    changed = F.size(F.filter(F.zip_with("values", "names", lambda a, b: a != b), lambda x: x))
    columns = [
        F.when(some, joined).otherwise(text).alias(c) if c == text_column else F.col("row")[c].alias(c)
        for c in docs.columns
        if c != count_column
    ]
    if count_column:
        columns.append(F.when(some, changed).otherwise(0).cast("long").alias(count_column))
    return new.select(*columns)


def pseudonymised(
    docs: DataFrame, key: str, text_column: str = "text", count_column: str | None = "n_pseudonyms"
) -> DataFrame:
    """``docs`` with personal data in whole texts replaced, and how many values were.

    A null text stays null, an empty one empty; every row is kept, repeated rows alike. All
    other columns stay as they are; one named like ``count_column`` is replaced. ``key`` is
    the secret: who has it can restore the texts.
    """
    return _applied(docs, key, text_column, count_column, restore=False)


def restored(docs: DataFrame, key: str, text_column: str = "text") -> DataFrame:
    """The texts before ``pseudonymised`` with the same key."""
    return _applied(docs, key, text_column, None, restore=True)
