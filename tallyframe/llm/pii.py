"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations, in DataFrame functions only.

Found in whole texts, validated, and permuted within their format, so equal values get equal pseudonyms in
all documents and different values of one format different ones:

card    13 to 19 digits, plain or grouped, valid by Luhn: the first digit and the grouping stay, the check digit is made to fit
iban    valid by modulo 97: country and letters stay, the other digits are permuted, the check digits made to fit
ip      four numbers up to 255
phone   + country code (1 to 3 digits) and the rest, 8 to 15 digits in all, or (ddd) ddd-dddd or ddd-ddd-dddd: the code and the layout stay
ssn     ddd-dd-dddd within the issued ranges
date    y-m-d, d/m/y, m/d/y or d.m.y, a real day of 1900 to 2099: another real day of these years, in the same layout
email   letters and digits of the local part move within their class; the domain stays

A number is split into two halves, each round adds a keyed SHA-256 of one half to the other modulo the size
of its range, and an even number of rounds restores the ranges; this is a permutation for every key.

Cases: a null text stays null, an empty one empty; invalid numbers (Luhn, 97, ranges, days) and plain digit
runs stay as they are. Repeated rows get equal results. No value is looked up anywhere: one scan, no
shuffle, each row by itself, so hot values and long texts make no difference. Empty tables give no rows.
Extra columns pass through unless named like a result (n_replaced, kinds, pseudonyms).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

#: Of the registered query only: whoever uses the operator brings a key.
EXAMPLE_KEY = "not-a-secret-change-me"
ROUNDS = 8
_SEP = r"[ .\-]?"
#: Kinds in the order in which they are tried; none holds a capturing group.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?!\w)",
    "phone": rf"(?<![\w+])\+1{_SEP}\(?\d{{3}}\)?{_SEP}\d{{3}}{_SEP}\d{{4}}(?!\w)|(?<![\w+])\+[2-9]\d{{0,2}}{_SEP}\(?\d{{1,4}}\)?(?:{_SEP}\d{{2,4}}){{2,4}}(?!\w)|(?<!\w)\(\d{{3}}\) ?\d{{3}}-\d{{4}}(?!\w)|(?<![\w\-])\d{{3}}-\d{{3}}-\d{{4}}(?![\w\-])",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "date": r"(?<![\w\-])\d{4}-\d{2}-\d{2}(?![\w\-])|(?<![\w/])\d{1,2}/\d{1,2}/\d{4}(?![\w/])|(?<![\w.])\d{1,2}\.\d{1,2}\.\d{4}(?!\w)",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)",
    "card": r"(?<![\w.\-])\d{13,19}(?![\w\-])|(?<![\w.\-])\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}(?![\w\-])|(?<![\w.\-])\d{4}[ \-]\d{6}[ \-]\d{5}(?![\w\-])".replace(r"([ \-])\d{4}\1\d{4}\1", r"[ \-]\d{4}[ \-]\d{4}[ \-]"),
}
PATTERN = "|".join(SHAPES.values())
# Country calling codes of two digits (ITU-T E.164); 1 and 7 are codes of one digit, all others have three.
_TWO_DIGIT_CODES = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)
#: 1900-01-01 and the number of days to 2099-12-31; its two factors are the ranges of the halves.
_DAY_ONE, _DAY_HALVES = "1900-01-01", (17, 4297)
_LAYOUTS = (("y-m-d", r"^\d{4}-", "yyyy-MM-dd", "y-M-d"), ("d/m/y", "/", "dd/MM/yyyy", "d/M/y"), ("m/d/y", "/", "MM/dd/yyyy", "M/d/y"), ("d.m.y", r"\.", "dd.MM.yyyy", "d.M.y"))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _number(s: Column) -> Column:
    return F.coalesce(F.when(s != "", s), F.lit("0")).cast("long")


def _power(n: Column) -> Column:
    """10 ** n, exact, up to 10 ** 18."""
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("long")


def _luhn(d: Column) -> Column:
    """The sum that must be a multiple of ten, of digits with the check digit last."""
    return F.aggregate(
        F.split(F.reverse(d), ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")),
        lambda a, c: F.struct((a["sum"] + _doubled(c.cast("int"), a["i"])).alias("sum"), (a["i"] + 1).alias("i")), lambda a: a["sum"],
    )


def _doubled(x: Column, i: Column) -> Column:
    return F.when(i % 2 == 0, x).when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)


def _mod97(s: Column) -> Column:
    """Of letters and digits, letters as 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), _number(F.regexp_extract(c, "[0-9]", 0))).otherwise(F.ascii(c).cast("long") - 55)
    return F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def _prf(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]).cast("binary"), 256)


def _feistel(key: str, kind: Column, a: Column, b: Column, ma: Column, mb: Column) -> Column:
    """(a, b) in ranges (ma, mb), permuted."""
    start = F.struct(a.alias("a"), b.alias("b"))

    def one(s: Column, i: Column) -> Column:
        draw = F.conv(F.substring(_prf(key, kind, ma, mb, i, s["b"]), 1, 15), 16, 10).cast("long")
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + F.pmod(draw, F.when(i % 2 == 0, ma).otherwise(mb)), F.when(i % 2 == 0, ma).otherwise(mb)).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one)


_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")


def _shifted(part: Column, stream: Column) -> Column:
    """Each letter or digit moved within its class by two hexadecimal digits of the stream."""

    def one(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(stream, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for letters in _CLASSES:
            at = F.instr(F.lit(letters), c)
            out = F.when((c != "") & (at > 0), F.substr(F.lit(letters), F.pmod(at - 1 + by, F.lit(len(letters))) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(part, ""), one), "")


def _laid_out(shape: Column, digits: Column) -> Column:
    """The digits in the places of the shape's digits."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))

    def one(s: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substr(digits, s["i"], F.lit(1))).otherwise(c)).alias("out"), (s["i"] + is_digit.cast("int")).alias("i"))

    return F.aggregate(F.split(shape, ""), start, one, lambda s: s["out"])


def _with(s: Column, names: list[str], **new: Column) -> Column:
    return F.struct(*[s[n].alias(n) for n in names], *[c.alias(n) for n, c in new.items()])


def _day(m: Column) -> Column:
    """struct(layout, day number): of the first layout that makes it a day of the range."""
    out = F.lit(None).cast("struct<layout:string,day:int>")
    for name, test, _, reading in reversed(_LAYOUTS):
        day = F.datediff(F.try_to_timestamp(m, F.lit(reading)).cast("date"), F.lit(_DAY_ONE).cast("date"))
        out = F.when(m.rlike(test) & day.between(0, _DAY_HALVES[0] * _DAY_HALVES[1] - 1), F.struct(F.lit(name).alias("layout"), day.alias("day"))).otherwise(out)
    return out


def pseudonyms(matches: Column, key: str) -> Column:
    """An array of what the pattern matched, to structs (m, kind, new); kind is null where it isn't valid, and new is m then."""

    def kind(m: Column) -> Column:
        return reduce(lambda rest, k: F.when(m.rlike(f"^(?:{SHAPES[k]})$"), F.lit(k)).otherwise(rest), reversed(SHAPES), F.lit(None).cast("string"))

    has = ["m"]
    step = F.transform(matches, lambda m: F.struct(m.alias("m"), kind(m).alias("shape"), _digits(m).alias("d")))
    has += ["shape", "d"]
    step = F.transform(step, lambda s: _with(s, has, n=F.length(s["d"]), date=F.when(s["shape"] == "date", _day(s["m"])), bare=F.when(s["shape"] == "iban", F.replace(s["m"], F.lit(" "), F.lit("")))))
    has += ["n", "date", "bare"]

    def valid(s: Column) -> Column:
        d, k = s["d"], s["shape"]
        area = _number(F.substring(d, 1, 3))
        return (
            F.when(k == "card", s["n"].between(13, 19) & (_luhn(d) % 10 == 0))
            .when(k == "iban", F.length(s["bare"]).between(15, 34) & (_mod97(F.concat(F.substr(s["bare"], F.lit(5)), F.substring(s["bare"], 1, 4))) == 1))
            .when(k == "ip", F.forall(F.split(s["m"], r"\."), lambda x: _number(x) <= 255))
            .when(k == "phone", s["n"].between(8, 15) | ~s["m"].startswith("+"))
            .when(k == "ssn", (area > 0) & (area != 666) & (area < 900) & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000"))
            .when(k == "date", s["date"].isNotNull())
            .otherwise(k == "email")
        )

    step = F.transform(step, lambda s: _with(s, has, kind=F.when(valid(s), s["shape"])))
    has += ["kind"]

    def moving(s: Column) -> Column:
        """The digits that are permuted as one decimal number."""
        d, k = s["d"], s["kind"]
        code = F.when(~s["m"].startswith("+"), 0).when(F.substring(d, 1, 1).isin("1", "7"), 1).when(F.substring(d, 1, 2).isin(*_TWO_DIGIT_CODES), 2).otherwise(3)
        return F.when(k == "card", F.substr(d, F.lit(2), s["n"] - 2)).when(k == "iban", F.substr(d, F.lit(3))).when(k == "phone", F.substr(d, code + 1))

    step = F.transform(step, lambda s: _with(s, has, core=moving(s)))
    has += ["core"]

    def halves(s: Column) -> Column:
        d, k, core = s["d"], s["kind"], s["core"]
        four = F.split(s["m"], r"\.")
        octet = lambda i: _number(F.get(four, F.lit(i)))
        cut = F.floor(F.length(core) / 2).cast("int")
        area = _number(F.substring(d, 1, 3))
        make = lambda a, b, ma, mb: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), ma.cast("long").alias("ma"), mb.cast("long").alias("mb"))
        day = s["date"]["day"]
        return (
            F.when(k == "ip", make(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536)))
            .when(k == "date", make(F.floor(day / _DAY_HALVES[1]), day % _DAY_HALVES[1], F.lit(_DAY_HALVES[0]), F.lit(_DAY_HALVES[1])))
            .when(k == "ssn", make((area - F.when(area > 666, 2).otherwise(1)) * 99 + _number(F.substring(d, 4, 2)) - 1, _number(F.substring(d, 6, 4)) - 1, F.lit(898 * 99), F.lit(9999)))
            .when(core.isNotNull(), make(_number(F.substr(core, F.lit(1), cut)), _number(F.substr(core, cut + 1)), _power(cut), _power(F.length(core) - cut)))
        )

    step = F.transform(step, lambda s: _with(s, has, h=halves(s)))
    has += ["h"]
    step = F.transform(step, lambda s: _with(s, has, p=F.when(s["h"].isNotNull(), _feistel(key, s["kind"], s["h"]["a"], s["h"]["b"], s["h"]["ma"], s["h"]["mb"]))))
    has += ["p"]

    def core_out(s: Column) -> Column:
        cut = F.floor(F.length(s["core"]) / 2).cast("int")
        pad = lambda x, n: F.when(n > 0, F.lpad(x.cast("string"), n, "0")).otherwise("")
        return F.when(s["core"].isNotNull(), F.concat(pad(s["p"]["a"], cut), pad(s["p"]["b"], F.length(s["core"]) - cut)))

    local = lambda s: F.substring_index(s["m"], "@", 1)
    step = F.transform(step, lambda s: _with(s, has, out=core_out(s), left=F.when(s["kind"] == "email", F.substr(local(s), F.lit(1), F.floor(F.length(local(s)) / 2).cast("int"))), right=F.when(s["kind"] == "email", F.substr(local(s), F.floor(F.length(local(s)) / 2).cast("int") + 1))))
    has += ["out", "left", "right"]
    for r in range(2):  # each round moves both halves of an address, one by the other
        step = F.transform(step, lambda s, r=r: _with(s, [n for n in has if n != "left"], left=F.when(s["left"].isNotNull(), _shifted(s["left"], _prf(key, F.lit(f"email{2 * r}"), F.length(s["left"]), s["right"])))))
        step = F.transform(step, lambda s, r=r: _with(s, [n for n in has if n != "right"], right=F.when(s["right"].isNotNull(), _shifted(s["right"], _prf(key, F.lit(f"email{2 * r + 1}"), F.length(s["right"]), s["left"])))))

    def new(s: Column) -> Column:
        d, k, p = s["d"], s["kind"], s["p"]
        card = F.concat(F.substring(d, 1, 1), s["out"])
        check = F.pmod(-_luhn(F.concat(card, F.lit("0"))), F.lit(10)).cast("string")
        day = F.date_add(F.lit(_DAY_ONE).cast("date"), (p["a"] * _DAY_HALVES[1] + p["b"]).cast("int"))
        laid = reduce(lambda rest, x: F.when(s["date"]["layout"] == x[0], F.date_format(day, x[2])).otherwise(rest), _LAYOUTS, F.lit(None).cast("string"))
        area = F.floor(p["a"] / 99).cast("int") + 1
        ssn = F.format_string("%03d-%02d-%04d", F.when(area >= 666, area + 1).otherwise(area), (p["a"] % 99 + 1).cast("int"), (p["b"] + 1).cast("int"))
        ip = F.concat_ws(".", F.shiftright(p["a"], 8), p["a"] % 256, F.shiftright(p["b"], 8), p["b"] % 256)
        iban = _laid_out(s["m"], F.concat(F.lit("00"), s["out"]))
        bare = F.replace(iban, F.lit(" "), F.lit(""))
        fitted = F.lpad((98 - _mod97(F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 2), F.lit("00")))).cast("string"), 2, "0")
        return (
            F.when(k == "card", _laid_out(s["m"], F.concat(card, check)))
            .when(k == "iban", F.concat(F.substring(iban, 1, 2), fitted, F.substr(iban, F.lit(5))))
            .when(k == "phone", _laid_out(s["m"], F.concat(F.substr(d, F.lit(1), s["n"] - F.length(s["core"])), s["out"])))
            .when(k == "ip", ip).when(k == "ssn", ssn).when(k == "date", laid)
            .when(k == "email", F.concat(s["left"], s["right"], F.substr(s["m"], F.length(local(s)) + 1)))
            .otherwise(s["m"])
        )

    return F.transform(step, lambda s: F.struct(s["m"].alias("m"), s["kind"].alias("kind"), new(s).alias("new")))


def pseudonymise(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """df with the text's personal data replaced, n_replaced, kinds and pseudonyms in order of the text. key: a secret of the caller's."""
    made = ("n_replaced", "kinds", "pseudonyms")
    df = df.drop(*[c for c in df.columns if c.lower() in made and c != text])
    matches, replaced, valid = fresh(df, "found", "new", "valid")
    found = df.withColumn(matches, F.when(F.col(text).rlike(PATTERN), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))))
    new = found.withColumn(replaced, F.when(F.col(matches).isNotNull(), pseudonyms(F.col(matches), key)))
    between = F.split(F.col(text), PATTERN, -1)
    whole = F.array_join(F.flatten(F.zip_with(between, F.col(replaced)["new"], lambda x, y: F.array(x, F.coalesce(y, F.lit(""))))), "")
    own = F.filter(F.coalesce(F.col(replaced), F.array().cast("array<struct<m:string,kind:string,new:string>>")), lambda s: s["kind"].isNotNull())
    return (
        new.withColumn(valid, own)
        .withColumn(text, F.when(F.size(valid) > 0, whole).otherwise(F.col(text)))
        .withColumn("n_replaced", F.when(F.col(text).isNotNull(), F.size(valid)))
        .withColumn("kinds", F.when(F.col(text).isNotNull(), F.transform(valid, lambda s: s["kind"])))
        .withColumn("pseudonyms", F.when(F.col(text).isNotNull(), F.transform(valid, lambda s: s["new"])))
        .select(*df.columns, *made)
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), EXAMPLE_KEY)
