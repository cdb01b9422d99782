"""Personal data replaced by format-preserving Feistel pseudonyms, in DataFrame functions only.

One pattern finds candidates; each is validated (check digits, ranges, calendar), and what is valid is permuted by a
keyed Feistel network over the numbers that its format allows. The permutation depends on key, kind and value alone, so
equal values stay equal across documents; numbers and dates are permuted, so two of them never become one. Stand-ins of
mail addresses (48 bits of a keyed hash) and of secrets and access keys (letters and digits drawn from one) can in
principle coincide. Texts without a trace of a candidate are passed through after a single look.

The key reaches the plan as the result of a scalar subquery, not as a literal, so that plans, pages and event logs don't
show it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import carried

ROUNDS = 8
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"

#: Kinds of candidates by the pattern that finds them; where several fit, the first wins.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?<=(?i:password|passwd|token|secret|api[_-]?key)[ ]{0,3}[=:][ ]{0,3}[\"']?)[A-Za-z0-9/+_-]{8,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?<gap>[ -])[0-9]{4}\k<gap>[0-9]{4}\k<gap>[0-9]{4}|[0-9]{4}(?<cut>[ -])[0-9]{6}\k<cut>[0-9]{4,5})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4})(?![0-9A-Za-z/-])",
    "ip": rf"(?<![0-9A-Za-z.])(?:{_OCTET}[.]){{3}}{_OCTET}(?![0-9A-Za-z]|[.][0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:[+][0-9]{1,3}[ .-]?(?:[(][0-9]{1,4}[)][ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,4}|(?:[(][2-9][0-9]{2}[)] ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4})(?![0-9A-Za-z])",
}
#: Group 1 is what the secret pattern finds.
ANY = "|".join(f"({p})" if k == "secret" else f"(?:{p})" for k, p in PATTERNS.items())
SECRET_TRACE = r"(?i)password|passwd|token|secret|api[_-]?key"
#: Every candidate but a secret holds one of the first three; a secret follows a mark.
TRACE = r"@|AKIA[0-9A-Z]|[0-9][0-9]|[0-9]/[0-9]|[0-9][.][0-9]|[=:][ ]{0,3}[\"']?[A-Za-z0-9/+_-]{8}"


def _lit(text: str) -> str:
    """A raw SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Days by era, each permuted within itself: from 0001-01-01 to 1899-12-31, to 2100-04-25, to 9999-12-31. For each its
#: first day, counted from 0001-01-01, and two factors of its length.
ERAS = ((0, 745, 931), (693595, 268, 273), (766759, 1525, 1892))
KEY_COL = "__pii_key"


class _Sql:
    """SQL text of what is done to a candidate m; key: SQL of the key."""

    def __init__(self, key: str = KEY_COL):
        self.key = key

    def feistel(self, kind: str, left: str, right: str, a: str, b: str, then: str) -> str:
        """Permutes (left, right) in [0, a) x [0, b); then: SQL of the result over s.l and s.r."""

        def mixed(half: str, most: str) -> str:
            hashed = f"sha2(concat_ws('|', {self.key}, '{kind}', cast(i AS string), cast({half} AS string), cast({a} AS string), cast({b} AS string)), 256)"
            return f"cast(conv(substr({hashed}, 1, 12), 16, 10) AS bigint) % {most}"

        step = f"named_struct('l', IF(i % 2 = 1, (s.l + {mixed('s.r', a)}) % {a}, s.l), 'r', IF(i % 2 = 0, (s.r + {mixed('s.l', b)}) % {b}, s.r))"
        ran = f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({left} AS bigint), 'r', cast({right} AS bigint)), (s, i) -> {step})"
        return f"transform(array({ran}), s -> {then})[0]"

    def digits(self, kind: str, d: str) -> str:
        """Permutes a string of 2 to 36 digits."""
        return self.let(d, "d", self.let("cast(length(d) DIV 2 AS int)", "h", self.feistel(
            kind, "cast(substr(d, 1, h) AS bigint)", "cast(substr(d, h + 1) AS bigint)", "cast(pow(10, h) AS bigint)", "cast(pow(10, length(d) - h) AS bigint)",
            "concat(lpad(cast(s.l AS string), h, '0'), lpad(cast(s.r AS string), length(d) - h, '0'))")))

    @staticmethod
    def let(value: str, name: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    @staticmethod
    def only_digits(text: str) -> str:
        return f"regexp_replace({text}, '[^0-9]', '')"

    def refill(self, digits: str) -> str:
        """m with its digits replaced, in order, by others."""
        char = f"IF(substr(m, k, 1) RLIKE '[0-9]', substr(n, length({self.only_digits('substr(m, 1, k)')}), 1), substr(m, k, 1))"
        return self.let(digits, "n", f"array_join(transform(sequence(1, length(m)), k -> {char}), '')")

    @staticmethod
    def luhn(d: str) -> str:
        own = "cast(substr(r, j, 1) AS int)"
        return f"transform(array(reverse({d})), r -> aggregate(sequence(1, length(r)), 0, (t, j) -> t + IF(j % 2 = 0, {own} * 2 - IF({own} > 4, 9, 0), {own})))[0] % 10"

    @staticmethod
    def mod97(code: str) -> str:
        """Of an account code whose first four characters go last and whose letters count from 10."""
        char = "ascii(substr(w, j, 1))"
        return f"transform(array(concat(substr({code}, 5), substr({code}, 1, 4))), w -> aggregate(sequence(1, length(w)), 0, (t, j) -> IF({char} < 58, t * 10 + {char} - 48, t * 100 + {char} - 55) % 97))[0]"

    def email(self) -> str:
        return f"concat('u', substr(sha2(concat_ws('|', {self.key}, 'email', lower(m)), 256), 1, 12), '@mail.invalid')"

    def opaque(self, kind: str) -> str:
        """Letters and digits drawn anew from the keyed hash of the whole; marks and case stay."""
        drawn = f"cast(conv(substr(sha2(concat_ws('|', {self.key}, '{kind}', m, cast(k AS string)), 256), 1, 8), 16, 10) AS bigint)"
        char = f"CASE WHEN substr(m, k, 1) RLIKE '[0-9]' THEN cast({drawn} % 10 AS string) WHEN substr(m, k, 1) RLIKE '[A-Z]' THEN chr(65 + {drawn} % 26) WHEN substr(m, k, 1) RLIKE '[a-z]' THEN chr(97 + {drawn} % 26) ELSE substr(m, k, 1) END"
        return f"array_join(transform(sequence(1, length(m)), k -> {char}), '')"

    def key_id(self) -> str:
        return f"concat('AKIA', substr(upper(sha2(concat_ws('|', {self.key}, 'key', m), 256)), 1, 16))"

    def iban(self) -> str:
        """Permutes the digits of the account, then sets the check digits. Words after the account may look like more
        groups of it: the longest valid run of groups is taken, and what follows stays."""
        code = "replace(m, ' ', '')"
        inner = self.digits("iban", self.only_digits("substr(c, 5)"))
        # The country's letters, two digits to come, and the account with its letters left in place.
        place = "array_join(transform(sequence(5, length(c)), k -> IF(substr(c, k, 1) RLIKE '[0-9]', substr(p, length(regexp_replace(substr(c, 5, k - 4), '[^0-9]', '')), 1), substr(c, k, 1))), '')"
        check = self.let(f"concat(substr(c, 1, 2), '00', {place})", "z", f"concat(substr(z, 1, 2), lpad(cast(98 - {self.mod97('z')} AS string), 2, '0'), substr(z, 5))")
        spaced = "array_join(transform(sequence(1, length(m)), k -> IF(substr(m, k, 1) = ' ', ' ', substr(y, k - length(regexp_replace(substr(m, 1, k), '[^ ]', '')), 1))), '')"
        made = self.let(inner, "p", self.let(check, "y", spaced))
        valid = f"length(c) BETWEEN 15 AND 34 AND length({self.only_digits('substr(c, 5)')}) BETWEEN 2 AND 30 AND {self.mod97('c')} = 1"
        runs = "transform(sequence(0, size(g) - 1), k -> array_join(slice(g, 1, size(g) - k), ' '))"
        fits = self.let("split(m, ' ')", "g", f"get(filter({runs}, v -> {self.let(code.replace('m', 'v'), 'c', valid)}), 0)")
        return self.let(fits, "f", f"IF(f IS NULL, NULL, concat({self.let('f', 'm', self.let(code, 'c', made))}, substr(m, length(f) + 1)))")

    def card(self) -> str:
        """Keeps the first digit, permutes what follows and sets the check digit."""
        body = f"concat(substr(e, 1, 1), {self.digits('card', 'substr(e, 2, length(e) - 2)')})"
        whole = self.let(body, "g", f"concat(g, cast((10 - {self.luhn('concat(g, chr(48))')}) % 10 AS string))")
        return self.let(self.only_digits("m"), "e", f"IF({self.luhn('e')} = 0 AND e RLIKE '[1-9]', {self.refill(whole)}, NULL)")

    def ssn(self) -> str:
        area = "cast(substr(m, 1, 3) AS int)"
        index = f"({area} - 1 - IF({area} > 666, 1, 0)) * 99 + cast(substr(m, 5, 2) AS int) - 1"
        back = "cast(s.l DIV 99 AS int) + 1"
        shown = f"concat(lpad(cast({back} + IF({back} > 665, 1, 0) AS string), 3, '0'), '-', lpad(cast(s.l % 99 + 1 AS string), 2, '0'), '-', lpad(cast(s.r + 1 AS string), 4, '0'))"
        valid = "NOT m RLIKE '^(000|666|9)|-00-|-0000$'"
        return f"IF({valid}, {self.feistel('ssn', index, 'cast(substr(m, 8, 4) AS bigint) - 1', '88902', '9999', shown)}, NULL)"

    def date(self) -> str:
        """Permutes the days of each era of ERAS within it, so that a date of our time stays one."""
        wide = "length(m) = 10"
        parsed = lambda layout: f"cast(try_to_timestamp(m, '{layout}') AS date)"
        layout = f"CASE WHEN m RLIKE '^[0-9]{{4}}-' THEN 'yyyy-MM-dd' WHEN m RLIKE '[.]' THEN IF({wide}, 'dd.MM.yyyy', 'd.M.yyyy') WHEN {parsed('M/d/yyyy')} IS NOT NULL THEN IF({wide}, 'MM/dd/yyyy', 'M/d/yyyy') ELSE IF({wide}, 'dd/MM/yyyy', 'd/M/yyyy') END"
        day = f"coalesce(IF(m RLIKE '^[0-9]{{4}}-', {parsed('yyyy-MM-dd')}, NULL), IF(m RLIKE '[.]', {parsed('d.M.yyyy')}, NULL), IF(m RLIKE '/', coalesce({parsed('M/d/yyyy')}, {parsed('d/M/yyyy')}), NULL))"

        def moved(first: int, a: int, b: int) -> str:
            shown = f"date_format(date_add(DATE'0001-01-01', cast({first} + s.l * {b} + s.r AS int)), {layout})"
            return self.feistel("date", f"(v - {first}) DIV {b}", f"(v - {first}) % {b}", str(a), str(b), shown)

        cases = " ".join(f"WHEN v < {first + a * b} THEN {moved(first, a, b)}" for first, a, b in ERAS)
        return self.let(f"datediff({day}, DATE'0001-01-01')", "v", f"CASE WHEN v IS NULL OR v < 0 THEN NULL {cases} END")

    def ip(self) -> str:
        part = lambda i: f"cast(o[{i}] AS bigint)"
        shown = "concat_ws('.', cast(s.l DIV 256 AS string), cast(s.l % 256 AS string), cast(s.r DIV 256 AS string), cast(s.r % 256 AS string))"
        return self.let("split(m, '[.]')", "o", self.feistel("ip", f"{part(0)} * 256 + {part(1)}", f"{part(2)} * 256 + {part(3)}", "65536", "65536", shown))

    def phone(self) -> str:
        """The country's code stays; a number of the North American plan stays one."""
        code = "IF(m LIKE '+%', length(regexp_extract(m, '^[+]([0-9]{1,3}?)(?=[ .(-]|[0-9]{7,12}$)', 1)), 0)"
        national = "substr(e, q + 1)"
        digit = lambda at, n=1: f"cast(substr(u, {at}, {n}) AS bigint)"
        first = f"({digit(1)} - 2) * 8000 + {digit(2, 2)} * 80 + ({digit(4)} - 2) * 10 + {digit(5)}"
        shown = "concat(cast(s.l DIV 8000 + 2 AS string), lpad(cast(s.l DIV 80 % 100 AS string), 2, '0'), cast(s.l DIV 10 % 8 + 2 AS string), cast(s.l % 10 AS string), lpad(cast(s.r AS string), 5, '0'))"
        plan = self.feistel("phone", first, digit(6, 5), "64000", "100000", shown)
        made = f"IF(length(u) = 10 AND u RLIKE '^[2-9][0-9]{{2}}[2-9]' AND (q = 0 OR e LIKE '1%'), {plan}, {self.digits('phone', 'u')})"
        whole = f"concat(substr(e, 1, q), {self.let(national, 'u', made)})"
        return self.let(self.only_digits("m"), "e", self.let(code, "q", f"IF(length(e) BETWEEN 8 AND 15 AND length(e) - q >= 6, {self.refill(whole)}, NULL)"))


def replacement() -> str:
    """SQL of struct(kind, value) for a candidate m; value is null if it isn't valid as any kind. s: m, if the secret
    pattern found it, which makes it a secret whatever else it fails to be."""
    sql = _Sql()
    made = {"email": sql.email(), "key": sql.key_id(), "secret": sql.opaque("secret"), "iban": sql.iban(), "card": sql.card(), "ssn": sql.ssn(), "date": sql.date(), "ip": sql.ip(), "phone": sql.phone()}
    cases = " ".join(f"WHEN m RLIKE {_lit(f'^(?:{p})$')} THEN named_struct('kind', '{k}', 'value', {made[k]})" for k, p in PATTERNS.items() if k != "secret")
    secret = f"named_struct('kind', 'secret', 'value', {made['secret']})"
    return _Sql.let(f"CASE {cases} END", "r", f"IF(r.value IS NULL AND s = m, {secret}, r)")


def pseudonymised(text: str) -> Column:
    """struct(text, kinds): the text with every valid candidate replaced, and the replaced ones' kinds in order, beside
    a column KEY_COL with the key. A null text gives a null text and no kinds; texts of any length are read whole.
    """
    body = f"cast(`{text}` AS string)"
    secrets = f"IF({body} RLIKE {_lit(SECRET_TRACE)}, regexp_extract_all({body}, {_lit(ANY)}, 1), cast(array() AS array<string>))"
    each = _Sql.let("coalesce(get(marked, at), '')", "s", f"named_struct('old', m, 'new', {replacement()})")
    found = _Sql.let(secrets, "marked", f"transform(regexp_extract_all({body}, {_lit(ANY)}, 0), (m, at) -> {each})")
    joined = f"array_join(zip_with(split({body}, {_lit(ANY)}, -1), f, (p, x) -> concat(p, coalesce(x.new.value, x.old, ''))), '')"
    kinds = "transform(filter(f, x -> x.new.value IS NOT NULL), x -> x.new.kind)"
    changed = f"transform(array({found}), f -> named_struct('text', {joined}, 'kinds', {kinds}))[0]"
    return F.expr(f"IF({body} RLIKE {_lit(TRACE)}, {changed}, named_struct('text', {body}, 'kinds', cast(array() AS array<string>)))")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", kinds_col: str | None = "pii_kinds") -> DataFrame:
    """docs with personal data in text_col replaced; kinds_col, if named, lists what was replaced in order.

    Every other column and row passes as it is, repeated rows too. Null texts stay null, empty ones empty, and an empty
    table gives none. A column that already has kinds_col's name is replaced; "__pii" and KEY_COL are refused.
    """
    carried(docs.columns, "__pii", KEY_COL)
    held = docs.sparkSession.createDataFrame([(hashlib.sha256(key.encode()).hexdigest(),)], "k string").scalar()
    keyed = docs.withColumn(KEY_COL, held)
    done = keyed.withColumn("__pii", pseudonymised(text_col)).drop(KEY_COL)
    out = done.withColumn(text_col, F.col("__pii.text"))
    return (out.withColumn(kinds_col, F.coalesce("__pii.kinds", F.array().cast("array<string>"))) if kinds_col else out).drop("__pii")
