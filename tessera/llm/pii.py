"""PII pseudonyms that keep the format: keyed Feistel networks over validated values. DataFrame functions only.

Found values, and what their pseudonyms keep:
 card    13 to 19 digits, or groups of four, with a right Luhn digit: separators, and a right Luhn digit
 phone   + country code and 7 to 12 more digits: the country code and all signs; or (ddd) ddd-dddd, ddd-ddd-dddd,
         ddd.ddd.dddd: all signs
 ssn     ddd-dd-dddd, not 000, 666 or 9dd, 00, 0000: the hyphens (digits are permuted until valid)
 ip      four numbers up to 255 without leading zeros: the same
 date    yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, dd/mm/yyyy, of 1800 to 2199: a date of that form there
 email   a name at a domain: the domain and the name's length, signs, cases and digit places
Each kind's network permutes exactly its own format, keyed by SHA-256 of key, kind, round and the other
half. The key is a scalar subquery, so that neither plans nor event logs show it. So a value has one pseudonym in all documents, different values have different ones, and the key
gives the values back (invert=True). Numbers that fail validation stay as they are.

Texts are cut at the matches and put together again, so no pseudonym is replaced twice. Host names have 127
labels of 63 characters at most; of a longer run of labels the first are taken. Work is linear in a value's length.
Null text stays null; other columns, whatever their names, and repeated rows stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KEY = "_key"  # the column that holds the key
_DAYS, _WIDE = 146_097, 189  # days of 400 years = 773 * 189

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,63}"
PHONE = r"(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
NATIONAL = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?[0-9]{3}[-. ]|[0-9]{3}-[0-9]{3}-|[0-9]{3}\.[0-9]{3}\.)[0-9]{4}(?![0-9A-Za-z-]|\.[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IP = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?)(?![0-9])"
#: A country code up to a sign, or else by the prefix rules of E.164.
_COUNTRY = "^[+](?:[0-9]{1,3}(?=[ .(-])|[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
ANY = "|".join((EMAIL, PHONE, NATIONAL, DATE, SSN, IP, CARD))


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(kind: str, turn: str, other: str, at: str = "0") -> str:
    """SQL for a keyed 48-bit number: of the round, the other half, and a place in this one."""
    return f"cast(conv(substring(sha2(concat_ws('|', {KEY}, '{kind}', {turn}, {at}, {other}), 256), 1, 12), 16, 10) as bigint)"


def _rounds(invert: bool) -> str:
    return f"sequence({ROUNDS}, 1, -1)" if invert else f"sequence(1, {ROUNDS})"


def _signs(codes: str, kind: str, invert: bool) -> str:
    """SQL for the permuted array of (v, r): a value below its radix r at each place; what has the radix 1 stays."""
    sign = "-" if invert else "+"

    def turned(this: str, other: str) -> str:
        text = f"sha2(array_join(transform({other}, o -> concat_ws(':', o.v, o.r)), ','), 256)"  # the other half is read once a round
        return _let(text, "f", f"transform({this}, (c, j) -> named_struct('v', if(c.r = 1, c.v, cast(pmod(c.v {sign} {_number(kind, 'i', 'f', 'j')}, c.r) as int)), 'r', c.r))")

    step = f"if(i % 2 = 0, named_struct('a', {turned('s.a', 's.b')}, 'b', s.b), named_struct('a', s.a, 'b', {turned('s.b', 's.a')}))"
    halves = "named_struct('a', slice(w, 1, size(w) div 2), 'b', slice(w, size(w) div 2 + 1, size(w)))"
    done = f"aggregate({_rounds(invert)}, {halves}, (s, i) -> {step})"
    return _let(codes, "w", _let(done, "z", "concat(z.a, z.b)"))


def _codes(text: str) -> str:
    """SQL for the (v, r) of a text's letters and digits."""
    return f"transform(filter(split({text}, ''), c -> c rlike '[0-9A-Za-z]'), c -> case when c rlike '[0-9]' then named_struct('v', ascii(c) - 48, 'r', 10) when c rlike '[a-z]' then named_struct('v', ascii(c) - 97, 'r', 26) else named_struct('v', ascii(c) - 65, 'r', 26) end)"


def _put(text: str, codes: str) -> str:
    """SQL for the text with its letters and digits replaced by codes, in order; cases stay."""
    nth = "size(filter(slice(t, 1, k + 1), o -> o rlike '[0-9A-Za-z]'))"
    one = f"case when c rlike '[0-9]' then char(48 + element_at(y, {nth}).v) when c rlike '[a-z]' then char(97 + element_at(y, {nth}).v) when c rlike '[A-Z]' then char(65 + element_at(y, {nth}).v) else c end"
    return _let(f"split({text}, '')", "t", _let(codes, "y", f"array_join(transform(t, (c, k) -> {one}), '')"))


def _luhn(digits: str, double_last: bool) -> str:
    """SQL for the Luhn sum of an array of (v, r)."""
    return f"aggregate(transform(reverse({digits}), (d, k) -> if(k % 2 = {0 if double_last else 1}, if(d.v > 4, 2 * d.v - 9, 2 * d.v), d.v)), 0, (n, v) -> n + v)"


def card(m: str, invert: bool) -> str:
    body = "slice(x, 1, size(x) - 1)"
    new = _signs(body, "card", invert)
    last = f"array(named_struct('v', cast(pmod(10 - {_luhn('g', True)} % 10, 10) as int), 'r', 10))"
    return _let(_codes(m), "x", _put(m, _let(new, "g", f"concat(g, {last})")))


def phone(m: str, invert: bool) -> str:
    """The first run of digits is the country code; if it is longer than 3, E.164's prefix rules cut the code off."""
    head = f"regexp_extract({m}, '{_COUNTRY}', 0)"
    return _let(head, "head", f"concat(head, {_let(f'substring({m}, length(head) + 1)', 'tail', _put('tail', _signs(_codes('tail'), 'phone', invert)))})")


def valid_ssn(m: str) -> str:
    return f"(substring({m}, 1, 3) not in ('000', '666') and substring({m}, 1, 1) <> '9' and substring({m}, 5, 2) <> '00' and substring({m}, 8, 4) <> '0000')"


def ssn(m: str, invert: bool) -> str:
    """898 areas * 99 groups * 9,999 numbers, as a network over areas and the rest."""
    area = f"(cast(substring({m}, 1, 3) as bigint) - if(substring({m}, 1, 3) > '666', 2, 1))"
    rest = f"((cast(substring({m}, 5, 2) as bigint) - 1) * 9999 + cast(substring({m}, 8, 4) as bigint) - 1)"
    out = "concat_ws('-', lpad(cast(if(z.a + 1 >= 666, z.a + 2, z.a + 1) as string), 3, '0'), lpad(cast(z.b div 9999 + 1 as string), 2, '0'), lpad(cast(z.b % 9999 + 1 as string), 4, '0'))"
    return _let(_pair(area, "898", rest, "989901", "ssn", invert), "z", out)


def _pair(a: str, na: str, b: str, nb: str, kind: str, invert: bool) -> str:
    """SQL for a network over two numbers, below na and nb."""
    sign = "-" if invert else "+"
    step = f"if(i % 2 = 0, named_struct('a', pmod(s.a {sign} {_number(kind, 'i', 's.b')}, {na}L), 'b', s.b), named_struct('a', s.a, 'b', pmod(s.b {sign} {_number(kind, 'i', 's.a')}, {nb}L)))"
    return f"aggregate({_rounds(invert)}, named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, i) -> {step})"


def ip(m: str, invert: bool) -> str:
    part = [f"cast(element_at(o, {k}) as bigint)" for k in (1, 2, 3, 4)]
    pair = _pair(f"{part[0]} * 256 + {part[1]}", "65536", f"{part[2]} * 256 + {part[3]}", "65536", "ip", invert)
    return _let(f"split({m}, '[.]')", "o", _let(pair, "z", "concat_ws('.', cast(z.a div 256 as string), cast(z.a % 256 as string), cast(z.b div 256 as string), cast(z.b % 256 as string))"))


def _form(m: str) -> str:
    return f"case when substring({m}, 5, 1) in ('-', '/') then concat_ws(substring({m}, 5, 1), 'yyyy', 'MM', 'dd') else concat_ws(substring({m}, 3, 1), 'dd', 'MM', 'yyyy') end"


def _day(m: str) -> str:
    """SQL for the days from 1800-01-01 of a date in any of the forms; null if there is no such day."""
    iso = f"case when substring({m}, 5, 1) in ('-', '/') then replace({m}, '/', '-') else concat_ws('-', substring({m}, 7, 4), substring({m}, 4, 2), substring({m}, 1, 2)) end"
    return f"datediff(try_to_date({iso}, 'yyyy-MM-dd'), date'1800-01-01')"


def date(m: str, invert: bool) -> str:
    pair = _pair(f"n div {_WIDE}", str(_DAYS // _WIDE), f"n % {_WIDE}", str(_WIDE), "date", invert)
    return _let(f"cast({_day(m)} as bigint)", "n", _let(pair, "z", f"date_format(date_add(date'1800-01-01', cast(z.a * {_WIDE} + z.b as int)), {_form(m)})"))


def email(m: str, invert: bool) -> str:
    """The name's signs belong to the value, as codes of radix 1, so each character is looked at once."""
    name = f"substring_index({m}, '@', 1)"
    codes = f"transform(filter(split({name}, ''), c -> c <> ''), c -> case when c rlike '[0-9]' then named_struct('v', ascii(c) - 48, 'r', 10) when c rlike '[a-z]' then named_struct('v', ascii(c) - 97, 'r', 26) when c rlike '[A-Z]' then named_struct('v', ascii(c) - 65, 'r', 27) else named_struct('v', ascii(c), 'r', 1) end)"
    # 27 marks capitals; their values are turned modulo 26 like the others
    lower = "transform(k, c -> named_struct('v', c.v, 'r', if(c.r = 27, 26, c.r)))"
    out = "array_join(zip_with(k, y, (c, n) -> case c.r when 10 then char(48 + n.v) when 26 then char(97 + n.v) when 27 then char(65 + n.v) else char(c.v) end), '')"
    return f"concat({_let(codes, 'k', _let(_signs(lower, 'email', invert), 'y', out))}, '@', substring_index({m}, '@', -1))"


def _kind(m: str) -> str:
    digits = f"length(regexp_replace({m}, '[^0-9]', ''))"
    return f"""case
        when contains({m}, '@') then 'email'
        when startswith({m}, '+') then if({digits} between 8 and 15 and {m} rlike '{_COUNTRY}', 'phone', null)
        when {m} rlike '^([(][0-9]{{3}}[)] ?[0-9]{{3}}[-. ]|[0-9]{{3}}-[0-9]{{3}}-|[0-9]{{3}}[.][0-9]{{3}}[.])[0-9]{{4}}$' then 'phone'
        when {m} rlike '^([0-9]{{4}}[-/][0-9]{{2}}[-/]|[0-9]{{2}}[./][0-9]{{2}}[./])' and {m} rlike '^[0-9./-]{{10}}$' then if({_day(m)} between 0 and {_DAYS - 1}, 'date', null)
        when {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then if({valid_ssn(m)}, 'ssn', null)
        when contains({m}, '.') then if(forall(split({m}, '[.]'), p -> cast(p as int) < 256 and p = cast(cast(p as int) as string)), 'ip', null)
        else if({_let(_codes(m), 'x', _luhn('x', False) + ' % 10 = 0')} and {digits} >= 13, 'card', null) end"""


KINDS = {"card": card, "phone": phone, "ssn": ssn, "ip": ip, "date": date, "email": email}


def values(text: str) -> Column:
    """The array of (found, kind) of a text, in order; kind is null for what fails validation."""
    return F.expr(f"transform(regexp_extract_all({text}, {_quoted(ANY)}, 0), m -> named_struct('found', m, 'kind', {_kind('m')}))")


def pseudonym(found: str, kind: str, invert: bool = False) -> str:
    """SQL for the pseudonym of a value of a kind."""
    return f"case {' '.join(f"when {kind} = '{k}' then {f(found, invert)}" for k, f in KINDS.items())} else {found} end"


def pseudonymize(docs: DataFrame, key: str, invert: bool = False) -> DataFrame:
    """docs with its text's values replaced, and pii_values, pii_pseudonyms and pii_kinds: arrays in the order of the text."""
    names = docs.columns
    rows = docs.toDF(*["text" if c == "text" else f"c{k}" for k, c in enumerate(names)])
    maybe = F.col("text").rlike("[0-9@]")
    none = F.expr("cast(array() as array<struct<found:string,kind:string>>)")
    rows = rows.withColumn("_values", F.when(maybe, values("text")).otherwise(none)).withColumn(KEY, docs.sparkSession.createDataFrame([(key,)], "k string").scalar())
    rows = rows.withColumn("_new", F.expr(f"transform(_values, v -> {pseudonym('v.found', 'v.kind', invert)})"))
    gaps = f"split(text, {_quoted(ANY)})"
    text = F.when(F.size("_values") > 0, F.expr(f"array_join(flatten(zip_with({gaps}, _new, (g, n) -> array(g, coalesce(n, '')))), '')")).otherwise(F.col("text"))
    real = "transform(filter(arrays_zip(_values, _new), z -> z._values.kind is not null), z -> {})"
    more = {"pii_values": "z._values.found", "pii_pseudonyms": "z._new", "pii_kinds": "z._values.kind"}
    same = [text.alias(c) if c == "text" else F.col(f"c{k}").alias(c) for k, c in enumerate(names) if c not in more]
    return rows.select(*same, *[F.expr(real.format(x)).alias(c) for c, x in more.items()])
