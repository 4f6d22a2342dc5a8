"""Format-preserving pseudonyms for personal data, in DataFrame expressions only.

Values are found by pattern and validated: e-mail addresses, IPv4 addresses,
payment cards (Luhn), IBANs (mod 97), social security numbers, telephone
numbers, calendar dates, and keys or passwords that are named as such.  A valid
value is permuted within its format by a keyed Feistel network over the two
halves of its domain, so equal values get equal pseudonyms in every document and
different ones stay different; whoever holds the key can reverse it.  Check
digits are computed anew.  What fails validation is left as it is.

A card or an IBAN may stand beside other numbers or words of its form.  So a
whole run of such groups is taken, all of its stretches of groups are tried, and
those that are valid are values, usual groupings first, then from the left and
the longest; the rest of the run is searched for the other kinds.

Domains: runs of digits and of letters keep their length and class; a card keeps
its first digit; a telephone number its country code; an address its domain; a
date stays a valid date between 1700-01-01 and 2099-12-31 (146,097 days, which
is 27 times 5,411); runs over 20 characters are permuted in parts, and a part's
place in its value enters the permutation.  A telephone number's country code is
told by the numbering plan, so the ways to write a number have one pseudonym.

The key is a literal of the expression.  The session's
``spark.sql.redaction.string.regex`` is set so that Spark masks it in explained
plans, the user interface and event logs.

Edge cases: a null text stays null and has no values, an empty one stays empty;
ids may be null or repeated; other columns are kept by ``pseudonymise_column``
and ignored by ``pseudonymise``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
DEFAULT_KEY = "demonstration key"

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NAMES = "(?i:password|passwd|pwd|secret|token|api_key|apikey)"
NAMED = rf"(?<={_NAMES}\s{{0,2}}[=:]\s{{0,2}}[\"']?)"
#: What each kind looks like.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "secret": NAMED + r"[0-9A-Za-z][0-9A-Za-z_+/=.~-]{6,}[0-9A-Za-z=]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9-])(?:1[789]|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])",
    "day_first": r"(?<![0-9./])(?:0[1-9]|[12][0-9]|3[01])([./])(?:0[1-9]|1[0-2])\1(?:1[789]|20)[0-9]{2}(?![0-9/])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}([-.])[0-9]{3}\2[0-9]{4}(?![0-9.-])",
}


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Runs that may hold values of these kinds, at any of their groups.
RUNS = {"iban": r"\b[A-Z]{2}[0-9]{2}[A-Z0-9 ]{10,}[A-Z0-9]\b", "card": r"(?<![0-9])[0-9][0-9 -]{11,}[0-9](?![0-9])"}
#: Fixed value: country codes of one and two digits by the numbering plan; all others have three.
COUNTRY_CODE = "^([17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Masks the key in the text of a plan.
KEY_IN_PLAN = r"(?<=concat_ws\(\|, ).*?(?=, (?:ip|date|concat\(|[a-z]+/))"
#: What every text with a value holds.
HINT = f"[0-9@]|AKIA|{_NAMES}"


def _any(patterns: dict[str, str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns.values())


ANY = _any({k: p for k, p in PATTERNS.items() if k not in RUNS})


def _feistel(key: str, left: str, right: str, a: str, b: str, tweak: str) -> str:
    """A struct (l, r) in Z_a x Z_b: halves take turns to be shifted by a keyed hash of the other."""

    def digest(x: str) -> str:
        return f"cast(conv(substr(sha2(concat_ws('|', {_quote(key)}, {tweak}, cast(i as string), cast({x} as string)), 256), 1, 15), 16, 10) as bigint)"

    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> named_struct("
        f"'l', if(i % 2 = 0, pmod(s.l + pmod({digest('s.r')}, {a}), {a}), s.l), 'r', if(i % 2 = 1, pmod(s.r + pmod({digest('s.l')}, {b}), {b}), s.r)))"
    )


def _let(name: str, value: str, body: str) -> str:
    """Bind a value once within an expression."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _run(key: str, x: str, radix: int, tweak: str) -> str:
    """Permute a string of up to 20 digits of a radix (10, 16, or 26 as the first digits 0-9a-p)."""
    h = f"(length({x}) div 2)"
    a, b = f"cast(pow({radix}, {h}) as bigint)", f"cast(pow({radix}, length({x}) - {h}) as bigint)"
    number = lambda part: f"coalesce(cast(conv({part}, {radix}, 10) as bigint), 0)"
    swap = _feistel(key, number(f"substr({x}, 1, {h})"), number(f"substr({x}, {h} + 1)"), a, b, f"concat({tweak}, '/', {radix}, '/', length({x}))")
    back = lambda v, n: f"if({n} = 0, '', lpad(lower(conv(cast({v} as string), 10, {radix})), {n}, '0'))"
    return _let("y", swap, f"concat({back('y.l', h)}, {back('y.r', f'length({x}) - {h}')})")


_LETTERS, _DIGITS26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"


def _placed(tweak: str) -> str:
    """The tweak of the part at index ``at`` of a value."""
    return f"concat({tweak}, if(at = 0, '', concat('#', at)))"


def _runs(key: str, value: str, tweak: str) -> str:
    """Permute each run of digits, of small and of capital letters on its own, by its place; keep all else."""
    tweak = _placed(tweak)
    letters = lambda x: f"translate({_let('z', f'translate({x}, {_quote(_LETTERS)}, {_quote(_DIGITS26)})', _run(key, 'z', 26, tweak))}, {_quote(_DIGITS26)}, {_quote(_LETTERS)})"
    return (
        f"array_join(transform(regexp_extract_all({value}, '[0-9]{{1,20}}|[a-z]{{1,20}}|[A-Z]{{1,20}}|[^0-9A-Za-z]+', 0), (w, at) -> "
        f"case when w rlike '^[0-9]' then {_run(key, 'w', 10, tweak)} when w rlike '^[a-z]' then {letters('w')} "
        f"when w rlike '^[A-Z]' then upper({letters('lower(w)')}) else w end), '')"
    )


def _only_digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _refill(value: str, digits: str) -> str:
    """The digits in the places of those of ``value``; all else as it was."""
    return _let(
        "d", digits,
        f"aggregate(sequence(1, length({value})), named_struct('o', '', 'k', 1), (f, j) -> if(substr({value}, j, 1) between '0' and '9', "
        f"named_struct('o', concat(f.o, substr(d, f.k, 1)), 'k', f.k + 1), named_struct('o', concat(f.o, substr({value}, j, 1)), 'k', f.k))).o",
    )


def _luhn(x: str) -> str:
    """Luhn sum of a digit string that ends in its check digit."""
    digit = f"cast(substr({x}, length({x}) - c + 1, 1) as int)"
    return f"aggregate(sequence(1, length({x})), cast(0 as bigint), (t, c) -> t + if(c % 2 = 1, {digit}, ({digit} * 2) div 10 + ({digit} * 2) % 10))"


def _mod97(x: str) -> str:
    """An IBAN's number mod 97, letters as 10 to 35, the first four characters last."""
    return (
        f"aggregate(split(concat(substr({x}, 5), substr({x}, 1, 4)), ''), cast(0 as bigint), (t, c) -> case when c = '' then t "
        f"when c between '0' and '9' then (t * 10 + cast(c as int)) % 97 else (t * 100 + ascii(c) - 55) % 97 end)"
    )


def _stretches(v: str, groups: str, reach: int, valid: str, usual: str) -> str:
    """The segments (text, value) of a run: its stretches of up to ``reach`` groups and gaps that are ``valid``, and what is between them.

    Of stretches w that overlap a ``usual`` one comes before others, then the leftmost, then the longest.
    """
    join = lambda i, j: f"array_join(slice(g, {i} + 1, {j} - {i} + 1), '')"
    found = (
        f"flatten(transform(sequence(0, size(g) - 1, 2), i -> filter(transform(sequence(i, least(size(g) - 1, i + {reach}), 2), j -> {_let('w', join('i', 'j'), f'named_struct({_quote("i")}, i, {_quote("r")}, if({usual}, 0, 1), {_quote("l")}, -j, {_quote("ok")}, {valid})')}), c -> c.ok)))"
    )
    apart = "filter(f, c -> c.r = 0 or not exists(filter(f, b -> b.r = 0), b -> b.i <= -c.l and -b.l >= c.i))"
    picked = (
        f"aggregate(array_sort({apart}), named_struct('e', -1, 'p', cast(array() as array<struct<i:int,j:int>>)), "
        "(a, c) -> if(c.i > a.e, named_struct('e', -c.l, 'p', concat(a.p, array(named_struct('i', c.i, 'j', -c.l)))), a)).p"
    )
    start = "if(k = 0, 0, p[k - 1].j + 1)"
    parts = f"flatten(transform(p, (c, k) -> array(named_struct('text', {join(start, '(c.i - 1)')}, 'value', false), named_struct('text', {join('c.i', 'c.j')}, 'value', true))))"
    last = f"named_struct('text', {join('if(size(p) = 0, 0, p[size(p) - 1].j + 1)', '(size(g) - 1)')}, 'value', false)"
    return _let("g", f"regexp_extract_all({v}, {_quote(groups)}, 0)", _let("f", found, _let("p", picked, f"concat({parts}, array({last}))")))


def _segments(t: str, kind: str) -> str:
    """A text as an array of (plain, value): what stands before each valid card or IBAN and the value; the last has no value."""
    search = _quote(_any({k: p for k, p in PATTERNS.items() if k not in RUNS} | {kind: RUNS[kind]}))
    plain = lambda x: f"array(named_struct('text', {x}, 'value', false))"
    if kind == "card":
        tried = _stretches("v", "[0-9]+|[ -]+", 36, f"w rlike '^[0-9](?:[ -]?[0-9]){{12,18}}$' and {_luhn(_only_digits('w'))} % 10 = 0", "w rlike '^(?:[0-9]+|[0-9]{4}([ -])[0-9]{4}\\\\1[0-9]{4}\\\\1[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$'")
        run = f"v rlike '^[0-9][0-9 -]{{11,}}[0-9]$' and length({_only_digits('v')}) > 12"
    else:
        squeezed = "replace(w, ' ', '')"
        tried = _stretches("v", "[^ ]+| +", 26, f"w rlike {_quote('^(?:' + PATTERNS['iban'] + ')$')} and length({squeezed}) between 15 and 34 and {_mod97(squeezed)} = 1", "true")
        run = f"v rlike {_quote('^(?:' + RUNS['iban'] + ')$')}"
    runs = f"if({run}, {tried}, {plain('v')})"
    both = f"flatten(zip_with(split({t}, {search}, -1), transform(regexp_extract_all({t}, {search}, 0), v -> {runs}), (a, b) -> concat({plain('a')}, coalesce(b, cast(array() as array<struct<text:string,value:boolean>>)))))"
    closed = (
        f"aggregate({both}, named_struct('done', cast(array() as array<struct<plain:string,value:string>>), 'rest', ''), (s, x) -> "
        "if(x.value, named_struct('done', concat(s.done, array(named_struct('plain', s.rest, 'value', x.text))), 'rest', ''), named_struct('done', s.done, 'rest', concat(s.rest, x.text))))"
    )
    whole = f"array(named_struct('plain', {t}, 'value', cast(null as string)))"
    return f"if({t} rlike {_quote(RUNS[kind])}, {_let('y', closed, 'concat(y.done, array(named_struct(' + _quote('plain') + ', y.rest, ' + _quote('value') + ', cast(null as string))))')}, {whole})"


def _date(key: str, year: str, month: str, day: str, make: str, value: str) -> str:
    """``make``: the new value, of a date named d."""
    real = f"try_to_date(concat_ws('-', {year}, {month}, {day}), 'yyyy-MM-dd')"
    n = "datediff(e, date'1700-01-01')"
    swap = _feistel(key, f"{n} div 5411", f"{n} % 5411", "27", "5411", "'date'")
    return _let("e", real, f"if(e is null, {value}, {_let('g', swap, _let('d', 'date_add(date' + chr(39) + '1700-01-01' + chr(39) + ', cast(g.l * 5411 + g.r as int))', make))})")


def pseudonym_sql(v: str, key: str) -> str:
    """The pseudonym of a found value ``v``, or ``v`` itself if it is not valid."""
    # What stands before a secret isn't part of the value.
    kind = {k: f"{v} rlike {_quote('^(?:' + p.removeprefix(NAMED) + ')$')}" for k, p in PATTERNS.items()}
    ip = _let("p", f"transform(split({v}, '[.]'), o -> cast(o as bigint))", _let("q", _feistel(key, "p[0] * 256 + p[1]", "p[2] * 256 + p[3]", "65536", "65536", "'ip'"), "concat_ws('.', q.l div 256, q.l % 256, q.r div 256, q.r % 256)"))
    number = _only_digits(v)
    valid = _let("n", number, "length(n) between 13 and 19 and " + _luhn("n") + " % 10 = 0")
    card = _let("n", number, _refill(v, _let(
        "m", f"concat(substr(n, 1, 1), {_let('z', 'substr(n, 2, length(n) - 2)', _run(key, 'z', 10, _quote('card')))}, '0')", "concat(substr(m, 1, length(m) - 1), pmod(10 - " + _luhn("m") + " % 10, 10))")))
    iban = _let("n", f"replace({v}, ' ', '')", "if(length(n) between 15 and 34 and " + _mod97("n") + " = 1, " + _let(
        "b", _runs(key, "substr(n, 5)", _quote("iban")), _let("k", "concat(substr(n, 1, 2), '00', b)", f"aggregate(sequence(1, length({v})), named_struct('o', '', 'k', 1), (f, j) -> if(substr({v}, j, 1) = ' ', "
        "named_struct('o', concat(f.o, ' '), 'k', f.k), named_struct('o', concat(f.o, substr(concat(substr(k, 1, 2), lpad(cast(98 - " + _mod97("k") + " as string), 2, '0'), b), f.k, 1)), 'k', f.k + 1))).o")) + f", {v})")
    iso = _date(key, f"substr({v}, 1, 4)", f"substr({v}, 6, 2)", f"substr({v}, 9, 2)", "date_format(d, 'yyyy-MM-dd')", v)
    first = _date(key, f"substr({v}, 7, 4)", f"substr({v}, 4, 2)", f"substr({v}, 1, 2)", f"concat(date_format(d, 'dd'), substr({v}, 3, 1), date_format(d, 'MM'), substr({v}, 6, 1), date_format(d, 'yyyy'))", v)
    hexes = f"array_join(transform(regexp_extract_all({v}, '.{{1,20}}', 0), (w, at) -> {_run(key, 'w', 16, _placed(_quote('hex')))}), '')"
    ssn = _refill(v, _let("z", _only_digits(v), _run(key, "z", 10, _quote("ssn"))))
    return (
        f"case when {kind['email']} then concat({_runs(key, f'substring_index({v}, {_quote(chr(64))}, 1)', _quote('email'))}, '@', substring_index({v}, '@', -1)) "
        f"when {kind['key']} then concat('AKIA', {_runs(key, f'substr({v}, 5)', _quote('key'))}) "
        f"when {kind['ip']} then {ip} when {kind['date']} then {iso} when {kind['day_first']} then {first} when {kind['ssn']} then {ssn} "
        f"when {kind['iban']} then {iban} when {kind['card']} and {valid} then {card} when {kind['card']} then {v} "
        f"when {v} rlike '^[^A-Za-z]*[(+.-][^A-Za-z]*$' then {_phone(v, key)} "
        f"when {v} rlike '^[0-9a-f]*[a-f][0-9a-f]*$' then {hexes} when {kind['secret']} and {v} rlike '[A-Za-z]' then {_runs(key, v, _quote('secret'))} else {v} end"
    )


def _phone(v: str, key: str) -> str:
    code = f"if({v} like '+%', regexp_extract({_only_digits(v)}, {_quote(COUNTRY_CODE)}, 1), '')"
    return _let("h", code, _let("z", f"substr({_only_digits(v)}, length(h) + 1)", f"if({v} rlike '[(+.-]' and length(z) between 6 and 15, {_refill(v, 'concat(h, ' + _run(key, 'z', 10, _quote('phone')) + ')')}, {v})"))


def _mask_key() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        name = "spark.sql.redaction.string.regex"
        held = spark.conf.get(name, None)
        if not held or KEY_IN_PLAN not in held:
            spark.conf.set(name, f"{held}|{KEY_IN_PLAN}" if held else KEY_IN_PLAN)


def pseudonymise_column(name: str, key: str = DEFAULT_KEY) -> Column:
    """A struct: ``text`` with pseudonyms, ``n`` values that changed."""
    _mask_key()
    t = "`" + name.replace("`", "``") + "`"
    # Values and what stands before each; the last of a stretch takes the value that ends it.
    ended = lambda pairs, value: _let("z", pairs, f"concat(slice(z, 1, size(z) - 1), array(named_struct('plain', element_at(z, -1).plain, 'value', {value})))")
    rest = f"zip_with(split(q.plain, {_quote(ANY)}, -1), regexp_extract_all(q.plain, {_quote(ANY)}, 0), (a, b) -> named_struct('plain', a, 'value', b))"
    valid = f"flatten(transform({_segments(t, 'iban')}, h -> {ended(_segments('h.plain', 'card'), 'h.value')}))"
    found = f"flatten(transform({valid}, q -> {ended(rest, 'q.value')}))"
    made = f"transform({found}, u -> {_let('v', 'u.value', f'named_struct({_quote("plain")}, u.plain, {_quote("old")}, v, {_quote("new")}, if(v is null, {_quote("")}, {pseudonym_sql("v", key)}))')})"
    changed = _let("x", made, "named_struct('text', array_join(transform(x, b -> concat(b.plain, b.new)), ''), 'n', size(filter(x, b -> b.old <> b.new)))")
    return F.expr(f"if({t} rlike {_quote(HINT)}, {changed}, named_struct('text', {t}, 'n', 0))")


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = DEFAULT_KEY) -> DataFrame:
    """``doc_id``, ``text`` with pseudonyms and ``n_values`` for each row of ``docs``."""
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), pseudonymise_column(text_col, key).alias("p"))
    return found.select("doc_id", F.col("p.text").alias("text"), F.coalesce("p.n", F.lit(0)).cast("long").alias("n_values"))
