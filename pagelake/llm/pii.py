"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations in SQL expressions.

Found kinds: e-mail addresses, payment cards (13 to 19 digits that pass the Luhn check), telephone numbers, US social
security numbers (of areas, groups and serials that are given out), dates and IPv4 addresses. A value is permuted bare:
the digits of a card, of a telephone number without its country's, the letters of an address in lower case. Then its
format is put back: separators, letters' case. So a value has one pseudonym however it is written, different values have
different ones, a card passes the Luhn check again, an address has octets below 256, a date is a date written the same
way. The permutation depends on the key and the kind alone; who has the key can undo it (`undone`). A key is asked for:
one that stands in code protects nothing.

Generic strings alternate between their halves: each character of a half moves within its alphabet by a number drawn
from the hash of the other half. Numbers of a fixed range do the same with quotient and remainder.

A run of digit groups is searched for cards: sub-runs of whole groups with 13 to 19 digits that pass the check. The
whole run comes first, then 16, 15 and other digits, each from the left; what is left of the run is searched for the
other kinds. Dates with slashes are day first where that is a date, else month first; the latter keep a day above 12
and are not linked with other spellings. A telephone number after + without separators is permuted whole.

Null texts stay null; empty texts and texts without a valid value stay as they are; an empty table gives no rows. Runs
that fail their check (a wrong Luhn digit, an octet of 300, a 31st of February, a date before 1900 or after FIRST +
DAYS, area 000) are no personal data here. A very long text is one array of its parts; no pattern recurses, so its
length costs time in proportion. Where kinds tie for a place, the first of PATTERNS has it. Repeated rows give equal
rows. Extra columns are kept by `pseudonymised`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_before, rows_of

KINDS = ("email", "card", "phone", "ssn", "date", "ip")
_NOT_BEFORE, _NOT_AFTER = r"(?<![A-Za-z0-9.+-])", r"(?![A-Za-z0-9]|[.-][0-9])"
# No group is repeated without bound: Java's regex would recurse for each time.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PATTERNS = {
    "email": EMAIL,
    "ip": _NOT_BEFORE + r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}" + _NOT_AFTER,
    "date": _NOT_BEFORE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})" + _NOT_AFTER,
    "ssn": _NOT_BEFORE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _NOT_AFTER,
    "phone": _NOT_BEFORE + "(?:" + "|".join([
        r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
        r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-][0-9]{2}){4}",
        r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}",
        r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,5}\)?[ .-][0-9]{5,8}",
        r"\+[0-9]{8,15}",
        r"[2-9][0-9]{2}[2-9][0-9]{6}",
    ]) + ")" + _NOT_AFTER,
    # Possessive, as Java's regex recurses over groups it may have to give back.
    "card": _NOT_BEFORE + r"(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![A-Za-z]|[.][0-9])(?:[ -][0-9]++(?![A-Za-z]|[.][0-9]))*+" + _NOT_AFTER,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
NO_CARD = "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "card")
#: Dates are permuted among DAYS = 250 * 292 days from FIRST.
FIRST, RADIX = "1900-01-01", (250, 292)
ROUNDS = 8
#: What stays of a telephone number: + and, where its end can be seen, the country's number.
_COUNTRY = "^(?:[+](?:[0-9]{1,3}(?=[ .(-])[ .-]?)?)?"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _drawn(key: str, kind: str, step: str, half: str) -> str:
    """A number below 2**32 from the hash of the other half."""
    return f"cast(conv(substring(sha2(concat_ws('|', {_q(key)}, {_q(kind)}, {step}, {half}), 256), 1, 8), 16, 10) AS bigint)"


def _moved(half: str, other: str, key: str, kind: str, step: str, back: bool) -> str:
    """`half` with each digit and letter moved within its alphabet by two hexadecimal digits of the hash of `other`."""
    by = "cast(conv(substring(x.h, 2 * ((j - 1) % 64) + 1, 2), 16, 10) AS int)"
    moved = lambda a: f"pmod(instr('{a}', c) - 1 {'-' if back else '+'} {by}, {len(a)})"
    cases = " ".join(f"WHEN instr('{a}', c) > 0 THEN substring('{a}', {moved(a)} + 1, 1)" for a in ("0123456789", "abcdefghijklmnopqrstuvwxyz"))
    cases = cases.replace(", c)", ", substring(x.s, j, 1))")
    return f"""array_join(flatten(transform(array(struct({half} AS s, sha2(concat_ws('|', {_q(key)}, {_q(kind)}, {step}, {other}), 512) AS h)), x ->
      if(x.s = '', array(''), transform(sequence(1, length(x.s)), j -> CASE {cases} ELSE substring(x.s, j, 1) END)))), '')"""


def _rounds(back: bool) -> str:
    return f"sequence({ROUNDS}, 1, -1)" if back else f"sequence(1, {ROUNDS})"


def permuted(value: str, key: str, kind: str, back: bool = False) -> str:
    """SQL for the pseudonym of a string of digits and lower-case letters; back: for the string of a pseudonym."""
    left, right = _moved("a.l", "a.r", key, kind, "i", back), _moved("a.r", "a.l", key, kind, "i", back)
    step = f"if(i % 2 = 0, named_struct('l', {left}, 'r', a.r), named_struct('l', a.l, 'r', {right}))"
    start = f"named_struct('l', substring({value}, 1, length({value}) div 2), 'r', substring({value}, length({value}) div 2 + 1))"
    return f"aggregate({_rounds(back)}, {start}, (a, i) -> {step}, a -> concat(a.l, a.r))"


def _number(x: str, y: str, most_x: int, most_y: int, key: str, kind: str, done: str, back: bool) -> str:
    """SQL that permutes the pair of numbers x < most_x, y < most_y and puts the result, n.x and n.y, in `done`."""
    sign = "-" if back else "+"
    step = f"""if(i % 2 = 0, named_struct('x', pmod(n.x {sign} {_drawn(key, kind, 'i', 'n.y')}, {most_x}), 'y', n.y),
      named_struct('x', n.x, 'y', pmod(n.y {sign} {_drawn(key, kind, 'i', 'n.x')}, {most_y})))"""
    return f"aggregate({_rounds(back)}, named_struct('x', cast({x} AS bigint), 'y', cast({y} AS bigint)), (n, i) -> {step}, n -> {done})"


def _bare(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def _spelled(old: str, digits: str) -> str:
    """SQL for `old` with its digits replaced by `digits`, in order."""
    char = "substring(w.o, j, 1)"
    each = f"transform(sequence(1, length(w.o)), j -> if({char} BETWEEN '0' AND '9', substring(w.d, length({_bare('substring(w.o, 1, j)')}), 1), {char}))"
    return f"transform(array(named_struct('o', {old}, 'd', {digits})), w -> if(w.o = '', '', array_join({each}, '')))[0]"


def _cased(old: str, new: str) -> str:
    """SQL for `new` with capitals where `old`, of the same length, has them."""
    char = "substring(w.n, j, 1)"
    return f"transform(array(named_struct('o', {old}, 'n', {new})), w -> array_join(transform(sequence(1, length(w.o)), j -> if(substring(w.o, j, 1) BETWEEN 'A' AND 'Z', upper({char}), {char})), ''))[0]"


def luhn_sum(digits: str, from_right: int) -> str:
    """SQL for the Luhn sum of a string of digits whose last digit stands at `from_right` (0: it is the check digit)."""
    value = f"cast(substring({digits}, j, 1) AS int)"
    twice = f"cast(({value} * 2) div 10 + ({value} * 2) % 10 AS int)"
    return f"aggregate(sequence(1, length({digits})), 0, (s, j) -> s + if((length({digits}) - j + {from_right}) % 2 = 1, {twice}, {value}))"


def _date(v: str) -> str:
    return f"coalesce(try_to_date({v}, 'yyyy-MM-dd'), try_to_date({v}, 'dd/MM/yyyy'), try_to_date({v}, 'dd.MM.yyyy'))"


def _month_first(v: str) -> str:
    """SQL for the date written month first, null if its day could be a month: then it is day first."""
    return f"if(substring({v}, 3, 1) = '/' AND substring({v}, 4, 2) > '12', try_to_date({v}, 'MM/dd/yyyy'), null)"


def _month_first_pseudonym(key: str, back: bool) -> str:
    """Days 13 to 28 are permuted with month and year, 29 and 30 with those but February, 31 with the long months, 29 February among leap years."""
    y, m, d = "cast(substring(h.v, 7, 4) AS int) - 1900", "cast(substring(h.v, 1, 2) AS int)", "cast(substring(h.v, 4, 2) AS int)"
    out = lambda month, day, year="n.x + 1900": f"concat(lpad(cast({month} AS string), 2, '0'), '/', {day}, '/', {year})"
    long = "array(1, 3, 5, 7, 8, 10, 12)"
    leap = _number(f"(({y}) div 4 - 1) div 7", f"(({y}) div 4 - 1) % 7", 7, 7, key, "mdy-leap", out("2", "29", "1904 + 4 * (n.x * 7 + n.y)"), back)
    day31 = _number(y, f"array_position({long}, {m}) - 1", 200, 7, key, "mdy-31", out(f"{long}[cast(n.y AS int)]", "31"), back)
    day29 = _number(y, f"({m} - if({m} > 2, 2, 1)) * 2 + {d} - 29", 200, 22, key, "mdy-29", out("n.y div 2 + if(n.y >= 2, 2, 1)", "29 + n.y % 2"), back)
    rest = _number(y, f"({m} - 1) * 16 + {d} - 13", 200, 192, key, "mdy", out("n.y div 16 + 1", "13 + n.y % 16"), back)
    return f"CASE WHEN {m} = 2 AND {d} = 29 THEN {leap} WHEN {d} = 31 THEN {day31} WHEN {d} >= 29 THEN {day29} ELSE {rest} END"


def _pseudonym(key: str, back: bool = False) -> str:
    """SQL over h.v (a hit) and h.k (its kind); back: for the value of a pseudonym."""
    low = "lower(h.v)"
    local, domain = f"substring_index({low}, '@', 1)", f"regexp_replace(substring_index({low}, '@', -1), '[.][a-z]+$', '')"
    email = _cased("h.v", f"concat({permuted(local, key, 'local', back)}, '@', {permuted(domain, key, 'domain', back)}, regexp_extract({low}, '[.][a-z]+$', 0))")
    check = f"cast((10 - ({luhn_sum('y.d', 1)}) % 10) % 10 AS string)"
    body = f"substring({_bare('h.v')}, 1, length({_bare('h.v')}) - 1)"
    # Named values are bound by a transform over an array of one.
    card = _spelled("h.v", f"transform(array(named_struct('d', {permuted(body, key, 'card', back)})), y -> concat(y.d, {check}))[0]")
    rest = f"regexp_replace(h.v, '{_COUNTRY}', '')"
    phone = f"concat(regexp_extract(h.v, '{_COUNTRY}', 0), {_spelled(rest, permuted(_bare(rest), key, 'phone', back))})"
    area, group, serial = (f"cast(substring(h.v, {at}, {n}) AS int)" for at, n in ((1, 3), (5, 2), (8, 4)))
    number = lambda x, n: f"lpad(cast({x} AS string), {n}, '0')"
    ssn_out = f"concat({number('n.x div 99 + if(n.x div 99 >= 665, 2, 1)', 3)}, '-', {number('n.x % 99 + 1', 2)}, '-', {number('n.y + 1', 4)})"
    ssn = _number(f"({area} - if({area} > 666, 2, 1)) * 99 + {group} - 1", f"{serial} - 1", 898 * 99, 9999, key, "ssn", ssn_out, back)
    octet = lambda i: f"cast(split(h.v, '[.]')[{i}] AS int)"
    ip = _number(f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", 65536, 65536, key, "ip", "concat_ws('.', n.x div 256, n.x % 256, n.y div 256, n.y % 256)", back)
    days = f"datediff({_date('h.v')}, date'{FIRST}')"
    form = "CASE WHEN instr(h.v, '/') > 0 THEN 'dd/MM/yyyy' WHEN instr(h.v, '.') > 0 THEN 'dd.MM.yyyy' ELSE 'yyyy-MM-dd' END"
    date = _number(f"{days} div {RADIX[1]}", f"{days} % {RADIX[1]}", *RADIX, key, "date", f"date_format(date_add(date'{FIRST}', cast(n.x * {RADIX[1]} + n.y AS int)), {form})", back)
    parts = {"email": email, "card": card, "phone": phone, "ssn": ssn, "date": f"if({_month_first('h.v')} IS NOT NULL, {_month_first_pseudonym(key, back)}, {date})", "ip": ip}
    return f"CASE h.k {' '.join(f'WHEN {i} THEN {parts[k]}' for i, k in enumerate(KINDS))} ELSE h.v END"


def undone(value: str, kind: str, key: str) -> Column:
    """The values of which the column `value` has the pseudonyms."""
    return F.expr(f"transform(array(named_struct('v', {value}, 'k', {KINDS.index(kind)})), h -> {_pseudonym(key, back=True)})[0]")


def _kind(v: str) -> str:
    """SQL for the index of the kind of a hit, null if it fails its check; cards are found by _cards()."""
    octets = f"forall(split({v}, '[.]'), o -> cast(o AS int) < 256)"
    date = f"{_date(v)} BETWEEN date'{FIRST}' AND date_add(date'{FIRST}', {RADIX[0] * RADIX[1] - 1}) OR year({_month_first(v)}) BETWEEN 1900 AND 2099"
    mail = f"NOT {v} rlike '@[.-]|[.-][.]|[.]-' AND length({v}) <= 254"
    return f"""CASE WHEN {_is_a(v, 'email')} THEN if({mail}, 0, null) WHEN {_is_a(v, 'ip')} THEN if({octets}, 5, null) WHEN {_is_a(v, 'date')} THEN if({date}, 4, null)
      WHEN {_is_a(v, 'ssn')} THEN if({v} rlike '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)', 3, null) WHEN {_is_a(v, 'phone')} THEN 2 END"""


def _escaped(pattern: str) -> str:
    return _q(pattern.replace(chr(92), chr(92) * 2))


def _is_a(v: str, kind: str) -> str:
    return f"{v} rlike {_escaped('^(?:' + PATTERNS[kind] + ')$')}"


def _cards(v: str) -> str:
    """SQL for the cards of a run of digit groups: array<struct<order, i, j, ...>> by place, of groups i to j."""
    digits = "array_join(slice(r.g, i + 1, j - i + 1), '')"
    order = "if(j - i + 1 = size(r.g), 0, CASE length(d) WHEN 16 THEN 1 WHEN 15 THEN 2 ELSE 3 END)"
    tried = f"flatten(transform(sequence(0, size(r.g) - 1), i -> flatten(transform(sequence(i, least(i + 18, size(r.g) - 1)), j -> transform(filter(array({digits}), d -> length(d) BETWEEN 13 AND 19 AND ({luhn_sum('d', 0).replace('(s, j)', '(s, q)').replace(', j, 1)', ', q, 1)').replace('- j +', '- q +')}) % 10 = 0), d -> named_struct('o', {order}, 'i', i, 'j', j))))))"
    taken = f"aggregate(array_sort({tried}), cast(array() AS array<struct<o: int, i: int, j: int>>), (t, c) -> if(exists(t, x -> x.i <= c.j AND c.i <= x.j), t, concat(t, array(c))))"
    return f"transform(array(named_struct('g', split({v}, '[ -]'))), r -> array_sort(transform({taken}, c -> named_struct('at', length(array_join(slice(r.g, 1, c.i), ' ')) + if(c.i > 0, 1, 0), 'n', length(array_join(slice(r.g, c.i + 1, c.j - c.i + 1), ' '))))))[0]"


_PARTS = "array<struct<k: int, v: string>>"


def _searched(v: str) -> str:
    """SQL for the parts of a text without cards: (kind or null, text)."""
    return f"""flatten(transform(array(named_struct('g', split({v}, {_escaped(NO_CARD)}, -1), 'h', regexp_extract_all({v}, {_escaped(NO_CARD)}, 0))), f ->
      flatten(transform(f.g, (g, i) -> if(i < size(f.h), array(named_struct('k', cast(null AS int), 'v', g), transform(slice(f.h, i + 1, 1), w -> named_struct('k', {_kind('w')}, 'v', w))[0]), array(named_struct('k', cast(null AS int), 'v', g)))))))"""


def _parts(v: str) -> str:
    """SQL for the parts of a hit: itself, or a run's cards and what lies between them."""
    cut = f"substring({v}, a.at + 1, c.at - a.at)"
    step = f"(a, c) -> named_struct('at', c.at + c.n, 'p', concat(a.p, {_searched(cut)}, array(named_struct('k', 1, 'v', substring({v}, c.at + 1, c.n)))))"
    run = f"aggregate({_cards(v)}, named_struct('at', 0, 'p', cast(array() AS {_PARTS})), {step}, a -> concat(a.p, {_searched(f'substring({v}, a.at + 1)')}))"
    return f"if({_is_a(v, 'card')} AND NOT {_is_a(v, 'date')} AND NOT {_is_a(v, 'ssn')} AND NOT {_is_a(v, 'phone')}, {run}, array(named_struct('k', {_kind(v)}, 'v', {v})))"


#: Parts of a text whose spans are listed at a time.
RUN = 256


def pseudonymised(docs: DataFrame, key: str, found: bool = False) -> DataFrame:
    """`docs` with pseudonyms under `key` in `text`. found: also `_found`, array<struct<k, start, end>> of what was replaced (code points of the old text)."""
    hits = F.regexp_extract_all(F.col("text"), F.lit(ANY), F.lit(0))
    with_hits = rows_of(docs).withColumn("_hits", F.when(F.col("text").rlike("[0-9@]"), hits))
    gaps = with_hits.withColumn("_gaps", F.when(F.size("_hits") > 0, F.split("text", ANY, -1)))
    parts = f"flatten(transform(_gaps, (g, i) -> if(i < size(_hits), concat(array(named_struct('k', cast(null AS int), 'v', g)), flatten(transform(slice(_hits, i + 1, 1), v -> {_parts('v')}))), array(named_struct('k', cast(null AS int), 'v', g)))))"
    split = gaps.withColumn("_parts", F.when(F.col("_gaps").isNotNull(), F.expr(parts)))
    split = split.withColumn("_parts", F.expr("if(exists(_parts, h -> h.k IS NOT NULL), _parts, null)"))
    # Offsets are running sums of the parts' lengths: within runs of parts, then of the runs, as a list that grows is copied
    # for each part put to it.
    none = "cast(array() AS array<struct<k: int, start: int, end: int>>)"
    step = """(a, h) -> named_struct('at', a.at + length(h.v), 'found',
        if(h.k IS NULL, a.found, concat(a.found, array(named_struct('k', h.k, 'start', a.at, 'end', a.at + length(h.v))))))"""
    runs = f"transform(sequence(0, (size(_parts) - 1) div {RUN}), c -> aggregate(slice(_parts, c * {RUN} + 1, {RUN}), named_struct('at', 0, 'found', {none}), {step}))"
    starts = "aggregate(y, named_struct('at', 0, 's', cast(array() AS array<int>)), (a, r) -> named_struct('at', a.at + r.at, 's', concat(a.s, array(a.at))), a -> a.s)"
    moved = "transform(r.found, x -> named_struct('k', x.k, 'start', x.start + s, 'end', x.end + s))"
    # The runs are bound by a transform over an array of one.
    spans = f"flatten(flatten(transform(array({runs}), y -> zip_with(y, {starts}, (r, s) -> {moved}))))"
    out = split.withColumn("_found", F.expr(f"if(_parts IS NULL, cast(array() AS array<struct<k: int, start: int, end: int>>), {spans})"))
    out = out.withColumn("text", F.expr(f"if(_parts IS NULL, text, array_join(transform(_parts, h -> {_pseudonym(key)}), ''))"))
    if not found:
        return as_before(out, docs)
    return as_before(out.withColumn("row", F.struct("row.*", "_found")), docs.withColumn("_found", F.lit(None)))


#: For the query only, so that its reruns agree where the session names no key: no secret.
OPEN_KEY = "open"


def op3(spark, sf_dir: str) -> DataFrame:
    docs = pseudonymised(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.conf.get("pagelake.pseudonyms.key", OPEN_KEY), found=True)
    n: list[Column] = [F.size(F.filter("_found", lambda s, i=i: s["k"] == i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    names = F.array(*map(F.lit, KINDS))
    listed = F.array_join(F.transform("_found", lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return docs.select("doc_id", "text", *n, listed.alias("spans"))
