"""Format-preserving pseudonyms for personal numbers, dates, addresses and secrets; DataFrame operations only.

Candidates are found by one pattern and then validated: payment cards by the Luhn digit, IBANs by
their remainder modulo 97, IPv4 addresses and social security numbers by their ranges, dates by
the calendar. What passes is permuted within its own format by a keyed Feistel network: equal
values get equal pseudonyms in all documents, different values of a format different ones, a
card keeps a valid Luhn digit, a date stays a date, and blanks, dashes and brackets stay put. What does
not pass is left as it is. Mail addresses keep their domain and long hexadecimal secrets their length; both
get a keyed digest in place of the rest.

A Feistel round adds a keyed digest of one half to the other, modulo the size of that half, so
any domain of two factors is permuted: digits in two runs, days in 319 * 229, IPv4 in 2^16 * 2^16.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: Days from 1900-01-01 that a date is permuted in: 319 * 229, which ends in the year 2099.
DAYS = (319, 229)

KINDS = ("email", "secret", "ip", "date", "ssn", "iban", "card", "phone")

#: What may be personal. No candidate begins or ends inside a longer run of letters or digits.
CANDIDATES = "|".join((
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    r"(?<![A-Za-z0-9])(?:"
    + "|".join((
        r"[0-9a-f]{32,128}+(?![A-Za-z0-9])",
        r"[0-9A-F]{32,128}+(?![A-Za-z0-9])",
        r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
        r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])",
        r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![A-Za-z0-9]|-[0-9])",
        r"[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}(?![A-Za-z0-9])",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9])",
        r"[0-9]{13,19}(?![A-Za-z0-9])",
        r"[0-9]{4}(?:[ -][0-9]{4}){3}(?![A-Za-z0-9])",
        r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![A-Za-z0-9])",
        r"[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![A-Za-z0-9])",
    ))
    + ")",
    r"(?<![A-Za-z0-9])(?:\+[0-9]{1,3}[ -]?)?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![A-Za-z0-9])",
    r"\+[0-9]{1,3}(?:[ -][0-9]{2,5}){2,5}(?![A-Za-z0-9])",
))


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _digest(key: str, kind: str, *parts: str) -> str:
    """SQL for a keyed digest; ``key`` is the key itself, or the name of a column, in backticks, that has it."""
    held = key if key.startswith("`") else f"'{key}'"
    return f"sha2(concat_ws('|', {held}, '{kind}', {', '.join(parts)}), 256)"


def _feistel(key: str, kind: str, x: str, y: str, mx: str, my: str, done: str) -> str:
    """SQL that permutes (x, y) in [0, mx) * [0, my) and gives ``done`` of the result ``s``."""
    draw = lambda half, size: f"(cast(conv(substr({_digest(key, kind, 'cast(i as string)', f'cast({half} as string)')}, 1, 12), 16, 10) as bigint) % {size})"
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('x', cast({x} as bigint), 'y', cast({y} as bigint)), "
        f"(s, i) -> if(i % 2 = 0, named_struct('x', (s.x + {draw('s.y', mx)}) % {mx}, 'y', s.y), named_struct('x', s.x, 'y', (s.y + {draw('s.x', my)}) % {my})), s -> {done})"
    )


def _permuted(key: str, kind: str, d: str) -> str:
    """SQL that permutes a digit string of 2 to 18 digits among those of its length."""
    left, right = f"(length({d}) div 2)", f"(length({d}) - length({d}) div 2)"
    power = lambda n: f"cast(pow(10, {n}) as bigint)"
    return _feistel(key, f"{kind}", f"substr({d}, 1, {left})", f"substr({d}, {left} + 1)", power(left), power(right), f"concat(lpad(cast(s.x as string), {left}, '0'), lpad(cast(s.y as string), {right}, '0'))")


def _moved_digit(key: str, kind: str, d: str) -> str:
    """SQL that permutes a single digit by a keyed step; an empty string stays."""
    return f"if({d} = '', '', cast((cast({d} as int) + cast(conv(substr({_digest(key, kind, chr(39) + 'one' + chr(39))}, 1, 12), 16, 10) as bigint)) % 10 as string))"


def _placed(m: str, new: str) -> str:
    """SQL that puts the digits ``new`` where ``m`` has digits."""
    return f"array_join(transform(array({new}), n -> array_join(transform(sequence(1, length({m})), k -> if(substr({m}, k, 1) between '0' and '9', substr(n, length({_digits(f'substr({m}, 1, k)')}), 1), substr({m}, k, 1))), '')), '')"


def _luhn(d: str, doubled: int) -> str:
    """SQL for the Luhn sum of a digit string, counting from its end; every second digit from place ``doubled`` on is doubled."""
    v = f"cast(substr({d}, length({d}) - p + 1, 1) as int)"
    return f"aggregate(sequence(1, length({d})), 0, (a, p) -> a + if(p % 2 = {doubled % 2}, 2 * {v} - if({v} > 4, 9, 0), {v}))"


def _mod97(s: str) -> str:
    """SQL for the remainder modulo 97 of a string of digits and letters, a letter counting as 10 to 35."""
    c = f"substr({s}, p, 1)"
    return f"aggregate(sequence(1, length({s})), cast(0 as bigint), (a, p) -> if({c} between '0' and '9', (a * 10 + cast({c} as int)) % 97, (a * 100 + ascii({c}) - 55) % 97))"


def _iso_date(m: str) -> str:
    """SQL for the date of an ISO, day-first or (with slashes, if only that is one) month-first string; null if it is none."""
    day_first = f"try_cast(concat(substr({m}, 7, 4), '-', substr({m}, 4, 2), '-', substr({m}, 1, 2)) as date)"
    month_first = f"try_cast(concat(substr({m}, 7, 4), '-', substr({m}, 1, 2), '-', substr({m}, 4, 2)) as date)"
    return f"case when {m} rlike '^[0-9]{{4}}-' then try_cast({m} as date) when {m} rlike '^[0-9]{{2}}[.][0-9]{{2}}[.]' then {day_first} when {m} rlike '^[0-9]{{2}}/[0-9]{{2}}/' then coalesce({day_first}, {month_first}) end"


def kind_sql(m: str = "m") -> str:
    """SQL for the kind of a candidate after validation, or null."""
    d = _digits(m)
    area, group, serial = (f"cast(substr({m}, {a}, {n}) as int)" for a, n in ((1, 3), (5, 2), (8, 4)))
    bare = f"replace({m}, ' ', '')"
    return (
        f"case when contains({m}, '@') then 'email' "
        f"when {m} rlike '^[0-9a-fA-F]{{32,}}$' then if({m} rlike '[a-fA-F]' and {m} rlike '[0-9]', 'secret', null) "
        f"when {m} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then if(forall(split({m}, '[.]'), o -> cast(o as int) < 256), 'ip', null) "
        f"when {m} rlike '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}([/.])[0-9]{{2}}[/.][0-9]{{4}})$' then if({_iso_date(m)} >= date'1900-01-01' and {_iso_date(m)} < date_add(date'1900-01-01', {DAYS[0] * DAYS[1]}), 'date', null) "
        f"when {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then if({area} not in (0, 666) and {area} < 900 and {group} > 0 and {serial} > 0, 'ssn', null) "
        f"when {m} rlike '^[A-Z]{{2}}' then if(length({bare}) between 15 and 34 and {_mod97(f'concat(substr({bare}, 5), substr({bare}, 1, 4))')} = 1, 'iban', null) "
        f"when startswith({m}, '+') or {m} rlike '^[(]|^[0-9]{{3}}[-.][0-9]{{3}}[-.][0-9]{{4}}$' then if(length({d}) between 7 and 15, 'phone', null) "
        f"when length({d}) between 13 and 19 and {_luhn(d, 2)} % 10 = 0 then 'card' end"
    )


def pseudonym_sql(key: str, m: str = "m", kind: str = "kind") -> str:
    """SQL for the pseudonym of a validated candidate of a kind; ``key`` as in ``_digest``."""
    d = _digits(m)
    octet = lambda n: f"cast(split({m}, '[.]')[{n}] as bigint)"
    days = f"datediff({_iso_date(m)}, date'1900-01-01')"
    new_day = f"date_add(date'1900-01-01', cast(s.x * {DAYS[1]} + s.y as int))"
    month_first = f"{m} rlike '/' and try_cast(concat(substr({m}, 7, 4), '-', substr({m}, 4, 2), '-', substr({m}, 1, 2)) as date) is null"
    dated = f"case when {m} rlike '^[0-9]{{4}}-' then date_format({new_day}, 'yyyy-MM-dd') when {m} rlike '[.]' then date_format({new_day}, 'dd.MM.yyyy') when {month_first} then date_format({new_day}, 'MM/dd/yyyy') else date_format({new_day}, 'dd/MM/yyyy') end"
    area = f"(cast(substr({m}, 1, 3) as int) - if(cast(substr({m}, 1, 3) as int) > 666, 2, 1))"
    ssn_x = f"({area} * 99 + cast(substr({m}, 5, 2) as int) - 1)"
    ssn_area = "(s.x div 99 + if(s.x div 99 >= 665, 2, 1))"
    ssn = f"concat(lpad(cast({ssn_area} as string), 3, '0'), '-', lpad(cast(s.x % 99 + 1 as string), 2, '0'), '-', lpad(cast(s.y + 1 as string), 4, '0'))"
    card_body = _permuted(key, "card", f"substr({d}, 1, length({d}) - 1)")
    card = f"array_join(transform(array({card_body}), b -> concat(b, cast((10 - {_luhn('b', 1)} % 10) % 10 as string))), '')"
    # an IBAN keeps country and letters; its account digits, in even runs of at most 16, are permuted and the check digits made anew
    bare = f"replace({m}, ' ', '')"
    account = _digits(f"substr({bare}, 5)")
    run = _permuted(key, "iban", "r")
    parts = f"((length({account}) + 15) div 16)"
    size = f"((length({account}) + {parts} - 1) div {parts})"
    runs = f"array_join(transform(sequence(0, {parts} - 1), q -> array_join(transform(array(substr({account}, q * {size} + 1, {size})), r -> if(length(r) > 1, {run}, {_moved_digit(key, 'iban', 'r')})), '')), '')"
    body = f"array_join(transform(array({runs}), n -> array_join(transform(sequence(1, length({bare}) - 4), k -> if(substr({bare}, k + 4, 1) between '0' and '9', substr(n, length({_digits(f'substr({bare}, 5, k)')}), 1), substr({bare}, k + 4, 1))), '')), '')"
    checked = f"array_join(transform(array({body}), b -> concat(lpad(cast(98 - {_mod97(f'concat(b, substr({bare}, 1, 2), {chr(39)}00{chr(39)})')} as string), 2, '0'), b)), '')"
    spaced = f"array_join(transform(array(concat(substr({bare}, 1, 2), {checked})), z -> if(contains({m}, ' '), trim(regexp_replace(z, '(.{{4}})', '$1 ')), z)), '')"
    national = f"right({d}, least(10, length({d})))"
    return (
        f"case {kind} "
        f"when 'email' then concat('u', substr({_digest(key, 'email', f'lower({m})')}, 1, 12), '@', substring_index({m}, '@', -1)) "
        f"when 'secret' then if({m} rlike '[A-F]', upper(substr(repeat({_digest(key, 'secret', m)}, 2), 1, length({m}))), substr(repeat({_digest(key, 'secret', m)}, 2), 1, length({m}))) "
        f"when 'ip' then {_feistel(key, 'ip', f'{octet(0)} * 256 + {octet(1)}', f'{octet(2)} * 256 + {octet(3)}', '65536', '65536', 'concat_ws({0}, cast(s.x div 256 as string), cast(s.x % 256 as string), cast(s.y div 256 as string), cast(s.y % 256 as string))'.format(chr(39) + '.' + chr(39)))} "
        f"when 'date' then {_feistel(key, 'date', f'{days} div {DAYS[1]}', f'{days} % {DAYS[1]}', str(DAYS[0]), str(DAYS[1]), dated)} "
        f"when 'ssn' then {_feistel(key, 'ssn', ssn_x, f'cast(substr({m}, 8, 4) as int) - 1', str(898 * 99), '9999', ssn)} "
        f"when 'iban' then {spaced} "
        f"when 'card' then {_placed(m, card)} "
        f"when 'phone' then {_placed(m, f'concat(left({d}, length({d}) - length({national})), {_permuted(key, 'phone', national)})')} "
        f"else {m} end"
    )


def pseudonymize(docs: DataFrame, key: DataFrame | str, text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by pseudonyms; all other columns and all rows are kept.

    ``key`` makes the permutations; whoever has it can undo those of numbers and dates. A secret key comes as a
    table whose only column has it in its one row, such as a text file that only the job may read: then no plan, log or
    user interface shows it. A key given as a string (letters and digits) stands in the plan and is for open data. With ``found_col``, a column of that name is added: array of (kind, value, pseudonym)
    in the order of the text. Null texts stay null with null findings; empty texts stay empty;
    rows that repeat change alike; an empty table gives no rows.
    Texts without digits and @ can hold nothing of the kind and skip the pattern.
    """
    if isinstance(key, str):
        if not key.isalnum():
            raise ValueError("the key must be letters and digits")
        columns, held = docs.columns, key
    else:
        columns, (name,) = docs.columns, key.columns
        hidden = next(n for n in ("__key", *(f"__key{k}" for k in range(len(columns) + 1))) if n not in columns)
        given = F.max(F.col(f"`{name}`").cast("string"))
        one = key.agg(F.when((F.count("*") == 1) & given.isNotNull(), given).otherwise(F.raise_error(F.lit("the key must be one row"))).alias(hidden))
        docs, held = docs.join(F.broadcast(one)), f"`{hidden}`"  # one row
    t = F.col(f"`{text_col}`")
    pattern = CANDIDATES.replace("'", "''")
    candidates = f"if(`{text_col}` rlike '[0-9@]', regexp_extract_all(`{text_col}`, r'{pattern}', 0), cast(array() as array<string>))"
    kinds = f"transform({candidates}, m -> named_struct('m', m, 'kind', {kind_sql('m')}))"
    names = set(docs.columns)
    found = next(n for n in ("__found", *(f"__found{k}" for k in range(len(names) + 1))) if n not in names)
    out = docs.withColumn(found, F.expr(kinds))
    out = out.withColumn(found, F.expr(f"transform({found}, c -> named_struct('kind', c.kind, 'value', c.m, 'pseudonym', {pseudonym_sql(held, 'c.m', 'c.kind')}))"))
    rest = f"split(`{text_col}`, r'{pattern}', -1)"
    # the text between candidates, and each candidate or its pseudonym
    woven = f"concat(array_join(zip_with(slice({rest}, 1, size({found})), {found}, (a, c) -> concat(a, c.pseudonym)), ''), element_at({rest}, -1))"
    out = out.withColumn(text_col, F.when(F.expr(f"exists({found}, c -> c.kind is not null)"), F.expr(woven)).otherwise(t))
    if found_col is None:
        return out.select(*[f"`{c}`" for c in columns])
    return out.withColumn(found_col, F.expr(f"filter({found}, c -> c.kind is not null)")).select(*[f"`{c}`" for c in columns], f"`{found_col}`")
