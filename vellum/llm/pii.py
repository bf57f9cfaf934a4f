"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Numbers and dates that pass their own check (a card's Luhn digit, an address' octets, a real
date, a phone number after +1 or a possible one without, a possible security number) are replaced by a keyed permutation of all such
values of the same format; e-mail names and access keys, of their letters and digits.  The permutation is a
Feistel network whose two halves live in Z_a and Z_b, with a times b the exact number of
values of the format, so every pseudonym is valid again, equal values get equal pseudonyms
in all documents, and who has the key can invert it.  Month-first dates walk the permutation of all dates until one
has a day over 12, so they are permuted among themselves.  The key's digest enters as the value of a subquery: plans and event logs do not show it.

A text is split at its candidates and put together again; texts without a digit or ``@`` pass
through.  There is no shuffle.

Defined cases: a null text stays null with nothing found; candidates that fail their check stay as they are;
dates outside 1900 to 2099 stay; a date that can be read day first is, and stays so; one that only can be read month first becomes another such;
overlapping candidates go to the leftmost, then in the order of ``KINDS``; repeated rows get
equal results; a null doc_id is returned as it is; other columns stay; empty tables give none.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Candidates of each kind, in order of precedence.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "iso": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "dmy": r"(?<![0-9])[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
#: Days from 1900-01-01 to 2099-12-31 are 17 times 4297.
FIRST_DAY, DAYS = "date'1900-01-01'", (17, 4297)
#: Steps at most until a permuted month-first date has a day over 12; each ends the walk with more than even odds.
WALK = 100
#: Characters that one network takes; a longer name is permuted piece by piece.
PIECE = 22


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """Binds a value to a name, so it is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _fold(items: str, start: str, step: str) -> str:
    return f"aggregate({items}, {start}, {step})"


class _Network:
    """SQL of the keyed permutations, forwards or back, over a column ``_key``."""

    def __init__(self, back: bool):
        self.back = back

    def pair(self, x: str, a: str, y: str, b: str, tweak: str) -> str:
        """Permutes (x, y) of Z_a times Z_b: a struct of both."""
        rounds = f"sequence({ROUNDS - 1}, 0, -1)" if self.back else f"sequence(0, {ROUNDS - 1})"

        def told(of: str, m: str) -> str:
            return f"(cast(conv(substring(sha2(concat(_key, '|', {tweak}, '|', r, '|', {of}), 256), 1, 15), 16, 10) as bigint) % {m})"

        def moved(of: str, by: str, m: str) -> str:
            return f"(({of} + {m} - {by}) % {m})" if self.back else f"(({of} + {by}) % {m})"

        step = (
            "(q, r) -> if(r % 2 = 0, "
            f"named_struct('x', {moved('q.x', told('q.y', a), a)}, 'y', q.y), "
            f"named_struct('x', q.x, 'y', {moved('q.y', told('q.x', b), b)}))"
        )
        return _fold(rounds, f"named_struct('x', cast({x} as bigint), 'y', cast({y} as bigint))", step)

    def text(self, s: str, t: str) -> str:
        """Permutes the string s of at most PIECE characters of the classes t: # digit, n digit from 2, z digit below 2, l and u letters."""
        radix = "case substring(t, i, 1) when '#' then 10L when 'n' then 8L when 'z' then 2L else 26L end"
        base = "case substring(t, i, 1) when '#' then 48 when 'z' then 48 when 'n' then 50 when 'l' then 97 else 65 end"

        def number(lo: str, hi: str) -> str:
            return f"if({lo} > {hi}, 0L, aggregate(sequence({lo}, greatest({lo}, {hi})), 0L, (v, i) -> v * ({radix}) + ascii(substring(s, i, 1)) - ({base})))"

        def size(lo: str, hi: str) -> str:
            return f"if({lo} > {hi}, 1L, aggregate(sequence({lo}, greatest({lo}, {hi})), 1L, (v, i) -> v * ({radix})))"

        def string(v: str, lo: str, hi: str) -> str:
            step = f"(w, i) -> named_struct('v', w.v div ({radix}), 'o', concat(chr(cast(({base}) + w.v % ({radix}) as int)), w.o))"
            return f"if({lo} > {hi}, '', aggregate(sequence(greatest({lo}, {hi}), {lo}, -1), named_struct('v', {v}, 'o', ''), {step}).o)"

        net = self.pair("xa", "ma", "xb", "mb", "t")
        body = _let("z", net, f"concat({string('z.x', '1', 'h')}, {string('z.y', 'h + 1', 'n')})")
        for name, value in (("mb", size("h + 1", "n")), ("ma", size("1", "h")), ("xb", number("h + 1", "n")), ("xa", number("1", "h")), ("h", "cast(n div 2 as int)"), ("n", "length(s)"), ("t", t), ("s", s)):
            body = _let(name, value, body)
        return body

    def pieces(self, s: str, t: str) -> str:
        one = self.text(f"substring(s0, k * {PIECE} + 1, {PIECE})", f"substring(t0, k * {PIECE} + 1, {PIECE})")
        return _let("s0", s, _let("t0", t, f"array_join(transform(sequence(0, cast((greatest(length(s0), 1) - 1) div {PIECE} as int)), k -> {one}), '')"))


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_CLASSES = "regexp_replace(regexp_replace(regexp_replace({0}, '[0-9]', '#'), '[a-z]', 'l'), '[A-Z]', 'u')"


def _luhn_sum(d: str, doubled: int) -> str:
    """Luhn sum of a digit string; places with this parity from the right (1 the last) are doubled."""
    digit = f"cast(substring({d}, length({d}) - i + 1, 1) as int)"
    return f"aggregate(sequence(1, length({d})), 0, (v, i) -> v + if(i % 2 = {doubled}, if({digit} > 4, {digit} * 2 - 9, {digit} * 2), {digit}))"


def _refill(template: str, chars: str, spot: str) -> str:
    """``template`` with its characters of class ``spot`` replaced by those of ``chars`` in order."""
    step = f"(w, c) -> if(c rlike '{spot}', named_struct('i', w.i + 1, 'o', concat(w.o, substring(f, w.i, 1))), named_struct('i', w.i, 'o', concat(w.o, c)))"
    return _let("f", chars, f"aggregate(split({template}, ''), named_struct('i', 1, 'o', ''), {step}).o")


def _permuted_day(net: _Network, day: str, tweak: str) -> str:
    a, b = DAYS
    return _let("z", net.pair(f"({day}) div {b}", f"{a}L", f"({day}) % {b}", f"{b}L", tweak), f"z.x * {b} + z.y")


def _date(net: _Network, parsed: str, pattern: str, otherwise: str = "m") -> str:
    day = f"datediff(d, {FIRST_DAY})"
    moved = f"date_format(date_add({FIRST_DAY}, cast({_permuted_day(net, day, _lit('date'))} as int)), {pattern})"
    return _let("d", parsed, f"if(d is null, {otherwise}, if({day} < 0 or {day} >= {DAYS[0] * DAYS[1]}, m, {moved}))")


def _month_first(net: _Network, parsed: str, pattern: str) -> str:
    """A date that can only be read month first, as another one."""
    day = f"datediff(d, {FIRST_DAY})"
    date = f"date_add({FIRST_DAY}, cast(u as int))"
    step = f"(w, k) -> if(w.done, w, {_let('u', _permuted_day(net, 'w.v', _lit('month first')), f'struct(u as v, day({date}) > 12 as done)')})"
    walked = f"aggregate(sequence(1, {WALK}), struct(cast({day} as bigint) as v, false as done), {step}).v"
    moved = _let("u", walked, f"date_format({date}, {pattern})")
    return _let("d", parsed, f"if(d is null or {day} < 0 or {day} >= {DAYS[0] * DAYS[1]}, m, {moved})")


def _replacement(net: _Network) -> str:
    """SQL of the pseudonym of the candidate ``m``."""
    local = "substring_index(m, '@', 1)"
    email = _let("a", f"regexp_replace({local}, '[^0-9A-Za-z]', '')", f"concat({_refill(local, net.pieces('a', _CLASSES.format('a')), '[0-9A-Za-z]')}, substring(m, length({local}) + 1))")
    key = f"concat('AKIA', {_let('a', 'substring(m, 5)', net.text('a', _CLASSES.format('a')))})"
    o = [f"cast(split(m, '[.]')[{i}] as bigint)" for i in range(4)]
    ip = f"if(exists(split(m, '[.]'), x -> cast(x as int) > 255), m, {_let('z', net.pair(f'{o[0]} * 256 + {o[1]}', '65536L', f'{o[2]} * 256 + {o[3]}', '65536L', _lit('ip')), _octets())})"
    iso = _date(net, "cast(try_to_timestamp(m, 'yyyy-MM-dd') as date)", "'yyyy-MM-dd'")
    slashed = "replace(m, '.', '/')"
    read = {p: f"cast(try_to_timestamp({slashed}, {_lit(p)}) as date)" for p in ("dd/MM/yyyy", "MM/dd/yyyy")}
    other = _month_first(net, read["MM/dd/yyyy"], _lit("MM/dd/yyyy"))
    dmy = _refill("m", f"regexp_replace({_date(net, read['dd/MM/yyyy'], _lit('dd/MM/yyyy'), other)}, '[^0-9]', '')", "[0-9]")
    area, group, serial = "cast(substring(m, 1, 3) as bigint)", "cast(substring(m, 5, 2) as bigint)", "cast(substring(m, 8, 4) as bigint)"
    rank = f"if({area} > 666, {area} - 2, {area} - 1)"
    back = "z.x div 99 + if(z.x div 99 >= 665, 2, 1)"
    ssn = f"if({area} in (0, 666) or {area} >= 900 or {group} = 0 or {serial} = 0, m, {_let('z', net.pair(f'({rank}) * 99 + {group} - 1', f'{898 * 99}L', f'{serial} - 1', '9999L', _lit('ssn')), f'concat(lpad(cast({back} as string), 3, {_lit("0")}), {_lit("-")}, lpad(cast(z.x % 99 + 1 as string), 2, {_lit("0")}), {_lit("-")}, lpad(cast(z.y + 1 as string), 4, {_lit("0")}))')})"
    start = "if(m like '+1%', 3, 1)"
    # All ten-digit numbers fall into three sets that are each permuted, so a possible number has one pseudonym with and without +1.
    ranks = "case when substring(a, 1, 1) < '2' then 'z#########' when substring(a, 4, 1) < '2' then 'n##z######' else 'n##n######' end"
    digits = _let("a", "regexp_replace(b, '[^0-9]', '')", net.text("a", ranks))
    phone = f"concat(substring(m, 1, {start} - 1), {_let('b', f'substring(m, {start})', _refill('b', digits, '[0-9]'))})"
    payload = net.text("substring(a, 1, length(a) - 1)", "repeat('#', length(a) - 1)")
    checked = _let("p", payload, f"concat(p, cast((10 - {_luhn_sum('p', 1)} % 10) % 10 as string))")
    card = _let("a", _DIGITS, f"if({_luhn_sum('a', 0)} % 10 <> 0, m, {_refill('m', checked, '[0-9]')})")
    by_kind = {"email": email, "key": key, "ip": ip, "iso": iso, "dmy": dmy, "ssn": ssn, "phone": phone, "card": card}
    cases = " ".join(f"when m rlike {_quoted('^(?:' + KINDS[k] + ')$')} then {by_kind[k]}" for k in KINDS)
    return f"case {cases} else m end"


def _lit(text: str) -> str:
    return f"'{text}'"


def _octets() -> str:
    return "concat_ws('.', z.x div 256, z.x % 256, z.y div 256, z.y % 256)"


def pseudonymised(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """``docs`` with the texts' personal data replaced, and ``n_found``, how many were.

    ``back`` inverts with the same key.
    """
    pattern = "|".join(KINDS.values())
    digest = docs.sparkSession.createDataFrame([(hashlib.sha256(key.encode()).hexdigest(),)], "_key string").scalar()
    rows = docs.drop("n_found")
    rest = [c for c in rows.columns if c != "text"]
    rows = rows.withColumn("_has", F.expr("coalesce(text rlike '[0-9@]|AKIA', false)"))
    rows = rows.select(*rest, "text", digest.alias("_key"), F.expr(f"if(_has, regexp_extract_all(text, {_quoted(pattern)}, 0), cast(array() as array<string>))").alias("_m"))
    rows = rows.select(*rest, "text", "_m", F.expr(f"transform(_m, m -> {_replacement(_Network(back))})").alias("_p"))
    gaps = f"split(text, {_quoted(pattern)}, -1)"
    joined = f"if(size(_m) = 0, text, array_join(zip_with({gaps}, _p, (g, p) -> concat(g, coalesce(p, ''))), ''))"
    done = rows.select(*rest, F.expr(joined).alias("text"), F.expr("cast(size(filter(zip_with(_m, _p, (a, b) -> a <> b), x -> x)) as bigint)").alias("n_found"))
    return done.select(*[c for c in docs.columns if c != "n_found"], "n_found")
