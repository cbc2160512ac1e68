"""Format-preserving pseudonyms of personal numbers and dates, all in SQL functions.

A number is found by shape, validated by its own rule, and permuted by a keyed
Feistel network over exactly the values its format allows, so the result is
valid too, equal values get equal pseudonyms in every document, different values
get different ones, and the key holder can undo it (:func:`restore`):

=========  ==========================================  =======================================
kind       validated by                                permuted domain
=========  ==========================================  =======================================
card       13-19 digits, Luhn check                    all digits but the last; check digit renewed
phone      + country code and 10 digits, or (ddd) ddd-dddd, ddd-ddd-dddd   the 10 national digits
ip         four numbers to 255                         2**16 x 2**16
ssn        area 001-899 but 666, group and serial not 0   88,902 x 9,999
date       a calendar day of 1800-2199; y-m-d, y/m/d, d.m.y, d/m/y   189 x 773 days (400 years)
secret     32-64 hex digits, of both kinds, after token/key/secret/password = or :   blocks of up to 14 hex digits
email      an address                                  none: local part and domain become keyed digests
=========  ==========================================  =======================================

Each round adds a keyed SHA-256 of one half to the other half, modulo that half's
size, so the domain needs neither padding nor walking.  What fails its validation stays as it is.
Emails are no permutation: their digests have 48 and 32 bits, so among very many hosts two may become equal, and nothing undoes them.

Defined results: a null text stays null with count 0, an empty one empty; repeated
rows give repeated results; other columns pass through; a text may hold any
characters, control characters included.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 10

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET = r"""(?<=(?i:token|key|secret|password)["']? {0,3}[=:] {0,3}["']?)[0-9a-fA-F]{32,64}(?![0-9A-Za-z])"""
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = (r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
         r"|(?<![0-9-])(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4})(?![0-9-])")
CARD = (r"(?<![0-9])(?<![0-9][.,])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}"
        r"|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9])(?![.,][0-9])")
FOUND = "|".join([EMAIL, SECRET, IP, DATE, SSN, PHONE, CARD])



def _feistel(left: str, right: str, a: str, b: str, tweak: str, key: str, back: bool) -> str:
    """SQL struct (l, r): the network over [0, a) x [0, b); all arguments are SQL expressions but ``key``."""
    half = (f"cast(conv(substr(sha2(concat('{key}|', {tweak}, '|', cast(i AS string), '|', cast(%s AS string)), 256), 1, 15), 16, 10) AS bigint)")
    move = "pmod(s.%s - " if back else "pmod(s.%s + "
    order = f"sequence({ROUNDS - 1}, 0, -1)" if back else f"sequence(0, {ROUNDS - 1})"
    return (f"aggregate({order}, named_struct('l', cast({left} AS bigint), 'r', cast({right} AS bigint)), (s, i) -> if(i % 2 = 0, "
            f"named_struct('l', {move % 'l'}{half % 's.r'}, cast({a} AS bigint)), 'r', s.r), "
            f"named_struct('l', s.l, 'r', {move % 'r'}{half % 's.l'}, cast({b} AS bigint)))))")


def _digits(d: str, tweak: str, key: str, back: bool) -> str:
    """A string of 2 to 18 digits permuted among the strings of its length."""
    h, n = f"(length({d}) DIV 2)", f"length({d})"
    net = _feistel(f"substr({d}, 1, {h})", f"substr({d}, {h} + 1)", f"power(10, {h})", f"power(10, {n} - {h})", tweak, key, back)
    return f"transform(array({net}), q -> concat(lpad(cast(q.l AS string), {h}, '0'), lpad(cast(q.r AS string), {n} - {h}, '0')))[0]"


def _let(name: str, value: str, body: str) -> str:
    """``value`` evaluated once under a name inside an expression."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _refill(piece: str, digits: str) -> str:
    """``piece`` with its digits replaced in order."""
    upto = f"length(regexp_replace(substr({piece}, 1, j), '[^0-9]', ''))"
    return (f"array_join(transform(sequence(1, length({piece})), j -> if(substr({piece}, j, 1) RLIKE '[0-9]', "
            f"substr({digits}, {upto}, 1), substr({piece}, j, 1))), '')")


def _luhn(d: str, doubled: int) -> str:
    """Luhn sum of a digit string; positions from the right of the parity ``doubled`` count twice."""
    x = f"cast(substr({d}, -j, 1) AS int)"
    return f"aggregate(sequence(1, length({d})), 0, (t, j) -> t + if(j % 2 = {doubled}, if({x} > 4, {x} * 2 - 9, {x} * 2), {x}))"


def _piece(key: str, back: bool) -> str:
    """SQL expression: the pseudonym of the found piece ``x``, or ``x`` itself if it isn't valid."""
    only = "regexp_replace(x, '[^0-9]', '')"
    card = _let("d", only, f"if({_luhn('d', 0)} % 10 <> 0, x, " + _let(
        "p", _digits("substr(d, 1, length(d) - 1)", "concat('card', cast(length(d) AS string))", key, back),
        _refill("x", f"concat(p, cast((10 - {_luhn('p', 1)} % 10) % 10 AS string))")) + ")")
    phone = _let("d", only, _let("p", _digits("substr(d, -10)", "'phone'", key, back),
                                 _refill("x", "concat(substr(d, 1, length(d) - 10), p)")))
    ip = _let("o", r"transform(split(x, '\\.'), v -> cast(v AS int))", "if(array_max(o) > 255, x, " + _let(
        "q", _feistel("o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536", "'ip'", key, back),
        "concat_ws('.', cast(q.l DIV 256 AS string), cast(q.l % 256 AS string), cast(q.r DIV 256 AS string), cast(q.r % 256 AS string))") + ")")
    area, group, serial = "cast(substr(x, 1, 3) AS int)", "cast(substr(x, 5, 2) AS int)", "cast(substr(x, 8, 4) AS int)"
    ssn = (f"if({area} IN (0, 666) OR {area} > 899 OR {group} = 0 OR {serial} = 0, x, " + _let(
        "q", _feistel(f"({area} - if({area} > 666, 2, 1)) * 99 + {group} - 1", f"{serial} - 1", "88902", "9999", "'ssn'", key, back),
        "concat_ws('-', lpad(cast(q.l DIV 99 + if(q.l DIV 99 >= 665, 2, 1) AS string), 3, '0'), lpad(cast(q.l % 99 + 1 AS string), 2, '0'), "
        "lpad(cast(q.r + 1 AS string), 4, '0'))") + ")")
    iso = ("CASE WHEN x RLIKE '^[0-9]{4}' THEN replace(x, '/', '-') ELSE concat_ws('-', substr(x, 7, 4), substr(x, 4, 2), substr(x, 1, 2)) END")
    shape = ("CASE WHEN x LIKE '____-__-__' THEN 'yyyy-MM-dd' WHEN x LIKE '____/%' THEN 'yyyy/MM/dd' "
             "WHEN x LIKE '%.%' THEN 'dd.MM.yyyy' ELSE 'dd/MM/yyyy' END")
    date = _let("c", f"try_cast({iso} AS date)", "if(c IS NULL OR c < DATE'1800-01-01' OR c > DATE'2199-12-31', x, " + _let(
        "n", "datediff(c, DATE'1800-01-01')", _let("q", _feistel("n DIV 773", "n % 773", "189", "773", "'date'", key, back),
                                                  f"date_format(date_add(DATE'1800-01-01', cast(q.l * 773 + q.r AS int)), {shape})")) + ")")
    m = "((length(x) + 13) DIV 14)"     # blocks of nearly equal length
    block = _let("h", f"substr(x, k * length(x) DIV {m} + 1, (k + 1) * length(x) DIV {m} - k * length(x) DIV {m})", _let("q", _feistel(
        "cast(conv(substr(h, 1, length(h) DIV 2), 16, 10) AS bigint)", "cast(conv(substr(h, length(h) DIV 2 + 1), 16, 10) AS bigint)",
        "power(16, length(h) DIV 2)", "power(16, length(h) - length(h) DIV 2)",
        "concat('secret', cast(k AS string), '/', cast(length(x) AS string))", key, back),
        "concat(lpad(hex(q.l), length(h) DIV 2, '0'), lpad(hex(q.r), length(h) - length(h) DIV 2, '0'))"))
    secret = (f"if(NOT (x RLIKE '[0-9]' AND x RLIKE '[a-fA-F]'), x, " + _let(
        "y", f"array_join(transform(sequence(0, {m} - 1), k -> {block}), '')", "if(x = upper(x), y, lower(y))") + ")")
    mail = "x" if back else (
        f"concat('u', substr(sha2(concat('{key}|mail|', lower(x)), 256), 1, 12), '@', "
        f"substr(sha2(concat('{key}|host|', lower(substring_index(x, '@', -1))), 256), 1, 8), '.example')")
    return (f"CASE WHEN contains(x, '@') THEN {mail} WHEN x RLIKE '^[0-9a-fA-F]{{32,64}}$' THEN {secret} "
            f"WHEN x RLIKE '^[0-9]{{1,3}}(\\\\.[0-9]{{1,3}}){{3}}$' THEN {ip} "
            f"WHEN x RLIKE '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}|[0-9]{{2}}[./][0-9]{{2}}[./][0-9]{{4}})$' THEN {date} "
            f"WHEN x RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN {ssn} "
            f"WHEN x RLIKE '^([+(]|[0-9]{{3}}-[0-9]{{3}}-)' THEN {phone} ELSE {card} END")


def _rewrite(df: DataFrame, key: str, text: str, count: str, back: bool) -> DataFrame:
    secret = hashlib.sha256(key.encode()).hexdigest()
    kept = [c for c in df.columns if c.lower() != count.lower()]
    t = F.col(f"`{text}`").cast("string")
    # the mark around found pieces; a text that holds it already gets a longer one
    mark = F.when(F.contains(t, F.lit("\x01")), F.concat(F.lit("\x01"), F.sha2(t, 256), F.lit("\x01"))).otherwise(F.lit("\x01"))
    marked = F.regexp_replace(t, F.lit(FOUND), F.concat(mark, F.lit("$0"), mark))
    pieces = F.when(t.rlike("[0-9@]"), F.split(marked, mark)).otherwise(F.array(t))
    was = df.select(*[F.col(f"`{c}`") for c in kept], F.when(t.isNotNull(), pieces).alias("__was"))
    now = was.withColumn("__now", F.expr(f"transform(__was, (x, m) -> if(m % 2 = 1, {_piece(secret, back)}, x))"))
    out = [F.array_join("__now", "").alias(c) if c == text else F.col(f"`{c}`") for c in kept]
    changed = F.expr("size(filter(zip_with(__was, __now, (a, b) -> a <> b), v -> v))")
    return now.select(*out, F.when(F.col("__was").isNull(), 0).otherwise(changed).cast("long").alias(count))


def pseudonymise(df: DataFrame, key: str, text: str = "text", count: str = "n_pseudonyms") -> DataFrame:
    """``df`` with pseudonyms in ``text`` and their number in ``count``."""
    return _rewrite(df, key, text, count, False)


def restore(df: DataFrame, key: str, text: str = "text", count: str = "n_restored") -> DataFrame:
    """The inverse for everything but email addresses."""
    return _rewrite(df, key, text, count, True)
