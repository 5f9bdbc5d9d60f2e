r"""Personal data and secrets replaced by surrogates, with Spark SQL functions only.

Detected: e-mail addresses, telephone numbers, payment card numbers (of an issuer's range, with a valid check digit), bank
account numbers (IBAN, with valid check digits), IPv4 addresses, US social security numbers, cloud access keys, values assigned to names such as password or token, and persons after an honorific.
A value is of any length and ends before white space or one of "'<>,;=; a quoted one at its quote, on one line. A person is all
capitalised words after the honorific, with initials, titles, particles (van, de), inner capitals, hyphens and apostrophes.

Surrogates depend on a key and the entity's normalised value alone, so equal entities get equal surrogates in all texts:
- numbers go through a keyed permutation of the digit strings of their length (a Feistel network on decimal halves), which
  keeps distinct numbers distinct. Punctuation, country prefix and card brand digit stay; check digits are made anew;
  addresses are permuted as 32 bits.
- addresses of mail, keys, secrets, bank accounts and names are rewritten character by character in their own class (lower,
  upper, digit, hexadecimal, Greek, Cyrillic; in names also vowel or consonant, so that they can be spoken) from a keyed
  digest; names keep their honorific and end as the honorific's gender has it; mail domains end in .example; bank accounts
  keep their country and get new check digits.
Collisions: a check over all entities of all texts finds values whose surrogates coincide; all but the smallest of them get
the next attempt, until none coincide. These overrides reach their texts by joins. Usually there are none, and no text moves.

Null text stays null, with 0 entities; texts without entities stay as they are, byte for byte. Repeated rows are treated
alike. Columns of docs other than the text (and n_chars, which is made anew where it exists) pass unchanged; columns named
n_entities or entity_kinds give way to the results. An empty table gives no rows.

The key is a secret: who has it can tell which numbers stand behind the surrogates. It has no default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

# Detection patterns in the order in which they are tried at a place.
LEAD = r"""(?i:password|passwd|pwd|token|secret|api_?key|access_?key|auth)["']?[ \t]*+[=:][ \t]*+"""
SECRET = rf"""\b{LEAD}(?:"(?=[^"\r\n]*")[^"\r\n]*[\p{{L}}0-9]|'(?=[^'\r\n]*')[^'\r\n]*[\p{{L}}0-9]|["']?(?!{LEAD})[^\s"'<>,;=]*[\p{{L}}0-9])"""
UNSPELT = r"(?:(?:Dr|Prof|Ing|Dipl|St|Jr|Sr)\.|van|von|vom|der|den|de|della|del|des|di|da|do|dos|das|du|la|las|le|les|los|el|al|bin|ibn|ter|ten|zu|zum|zur)"
NAME = r"(?:(?:Dr|Prof|Ing|Dipl|St|Jr|Sr)\.|\p{Lu}\.(?:-?\p{Lu}\.)*+|\p{Lu}[\p{L}\p{M}]*+(?:(?:-|['\u2019](?!(?:s|ll|d|re|ve|m|t)\b))\p{L}[\p{L}\p{M}]*+)*+)"
PATTERNS = {
    "secret": SECRET,
    "key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}(?!\d)|(?<![\w+.-])(?:\+?1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
    "card": r"(?<![\d.])(?=[2-6])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "person": r"\b(?:Mr|Mrs|Ms|Miss|Mister|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr|Dona|Don|Госпожа|Господин|Κυρία|Κύριος)\.?(?: (?:" + UNSPELT + " )*+" + NAME + ")+",
}
ISSUER = r"^(?:4|5[0-8]|2(?:2[0-9][0-9]|[3-6][0-9][0-9]|7[01][0-9]|720)|3[0-9]|6[0-9])"
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Dona|Госпожа|Κυρία)\b"


def quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def guarded() -> str:
    """All patterns in their order, behind tests of a character or two that their matches pass: most places end there."""
    first = {"secret": r"(?=[pPtTsSaA])", "key": "(?=A[KS]IA)", "iban": r"(?=[A-Z][A-Z]\d)", "email": "(?=[A-Za-z0-9._%+-])", "person": "(?=[MHFSDГΚ])"}
    alone = {k: f"{first.get(k, '')}(?:{p})" for k, p in PATTERNS.items()}
    numbers = "|".join(alone.pop(k) for k in ("ip", "ssn", "phone", "card"))
    return "|".join([*(alone[k] for k in ("secret", "key", "iban", "email")), f"(?=[0-9+(])(?:{numbers})", alone["person"]])


ANY = quoted(guarded())


def check_digit(payload: str) -> str:
    """The Luhn digit of a digit string."""
    each = f"transform(sequence(1, length({payload})), j -> cast(substr({payload}, length({payload}) - j + 1, 1) as int) * (1 + j % 2))"
    return f"cast((10 - aggregate({each}, 0, (s, d) -> s + cast(floor(d / 10) as int) + d % 10) % 10) % 10 as string)"


def feistel(left: str, right: str, mod_left: str, mod_right: str, salt: str) -> str:
    """Eight rounds on two numbers: struct(l, r), a permutation of all pairs below the moduli."""
    turn = f"cast(conv(substr(sha2(concat_ws('|', {salt}, cast(i as string), cast(s.r as string)), 256), 1, 15), 16, 10) as bigint)"
    return f"aggregate(sequence(1, 8), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> named_struct('l', s.r, 'r', pmod(s.l + {turn}, if(i % 2 = 1, {mod_left}, {mod_right}))))"


def permuted(digits: str, salt: str) -> str:
    half, size = f"cast(floor(length({digits}) / 2) as int)", f"length({digits})"
    power = lambda n: f"cast(pow(10, {n}) as bigint)"
    net = feistel(f"coalesce(nullif(substr({digits}, 1, {half}), ''), '0')", f"substr({digits}, {half} + 1)", power(half), power(f"({size} - {half})"), salt)
    return f"transform(array({net}), p -> concat(if({half} = 0, '', lpad(cast(p.l as string), {half}, '0')), lpad(cast(p.r as string), {size} - {half}, '0')))[0]"


def mod97(text: str) -> str:
    """The remainder of letters (A as 10) and digits read as one number."""
    return f"aggregate(sequence(1, length({text})), 0, (s, j) -> if(substr({text}, j, 1) rlike '[0-9]', s * 10 + cast(substr({text}, j, 1) as int), s * 100 + ascii(substr({text}, j, 1)) - 55) % 97)"


# Letters that surrogates of names are made of, by script: those that a letter stands for, those it is drawn from.
SPOKEN = [("aeiouyäöüàâéèêëîïôûùáíóúñæœ", "aeiou"), ("bcdfghjklmnpqrstvwxzßç", "bdfgklmnprstvz"), ("аеёиоуыэюяй", "аеиоу"), ("бвгджзклмнпрстфхцчшщъь", "бвгдзклмнпрст"), ("αεηιουωάέήίόύώϊϋΐΰ", "αειου"), ("βγδζθκλμνξπρσςτφχψ", "βγδκλμνπρστ")]


def spoken(char: str, byte: str) -> str:
    cases = ""
    for of, out in SPOKEN:
        cases += f" when instr('{of}', {char}) > 0 then substr('{out}', 1 + {byte} % {len(out)}, 1) when instr('{of}', lower({char})) > 0 then upper(substr('{out}', 1 + {byte} % {len(out)}, 1))"
    return cases


def spelt(value: str, salt: str, hexadecimal: str, name: bool = False) -> str:
    """value with each letter and digit drawn anew within its class, from digests of 32 characters' worth."""
    byte = f"cast(conv(substr(b[cast(floor((j - 1) / 32) as int)], 1 + 2 * ((j - 1) % 32), 2), 16, 10) as int)"
    char = f"substr({value}, j, 1)"
    new = (
        f"case {spoken(char, byte) if name else ''} when {hexadecimal} then substr('0123456789abcdef', 1 + {byte} % 16, 1) when {char} rlike '[a-z]' then char(97 + {byte} % 26) when {char} rlike '[A-Z]' then char(65 + {byte} % 26)"
        f" when {char} rlike '[0-9]' then char(48 + {byte} % 10) when {char} rlike '[а-я]' then substr('абвгдежзиклмнопрстуфхцчшэюя', 1 + {byte} % 27, 1) when {char} rlike '[А-Я]' then substr('АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ', 1 + {byte} % 27, 1)"
        f" when {char} rlike '[α-ωά-ώ]' then substr('αβγδεζηθικλμνξοπρστυφχψω', 1 + {byte} % 24, 1) when {char} rlike '[Α-Ω]' then substr('ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ', 1 + {byte} % 24, 1)"
        f" when {char} rlike '\\\\p{{Lu}}' then char(65 + {byte} % 26) when {char} rlike '\\\\p{{L}}' then char(97 + {byte} % 26) else {char} end"
    )
    blocks = f"transform(sequence(0, cast(floor(length({value}) / 32) as int)), k -> sha2(concat_ws('|', {salt}, {value}, cast(k as string)), 256))"
    return f"transform(array({blocks}), b -> array_join(transform(sequence(1, length({value})), j -> {new}), ''))[0]"


def kind_of(m: str) -> str:
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    luhn = f"{check_digit(f'substr({digits}, 1, length({digits}) - 1)')} = substr({digits}, -1)"
    bare = f"replace({m}, ' ', '')"
    account = f"length({bare}) between 15 and 34 and {mod97(f'concat(substr({bare}, 5), substr({bare}, 1, 4))')} = 1"
    whole = lambda k: f"{m} rlike {quoted('^(?:' + PATTERNS[k] + ')$')}"
    return f"case when {whole('person')} then 'person' when {whole('email')} then 'email' when {whole('key')} then 'key' when {whole('iban')} then if({account}, 'iban', null) when {whole('ip')} then 'ip' when {whole('ssn')} then 'ssn' when {whole('card')} then if({luhn} and {digits} rlike '{ISSUER}', 'card', null) when {whole('phone')} then 'phone' else 'secret' end"


def value_of(kind: str, m: str) -> str:
    """What coreferent mentions share."""
    return f"""case {kind} when 'email' then lower({m}) when 'person' then regexp_replace({m}, '^\\\\S+ ', '') when 'secret' then {m} when 'key' then {m} when 'ip' then {m} when 'iban' then replace({m}, ' ', '')
        when 'phone' then regexp_replace(regexp_replace({m}, r'^\\+\\d{{1,3}}(?=[ .(-])', ''), '[^0-9]', '') else regexp_replace({m}, '[^0-9]', '') end"""


def surrogate_of(kind: str, m: str, value: str, salt: str) -> str:
    """The replacement of mention m."""
    placed = lambda new, text: f"array_join(transform(sequence(1, length({text})), j -> if(substr({text}, j, 1) rlike '[0-9]', substr(n, length(regexp_replace(substr({text}, 1, j), '[^0-9]', '')), 1), substr({text}, j, 1))), '')"
    over = lambda new, text: f"transform(array({new}), n -> {placed('n', text)})[0]"
    octets = f"transform(split({value}, '[.]'), o -> cast(o as bigint))"
    ip = f"transform(array({feistel(f'{octets}[0] * 256 + {octets}[1]', f'{octets}[2] * 256 + {octets}[3]', '65536', '65536', salt)}), p -> concat_ws('.', p.l div 256, p.l % 256, p.r div 256, p.r % 256))[0]"
    card = over(f"transform(array(concat(substr({value}, 1, 1), {permuted(f'substr({value}, 2, length({value}) - 2)', salt)})), c -> concat(c, {check_digit('c')}))[0]", m)
    prefix = f"regexp_extract({m}, r'^\\+\\d{{1,3}}(?=[ .(-])', 0)"
    phone = f"concat({prefix}, {over(permuted(value, salt), f'substr({m}, length({prefix}) + 1)')})"
    domain = f"regexp_replace(substring_index({value}, '@', -1), '[.][^.]*$', '')"
    email = f"concat({spelt(f'substring_index({value}, chr(64), 1)', f'{salt}, {value}', 'false')}, '@', {spelt(domain, f'{salt}, {domain}', 'false')}, '.example')"
    given = f"if({m} rlike {quoted(FEMALE)}, case when {value} rlike '[а-яА-Я]' then 'а' when {value} rlike '[α-ωΑ-Ω]' then 'α' else 'a' end, case when {value} rlike '[а-яА-Я]' then 'н' when {value} rlike '[α-ωΑ-Ω]' then 'ς' else 'o' end)"
    parts = f"split({value}, ' ')"
    spelling = f"if(length({value}) < 3, concat({value}, 'xxxx'), w)"  # so short values have room to stay distinct
    name = f"array_join(transform({parts}, (w, at) -> if(w rlike {quoted('^' + UNSPELT + '$')}, w, if(at + 1 < size({parts}) and length(w) > 1 and not endswith(w, '.'), concat(substr({spelt('w', salt, 'false', True)}, 1, length(w) - 1), {given}), {spelt(spelling, salt, 'false', True)}))), ' ')"
    secret = spelt(f"if(length({value}) < 6, concat({value}, repeat('x', 6 - length({value}))), {value})", f"{salt}, {value}", f"{value} rlike '^[0-9a-f]{{8,}}$'")
    inner = spelt(f"substr({value}, 5)", f"{salt}, {value}", "false")
    account = f"transform(array({inner}), b -> concat(substr({value}, 1, 2), lpad(cast(98 - {mod97(f"concat(b, substr({value}, 1, 2), '00')")} as string), 2, '0'), b))[0]"
    iban = f"transform(array({account}), n -> array_join(transform(sequence(1, length({m})), j -> if(substr({m}, j, 1) = ' ', ' ', substr(n, length(replace(substr({m}, 1, j), ' ', '')), 1))), ''))[0]"
    return f"""case {kind} when 'email' then {email} when 'iban' then {iban} when 'ip' then {ip} when 'card' then {card} when 'phone' then {phone} when 'ssn' then {over(permuted(value, salt), m)}
        when 'key' then concat(substr({m}, 1, 4), {spelt(f'substr({value}, 5)', f'{salt}, {value}', 'false')}) when 'person' then concat(regexp_extract({m}, '^\\\\S+ ', 0), {name}) else {secret} end"""


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def hits(text: str) -> str:
    """array(struct(lead, m, kind, value)) of the mentions in text, in order; kind is null for what stays, lead goes before m."""
    leads = f"transform(regexp_extract_all({text}, {ANY}, 0), w -> named_struct('w', w, 'lead', regexp_extract(w, {quoted('^' + LEAD + '["' + chr(39) + ']?')}, 0)))"
    mentions = f"transform({leads}, l -> named_struct('lead', l.lead, 'm', substr(l.w, length(l.lead) + 1)))"
    kinds = f"transform({mentions}, l -> named_struct('lead', l.lead, 'm', l.m, 'kind', coalesce({kind_of('l.m')}, if(l.lead <> '', 'secret', null))))"
    return f"transform({kinds}, h -> named_struct('lead', h.lead, 'm', h.m, 'kind', h.kind, 'value', {value_of('h.kind', 'h.m')}))"


def salted(key: str, attempt: str) -> str:
    return f"{literal(key)}, h.kind, cast({attempt} as string)"


def overrides(docs: DataFrame, key: str, text_column: str, most_attempts: int = 20) -> DataFrame | None:
    """(kind, value, attempt) of the entities whose first surrogate another entity has too; None where there are none.

    Permuted numbers can't coincide and aren't checked. Only distinct entities are shuffled.
    """
    found = docs.select(F.expr(f"inline({hits(f'`{text_column}`')})")).where("kind in ('email', 'person', 'secret', 'key', 'iban')")
    now = written(found.groupBy("kind", "value").agg(F.min("m").alias("m")).withColumn("attempt", F.lit(0)))
    for attempt in range(1, most_attempts + 1):
        named = now.withColumn("h", F.struct("m", "kind", "value"))
        named = named.withColumn("surrogate", F.expr(surrogate_of("h.kind", "h.m", "h.value", salted(key, "attempt"))))
        named = named.withColumn("surrogate", F.when(F.col("kind") == "person", F.regexp_replace("surrogate", r"^\S+ ", "")).otherwise(F.col("surrogate")))
        claims = named.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "value")).alias("first"), F.count("*").alias("n")).where("n > 1")
        lost = written(named.join(claims, ["kind", "surrogate"]).where(F.struct("attempt", "value") != F.col("first")).select("kind", "value"))
        if lost.isEmpty():
            again = now.where("attempt > 0").select("kind", "value", "attempt")
            return None if attempt == 1 else again
        now = written(now.join(lost.withColumn("lost", F.lit(True)), ["kind", "value"], "left").withColumn("attempt", F.when(F.col("lost"), attempt).otherwise(F.col("attempt"))).drop("lost"))
    raise RuntimeError(f"surrogates coincide after {most_attempts} attempts")


def replaced(docs: DataFrame, key: str, text_column: str = "text") -> DataFrame:
    """docs with surrogates in its text, and two columns more: n_entities, and entity_kinds (sorted, comma-joined)."""
    docs = docs.drop("n_entities", "entity_kinds")
    again = overrides(docs.select(text_column), key, text_column)
    text = f"`{text_column}`"
    new, attempt = docs, "0"
    if again is not None:
        of = docs.select(F.xxhash64(text_column).alias("__hash"), F.length(text_column).alias("__size"), F.expr(f"inline({hits(text)})"))
        own = of.join(again, ["kind", "value"]).groupBy("__hash", "__size").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "value"), "attempt"))).alias("__again"))
        new = docs.withColumn("__hash", F.xxhash64(text_column)).withColumn("__size", F.length(text_column)).join(own, ["__hash", "__size"], "left")
        attempt = "coalesce(try_element_at(__again, concat_ws('|', h.kind, h.value)), 0)"
    new = new.withColumn("__hits", F.expr(f"transform({hits(text)}, h -> named_struct('lead', h.lead, 'kind', h.kind, 'new', if(h.kind is null, h.m, {surrogate_of('h.kind', 'h.m', 'h.value', salted(key, attempt))})))"))
    rebuilt = f"if(size(__hits) > 0, array_join(zip_with(split({text}, {ANY}, -1), __hits, (gap, h) -> concat(gap, coalesce(h.lead, ''), coalesce(h.new, ''))), ''), {text})"
    new = new.withColumn("__text", F.expr(rebuilt)).withColumn("__kinds", F.expr("filter(transform(__hits, h -> h.kind), k -> k is not null)"))
    columns = [F.col("__text").alias(c) if c == text_column else F.coalesce(F.length("__text"), "n_chars").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return new.select(*columns, F.coalesce(F.expr("size(__kinds)"), F.lit(0)).cast("long").alias("n_entities"), F.expr("coalesce(array_join(array_sort(array_distinct(__kinds)), ','), '')").alias("entity_kinds"))
