"""Personal data: surrogates for detected entities, in DataFrame functions alone.

Entities are found by pattern, typed and brought to a normal form (e-mail in
lower case, phone and card numbers as digits).  A titled name holds several:
its given names, its initials and its family name, whatever the title.  Every different (type, normal form) gets one surrogate of the same
type and format, made from a keyed hash, so an entity reads the same wherever
and however it is written.  Surrogates are checked against each other and
against all originals; those that collide are drawn again until none does,
so different entities stay different.

The key is a secret of the user: ``KEY_CONF`` of the session, or an argument.
There is no default.  Without one a random key is drawn for the application,
so that surrogates agree within it and nobody can undo them, but those of
another application differ.  The hash is HMAC-SHA-256.

The table of entities is aggregated before any join.  Clean texts never
leave the scan: only texts with an entity are split, joined and put together.

Defined cases: null and empty texts stay as they are; digits that only look
like a card number (check digit wrong) stay unless an id or a phone number is
among them; passwords without a letter or
digit (``****``, the second ``=`` of a comparison) stay; repeated rows get equal texts;
an empty table gives an empty table; other columns pass through, and a
column named ``n_entities`` is replaced.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import materialize

# Named so that Spark redacts its value wherever it shows settings.
KEY_CONF = "spark.lectern.surrogate.secret"
ROUNDS = 40

# Titles by gender, given names by gender and script, syllables.
TITLES_M = "Mr|Herr|Señor|Monsieur|Господин|Г-н|Κύριος"
TITLES_F = "Mrs|Ms|Miss|Frau|Señora|Señorita|Madame|Mademoiselle|Госпожа|Г-жа|Κυρία"
TITLES_N = "Dr|Prof"
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl Denis Emil Felix Georg Hugo Ivan Jonas Leon Marco".split(),
    ("f", "latin"): "Alma Berta Clara Diana Elena Flora Greta Helga Irma Julia Lena Maria".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Лидия Мария Нина Ольга".split(),
    ("m", "greek"): "Αλέξης Γιάννης Δημήτρης Ηλίας Κώστας Λευτέρης Μάριος Νίκος Πέτρος Σπύρος Τάσος Φώτης".split(),
    ("f", "greek"): "Άννα Βάσω Γιάννα Δήμητρα Ελένη Ζωή Ηρώ Κατερίνα Μαρία Νίκη Σοφία Χρύσα".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va".split(),
    "cyrillic": "ба бе бо да де до га го ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве во".split(),
    "greek": "βα βε βο γα γο δα δε δο κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε το".split(),
}
ALPHABETS = {
    r"[\p{IsCyrillic}&&\p{Ll}]": "абвгдежзиклмнопрстуфхцчшэюя", r"[\p{IsCyrillic}&&\p{Lu}]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    r"[\p{IsGreek}&&\p{Ll}]": "αβγδεζηθικλμνξοπρστυφχψω", r"[\p{IsGreek}&&\p{Lu}]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
}

NAME = r"\p{Lu}(?:[\p{L}\p{M}]|['’-](?!s(?!\p{L}))(?=\p{L}))++"      # without the 's of a possessive
INITIALS = r"(?:\p{Lu}\.[ -]?|\p{Lu} )*+"
PATTERNS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("password", r"(?<![A-Za-z])(?:[Pp]assword|PASSWORD|passwd|pwd)\s?[=:]\s?[^\s\"']+"),
    ("access_key", r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("hex_secret", r"(?<![A-Za-z0-9])(?=[0-9]*[A-Fa-f])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)"),
    ("card", r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    ("national_id", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])"),
    ("name", rf"(?<!\p{{L}})(?:{TITLES_M}|{TITLES_F}|{TITLES_N})\.? {INITIALS}{NAME}(?: {INITIALS}{NAME})*+"),
]
# Pieces of a name: the title, names, initials, and what is between them.
NAME_PIECES = rf"^(?:{TITLES_M}|{TITLES_F}|{TITLES_N})\.? |{NAME}|\p{{Lu}}\.?|."
# Digits that may be a card, an id or a phone number are told apart in turns:
# cards in a usual grouping whose check digit is right, wherever they begin;
# then ids and phone numbers in what is left; then digits in any grouping.
CARD_START = r"(?:(?<![\w.-])|(?<=(?<![\w.-])\d{1,3}-))"
CARD_END = r"(?!\w)(?!-(?!\d{1,4}(?![\w-])))"
FOURS = [r"\d{4} \d{4} \d{4} \d{4}", r"\d{4}-\d{4}-\d{4}-\d{4}"]
GROUPINGS = "|".join([*FOURS, r"\d{4} \d{6} \d{4,5}", r"\d{4}-\d{6}-\d{4,5}", r"\d{4} \d{4} \d{5}", r"\d{4}-\d{4}-\d{5}", r"\d{13,19}"])
LONG_GROUPINGS = "|".join([*(f + f[5] + r"\d{1,3}" for f in FOURS), r"\d{6}[ -]\d{13}"])
PATTERN = dict(PATTERNS)
FIRST = "|".join(f"(?:{PATTERN[t]})" for t in ("email", "password", "access_key", "hex_secret", "ip"))
# A grouped card with a wrong check digit stays, and is no phone number.
SECOND = "|".join([f"{CARD_START}(?=[2-6])(?:{'|'.join(FOURS)}){CARD_END}", *(f"(?:{PATTERN[t]})" for t in ("national_id", "phone"))])
ANY = "|".join(f"(?:{p})" for t, p in PATTERNS if t != "card") + r"|\d(?:[ -]?\d){12}"
# What every entity contains; most texts have none of it and are not searched further.
HINT = rf"[0-9@=:]|A[KS]IA[A-Z0-9]{{16}}|(?<!\p{{L}})(?:{TITLES_M}|{TITLES_F}|{TITLES_N})\.? \p{{Lu}}"


# The value of a password without its label.
PASSWORD = "regexp_replace({}, '^[A-Za-z]+\\\\s?[=:]\\\\s?', '')"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(col: str) -> str:
    return f"regexp_replace({col}, '[^0-9]', '')"


def _luhn(digits: str, doubled: int) -> str:
    """Sum of the check-digit rule; ``doubled``: parity, from the right, of the digits that count double."""
    d = f"cast(substr({digits}, i, 1) as int)"
    return (f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + CASE WHEN (length({digits}) - i) % 2 = {doubled} "
            f"THEN {d} * 2 - CASE WHEN {d} > 4 THEN 9 ELSE 0 END ELSE {d} END)")


def typed(entity: str = "ent") -> Column:
    """Type of an entity, null where it is to stay."""
    whens = " ".join(
        f"WHEN {entity} rlike {_quoted('^(?:' + p + ')$')} THEN "
        + (f"CASE WHEN {_luhn(_digits(entity), 1)} % 10 = 0 THEN 'card' END" if t == "card" else
           f"CASE WHEN {PASSWORD.format(entity)} rlike '[\\\\p{{L}}\\\\p{{N}}]' THEN 'password' END" if t == "password" else
           f"'{t}'") for t, p in PATTERNS)
    return F.expr(f"CASE {whens} END")


def normal(kind: str = "kind", entity: str = "ent") -> Column:
    """Normal form: what an entity has in common wherever it is written."""
    d = _digits(entity)
    return F.expr(f"""CASE
        WHEN {kind} IN ('email', 'hex_secret') THEN lower({entity})
        WHEN {kind} = 'password' THEN {PASSWORD.format(entity)}
        WHEN {kind} = 'phone' THEN CASE WHEN length({d}) = 11 AND left({d}, 1) = '1' THEN substr({d}, 2) ELSE {d} END
        WHEN {kind} IN ('card', 'national_id') THEN {d}
        WHEN {kind} = 'initial' THEN left({entity}, 1)
        ELSE {entity} END""")


def named(occ: DataFrame) -> DataFrame:
    """Occurrences, names in pieces: ``part`` numbers them, and ``role`` tells
    a family name (a) from a given name (f, m; u where the title does not say)."""
    whole = occ.withColumn("_parts", F.expr(f"CASE WHEN kind = 'name' THEN regexp_extract_all(ent, {_quoted(NAME_PIECES)}, 0) ELSE array(ent) END"))
    title = lambda t: f"_parts[0] rlike {_quoted('^(?:' + t + ')[. ]')}"
    return (whole.select("_rid", "pos", "kind", "_parts", F.posexplode("_parts").alias("part", "ent"))
            .withColumn("kind", F.expr(f"CASE WHEN kind <> 'name' THEN kind WHEN kind IS NULL OR part = 0 THEN NULL "
                                       f"WHEN ent rlike {_quoted('^' + NAME + '$')} THEN 'name' WHEN ent rlike '^\\\\p{{Lu}}' THEN 'initial' END"))
            .withColumn("role", F.expr(f"CASE WHEN kind IS NULL OR kind <> 'name' OR part = size(_parts) - 1 THEN 'a' "
                                       f"WHEN {title(TITLES_M)} THEN 'm' WHEN {title(TITLES_F)} THEN 'f' ELSE 'u' END"))
            .withColumn("counts", F.expr("kind IS NOT NULL AND part = size(_parts) - 1")).drop("_parts"))


def _shaped(value: str, h: str) -> str:
    """Letters for letters, digits for digits, the rest as it is.  Letters of
    scripts without an alphabet here become Latin."""
    b = f"cast(conv(substr({h}, 2 * (i % 32) + 1, 2), 16, 10) as int)"
    return (f"array_join(transform(split({value}, ''), (c, i) -> CASE WHEN c rlike '[a-z]' THEN char(97 + {b} % 26) "
            f"WHEN c rlike '[A-Z]' THEN char(65 + {b} % 26) WHEN c rlike '[0-9]' THEN char(48 + {b} % 10) "
            + "".join(f"WHEN c rlike {_quoted(p)} THEN substr('{a}', 1 + {b} % {len(a)}, 1) " for p, a in ALPHABETS.items())
            + f"WHEN c rlike '\\\\p{{Lu}}' THEN char(65 + {b} % 26) WHEN c rlike '\\\\p{{L}}' THEN char(97 + {b} % 26) "
            f"WHEN c rlike '\\\\p{{N}}' THEN char(48 + {b} % 10) ELSE c END), '')")


def script_of(value: str) -> str:
    return f"CASE WHEN {value} rlike '[\\\\u0400-\\\\u04FF]' THEN 'cyrillic' WHEN {value} rlike '[\\\\u0370-\\\\u03FF]' THEN 'greek' ELSE 'latin' END"


_DRAWN: dict[str, str] = {}


def secret_key(spark: SparkSession) -> str:
    """The configured key, else the one drawn for this application."""
    return (spark.conf.get(KEY_CONF, None) or spark.sparkContext.getConf().get(KEY_CONF)
            or _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32)))


def hmac_sha256(message: str, key: str) -> str:
    """SQL for the HMAC (lowercase hex) of a string expression."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in k).hex().upper() for pad in (0x36, 0x5C))
    return f"sha2(concat(X'{outer}', unhex(sha2(concat(X'{inner}', encode({message}, 'UTF-8')), 256))), 256)"


def surrogate(attempt: int, key: str) -> Column:
    """Candidate for (kind, norm): the same type and format, from a keyed hash."""
    h = hmac_sha256(f"concat(kind, '|', norm, '|{attempt}')", key)
    dig = "concat(right(lpad(conv(substr(h, 1, 15), 16, 10), 18, '0'), 12), right(lpad(conv(substr(h, 16, 15), 16, 10), 18, '0'), 12))"
    byte = lambda k: f"cast(conv(substr(h, {2 * k + 1}, 2), 16, 10) as int)"
    body = "concat(left(norm, 1), substr(dig, 1, length(norm) - 2))"
    syl = {s: "array(" + ", ".join(map(_quoted, v)) + ")" for s, v in SYLLABLES.items()}
    n_syl = 3 + attempt // 2
    family = "CASE " + " ".join(
        f"WHEN {script_of('norm')} = '{s}' THEN initcap(concat("
        + ", ".join(f"get({a}, {byte(k)} % {len(SYLLABLES[s])})" for k in range(n_syl)) + "))"
        for s, a in syl.items()) + " END"
    sylls = lambda s, n, k0=0: "".join(f", get({syl[s]}, {byte(k0 + k)} % {len(SYLLABLES[s])})" for k in range(n))
    given = "CASE " + " ".join(
        f"WHEN {script_of('norm')} = '{s}'" + (f" AND (role = 'm' OR role = 'u' AND {byte(31)} % 2 = 0)" if g == "m" else "")
        + " THEN concat(get(array(" + ", ".join(map(_quoted, v)) + f"), {byte(0)} % {len(v)}){sylls(s, min(max(attempt - 1, 0), 20), 1)})"
        for g in ("m", "f") for (g2, s), v in GIVEN.items() if g2 == g) + " END"
    initial = "CASE " + " ".join(
        f"WHEN {script_of('norm')} = '{s}' THEN " + (f"upper(left(concat(''{sylls(s, 1)}), 1))" if attempt < 2 else
                                                    f"initcap(concat(''{sylls(s, min(attempt - 1, 20))}))") for s in syl) + " END"
    extra = f", substr(dig, 1, {min(attempt, 12)})" if attempt else ""
    octet = f"'{10}'" if attempt < 8 else f"cast(11 + {byte(3)} % 200 as string)"
    exchange = "'555'" if attempt < 4 else "concat(2 + cast(substr(dig, 4, 1) as int) % 8, substr(dig, 5, 2))"
    expr = f"""CASE
        WHEN kind = 'email' THEN concat({_shaped("substring_index(norm, '@', 1)", 'h')}{extra}, '@example.org')
        WHEN kind = 'password' THEN concat({_shaped('norm', 'h')}, substr(h, 33, {min(attempt, 32)}))
        WHEN kind = 'access_key' THEN concat(left(norm, 4), upper({_shaped('substr(norm, 5)', 'h')}))
        WHEN kind = 'hex_secret' THEN left(concat(h, h), length(norm))
        WHEN kind = 'ip' THEN concat({octet}, '.', {byte(0)}, '.', {byte(1)}, '.', 1 + {byte(2)} % 254)
        WHEN kind = 'card' THEN concat({body}, (10 - {_luhn(body, 0)} % 10) % 10)
        WHEN kind = 'national_id' THEN {"concat(9, substr(dig, 1, 8))" if attempt < 8 else "substr(dig, 1, 9)"}
        WHEN kind = 'phone' THEN CASE WHEN length(norm) = 10
             THEN concat(2 + cast(left(dig, 1) as int) % 8, substr(dig, 2, 2), {exchange}, substr(dig, 7, 4))
             ELSE concat(1 + cast(left(dig, 1) as int) % 9, substr(dig, 2, length(norm) - 1)) END
        WHEN kind = 'initial' THEN {initial}
        WHEN role <> 'a' THEN {given}
        ELSE {family} END"""
    return F.expr(f"element_at(transform(array(named_struct('h', {h})), x -> {_with(expr, dig)}), 1)")


def _with(expr: str, dig: str) -> str:
    import re
    expr = re.sub(r"\bdig\b", lambda _: f"({dig})", expr)
    return re.sub(r"\bh\b", "x.h", expr)


def surrogates(entities: DataFrame, key: str | None = None, rounds: int = ROUNDS, propose=surrogate) -> DataFrame:
    """``kind, norm`` (distinct; ``role`` for names) -> plus ``sur``: no two
    alike within a kind, none equal to any original."""
    key = key or secret_key(entities.sparkSession)
    if "role" not in entities.columns:
        entities = entities.withColumn("role", F.lit("a"))
    pending = materialize(entities, "entities")
    originals, accepted = pending, None
    for attempt in range(rounds):
        cand = materialize(pending.withColumn("sur", propose(attempt, key)), "candidates")
        free = cand.join(originals.select("kind", F.col("norm").alias("sur")), ["kind", "sur"], "left_anti")
        if accepted is not None:
            free = free.join(accepted.select("kind", "sur"), ["kind", "sur"], "left_anti")
        won = materialize(free.groupBy("kind", "sur").agg(F.min("norm").alias("norm")).select("kind", "norm", "sur"), "surrogates")
        accepted = won if accepted is None else accepted.union(won)
        pending = materialize(cand.select("kind", "norm", "role").join(won, ["kind", "norm"], "left_anti"), "pending")
        if not pending.take(1):
            return accepted
    raise RuntimeError(f"surrogates still collide after {rounds} draws")


def rendered() -> Column:
    """An occurrence (kind, ent, norm, sur, key hash) in the format it was written in."""
    d = _digits("ent")
    full = f"concat(left({d}, length({d}) - length(norm)), sur)"
    in_place = (f"aggregate(split(ent, ''), named_struct('o', '', 'k', 0), (s, c) -> CASE WHEN c rlike '[0-9]' "
                f"THEN named_struct('o', concat(s.o, substr({full}, s.k + 1, 1)), 'k', s.k + 1) "
                f"ELSE named_struct('o', concat(s.o, c), 'k', s.k) END, s -> s.o)")
    return F.expr(f"""CASE
        WHEN kind IN ('card', 'phone', 'national_id') THEN {in_place}
        WHEN kind = 'password' THEN concat(regexp_extract(ent, '^[A-Za-z]+\\\\s?[=:]\\\\s?', 0), sur)
        WHEN kind = 'initial' THEN concat(sur, substr(ent, 2))
        WHEN kind = 'hex_secret' AND ent = upper(ent) THEN upper(sur)
        ELSE sur END""")


def _cards(text: str) -> str:
    """Pieces of a text in the groupings of cards, overlapping ones too."""
    found = (f"regexp_extract_all({text}, {_quoted(f'{CARD_START}(?=({g}){CARD_END})')}, 1)" for g in (GROUPINGS, LONG_GROUPINGS))
    return f"concat({', '.join(found)})"


def _first_turn() -> str:
    """Pattern of a text's first turn: its cards are those of ``_cards`` with a right check digit (``_valid``)."""
    card = lambda p: f"concat({_quoted('|' + CARD_START + '(?:')}, {p}, {_quoted(')' + CARD_END)})"
    return (f"concat({_quoted(FIRST)}, CASE WHEN size(_valid) = 0 THEN '' "
            f"WHEN size(_valid) = size(_cards) THEN {card(_quoted(GROUPINGS + '|' + LONG_GROUPINGS))} "
            f"ELSE {card("array_join(array_distinct(_valid), '|')")} END, {_quoted('|(?:' + PATTERN['name'] + ')')})")


def _again(found: DataFrame, pattern: str) -> DataFrame:
    """Search the gaps between the entities found so far for more."""
    p = _quoted(pattern)
    return (found.withColumn("_ents", F.expr(
        f"flatten(zip_with(_gaps, _ents, (g, e) -> concat(regexp_extract_all(g, {p}, 0), "
        "CASE WHEN e IS NULL THEN cast(array() AS array<string>) ELSE array(e) END)))"))
        .withColumn("_gaps", F.expr(f"flatten(transform(_gaps, g -> CASE WHEN g rlike {p} THEN split(g, {p}, -1) ELSE array(g) END))")))


def pieces(texts: DataFrame, text: str) -> DataFrame:
    """Entities of the texts (``_ents``) and what lies around them (``_gaps``, one more)."""
    found = (texts.withColumn("_cards", F.expr(_cards(text)))
             .withColumn("_valid", F.expr(f"filter(_cards, c -> {_luhn(_digits('c'), 1)} % 10 = 0)"))
             .withColumn("_first", F.expr(_first_turn()))
             .withColumn("_gaps", F.expr(f"split({text}, _first, -1)"))
             .withColumn("_ents", F.expr(f"regexp_extract_all({text}, _first, 0)"))
             .drop(text, "_cards", "_valid", "_first"))
    return _again(_again(found, SECOND), PATTERN["card"])


def replace(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text``, plus ``n_entities`` (replaced)."""
    cols = [c for c in docs.columns if c != "n_entities"]
    found = F.col(text).rlike(HINT) & F.col(text).rlike(ANY)
    clean = docs.filter(~F.coalesce(found, F.lit(False))).select(*cols, F.lit(0).cast("long").alias("n_entities"))
    hit = materialize(pieces(docs.filter(found).select(
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(cols) if c != text], F.col(text).alias("_text"),
        F.monotonically_increasing_id().alias("_rid")), "_text"), "entities-in-texts")
    occ = (named(hit.select("_rid", F.posexplode("_ents").alias("pos", "ent")).withColumn("kind", typed()))
           .withColumn("norm", normal()))
    occ = materialize(occ, "occurrences")
    chosen = surrogates(occ.filter("kind IS NOT NULL").groupBy("kind", "norm").agg(F.min("role").alias("role")), key)
    done = (occ.join(chosen, ["kind", "norm"], "left")
            .select("_rid", "pos", "part", F.when(F.col("sur").isNull(), F.col("ent")).otherwise(rendered()).alias("new"),
                    F.col("counts").cast("long").alias("hit")))
    # One list per text, as long as the text has entities; none where digits turned out to be none.
    lists = done.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("pos", "part", "new"))).alias("_new"),
                                     F.sum("hit").alias("n_entities"))
    whole = F.expr("concat(coalesce(array_join(transform(_new, x -> concat(CASE WHEN x.part = 0 THEN _gaps[x.pos] ELSE '' END, x.new)), ''), ''), "
                   "element_at(_gaps, -1))")
    fixed = hit.join(lists, "_rid", "left").select(
        *[(whole if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(cols)],
        F.coalesce("n_entities", F.lit(0).cast("long")).alias("n_entities"))
    return clean.unionByName(fixed)
