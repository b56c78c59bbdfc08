"""Surrogates for personal data, in DataFrame and SQL functions only.

Entities are found by one pattern, whose marks cut a text into entities and what lies between. A replacement depends on
a key, the entity's kind and its canonical form alone, so that the same entity has the same surrogate wherever it stands
and in whatever layout: digits go into the layout of the original, letters keep their script and case, card numbers and
account numbers stay valid. Of a name behind a title the given names and the surname have surrogates of their own: the
title stays, the given name has its gender, and a short form (Mr Smith for Mr John Smith) has the surname of the full
one. In a text that has a name behind a title, the full name and the surname are entities too where no title stands
before them; they have the gender that a title in this text tells.

Before anything is replaced, the surrogates of all distinct entities are checked: one that two entities would share, or
that is itself an entity of the table, is drawn again until there is none. Names and mail addresses get longer with each
attempt, so that there are always enough. The layouts of numbers can't grow: there an attempt after the 32nd may be
an entity of the table, but never another one's surrogate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, free_prefix, smaller, written

#: Titles by the gender that they tell; the others tell none.
HE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "г-н", "κ")
SHE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "г-жа", "κα")
ANY = ("Dr", "Prof")
#: Beginnings of surrogate first names by script and gender; endings and surnames are made of syllables.
FIRST = {
    ("latin", "he"): ("Alden", "Boris", "Carlo", "Devin", "Edgar", "Felix", "Goran", "Henri"),
    ("latin", "she"): ("Alba", "Berta", "Clara", "Dora", "Edith", "Flora", "Greta", "Hanna"),
    ("latin", "any"): ("Alex", "Robin", "Kim", "Sasha", "Noel", "Jamie", "Toni", "Lou"),
    ("cyrillic", "he"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь"),
    ("cyrillic", "she"): ("Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина"),
    ("cyrillic", "any"): ("Саша", "Женя", "Валя", "Слава", "Шура", "Паша", "Тоня", "Миша"),
    ("greek", "he"): ("Άρης", "Βασίλης", "Γιώργος", "Δήμος", "Ηλίας", "Κώστας", "Νίκος", "Πέτρος"),
    ("greek", "she"): ("Άννα", "Βάσω", "Γεωργία", "Δάφνη", "Ελένη", "Κατερίνα", "Νίκη", "Σοφία"),
    ("greek", "any"): ("Άγγελος", "Χρύσα", "Φοίβη", "Λίνος", "Μέλπω", "Ξένια", "Ορέστης", "Ρέα"),
}
SYLLABLES = {
    "latin": ("ba", "ce", "di", "fo", "gu", "ha", "ke", "li", "mo", "nu", "pa", "re", "si", "to", "vu", "za"),
    "cyrillic": ("ба", "ве", "ги", "до", "жу", "за", "ке", "ли", "мо", "ну", "па", "ре", "си", "то", "фу", "ха"),
    "greek": ("βα", "γε", "δι", "ζο", "θυ", "κα", "λε", "μι", "νο", "πα", "ρε", "σι", "το", "φυ", "χα", "ψε"),
}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

_WORD = r"[\p{Lu}][\p{L}]++"
#: What may stand before a word of a name: initials and particles.
_BEFORE = r"(?:\p{Lu}\. ?|(?:van|von|vom|zu|zum|zur|der|den|ter|ten|de|del|della|di|da|do|dos|das|du|des|la|las|le|los|el|al|bin|ibn|y|e) |[dDlLO]['’](?=\p{Lu}))*"
_NAMED = rf"{_BEFORE}{_WORD}(?:-{_WORD})*"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_FREE = r"(?<![\p{L}\p{N}])"
_END = r"(?![\p{L}\p{N}])"
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)+",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.\d)",
    "ssn": rf"{_FREE}(?<![\d\-])\d{{3}}-\d{{2}}-\d{{4}}(?![\p{{L}}\p{{N}}\-])",
    "card": rf"{_FREE}(?:\d{{4}}[ \-]\d{{4}}[ \-]\d{{4}}[ \-]\d{{4}}|\d{{13,19}}){_END}",
    "iban": rf"{_FREE}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}",
    "phone": rf"{_FREE}(?:\+\d{{1,3}}[ .\-]?)?(?:\(\d{{2,4}}\)[ .\-]?|\d{{2,4}}[ .\-])\d{{3,4}}[ .\-]\d{{3,4}}{_END}",
    "name": rf"{_FREE}(?:{'|'.join((*HE, *SHE, *ANY))})(?:\. ?| ){_NAMED}(?: {_NAMED})*",
}
PATTERN = "|".join(KINDS.values())


_TITLE = rf"^(?:{'|'.join((*HE, *SHE, *ANY))})(?:\. ?| )"
#: The word or double word that a name ends with, without particles.
_UNIT = rf"({_WORD}(?:-{_WORD})*)$"
#: What stands before it: given names, initials, particles of the surname.
_GIVEN = rf"^(.*?) ?(?:(?:van|von|vom|zu|zum|zur|der|den|ter|ten|de|del|della|di|da|do|dos|das|du|des|la|las|le|los|el|al|bin|ibn|y|e) |[dDlLO]['’])*{_WORD}(?:-{_WORD})*$"
#: Attempts in which a surrogate must not be an entity of the table.
UNLIKE = 32


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, r"\D", "")


def _luhn(digits: Column) -> Column:
    """The sum of a card number's digits, every second from the right doubled, which is a multiple of 10 if it is valid."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _mod97(account: Column) -> Column:
    """An account number's check: 1 if it is valid. The first four characters go behind the others, letters count from 10."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97))


def _account(e: Column) -> Column:
    """The longest valid account number that a found one begins with; null if there is none."""
    whole = F.regexp_replace(e, " ", "")
    parts = F.transform(F.sequence(F.least(F.lit(34), F.length(whole)), F.lit(15), F.lit(-1)), lambda n: F.substring(whole, F.lit(1), n))
    return F.when(F.length(whole) >= 15, F.get(F.filter(parts, lambda x: _mod97(x) == 1), F.lit(0)))


def kind_of(e: Column) -> Column:
    """The kind of a found entity; null for one that only looks so, such as a number that is no valid card number."""
    return (
        F.when(e.contains("@"), "email")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ip")
        .when(e.rlike(r"^[A-Z]{2}\d{2}"), F.when(_account(e).isNotNull(), "iban"))
        .when(e.rlike(r"^(?:\d{13,19}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4})$"), F.when(_luhn(_digits(e)) % 10 == 0, "card"))
        .when(e.rlike(r"^[+(\d]"), "phone")
        .otherwise("name")
    )


def _gender(e: Column) -> Column:
    title = F.regexp_extract(e, r"^([\p{L}\-]+)", 1)
    titled = e.rlike(_TITLE)
    return F.when(titled & title.isin(*HE), "he").when(titled & title.isin(*SHE), "she").otherwise("any")


def _script(e: Column) -> Column:
    return F.when(e.rlike(r"[\p{IsCyrillic}]"), "cyrillic").when(e.rlike(r"[\p{IsGreek}]"), "greek").otherwise("latin")


def _name(e: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(e, _TITLE, "")


def canonical(e: Column, kind: Column) -> Column:
    """What two ways of writing an entity share: digits, lower-case letters, or of a name the surname without particles."""
    return (
        F.when(kind.isin("phone", "card", "ssn"), _digits(e))
        .when(kind == "iban", _account(e))
        .when(kind == "name", F.concat(F.lit("any:"), F.lower(F.regexp_replace(F.regexp_extract(_name(e), _UNIT, 1), "-", " "))))
        .otherwise(F.lower(e))
    )


def given_of(e: Column, kind: Column, gender: Column) -> Column:
    """The canonical form of a name's given names and initials, with their gender; null where there are none."""
    given = F.trim(F.regexp_extract(_name(e), _GIVEN, 1))
    return F.when((kind == "name") & (given != ""), F.concat(gender, F.lit(":"), F.lower(F.regexp_replace(given, "-", " "))))


def _stream(c: Column, kind: Column, attempt: Column, key: str) -> Column:
    """256 hexadecimal digits that depend on the key, the kind, the canonical form and the attempt."""
    inner = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, attempt.cast("string"), c), 512)
    return F.concat(F.sha2(F.concat(F.lit(key), F.lit("\u0002"), inner), 512), F.sha2(F.concat(F.lit(key), F.lit("\u0003"), inner), 512))


def _number(h: Column, i: Column, digits: int = 4) -> Column:
    """A number from the i-th group of the stream, which begins anew behind its end."""
    return F.conv(F.substring(h, F.pmod(i * digits, F.lit(256 // digits * digits)).cast("int") + 1, F.lit(digits)), 16, 10).cast("int")


def _pick(values: tuple[str, ...] | str, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _letters(c: Column, h: Column) -> Column:
    """Each letter and digit replaced by one of its script; other characters stay."""

    def one(x: Column, i: Column) -> Column:
        n = _number(h, i)
        out = F.when(x.rlike(r"^\d$"), _pick("0123456789", n))
        for script, test in (("cyrillic", r"^\p{IsCyrillic}$"), ("greek", r"^\p{IsGreek}$")):
            out = out.when(x.rlike(test), _pick(ALPHABETS[script], n))
        return out.when(x.rlike(r"^\p{L}$"), _pick(ALPHABETS["latin"], n)).otherwise(x)

    return F.array_join(F.transform(F.split(c, ""), one), "")


def replaced(c: Column, kind: Column, h: Column, attempt: Column) -> Column:
    """The canonical form of the surrogate, from the entity's stream. Each new attempt adds a syllable to a name and a letter to a mail address."""
    figures = lambda c: F.array_join(F.transform(F.split(c, ""), lambda x, i: _pick("0123456789", _number(h, i))), "")
    body = F.concat(F.substring(c, 1, 1), figures(F.substring(c, F.lit(2), F.length(c) - 2)))
    check = ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    basic = F.upper(_letters(F.lower(F.substring(c, F.lit(5), F.length(c) - 4)), h))
    account = F.concat(F.substring(c, 1, 2), F.lpad((98 - _mod97(F.concat(F.substring(c, 1, 2), F.lit("00"), basic))).cast("string"), 2, "0"), basic)
    domain = F.regexp_extract(c, r"(\.[^.]+)$", 1)
    address = F.substring(c, F.lit(1), F.length(c) - F.length(domain))
    longer = F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(1), attempt), lambda k: _pick(ALPHABETS["latin"], _number(h, 63 - k % 32))), "")).otherwise("")
    gender, script = F.substring_index(c, ":", 1), _script(c)
    first, last = F.lit(None).cast("string"), F.lit(None).cast("string")
    more = lambda s: F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(7), attempt + 6), lambda k: _pick(SYLLABLES[s], _number(h, k))), "")).otherwise("")
    for s in SYLLABLES:
        last = F.when(script == s, F.concat(*[_pick(SYLLABLES[s], _number(h, F.lit(k))) for k in range(3, 7)], more(s))).otherwise(last)
        for g in ("he", "she", "any"):
            first = F.when((script == s) & (gender == g), F.concat(F.lower(_pick(FIRST[s, g], _number(h, F.lit(0)))), more(s))).otherwise(first)
    return (
        F.when(kind == "email", F.concat(longer, _letters(address, h), domain))
        .when(kind == "ip", F.concat_ws(".", *[(_number(h, F.lit(k)) % (223 if k == 0 else 254) + 1).cast("string") for k in range(4)]))
        .when(kind == "card", F.concat(body, check))
        .when(kind == "iban", account)
        .when(kind == "name", F.concat(gender, F.lit(":"), last))
        .when(kind == "first", F.concat(gender, F.lit(":"), first))
        .when((kind == "phone") & (F.length(c) > 10), F.concat(F.substring(c, F.lit(1), F.length(c) - 10), figures(F.substring(c, F.length(c) - 9, F.lit(10)))))
        .otherwise(figures(c))
    )


def _laid_out(e: Column, s: Column, kind: Column, given: Column) -> Column:
    """The surrogate's canonical form in the layout and case of the entity."""

    def place(keep: str) -> Column:
        # characters of s go, in order, where the entity has a character of its canonical form; what lies behind that stays
        def one(x: Column, i: Column) -> Column:
            nth = F.length(F.regexp_replace(F.substring(e, F.lit(1), i.cast("int") + 1), f"(?!{keep}).", "")).cast("int")
            return F.when(x.rlike(keep) & (nth <= F.length(s)), F.substring(s, nth, F.lit(1))).otherwise(x)

        return F.array_join(F.transform(F.split(e, ""), one), "")

    extra = F.length(s) - F.length(e)  # letters that further attempts put in front
    at = lambda i: F.substring(s, (i + 1 + extra).cast("int"), F.lit(1))
    cased = F.concat(F.substring(s, F.lit(1), extra), F.array_join(F.transform(F.split(e, ""), lambda x, i: F.when(x.rlike(r"^\p{Lu}$"), F.upper(at(i))).otherwise(at(i))), ""))
    own = lambda x: F.initcap(F.substring_index(x, ":", -1))
    return (
        F.when(kind == "email", cased)
        .when(kind.isin("phone", "card", "ssn"), place("[0-9]"))
        .when(kind == "iban", place("[A-Z0-9]"))
        .when(kind == "name", F.concat(F.regexp_extract(e, rf"({_TITLE})", 1), F.coalesce(F.concat(own(given), F.lit(" ")), F.lit("")), own(s)))
        .otherwise(s)
    )


#: Marks an entity; a text that has the character itself is searched twice instead.
_MARK = "\u0001"


def _cut_up(text: Column, pattern: Column) -> tuple[Column, Column]:
    """(what lies between the entities, the entities) of a text: there is one more of the former."""
    marked = F.split(F.regexp_replace(text, pattern, F.lit(f"{_MARK}$0{_MARK}")), _MARK)
    has = text.contains(_MARK)
    gaps = F.when(has, F.split(text, pattern, F.lit(-1))).otherwise(F.filter(marked, lambda x, i: i % 2 == 0))
    return gaps, F.when(has, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.filter(marked, lambda x, i: i % 2 == 1))


def _found(docs: DataFrame, own: str) -> DataFrame:
    """``docs`` with its text cut up: arrays ``gaps`` and ``each`` (e, kind, canon, given), named with ``own`` in front."""
    g, f, n, more, each = (f"{own}{x}" for x in ("gaps", "found", "names", "more", "each"))

    def cut_up(rows: DataFrame, pattern: Column, only: Column | None = None) -> DataFrame:
        new = _cut_up(F.col("text").cast("string"), pattern)
        gaps, found = new if only is None else (F.when(only, x).otherwise(F.col(c)) for x, c in zip(new, (g, f)))
        return rows.withColumns({g: gaps, f: found})

    rows = cut_up(docs, F.lit(PATTERN))
    titled = F.filter(f, lambda e: e.rlike(_TITLE))
    rows = rows.withColumn(n, F.transform(titled, lambda e: F.struct(_name(e).alias("name"), _gender(e).alias("gender"))))
    units = F.filter(F.transform(n, lambda x: F.regexp_extract(x["name"], _UNIT, 1)), lambda u: F.length(u) > 3)
    others = F.array_sort(F.array_distinct(F.concat(F.transform(n, lambda x: x["name"]), units)), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    listed = F.array_join(F.transform(others, lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), "|")
    rows = rows.withColumn(more, F.when(F.size(n) > 0, F.concat(F.lit(f"{PATTERN}|{_FREE}(?:"), listed, F.lit(f"){_END}"))))
    rows = cut_up(rows, F.coalesce(F.col(more), F.lit(PATTERN)), F.col(more).isNotNull())

    told = lambda e: F.get(F.filter(n, lambda x: (x["name"] == _name(e)) & (x["gender"] != "any")), F.lit(0))["gender"]
    gender = lambda e: F.when(_gender(e) != "any", _gender(e)).otherwise(F.coalesce(told(e), F.lit("any")))
    rows = rows.withColumn(each, F.transform(f, lambda e: F.struct(e.alias("e"), kind_of(e).alias("kind"))))
    rows = rows.withColumn(each, F.transform(each, lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), canonical(x["e"], x["kind"]).alias("canon"), given_of(x["e"], x["kind"], gender(x["e"])).alias("given"))))
    return rows.drop(f, n, more)


def _tokens(each: Column) -> Column:
    """(kind, canon) of entities and of given names."""
    pairs = F.concat(F.transform(each, lambda x: F.struct(x["kind"].alias("kind"), x["canon"].alias("canon"))), F.transform(F.filter(each, lambda x: x["given"].isNotNull()), lambda x: F.struct(F.lit("first").alias("kind"), x["given"].alias("canon"))))
    return F.array_distinct(F.filter(pairs, lambda x: x["kind"].isNotNull()))


def _collided(ents: DataFrame) -> DataFrame:
    """Entities whose surrogate an earlier entity has, or which is an entity itself."""
    order = Window.partitionBy("kind", "surrogate").orderBy("attempt", "canon")
    twice = ents.withColumn("_nth", F.row_number().over(order)).where("_nth > 1").select("kind", "canon")
    real = ents.select("kind", F.col("canon").alias("surrogate"))
    return twice.unionByName(ents.where(F.col("attempt") < UNLIKE).join(real, ["kind", "surrogate"], "left_semi").select("kind", "canon")).distinct()


def _drawn(tokens: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt, surrogate) of all distinct ``tokens`` (kind, canon), with distinct surrogates."""
    ents = tokens.distinct().withColumn("attempt", F.lit(0))
    stream = _stream(F.col("canon"), F.col("kind"), F.col("attempt"), key)
    made = lambda d: d.withColumn("_h", stream).withColumn("surrogate", replaced(F.col("canon"), F.col("kind"), F.col("_h"), F.col("attempt"))).drop("_h")
    ents = cut(made(ents))
    while True:
        again = cut(_collided(ents))
        if not again.limit(1).count():
            return ents
        again = again.withColumn("_again", F.lit(1))
        ents = ents.join(again, ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("_again", F.lit(0))).drop("_again", "surrogate")
        ents = cut(made(ents))


def entities(docs: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt, surrogate) of all distinct entities in ``docs`` (text), with distinct surrogates."""
    return _drawn(_found(docs.select("text"), "_").select(F.explode(_tokens(F.col("_each"))).alias("t")).select("t.*"), key)


def with_surrogates(docs: DataFrame, key: str = "k1") -> DataFrame:
    """``docs`` (text, ...) with entities in ``text`` replaced, and ``n_entities``, the number of replacements.

    All columns are kept, whatever their names; a column named n_entities is replaced. Rows count, not ids: null and
    repeated doc_ids make no difference. A null text stays null with no entities; an empty table gives no rows; repeated
    rows are treated alike. Numbers that are no valid card or account numbers, and all other text, stay. Texts are
    searched once and kept cut up in the shared folder until they are put together again.
    """
    docs = docs.drop("n_entities")
    own = free_prefix(docs.columns)
    g, f, row, drawn = (f"{own}{x}" for x in ("gaps", "each", "row", "drawn"))
    kept = [c for c in docs.columns if c != "text"]
    rows = written(_found(docs, own).select(*kept, g, f, F.monotonically_increasing_id().alias(row)), "cut-up")
    some = rows.where(F.size(f) > 0).select(row, F.explode(_tokens(F.col(f))).alias("t")).select(row, "t.*")
    redrawn = cut(_drawn(some.select("kind", "canon"), key).where("attempt > 0").select("kind", "canon", "attempt"))
    # of the entities that were drawn again: their attempts, by row
    told = some.join(smaller(redrawn), ["kind", "canon"]).select(F.col(row).alias(f"{own}of"), F.struct(F.concat("kind", F.lit(_MARK), "canon").alias("name"), "attempt").alias("x"))
    told = told.groupBy(f"{own}of").agg(F.map_from_entries(F.collect_list("x")).alias(drawn))  # at most the row's own entities
    if redrawn.limit(1).count():
        rows = rows.join(told, rows[row] == told[f"{own}of"], "left")
    else:
        rows = rows.withColumn(drawn, F.lit(None).cast("map<string,int>"))

    fields = ["e", "kind", "canon", "given"]

    # each step adds one field, so that no expression is repeated in the next
    def step(name: str, make) -> None:
        nonlocal rows, fields
        old = fields
        rows = rows.withColumn(f, F.transform(f, lambda x: F.struct(*[x[c].alias(c) for c in old], make(x).alias(name))))
        fields = [*old, name]

    again = lambda kind, canon: F.coalesce(F.col(drawn)[F.concat(kind, F.lit(_MARK), canon)], F.lit(0))
    step("attempt", lambda x: again(x["kind"], x["canon"]))
    step("h", lambda x: _stream(x["canon"], x["kind"], x["attempt"], key))
    step("s", lambda x: replaced(x["canon"], x["kind"], x["h"], x["attempt"]))
    step("first", lambda x: F.when(x["given"].isNotNull(), again(F.lit("first"), x["given"])))
    step("g", lambda x: F.when(x["given"].isNotNull(), replaced(x["given"], F.lit("first"), _stream(x["given"], F.lit("first"), x["first"], key), x["first"])))
    step("new", lambda x: F.when(x["kind"].isNull(), x["e"]).otherwise(_laid_out(x["e"], x["s"], x["kind"], x["g"])))
    found = F.size(f) > 0
    joined = F.array_join(F.zip_with(g, F.concat(F.col(f)["new"], F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    rows = rows.withColumn("n_entities", F.when(found, F.size(F.filter(f, lambda x: x["kind"].isNotNull()))).otherwise(0).cast("long"))
    text = F.when(found, joined).otherwise(F.get(g, F.lit(0)))
    return rows.select(*[text.alias("text") if c == "text" else c for c in docs.columns], "n_entities")
