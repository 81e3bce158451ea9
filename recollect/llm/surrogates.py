"""Replacement of personal data by keyed, type-consistent surrogates.

Detected are e-mail addresses (local parts in any script), telephone numbers, card numbers,
social security numbers, IBANs with right check digits, IPv4 and IPv6 addresses, long
hexadecimal secrets, access keys with a known prefix, street addresses (English, German,
French), names behind a title, and every further capitalised mention of such a name in the
same document.  Not detected: names that a document never gives a title, other shapes.
Everything is built from DataFrame expressions; texts are searched once, and once more
where something was found.

A surrogate depends on a secret key and the entity's normal form only, so one entity has
one surrogate in the whole corpus (coreference), whatever its spelling: e-mail case,
separators in numbers, case of names, "Mr. Smith" against "Mr. John Smith" (given and
family names are entities of their own).  A given name's gender is what the titles in its
document say of it or of its family name; with no or opposed evidence it is neutral.  A
surrogate keeps the type and looks: script, case and length class of letters, digits for
digits, separators where they stood, country codes, prefixes, top-level domains, valid
octets, and whether check digits are right.

Distinctness is checked, not hoped for: candidates are grouped per type over the corpus;
where two entities share a candidate, or a candidate is a real entity of the corpus, all
but one draw again until none collide.  From the third draw on free parts grow, from the
tenth on numbers grow by a digit a draw, so a crowded format runs out of no room.

Nulls stay null, texts without entities stay as they are, repeated rows are answered
alike, an empty table gives an empty result; columns named in `keep` are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import materialize, release

MOST_DRAWS = 40

# Patterns and titles of the detected types.
# A run is entered at its start only and never given back, so very long words cost linear time.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])"
IPV4 = r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9A-Za-z.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])"
MALE = ["Mr", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Sr", "Don", "г-н", "господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "г-жа", "госпожа"]
NEUTRAL = ["Mx", "Dr", "Prof"]
TITLE = r"(?:" + "|".join(sorted([*MALE, *FEMALE, *NEUTRAL], key=lambda t: (-len(t), t))) + r")\.? "
WORD = r"\p{Lu}[\p{L}'’-]+"
NAME = r"(?<![\p{L}])" + TITLE + f"(?:{WORD} )?{WORD}"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
IPV6 = r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"
TOKEN = r"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,}+)(?![0-9A-Za-z])"
STREET_ENDS = "Street|Avenue|Road|Lane|Boulevard|Drive|Court|Square|Terrace"
STREET = r"(?<![0-9A-Za-z])[0-9]{1,5} (?:\p{Lu}[\p{L}'’-]+ ){1,3}(?:" + STREET_ENDS + r")(?![\p{L}])|(?<![\p{L}])\p{Lu}\p{L}+(?:straße|strasse|gasse|platz) [0-9]{1,4}(?![0-9\p{L}])|(?<![0-9A-Za-z])[0-9]{1,4},? (?:rue|avenue|boulevard) (?:de |du |des |de la )?\p{Lu}[\p{L}'’-]+"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, TOKEN, SECRET, IBAN, IPV4, IPV6, SSN, PHONE, CARD, STREET, NAME))

# Alphabets that letters are replaced within.
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "àâäáçèéêëíîïñóôöúùûü", "ÀÂÄÁÇÈÉÊËÍÎÏÑÓÔÖÚÙÛÜ"]
HEX = ["0123456789abcdef", "0123456789ABCDEF"]
LATIN = (["b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v"], ["a", "e", "i", "o", "u"], {"m": ["o", "us", "er"], "f": ["a", "ia", "ine"], "n": ["en", "is", "el"], "x": ["son", "ler", "mann"]})
GREEK = (["β", "γ", "δ", "κ", "λ", "μ", "ν", "π", "ρ", "σ", "τ", "φ"], ["α", "ε", "ι", "ο", "υ"], {"m": ["ος", "ης", "ας"], "f": ["α", "η", "ω"], "n": ["ις", "υς", "αρ"], "x": ["ίδης", "άκης", "όπουλος"]})
CYRILLIC = (["б", "в", "г", "д", "к", "л", "м", "н", "п", "р", "с", "т"], ["а", "е", "и", "о", "у"], {"m": ["ий", "ан", "ор"], "f": ["а", "ия", "ина"], "n": ["ен", "ис", "ель"], "x": ["ов", "ин", "ский"]})


def _draw(seed: Column, what, upto: int | Column) -> Column:
    return F.pmod(F.xxhash64(seed, F.lit(what) if not isinstance(what, Column) else what), F.lit(upto) if isinstance(upto, int) else upto)


def _pick(seed: Column, what, values: list[str] | str) -> Column:
    if isinstance(values, str):
        return F.substring(F.lit(values), _draw(seed, what, len(values)).cast("int") + 1, F.lit(1))
    return F.get(F.array(*[F.lit(v) for v in values]), _draw(seed, what, len(values)).cast("int"))


def _reshape(value: Column, seed: Column, alphabets: list[str]) -> Column:
    """Each character replaced within its alphabet; others stay."""

    def one(ch, i):
        out = ch
        for a in alphabets:
            out = F.when(F.instr(F.lit(a), ch) > 0, _pick(seed, i, a)).otherwise(out)
        return out

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda ch: ch != ""), one), "")


def _luhn(body: Column) -> Column:
    """The check digit that follows these digits."""
    digits = F.reverse(F.filter(F.split(body, ""), lambda ch: ch != ""))
    doubled = F.transform(digits, lambda ch, i: F.when(i % 2 == 0, ch.cast("int") * 2 - F.when(ch.cast("int") > 4, 9).otherwise(0)).otherwise(ch.cast("int")))
    return F.pmod(10 - F.pmod(F.aggregate(doubled, F.lit(0), lambda a, x: a + x), F.lit(10)), F.lit(10))


def _name(value: Column, seed: Column, gender: str, draw: Column) -> Column:
    """A name, capitalised, in the value's script."""

    def build(script):
        consonants, vowels, endings = script
        syllable = lambda k: F.concat(_pick(seed, f"c{k}", consonants), _pick(seed, f"v{k}", vowels))
        more = F.when(draw > 0, syllable(3)).otherwise("")
        more = F.concat(more, F.when(draw > 2, syllable(4)).otherwise(""), F.when(draw > 4, syllable(5)).otherwise(""))
        return F.initcap(F.concat(syllable(1), syllable(2), more, _pick(seed, "l", consonants), _pick(seed, "e", endings[gender])))

    return F.when(value.rlike(r"\p{IsCyrillic}"), build(CYRILLIC)).when(value.rlike(r"\p{IsGreek}"), build(GREEK)).otherwise(build(LATIN))


def _mod97(body: Column) -> Column:
    """The remainder of an IBAN's account part followed by its country and check digits."""
    chars = F.filter(F.split(body, ""), lambda ch: ch != "")
    return F.aggregate(chars, F.lit(0), lambda r, ch: F.pmod(r * F.when(ch.between("0", "9"), 10).otherwise(100) + F.when(ch.between("A", "Z"), F.ascii(ch) - 55).otherwise(F.ascii(ch) - 48), F.lit(97)))


def valid_iban(value: Column) -> Column:
    return _mod97(F.concat(F.substring(value, F.lit(5), F.length(value)), F.left(value, F.lit(4)))) == 1


def surrogate(kind: Column, value: Column, key: str, draw: Column) -> Column:
    """The candidate surrogate of an entity's normal form for one draw."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, draw.cast("string")), 256)
    extra = F.when(draw > 2, F.concat(*[_pick(seed, f"x{k}", ALPHABETS[0]) for k in range(3)])).otherwise("")
    wide = F.when(draw > 9, F.substring(F.regexp_replace(F.sha2(F.concat(seed, F.lit("w")), 512), "[^0-9]", ""), F.lit(1), draw - 9)).otherwise("")
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    host = F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1)
    top = F.regexp_extract(domain, r"\.([^.]+)$", 1)
    email = F.concat(_reshape(local, seed, ALPHABETS), extra, F.lit("@"), _reshape(host, F.concat(seed, F.lit("h")), ALPHABETS), F.lit("."), top)
    body = F.concat(_reshape(F.substring(value, F.lit(1), F.length(value) - 1), seed, ALPHABETS), wide)
    valid = _luhn(F.substring(value, F.lit(1), F.length(value) - 1)) == F.right(value, F.lit(1)).cast("int")
    card = F.concat(body, F.pmod(_luhn(body) + F.when(valid, 0).otherwise(1 + _draw(seed, "w", 9).cast("int")), F.lit(10)).cast("string"))
    code = F.regexp_extract(value, r"^(\+[0-9]*:)", 1)  # the country code stays
    phone = F.concat(code, _reshape(F.substring(value, F.length(code) + 1, F.length(value)), seed, ALPHABETS), wide)
    address = F.concat_ws(".", *[(_draw(seed, f"o{k}", 254) + 1).cast("string") for k in range(4)])
    hexed = F.when(value.rlike("[A-F]"), _reshape(value, seed, [HEX[1]])).otherwise(_reshape(value, seed, [HEX[0]]))
    number = lambda what, low, many: F.lpad((_draw(seed, what, many) + low).cast("string"), len(str(many)), "0")
    social = F.concat(number("a", 100, 566), number("g", 1, 99), F.lpad((_draw(seed, "s", 9999) + 1).cast("string"), 4, "0"), wide)
    account = F.concat(_reshape(F.substring(value, F.lit(5), F.length(value)), seed, ALPHABETS), wide)
    country = F.left(value, F.lit(2))
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    prefix = F.regexp_extract(value, r"^(AKIA|ASIA|gh[pousr]_)", 1)
    token = F.concat(prefix, _reshape(F.substring(value, F.length(prefix) + 1, F.length(value)), seed, ALPHABETS))
    kept = r"^(?:[0-9]+,?|" + STREET_ENDS + r"|rue|avenue|boulevard|de|du|des|la)$"
    ending = lambda w: F.regexp_extract(w, r"(straße|strasse|gasse|platz)$", 1)
    reword = lambda w, k: F.when(w.rlike(r"^[0-9]"), _reshape(w, F.concat(seed, k.cast("string")), ALPHABETS)).when(w.rlike(kept), w).otherwise(F.concat(_reshape(F.left(w, F.length(w) - F.length(ending(w))), F.concat(seed, k.cast("string")), ALPHABETS), ending(w)))
    street = F.concat(F.array_join(F.transform(F.split(value, " "), reword), " "), wide)
    out = F.when(kind == "email", email).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ip", address).when(kind.isin("secret", "ip6"), hexed)
    out = out.when(kind == "ssn", social).when(kind == "iban", iban).when(kind == "token", token).when(kind == "street", street)
    return out.when(kind == "given_m", _name(value, seed, "m", draw)).when(kind == "given_f", _name(value, seed, "f", draw)).when(kind == "given_n", _name(value, seed, "n", draw)).otherwise(_name(value, seed, "x", draw))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _entity(raw: Column) -> Column:
    """(kind, normal form) of a match that is no name; null for names and for what only looks like an IBAN."""
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    country = F.regexp_extract(raw, r"^(\+[0-9]{1,3})[ .(-]", 1)
    phone = F.concat(F.when(country != "", F.concat(country, F.lit(":"))).otherwise(""), _digits(F.substring(raw, F.length(country) + 1, F.length(raw))))
    plain = F.replace(raw, F.lit(" "), F.lit(""))
    return (
        F.when(raw.contains("@"), one("email", F.lower(raw)))
        .when(raw.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), one("ip", raw))
        .when(raw.rlike(r"^[0-9]{13,19}$|^(?:[0-9]{4}[ -]){3}[0-9]{4}$"), one("card", _digits(raw)))
        .when(raw.rlike(r"^[0-9A-Fa-f]{32,}$"), one("secret", raw))
        .when(raw.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), one("ssn", _digits(raw)))
        .when(raw.rlike(r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_"), one("token", raw))
        .when(raw.contains(":") & raw.rlike(r"^[0-9A-Fa-f:]+$"), one("ip6", F.lower(raw)))
        .when(raw.rlike("^" + IBAN[IBAN.index("[A-Z]") : IBAN.rindex("(?!")] + "$"), F.when(valid_iban(plain), one("iban", plain)))
        .when(raw.rlike(r"^[0-9]{1,5},? [\p{L}]|(?:straße|strasse|gasse|platz) [0-9]+$"), one("street", raw))
        .when(raw.rlike(r"^[+(0-9]"), one("phone", phone))
    )


def _fill(raw: Column, signs: Column, pattern: str = "[0-9]") -> Column:
    """Signs of `raw` that match replaced in turn by `signs`; what is left of those follows."""
    done = F.aggregate(
        F.filter(F.split(raw, ""), lambda ch: ch != ""),
        F.struct(F.lit("").alias("s"), F.lit(0).alias("k")),
        lambda a, ch: F.when(ch.rlike(pattern), F.struct(F.concat(a["s"], F.substring(signs, a["k"] + 1, F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], ch).alias("s"), a["k"].alias("k"))),
    )
    return F.concat(done["s"], F.substring(signs, done["k"] + 1, F.length(signs)))


def _written(raw: Column, kind: Column, made: Column) -> Column:
    """The replacement of a match that is no name."""
    return (
        F.when(kind == "email", F.when(F.upper(raw) == raw, F.upper(made)).otherwise(made))
        .when(kind.isin("card", "ssn"), _fill(raw, made))
        .when(kind == "phone", _fill(raw, F.regexp_replace(made, "[^0-9]", "")))
        .when(kind == "iban", _fill(raw, made, "[0-9A-Z]"))
        .when(kind == "ip6", F.when(raw.rlike("[A-F]"), F.upper(made)).otherwise(made))
        .otherwise(made)
    )


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, made): a surrogate for each distinct (kind, value), no two of a type alike and none a value of the corpus."""
    group = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind")).alias("group")
    like = F.when(F.col("kind").startswith("given") | (F.col("kind") == "family"), F.lower("made")).otherwise(F.col("made")).alias("like")
    real = materialize(entities.select("kind", "value").distinct())
    taken = real.select(group, F.col("value").alias("like"), F.lit(True).alias("is_real")).distinct()
    made = surrogate(F.col("kind"), F.col("value"), key, F.lit(0)).alias("made")
    drawn = materialize(real.select("kind", "value", F.lit(0).alias("draw"), made, F.lit(False).alias("settled")))
    used = [real]
    for _ in range(MOST_DRAWS):
        rank = F.concat(F.when(F.col("settled"), "0").otherwise("1"), "kind", F.lit(":"), "value")
        rows = drawn.select("*", group, like)
        first = rows.groupBy("group", "like").agg(F.min(rank).alias("winner"))
        checked = rows.join(first, ["group", "like"]).join(taken, ["group", "like"], "left")
        good = F.col("settled") | ((F.col("winner") == rank) & F.col("is_real").isNull())
        checked = materialize(checked.select("kind", "value", "draw", "made", good.alias("settled")))
        used.append(drawn)
        if checked.filter("not settled").isEmpty():
            release(*used)
            return checked.select("kind", "value", "made")
        again = F.col("draw") + F.when(F.col("settled"), 0).otherwise(1)
        made = F.when(F.col("settled"), F.col("made")).otherwise(surrogate(F.col("kind"), F.col("value"), key, again))
        used.append(checked)
        drawn = materialize(checked.select("kind", "value", again.alias("draw"), made.alias("made"), "settled"))
    raise ValueError(f"some entities still collide after {MOST_DRAWS} draws")


def _names(found: DataFrame) -> DataFrame:
    """(_row, value, kind, forms): the name entities of each row, from its titled mentions (_row, raw)."""
    title = lambda names: F.col("raw").rlike(r"^(?:" + "|".join(names) + r")\.? ").cast("int")
    words = F.split(F.regexp_replace("raw", "^" + TITLE, ""), " ")
    titled = found.select("_row", title(MALE).alias("m"), title(FEMALE).alias("f"), F.element_at(words, -1).alias("family"), F.when(F.size(words) > 1, F.get(words, 0)).alias("given"))
    titled = materialize(titled.withColumns({"family_": F.lower("family"), "given_": F.lower("given")}))
    known = titled.groupBy("_row", "family_").agg(F.max("m").alias("fm"), F.max("f").alias("ff"))
    own = titled.filter("given is not null").join(known, ["_row", "family_"]).groupBy("_row", F.col("given_").alias("value"))
    own = own.agg(F.max("m").alias("m"), F.max("f").alias("f"), F.max("fm").alias("fm"), F.max("ff").alias("ff"), F.collect_set("given").alias("forms"))
    m = F.when((F.col("m") + F.col("f")) > 0, F.col("m")).otherwise(F.col("fm"))
    f = F.when((F.col("m") + F.col("f")) > 0, F.col("f")).otherwise(F.col("ff"))
    given = own.select("_row", "value", F.when((m == 1) & (f == 0), "given_m").when((f == 1) & (m == 0), "given_f").otherwise("given_n").alias("kind"), "forms")
    family = titled.groupBy("_row", F.col("family_").alias("value")).agg(F.collect_set("family").alias("forms"))
    family = family.join(given.select("_row", "value"), ["_row", "value"], "left_anti")  # a given name stays one where it stands alone
    return materialize(given.unionByName(family.select("_row", "value", F.lit("family").alias("kind"), "forms")))


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, text with surrogates, n_entities, `keep` columns), one row for each input row."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    found = F.coalesce(F.regexp_extract_all("_text", F.lit(ANY), 0), F.array().cast("array<string>"))
    # The only search of all texts: what it finds is written beside them.
    scanned = materialize(base.select("*", found.alias("_found"), F.monotonically_increasing_id().alias("_row")))
    raws = scanned.filter(F.size("_found") > 0).select("_row", F.explode(F.array_distinct("_found")).alias("raw"))
    raws = materialize(raws.withColumn("is_name", F.col("raw").rlike("^" + TITLE)).withColumn("entity", F.when(~F.col("is_name"), _entity(F.col("raw")))))
    names = _names(raws.filter("is_name").select("_row", "raw"))
    others = raws.filter("entity is not null").select("_row", "raw", "entity.kind", "entity.value")
    made = materialize(assign(others.select("kind", "value").union(names.select("kind", "value")), key))
    written = others.join(made, ["kind", "value"]).select("_row", "raw", _written(F.col("raw"), F.col("kind"), F.col("made")).alias("new"))
    written = written.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("raw", "new"))).alias("_map"))
    quoted = lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))
    called = names.join(made, ["kind", "value"]).groupBy("_row").agg(
        F.map_from_entries(F.collect_list(F.struct("value", "made"))).alias("_names"),
        F.array_distinct(F.flatten(F.collect_list(F.array_union("forms", F.array(F.initcap("value"), F.upper("value")))))).alias("_forms"),
    )
    mention = F.concat(F.lit(ANY + r"|(?<![\p{L}])(?:"), F.array_join(F.transform("_forms", quoted), "|"), F.lit(r")(?![\p{L}])"))
    touched = scanned.filter(F.size("_found") > 0).join(written, "_row", "left").join(called, "_row", "left")

    def adapted(word):
        new = F.element_at("_names", F.lower(word))
        return F.when(new.isNull(), word).when((F.upper(word) == word) & (F.length(word) > 1), F.upper(new)).otherwise(new)

    def replaced(m):
        title = F.regexp_extract(m, "^" + TITLE, 0)
        rest = F.substring(m, F.length(title) + 1, F.length(m))
        name = F.concat(title, F.array_join(F.transform(F.split(rest, " "), adapted), " "))
        return F.coalesce(F.element_at("_map", m), F.when(F.col("_names").isNotNull(), name), m)

    def rebuilt(rows, pattern, matches):
        rows = rows.withColumn("_matches", matches).withColumn("_between", F.split("_text", pattern, -1))
        text = F.array_join(F.zip_with("_between", F.transform("_matches", replaced), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return rows.select("_id", text.alias("_new"), F.size("_matches").cast("long").alias("n_entities"), *[f"_keep_{c}" for c in keep])

    with_names = rebuilt(touched.filter("_names is not null").withColumn("_pattern", mention), F.col("_pattern"), F.regexp_extract_all("_text", F.col("_pattern"), F.lit(0)))
    without = rebuilt(touched.filter("_names is null"), F.lit(ANY), F.col("_found"))
    plain = scanned.filter(F.size("_found") == 0).select("_id", F.col("_text").alias("_new"), F.lit(0).cast("long").alias("n_entities"), *[f"_keep_{c}" for c in keep])
    return with_names.unionByName(without).unionByName(plain).select(F.col("_id").alias(id_col), F.col("_new").alias(text_col), "n_entities", *[F.col(f"_keep_{c}").alias(c) for c in keep])
