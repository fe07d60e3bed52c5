"""PII surrogates: detected entities are replaced by keyed, type-consistent
stand-ins.  DataFrame operations only.

Detected types: e-mail, IPv4 address, IBAN, payment card number, social
security number, phone number, access key, assigned secret (``password=...``,
``TOKEN = "..."``, ``secret: ...``) and titled person names.  A mention belongs to an entity (type, canonical
form): e-mails without case, numbers without separators, a name word by role,
gender of its title and script; so all mentions of an entity share a surrogate
(coreference), rendered in the format of each mention.

Surrogates derive from SHA-256 of (key, type, canonical form, attempt).
Characters keep their class (digit, lower, upper), separators their place;
cards keep the first digit and a valid check digit, IBANs country and check
digits, phone numbers the country digit, addresses the width of their octets,
e-mails the top-level domain (equal domains stay equal), names gender, script
and capitals.

Collision checks: a surrogate may equal neither another entity's surrogate nor
any detected original of its type.  Of entities that claim one surrogate the
smallest keeps it, the others try the next attempt, until none is left; from
``WIDEN`` attempts on surrogates get one more character an attempt, so small
formats do not run out.

Only texts with a mention are shuffled, equal texts are resolved once, and
entities are pre-aggregated, so neither a hot text nor a hot entity gathers in
a task.

Defined results: a null text stays null and has no mentions; a text without
mentions stays as it is; repeated rows give equal rows; all other columns pass
through unchanged; an empty table gives an empty table.  A mention may follow
punctuation or text of a script without blanks, but starts inside no word or
number of its own kind; an e-mail's local part may hold letters of any script
(glued ones only if all are).  Whole texts are
searched, and a secret or vendor key is met up to its end, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .runtime import materialize, prepare

#: For tests and trials: surrogates under a published key can be recomputed.
KEY = "outcry"
KEY_SETTING = "spark.outcry.surrogates.key"
WIDEN = 6
ATTEMPTS = 64

_MALE = "Mr|Herr|Monsieur|Señor|Sr|Г-н"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа"
_LABEL = "password|passwd|pwd|secret|api_key|apikey|api-key|access_token|token"
#: Label, sign and opening quote of an assigned secret: ``pwd=``, ``TOKEN = "``, ``"secret": "``.
_ASSIGNED = rf"(?i:{_LABEL})[\"']?[ \t]*[=:][ \t]*[\"']?"
#: Scripts without blanks (or, as Hangul, with particles right at the word): text may be glued to a mention. As code
#: points, since looking up the script of every letter takes most of the time: Thai, Lao, Myanmar, Hangul, Khmer, Kana, Han.
_GLUED = (r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1100}-\x{11FF}\x{1780}-\x{17FF}\x{2E80}-\x{2FDF}\x{3005}-\x{3007}"
          r"\x{3040}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A960}-\x{A97F}\x{AC00}-\x{D7FF}\x{F900}-\x{FAFF}"
          r"\x{FF66}-\x{FFDC}\x{20000}-\x{3FFFF}")
#: Characters of the local part of an e-mail.
_LOCAL = rf"[A-Za-z0-9[\p{{L}}\p{{M}}\p{{N}}&&[\x{{0}}-\x{{DFF}}[^{_GLUED}]]]._%+\-]"
#: Type -> pattern, in the order in which they are tried at a position.
PATTERNS = {
    "email": rf"(?:{_LOCAL}++|(?![\x{{0}}-\x{{DFF}}])[{_GLUED}]++)@(?:[\p{{L}}\p{{M}}\p{{N}}-]+\.)+[A-Za-z]{{2,24}}(?![A-Za-z0-9-])",
    "ip": r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![.]?\d)",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"[3-6]\d{3}(?:(?:[ -]\d{4}){3}|[ -]\d{6}[ -]\d{5}|\d{9,15})(?![\d-])",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\d-])",
    "access": r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "vendor": r"(?:sk|pk|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,}+",
    "secret": rf"{_ASSIGNED}[^\s\"',;]{{4,}}+",
    "name": rf"(?:{_MALE}|{_FEMALE})\.? \p{{Lu}}[\p{{L}}]+(?: \p{{Lu}}[\p{{L}}]+)?(?!\p{{L}})",
}
def _start(kind: str) -> str:
    """What may not be before a mention, besides a word under way: a number of its kind or own characters."""
    return {"ip": r"(?<!\p{N}\.)", "card": r"(?<!\p{N}[.-])", "ssn": r"(?<!\p{N}[.-])", "phone": r"(?<!\p{N}[.-])",
            "vendor": r"(?<![_-])"}.get(kind, "")


#: A mention starts where its type may: an e-mail behind none of its own characters, the others where no word is under
#: way (tested once for all), a phone number with a plus sign or bracket also right behind a word, which that ends.
#: The first group passes over the inside of ASCII words at little cost.
PATTERN = (r"(?:(?<![A-Za-z0-9])|(?=[+(\x{80}-\x{10FFFF}]))"
           rf"(?:(?:(?=[\x{{0}}-\x{{DFF}}])(?<!{_LOCAL})|(?![\x{{0}}-\x{{DFF}}])(?:(?<!{_LOCAL})(?={_LOCAL})|(?<![{_GLUED}])(?=[{_GLUED}])))"
           rf"{PATTERNS['email']}"
           rf"|(?<![A-Za-z0-9[\p{{L}}\p{{N}}&&[\x{{0}}-\x{{DFF}}[^{_GLUED}]]]])(?:" + "|".join(_start(k) + p for k, p in PATTERNS.items() if k != "email")
           + rf")|(?=[+(])(?<!\p{{N}})(?<!\p{{N}}[.-]){PATTERNS['phone']})")

_SYLLABLES = {
    "latin": "ba be bo ca da de do el fa ga ha jo ka la le li lo ma me mi na ne no pa ra re ri ro sa se ta te ti to va vi".split(),
    "cyrillic": "ба бе ва га да до ка ла ле ли ло ма ме ми на не но па ра ре ри ро са се та те ти то".split(),
    "greek": "βα γα δα κα λα λε λι λο μα με μι να νε νο πα ρα ρε ρι ρο σα τα τε τι το".split(),
}
_ENDINGS = {("latin", "m"): "n", ("latin", "f"): "a", ("latin", "l"): "r", ("cyrillic", "m"): "н", ("cyrillic", "f"): "я",
            ("cyrillic", "l"): "в", ("greek", "m"): "ς", ("greek", "f"): "α", ("greek", "l"): "ου"}


def _pick(alphabet: str, seed: Column, i) -> Column:
    return F.substr(F.lit(alphabet), (F.pmod(F.xxhash64(seed, i), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))


def _mapped(text: Column, seed: Column) -> Column:
    """Every ASCII letter and digit replaced by one of its class; any other
    letter by a Latin one of its case."""
    def one(c, i):
        return (F.when(c.rlike(r"^[0-9]"), _pick("0123456789", seed, i))
                .when(c.rlike(r"^\p{Lu}"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", seed, i))
                .when(c.rlike(r"^\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", seed, i)).otherwise(c))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn rule, the last digit counted once."""
    return F.aggregate(
        F.transform(F.reverse(F.split(digits, "")),
                    lambda c, i: F.when(i % 2 == 0, c.cast("int"))
                    .otherwise(F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int")))),
        F.lit(0), lambda a, x: a + x)


def _iban_check(country: Column, rest: Column) -> Column:
    """Check digits of country and basic account number (mod 97)."""
    ordered = F.split(F.concat(rest, country, F.lit("00")), "")
    mod = F.aggregate(ordered, F.lit(0), lambda a, c: F.when(c.rlike("^[0-9]"), (a * 10 + c.cast("int")) % 97)
                      .otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return F.lpad((F.lit(98) - mod).cast("string"), 2, "0")


def _name(canon: Column, seed: Column, extra: Column) -> Column:
    """canon: role, script and word, joined by '|'."""
    role, script = F.substring_index(canon, "|", 1), F.substring_index(F.substring_index(canon, "|", 2), "|", -1)

    def word(script_name: str, ending: str) -> Column:
        some = _SYLLABLES[script_name]
        syllables = F.array(*[F.lit(x) for x in some])
        return F.concat(F.array_join(F.transform(
            F.sequence(F.lit(1), F.lit(3) + extra),
            lambda i: F.get(syllables, F.pmod(F.xxhash64(seed, i), F.lit(len(some))).cast("int"))), ""), F.lit(ending))

    out = F.when(F.lit(False), F.lit(""))
    for (s, r), ending in _ENDINGS.items():
        out = out.when((role == r) & (script == s), word(s, ending))
    return out


def _octet(part: Column, seed: Column, i: int, wide: Column) -> Column:
    h = F.xxhash64(seed, F.lit(i))
    low = F.when(wide, 0).when(F.length(part) == 1, 1).when(F.length(part) == 2, 10).otherwise(100)
    high = F.when(wide, 255).when(F.length(part) == 1, 9).when(F.length(part) == 2, 99).otherwise(255)
    return (low + F.pmod(h, (high - low + 1).cast("long"))).cast("string")


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    seed = F.sha2(F.concat_ws("\x00", F.lit(key), kind, canon, attempt.cast("string")), 256)
    extra = F.greatest(attempt - WIDEN + 1, F.lit(0))
    more = F.when(extra > 0, _mapped(F.repeat(F.lit("0"), extra), F.concat(seed, F.lit("+")))).otherwise("")
    domain = F.substring_index(canon, "@", -1)
    tld = F.substring_index(domain, ".", -1)
    host = F.substr(domain, F.lit(1), F.length(domain) - F.length(tld) - 1)
    host_seed = F.sha2(F.concat_ws("\x00", F.lit(key), F.lit("domain"), domain), 256)
    email = F.concat(_mapped(F.substring_index(canon, "@", 1), seed), more, F.lit("@"), _mapped(host, host_seed), F.lit("."), tld)
    head = F.when(F.startswith(canon, F.lit("+")), 2).otherwise(0)
    phone = F.concat(F.substr(canon, F.lit(1), head), _mapped(F.substr(canon, head + 1), seed), more)
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)),
                    _mapped(F.substr(canon, F.lit(2), F.length(canon) - 2), seed), more)
    check = F.pmod(F.lit(10) - _luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
    valid = _luhn_sum(canon) % 10 == 0
    card = F.concat(body, F.when(valid, check).otherwise(_pick("0123456789", seed, F.lit(-1))))
    rest = F.concat(_mapped(F.substr(canon, F.lit(5)), seed), more)
    country = F.substr(canon, F.lit(1), F.lit(2))
    iban = F.concat(country, _iban_check(country, rest), rest)
    parts = F.split(canon, r"\.")
    ip = F.concat_ws(".", *[_octet(F.get(parts, F.lit(i)), seed, i, extra > 0) for i in range(4)])
    prefix = F.regexp_extract(canon, r"^(?:AKIA|ASIA|(?:sk|pk|ghp|gho|xoxb|xoxp)[-_])", 0)
    keyed = F.concat(prefix, _mapped(F.substr(canon, F.length(prefix) + 1), seed), more)
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "iban", iban).when(kind == "card", card)
            .when(kind == "phone", phone).when(kind == "name", _name(canon, seed, extra))
            .when(kind.isin("access", "vendor"), keyed).otherwise(F.concat(_mapped(canon, seed), more)))


def _kind(mention: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        test = mention.rlike(rf"\A(?:{pattern})\z")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def _canonical(kind: Column, mention: Column) -> Column:
    """array<string>: the canonical forms of a mention (two for a full name)."""
    words = F.split(F.regexp_replace(mention, rf"^(?:{_MALE}|{_FEMALE})\.? ", ""), " ")
    gender = F.when(mention.rlike(rf"^(?:{_FEMALE})\.? "), "f").otherwise("m")
    script = lambda w: F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").when(w.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    names = F.transform(words, lambda w, i: F.concat_ws("|", F.when((F.size(words) == 2) & (i == 0), gender).otherwise("l"),
                                                        script(w), F.lower(w)))
    plain = (F.when(kind == "email", F.lower(mention)).when(kind.isin("card", "ssn"), _digits(mention))
             .when(kind == "phone", F.regexp_replace(mention, "[^0-9+]", "")).when(kind == "iban", F.regexp_replace(mention, " ", ""))
             .when(kind == "secret", F.regexp_replace(mention, rf"^{_ASSIGNED}", "")).otherwise(mention))
    return F.when(kind == "name", names).otherwise(F.array(plain))


def _fill(mention: Column, value: Column, slot: str) -> Column:
    """``value`` written into the characters of ``mention`` that match ``slot``."""
    chars = F.split(value, "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    return F.aggregate(
        F.split(mention, ""), start,
        lambda a, c: F.when(c.rlike(slot), F.struct(F.concat(a["out"], F.coalesce(F.get(chars, a["k"]), F.lit(""))).alias("out"),
                                                    (a["k"] + 1).alias("k")))
        .otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))),
        lambda a: F.concat(a["out"], F.coalesce(F.array_join(F.slice(chars, a["k"] + 1, F.size(chars)), ""), F.lit(""))))


def _rendered(kind: Column, mention: Column, values: Column) -> Column:
    one = F.get(values, F.lit(0))
    cased = F.array_join(F.zip_with(F.split(one, ""), F.split(mention, ""),
                                    lambda s, c: F.when(c.rlike(r"^\p{Lu}") & s.isNotNull(), F.upper(s)).otherwise(F.coalesce(s, F.lit("")))), "")
    title = F.regexp_extract(mention, rf"^(?:{_MALE}|{_FEMALE})\.? ", 0)
    caps = mention.rlike(r" \p{Lu}{2,}( \p{Lu}{2,})?$")
    name = F.concat(title, F.array_join(F.transform(values, lambda v: F.when(caps, F.upper(v)).otherwise(F.initcap(v))), " "))
    return (F.when(kind == "email", cased).when(kind.isin("phone", "card", "ssn"), _fill(mention, _digits(one), "^[0-9]"))
            .when(kind == "iban", _fill(mention, one, "^[A-Z0-9]"))
            .when(kind == "secret", F.concat(F.regexp_extract(mention, rf"^{_ASSIGNED}", 0), one))
            .when(kind == "name", name).otherwise(one))


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, value): a surrogate for each distinct (kind, canon), with
    values distinct within a kind and different from every canon of it."""
    entities = materialize(entities.select("kind", "canon").distinct(), "entities")
    # A name's surrogate is a bare word: the word of its canonical form is taken.
    taken = entities.select("kind", F.when(F.col("kind") == "name", F.substring_index("canon", "|", -1))
                            .otherwise(F.col("canon")).alias("value")).distinct()
    left, done = entities, None
    for attempt in range(ATTEMPTS):
        tried = left.withColumn("value", surrogate(F.col("kind"), F.col("canon"), F.lit(attempt), key))
        free = tried.join(taken, ["kind", "value"], "left_anti")
        if done is not None:
            free = free.join(done, ["kind", "value"], "left_anti")
        own = materialize(free.groupBy("kind", "value").agg(F.min("canon").alias("canon"))
                          .select("kind", "canon", "value"), "surrogates")
        done = own if done is None else done.unionByName(own)
        left = materialize(left.join(own, ["kind", "canon"], "left_anti"), "entities")
        if left.isEmpty():
            return done
    raise ValueError(f"no free surrogate after {ATTEMPTS} attempts")


def replace(docs: DataFrame, text: str = "text", key: str | None = None,
            count: str | None = "n_entities") -> tuple[DataFrame, DataFrame]:
    """``key`` decides the surrogates; by default it is the session's setting
    ``spark.outcry.surrogates.key``, which should be kept secret, or else ``KEY``.
    Returns (documents with surrogates in ``text`` and, if named, the added column
    ``count``, mentions (text_key, pos, kind, mention, replacement))."""
    prepare(docs.sparkSession)
    key = docs.sparkSession.conf.get(KEY_SETTING, KEY) if key is None else key
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PATTERN), F.lit(0))
    # Written once with what was found: the search is most of the work.
    base = materialize(docs.withColumn("found__", found), "searched")
    hits = base.filter(F.size("found__") > 0).withColumn("text_key__", F.md5(text))
    clean = base.filter(F.size("found__") == 0).withColumn("n__", F.lit(0))

    per_text = hits.groupBy("text_key__").agg(F.first("found__").alias("found__"))
    kind = _kind(F.col("mention"))
    mentions = (per_text.select("text_key__", F.posexplode("found__").alias("pos", "mention"))
                .withColumn("kind", kind))
    parts = materialize(mentions.select("text_key__", "pos", "mention", "kind",
                                        F.posexplode(_canonical(F.col("kind"), F.col("mention"))).alias("sub", "canon")), "mentions")
    given = assign(parts, key)
    rendered = (parts.join(given, ["kind", "canon"])
                .groupBy("text_key__", "pos", "kind", "mention")
                .agg(F.transform(F.array_sort(F.collect_list(F.struct("sub", "value"))), lambda x: x["value"]).alias("values"))
                .withColumn("replacement", _rendered(F.col("kind"), F.col("mention"), F.col("values"))).drop("values"))
    rendered = materialize(rendered, "rendered")
    lists = rendered.groupBy("text_key__").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "replacement"))), lambda x: x["replacement"]).alias("with__"))
    gaps = F.split(F.col(text), PATTERN, -1)
    joined = F.array_join(F.zip_with(gaps, F.col("with__"), lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), "")
    changed = (hits.join(lists, "text_key__").withColumn(text, joined)
               .withColumn("n__", F.size("with__")))
    columns = [F.col(f"`{c}`") for c in docs.columns] + ([F.col("n__").alias(count)] if count else [])
    out = changed.select(*columns).union(clean.select(*columns))
    return out, rendered.withColumnRenamed("text_key__", "text_key")
