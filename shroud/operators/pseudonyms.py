"""Pseudonymization (PSE-01..15) as keyed-hash Column expressions.

Every random draw of the reference becomes ``md5(salt|type|norm|slot)`` cut to an integer, so
a value gets the same replacement in every document and on every executor, with no shared
RNG state. The mapping table holds one row per distinct (type, normalized value) -- built
with a partial aggregate (map-side combine), so a value repeated in a third of the corpus
is one row after the first stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.spans import is_private_ipv4, ordinal
from ..functions.steps import on_rows
from ..session import ensure_checkpoint_dir

DEFAULT_SALT = "shroud"


def normalize(value: Column) -> Column:
    """PSE-01: ``lower(strip(value))``."""
    return F.lower(F.regexp_replace(value, r"^\s+|\s+$", ""))


N_SLOTS = 8  # slots hashed once per mapping row; further ones on demand


class HashKey:
    """Pre-computed draws of one mapping row: ``h[slot]`` = 32 bits of md5(key|slot), ``ds`` =
    18 digits of md5(key|0). Generators read these columns instead of hashing again, which
    keeps the per-type expressions small enough for whole-stage code generation."""

    def __init__(self, h: Column, ds: Column, key: Column, ctx: dict | None = None):
        self.h, self.ds, self.key, self.ctx = h, ds, key, ctx or {}


def _f(key, name: str, expr):
    """A per-row feature: the pre-computed column when the mapping provides it, else ``expr()``."""
    ctx = getattr(key, "ctx", None) or {}
    return ctx[name] if name in ctx else expr()


def _eighteen(key: Column, slot: int) -> Column:
    """60 bits of md5(key|slot) modulo 10^18, as 18 digits."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{slot}"))), 1, 15), 16, 10).cast("bigint")
    return F.lpad((bits % F.lit(10**18)).cast("string"), 18, "0")


def hash_columns(key: Column) -> tuple[Column, Column]:
    h = F.array(*[F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{i}"))), 1, 8), 16, 10).cast("bigint")
                  for i in range(N_SLOTS)])
    return h, _eighteen(key, 0)


def draw(key, slot: int, n: int, bump: Column | None = None) -> Column:
    """Integer in [0, n) from the 32 high bits of md5(key|slot); ``bump`` shifts it by one."""
    if isinstance(key, HashKey) and slot < N_SLOTS:
        h = F.get(key.h, slot)
    else:  # a user's generator may take any slot
        text = key.key if isinstance(key, HashKey) else key
        h = F.conv(F.substring(F.md5(F.concat(text, F.lit(f"|{slot}"))), 1, 8), 16, 10).cast("bigint")
    if bump is not None:
        h = h + bump
    return F.pmod(h, F.lit(n))


def rint(key: Column, slot: int, lo: int, hi: int, bump: Column | None = None) -> Column:
    """Inclusive integer range [lo, hi] (Python ``random.randint``)."""
    return draw(key, slot, hi - lo + 1, bump) + lo


def digit_string(key, slot: int) -> Column:
    """18 decimal digits from 60 bits of md5(key|slot)."""
    if isinstance(key, HashKey) and slot == 0:
        return key.ds
    return _eighteen(key.key if isinstance(key, HashKey) else key, slot)


def pick(values: list[str], key: Column, slot: int, bump: Column | None = None) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (draw(key, slot, len(values), bump) + 1).cast("int"))


def pad2(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


# ------------------------------------------------------------------ generators (PSE-03..12)

def gen_person(form: Column, key: Column, b: Column) -> Column:
    parts = F.size(F.split(F.regexp_replace(form, r"^\s+|\s+$", ""), r"\s+"))
    first = pick(R.FIRST_NAMES, key, 0, b)
    last = pick(R.LAST_NAMES, key, 2)
    initial = F.char(rint(key, 1, 65, 90))
    return (F.when(parts >= 3, F.concat_ws(" ", first, F.concat(initial, F.lit(".")), last))
            .when(parts == 2, F.concat_ws(" ", first, last))
            .otherwise(first))


def gen_email(form: Column, key: Column, b: Column) -> Column:
    return F.concat(pick(R.EMAIL_NAMES, key, 0, b), rint(key, 1, 10, 999).cast("string"), F.lit("@"),
                    pick(R.EMAIL_DOMAINS, key, 2))


def gen_phone(form: Column, key: Column, b: Column) -> Column:
    has_ext = _f(key, "ph_has_ext", lambda: form.rlike(PHONE_EXT))
    label = _f(key, "ph_label", lambda: F.regexp_extract(form, PHONE_EXT, 1))
    base = _f(key, "ph_base", lambda: F.when(form.rlike(PHONE_EXT), F.regexp_replace(form, PHONE_EXT, "")).otherwise(form))
    d = _digits(key, b)  # 18 digits, first one bumped

    def s(i, n):
        return F.substring(d, i, n)

    body = (
        F.when(base.startswith("+91"), F.concat(F.lit("+91-9"), s(1, 9)))
        .when(base.startswith("+"), F.concat(F.lit("+1-"), s(1, 3), F.lit("-"), s(4, 3), F.lit("-"), s(7, 4)))
        .when(F.instr(base, "(") > 0, F.concat(F.lit("("), s(1, 3), F.lit(") "), s(4, 3), F.lit("-"), s(7, 4)))
        .when(F.instr(base, ".") > 0, F.concat(s(1, 3), F.lit("."), s(4, 3), F.lit("."), s(7, 4)))
        .when(base.rlike(r"^0\d{2,4}[\s\-]"), F.concat(F.lit("0"), s(1, 2), F.lit("-"), s(3, 4), F.lit("-"), s(7, 4)))
        .otherwise(F.concat(s(1, 3), F.lit("-"), s(4, 3), F.lit("-"), s(7, 4)))
    )
    ext = F.concat(F.lit(" "), label, F.lit(" "), _f(key, "ph_ext_n", lambda: rint(key, 1, 100, 999).cast("string")))
    return F.when(has_ext, F.concat(body, ext)).otherwise(body)


PHONE_EXT = r"(?i)\s*(ext\.?|x|extension)\s*(\d{1,5})$"


def _digits_bumped(key, b: Column) -> Column:
    ds = digit_string(key, 0)
    return F.concat(F.pmod(F.substring(ds, 1, 1).cast("int") + b, F.lit(10)).cast("string"), F.substring(ds, 2, 17))


def _digits(key, b: Column) -> Column:
    ctx = getattr(key, "ctx", None) or {}
    if "dig0" in ctx:
        return F.when(b == 1, ctx["dig1"]).otherwise(ctx["dig0"])
    return _digits_bumped(key, b)


def gen_ssn(form: Column, key: Column, b: Column) -> Column:
    d = _digits(key, b)
    compact = F.regexp_replace(form, "[ -]", "")
    return (F.when(F.length(compact) == 12, F.concat_ws(" ", F.substring(d, 1, 4), F.substring(d, 5, 4),
                                                          F.substring(d, 9, 4)))
            .when(F.instr(form, "-") > 0, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 2),
                                                      F.substring(d, 6, 4)))
            .otherwise(F.substring(d, 1, 9)))


def gen_card(form: Column, key: Column, b: Column) -> Column:
    num = F.concat(F.lit("4"), F.substring(_digits(key, b), 1, 15))
    groups = [F.substring(num, i, 4) for i in (1, 5, 9, 13)]
    return (F.when(F.instr(form, "-") > 0, F.concat_ws("-", *groups))
            .when(F.instr(form, " ") > 0, F.concat_ws(" ", *groups))
            .otherwise(num))


def _month_index(form: Column) -> Column:
    """1-based month named in ``form`` (first three letters, any case), else null."""
    m = F.lower(F.regexp_extract(form, r"(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)", 1))
    arr = F.array(*[F.lit(x.lower()) for x in R.SHORT_MONTHS])
    return F.when(m != "", F.array_position(arr, m).cast("int"))


def dob_parts(form: Column) -> tuple[Column, Column, Column]:
    """(year, month, day) of an original date in any of the detected shapes (null if absent)."""
    iso = r"^(\d{4})-(\d{2})-(\d{2})"
    mdy = r"^(\d{2})[/\-](\d{2})[/\-](\d{4})"
    year = F.regexp_extract(form, r"((?:19|20)\d{2})", 1).try_cast("int")
    month = (F.when(form.rlike(iso), F.regexp_extract(form, iso, 2).try_cast("int"))
             .when(form.rlike(mdy), F.regexp_extract(form, mdy, 1).try_cast("int"))
             .otherwise(_month_index(form)))
    day = (F.when(form.rlike(iso), F.regexp_extract(form, iso, 3).try_cast("int"))
           .when(form.rlike(mdy), F.regexp_extract(form, mdy, 2).try_cast("int"))
           .otherwise(F.regexp_extract(form, r"(?<![0-9])(\d{1,2})(?![0-9])", 1).try_cast("int")))
    return year, month, day


def _avoid(key: Column, slot: int, lo: int, hi: int, orig: Column) -> Column:
    """randint(lo, hi) that is never equal to ``orig`` (PSE-14 for date parts)."""
    n = hi - lo  # draw from n values, skip over orig
    x = draw(key, slot, n) + lo
    return F.when(orig.isNotNull() & (x >= orig) & (orig >= lo) & (orig <= hi), x + 1).otherwise(x)


def dob_draws(form: Column, key) -> tuple[Column, Column, Column]:
    """New (year, month, day), each different from the original's (PSE-14)."""
    oy, om, od = dob_parts(form)
    return (_avoid(key, 0, R.DOB_YEARS[0], R.DOB_YEARS[1], oy), _avoid(key, 1, 1, 12, om),
            _avoid(key, 2, R.DOB_DAYS[0], R.DOB_DAYS[1], od))


def gen_dob(form: Column, key: Column, b: Column) -> Column:
    y, m, d = _f(key, "dob_ymd", lambda: dob_draws(form, key))

    months = F.array(*[F.lit(x) for x in R.MONTHS])
    short = F.array(*[F.lit(x) for x in R.SHORT_MONTHS])
    mon_long = F.element_at(months, m.cast("int"))
    mon_short = F.element_at(short, m.cast("int"))
    ys, ms, dd = F.lpad(y.cast("string"), 4, "0"), pad2(m), pad2(d)
    short_used = _f(key, "dob_short", lambda: form.rlike(r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b"))
    return (
        F.when(form.rlike(r"^\d{4}-\d{2}-\d{2}"), F.concat_ws("-", ys, ms, dd))
        .when(form.rlike(r"^\d{2}/\d{2}/\d{4}"), F.concat_ws("/", ms, dd, ys))
        .when(form.rlike(r"^\d{2}-\d{2}-\d{4}"), F.concat_ws("-", ms, dd, ys))
        .when(form.rlike(r"(?i)^\d{1,2}(?:st|nd|rd|th)\s+[A-Za-z]+"),
              F.concat_ws(" ", ordinal(d), F.when(short_used, mon_short).otherwise(mon_long), ys))
        .when(form.rlike(r"^[A-Za-z]+\s+\d"), F.concat(mon_long, F.lit(" "), dd, F.lit(", "), ys))
        .when(form.rlike(r"^\d{1,2}\s+[A-Za-z]+"), F.concat_ws(" ", dd, mon_long, ys))
        .otherwise(F.concat_ws("/", ms, dd, ys))
    )


def gen_ip(form: Column, key: Column, b: Column) -> Column:
    hexes = [F.lower(F.hex(rint(key, i, 0, 65535, b if i == 0 else None))) for i in range(8)]
    v6 = F.concat_ws(":", *hexes)
    o1 = F.get(F.split(form, r"\."), 0).try_cast("int")
    last = rint(key, 3, 1, 254, b).cast("string")
    private = (
        F.when(o1 == 10, F.concat_ws(".", F.lit("10"), rint(key, 1, 0, 255).cast("string"),
                                     rint(key, 2, 0, 254).cast("string"), last))
        .when(o1 == 172, F.concat_ws(".", F.lit("172"), rint(key, 1, 16, 31).cast("string"),
                                     rint(key, 2, 0, 254).cast("string"), last))
        .otherwise(F.concat_ws(".", F.lit("192.168"), rint(key, 2, 0, 254).cast("string"), last))
    )
    public = F.concat_ws(".", pick(R.TEST_NETS, key, 1), last)
    return F.when(F.instr(form, ":") > 0, v6).when(is_private_ipv4(form), private).otherwise(public)


def gen_company(form: Column, key: Column, b: Column) -> Column:
    return F.concat_ws(" ", pick(R.COMPANY_PREFIXES, key, 0, b), pick(R.COMPANY_SUFFIX_POOL, key, 1))


def gen_address(form: Column, key: Column, b: Column) -> Column:
    low = F.lower(form)
    n = rint(key, 0, 1, 999, b).cast("string")
    india = (F.instr(low, "india") > 0) | (F.instr(low, "bengaluru") > 0) | form.rlike(r"\b\d{6}\b")
    uk = ((F.instr(low, "uk") > 0) | (F.instr(low, "united kingdom") > 0) | (F.instr(low, "london") > 0)
          | form.rlike(r"(?i)\b[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}\b"))
    return (
        F.when(form.rlike(r"(?i)^P\.?O\.?\s*Box"), F.concat(F.lit("P.O. Box "), rint(key, 0, 100, 9999, b).cast("string")))
        .when(india, F.concat(n, F.lit(" Main Street, Bangalore, Karnataka "),
                              rint(key, 1, 500000, 599999).cast("string"), F.lit(", India")))
        .when(uk, F.concat(n, F.lit(" High Street, London, SW1A 1AA, United Kingdom")))
        .otherwise(F.concat(n, F.lit(" Maple Ave, Springfield, IL "), rint(key, 1, 10000, 99999).cast("string")))
    )


def gen_url(form: Column, key: Column, b: Column) -> Column:
    parts = F.split(F.regexp_replace(form, "/+$", ""), "/")
    n = F.size(parts)
    keep = (n <= 1) | ((n == 3) & F.get(parts, 0).startswith("http"))
    new_last = F.concat(F.lit("user"), rint(key, 0, 1000, 9999, b).cast("string"))
    replaced = F.array_join(F.concat(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), F.array(new_last)), "/")
    return F.when(keep, form).otherwise(replaced)


GENERATORS = {
    "PERSON": gen_person, "EMAIL": gen_email, "PHONE": gen_phone, "SSN": gen_ssn, "CREDIT_CARD": gen_card,
    "DOB": gen_dob, "IP_ADDRESS": gen_ip, "COMPANY": gen_company, "ADDRESS": gen_address, "URL": gen_url,
}


def replacement(type_: Column, form: Column, key: Column, bump: Column, generators: dict | None = None) -> Column:
    """Dispatch on type; unknown types return null (PSE-13 fills them)."""
    gens = dict(GENERATORS)
    if generators:
        gens.update(generators)  # UDF-02: user generators (Column functions)
    out = None
    for t, g in gens.items():
        out = F.when(type_ == t, g(form, key, bump)) if out is None else out.when(type_ == t, g(form, key, bump))
    return out


NAMING_TEMPORARY = ["_key", "_h", "_ds", "_r0", *(f"_f_{k}" for k in ("ph_has_ext", "ph_label", "ph_base", "ph_ext_n", "dig0", "dig1", "dob_y", "dob_m", "dob_d", "dob_short"))]


def naming(salt: str = DEFAULT_SALT, generators: dict | None = None, scope: list = ()) -> list[dict]:
    """The replacement of a value as steps over its fields ``type``, ``norm`` and ``form`` (see ``validate.stages``), for
    rows of a mapping and for entities in an array; ``scope``: more fields of the key. Types without a generator get
    a name from the hash."""
    known_types = list(GENERATORS) + list(generators or {})

    def key(c) -> Column:
        return F.concat_ws("|", F.lit(salt), *[part(c) for part in scope], c("type"), c("norm"))

    def base(c) -> HashKey:
        return HashKey(c("_h"), c("_ds"), c("_key"))

    # shared sub-expressions of the generators, computed once per value as fields (keeps the generated code of
    # the replacement small and each regex evaluated once)
    feats = {
        "ph_has_ext": lambda c: c("form").rlike(PHONE_EXT), "ph_label": lambda c: F.regexp_extract(c("form"), PHONE_EXT, 1),
        "ph_base": lambda c: F.when(c("form").rlike(PHONE_EXT), F.regexp_replace(c("form"), PHONE_EXT, "")).otherwise(c("form")),
        "ph_ext_n": lambda c: rint(base(c), 1, 100, 999).cast("string"),
        "dig0": lambda c: _digits_bumped(base(c), F.lit(0)), "dig1": lambda c: _digits_bumped(base(c), F.lit(1)),
        "dob_y": lambda c: dob_draws(c("form"), base(c))[0], "dob_m": lambda c: dob_draws(c("form"), base(c))[1],
        "dob_d": lambda c: dob_draws(c("form"), base(c))[2],
        "dob_short": lambda c: c("form").rlike(r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b"),
    }

    def made(c, bump: int) -> Column:
        ctx = {k: c(f"_f_{k}") for k in feats}
        ctx["dob_ymd"] = (ctx.pop("dob_y"), ctx.pop("dob_m"), ctx.pop("dob_d"))
        return replacement(c("type"), c("form"), HashKey(c("_h"), c("_ds"), c("_key"), ctx), F.lit(bump), generators)

    def chosen(c) -> Column:
        never_same = F.when((c("_r0") == c("form")) & (c("type") != "URL"), made(c, 1)).otherwise(c("_r0"))
        return F.when(c("type").isin(*known_types), never_same).otherwise(hashed_name(c("type"), c("_key")))

    return [{"_key": key}, {"_h": lambda c: hash_columns(c("_key"))[0], "_ds": lambda c: hash_columns(c("_key"))[1]},
            {f"_f_{k}": make for k, make in feats.items()}, {"_r0": lambda c: made(c, 0)}, {"replacement": chosen}]


RANGE_BITS = 16  # document ids are counted in ranges of 2^16, ranges of ranges, and so on


def numbers(seen: DataFrame) -> DataFrame:
    """PSE-13: ``number`` of each distinct (type, doc_id, start), from 1 in order of (doc_id, start) within its type.

    Counts per range and prefix offsets instead of one ordered window a type: places are numbered within their
    document, documents are counted within ranges of 2^16 ids, ranges within ranges of ranges, five levels for
    64-bit ids. A window holds a document's places or at most 2^16 counts, whatever the type. The ranges are a
    function of the id, so a recomputed task agrees with the others. ``seen`` is read more than once."""
    named = F.col("type"), F.col("_doc")
    seen = seen.select("type", F.col("doc_id").cast("bigint").alias("_doc"), "start").distinct()
    found = seen.withColumn("number", F.row_number().over(Window.partitionBy(*named).orderBy("start")).cast("bigint"))
    counts = seen.groupBy(*named).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("_doc", "_range")
    bits = 0
    while True:
        last = bits == 64  # the sign alone is left
        above = F.lit(0) if last else F.shiftright("_range", RANGE_BITS)
        counts = counts.withColumn("_above", above.cast("bigint"))
        before = Window.partitionBy("type", "_above").orderBy(F.asc_nulls_first("_range")).rowsBetween(Window.unboundedPreceding, -1)
        offset = counts.select(F.col("type").alias("_t"), "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        mine = F.col("_doc") if bits == 0 else F.shiftright("_doc", min(bits, 63))
        found = found.join(offset, (F.col("type") == F.col("_t")) & mine.eqNullSafe(F.col("_range")))
        found = found.withColumn("number", F.col("number") + F.col("_before")).drop("_t", "_range", "_before")
        if last:
            return found.select("type", F.col("_doc").alias("doc_id"), "start", "number")
        counts = counts.groupBy("type", "_above").agg(F.sum("_n").alias("_n")).withColumnRenamed("_above", "_range")
        bits += RANGE_BITS


def pseudonym_mapping(entities: DataFrame, salt: str = DEFAULT_SALT, scope: str = "corpus",
                      generators: dict | None = None, unknown: str = "number") -> DataFrame:
    """PSE-02/13/14/15: one row per distinct (type, norm) -- or (doc_id, type, norm) for
    ``scope='document'`` -- with the form (first appearance), count and replacement.

    ``unknown`` names values of types without a generator: "number" gives ``[TYPE_n]`` by first appearance, for which
    the distinct values are checkpointed and counted over all documents; "hash" gives ``[TYPE_xxxxxxxxxxxx]`` from the
    keyed hash of the value alone, the same in every batch and run, and needs no second pass. Detection rejects unknown
    types (VAL-16), so its entities are named alike by both."""
    if unknown not in ("number", "hash"):
        raise ValueError(f"unknown: {unknown!r}")
    keys = ["type", "norm"] if scope == "corpus" else ["doc_id", "type", "norm"]
    e = entities.withColumn("norm", normalize(F.col("value")))
    m = e.groupBy(*keys).agg(
        F.min_by(F.col("value"), F.struct("doc_id", "start")).alias("form"),
        F.min(F.struct("doc_id", "start")).alias("first_seen"),
        F.count(F.lit(1)).alias("occurrences"),
    )
    known = F.col("type").isin(*(list(GENERATORS) + list(generators or {})))
    scope_key = [lambda c: c("doc_id").cast("string")] if scope == "document" else []
    m = on_rows(m, naming(salt, generators, scope_key), NAMING_TEMPORARY)
    if unknown == "hash":
        return m
    place = F.concat(F.lit("["), F.col("type"), F.lit("_"), F.col("number").cast("string"), F.lit("]"))
    if scope == "document":  # a window of a document's values
        number = F.dense_rank().over(Window.partitionBy(*keys[:-1], F.when(known, F.col("norm"))).orderBy("first_seen"))
        return m.withColumn("number", number).withColumn("replacement", F.when(known, F.col("replacement")).otherwise(place)).drop("number")
    ensure_checkpoint_dir(entities.sparkSession)
    m = m.checkpoint()
    n = numbers(m.where(~known).select("type", "first_seen.*")).withColumnRenamed("type", "_t").withColumnRenamed("doc_id", "_d").withColumnRenamed("start", "_s")
    m = m.join(n, (F.col("type") == F.col("_t")) & F.col("first_seen.doc_id").eqNullSafe(F.col("_d")) & F.col("first_seen.start").eqNullSafe(F.col("_s")) & ~known, "left")
    return m.withColumn("replacement", F.when(known, F.col("replacement")).otherwise(place)).drop("_t", "_d", "_s", "number")


def hashed_name(type_: Column, key: Column) -> Column:
    """``[TYPE_xxxxxxxxxxxx]``: the name of a value without a generator that needs nothing but its key."""
    return F.concat(F.lit("["), type_, F.lit("_"), F.substring(F.md5(F.concat(key, F.lit("|name")).cast("binary")), 1, 12), F.lit("]"))


def apply_mapping(entities: DataFrame, mapping: DataFrame, scope: str = "corpus") -> DataFrame:
    """JOIN-04: attach the replacement to each entity (equi join on the normalized key;
    AQE turns it into a broadcast when the mapping is small and splits skewed keys)."""
    keys = ["type", "norm"] if scope == "corpus" else ["doc_id", "type", "norm"]
    e = entities.withColumn("norm", normalize(F.col("value")))
    return e.join(mapping.select(*keys, "replacement"), keys, "left").drop("norm")


def pseudonymize(entities: DataFrame, salt: str = DEFAULT_SALT, scope: str = "corpus",
                 generators: dict | None = None, unknown: str = "number") -> DataFrame:
    """Entities + ``replacement`` (PSE-02 + JOIN-04)."""
    return apply_mapping(entities, pseudonym_mapping(entities, salt, scope, generators, unknown), scope)
