"""Column builders on keys: stores and their families, paths and links, headers, aliases, measures in cells, prices of bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import digits
from .text import ACCENTED, PLAIN, digest, fold, squeeze, tokens

# Retailers that belong to one family.
FAMILIES = {"falabella": "falabella", "sodimac": "falabella", "tottus": "falabella", "paris": "cencosud", "easy": "cencosud"}
# Words of a query that ask for cheap or for dear things.
CHEAP = ["barato", "barata", "baratos", "baratas", "economico", "economica", "economicos", "economicas"]
DEAR = ["premium", "gamer", "profesional"]
# Spellings of units, and the unit and factor that a quote counts them in.
UNITS = {
    "kg": (["kg", "kilo", "kilos"], "kg", 1.0),
    "g": (["g", "gr", "grs", "gramo", "gramos"], "kg", 0.001),
    "litro": (["l", "lt", "lts", "litro", "litros"], "litro", 1.0),
    "ml": (["ml", "cc"], "litro", 0.001),
    "unidad": (["un", "und", "u", "unidad", "unidades"], "unidad", 1.0),
    "pack": (["pack", "packs"], "pack", 1.0),
    "metro": (["m", "mt", "mts", "metro", "metros"], "metro", 1.0),
}
#: Units that only the texts of a catalog use, and the order in which its measures are looked for.
CATALOG_UNITS = {"mm": (["mm"], "metro", 0.001), "cm": (["cm"], "metro", 0.01), "lts": (["lts"], "litro", 1.0)}
MEASURES = ["litro", "kg", "metro"]


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The value of a small table for a key, null for none."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[c]


def equivalents(token: Column, aliases: dict[str, list[str]]) -> Column:
    """All spellings of a token, its own alone where no alias knows it. aliases: canonical spelling -> others."""
    sets = {t: [name, *others] for name, others in aliases.items() for t in [name, *others]}
    table = F.create_map(*(x for t, all_ in sets.items() for x in (F.lit(t), F.array(*(F.lit(a) for a in sorted(all_))))))
    return F.coalesce(table[token], F.array(token))


def canonical_token(token: Column, aliases: dict[str, list[str]]) -> Column:
    return F.coalesce(lookup(token, {o: name for name, others in aliases.items() for o in [name, *others]}), token)


def matches_any_spelling(text: Column, query: Column, aliases: dict[str, list[str]]) -> Column:
    """Every word of the query, in some spelling, is a word of the text (both arrays of tokens)."""
    return F.forall(query, lambda t: F.arrays_overlap(text, equivalents(t, aliases)))


def rewritten_query(c: Column, aliases: dict[str, list[str]]) -> Column:
    """White space squeezed, and words that have other spellings in their canonical one."""
    known = lambda w: F.size(equivalents(fold(w), aliases)) > 1
    return F.array_join(F.transform(F.split(squeeze(c), " "), lambda w: F.when(known(w), canonical_token(fold(w), aliases)).otherwise(w)), " ")


def scope_digest(source: Column, stores: Column, most: Column, band: Column) -> Column:
    """16 hex digits of what a search covers, whatever the order and case of its stores."""
    body = F.struct(source.alias("source"), F.array_sort(F.transform(stores, lambda s: F.lower(s))).alias("stores"), most.cast("int").alias("max"), band.alias("band"))
    return digest(F.to_json(body), 16)


def typo_equivalent(left: Column, right: Column) -> Column:
    """As many words, and at most one of them differs, by one doubled letter, in a word of letters. left, right: arrays of words."""
    without = lambda w, i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))

    def doubled(a: Column, b: Column) -> Column:
        long, short = F.when(F.length(a) > F.length(b), a).otherwise(b), F.when(F.length(a) > F.length(b), b).otherwise(a)
        again = F.filter(F.sequence(F.lit(2), F.greatest(F.length(long), F.lit(2))), lambda i: F.substring(long, i, F.lit(1)) == F.substring(long, i - 1, F.lit(1)))
        return (F.length(short) >= 3) & (F.length(long) == F.length(short) + 1) & F.array_contains(F.transform(again, lambda i: without(long, i)), short)

    letters = lambda w: w.rlike("^[a-z]+$")
    one = lambda a, b: F.when(a == b, 0).when(letters(a) & letters(b) & doubled(a, b), 1).otherwise(2)
    same = (F.size(left) == F.size(right)) & (F.size(left) > 0)
    return F.when(same, F.aggregate(F.zip_with(left, right, one), F.lit(0), lambda n, x: n + x) <= 1).otherwise(F.lit(False))


def compatible_queries(left: Column, right: Column, spec: str = "^[0-9]+(gb|tb|mb|hz|mah|w|pulgadas|litros|ml|kg|cm|mm)$") -> Column:
    """Equal specs where both have some, and three quarters of the shorter query's words in common. left, right: texts."""
    a, b = F.array_distinct(tokens(left)), F.array_distinct(tokens(right))
    specs = lambda t: F.array_sort(F.filter(t, lambda w: w.rlike(spec)))
    clash = (F.size(specs(a)) > 0) & (F.size(specs(b)) > 0) & (specs(a) != specs(b))
    shared = F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0))
    return F.coalesce(~clash & (shared >= 0.75), F.lit(False))


def store_id(c: Column, families: dict[str, str] = FAMILIES) -> Column:
    """The store that an id, a host or a label names, else the label in lower case."""
    plain = F.regexp_replace(fold(c), "^www[.]|[.]cl$|[^a-z0-9. ]", "")
    known = [F.when(plain.contains(name), F.lit(name)) for name in families]
    return F.coalesce(F.when(plain.contains("homecenter"), F.lit("sodimac")), *known, F.lower(F.trim(c)))


def store_family(store: Column, families: dict[str, str] = FAMILIES) -> Column:
    return lookup(store_id(store, families), families)


def retailer_key(store: Column, families: dict[str, str] = FAMILIES) -> Column:
    """The family of a store, or the store itself."""
    return F.coalesce(store_family(store, families), store_id(store, families))


def same_retailer(a: Column, b: Column, families: dict[str, str] = FAMILIES) -> Column:
    return F.coalesce((retailer_key(a, families) == retailer_key(b, families)) & (F.trim(a) != ""), F.lit(False))


def display_name(label: Column, suffix: str = "chile") -> Column:
    """A label without its country at the end, unless nothing else is left."""
    text = squeeze(F.coalesce(label, F.lit("")))
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(text, rf"(?i)[ \-]+{suffix}$", "")), F.lit("")), text)


def public_store(store: Column, title: Column, hidden: list[str], fallback: str = "otro") -> Column:
    """Struct id, title as shown: aggregators hide behind the fallback."""
    key = F.lower(squeeze(store))
    secret = key.isin(hidden)
    return F.struct(F.when(secret, fallback).otherwise(key).alias("id"), F.when(secret, F.initcap(F.lit(fallback))).otherwise(display_name(F.coalesce(title, store))).alias("title"))


def origin_path(c: Column, most: int = 80) -> Column:
    """The path of a link or path without its query and last slash; empty where there is none or it has white space."""
    text = F.trim(F.coalesce(c, F.lit("")))
    path = F.when(text.startswith("/") & ~text.startswith("//"), text).otherwise(F.regexp_extract(text, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1))
    path = F.substring(F.regexp_extract(path, r"^([^?#]*)", 1), 1, most)
    bare = F.rtrim(path, F.lit("/"))
    return F.when(~path.startswith("/") | path.rlike(r"\s"), "").otherwise(F.when(bare == "", "/").otherwise(bare))


def product_path(store: Column, product_id: Column, prefix: str = "/producto") -> Column:
    return F.concat(F.lit(prefix + "?store="), F.url_encode(store), F.lit("&id="), F.url_encode(product_id.cast("string")))


def repaired_url(base: Column, url: Column, slug: Column) -> Column:
    """An absolute product link: as it is, of the base where it is a path, from the slug where there is none."""
    u = F.trim(F.coalesce(url, F.lit("")))
    root = F.rtrim(base, F.lit("/"))
    return F.when(u.rlike("^https?://"), u).when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u != "", F.concat(root, F.lit("/"), F.ltrim(u, F.lit("/")))).when(slug != "", F.concat(root, F.lit("/"), slug, F.lit("/p")))


def image_urls(gallery: Column, base: Column, most: int = 12) -> Column:
    """Distinct absolute links of an array of galleries (arrays of links), the first ones."""
    flat = F.filter(F.flatten(gallery), lambda u: u.isNotNull() & (F.trim(u) != ""))
    return F.slice(F.array_distinct(F.transform(flat, lambda u: repaired_url(base, u, F.lit("")))), 1, most)


def column_key(c: Column) -> Column:
    """Letters and digits of a header, folded."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTED, PLAIN), "[^a-z0-9]", "")


def entity_key(code: Column, store: Column, product_id: Column, name: Column) -> Column:
    """What an alert is about: the comparison code, the store's product, or the name."""
    own = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    return F.coalesce(own(code), F.concat(F.lit("product:"), store, F.lit(":"), own(product_id)), F.concat(F.lit("name:"), F.lower(squeeze(name))))


def price_signature(*prices: Column) -> Column:
    """Prices joined by colons, nothing for null."""
    return F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in prices))


def price_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.greatest(a, b) / F.least(a, b))


def preference(query: Column) -> Column:
    """low or high where a query asks for it, null else; low wins."""
    words = F.regexp_extract_all(fold(query), F.lit("([a-z0-9]+)"))
    asks = lambda listed: F.arrays_overlap(words, F.array(*(F.lit(w) for w in listed)))
    return F.when(asks(CHEAP), "low").when(asks(DEAR), "high")


def band_conflict(price: Column, low: Column, high: Column, want: Column) -> Column:
    """below, above, or the same with what was asked for; null inside a band or without one."""
    return F.when(low.isNull() | F.coalesce(price, F.lit(0)).isin(0) | price.between(low, high), F.lit(None)).when(price < low, F.when(want == "high", "below_high").otherwise("below")).otherwise(F.when(want == "low", "above_low").otherwise("above"))


def unit_of(c: Column) -> Column:
    """Struct unit, factor that a spelling of a unit counts in; null for others."""
    key = column_key(c)
    spelled = {s: (unit, factor) for spellings, unit, factor in UNITS.values() for s in spellings}
    return F.struct(lookup(key, {s: u for s, (u, _) in spelled.items()}).alias("unit"), F.create_map(*(F.lit(x) for s, (_, f) in spelled.items() for x in (s, f)))[key].alias("factor"))


def quantity_cell(c: Column, most: float = 10_000) -> Column:
    """Struct amount, unit of a cell such as 500 g or 1,5 lt, in kg, litro, unidad, pack or metro; null for what is none or out of (0, most], and for a fraction without a unit."""
    number = F.replace(F.regexp_extract(c, r"^\s*([0-9]+(?:[.,][0-9]+)?)\s*[^\d\s]*\s*$", 1), F.lit(","), F.lit(".")).try_cast("double")
    word = F.regexp_extract(c, r"^\s*[0-9]+(?:[.,][0-9]+)?\s*([^\d\s]*)\s*$", 1)
    u = unit_of(word)
    unit = F.when(word == "", "unidad").otherwise(u["unit"])
    amount = F.round(number * F.when(word == "", F.lit(1.0)).otherwise(u["factor"]), 6)
    good = unit.isNotNull() & (number > 0) & (number <= most) & ((word != "") | (number == F.floor(number)))
    return F.struct(F.when(good, amount).alias("amount"), F.when(good, unit).alias("unit"))


def catalog_measure(name: Column, brand: Column, specs: Column) -> Column:
    """Struct measure, amount of the first volume in name, brand or specs (a map), else the first mass, else the first length: litro, kg or metro; null without one."""
    entries = F.transform(F.map_entries(specs), lambda e: F.concat_ws(" ", e["key"], e["value"]))
    text = fold(F.concat_ws(" ", name, brand, F.concat_ws(" ", entries)))
    found = []
    for measure in MEASURES:
        spelled = {s: factor for spellings, m, factor in [*UNITS.values(), *CATALOG_UNITS.values()] if m == measure for s in spellings}
        pattern = rf"(?<![0-9.,])([0-9]+(?:[.,][0-9]+)?) ?({'|'.join(sorted(spelled, key=len, reverse=True))})\b"
        number = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
        factor = F.create_map(*(F.lit(x) for pair in spelled.items() for x in pair))[F.nullif(F.regexp_extract(text, pattern, 2), F.lit(""))]
        amount = F.round(number * factor, 6)
        found.append(F.when(amount > 0, F.struct(F.lit(measure).alias("measure"), amount.alias("amount"))))
    return F.coalesce(*found)


def money_cell(c: Column) -> Column:
    """Whole pesos of a cell such as 10990, $10.990 or CLP 10.990; null for anything else."""
    text = F.regexp_replace(F.trim(c.cast("string")), r"(?i)^(clp\s*|\$\s*)", "")
    amount = F.when(text.rlike(r"^([0-9]+|[0-9]{1,3}([.][0-9]{3})+)$"), digits(text))
    return F.when(amount >= 1, amount)


def unit_price(line_unit: Column, price: Column, measure: Column, amount: Column) -> Column:
    """Struct fits, price, issue: the price of one line unit of a product that holds ``amount`` of ``measure`` (kg, litro, metro or unidad)."""
    pieces = line_unit.isin("unidad", "pack")
    same = line_unit == measure
    each = F.when(pieces, price).when(same & (amount > 0), F.round(price / amount).cast("long"))
    issue = F.when(price.isNull(), "price").when(~pieces & measure.isNull(), "measure_unknown").when(~pieces & ~same, "unit_mismatch")
    return F.struct((issue.isNull() & each.isNotNull()).alias("fits"), F.when(issue.isNull(), each).alias("price"), issue.alias("issue"))


def power_tokens(text: Column) -> Column:
    """Watts and counts of panels in a text, sorted: 100w, 6panel."""
    f = fold(text)
    watts = F.transform(F.regexp_extract_all(f, F.lit(r"\b([0-9]{1,5}) ?(?:w|watts?|watios?)\b")), lambda n: F.concat(n.cast("int").cast("string"), F.lit("w")))
    counted = lambda word: F.transform(F.regexp_extract_all(f, F.lit(rf"\b([0-9]{{1,3}}) ?{word}(?:es|s)?\b")), lambda n: F.concat(n.cast("int").cast("string"), F.lit(word)))
    return F.array_sort(F.array_distinct(F.concat(watts, counted("placa"), counted("panel"))))


def main_storage(words: Column, least: int = 64) -> Column:
    """The largest of the storage words that has ``least`` GB or more, else the largest; in GB."""
    gb = F.transform(F.filter(words, lambda w: w.rlike("^[0-9]{1,5}(gb|tb)$")), lambda w: F.regexp_extract(w, "^([0-9]+)", 1).cast("long") * F.when(w.endswith("tb"), 1024).otherwise(1))
    return F.coalesce(F.array_max(F.filter(gb, lambda x: x >= least)), F.array_max(gb))


def manufacturer_codes(specs: Column, keys: tuple[str, ...] = ("modelo", "model", "mpn", "numero de parte", "part number")) -> Column:
    """Letters and digits of the specs that name a model, those with a digit and four characters or more, sorted."""
    named = F.filter(F.map_entries(specs), lambda e: fold(e["key"]).isin(*keys))
    codes = F.transform(named, lambda e: F.regexp_replace(fold(e["value"]), "[^a-z0-9]", ""))
    return F.array_sort(F.array_distinct(F.filter(codes, lambda c: (F.length(c) >= 4) & c.rlike("[0-9]"))))


def vehicle_code(brand: Column, model: Column, year: Column, version: Column, used: Column, store: Column, product_id: Column) -> Column:
    """A used vehicle is one of its kind; a new one compares by brand, model, year and version, if that is known."""
    own = F.concat(F.lit(":"), store, F.lit(":"), product_id.cast("string"))
    key = F.concat_ws("|", *(F.nullif(fold(c.cast("string")), F.lit("")) for c in (brand, model, year, version)))
    return F.when(used, F.concat(F.lit("vehicle-used"), own)).when(fold(version) == "", F.concat(F.lit("vehicle-new-unverified"), own)).otherwise(F.concat(F.lit("vehicle-new:"), key))


def membership(role: Column, paid_until: Column, now: Column) -> Column:
    """Struct active, tier: an administrator always, others while they have paid."""
    admin, paid = F.coalesce(role == "admin", F.lit(False)), F.coalesce(paid_until > now, F.lit(False))
    return F.struct((admin | paid).alias("active"), F.when(admin, "admin").when(paid, "paid").otherwise("user").alias("tier"))


def moment(c: Column) -> Column:
    """An ISO text as an instant, UTC where it names no zone; null for anything else."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(c), r"Z$", "+00:00"))


def thousands_int(c: Column) -> Column:
    """A number from 1.234.567, 1234 or 1234.0; null for anything else."""
    t = F.trim(c)
    return F.when(t.rlike(r"^-?[0-9]{1,3}([.][0-9]{3})+$"), F.replace(t, F.lit("."), F.lit("")).try_cast("long")).otherwise(t.try_cast("double").cast("long"))
