"""Column builders on listings: condition, shipping and financing in prose, stock, option lists, price arrays."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_listed, fold, phrases

# Phrases that tell a used condition, the most telling condition first; a star ends a word that may go on.
CONDITIONS = {
    "refurbished": ["reacondicionad*", "refurbished", "renewed", "renew", "grado a", "grado b", "detalle estetico", "detalles esteticos", "saldo de tienda", "producto saldo"],
    "open_box": ["open box", "openbox", "caja abierta", "devolucion de cliente", "devoluciones de cliente", "embalaje abierto", "empaque danado", "empaque abierto"],
    "display": ["exhibicion", "exhibiciones", "producto de muestra", "equipo demo", "vitrina"],
    "used": ["usado", "usada", "usados", "usadas", "segunda mano", "pre owned", "preowned"],
}
# What a catalog calls a condition.
STATED = {"new": ["new", "nuevo"], "used": ["used", "usado"], "refurbished": ["refurbished", "reacondicionado"]}


def condition(catalog: Column, text: Column) -> Column:
    """Evidence of use in the text wins over the catalog; new only where it is written."""
    words = phrases(text)
    return F.coalesce(first_listed(words, CONDITIONS), first_listed(phrases(catalog), STATED), first_listed(words, {"new": ["nuevo", "nueva", "nuevos", "nuevas"]}), F.lit("unknown"))


def condition_group(c: Column) -> Column:
    return F.when(c.isin("new", "unknown"), "new_or_unknown").otherwise(c)


def amounts(text: Column) -> Column:
    """Folded text whose sums of money are one word each, a hash sign and digits: thousands lose their dots."""
    joined = F.regexp_replace(fold(text), r"(?<=[0-9])[. ](?=[0-9]{3}(?![0-9]))", "")
    return F.regexp_replace(joined, r"[$]?\s*(?<![0-9,.])([0-9]{3,9})(?!,?[0-9])", " #$1 ")


def _next_sum(words: Column, lead: list[list[str]], within: int, between: Callable[[Column], Column]) -> Column:
    """The first sum among the ``within`` words after the words of ``lead`` (alternatives for each place), where the words before it satisfy ``between``."""
    n = len(lead)
    opens = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: reduce(lambda x, y: x & y, (F.coalesce(F.get(words, i + k).isin(any_of), F.lit(False)) for k, any_of in enumerate(lead))))
    after = F.transform(opens, lambda i: F.slice(words, i + n + 1, F.lit(within)))
    is_sum = lambda w: F.startswith(w, F.lit("#"))
    place = lambda a: F.array_position(F.transform(a, is_sum), True).cast("int")
    told = F.filter(after, lambda a: F.exists(a, is_sum) & between(F.slice(a, F.lit(1), F.greatest(place(a) - 1, F.lit(0)))))
    return F.get(F.transform(told, lambda a: F.substring(F.get(a, place(a) - 1), 2, 12).try_cast("long")), F.lit(0))


def shipping(text: Column) -> Column:
    """Struct cost, free_over, pickup from prose: a cost, a threshold of free shipping, or free without one (0).

    A cost follows its word at once or after a preposition; a threshold follows within
    eight words of which one says from where on.
    """
    words, said = F.regexp_extract_all(amounts(text), F.lit("(#?[a-z0-9]+)")), phrases(text)
    free = first_listed(said, {"free": ["despacho gratis", "envio gratis"]}).isNotNull()
    over = _next_sum(words, [["despacho", "envio"], ["gratis"]], 8, lambda before: F.exists(before, lambda w: w.isin("sobre", "desde")))
    cost = _next_sum(words, [["despacho", "envio", "delivery"]], 2, lambda before: F.forall(before, lambda w: w.isin("desde", "por", "a")))
    pickup = first_listed(said, {"pickup": ["retiro en tienda", "retiro en local", "retiro gratis en tienda", "retiro gratis en local", "click y collect", "click collect"]}).isNotNull()
    return F.struct(F.when(free & over.isNull(), F.lit(0).cast("long")).otherwise(cost).alias("cost"), over.alias("free_over"), pickup.alias("pickup"))


def financing(text: Column) -> Column:
    """Struct apr, instalments, total from prose: the per cent that follow CAE, the number before cuotas, the sum within six words of a total."""
    marks = F.regexp_extract_all(F.replace(fold(text), F.lit(","), F.lit(".")), F.lit("([a-z]+|[0-9]+[.]?[0-9]*|%)"))
    rate = F.transform(F.filter(F.sequence(F.lit(0), F.size(marks)), lambda i: (F.get(marks, i) == "cae") & (F.get(marks, i + 2) == "%")), lambda i: F.get(marks, i + 1).try_cast("double"))
    several = F.regexp_extract(phrases(text), " ([0-9]{1,3}) cuotas? ", 1)
    words = F.regexp_extract_all(amounts(text), F.lit("(#?[a-z0-9]+)"))
    total = _next_sum(words, [["costo", "valor", "monto", "precio"], ["total"]], 6, lambda before: F.lit(True))
    return F.struct(F.get(rate, F.lit(0)).alias("apr"), F.nullif(several, F.lit("")).try_cast("int").alias("instalments"), total.alias("total"))


def stock_state(stock: Column, availability: Column) -> Column:
    a = fold(availability)
    out = a.rlike("agotado|sin stock|out of stock|sold out|unavailable|no disponible")
    return F.when(stock <= 0, "sold_out").when(stock > 0, "in_stock").when(out, "sold_out").when(a.rlike("ultimas? unidades?|poco stock"), "low").when(a != "", "in_stock").otherwise("unknown")


def prices_by_type(prices: Column) -> Column:
    """Struct card, all_payment, list, current of array<struct<type, price>>: an event price is before an internet price."""
    of = lambda t: F.get(F.transform(F.filter(prices, lambda p: p["type"] == t), lambda p: p["price"]), F.lit(0))
    all_, card, list_ = F.coalesce(of("eventPrice"), of("internetPrice")), of("cmrPrice"), of("normalPrice")
    return F.struct(card.alias("card"), all_.alias("all_payment"), list_.alias("list"), F.coalesce(card, all_, list_).alias("current"))


def spec_text(specs: Column) -> Column:
    """A map as one text, keys in order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(specs)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | ")


def variants(raw: Column) -> Column:
    """Uniform options of array<struct<id, sku, name, stock, available>>: available where stock is known and positive, or as stated."""
    return F.transform(raw, lambda v: F.struct(F.coalesce(v["id"], v["sku"]).alias("id"), v["sku"].alias("sku"), F.trim(v["name"]).alias("name"), v["stock"].alias("stock"), F.coalesce(v["stock"] > 0, v["available"]).alias("available")))


def field_difference(expected: Column, observed: Column) -> Column:
    """Struct status (same, different, not_verified) and relative difference of a checked field."""
    status = F.when(expected.isNull() | observed.isNull(), "not_verified").when(expected == observed, "same").otherwise("different")
    return F.struct(status.alias("status"), F.when(status == "different", F.abs(F.try_divide(observed - expected, expected))).alias("relative"))
