"""Records from payloads and for exports: listings inside JSON and HTML, tables of cells, promotions, searches with their results, scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions.money import money

from .catalog import latest, quota


def listing_pages(payloads: DataFrame, items: str, pages: str, item: str) -> DataFrame:
    """store, total_pages (1 where the payload has none) and the fields of each item of a listing payload. items, pages: JSON paths; item: their schema."""
    x = payloads.select("store", F.coalesce(F.get_json_object("payload", pages).try_cast("int"), F.lit(1)).alias("total_pages"), F.from_json(F.get_json_object("payload", items), f"array<struct<{item}>>").alias("i"))
    return x.select("store", "total_pages", F.explode("i").alias("i")).select("store", "total_pages", "i.*")


def aggregator_normal(current: Column, previous: Column, internet: Column) -> Column:
    """The list price of an aggregator's row: the previous price if higher, else the internet price if higher, else the current one."""
    return F.when(previous > current, previous).when(internet > current, internet).otherwise(current)


def spec_map(names: Column, values: Column) -> Column:
    """A map of two arrays; the first value of a name that comes twice, no empty names."""
    pairs = F.filter(F.zip_with(names, values, lambda n, v: F.struct(F.trim(n).alias("key"), v.alias("value"))), lambda e: e["key"] != "")
    first = F.filter(pairs, lambda e, i: F.array_position(F.transform(pairs, lambda p: p["key"]), e["key"]) == i + 1)
    return F.map_from_entries(first)


def parsed_specs(text: Column) -> Column:
    """The map of a text such as a: x | b: y."""
    parts = F.filter(F.split(text, r"\s*\|\s*"), lambda p: F.contains(p, F.lit(":")))
    split = lambda p, i: F.trim(F.regexp_extract(p, r"^([^:]*):(.*)$", i))
    return spec_map(F.transform(parts, lambda p: split(p, 1)), F.transform(parts, lambda p: split(p, 2)))


def grids(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, row, values: cells (by, row, col, text) as rows of arrays in order of their columns, empty where a cell is missing."""
    width = cells.groupBy(*by).agg(F.max("col").alias("_w"))
    x = cells.groupBy(*by, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("_m")).join(width, by)
    return x.select(*by, "row", F.transform(F.sequence(F.lit(0), F.col("_w")), lambda c: F.coalesce(F.col("_m")[c], F.lit(""))).alias("values"))


_CELL = "array<struct<text:string,start_row_offset_idx:int,end_row_offset_idx:int,start_col_offset_idx:int,end_col_offset_idx:int,column_header:boolean>>"


def document_tables(documents: DataFrame, by: list[str], schema_name: str, most: tuple[int, int] = (1000, 50)) -> DataFrame:
    """by, table, page, row, headers, values: the rows below the headers of the tables in JSON documents (payload).

    Cells tell the rows and columns that they span; where cells overlap the later one
    stands. The headers of a column are the different texts of its header rows, joined.
    Documents that are damaged or of another schema, tables without size or beyond
    ``most``, and tables with a cell outside of them, have no rows; nor have empty rows.
    Tables are numbered from 1 in their document, rows from 1 in their table.
    """
    v = F.try_parse_json("payload")
    # conditions are columns that the last step reads: a filter would be made again from the payload, for each cell
    x = documents.select(*by, v.alias("_v")).withColumn("_v", F.when(F.try_variant_get("_v", "$.schema_name", "string") == schema_name, F.col("_v")))
    x = x.select(*by, F.posexplode(F.try_variant_get("_v", "$.tables", "array<variant>")).alias("table", "_t"))
    of = lambda path, kind: F.try_variant_get("_t", path, kind)
    x = x.select(*by, (F.col("table") + 1).alias("table"), of("$.prov[0].page_no", "int").alias("page"), of("$.data.num_rows", "int").alias("_rows"), of("$.data.num_cols", "int").alias("_cols"), of("$.data.table_cells", _CELL).alias("_cells"))
    inside = lambda c: (c["start_row_offset_idx"] >= 0) & (c["start_row_offset_idx"] < c["end_row_offset_idx"]) & (c["end_row_offset_idx"] <= F.col("_rows")) & (c["start_col_offset_idx"] >= 0) & (c["start_col_offset_idx"] < c["end_col_offset_idx"]) & (c["end_col_offset_idx"] <= F.col("_cols"))
    fits = F.col("_rows").between(1, most[0]) & F.col("_cols").between(1, most[1]) & F.forall("_cells", lambda c: F.coalesce(inside(c), F.lit(False)))
    x = x.withColumn("_cells", F.when(fits, F.col("_cells")))
    ends = F.transform(F.filter("_cells", lambda c: F.coalesce(c["column_header"], F.lit(False))), lambda c: c["end_row_offset_idx"] - 1)
    x = x.withColumn("_end", F.coalesce(F.array_max(ends), F.lit(0)))
    # a table is one row: its places, first empty, then as its cells fill them, sorted by place and cell; the last of a place stands
    entry = lambda at, i, text: F.struct(at.alias("at"), i.alias("i"), text.alias("text"))
    across = lambda c, i: lambda r: F.transform(F.sequence(c["start_col_offset_idx"], c["end_col_offset_idx"] - 1), lambda k: entry(r * F.col("_cols") + k, i, F.coalesce(c["text"], F.lit(""))))
    filled = F.flatten(F.transform("_cells", lambda c, i: F.flatten(F.transform(F.sequence(c["start_row_offset_idx"], c["end_row_offset_idx"] - 1), across(c, i)))))
    free = F.transform(F.sequence(F.lit(0), F.when(F.col("_cells").isNotNull(), F.col("_rows") * F.col("_cols") - 1)), lambda at: entry(at, F.lit(-1), F.lit("")))
    x = x.withColumn("_sorted", F.sort_array(F.concat(free, filled)))
    last = F.filter("_sorted", lambda e, i: ~F.coalesce(F.get("_sorted", i + 1)["at"] == e["at"], F.lit(False)))
    x = x.withColumn("_grid", F.transform(last, lambda e: e["text"]))
    told = lambda c: F.filter(F.transform(F.sequence(F.lit(0), F.col("_end")), lambda r: F.get("_grid", r * F.col("_cols") + c)), lambda t: t != "")
    x = x.withColumn("headers", F.transform(F.sequence(F.lit(0), F.when(F.col("_grid").isNotNull(), F.col("_cols") - 1)), lambda c: F.array_join(F.array_distinct(told(c)), " ")))
    below = F.when(F.col("_grid").isNotNull() & (F.col("_end") < F.col("_rows") - 1), F.col("_rows") - 1)
    rows = F.transform(F.sequence(F.col("_end") + 1, below), lambda r: F.struct((r + 1).alias("row"), F.slice("_grid", r * F.col("_cols") + 1, F.col("_cols")).alias("values")))
    x = x.select(*by, "table", "page", "headers", F.explode(rows).alias("_r")).select(*by, "table", "page", "_r.row", "headers", "_r.values")
    return x.filter(F.exists("values", lambda t: F.trim(t) != ""))


#: Words of a stock state, and the keys of an object that may tell it, in their order.
IN_STOCK, NO_STOCK = ["available", "in stock", "instock", "disponible"], ["unavailable", "out of stock", "outofstock", "agotado", "no disponible"]
STATE_KEYS = ["message", "text", "label", "name", "description", "displayName", "statusText", "stockStatus", "status", "type", "availability", "value"]
STATE_FLAGS = ["available", "isAvailable", "inStock", "isInStock"]


def availability_text(v: Column, depth: int = 2, told: tuple[str, str] = ("En stock", "Sin stock")) -> Column:
    """What a variant says of the stock: a flag, a text, the different texts of a list, or the first key of an object that tells; '' for none.

    Objects and lists are followed ``depth`` levels down.
    """
    kind = F.schema_of_variant(v)
    flag = lambda b: F.when(b, told[0]).otherwise(told[1])
    text = F.trim(F.try_variant_get(v, "$", "string"))
    code = F.translate(F.lower(text), "_-", "  ")
    spoken = F.when(text == "[object Object]", "").when(code.isin(IN_STOCK), told[0]).when(code.isin(NO_STOCK), told[1]).otherwise(text)
    out = F.when(kind == "BOOLEAN", flag(F.try_variant_get(v, "$", "boolean"))).when(kind == "STRING", spoken)
    if depth:
        each = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e: availability_text(e, depth - 1, told))
        out = out.when(F.startswith(kind, F.lit("ARRAY")), F.array_join(F.array_distinct(F.filter(each, lambda t: t != "")), " · "))
        held = F.array(*(F.try_variant_get(v, f"$.{k}", "variant") for k in STATE_KEYS))
        first = F.get(F.filter(F.transform(held, lambda e: availability_text(e, depth - 1, told)), lambda t: t != ""), F.lit(0))
        flags = F.array(*(F.try_variant_get(v, f"$.{k}", "variant") for k in STATE_FLAGS))
        flagged = F.get(F.transform(F.filter(flags, lambda e: F.schema_of_variant(e) == "BOOLEAN"), lambda e: flag(F.try_variant_get(e, "$", "boolean"))), F.lit(0))
        out = out.when(F.startswith(kind, F.lit("OBJECT")), F.coalesce(first, flagged, F.lit("")))
    return F.coalesce(out, F.lit(""))


def lines_of_tables(rows: DataFrame, by: list[str], headers: dict[str, list[str]], key) -> DataFrame:
    """by, row and the named columns of grids whose first row has their headers; rows without a name are left out. key: folds a header."""
    head = rows.filter("row = 0").select(*by, F.transform("values", lambda v: key(v)).alias("_h"))
    place = lambda names: F.array_max(F.transform(F.array(*(F.lit(n) for n in names)), lambda n: F.array_position("_h", n)))
    x = rows.filter("row > 0").join(head, by)
    cell = lambda names: F.when(place(names) > 0, F.nullif(F.trim(F.get("values", (place(names) - 1).cast("int"))), F.lit("")))
    return x.select(*by, "row", *(cell(names).alias(c) for c, names in headers.items())).filter(F.col("name").isNotNull())


def csv_rows(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """Each row as a line of CSV, in one column ``line``."""
    return rows.select("*", F.to_csv(F.struct(*columns)).alias("line"))


def wide_matrix(grid: DataFrame, stores: list[str]) -> DataFrame:
    """item and a column of prices for each store of a stated list."""
    return grid.groupBy("item").pivot("store", stores).agg(F.max("price"))


def promotions(offers: DataFrame, listed: Column) -> DataFrame:
    """offer, kind, price of promotions: one of a card and one of a coupon made from columns, and those of a nested list."""
    made = F.array_compact(F.array(
        F.when(F.col("price_card") > 0, F.struct(F.lit("card").alias("kind"), F.col("price_card").alias("price"))),
        F.when(F.col("price_coupon") > 0, F.struct(F.lit("coupon").alias("kind"), F.col("price_coupon").alias("price"))),
    ))
    return offers.select("offer", F.explode(F.concat(made, listed)).alias("p")).select("offer", "p.*")


def searches_with_results(searches: DataFrame, results: DataFrame, products: DataFrame) -> DataFrame:
    """search_id and its results in order, as an array of structs of what the products are now; empty where it has none."""
    x = results.join(products, "product_id", "left")
    rest = [c for c in products.columns if c != "product_id"]
    nested = x.groupBy("search_id").agg(F.array_sort(F.collect_list(F.struct("position", "product_id", *rest))).alias("results"))
    kind = nested.schema["results"].dataType
    return searches.join(nested, "search_id", "left").withColumn("results", F.coalesce("results", F.array().cast(kind)))


def search_candidates(searches: DataFrame, results: DataFrame, products: DataFrame, each: int = 3) -> DataFrame:
    """query, n, search_id, category and product_ids: the newest search of each query, how often it was made, and its first results with their most frequent category."""
    w = Window.partitionBy("query")
    newest = latest(searches.withColumn("n", F.count("*").over(w)), ["query"], [F.col("at").desc(), F.col("search_id").desc()])
    few = quota(results.join(newest.select("search_id"), "search_id", "left_semi"), ["search_id"], [F.col("position")], each).join(products, "product_id")
    mode = few.groupBy("search_id", "category").agg(F.count("*").alias("c"), F.min("place").alias("p")).groupBy("search_id").agg(F.min_by("category", F.struct(-F.col("c"), "p")).alias("category"))
    ids = few.groupBy("search_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "product_id"))), lambda x: x["product_id"]).alias("product_ids"))
    return newest.join(ids, "search_id").join(mode, "search_id").select("query", "n", "search_id", "category", "product_ids")


def measure_totals(rows: DataFrame, measures: list[str], today: Column, windows: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """measure and its sum in each window of days (day column), 0 for none."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.coalesce(F.col(m), F.lit(0)).cast("long").alias("v")) for m in measures))).alias("m")
    x = rows.select("day", each).select("day", "m.*")
    inside = lambda w: F.col("day").between(F.date_sub(today, w - 1), today)
    return x.groupBy("measure").agg(*(F.coalesce(F.sum(F.when(inside(w), F.col("v"))), F.lit(0)).alias(f"days_{w}") for w in windows))


def top_reasons(rows: DataFrame, reason: str, limit: int = 6) -> DataFrame:
    return rows.groupBy(reason).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), reason).limit(limit)


def bounded_history(points: DataFrame, key: list[str], now: Column, hours: int = 24, most: int = 100) -> DataFrame:
    """The newest points of each key within some hours, one a moment (the last that came), up to a number."""
    x = points.filter(F.col("ts") >= now - F.expr(f"INTERVAL {hours} HOURS"))
    one = latest(x, [*key, "ts"], [F.col("id").desc()])
    return quota(one, key, [F.col("ts").desc()], most)


def review_summary(reviews: DataFrame, key: list[str]) -> DataFrame:
    """key, n, average (1 decimal), commented, newest comment."""
    said = F.trim(F.coalesce("comment", F.lit(""))) != ""
    return reviews.groupBy(*key).agg(F.count("*").alias("n"), F.round(F.avg("stars"), 1).alias("average"), F.count(F.when(said, 1)).alias("commented"), F.max_by("comment", F.when(said, F.struct("ts", "id"))).alias("newest"))


def stale_runs(runs: DataFrame, cutoff: Column) -> DataFrame:
    """Running and unpaused runs without activity since the cutoff, or with none at all."""
    active = F.coalesce("activity", "created")
    return runs.filter((F.col("state") == "running") & ~F.coalesce("paused", F.lit(False)) & (active.isNull() | (active < cutoff)))


def scoped(products: DataFrame, stores: DataFrame) -> DataFrame:
    """store, id, query: catalog rows of each store's groups, each id and each folded query once, the first by place.

    An id of one row is in no other group, so of these only the first of each group
    and query meet the stores.
    """
    rows = products.withColumns({"_q": F.lower(F.trim("query")), "_rows": F.count("*").over(Window.partitionBy("id"))})
    first = latest(rows.filter("_rows = 1"), ["grp", "_q"], [F.col("place"), F.col("id")])
    kept = first.unionByName(rows.filter("_rows > 1")).drop("_rows")
    x = stores.select("store", F.explode(F.array_distinct("groups")).alias("grp")).join(kept, "grp")
    one = latest(x, ["store", "id"], [F.col("place"), F.col("grp")])
    return latest(one, ["store", "_q"], [F.col("place"), F.col("id")]).drop("_q")


def refiltered(groups: DataFrame, words: list[str], stores: list[str] | None) -> DataFrame:
    """Cached offers (grp, store, name, price) again by further words and stores, with the count and lowest price of each group that is left."""
    x = groups
    for w in words:
        x = x.filter(F.contains(F.lower("name"), F.lit(w)))
    if stores:
        x = x.filter(F.col("store").isin(*stores))
    return x.groupBy("grp").agg(F.count("*").alias("offers"), F.min("price").alias("lowest"))


def deal_key(code: Column, store: Column, product_id: Column, name: Column) -> Column:
    """What makes two deals one: the comparison code, else the store's product, else the store and the name."""
    own = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    return F.coalesce(own(code), F.concat(store, F.lit(":"), own(product_id)), F.concat(store, F.lit(":"), F.lower(F.trim(name))))


def ordered_union(a: Column, b: Column) -> Column:
    """The values of two arrays, each once, in the order in which they first stand."""
    return F.array_distinct(F.concat(a, b))


def subset_rank(query: Column, name: Column, brand: Column) -> Column:
    """-1 to 1: whether a name begins with the query's first word or has its brand, less where it says that something is missing."""
    first = F.get(query, F.lit(0))
    return F.when(name.startswith(first), 0.6).otherwise(0.0) + F.when(F.array_contains(query, brand), 0.4).otherwise(0.0) - F.when(F.exists(query, lambda w: F.contains(name, F.concat(F.lit("without "), w))), 1.0).otherwise(0.0)


def subset_confidence(relevance: Column, rank: Column) -> Column:
    """Confidence of a lax match, between 0.72 and 0.79."""
    return F.greatest(F.lit(0.72), F.least(F.lit(0.79), F.lit(0.55) + 0.25 * relevance + 0.1 * F.greatest(F.lit(0.0), rank)))


def search_ready(done: Column, total: Column, offers: Column, seconds: Column) -> Column:
    """Most sources answered, or half with an offer, or some time with several offers."""
    share = done / F.nullif(total, F.lit(0))
    return F.coalesce(share >= 0.8, F.lit(True)) | ((share >= 0.5) & (offers >= 1)) | ((seconds >= 5) & (offers >= 10))


def stores_for(queries: DataFrame, stores: DataFrame) -> DataFrame:
    """query_id, stores: those whose group is one of the query's, in their given order. queries: query_id, groups; stores: store, grp, position."""
    x = queries.select("query_id", F.explode("groups").alias("grp")).join(stores, "grp")
    return x.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("position", "store"))), lambda s: s["store"]).alias("stores"))


def predicted_alerts(forecasts: DataFrame, follows: DataFrame, users: DataFrame, sent: DataFrame, key: list[str]) -> DataFrame:
    """user_id, key of supported drops that an approved user follows and was not told of at this level."""
    x = forecasts.filter("supported").join(follows, key).join(users.filter("approved").select("user_id"), "user_id", "left_semi")
    return x.join(sent.select("user_id", *key, "expected").distinct(), ["user_id", *key, "expected"], "left_anti")


def groups_of_product(products: DataFrame, fields: list[str], known: list[str], resolved: DataFrame, stores: DataFrame) -> DataFrame:
    """product_id, groups: the known store groups that a product's own fields name, in their order; else those its words resolve to; else its store's.

    fields: columns of text, or of arrays of it. resolved: product_id, groups. stores:
    store, grp. A product without any has an empty list.
    """
    kinds = dict(products.dtypes)
    values = F.concat(*(F.coalesce(F.col(f), F.array().cast("array<string>")) if kinds[f].startswith("array") else F.array(F.col(f)) for f in fields))
    folded = F.transform(values, lambda v: F.lower(F.trim(F.coalesce(v, F.lit("")))))
    only = lambda c: F.array_distinct(F.filter(c, lambda g: g.isin(known)))
    x = products.select("product_id", F.lower(F.trim("store")).alias("store"), only(folded).alias("_own"))
    x = x.join(resolved.select("product_id", only(F.col("groups")).alias("_found")), "product_id", "left").join(stores.select("store", F.when(F.col("grp").isin(known), F.array("grp")).alias("_of_store")), "store", "left")
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return x.select("product_id", F.coalesce(some("_own"), some("_found"), "_of_store", F.array().cast("array<string>")).alias("groups"))


def remaining(available: list[str], chosen: DataFrame) -> DataFrame:
    """search_id, store, position: the stores that a search did not choose, in their order. chosen: search_id, store."""
    taken = chosen.groupBy("search_id").agg(F.collect_set(F.lower(F.trim("store"))).alias("_taken"))
    listed = F.array(*(F.struct(F.lit(s).alias("store"), F.lit(i).alias("position")) for i, s in enumerate(available)))
    return taken.select("search_id", F.explode(F.filter(listed, lambda s: ~F.array_contains("_taken", s["store"]))).alias("s")).select("search_id", "s.*")


def points_of_lists(points: DataFrame, order: list[str]) -> DataFrame:
    """points (list_id, ts, ...) of named lists with their place in the list, those without a time first."""
    x = points.withColumn("list_id", F.trim("list_id")).filter("list_id <> ''")
    w = Window.partitionBy("list_id").orderBy(F.col("ts").asc_nulls_first(), *order)
    return x.withColumn("place", F.row_number().over(w))
