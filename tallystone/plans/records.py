"""Registered queries on payloads, tables, exports, searches with results, scopes and readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions import keys
from tallystone.operators import records as R
from tallystone.operators import rules
from tallystone.operators import audit as A
from tallystone.registry import query
from tallystone.sources import html as H
from tallystone.sources import listings as L
from tallystone.sources import sinks as K
from tallystone.sources.storage import shared_folder

from .store import _ALERTS, alerts
from .views import KEY, OFF, offers, table

_P = "p AS (SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_type AS kind, p_size::BIGINT AS n FROM part)"


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").cast("long").alias("n"))


@query(f"WITH {_P} SELECT k::VARCHAR AS product_id, 'k' || k AS sku_id, name, brand, n * 1000 AS price, n * 1500 AS price_normal, CASE WHEN n % 2 = 0 THEN 0 END AS stock FROM p")
def shopify_listing(spark, sf_dir):
    """Payloads of a platform made from the parts and read back."""
    k, n = F.col("k").cast("string"), F.col("n").cast("string")
    v = F.struct(F.concat(F.lit("k"), k).alias("sku"), F.concat(n, F.lit("000")).alias("price"), F.concat(F.lit("$"), (F.col("n") * 1500).cast("string")).alias("compare_at_price"), (F.col("n") % 2 != 0).alias("available"))
    payload = F.to_json(F.struct(k.alias("id"), F.col("name").alias("title"), F.col("brand").alias("vendor"), F.array(v).alias("variants")))
    out = L.json_listing(_parts(spark, sf_dir).select(F.lit("s").alias("store"), payload.alias("payload")), "shopify")
    return out.select("product_id", "sku_id", "name", "brand", "price", "price_normal", F.col("stock").cast("int").alias("stock"))


@query(f"WITH {_P} SELECT brand AS store, (k // 200)::BIGINT AS page, CASE WHEN length(brand) % 2 = 0 THEN length(brand) ELSE 1 END::INT AS total_pages, k::VARCHAR AS id, n * 100 AS price, CASE WHEN n % 3 = 0 THEN n * 120 WHEN n % 3 = 1 THEN n * 110 ELSE n * 100 END AS normal FROM p")
def listing_pages(spark, sf_dir):
    """Nested listing payloads of a brand, a page for every two hundred numbers of parts."""
    n = F.col("n")
    item = F.struct(F.col("k").cast("string").alias("id"), (n * 100).alias("price"), F.when(n % 3 == 0, n * 120).otherwise(n).alias("previous"), F.when(n % 3 == 1, n * 110).otherwise(n).alias("internet"))
    data = _parts(spark, sf_dir).groupBy("brand", F.floor(F.col("k") / 200).alias("page")).agg(F.collect_list(item).alias("products"))
    pages = F.when(F.length("brand") % 2 == 0, F.length("brand"))
    payload = F.to_json(F.struct(F.struct("products", F.struct(pages.alias("pages")).alias("paging")).alias("data")))
    x = R.listing_pages(data.select(F.concat_ws("|", "brand", F.col("page").cast("string")).alias("store"), payload.alias("payload")), "$.data.products", "$.data.paging.pages", "id:string,price:long,previous:long,internet:long")
    return x.select(F.substring_index("store", "|", 1).alias("store"), F.substring_index("store", "|", -1).cast("long").alias("page"), "total_pages", "id", "price", R.aggregator_normal(F.col("price"), F.col("previous"), F.col("internet")).alias("normal"))


@query(f"WITH {_P} SELECT brand, (k // 200)::BIGINT AS page, count(*) OVER (PARTITION BY brand, k // 200)::INT AS total, k::VARCHAR AS product_id, name || ' & <co>' AS name, '/p/' || k || '.html' AS url, CASE WHEN n % 3 = 0 THEN brand END AS maker, n * 1000 + 990 AS price, CASE WHEN n % 2 = 0 THEN n * 2000 END AS price_normal FROM p")
def html_listing(spark, sf_dir):
    """HTML pages of product cards of a brand, a page for every two hundred numbers of parts: nested tags, entities, old prices and missing fields."""
    n, k = F.col("n").cast("string"), F.col("k").cast("string")
    maker = F.when(F.col("n") % 3 == 0, F.concat(F.lit('<span class="brand-name">'), F.col("brand"), F.lit("</span>"))).otherwise("")
    old = F.when(F.col("n") % 2 == 0, F.concat(F.lit('<div class="old-price"><span data-price-amount="'), (F.col("n") * 2000).cast("string"), F.lit('.0000"></span></div>'))).otherwise("")
    card = F.concat(F.lit('<li class="item" data-id="'), k, F.lit('">'), maker, F.lit('<a class="x" href="/p/'), k, F.lit('.html"><b>'), F.col("name"), F.lit("</b> &amp; &lt;co&gt;</a><br>"), old, F.lit('<div><span class="price">$'), n, F.lit(".990</span></div></li>\n"))
    pages = _parts(spark, sf_dir).groupBy("brand", F.floor(F.col("k") / 200).alias("page")).agg(F.concat(F.lit("<ul><li>none</li>"), F.array_join(F.collect_list(card), ""), F.lit("</ul>")).alias("html"))
    return _cards(pages)


def _cards(pages):
    return H.page_cards(pages.withColumnRenamed("brand", "of_brand"), ["of_brand", "page"]).select(F.col("of_brand").alias("brand"), "page", "total", "product_id", "name", "url", F.col("brand").alias("maker"), "price", "price_normal")


@query("""WITH t AS (SELECT page_id, regexp_extract_all(html, '<a\\s+href="[^"]*"[^>]*>[^<]*</a>') AS tags FROM pages), u AS (SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS place FROM t)
SELECT page_id, place::INT AS place, regexp_extract(tag, 'href="([^"]*)"', 1) AS href, regexp_extract(tag, '>([^<]*)</a>', 1) AS label FROM u""")
def parsed_links(spark, sf_dir):
    """Links of all raw pages, by a parser."""
    return H.page_links(table(spark, sf_dir, "pages"), ["page_id"])


@query(f"WITH {_P} SELECT k, n::VARCHAR AS weight, brand AS maker, 'x' || k AS color, 2 AS entries FROM p")
def spec_maps(spark, sf_dir):
    """Attribute lists and flattened texts as maps."""
    s = F.col("n").cast("string")
    m = R.spec_map(F.array(F.lit(" weight "), F.lit("maker"), F.lit("weight"), F.lit("")), F.array(s, F.col("brand"), F.lit("second"), F.lit("none")))
    t = R.parsed_specs(F.concat(F.lit("color: x"), F.col("k").cast("string"), F.lit(" | nothing |size : 1:2")))
    return _parts(spark, sf_dir).select("k", m["weight"].alias("weight"), m["maker"].alias("maker"), t["color"].alias("color"), F.size(t).alias("entries"))


@query(f"WITH {_P} SELECT k, CASE WHEN k % 5 <> 0 THEN name END AS name, CASE WHEN k % 5 <> 0 THEN n * 10 END AS price FROM p")
def embedded_states(spark, sf_dir):
    """Detail pages with their state embedded as JSON; every fifth has none."""
    state = F.to_json(F.struct(F.struct(F.struct(F.col("name").alias("displayName"), (F.col("n") * 10).alias("price")).alias("product")).alias("props")))
    html = F.concat(F.lit("<html><script>var a = 1;</script>\n"), F.when(F.col("k") % 5 != 0, F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), state, F.lit("</script>"))).otherwise(""), F.lit("</html>"))
    s = L.embedded_state(html)
    return _parts(spark, sf_dir).select("k", F.get_json_object(s, "$.props.product.displayName").alias("name"), F.get_json_object(s, "$.props.product.price").cast("long").alias("price"))


@query(f"WITH {_P} SELECT k::VARCHAR AS n, name AS query, CASE WHEN n % 2 = 0 THEN brand END AS category FROM p WHERE k % 7 <> 0")
def imported_rows(spark, sf_dir):
    """A CSV with its own delimiter and headers, written and imported; rows without a query are left out."""
    p = _parts(spark, sf_dir)
    path = shared_folder(spark) + "/list.csv"
    p.select(F.col("k").alias("Nº"), F.when(F.col("k") % 7 != 0, F.col("name")).alias("Producto"), F.when(F.col("n") % 2 == 0, F.col("brand")).alias("Categoría")).write.option("header", True).option("sep", ";").csv(path)
    return L.read_import(spark, path, {"n": ["nº", "orden"], "query": ["producto", "name"], "category": ["categoria"]})


@query(f"WITH {_P} SELECT k::VARCHAR AS id, name, a AS alias, CASE WHEN k % 3 = 0 THEN NULL ELSE brand END AS grp FROM p, unnest([lower(name), kind]) t(a)")
def seeded_products(spark, sf_dir):
    """A JSON seed of generic products, written and read."""
    path = shared_folder(spark) + "/seed"
    none = F.array().cast("array<string>")
    _parts(spark, sf_dir).select(F.col("k").cast("string").alias("id"), "name", F.array(F.lower("name"), F.col("kind")).alias("aliases"), F.when(F.col("k") % 3 != 0, F.array("brand")).otherwise(none).alias("groups")).write.json(path)
    return L.read_seed(spark, path, lines=True).select("id", "name", "alias", F.col("group").alias("grp"))


@query(f"WITH {_P} SELECT k::VARCHAR AS id, name AS query, kind AS category FROM p WHERE n % 4 <> 0")
def active_catalog(spark, sf_dir):
    """A JSON catalog of queries, written and read; disabled ones are left out."""
    path = shared_folder(spark) + "/catalog"
    _parts(spark, sf_dir).select(F.col("k").cast("string").alias("id"), F.col("name").alias("query"), F.col("kind").alias("category"), F.when(F.col("n") % 4 == 0, F.lit(False)).alias("enabled")).write.json(path)
    return spark.read.schema("id string, query string, category string, enabled boolean").json(path).filter(F.coalesce("enabled", F.lit(True))).select("id", "query", "category")


@query("SELECT l_orderkey AS quote, l_linenumber AS row, 'p' || l_partkey AS name, l_quantity::BIGINT::VARCHAR AS quantity, CASE WHEN l_linenumber <> 2 THEN round(l_extendedprice)::BIGINT::VARCHAR END AS unit_price FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1")
def quote_tables(spark, sf_dir):
    """Orders as tables of cells with header rows, put together and read as quote lines."""
    l = K.first_of_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])  # noqa: E741
    cell = lambda col, text: F.struct(F.lit(col).alias("col"), text.alias("text"))
    body = l.select(F.col("l_orderkey").alias("quote"), F.col("l_linenumber").alias("row"), F.explode(F.array(cell(0, F.concat(F.lit("p"), F.col("l_partkey").cast("string"))), cell(2, F.col("l_quantity").cast("long").cast("string")), cell(1, F.when(F.col("l_linenumber") != 2, F.round("l_extendedprice").cast("long").cast("string")).otherwise(" ")))).alias("c"))
    head = l.select(F.col("l_orderkey").alias("quote")).distinct().select("quote", F.lit(0).alias("row"), F.explode(F.array(cell(0, F.lit("Descripción")), cell(1, F.lit("Precio Unitario")), cell(2, F.lit("Cant.")))).alias("c"))
    rows = R.grids(body.unionByName(head).select("quote", "row", "c.*"), ["quote"])
    return R.lines_of_tables(rows, ["quote"], {"name": ["name", "producto", "descripcion"], "quantity": ["quantity", "cantidad", "cant"], "unit_price": ["unitprice", "preciounitario", "precio"]}, keys.column_key)


@query("""WITH l AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1), t AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM l)
SELECT l_orderkey AS quote, 1 AS "table", (l_orderkey % 9)::INT AS page, (i + 2)::INT AS row, 'Item Nombre/Item Código/Precio Neto' AS headers, CASE WHEN l_linenumber = 2 THEN 'Subtotal/Subtotal/' || round(l_extendedprice)::BIGINT ELSE 'p' || l_partkey || '/' || l_suppkey || '/' || CASE WHEN l_linenumber = 3 THEN '' ELSE round(l_extendedprice)::BIGINT::VARCHAR END END AS "values" FROM t WHERE l_orderkey % 10 <> 0 AND l_orderkey % 11 <> 0""")
def document_tables(spark, sf_dir):
    """Orders as JSON documents with one table: a title over two columns, a second header row, subtotals over two columns, missing cells; some are damaged or of another kind."""
    l = K.first_of_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])  # noqa: E741

    def cell(text, r, c, height=1, width=1, header=False):
        r = F.lit(r) if isinstance(r, int) else r
        return F.struct(text.cast("string").alias("text"), r.alias("start_row_offset_idx"), (r + height).alias("end_row_offset_idx"), F.lit(c).alias("start_col_offset_idx"), F.lit(c + width).alias("end_col_offset_idx"), F.lit(header).alias("column_header"))

    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.round("l_extendedprice").cast("long").alias("price"))))
    head = F.array(cell(F.lit("Item"), 0, 0, 1, 2, True), cell(F.lit("Precio"), 0, 2, 2, 1, True), cell(F.lit("Nombre"), 1, 0, header=True), cell(F.lit("Código"), 1, 1, header=True), cell(F.lit("Precio"), 0, 2, 1, 1, True), cell(F.lit("Neto"), 1, 2, header=True))
    row = lambda x, i: F.when(x["l_linenumber"] == 2, F.array(cell(F.lit("Subtotal"), i + 2, 0, 1, 2), cell(x["price"], i + 2, 2))).when(x["l_linenumber"] == 3, F.array(cell(F.concat(F.lit("p"), x["l_partkey"].cast("string")), i + 2, 0), cell(x["l_suppkey"], i + 2, 1))).otherwise(F.array(cell(F.concat(F.lit("p"), x["l_partkey"].cast("string")), i + 2, 0), cell(x["l_suppkey"], i + 2, 1), cell(x["price"], i + 2, 2)))
    q = l.groupBy("l_orderkey").agg(lines.alias("x"))
    data = F.struct((F.size("x") + 2).alias("num_rows"), F.lit(3).alias("num_cols"), F.concat(head, F.flatten(F.transform("x", row))).alias("table_cells"))
    payload = F.to_json(F.struct(F.when(F.col("l_orderkey") % 11 == 0, "Other").otherwise("Doc").alias("schema_name"), F.array(F.struct(data.alias("data"), F.array(F.struct((F.col("l_orderkey") % 9).alias("page_no"))).alias("prov"))).alias("tables")))
    docs = q.select(F.col("l_orderkey").alias("quote"), F.when(F.col("l_orderkey") % 10 == 0, F.concat(F.lit("{"), payload)).otherwise(payload).alias("payload"))
    out = R.document_tables(docs, ["quote"], "Doc")
    return out.select("quote", "table", "page", "row", F.array_join("headers", "/").alias("headers"), F.array_join("values", "/").alias("values"))


@query("""SELECT p_partkey AS id, ['En stock', 'Sin stock', p_name, 'Sin stock · ' || p_brand, 'En stock', ''][p_partkey % 6 + 1] AS said FROM part""")
def availability_texts(spark, sf_dir):
    """Stock states as JSON of several shapes made from the parts."""
    k = F.col("p_partkey") % 6
    shape = F.when(k == 0, F.lit("true")).when(k == 1, F.to_json(F.struct(F.struct(F.lit("OUT_OF_STOCK").alias("status")).alias("availability")))).when(k == 2, F.to_json(F.struct(F.lit("").alias("message"), F.col("p_name").alias("label"))))
    shape = shape.when(k == 3, F.concat(F.lit('["agotado", "[object Object]", "unavailable", '), F.to_json(F.struct(F.col("p_brand").alias("text"))), F.lit("]"))).when(k == 4, F.lit('{"inStock": true, "other": "x"}')).otherwise(F.lit('{"n": 3}'))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), R.availability_text(F.try_parse_json(shape)).alias("said"))


@query("SELECT page_id, unnest([url, 'http://x/' || page_id]) AS loc FROM pages WHERE NOT regexp_matches(url, '[<\\s]')")
def sitemap_locations(spark, sf_dir):
    xml = F.concat(F.lit("<urlset>\n<url><loc>"), F.col("url"), F.lit("</loc></url><url>\n<loc> http://x/"), F.col("page_id").cast("string"), F.lit(" </loc></url></urlset>"))
    return table(spark, sf_dir, "pages").filter(~F.col("url").rlike(r"[<\s]")).select("page_id", F.explode(L.sitemap_locations(xml)).alias("loc"))


@query(f"WITH {_P} SELECT k, k || ',' || name || ',' || n AS line FROM p")
def exported_lines(spark, sf_dir):
    return R.csv_rows(_parts(spark, sf_dir), [F.col("k"), F.col("name"), F.col("n")]).select("k", "line")


@query(f"WITH {_P} SELECT k::VARCHAR AS k, name, n::VARCHAR AS n FROM p UNION ALL SELECT k::VARCHAR, name, 'json' FROM p WHERE k % 2 = 0")
def exports_read_back(spark, sf_dir):
    """Exports as CSV and JSON files, read again."""
    p, folder = _parts(spark, sf_dir), shared_folder(spark)
    K.export_csv(p, folder + "/csv", ["k", "name", "n"])
    K.export_json(p.filter("k % 2 = 0"), folder + "/json")
    csv = spark.read.csv(folder + "/csv", header=True)
    return csv.unionByName(spark.read.schema("k string, name string").json(folder + "/json").withColumn("n", F.lit("json")))


@query(f"WITH {OFF} SELECT product_id AS item, max(price) FILTER (WHERE store = 's0') AS s0, max(price) FILTER (WHERE store = 's1') AS s1, max(price) FILTER (WHERE store = 's2') AS s2 FROM off GROUP BY 1")
def wide_matrix(spark, sf_dir):
    return R.wide_matrix(offers(spark, sf_dir).select(F.col("product_id").alias("item"), "store", "price"), ["s0", "s1", "s2"])


@query("SELECT doc_id, quality::VARCHAR AS label_a, toxic::VARCHAR AS label_b FROM labels")
def pivoted_reviews(spark, sf_dir):
    x = table(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(F.struct(F.lit("r1").alias("reviewer"), F.col("quality").cast("string").alias("label")), F.struct(F.lit("r2").alias("reviewer"), F.col("toxic").cast("string").alias("label")))).alias("r")).select("doc_id", "r.*")
    return A.pivoted(x, "doc_id", F.col("reviewer"), "label")


@query(f"WITH {OFF} SELECT store || product_id AS offer, 'card' AS kind, price_card AS price FROM off WHERE price_card > 0 UNION ALL SELECT store || product_id, 'coupon', price - 10 FROM off WHERE product_id % 5 = 0 AND price > 10 UNION ALL SELECT store || product_id, 'bank', price - 20 FROM off WHERE product_id % 2 = 0")
def promotion_records(spark, sf_dir):
    o = offers(spark, sf_dir).select(F.concat("store", F.col("product_id").cast("string")).alias("offer"), "product_id", "price", "price_card", F.when(F.col("product_id") % 5 == 0, F.col("price") - 10).alias("price_coupon"))
    bank = F.struct(F.lit("bank").alias("kind"), (F.col("price") - 20).alias("price"))
    return R.promotions(o, F.when(F.col("product_id") % 2 == 0, F.array(bank)).otherwise(F.array().cast("array<struct<kind:string,price:bigint>>")))


_RES = "rs AS (SELECT DISTINCT l_orderkey AS search_id, l_partkey AS product_id FROM lineitem), rp AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY product_id) AS position FROM rs)"


def _results(spark, sf_dir):
    from pyspark.sql import Window

    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("search_id"), F.col("l_partkey").alias("product_id")).distinct()
    return r.withColumn("position", F.row_number().over(Window.partitionBy("search_id").orderBy("product_id")))


@query(f"WITH {_RES}, n AS (SELECT search_id, string_agg(product_id || ':' || p_brand, ',' ORDER BY position) AS results FROM rp JOIN part ON p_partkey = product_id GROUP BY 1) SELECT o_orderkey AS search_id, coalesce(results, '') AS results FROM orders LEFT JOIN n ON search_id = o_orderkey")
def searches_with_results(spark, sf_dir):
    searches = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("search_id"))
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"))
    out = R.searches_with_results(searches, _results(spark, sf_dir), products)
    return out.select("search_id", F.array_join(F.transform("results", lambda r: F.concat(r["product_id"].cast("string"), F.lit(":"), r["brand"])), ",").alias("results"))


@query(f"""WITH {_RES}, s AS (SELECT o_orderkey AS search_id, 'q' || o_custkey AS query, o_orderdate AS at_, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY at_ DESC, search_id DESC) = 1),
f AS (SELECT rp.search_id, product_id, p_type AS category, row_number() OVER (PARTITION BY rp.search_id ORDER BY position) AS place FROM rp JOIN l USING (search_id) JOIN part ON p_partkey = product_id QUALIFY place <= 3), m AS (SELECT search_id, category, count(*) AS c, min(place) AS p FROM f GROUP BY ALL)
SELECT query, n, l.search_id, (SELECT arg_min(category, (-c, p)) FROM m WHERE m.search_id = l.search_id) AS category, string_agg(product_id::VARCHAR, ',' ORDER BY place) AS product_ids FROM l JOIN f USING (search_id) GROUP BY ALL""")
def search_candidates(spark, sf_dir):
    searches = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("search_id"), F.concat(F.lit("q"), F.col("o_custkey").cast("string")).alias("query"), F.col("o_orderdate").alias("at"))
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"))
    out = R.search_candidates(searches, _results(spark, sf_dir), products)
    return out.withColumn("product_ids", F.array_join(F.transform("product_ids", lambda x: x.cast("string")), ","))


@query("""WITH d AS (SELECT ts::DATE AS day, 1 AS scraped, CASE WHEN event_type = 'click' THEN 1 END AS price_updated, CASE WHEN value > 50 THEN 1 ELSE 0 END AS discount_updated FROM events), u AS (SELECT day, 'scraped' AS measure, scraped AS v FROM d UNION ALL SELECT day, 'price_updated', coalesce(price_updated, 0) FROM d UNION ALL SELECT day, 'discount_updated', discount_updated FROM d)
SELECT measure, coalesce(sum(v) FILTER (WHERE day = DATE '2024-01-30'), 0)::BIGINT AS days_1, coalesce(sum(v) FILTER (WHERE day BETWEEN DATE '2024-01-24' AND DATE '2024-01-30'), 0)::BIGINT AS days_7, coalesce(sum(v) FILTER (WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'), 0)::BIGINT AS days_30 FROM u GROUP BY 1""")
def scrape_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.lit(1).alias("scraped"), F.when(F.col("event_type") == "click", 1).alias("price_updated"), F.when(F.col("value") > 50, 1).otherwise(0).alias("discount_updated"))
    return R.measure_totals(rows, ["scraped", "price_updated", "discount_updated"], F.lit("2024-01-30").cast("date"))


@query("SELECT o_orderpriority AS reason, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1 ORDER BY n DESC, reason LIMIT 6")
def discard_reasons(spark, sf_dir):
    return R.top_reasons(table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderpriority").alias("reason")), "reason")


@query("WITH o AS (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS ts, event_id FROM events WHERE date_trunc('hour', ts) >= TIMESTAMP '2024-01-25') SELECT user_id, ts, id FROM (SELECT user_id, ts, max(event_id) AS id FROM o GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 3")
def host_history(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("id"))
    return R.bounded_history(e, ["user_id"], F.lit("2024-01-30").cast("timestamp"), hours=120, most=3).select("user_id", "ts", "id")


@query("""WITH r AS (SELECT user_id % 20 AS product_id, (event_id % 5) + 1 AS stars, CASE WHEN event_id % 3 = 0 THEN 'c' || event_id END AS comment, ts, event_id AS id FROM events) SELECT product_id, count(*) AS n, round(avg(stars), 1) AS average, count(comment) AS commented, arg_max(comment, (ts, id)) FILTER (WHERE comment IS NOT NULL) AS newest FROM r GROUP BY 1""")
def review_summaries(spark, sf_dir):
    k = F.col("event_id")
    r = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("product_id"), (k % 5 + 1).alias("stars"), F.when(k % 3 == 0, F.concat(F.lit("c"), k.cast("string"))).otherwise(" ").alias("comment"), F.col("ts").cast("timestamp").alias("ts"), k.alias("id"))
    return R.review_summary(r, ["product_id"])


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 5 <> 0 AND (o_orderkey % 7 = 0 OR o_orderdate < TIMESTAMP '1997-01-01')")
def stale_runs(spark, sf_dir):
    k = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(F.col("o_orderstatus") == "O", "running").alias("state"), F.when(k % 5 == 0, True).alias("paused"), F.lit(None).cast("timestamp").alias("activity"), F.when(k % 7 != 0, F.col("o_orderdate").cast("timestamp")).alias("created"))
    return R.stale_runs(runs, F.lit("1997-01-01").cast("timestamp")).select("id")


@query("""WITH s AS (SELECT n_nationkey AS store, unnest([n_regionkey, (n_regionkey + 1) % 5]) AS grp FROM nation), p AS (SELECT p_partkey AS id, lower(p_type) AS query, p_size % 5 AS grp, p_size AS place FROM part), x AS (SELECT store, id, query, place FROM s JOIN p USING (grp)) SELECT store, id FROM x QUALIFY row_number() OVER (PARTITION BY store, query ORDER BY place, id) = 1""")
def store_scopes(spark, sf_dir):
    r = F.col("n_regionkey")
    stores = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("store"), F.array(r, (r + 1) % 5).alias("groups"))
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("query"), (F.col("p_size") % 5).alias("grp"), F.col("p_size").alias("place"))
    return R.scoped(products, stores).select("store", "id")


@query(f"WITH {OFF} SELECT product_id AS grp, count(*) AS offers, min(price) AS lowest FROM off WHERE contains(lower(name), 'red') AND store IN ('s0', 's1', 's3') GROUP BY 1")
def refiltered_results(spark, sf_dir):
    return R.refiltered(offers(spark, sf_dir).withColumnRenamed("product_id", "grp"), ["red"], ["s0", "s1", "s3"])


@query(f"""WITH {_ALERTS} SELECT category, store, arg_min(id, (-saving, id)) AS id, max(saving) AS saving FROM al WHERE rule <> 'watch_target' GROUP BY ALL""")
def strongest_alerts(spark, sf_dir):
    a = alerts(spark, sf_dir).filter("rule <> 'watch_target'")
    return rules.strongest(a, ["category", "store"], [F.col("saving").desc(), F.col("id")]).select("category", "store", "id", "saving")


@query("""SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'c' || user_id WHEN 1 THEN 's:' || event_id ELSE 's:name ' || (event_id % 10) END AS deal, array_to_string(list_distinct_keep, ',') AS groups, done * 10 >= total * 8 OR (done * 10 >= total * 5 AND offers >= 1) OR (seconds >= 5 AND offers >= 10) AS ready
FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN ['a', 'b', 'x' || (event_id % 4)] ELSE ['a', 'b'] END AS list_distinct_keep, event_id % 11 AS done, 10 AS total, event_id % 13 AS offers, event_id % 8 AS seconds FROM events)""")
def deal_keys_and_readiness(spark, sf_dir):
    k = F.col("event_id")
    deal = R.deal_key(F.when(k % 3 == 0, F.concat(F.lit("c"), F.col("user_id").cast("string"))), F.lit("s"), F.when(k % 3 == 1, k.cast("string")), F.concat(F.lit(" Name "), (k % 10).cast("string")))
    groups = R.ordered_union(F.array(F.lit("a"), F.lit("b")), F.when(k % 2 == 0, F.array(F.lit("b"), F.concat(F.lit("x"), (k % 4).cast("string")), F.lit("a"))).otherwise(F.array(F.lit("a"))))
    return table(spark, sf_dir, "events").select(k.alias("id"), deal.alias("deal"), F.array_join(groups, ",").alias("groups"), R.search_ready(k % 11, F.lit(10), k % 13, k % 8).alias("ready"))


@query(f"""WITH {_P}, w AS (SELECT *, string_split(lower(name), ' ') AS w, lower(brand) AS b FROM p), q AS (SELECT *, CASE WHEN k % 3 = 0 THEN 0.6 ELSE 0.0 END + CASE WHEN k % 2 = 0 THEN 0.4 ELSE 0.0 END - CASE WHEN k % 5 = 0 THEN 1.0 ELSE 0.0 END AS r FROM w)
SELECT k, round(r::DOUBLE, 6) AS rank, round(greatest(0.72, least(0.79, 0.55 + 0.25 * ((n % 10) / 10::DOUBLE) + 0.1 * greatest(0.0, r)))::DOUBLE, 6) AS confidence FROM q""")
def lax_matches(spark, sf_dir):
    """Words of a part's name as a query, its first word leading or not; names that lack one of them, and brands that the query says or not."""
    k = F.col("k")
    first, second = F.lower(F.get(F.split("name", " "), F.lit(0))), F.lower(F.get(F.split("name", " "), F.lit(1)))
    maker = F.regexp_replace(F.lower("brand"), "#", "x")
    name = F.concat(F.when(k % 3 == 0, F.concat_ws(" ", first, second)).otherwise(F.concat_ws(" ", F.lit("one"), first, second)), F.when(k % 5 == 0, " without salt").otherwise(""))
    words = F.array(first, F.lit("salt"), F.when(k % 2 == 0, maker).otherwise("other"))
    rank = R.subset_rank(words, name, maker)
    return _parts(spark, sf_dir).select("k", F.round(rank, 6).alias("rank"), F.round(R.subset_confidence(F.col("n") % 10 / 10, rank), 6).alias("confidence"))


@query("""WITH q AS (SELECT c_custkey AS query_id, unnest([c_custkey % 5, (c_custkey + 2) % 5]) AS grp FROM customer) SELECT query_id, string_agg(n_name, ',' ORDER BY n_nationkey) AS stores FROM q JOIN nation ON n_regionkey = grp GROUP BY 1""")
def stores_of_queries(spark, sf_dir):
    k = F.col("c_custkey")
    q = table(spark, sf_dir, "customer").select(k.alias("query_id"), F.array(k % 5, (k + 2) % 5).alias("groups"))
    stores = table(spark, sf_dir, "nation").select(F.col("n_name").alias("store"), F.col("n_regionkey").cast("long").alias("grp"), F.col("n_nationkey").alias("position"))
    return R.stores_for(q, stores).select("query_id", F.array_join("stores", ",").alias("stores"))


@query("SELECT c_custkey AS user_id, p_partkey AS product_id FROM customer JOIN part ON p_partkey = c_custkey % 200 WHERE p_size > 20 AND c_custkey % 6 <> 0 AND c_custkey % 4 <> 0")
def predicted_alerts(spark, sf_dir):
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), (F.col("p_size") > 20).alias("supported"), F.col("p_size").alias("expected"))
    c = F.col("c_custkey")
    follows = table(spark, sf_dir, "customer").select(c.alias("user_id"), (c % 200).alias("product_id"))
    users = table(spark, sf_dir, "customer").select(c.alias("user_id"), (c % 6 != 0).alias("approved"))
    sent = follows.filter("user_id % 4 = 0").join(f.select("product_id", "expected"), "product_id")
    return R.predicted_alerts(f, follows, users, sent, ["product_id"]).select("user_id", "product_id")


@query("SELECT c_custkey AS user_id, c_acctbal > 5000 AS in_range FROM customer")
def price_ranges(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), rules.in_range(F.col("c_acctbal"), low=5000.01, high=None).alias("in_range"))
