"""Registered queries on keys, links, measures and memberships."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions import commerce, keys, money, text
from tallystone.operators import offers as O
from tallystone.registry import query

from .views import OFF, offers, table

#: Spellings in this corpus.
ALIASES = {"steel": ["acero", "stl"], "copper": ["cobre"], "small": ["mini", "pequeno"]}
_PARTS = "p AS (SELECT p_partkey AS id, lower(p_name) AS name, lower(p_type) AS kind, p_size AS size, p_retailprice AS price FROM part)"


@query("""SELECT p_partkey AS id, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: CASE WHEN w IN ('steel', 'acero', 'stl') THEN 'steel' WHEN w IN ('copper', 'cobre') THEN 'copper' WHEN w IN ('small', 'mini', 'pequeno') THEN 'small' ELSE w END), ' ') AS canonical,
  list_sum(list_transform(string_split(lower(p_type), ' '), lambda w: CASE WHEN w IN ('steel', 'small') THEN 3 WHEN w = 'copper' THEN 2 ELSE 1 END))::INT AS spellings, regexp_matches(lower(p_type), '(^| )(steel|acero|stl)( |$)') AS found FROM part""")
def token_aliases(spark, sf_dir):
    words = F.split(F.lower("p_type"), " ")
    spelled = F.aggregate(words, F.lit(0), lambda n, w: n + F.size(keys.equivalents(w, ALIASES)))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.transform(words, lambda w: keys.canonical_token(w, ALIASES)), " ").alias("canonical"), spelled.alias("spellings"), keys.matches_any_spelling(words, F.array(F.lit("acero")), ALIASES).alias("found"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'steel Tazón' WHEN 1 THEN 'copper ' || c_custkey ELSE 'small Mesa' END AS query,
  substr(sha256('{"source":"web","stores":["a' || (c_custkey % 7) || '","b"],"max":' || (c_custkey % 50) || ',"band":' || (c_custkey % 2 = 0)::VARCHAR || '}'), 1, 16) AS scope FROM customer""")
def rewritten_queries(spark, sf_dir):
    k = F.col("c_custkey")
    q = F.when(k % 3 == 0, " Acero   Tazón").when(k % 3 == 1, F.concat(F.lit("cobre  "), k.cast("string"))).otherwise("Pequeno Mesa ")
    scope = keys.scope_digest(F.lit("web"), F.array(F.lit("B"), F.concat(F.lit("A"), (k % 7).cast("string"))), k % 50, k % 2 == 0)
    return table(spark, sf_dir, "customer").select(k.alias("id"), keys.rewritten_query(q, ALIASES).alias("query"), scope.alias("scope"))


@query("""WITH p AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS w, p_size AS n FROM part), x AS (SELECT *, id % 4 AS k, length(w[2]) AS l FROM p)
SELECT id, CASE k WHEN 0 THEN true WHEN 1 THEN l >= 3 WHEN 2 THEN false ELSE len(w) = 2 AND w[1] = w[2] END AS typo, CASE k WHEN 0 THEN true WHEN 1 THEN n % 10 = 0 WHEN 2 THEN len(list_distinct(w)) > 0 ELSE n % 10 = 0 END AS compatible FROM x""")
def query_pairs(spark, sf_dir):
    """Names of parts as queries beside themselves: as they are, with a doubled letter and another size, with two changes, and turned round."""
    k, n = F.col("p_partkey") % 4, F.col("p_size")
    w = F.split("p_name", " ")
    last = F.get(w, F.lit(1))
    doubled = F.array(F.get(w, F.lit(0)), F.concat(last, F.substring(last, -1, 1)))
    right = F.when(k == 0, w).when(k == 1, doubled).when(k == 2, F.transform(w, lambda x: F.concat(x, F.lit("q"), F.lit("x")))).otherwise(F.reverse(w))
    sized = lambda amount: F.concat("p_name", F.lit(" "), amount.cast("string"), F.lit("gb"))
    other = F.when(k == 0, sized(n)).when(k == 1, sized(n - n % 10 + 0 * n)).when(k == 2, F.col("p_name")).otherwise(sized(n - n % 10))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), keys.typo_equivalent(w, right).alias("typo"), keys.compatible_queries(sized(n), other).alias("compatible"))


@query("""WITH s AS (SELECT c_custkey AS id, ['sodimac', 'sodimac', 'falabella', 'tottus', 'paris', 'easy', 'shop' || c_custkey][c_custkey % 7 + 1] AS store FROM customer)
SELECT id, store, CASE WHEN store IN ('falabella', 'sodimac', 'tottus') THEN 'falabella' WHEN store IN ('paris', 'easy') THEN 'cencosud' END AS family, CASE WHEN store IN ('falabella', 'sodimac', 'tottus') THEN 'falabella' WHEN store IN ('paris', 'easy') THEN 'cencosud' ELSE store END AS retailer, store IN ('falabella', 'sodimac', 'tottus') AS like_falabella,
  CASE WHEN id % 7 = 5 THEN 'otro' ELSE lower(['homecenter sodimac', 'www.sodimac.cl', 'falabella chile', 'tottus', 'paris.cl', 'easy', 'shop' || id][id % 7 + 1]) END AS shown, CASE WHEN id % 7 = 5 THEN 'Otro' ELSE ['Homecenter Sodimac', 'www.sodimac.cl', 'Falabella', 'Tottus', 'paris.cl', 'Easy', 'Shop' || id][id % 7 + 1] END AS title FROM s""")
def store_names(spark, sf_dir):
    k = F.col("c_custkey")
    labels = ["Homecenter Sodimac", "www.sodimac.cl", "Falabella  Chile", "Tottus", "paris.cl", "Easy"]
    label = F.element_at(F.array(*(F.lit(x) for x in labels), F.concat(F.lit("Shop"), k.cast("string"))), (k % 7 + 1).cast("int"))
    shown = keys.public_store(label, F.lit(None).cast("string"), ["easy"])
    return table(spark, sf_dir, "customer").select(k.alias("id"), keys.store_id(label).alias("store"), keys.store_family(label).alias("family"), keys.retailer_key(label).alias("retailer"), keys.same_retailer(label, F.lit("Falabella")).alias("like_falabella"), shown["id"].alias("shown"), shown["title"].alias("title"))


@query("""SELECT page_id, coalesce(nullif(rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)[:80], '/'), ''), CASE WHEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '' ELSE '/' END) AS origin, '/producto?store=' || replace(url_encode('a b' || (page_id % 3)), '%20', '+') || '&id=' || page_id AS path,
  CASE page_id % 4 WHEN 0 THEN 'https://shop.example/x/' || page_id WHEN 1 THEN 'https://cdn.example/y' WHEN 2 THEN url ELSE 'https://shop.example/slug/p' END AS link, CASE page_id % 2 WHEN 0 THEN 'https://shop.example/a.jpg,https://cdn.example/b.jpg' ELSE 'https://shop.example/a.jpg' END AS images FROM pages""")
def page_links(spark, sf_dir):
    k, u = F.col("page_id"), F.col("url")
    raw = F.when(k % 4 == 0, F.concat(F.lit("/x/"), k.cast("string"))).when(k % 4 == 1, "//cdn.example/y").when(k % 4 == 2, u).otherwise(" ")
    base = F.lit("https://shop.example/")
    gallery = F.array(F.array(F.lit("a.jpg"), F.when(k % 2 == 0, F.lit("//cdn.example/b.jpg"))), F.array(F.lit("/a.jpg"), F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", keys.origin_path(u).alias("origin"), keys.product_path(F.concat(F.lit("a b"), (k % 3).cast("string")), k).alias("path"), keys.repaired_url(base, raw, F.lit("slug")).alias("link"), F.array_join(keys.image_urls(gallery, base), ",").alias("images"))


@query("""SELECT event_id AS id, ['preciounitario', 'codigobarras', 'descripcion'][event_id % 3 + 1] AS header, CASE event_id % 3 WHEN 0 THEN 'c' || user_id WHEN 1 THEN 'product:s:' || event_id ELSE 'name:view ' || event_type END AS entity FROM events""")
def header_and_entity_keys(spark, sf_dir):
    k = F.col("event_id")
    header = F.element_at(F.array(F.lit(" Precio Unitario ($)"), F.lit("Código  Barras"), F.lit("DESCRIPCIÓN:")), (k % 3 + 1).cast("int"))
    entity = keys.entity_key(F.when(k % 3 == 0, F.concat(F.lit("c"), F.col("user_id").cast("string"))), F.lit("s"), F.when(k % 3 == 1, k.cast("string")).otherwise(" "), F.concat(F.lit("  View "), F.col("event_type")))
    return table(spark, sf_dir, "events").select(k.alias("id"), keys.column_key(header).alias("header"), entity.alias("entity"))


@query(f"""WITH {OFF} SELECT store, product_id, price || ':' || price_normal AS signature, greatest(price, shipping_cost)::DOUBLE / nullif(least(price, shipping_cost), 0) AS ratio,
  CASE product_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS want, CASE WHEN price BETWEEN 20000 AND 50000 THEN NULL WHEN price < 20000 THEN CASE WHEN product_id % 3 = 1 THEN 'below_high' ELSE 'below' END ELSE CASE WHEN product_id % 3 = 0 THEN 'above_low' ELSE 'above' END END AS conflict FROM off""")
def price_band_conflicts(spark, sf_dir):
    k = F.col("product_id")
    want = keys.preference(F.when(k % 3 == 0, "televisor BARATO gamer").when(k % 3 == 1, "Silla  gamer").otherwise("silla"))
    band = keys.band_conflict(F.col("price"), F.lit(20000), F.lit(50000), want)
    return offers(spark, sf_dir).select("store", "product_id", keys.price_signature(F.col("price"), F.col("price_normal")).alias("signature"), keys.price_ratio(F.col("price"), F.col("shipping_cost")).alias("ratio"), want.alias("want"), band.alias("conflict"))


@query("""WITH k AS (SELECT p_partkey AS id, p_size AS n, p_partkey % 6 AS c FROM part)
SELECT id, CASE c WHEN 0 THEN n * 0.001 WHEN 1 THEN n + 0.5 WHEN 2 THEN n WHEN 3 THEN n WHEN 4 THEN NULL ELSE n * 0.001 END::DOUBLE AS amount, CASE c WHEN 0 THEN 'kg' WHEN 1 THEN 'litro' WHEN 2 THEN 'unidad' WHEN 3 THEN 'pack' WHEN 5 THEN 'litro' END AS unit,
  CASE c WHEN 0 THEN n * 1000 + 990 WHEN 1 THEN n WHEN 2 THEN n * 1000 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE n END::BIGINT AS money, CASE WHEN c IN (2, 3) THEN n * 100 WHEN c IN (0) THEN 200 WHEN c IN (1, 4) THEN NULL END::BIGINT AS each, CASE WHEN c = 1 THEN 'unit_mismatch' WHEN c = 4 THEN 'measure_unknown' WHEN c = 5 THEN 'price' END AS issue FROM k""")
def quote_cells(spark, sf_dir):
    k, n = F.col("p_partkey") % 6, F.col("p_size").cast("long")
    s = n.cast("string")
    cell = F.when(k == 0, F.concat(s, F.lit(" grs."))).when(k == 1, F.concat(s, F.lit(",5 Lts"))).when(k == 2, s).when(k == 3, F.concat(F.lit(" "), s, F.lit(" packs"))).when(k == 4, F.concat(s, F.lit(" bolsas"))).otherwise(F.concat(s, F.lit("cc")))
    sum_ = F.when(k == 0, F.concat(F.lit("$ "), s, F.lit(".990"))).when(k == 1, s).when(k == 2, F.concat(F.lit("CLP "), s, F.lit(".000"))).when(k == 3, F.concat(s, F.lit(",50"))).when(k == 4, F.lit("0")).otherwise(s)
    line = F.when(k == 0, "kg").when(k == 1, "litro").when(k == 2, "unidad").when(k == 3, "pack").when(k == 4, "metro").otherwise("unidad")
    price = keys.unit_price(line, F.when(k != 5, n * 100), F.when(k != 4, "kg"), (n * 0.5).cast("double"))
    q = keys.quantity_cell(cell)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), q["amount"].alias("amount"), q["unit"].alias("unit"), keys.money_cell(sum_).alias("money"), price["price"].alias("each"), price["issue"].alias("issue"))


@query("""WITH k AS (SELECT p_partkey AS id, p_size AS n FROM part) SELECT id, array_to_string(list_sort([n || 'w', (n % 7 + 1) || 'panel']), ',') AS power, greatest(n * 2, 32)::BIGINT AS storage, 'ab' || n || 'x' || id AS codes,
  CASE id % 3 WHEN 0 THEN 'vehicle-used:s:' || id WHEN 1 THEN 'vehicle-new-unverified:s:' || id ELSE 'vehicle-new:brand|model ' || n || '|2020|full' END AS vehicle FROM k""")
def model_parts(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.concat(F.lit("Kit Solar "), n, F.lit(" Watts con "), (F.col("p_size") % 7 + 1).cast("string"), F.lit(" Paneles"))
    words = F.array(F.concat((F.col("p_size") * 2).cast("string"), F.lit("gb")), F.lit("32gb"))
    specs = F.create_map(F.lit("Modelo"), F.concat(F.lit("AB-"), n, F.lit("/X"), k.cast("string")), F.lit("Color"), F.lit("rojo9999"))
    vehicle = keys.vehicle_code(F.lit("Brand"), F.concat(F.lit("Model "), n), F.lit("2020"), F.when(k % 3 == 2, "Full").otherwise(""), k % 3 == 0, F.lit("s"), k)
    return table(spark, sf_dir, "part").select(k.alias("id"), F.array_join(keys.power_tokens(name), ",").alias("power"), keys.main_storage(words).alias("storage"), F.array_join(keys.manufacturer_codes(specs), ",").alias("codes"), vehicle.alias("vehicle"))


@query("""SELECT c_custkey AS id, c_custkey % 50 = 0 OR c_custkey % 3 = 0 AS active, CASE WHEN c_custkey % 50 = 0 THEN 'admin' WHEN c_custkey % 3 = 0 THEN 'paid' ELSE 'user' END AS tier, CASE c_custkey % 3 WHEN 0 THEN TIMESTAMP '2024-02-01 00:00:00' WHEN 1 THEN TIMESTAMP '2024-01-29 21:30:00' END AS "at", CASE c_custkey % 3 WHEN 0 THEN c_custkey + 1000000 WHEN 1 THEN c_custkey END AS n FROM customer""")
def memberships(spark, sf_dir):
    k = F.col("c_custkey")
    said = F.when(k % 3 == 0, "2024-02-01").when(k % 3 == 1, "2024-01-29T18:30:00-03:00").otherwise("soon")
    m = keys.membership(F.when(k % 50 == 0, "admin"), keys.moment(said), F.lit("2024-01-30").cast("timestamp"))
    number = F.when(k % 3 == 0, F.translate(F.format_number(k + 1000000, 0), ",", ".")).when(k % 3 == 1, k.cast("string")).otherwise("many")
    return table(spark, sf_dir, "customer").select(k.alias("id"), m["active"].alias("active"), m["tier"].alias("tier"), keys.moment(said).alias("at"), keys.thousands_int(number).alias("n"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'id' || p_partkey WHEN p_partkey % 4 = 1 THEN 'k' || p_size ELSE 'url:' || substr(sha256('u' || p_partkey), 1, 24) END AS own, '10.0.0.' || (p_partkey % 200) AS ip, p_partkey + 0.5::DOUBLE AS f, -p_partkey AS i,
  CASE WHEN p_partkey % 3 = 0 THEN 20 WHEN p_partkey % 3 = 1 THEN 25 ELSE 25 END::BIGINT AS discount, ['new_or_unknown', 'new_or_unknown', 'used'][p_partkey % 3 + 1] AS grp, ['sold_out', 'in_stock', 'low', 'unknown'][p_partkey % 4 + 1] AS stock, 'a: ' || p_size || ' | b: x' AS specs FROM part""")
def listing_fields(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    s = k.cast("string")
    own = text.stable_product_id(F.when(k % 4 == 0, F.concat(F.lit("id"), s)), F.when(k % 4 == 1, F.concat(F.lit("k"), n.cast("string"))).otherwise(" "), F.concat(F.lit("u"), s))
    hop = text.first_hop(F.when(k % 2 == 0, F.concat(F.lit(" 10.0.0."), (k % 200).cast("string"), F.lit(", 1.1.1.1"))), F.concat(F.lit("10.0.0."), (k % 200).cast("string")))
    said = F.when(k % 3 == 0, 20).when(k % 3 == 1, 90)
    stock = commerce.stock_state(F.when(k % 4 == 0, 0).when(k % 4 == 1, 3), F.when(k % 4 == 2, "Últimas unidades").otherwise(""))
    return table(spark, sf_dir, "part").select(
        k.alias("id"), own.alias("own"), hop.alias("ip"), money.decimal_comma(F.concat(s, F.lit(",5"))).alias("f"), money.signed_int(F.concat(F.lit("$ -"), s)).alias("i"),
        money.sane_discount(said, F.lit(1000), F.lit(750)).alias("discount"), commerce.condition_group(F.element_at(F.array(F.lit("new"), F.lit("unknown"), F.lit("used")), (k % 3 + 1).cast("int"))).alias("grp"), stock.alias("stock"),
        commerce.spec_text(F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), n.cast("string"))).alias("specs"),
    )


@query(f"""WITH {OFF} SELECT product_id, bool_and(shipping_cost IS NOT NULL) AS comparable, bool_or(abs(price - price_normal) * 100 <= 3 * greatest(price, price_normal)) AS any_same FROM off GROUP BY product_id""")
def comparable_shipping(spark, sf_dir):
    o = offers(spark, sf_dir)
    same = o.groupBy("product_id").agg(F.bool_or(O.same_price(F.col("price"), F.col("price_normal"))).alias("any_same"))
    return O.shipping_comparable(o, ["product_id"]).join(same, "product_id")


@query("""SELECT p_partkey AS id, 'v' || p_partkey || ',k' || p_partkey AS variants, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size > 10 END AS first_available, CASE WHEN p_partkey % 2 = 0 THEN 'same' WHEN p_partkey % 5 = 0 THEN 'not_verified' ELSE 'different' END AS status, CASE WHEN p_partkey % 2 = 1 AND p_partkey % 5 <> 0 THEN 1 / p_size::DOUBLE END AS relative FROM part""")
def variant_rows(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    one = F.struct(F.concat(F.lit("v"), k.cast("string")).alias("id"), F.lit("s").alias("sku"), F.lit(" A ").alias("name"), F.when(k % 3 != 0, n - 10).cast("long").alias("stock"), F.lit(None).cast("boolean").alias("available"))
    two = F.struct(F.lit(None).cast("string").alias("id"), F.concat(F.lit("k"), k.cast("string")).alias("sku"), F.lit("B").alias("name"), F.lit(None).cast("long").alias("stock"), F.lit(True).alias("available"))
    v = commerce.variants(F.array(one, two))
    d = commerce.field_difference(n.cast("double"), F.when(k % 2 == 0, n).when(k % 5 != 0, n + 1).cast("double"))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.array_join(F.transform(v, lambda x: x["id"]), ",").alias("variants"), v[0]["available"].alias("first_available"), d["status"].alias("status"), d["relative"].alias("relative"))
