"""Registered queries on scalar functions over documents, pages, parts, orders and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions import commerce, money, text
from tallystone.registry import query

from .views import OFF, offers, spread, table

_FOLD = f"trim(regexp_replace(translate(lower(coalesce({{}}, '')), '{text.ACCENTED}', '{text.PLAIN}'), '\\s+', ' ', 'g'))"
_FOLDS = f"trim(regexp_replace(regexp_replace(translate(lower(coalesce({{}}, '')), '{text.ACCENTED}', '{text.PLAIN}'), '[+/-]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _paths(c: str) -> str:
    """The path groups as a CASE over a cleaned path."""
    rules = [(name, " OR ".join([f"{c} IN ({', '.join(repr(p) for p in whole)})", *(f"starts_with({c}, '{p}')" for p in begins)])) for name, (whole, begins) in text.PATH_GROUPS.items()]
    return "CASE " + " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in rules) + " ELSE 'otro' END"


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(f"""SELECT doc_id, md5({_FOLD.format('text')}) AS folded, substr(regexp_replace(regexp_replace({_FOLD.format('text')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS slug,
  sha256(array_to_string(regexp_extract_all({_FOLD.format('text')}, '[a-z0-9]+'), ' '))[:24] AS query_digest FROM documents""")
def fold_and_digest(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = F.col("text")
    return d.select("doc_id", F.md5(text.fold(t).cast("binary")).alias("folded"), F.substring(text.slug(t), 1, 40).alias("slug"), text.digest(text.canonical_query(t)).alias("query_digest"))


@query(f"""WITH f AS (SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace({_FOLDS.format('text')}, '([0-9]{{1,4}})\\s*(pulgadas?|pulg\\.?|"|'''')', '\\1pulgadas', 'g'), '([0-9]{{1,4}})\\s*(litros?|lts?\\.?)\\b', '\\1litros', 'g'), '[a-z0-9]+') AS w FROM documents),
g AS (SELECT doc_id, list_filter(list_transform(w, lambda x: regexp_replace(x, '^([0-9]+)g$', '\\1gb')), lambda x: length(x) >= 2 AND x NOT IN ({_STOP})) AS t FROM f)
SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct, md5(array_to_string(t, ' ')) AS tokens FROM g""")
def tokenize_documents(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens"))


_HTML = "html"
for _e, _v in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _HTML = f"replace({_HTML if _HTML != 'html' else 'regexp_replace(html, chr(60) || $$[^>]+>$$, $$ $$, $$g$$)'}, '{_e}', '{_v}')"


@query(f"SELECT page_id, md5(trim(regexp_replace({_HTML}, '\\s+', ' ', 'g'))) AS plain, length(trim(regexp_replace({_HTML}, '\\s+', ' ', 'g')))::INT AS n FROM pages")
def strip_html_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("t"))
    return p.select("page_id", F.md5(F.col("t").cast("binary")).alias("plain"), F.length("t").alias("n"))


_PATH = "regexp_replace(regexp_replace('/' || regexp_extract(url, '^[a-z]+://[^/]*/(.*)$', 1), '[?#].*$', ''), '/+$', '')"


@query(f"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, {_paths(f"(CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END)")} AS path_group, 'page:' || sha256(page_id || '|' || coalesce(url, '')) AS id FROM pages""")
def page_urls(spark, sf_dir):
    u = F.col("url")
    path = F.concat(F.lit("/"), F.regexp_extract(u, "^[a-z]+://[^/]*/(.*)$", 1))
    return table(spark, sf_dir, "pages").select("page_id", text.url_part(u, "HOST").alias("host"), text.query_value(u, "page").alias("page"), text.path_group(path).alias("path_group"), text.stable_id("page", F.col("page_id"), u).alias("id"))


@query(f"""WITH g AS (SELECT p_partkey, lpad((p_partkey * 7919 + p_size)::VARCHAR, 12, '0') AS d FROM part), c AS (SELECT *, d || ((10 - (list_sum(list_transform(range(1, 13), lambda i: substr(d, i, 1)::INT * (CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)))::INT % 10)) % 10) AS ean FROM g),
k AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN d || '0' ELSE ean END AS code FROM c)
SELECT p_partkey, CASE WHEN code = ean AND NOT regexp_matches(lpad(code, 14, '0')[2:], '^(02|04|2)') THEN lpad(code, 14, '0') END AS gtin FROM k""")
def gtin_codes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    d = F.lpad((F.col("p_partkey") * 7919 + F.col("p_size")).cast("string"), 12, "0")
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1)), F.lit(0), lambda a, x: a + x)
    code = F.when(F.col("p_partkey") % 3 == 0, F.concat(d, F.lit("0"))).otherwise(F.concat(d, ((10 - total % 10) % 10).cast("string")))
    return p.select("p_partkey", text.normalize_gtin(code).alias("gtin"))


@query("""WITH m AS (SELECT o_orderkey, printf('%.6f', o_totalprice) AS a, '$' || replace(format('{:,}', round(o_totalprice)::BIGINT), ',', '.') AS b, o_totalprice AS t, o_orderdate AS ts FROM orders)
SELECT o_orderkey, round(a::DOUBLE)::BIGINT AS decimal_text, nullif(regexp_replace(b, '[^0-9]', '', 'g')::BIGINT, 0) AS dotted_text,
  CASE WHEN strftime(timezone('America/Santiago', timezone('UTC', ts)), '%m-%d') BETWEEN '05-20' AND '06-10' THEN 'CyberDay' WHEN strftime(timezone('America/Santiago', timezone('UTC', ts)), '%m-%d') BETWEEN '09-25' AND '10-10' THEN 'CyberMonday' WHEN strftime(timezone('America/Santiago', timezone('UTC', ts)), '%m-%d') BETWEEN '11-20' AND '12-02' THEN 'Black Friday' END AS event,
  epoch(timezone('UTC', timezone('America/Santiago', (timezone('America/Santiago', timezone('UTC', ts))::DATE + 1)::TIMESTAMP)))::BIGINT - epoch(ts)::BIGINT AS to_midnight FROM m""")
def money_and_calendar(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = F.format_string("%.6f", "o_totalprice"), F.concat(F.lit("$"), F.translate(F.format_number(F.round("o_totalprice"), 0), ",", "."))
    ts = F.col("o_orderdate").cast("timestamp")
    return o.select("o_orderkey", money.money(a).alias("decimal_text"), money.money(b).alias("dotted_text"), money.event_label(ts).alias("event"), money.seconds_to_midnight(ts).alias("to_midnight"))


@query(f"""WITH {OFF} SELECT store, product_id, CASE WHEN price_normal > price THEN round_even((price_normal - price) * 100 / price_normal, 0)::BIGINT END AS percent, CASE WHEN price_normal > price THEN price_normal - price END AS amount,
  CASE WHEN NOT price_normal > price THEN NULL WHEN round_even((price_normal - price) * 100 / price_normal, 0) >= 35 OR price <= floor(size * 1000 * 0.9::DOUBLE) THEN 'strong' WHEN round_even((price_normal - price) * 100 / price_normal, 0) < 10 THEN 'usual' ELSE 'ok' END AS signal FROM off""")
def discount_insight(spark, sf_dir):
    return offers(spark, sf_dir).select("store", "product_id", money.discount_insight(F.col("price"), F.col("price_normal"), (F.col("size") * 1000).cast("long")).alias("d")).select("store", "product_id", "d.*")


_CATS = ["steel", "copper", "brass"]


@query(f"""WITH q AS (SELECT 'large steel 15' AS q UNION ALL SELECT 'brass' UNION ALL SELECT 'small anodized copper x9'),
t AS (SELECT q, list_filter(regexp_extract_all(q, '[a-z0-9]+'), lambda x: length(x) >= 2) AS toks FROM q),
k AS (SELECT p_partkey, q, toks, {_FOLDS.format("p_name || ' ' || p_brand || ' ' || p_type")} AS h FROM t, part),
s AS (SELECT p_partkey, q, unnest(toks) AS tok, h FROM k),
w AS (SELECT p_partkey, q, tok, CASE WHEN regexp_matches(tok, '^[0-9]+(gb|tb|mb|hz|mah|w|pulgadas|litros|ml|kg|cm|mm)$') THEN 'spec' WHEN regexp_matches(tok, '[a-z]') AND regexp_matches(tok, '[0-9]') THEN 'model' WHEN tok IN ('steel', 'copper', 'brass') THEN 'category' ELSE 'keyword' END AS kind,
  list_contains(string_split(h, ' '), tok) OR (length(tok) >= 4 AND contains(replace(h, ' ', ''), tok)) AS hit FROM s),
a AS (SELECT p_partkey, q, sum(CASE kind WHEN 'model' THEN 3 WHEN 'spec' THEN 1 ELSE 2 END) AS total, coalesce(sum(CASE kind WHEN 'model' THEN 3 WHEN 'spec' THEN 1 ELSE 2 END) FILTER (WHERE hit), 0) AS won, coalesce(bool_and(hit) FILTER (WHERE kind = 'model'), true) AS mo,
  coalesce(bool_or(hit) FILTER (WHERE kind = 'category'), true) AS ca, count(*) FILTER (WHERE kind = 'keyword') AS nk, count(*) FILTER (WHERE kind = 'keyword' AND hit) AS hk, count(*) FILTER (WHERE kind = 'model') AS nm FROM w GROUP BY ALL)
SELECT q AS query, count(*) FILTER (WHERE ok) AS accepted, round(sum(round(won::DOUBLE / total, 3)), 3) AS scores FROM (SELECT *, mo AND ca AND (nk = 0 OR nm > 0 OR hk >= CASE WHEN nk <= 2 THEN nk ELSE greatest(1, (nk + 1) // 2) END) AS ok FROM a) GROUP BY q""")
def relevance_scores(spark, sf_dir):
    """A stated set of queries against all parts; each query is a few words, so it is a broadcast side of three rows."""
    queries = spark.createDataFrame([("large steel 15",), ("brass",), ("small anodized copper x9",)], "query string").select("query", text.tokens(F.col("query")).alias("t"))
    part = spread(table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type")).select(text.fold(F.concat_ws(" ", "p_name", "p_brand", "p_type"), separators=True).alias("h"))
    scored = part.join(F.broadcast(queries)).select("query", text.relevance(F.col("t"), F.col("h"), _CATS).alias("r"))
    return scored.groupBy("query").agg(F.count(F.when(F.col("r.accepted"), 1)).alias("accepted"), F.round(F.sum("r.score"), 3).alias("scores"))


#: Icons of this corpus' topics.
ICONS = {"code": ["function*", "code", "python", "sql"], "data": ["data*", "table*", "list"], "food": ["comida", "receta*", "food"], "numbers": ["number*", "suma", "total*"], "words": ["text*", "word*", "write", "explain"]}
_WORDS = f"' ' || array_to_string(regexp_extract_all({_FOLD.format('text')}, '[a-z0-9]+'), ' ') || ' '"
_ICONS = " ".join("WHEN regexp_matches(w, ' (" + "|".join(p.replace("*", "[a-z0-9]*") for p in listed) + f") ') THEN '{name}'" for name, listed in ICONS.items())


@query(f"SELECT conv_id, turn, CASE {_ICONS} ELSE 'other' END AS icon, regexp_matches(w, ' (usado|usada|usados|usadas|segunda mano|pre owned|preowned) ') AS used_words FROM (SELECT conv_id, turn, {_WORDS} AS w FROM conversations)")
def conversation_labels(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.category_icon(t, ICONS).alias("icon"), text.has_phrase(text.phrases(t), commerce.CONDITIONS["used"]).alias("used_words"))


@query("""WITH s AS (SELECT p_partkey AS id, p_partkey % 6 AS k, p_size::BIGINT AS n, round(p_retailprice * 100)::BIGINT AS c, lower(p_name) AS name FROM part)
SELECT id, CASE WHEN k = 0 THEN 'used' WHEN k = 3 THEN 'open_box' WHEN k = 1 THEN 'new' ELSE 'unknown' END AS condition, CASE k WHEN 1 THEN (n + 0.5) * 1000 WHEN 3 THEN 100 + n WHEN 5 THEN n END::DOUBLE AS amount,
  CASE k WHEN 0 THEN 19 + n WHEN 4 THEN 19 + n END::INT AS inches, CASE WHEN k = 2 THEN (10 + n) * 1000 + 990 END AS free_over, CASE WHEN k = 4 THEN c END AS cost, k = 4 AS pickup,
  CASE WHEN k = 2 THEN n + 0.5 END::DOUBLE AS apr, CASE WHEN k = 2 THEN 2 + n END::INT AS instalments, CASE WHEN k = 2 THEN c * 10 END AS total FROM s""")
def listing_prose(spark, sf_dir):
    """Listing texts around the names, sizes and prices of the parts, and what is read from them."""
    n, c, name = F.col("p_size").cast("long"), F.round(F.col("p_retailprice") * 100).cast("long"), F.col("p_name")
    pesos = lambda v: F.translate(F.format_number(v, 0), ",", ".")
    say = lambda pattern, *values: F.format_string(pattern, name, *values)
    texts = [
        say('%s %d" usado', n + 19),
        say("%s %d,5 litros nuevo", n),
        say("%s, despacho gratis sobre $%d.990, %d cuotas CAE: %d,5%% costo total del pago $ %s", n + 10, n + 2, n, pesos(c * 10)),
        say("%s caja abierta %d gr", n + 100),
        say("%s %d pulgadas retiro en tienda envio por %s", n + 19, pesos(c)),
        say("%s %d g", n),
    ]
    rows = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("id"), F.element_at(F.array(*texts), (F.col("p_partkey") % 6 + 1).cast("int")).alias("t"))
    t = F.regexp_replace("t", r"\b(new|old)\b", "plain")
    q, ship, fin = text.quantity(t), commerce.shipping(t), commerce.financing(t)
    return rows.select(
        "id", commerce.condition(F.lit(None).cast("string"), t).alias("condition"), F.when(q["unit"] != "un", q["amount"]).alias("amount"), text.screen_inches(text.fold(t)).alias("inches"),
        ship["free_over"].alias("free_over"), ship["cost"].alias("cost"), ship["pickup"].alias("pickup"), fin["apr"].alias("apr"), fin["instalments"].alias("instalments"), fin["total"].alias("total"),
    )
