"""Sources: product listings as JSON, imports as CSV or JSON, HTML listings, sitemaps, event catalogs; and targets in URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.functions.commerce import prices_by_type
from tallystone.functions.money import money
from tallystone.functions.text import fold, query_value, url_part

#: Fields of a listing row, whatever its source.
LISTING = "store string, product_id string, sku_id string, name string, brand string, category string, price long, price_normal long, price_card long, stock long, url string"
_OFFER = "struct<Price:double,ListPrice:double,AvailableQuantity:long>"
_VTEX = f"productId string, productName string, brand string, link string, categories array<string>, items array<struct<itemId:string,name:string,ean:string,sellers:array<struct<sellerId:string,commertialOffer:{_OFFER}>>>>"
_SHOPIFY = "id string, title string, vendor string, handle string, product_type string, variants array<struct<id:string,sku:string,price:string,compare_at_price:string,available:boolean>>"
_WOO = "id string, name string, permalink string, sku string, prices struct<price:string,regular_price:string,currency_minor_unit:int>, is_in_stock boolean"
_TYPED = "productId string, displayName string, brand string, url string, prices array<struct<type:string,price:long>>"


def _row(store: Column, **columns: Column) -> list[Column]:
    schema = T._parse_datatype_string(LISTING)
    return [(store if f.name == "store" else columns.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in schema]


def json_listing(payloads: DataFrame, platform: str) -> DataFrame:
    """Rows of LISTING from payloads (store, payload): the first option and its first seller; bad JSON gives no row."""
    p, store = F.col("p"), F.col("store")
    parsed = {"vtex": _VTEX, "shopify": _SHOPIFY, "woocommerce": _WOO, "typed": _TYPED}[platform]
    x = payloads.select("store", F.from_json("payload", parsed).alias("p")).filter("p is not null")
    if platform == "vtex":
        item = F.get(p["items"], F.lit(0))
        offer = F.get(item["sellers"], F.lit(0))["commertialOffer"]
        columns = dict(product_id=p["productId"], sku_id=item["itemId"], name=p["productName"], brand=p["brand"], category=F.get(p["categories"], F.lit(0)), price=F.round(offer["Price"]), price_normal=F.round(offer["ListPrice"]), stock=offer["AvailableQuantity"], url=p["link"])
    elif platform == "shopify":
        v = F.get(p["variants"], F.lit(0))
        columns = dict(product_id=p["id"], sku_id=v["sku"], name=p["title"], brand=p["vendor"], category=p["product_type"], price=money(v["price"]), price_normal=money(v["compare_at_price"]), stock=F.when(v["available"] == F.lit(False), 0), url=p["handle"])
    elif platform == "woocommerce":
        unit = F.pow(F.lit(10), F.coalesce(p["prices"]["currency_minor_unit"], F.lit(0)))
        amount = lambda c: F.floor(c.try_cast("double") / unit)
        columns = dict(product_id=p["id"], sku_id=p["sku"], name=p["name"], price=amount(p["prices"]["price"]), price_normal=amount(p["prices"]["regular_price"]), stock=F.when(p["is_in_stock"] == F.lit(False), 0), url=p["permalink"])
    else:
        price = prices_by_type(p["prices"])
        columns = dict(product_id=p["productId"], name=p["displayName"], brand=p["brand"], price=price["current"], price_normal=price["list"], price_card=price["card"], url=p["url"])
    return x.select(*_row(store, **columns)).filter("product_id is not null")


def target(url: Column) -> Column:
    """Struct kind (product, category, search, query), value of what a user typed: a URL of a shop, an id, or words."""
    path = url_part(url, "PATH")
    search = F.coalesce(query_value(url, "q"), query_value(url, "s"), query_value(url, "ft"))
    slug = F.regexp_extract(path, r"/(?:products?|producto|p)/([^/?#]+)", 1)
    vtex = F.regexp_extract(path, r"/([^/]+)/p/?$", 1)
    found = F.coalesce(F.nullif(vtex, F.lit("")), F.nullif(slug, F.lit("")))
    is_url = url.rlike("^https?://")
    kind = F.when(is_url & search.isNotNull(), "search").when(is_url & found.isNotNull(), "product").when(is_url, "category").when(url.rlike("^[0-9]+$"), "product").otherwise("query")
    value = F.when(is_url, F.coalesce(search, found, F.trim(F.regexp_replace(path, "^/|/$", "")))).otherwise(F.trim(url))
    return F.struct(kind.alias("kind"), value.alias("value"))


def embedded_state(html: Column) -> Column:
    """The JSON text of a page's embedded state, null where there is none."""
    return F.nullif(F.regexp_extract(html, r"(?s)<script[^>]*id=\"__NEXT_DATA__\"[^>]*>(.*?)</script>", 1), F.lit(""))


def html_links(pages: DataFrame) -> DataFrame:
    """page_id, place, href, label of the links of HTML pages, in order."""
    found = F.regexp_extract_all("html", F.lit(r"(<a\s+href=\"[^\"]*\"[^>]*>[^<]*</a>)"))
    x = pages.select("page_id", F.posexplode(found).alias("place", "tag"))
    return x.select("page_id", "place", F.regexp_extract("tag", r"href=\"([^\"]*)\"", 1).alias("href"), F.regexp_extract("tag", r">([^<]*)</a>", 1).alias("label"))


def sitemap_locations(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>")), lambda x: x)


def visit_seconds(url: Column) -> Column:
    """Four hours between visits of offer and category pages, two days for others."""
    return F.when(F.lower(url).rlike("oferta|offer|deal|sale|categor|collection"), 4 * 3600).otherwise(48 * 3600)


def csv_delimiter(sample: Column) -> Column:
    """The delimiter that the first line has most of; comma for none."""
    line = F.split_part(sample, F.lit("\n"), F.lit(1))
    n = lambda d: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))
    return F.when((n(";") > n(",")) & (n(";") >= n("\t")), ";").when(n("\t") > n(","), "\t").otherwise(",")


def read_import(spark: SparkSession, path: str, aliases: dict[str, list[str]], required: str = "query") -> DataFrame:
    """Rows of a CSV (by its extension) or JSON import: header names folded, aliases merged in order, rows without the required field left out."""
    csv = path.lower().split("?")[0].endswith((".csv", ".txt"))
    if csv:
        sample = spark.read.text(path).limit(1).select(csv_delimiter(F.col("value")).alias("d")).first()
        raw = spark.read.csv(path, header=True, sep=sample["d"] if sample else ",")
    else:
        raw = spark.read.json(path, multiLine=True)
    names = spark.range(1).select(*(fold(F.lit(c)).alias(f"c{i}") for i, c in enumerate(raw.columns))).first()
    folded = {names[i].replace(" ", "_"): c for i, c in enumerate(raw.columns)}
    column = lambda options: F.coalesce(*(F.trim(F.col(f"`{folded[o]}`").cast("string")) for o in options if o in folded), F.lit(None).cast("string"))
    out = raw.select(*(F.nullif(column([name, *more]), F.lit("")).alias(name) for name, more in aliases.items()))
    return out.filter(F.col(required).isNotNull())


def read_seed(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """id, name, alias, group of a JSON seed of generic products (an array, or one product a line), one row an alias and group."""
    x = spark.read.schema("id string, name string, aliases array<string>, groups array<string>").json(path, multiLine=not lines)
    return x.select("id", "name", F.explode_outer("aliases").alias("alias"), "groups").select("id", "name", "alias", F.explode_outer("groups").alias("group"))
