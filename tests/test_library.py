"""The library's queries against their SQL, and small cases of its operators."""

import glob
import hashlib
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from tallystone import plans
from tallystone.functions import commerce as P
from tallystone.functions import keys as Y
from tallystone.functions import money as M
from tallystone.functions import text as T
from tallystone.operators import identity as I
from tallystone.operators import catalog as C
from tallystone.operators import records as R
from tallystone.operators import search as V
from tallystone.operators import selection as X
from tallystone.operators import series as S
from tallystone.operators import store as K
from tallystone.sources import html as H
from tallystone.sources import listings as L

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


def rows_of(table, columns):
    return sorted(tuple(plain(v) for v in row) for row in zip(*(table[c].to_pylist() for c in columns)))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_agrees_with_its_sql(spark, sf_dir, duck, name):
    got = plans.queries()[name](spark, sf_dir).toArrow()
    want = duck.execute(plans.oracle_sql()[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    assert rows_of(got, columns) == rows_of(want, columns)


def test_entry_imports_before_any_session():
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_money_of_odd_texts(spark):
    rows = spark.createDataFrame([("$ 12.990",), ("",), (None,), ("sin precio",)], "t string")
    assert [r.m for r in rows.select(M.money(F.col("t")).alias("m")).collect()] == [12990, None, None, None]


def test_fold_drops_case_and_accents(spark):
    assert spark.range(1).select(T.fold(F.lit("  Ñandú  ÁÉÍ ")).alias("f")).first().f == "nandu aei"


def test_damaged_payloads_give_no_row(spark):
    rows = spark.createDataFrame([("s", "{bad"), ("s", None), ("s", '{"id": "7", "name": "x", "prices": {"price": "1990", "currency_minor_unit": 0}}')], "store string, payload string")
    assert [(r.product_id, r.price) for r in L.json_listing(rows, "woocommerce").collect()] == [("7", 1990)]


def test_hashed_vectors_are_those_of_a_plain_version(spark, sf_dir):
    def plain_vector(folded):
        out = [0.0] * 384
        for raw in [folded, *folded.split()]:
            padded = "^" + raw + "$"
            for gram in (padded[i : i + n] for n in (2, 3, 4) for i in range(len(padded) - n + 1)):
                d = hashlib.sha256(gram.encode()).digest()
                out[int.from_bytes(d[:4], "little") % 384] += 1.0 if d[4] % 2 == 0 else -1.0
        norm = sum(x * x for x in out) ** 0.5 or 1.0
        return [x / norm for x in out]

    odd = spark.createDataFrame([(i, t) for i, t in enumerate(["", None, "a", "ñu 中文 😀"])], "i long, t string")
    for r in odd.select("t", V.hashed_vector(F.col("t")).alias("v")).collect():
        assert r.v == pytest.approx(plain_vector(r.t or ""))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.fold(F.col("p_name")).alias("t"))
    got = plans.queries()["hashed_vectors"](spark, sf_dir).join(parts, "p_partkey").collect()
    assert len(got) == parts.count()
    for r in got:
        assert r.vector == pytest.approx(plain_vector(r.t))


def test_groups_of_a_path_and_a_lone_node(spark):
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "id long")
    edges = spark.createDataFrame([(4, 3), (2, 3), (1, 2)], "a long, b long")
    assert {r.id: r.root for r in I.groups(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in root}


def clusters_and_all_pairs(listed, block):
    """The operator's groups, and those of every pair's confidence."""
    known = I.identity(listed).cache()
    same = F.col("l.id") < F.col("r.id")
    for b in block:
        same &= F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}"))
    pairs = known.alias("l").join(known.alias("r"), same).withColumn("c", I.confidence())
    links = pairs.filter((F.col("c") >= I.ACCEPT) | (F.col("l.compare_code") == F.col("r.compare_code"))).select("l.id", "r.id").collect()
    want = components([r.id for r in known.select("id").collect()], links)
    return {r.id: r.root for r in I.cluster(listed, block).collect()}, want


def test_clusters_are_those_of_all_pairs(spark, sf_dir):
    from tallystone.plans.flows import parts_as_listings

    listed = parts_as_listings(spark, sf_dir).withColumn("brand", F.when(F.col("id") % 9 != 0, F.concat(F.lit("b"), (F.col("id") % 2).cast("string"))))
    got, want = clusters_and_all_pairs(listed, ["p_type"])
    assert got == want and len(set(got.values())) < len(got)


@pytest.mark.parametrize("seed, block", [(1, []), (2, ["kind"])])
def test_clusters_of_listings_with_codes_models_and_brands_in_names(spark, seed, block):
    import random

    r = random.Random(seed)
    models = ["un50u8000", "u8000", "un50u8000hgxzs", "a54", "v15", "sm-a546", "kx100200", "100200kx"]
    words = "smart televisor galaxy notebook celular negro azul grande nuevo oferta cocina madera".split()
    rows = []
    for i in range(150):
        brand = r.choice(["Samsung", "Lenovo", "", None])
        name = " ".join([r.choice(["", "Samsung", "lenovo"]), *r.sample(words, r.randint(2, 5)), r.choice([*models, ""]), r.choice(["", "5G", "128gb", "256 gb", "pack 6", "50 pulgadas"])])
        gtin = r.choice([None] * 8 + ["7802800000029", "4006381333931"])
        specs = r.choice([None] * 6 + [{"mpn": "AB-1234"}, {"mpn": "CD-9999"}, {"vehicle_type": "car", "year": r.choice(["2020", "2021"]), "model": "rio", "version": r.choice(["", "lx"])}])
        rows.append((i, name, brand, gtin, specs, r.choice(["new"] * 5 + ["used"]), r.choice([None] * 12 + ["mine"]), r.choice(["a", "b"]), r.choice(["x", None])))
    rows += [(200 + i, *rows[i][1:]) for i in range(20)]
    listed = spark.createDataFrame(rows, "id long, name string, brand string, gtin string, specs map<string,string>, condition string, entity_override string, store string, kind string")
    got, want = clusters_and_all_pairs(listed, block)
    assert got == want and 1 < len(set(got.values())) < len(got)


def test_similar_sets_miss_no_pair(spark):
    import random

    r = random.Random(5)
    sets = {i: sorted(r.sample("abcdefghijklmn", r.randint(1, 9))) for i in range(120)}
    df = spark.createDataFrame([(i, i % 2, s) for i, s in sets.items()], "id long, g long, words array<string>")
    for least in (0.3, 0.75, 1.0):
        got = {(x.a, x.b) for x in I.similar_sets(df, ["g"], least).collect()}
        close = {(a, b) for a in sets for b in sets if a < b and a % 2 == b % 2 and len(set(sets[a]) & set(sets[b])) >= least * len(set(sets[a]) | set(sets[b]))}
        assert close <= got and (len(got) < 120 * 119 / 4 / 2 or least < 0.5)


def test_sequence_ratio_is_that_of_difflib(spark, sf_dir):
    from difflib import SequenceMatcher

    names = [x.p_name for x in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").limit(40).collect()]
    rows = spark.createDataFrame([(a, b) for a in names for b in [*names[:9], a + " x", ""]] + [(None, "a")], "a string, b string")
    for x in rows.select("a", "b", I.sequence_ratio("a", "b").alias("r")).collect():
        assert x.r == (0.0 if x.a is None else SequenceMatcher(None, x.a, x.b).ratio())


def test_phones_of_a_generation_and_vehicles(spark):
    rows = [
        (1, "Celular Galaxy A54 5G 128GB", "Samsung", None, "new", "a"), (2, "Celular Galaxy A54 128GB", "Samsung", None, "new", "b"), (3, "Celular Galaxy A54 256GB 5G", "Samsung", None, "new", "b"),
        (4, "Kia Rio 2020", "Kia", {"vehicle_type": "car", "year": "2020", "model": "Rio", "version": "LX"}, "used", "a"), (5, "Kia Rio 2020", "Kia", {"vehicle_type": "car", "year": "2020", "model": "Rio", "version": "LX"}, "used", "a"),
        (6, "Kia Rio 2021", "Kia", {"vehicle_type": "car", "year": "2021", "model": "Rio", "version": "LX"}, "new", "a"), (7, "Kia Rio LX 2021", "Kia", {"vehicle_type": "auto", "year": "2021", "model": "rio", "version": "lx"}, "new", "b"),
        (8, "Kia Rio 2021", "Kia", {"year": "2021", "model": "Rio"}, "new", "chileautos"), (9, "Kia Rio 2021", "Kia", None, "new", "b"),
    ]
    listed = spark.createDataFrame([(i, n, b, None, s, c, t) for i, n, b, s, c, t in rows], "id long, name string, brand string, gtin string, specs map<string,string>, condition string, store string")
    known = I.identity(listed)
    x = known.alias("l").join(known.alias("r"), F.col("l.id") < F.col("r.id")).withColumn("c", I.confidence()).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), "c")
    got = {(r.a, r.b): r.c for r in x.collect()}
    assert got[1, 2] == 0.95 and got[1, 3] == 0 and got[4, 5] == 0 and got[4, 6] == 0 and got[6, 8] == 0 and got[7, 9] == 0
    codes = {r.id: r.compare_code for r in known.select("id", "compare_code").collect()}
    assert codes[4] == "vehicle-used:a:4" and codes[6] == codes[7] == "vehicle-new:kia|rio|2021|lx" and codes[8] == "vehicle-new-unverified:chileautos:8"
    root = {r.id: r.root for r in I.cluster(listed, []).collect()}
    assert root[1] == root[2] == 1 and root[4] == 4 and root[5] == 5 and root[6] == root[7] == 6 and root[8] == 8


def test_confidence_of_named_cases(spark):
    rows = [
        (1, "Televisor Samsung UN50U8000HGXZS 50 pulgadas", "Samsung"), (2, "Samsung U8000H smart tv 50 pulgadas", "Samsung"), (3, "Televisor Samsung UN55U8000HGXZS 55 pulgadas", "Samsung"),
        (4, "Leche entera 6 x 1 litro", "Colun"), (5, "Leche entera 1 lt", "Colun"), (6, "Leche entera 1000 ml", "Colun"), (7, "Notebook Lenovo V15 256gb", None), (8, "Notebook V15 256gb", "Lenovo"),
    ]
    known = I.identity(spark.createDataFrame([(i, n, b, None) for i, n, b in rows], "id long, name string, brand string, gtin string"))
    x = known.alias("l").join(known.alias("r"), F.col("l.id") < F.col("r.id")).withColumn("c", I.confidence()).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), "c")
    got = {(r.a, r.b): r.c for r in x.collect()}
    assert got[1, 2] == 0.93 and got[1, 3] == 0 and got[4, 5] == 0 and got[5, 6] == 0.95 and got[7, 8] == 0.91


def test_last_point_of_a_local_day(spark):
    rows = spark.createDataFrame([("a", "2026-01-02 01:00:00", 5), ("a", "2026-01-01 12:00:00", 7)], "k string, at string, price long").withColumn("ts", F.col("at").cast("timestamp"))
    got = S.last_per_day(rows, ["k"], ["ts"]).collect()
    # one in the morning UTC is still the evening before in Santiago
    assert [r.price for r in got] == [5]


def offers_of(spark, rows):
    """Offers (group, store, family, price, list price) that history says nothing against."""
    schema = "product_id long, store string, family string, price long, price_normal long"
    x = spark.createDataFrame(rows, schema)
    more = {"name": F.lit("x"), "stock": F.lit(3).cast("long"), "price_card": F.lit(None).cast("long"), "price_all_payment": F.col("price"), "verified": F.lit(0.0), "points": F.lit(5).cast("long"), "was_full": F.lit(False), "list_savings": F.lit(None).cast("double"), "fake": F.lit(False), "pre_event": F.lit(False)}
    return x.withColumns(more)


def test_real_offers_of_named_cases(spark):
    rows = [
        (1, "a", "a", 6000, 10000), (1, "b", "b", 10000, 10000),  # one store sells well below the others
        (2, "a", "a", 6000, 10000), (2, "b", "b", 6000, 10000),  # all equally cheap
        (3, "a", "a", 6000, 10000), (3, "a2", "a", 10000, 10000),  # sister stores only
        (4, "agg", "agg", 6000, 10000), (4, "b", "b", 10000, 10000),  # the cheap one is an aggregator
        (5, "a", "a", 9500, 10000), (5, "b", "b", 9600, 9600),  # a discount in name only
    ]
    got = X.real_offers(offers_of(spark, rows), ["product_id"], aggregators=["agg"]).collect()
    assert [(r.product_id, r.store, r.rival_store, r.gap, r.kinds) for r in got] == [(1, "a", "b", 4000, ["comparison"])]
    sold_out = offers_of(spark, rows[:2]).withColumn("stock", F.when(F.col("store") == "a", 0).otherwise(3).cast("long"))
    assert X.real_offers(sold_out, ["product_id"], aggregators=[]).count() == 0
    inflated = offers_of(spark, rows[:2]).withColumn("list_savings", F.lit(5.0))
    assert X.real_offers(inflated, ["product_id"], aggregators=[]).count() == 0
    assert X.real_offers(offers_of(spark, rows).limit(0), ["product_id"], aggregators=[]).count() == 0


def test_price_bands_are_those_of_all_centres(spark):
    import random

    r = random.Random(4)
    sets = {g: [r.choice([r.randint(1, 60), r.randint(400, 900), r.randint(5000, 9000)]) for _ in range(r.randint(1, 40))] for g in range(60)}
    rows = spark.createDataFrame([(g, p) for g, ps in sets.items() for p in ps], "g long, price long")
    for want in (None, "low", "high"):
        got = {x.g: (x.low, x.high, x.typical) for x in C.price_band(rows, ["g"], want).collect()}
        for g, ps in sets.items():
            ps, cloud = sorted(ps), []
            for c in ps:
                m = [p for p in ps if c / 2.5 <= p <= c * 2.5]
                cloud.append((len(m), c, round(sum(m) / len(m))))
            good = [x for x in cloud if x[0] >= max(3, (len(ps) + 2) // 4)] or cloud
            order = {"low": lambda x: (x[2], -x[0], x[1]), "high": lambda x: (-x[2], -x[0], x[1])}.get(want, lambda x: (-x[0], abs(x[2] - ps[len(ps) // 2]), x[1]))
            size, _, typical = min(good, key=order)
            band = (max(1, int(typical / 2.5)), int(typical * 2.5), typical)
            none = len(ps) < 3 or size < 3 or (want is None and (ps[-1] / ps[0] <= 8 or (ps[0] >= band[0] and ps[-1] <= band[1])))
            assert got.get(g) == (None if none else band), (want, g, ps)


def test_packs_cells_and_typos(spark):
    texts = {"6 x 100 ml": "6x100ml", "Pack de 12 rollos": "12un", "x6": "6un", "1,5 kg arroz": "1500g,1un", "16 comprimidos 500 mg": "16un,500mg", "": "1un", "3 packs 2 lts": "2000ml,3un"}
    x = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.array_join(I.pack_tokens(F.col("t")), ",").alias("p"))
    assert {r.t: r.p for r in x.collect()} == texts
    cells = {"500 g": (0.5, "kg"), "1,5 lt.": (1.5, "litro"), "12": (12.0, "unidad"), "0.5": (None, None), "1,5": (None, None), "2.0": (2.0, "unidad"), "0.5 kg": (0.5, "kg"), "2 bolsas": (None, None), "0": (None, None), "20000": (None, None), None: (None, None)}
    x = spark.createDataFrame([(c,) for c in cells], "c string").select("c", Y.quantity_cell(F.col("c")).alias("q"))
    assert {r.c: (r.q.amount, r.q.unit) for r in x.collect()} == cells
    pairs = [("sal", "ssal", True), ("leche", "lecche", True), ("sal", "sol", False), ("a1", "aa1", False), ("la sal", "la", False), ("mesa roja", "messa rroja", False)]
    x = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string").select(Y.typo_equivalent(F.split("a", " "), F.split("b", " ")).alias("t"))
    assert [r.t for r in x.collect()] == [t for *_, t in pairs]


def test_words_that_stand_inside_are_found_without_comparing_all(spark):
    import random

    r = random.Random(8)
    texts = {i: "".join(r.choice("abcd e") for _ in range(r.randint(0, 14))) for i in range(300)} | {900: None}
    queries = {i: ["".join(r.choice("abcde") for _ in range(r.randint(2, 5))) for _ in range(r.randint(1, 3))] for i in range(80)}
    t, q = spark.createDataFrame(list(texts.items()), "product_id long, text string"), spark.createDataFrame(list(queries.items()), "query_id long, words array<string>")
    found = K.standing_inside(q, t)
    want = {(i, j) for i, ws in queries.items() for j, x in texts.items() if x is not None and all(w in x for w in ws)}
    assert {tuple(x) for x in found.collect()} == want and found.count() == len(want) > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_find_by_query_looks_into_brand_and_specs(spark):
    p = spark.createDataFrame([(1, "silla", "", "Acme", {"color": "verde oliva"}, 1), (2, "mesa", "", "Otra", {}, 2)], "product_id long, name string, last_query string, brand string, specs map<string,string>, updated long")
    q = spark.createDataFrame([(7, "cme oliv"), (8, "zzz"), (9, "mesa")], "query_id long, text string")
    assert sorted(map(tuple, K.find_by_query(q, p).collect())) == [(7, 1, 4), (9, 2, 2)]


def test_the_vector_index_finds_most_neighbours_and_every_row_is_in_one_list(spark, sf_dir):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.5 * rng.normal(size=16)], i % 10) for i in range(1500)] + [(2000 + i, [1.0] * 16, 3) for i in range(300)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, day int").cache()
    asked = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = V.VectorIndex(v, lists=16, sample=400)
    assert sorted(r.vec_id for r in index.rows.select("vec_id").collect()) == sorted(r[0] for r in rows)
    for within, known in ((None, v), (F.col("day") < 5, v.filter("day < 5"))):
        want = {(r.query_id, r.vec_id): r.score for r in V.top_k(known.drop("day"), asked, 5).collect()}
        got = {(r.query_id, r.vec_id): r.score for r in index.search(asked, 5, probes=5, within=within).collect()}
        assert len(want.keys() & got.keys()) >= 0.9 * len(want)
        assert all(got[k] == pytest.approx(want[k]) for k in want.keys() & got.keys())
    assert V.VectorIndex(v.limit(0)).search(asked, 5).collect() == []
    exact = {(r.query_id, r.vec_id) for r in plans.queries()["similar_queries"](spark, sf_dir).collect()}
    near = {(r.query_id, r.vec_id) for r in plans.queries()["similar_queries_indexed"](spark, sf_dir).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_cards_and_links_of_odd_pages(spark):
    page = """<ul><li class=item data-product-id=7><div><img src="/i.png" alt="Alt name"><a href="/a.html"><span>Caf&eacute; &amp; <b>Té</b></span></a></div>
    <div class="old-price"><span class="price">$ 2.990</span></div><span data-price-amount="1990.0000"></span></li>
    <li data-id="8"><a href="/a.html">again the same address</a><span class="price">$1.000</span></li>
    <li data-id="9"><a href="/c.html">No price</a></li>
    <div data-id="10"><img alt="By its image" src="/j.png"><p class="brand-x">Acme</p><span class="price">12990</span>"""
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<li data-id='1'><<>&#x;</a></li>"), (5, "<script>var a='<a href=1>';</script><!-- <a href='/n'>n</a> --><a href='/x'>one<a href='/y'>two <i>deep</i></a>")], "k long, html string")
    cards = H.page_cards(df, ["k"]).collect()
    assert [(r.k, r.place, r.product_id, r.name, r.url, r.image, r.brand, r.price, r.price_normal, r.total) for r in cards] == [(1, 0, "7", "Café & Té", "/a.html", "/i.png", None, 1990, 2990, 2), (1, 1, "10", "By its image", None, "/j.png", "Acme", 12990, None, 2)]
    links = sorted((r.k, r.place, r.href, r.label) for r in H.page_links(df, ["k"]).collect())
    assert links == [(1, 0, "/a.html", "Café & Té"), (1, 1, "/a.html", "again the same address"), (1, 2, "/c.html", "No price"), (5, 0, "/x", "one"), (5, 1, "/y", "two deep")]


def test_sampled_pairs_are_those_of_all_pairs(spark):
    import random

    r = random.Random(6)
    for levels in (3, 1000):
        rows = [(r.choice("ABC"), i, r.choice(["s1"] * 5 + ["s2", "s3"]), r.randint(0, levels) / levels) for i in range(150)]
        o = spark.createDataFrame(rows, "g string, id long, store string, confidence double")
        want = sorted(((min(a[3], b[3]), a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] != b[2] and min(a[3], b[3]) >= 0.3), key=lambda x: (-x[0], x[1], x[2]))[:15]
        want = sorted(want, key=lambda x: hashlib.md5(f"21:{x[1]}:{x[2]}".encode()).hexdigest())[:5]
        assert sorted((x.score, x.a, x.b) for x in X.identity_pairs(o, ["g"], "id", 0.3, 5).collect()) == sorted(want)


def test_tables_of_damaged_documents_have_no_rows(spark):
    import json

    cell = lambda text, r, c, h=1, w=1, **more: {"text": text, "start_row_offset_idx": r, "end_row_offset_idx": r + h, "start_col_offset_idx": c, "end_col_offset_idx": c + w, **more}
    doc = lambda *tables, name="Doc": json.dumps({"schema_name": name, "tables": [{"data": {"num_rows": n, "num_cols": m, "table_cells": cells}} for n, m, cells in tables]})
    good = (3, 2, [cell("A", 0, 0), cell("B", 0, 1), cell("x", 1, 0, 1, 2), cell("y", 1, 1), cell(" ", 2, 0)])
    rows = [(1, doc(good)), (2, None), (3, "{"), (4, doc(good, name="x")), (5, doc((1, 1, [cell("z", 0, 1)]), good)), (6, doc((0, 2, []), (2000, 1, []))), (7, "[]"), (8, doc((2, 1, [cell("v", 1, 0)])))]
    got = R.document_tables(spark.createDataFrame(rows, "k long, payload string"), ["k"], "Doc").collect()
    assert sorted((r.k, r.table, r.page, r.row, r.headers, r["values"]) for r in got) == [(1, 1, None, 2, ["A", "B"], ["x", "y"]), (5, 2, None, 2, ["A", "B"], ["x", "y"]), (8, 1, None, 2, [""], ["v"])]
    odd = spark.createDataFrame([(s,) for s in ['"[object Object]"', "3", "null", "[]", '[["a", "b"], "a"]', '{"status": {"text": "Disponible"}}', "{bad", None]], "s string")
    assert [r.t for r in odd.select(R.availability_text(F.try_parse_json("s")).alias("t")).collect()] == ["", "", "", "", "a · b · a", "En stock", "", ""]


def test_measures_of_named_cases(spark):
    rows = {"Leche 1,5 Lt. 900 g": ("litro", 1.5), "Arroz 500 gr": ("kg", 0.5), "Cable 250 cm": ("metro", 2.5), "Tubo 12 mm": ("metro", 0.012), "TV 50 pulgadas": None, "": None, None: None, "0 kg pan 2 m": ("metro", 2.0)}
    x = spark.createDataFrame([(t,) for t in rows], "t string").select("t", Y.catalog_measure(F.col("t"), F.lit("x"), F.create_map().cast("map<string,string>")).alias("m"))
    assert {r.t: tuple(r.m) if r.m else None for r in x.collect()} == rows


def test_shipping_and_financing_of_named_cases(spark):
    texts = {
        "Despacho gratis por compras sobre $ 19.990": (None, 19990, False), "envío gratis, retiro en tienda": (0, None, True), "Despacho por $3.990 o retiro": (3990, None, False),
        "delivery 2500": (2500, None, False), "despacho en 3 dias, valor 9.990": (None, None, False), "": (None, None, False), None: (None, None, False),
    }
    x = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.shipping(F.col("t")).alias("s"))
    assert {r.t: tuple(r.s) for r in x.collect()} == texts
    texts = {"12 cuotas, CAE: 34,5 %, costo total del crédito $ 450.000": (34.5, 12, 450000), "cae 20%": (20.0, None, None), "1 cuota de 9990": (None, 1, None), "precio total 15000 en 3 cuotas": (None, 3, 15000), None: (None, None, None)}
    x = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.financing(F.col("t")).alias("s"))
    assert {r.t: tuple(r.s) for r in x.collect()} == texts


def test_a_shared_folder_is_named_on_a_cluster(spark):
    from types import SimpleNamespace

    from tallystone.sources.storage import shared_folder

    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_folder(away)


def test_the_summary_of_filled_days_is_that_of_their_rows(spark):
    import datetime

    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    daily = spark.createDataFrame([(1, day(0), 5), (1, day(3), 7), (2, day(9), 4), (2, day(12), 6), (3, day(2), 8), (3, day(15), 9)], "k long, day date, price long")
    today = F.lit(day(9))
    rows = S.filled_days(daily, ["k"], today).groupBy("k").agg(F.count("*").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("price").alias("price_days"))
    assert sorted(map(tuple, S.filled_summary(daily, ["k"], today).collect())) == sorted(map(tuple, rows.collect()))


def test_copies_of_a_listing_are_read_once(spark, monkeypatch):
    names = ["Galaxy a54 128gb", "galaxy a54", "Mesa redonda de madera", None]
    rows = [(i, names[i % 4], "Samsung" if i % 4 < 2 else None, None, None) for i in range(60)]
    rows += [(100 + i, "Kia rio", "Kia", None, {"vehicle_type": "car", "year": "2020", "model": "rio", "version": ("", "lx")[i % 2]}) for i in range(8)]
    listed = spark.createDataFrame(rows, "id long, name string, brand string, gtin string, specs map<string,string>")
    _, want = clusters_and_all_pairs(listed, [])
    read, identity = [], I.identity
    monkeypatch.setattr(I, "identity", lambda p: read.append(p.count()) or identity(p))
    assert {r.id: r.root for r in I.cluster(listed, []).collect()} == want
    assert read == [4 + 8]  # a vehicle is itself, also where all it tells is alike


def shuffled_rows(spark, run):
    """What run returns, and the rows that its jobs pass on between tasks."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def so_far():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = so_far()
    return run(), so_far() - before


def test_queries_of_one_text_and_products_of_one_name_do_not_meet_one_by_one(spark):
    kinds = ["mesa", "silla verde", "mesa roja", "banco"]
    rows = [(i, kinds[i % 4], ["sala", "bano"][i % 2], i % 7) for i in range(2000)]
    p = spark.createDataFrame(rows, "product_id long, name string, last_query string, updated long")
    texts = ["mesa", "sala", "illa erd", "12", "nada"]
    q = spark.createDataFrame([(i, texts[i % 5]) for i in range(500)], "query_id long, text string")
    got, moved = shuffled_rows(spark, lambda: K.find_by_query(q, p, limit=6).collect())
    newest = lambda ids: sorted(ids, key=lambda i: (-(i % 7), i))[:6]
    mesas = [i for i in range(2000) if i % 4 in (0, 2)][:6]  # the first of those that share the one word
    want = {"mesa": [(i, 2) for i in mesas], "sala": [(i, 1) for i in newest(range(0, 2000, 2))], "illa erd": [(i, 4) for i in newest(range(1, 2000, 4))], "12": [(12, 3)], "nada": []}
    assert sorted(map(tuple, got)) == sorted((k, i, tier) for k in range(500) for i, tier in want[texts[k % 5]])
    assert moved < 20_000


def test_related_products_keep_only_the_first_of_what_is_alike(spark):
    import random

    r = random.Random(4)
    words = ["mesa", "silla", "roja", "verde", "alta"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 3))), r.choice(["a", "b", None, ""]), r.choice(["x", "y", "", None]), r.choice([None, 10, 20, 30])) for i in range(1500)]
    p = spark.createDataFrame(rows, "product_id long, name string, brand string, category string, price long")
    seed = p.filter("product_id % 5 = 0").select(F.col("product_id").alias("id"), F.array_distinct(T.tokens(F.col("name"))).alias("words"), "brand", F.col("category").alias("grp"))
    got, moved = shuffled_rows(spark, lambda: C.related(seed, p, 6).collect())
    want = set()
    for i, name, brand, kind, _ in rows[::5]:
        score = lambda x: 3 * len(set(name.split()) & set(x[1].split())) + 4 * (brand is not None and brand == x[2]) + 5 * (kind is not None and kind == x[3])  # noqa: B023, E731
        best = sorted(((-score(x), x[4] is None, x[4] or 0, x[0], x[4]) for x in rows if x[0] != i and score(x) > 0))[:6]
        want |= {(i, x[3], -x[0], x[4], n) for n, x in enumerate(best, 1)}
    assert {(x.id, x.product_id, x.score, x.price, x.place) for x in got} == want and len(got) == len(want)
    assert moved < 100_000


def test_a_block_of_vectors_is_compared_in_bounded_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(6)
    known = rng.integers(-2, 3, size=(V.VECTOR_BLOCK, 4)).astype(np.float32) + 0.5  # many ties
    ids, asked = rng.permutation(len(known)), known[: V.QUERY_BLOCK]
    left = pa.table({"vec_id": ids, "known": pa.array(list(known), pa.list_(pa.float32()))})
    right = pa.table({"query_id": np.arange(len(asked)), "asked": pa.array(list(asked), pa.list_(pa.float32()))})
    tracemalloc.start()
    got = V._best_of(7)(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    unit = known.astype(float) / np.linalg.norm(known.astype(float), axis=1, keepdims=True)
    for i in range(0, len(asked), 100):
        best = np.lexsort((ids, -np.round(unit @ unit[i], 9)))[:7]
        assert got["vec_id"].to_pylist()[7 * i : 7 * i + 7] == ids[best].tolist()


def test_a_text_is_hashed_once_a_batch(spark, monkeypatch):
    import pyarrow as pa

    texts, hashed = ["mesa roja", "", "silla"] * 400, []
    plain = V.hashlib.sha256
    monkeypatch.setattr(V, "lru_cache", lambda n: lambda f: f)
    monkeypatch.setattr(V.hashlib, "sha256", lambda b: hashed.append(b) or plain(b))
    monkeypatch.setattr(V.F, "arrow_udf", lambda kind: lambda f: lambda c: f(pa.array(texts)))
    monkeypatch.setattr(V.F, "pandas_udf", lambda kind: lambda f: lambda c: f(pa.array(texts).to_pandas()))
    got = list(V.hashed_vector(F.lit("")))
    assert len(got) == 1200 and len(hashed) < 100


def test_tables_of_documents_are_made_in_their_task(spark):
    import json

    cell = lambda t, r, c, h=1, w=1, header=False: {"text": t, "start_row_offset_idx": r, "end_row_offset_idx": r + h, "start_col_offset_idx": c, "end_col_offset_idx": c + w, "column_header": header}
    doc = lambda cells, n: json.dumps({"schema_name": "Doc", "tables": [{"prov": [{"page_no": 3}], "data": {"num_rows": n, "num_cols": 3, "table_cells": cells}}]})
    full = [cell("A", 0, 0, 1, 2, True), cell("B", 0, 2, header=True), cell("x", 1, 0, 2, 1), cell("y", 1, 0), cell(None, 1, 2), cell(" ", 3, 0)]
    rows = [(1, doc(full, 4)), (2, doc(full[:2], 1)), (3, doc([], 2)), (4, doc(full, 3)), (5, None)]
    got, moved = shuffled_rows(spark, lambda: R.document_tables(spark.createDataFrame(rows, "k long, payload string"), ["k"], "Doc").collect())
    assert [tuple(r) for r in got] == [(1, 1, 3, 2, ["A", "A", "B"], ["y", "", ""]), (1, 1, 3, 3, ["A", "A", "B"], ["x", "", ""])]
    assert moved == 0


@pytest.mark.parametrize("name", ["listing_prose", "product_rows", "relevance_scores", "hashed_vectors"])
def test_costly_rows_of_a_small_file_are_dealt_to_all_tasks(spark, sf_dir, name):
    plan = plans.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_scopes_meet_stores_with_the_first_of_each_query_only(spark):
    import random

    r = random.Random(2)
    rows = [(i % 1900, r.choice(["a", "B ", "b", None]), r.randint(0, 3), r.randint(0, 9) + (i >= 1900) * 10) for i in range(2000)]  # a hundred ids twice
    products = spark.createDataFrame(rows, "id long, query string, grp int, place int")
    stores = spark.createDataFrame([(i, [i % 4, (i + 1) % 4]) for i in range(40)], "store int, groups array<int>")
    got, moved = shuffled_rows(spark, lambda: R.scoped(products, stores).collect())
    want = {}
    for s in range(40):
        best = {}
        for i, q, g, p in sorted((x for x in rows if x[2] in (s % 4, (s + 1) % 4)), key=lambda x: (x[3], x[2])):
            best.setdefault(i, (p, i, q and q.strip().lower()))
        for p, i, q in sorted(best.values(), key=lambda b: b[:2]):
            want.setdefault((s, q), i)
    assert sorted((x.store, x.id) for x in got) == sorted((s, i) for (s, _), i in want.items())
    assert moved < 30_000


def lines_read(spark, sf_dir, name, monkeypatch):
    """How often a query, with the tables that it stores on its way, reads lineitem."""
    from pyspark.sql.readwriter import DataFrameWriter

    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey")
    found, write = [], DataFrameWriter.parquet

    def counted(self, *args, **named):
        found.append(reads(self._df))
        return write(self, *args, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    return reads(plans.queries()[name](spark, sf_dir)) + sum(found)


@pytest.mark.parametrize("name", ["list_inflation", "price_stats_windows", "best_offer_cards", "real_offer_cards", "alert_families", "notification_offers", "advice_with_rivals", "candidates_of_day", "catalog_priorities", "normalized_records"])
def test_lines_are_read_and_shuffled_once(spark, sf_dir, name, monkeypatch):
    assert lines_read(spark, sf_dir, name, monkeypatch) == 1


def test_search_results_gather_no_groups(spark, sf_dir):
    plan = plans.queries()["search_results"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "collect" not in plan and "Aggregate" not in plan


def test_flat_search_places_are_those_of_gathered_groups(spark):
    import random

    from tallystone.sources import sinks

    r = random.Random(3)
    rows = spark.createDataFrame([(r.randint(0, 3), r.randint(0, 9), r.choice(["a", "b", None]), r.choice([1, 2, 3, None])) for _ in range(300)], "search_id long, group_index long, store string, product_id long")
    groups = rows.groupBy("search_id", "group_index").agg(F.array_sort(F.collect_set(F.struct("store", "product_id"))).alias("offers"))
    names = ["search_id", "store", "product_id", "position"]
    got = sinks.search_places(rows, ["store", "product_id"]).select(*names).collect()
    want = sinks.search_results(groups).select(*names).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 30
