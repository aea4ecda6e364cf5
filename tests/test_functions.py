"""Column functions on single values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vitrina.functions import dates, jsonld, labels, media, money, pages, text


def apply(spark, function, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    out = rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()
    return [r.out for r in out]


def as_floats(values):
    return [None if v is None else float(v) for v in values]


def test_parse_price(spark):
    cases = {
        "4.321": 4321,
        "217.004": 217004,
        "ARS 56.780": 56780,
        "3.210.987,6": 3210987.6,
        "44,5": 44.5,
        "62,018.75": 62018.75,
        "7.03": 7.03,
        "0.125": 125,
        "12345.678": 12345678,
        "12-5": 12,
        "-.50": -0.5,
        "1.": 1,
        "-": None,
        "": None,
        "a consultar": None,
        None: None,
    }
    got = as_floats(apply(spark, money.parse_price, list(cases)))
    assert got == as_floats(cases.values())


def test_json_prices_keep_numbers_apart_from_strings(spark):
    values = ['78.6', '"78.600"', "135000", "null", "true", '"x"', "[1]", "1e3"]
    got = apply(spark, lambda v: money.variant_price(F.try_parse_json(v)), values)
    assert as_floats(got) == [78.6, 78600, 135000, None, None, None, None, 1000]


def test_money_labels(spark):
    values = [48210.0, 6.5, 310.49, -6.5, None]
    assert apply(spark, money.price_label, values, "double") == [
        "$48.210", "$7", "$310", "$-6", None,
    ]
    assert apply(spark, lambda v: money.price_or_dash(v, "en"), values, "double")[0] == "$48,210"
    assert apply(spark, money.price_or_dash, [None], "double") == ["—"]
    assert apply(spark, money.millions_label, [3218000, 5000000, 9876500000], "bigint") == [
        "$3,22 M", "$5 M", "$9.876,5 M",
    ]
    assert apply(spark, lambda v: money.millions_label(v, "en"), [3218000], "bigint") == ["$3.22 M"]
    assert apply(spark, money.count_label, [None, 1234567], "bigint") == ["0", "1.234.567"]
    assert apply(spark, money.drop_zero_cents, ["€ 31,00", "€ 31,05", "7,00,00", "1,000", "", None]) == [
        "€ 31", "€ 31,05", "7,00", "1,000", None, None,
    ]


def test_minor_units(spark):
    rows = spark.createDataFrame(
        [("195", 2.0), ("195", None), ("1950", 3.0), ("", 2.0), ("x", 2.0), ("Infinity", 2.0)],
        "v string, u double",
    )
    got = rows.select(money.minor_unit_price(F.col("v"), F.col("u")).alias("p")).collect()
    assert as_floats(r.p for r in got) == [1.95, 1.95, 1.95, None, None, None]


def test_entities_and_tags(spark):
    assert apply(
        spark, text.decode_entities, ["ca&ntilde;a &amp; t&eacute; a &quot;granel&quot;", "&amp;lt;"]
    ) == ['caña & té a "granel"', "<"]
    assert apply(
        spark, text.strip_tags, ["<p>a<BR />b</p>\n  c&nbsp; d ", "x < 3 <b>y</b>"]
    ) == ["a b c  d", "x y"]


def test_truncate_and_slug(spark):
    assert apply(spark, lambda v: text.truncate(v, 4), ["abcd", "abc def", None, ""]) == [
        "abcd", "abc…", "", "",
    ]
    assert apply(spark, text.slug, ["Two Hip", "Ñandú & Café", "été", "***", None]) == [
        "Two_Hip", "Nandu_Cafe", "ete", "marca", "marca",
    ]


def test_meta_content(spark):
    page = (
        "<META content='Farol &lt;chico&gt; &amp; mecha' name=og:title><meta name='og:title' content='Farol &lt;chico&gt;'>"
        '<meta name="twitter:label1" content=" 12 cuotas "><meta content="" property="blank">'
    )
    found = [
        apply(spark, lambda v, key=key: text.meta_content(v, key), [page])[0]
        for key in ("og:title", "twitter:label1", "blank", "og:image")
    ]
    assert found == ["Farol <chico>", "12 cuotas", "", None]
    odd = (
        '<meta charset="x"><META content="a > b" name="og:title"><p content="no">'
        "<meta name='og:title' content='later'/><meta property=\"og:type\" content='t'>"
    )
    for key, want in (("og:title", "a > b"), ("og:type", "t"), ("x", None)):
        both = [
            lambda v, key=key: text.meta_content(v, key),
            lambda v, key=key: text.meta_content(text.meta_tags(v), key),
        ]
        assert [apply(spark, look, [odd])[0] for look in both] == [want, want]


def test_urls(spark):
    assert apply(spark, text.normalize_url, [" shop.com// ", "HTTP://a.b/"]) == [
        "https://shop.com", "HTTP://a.b",
    ]
    assert apply(spark, text.url_origin, ["https://A.com:443/x", "http://a.com:8080/x"]) == [
        "https://a.com", "http://a.com:8080",
    ]
    assert apply(spark, text.url_host, ["https://u@A.com:8/x?y"]) == ["a.com"]
    assert apply(spark, text.last_path_segment, ["https://a.com/p/slug-1//"]) == ["slug-1"]
    base = F.lit("https://a.com")
    assert apply(spark, lambda v: text.drop_first(v, base), ["https://a.com/x?u=https://a.com"]) == [
        "/x?u=https://a.com"
    ]


def test_product_paths(spark):
    good = [
        "/tetera-azul/p", "/item/farol", "/es/products/9", "/ovillo-p-31", "/producto/ancla-chica",
    ]
    bad = ["/contacto", "/prensa/2024/resumen", "/productores/lista"]
    base = F.lit("https://s.com")
    got = apply(spark, lambda v: pages.is_product_url(v, base), [f"https://s.com{p}" for p in good + bad])
    assert got == [True] * len(good) + [False] * len(bad)
    local = apply(
        spark,
        lambda v: pages.is_local_product_url(v, base),
        [f"https://s.com{p}" for p in ("/productos/jarra-uy/", "/uy/productos/z/", "/productos/",
                                       "/productos/z/uy/")],
    )
    assert local == [True, False, False, False]


def test_platform_signs(spark):
    cases = {
        "": None,
        None: None,
        "<p>Shopify and WooCommerce compared</p>": None,
        '<form action="https://lana.myshopify.com/cart">': "shopify",
        '<img srcset="/cdn/shop/files/ovillo.webp 2x">': "shopify",
        "<script>var wc_add_to_cart_params = {}</script>": "woocommerce",
        '<div class="grid woocommerce columns-4">': "woocommerce",
        "<script>LS.variants  = [1]</script>": "tiendanube",
        '<link href="//cdn.tiendanube.com/t.css"><i class="woocommerce">': "tiendanube",
        '<a href="https://cdn.shopify.com/a"><b class="woocommerce">': "shopify",
    }
    assert apply(spark, pages.platform_sign, list(cases)) == list(cases.values())
    bodies = {'[{"id":3}]': "woocommerce", '{"products":[{}],"page":2}': "shopify", '{"products":{}}': None, "<html>": None}
    assert apply(spark, pages.feed_shape, list(bodies)) == list(bodies.values())


def test_page_brand(spark):
    cases = {
        "<title>Lanera Sur: ovillos, agujas y telares a mano</title>": "Lanera Sur",
        '<meta property="og:site_name" content="El Yunque"><title>Portada - Z</title>': "El Yunque",
        "<title>Fuelle chico - Comprar en El Yunque</title>": "El Yunque",
        "<title>Portada – Casa Quince </title>": "Casa Quince",
        "<title>Quince</title>": "Quince",
        "<title>Faro -</title>": "Faro -",
        "<p>nada</p>": "tienda",
    }
    url = F.lit("https://www.tienda.com.ar/x")
    assert apply(spark, lambda v: pages.page_brand(v, url), list(cases)) == list(cases.values())


def test_images(spark):
    assert apply(
        spark,
        media.lighten_images,
        [
            '<a href="https://q.mitiendanube.com/telar-640-480.png">'
            '<a href="https://cdn.shopify.com/z/telar.webp?t=8">',
            "https://cdn.shopify.com/b.jpeg",
            "https://cdn.shopify.com/b.jpg?width=50&t=8",
            "https://cdn.shopify.com/b.png?u=c.jpg",
            "https://cdn.shopify.com/b.png?t=8&width=1&u=2&width=9&width=7 https://x.com/?width=1&width=2",
        ],
    ) == [
        '<a href="https://q.mitiendanube.com/telar-320-320.png">'
        '<a href="https://cdn.shopify.com/z/telar.webp?t=8&width=320">',
        "https://cdn.shopify.com/b.jpeg?width=320",
        "https://cdn.shopify.com/b.jpg?width=320&t=8",
        "https://cdn.shopify.com/b.png?u=c.jpg&width=320",
        "https://cdn.shopify.com/b.png?t=8&width=320&u=2 https://x.com/?width=1&width=2",
    ]
    base = F.lit("https://s.com")
    values = ["//c.com/x", "/x", "http://c.com/x", "x", "", None, '{"url":"//c.com/y"}']
    assert apply(spark, lambda v: media.resolve_image(v, base), values) == [
        "https://c.com/x", "https://s.com/x", "http://c.com/x", None, None, None, "https://c.com/y",
    ]
    assert apply(spark, media.resolve_image, ["/x"]) == [None]


def test_date_labels(spark):
    at = [dt.datetime(2026, 6, 10, 14, 5)]
    assert apply(spark, dates.datetime_label, at, "timestamp") == ["10 de junio de 2026 · 14:05 hs"]
    assert apply(spark, lambda v: dates.datetime_label(v, "en"), at, "timestamp") == [
        "June 10, 2026 · 02:05 PM"
    ]
    assert apply(spark, dates.short_date_label, at, "timestamp") == ["10 jun"]
    assert apply(spark, lambda v: dates.short_date_label(v, "en"), at, "timestamp") == ["Jun 10"]
    assert apply(spark, dates.stamp, at, "timestamp") == ["2026-06-10_1405"]


def test_structured_data_blocks(spark):
    page = (
        '<script type="application/ld+json">{"@type":"Product","name":"A"}</script>'
        "<SCRIPT id=x type='application/ld+json'> {\"@graph\":[{\"@type\":\"BreadcrumbList\"}]} </SCRIPT>"
        '<script type="application/ld+json">["sin cerrar", {</script>'
        '<script type="application/ld+json">null</script><script>{"@type":"Product"}</script>'
    )
    rows = spark.createDataFrame([(page,)], "v string").withColumn("n", jsonld.nodes(F.col("v")))
    products = jsonld.nodes_of_type(F.col("n"), "Product")
    row = rows.select(
        F.size(products).alias("products"),
        jsonld.text_field(F.get(products, 0), "$.name").alias("name"),
        F.size(jsonld.nodes_of_type(F.col("n"), "BreadcrumbList")).alias("crumbs"),
    ).first()
    assert (row.products, row.name, row.crumbs) == (1, "A", 1)


@pytest.mark.parametrize(
    "available, stock, badge",
    [
        (False, None, "soldOut"),
        (False, 0, "outOfStock"),
        (True, None, "available"),
        (True, 5, "Stock: 5"),
        (None, 5, "outOfStock"),
    ],
)
def test_stock_badge(spark, available, stock, badge):
    rows = spark.createDataFrame([(available, stock)], "a boolean, s int")
    assert rows.select(labels.stock_badge(F.col("a"), F.col("s"))).first()[0] == badge


def test_category_path(spark):
    rows = spark.createDataFrame(
        [(["Inicio", "Remeras"], "A"), ([], "B"), (None, "Inicio")], "c array<string>, n string"
    )
    got = rows.select(
        labels.category_path(F.col("c"), F.col("n"), False),
        labels.category_path(F.col("c"), F.col("n"), True),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("Remeras › A", "Inicio › Remeras › A"),
        ("B", "Inicio › B"),
        ("", "Inicio › Inicio"),
    ]


def test_structured_data_may_repeat_a_key(spark):
    page = '<script type="application/ld+json">{"@type":"Product","name":"a","name":"b"}</script>'
    rows = spark.createDataFrame([(page,)], "v string")
    name = jsonld.text_field(F.get(jsonld.nodes(F.col("v")), 0), "$.name")
    assert rows.select(name).first()[0] == "b"
