"""Adapters on small captures written here."""

import json

import pytest

from vitrina.operators import catalog
from vitrina.operators.adapters import (
    embedded_products,
    shopify_products,
    structured_products,
    woocommerce_products,
)
from vitrina.operators.adapters.embedded import bracketed, description_block

BASE = "https://shop.example.com"


def feed(spark, body):
    return spark.createDataFrame(
        [("s", BASE, 1, json.dumps(body))], "store_id string, base string, page int, body string"
    )


def page(spark, *htmls, url=BASE + "/p/thing-1/"):
    return spark.createDataFrame(
        [("s", BASE, url, h) for h in htmls],
        "store_id string, base string, url string, html string",
    )


def test_shopify_sale_prices_and_defaults(spark):
    body = {
        "products": [
            {
                "id": 52,
                "title": "Farol",
                "handle": "farol",
                "body_html": "<p>Light<br>shoe &amp; more</p>",
                "vendor": "Maker",
                "product_type": "Shoes",
                "variants": [
                    {"option1": "8", "option2": None, "sku": "A8", "available": False,
                     "price": "48.00", "compare_at_price": "75.00", "featured_image": None},
                    {"option1": "9", "option2": "Red", "sku": None, "available": True,
                     "price": "95.50", "compare_at_price": "95.50",
                     "featured_image": {"src": "https://i/9.jpg"}},
                ],
                "images": [],
                "options": [{"name": "Size"}],
            },
            {"id": 2, "title": "Plain", "handle": "plain",
             "variants": [{"option1": "Default Title", "available": False, "price": 10}]},
        ]
    }
    first, second = shopify_products(feed(spark, body)).orderBy("pos").collect()
    assert (first.id, first.url) == ("52", BASE + "/products/farol")
    assert (float(first.min_price), float(first.max_price)) == (48, 95.5)
    assert (first.price_short, first.promo_short, first.compare_short) == ("$75", "$48", "$75")
    assert first.available and first.stock_total is None and first.sold_qty is None
    assert first.crumbs == ["Shoes"] and first.size_option_name == "Size"
    assert first.description == "Light shoe & more" and first.main_image == "https://i/9.jpg"
    assert [(v.size, v.sku, v.promo_short) for v in first.variants] == [
        ("8", "A8", "$48"), ("9 / Red", "", None),
    ]
    assert (second.size_option_name, second.variants[0].size) == ("Variante", "—")
    assert not second.available and second.crumbs == [] and second.brand == ""


def test_woocommerce_minor_units_and_sales(spark):
    body = [
        {"id": 31, "name": "Hook <b>Board</b> &amp; Rail", "permalink": "", "on_sale": True,
         "is_in_stock": True, "low_stock_remaining": 3,
         "prices": {"price": "640", "regular_price": "720", "sale_price": "640",
                    "price_range": None, "currency_code": "USD", "currency_minor_unit": 2},
         "short_description": "", "description": "<p>long</p>",
         "categories": [{"name": "Workshop"}], "attributes": [{"name": "Rail Length"}]},
        {"id": 2, "name": "Range", "permalink": BASE + "/r", "on_sale": False, "is_in_stock": False,
         "prices": {"price": "1000", "price_range": {"min_amount": "1000", "max_amount": "2500"},
                    "currency_minor_unit": 0}},
    ]
    first, second = woocommerce_products(feed(spark, body)).orderBy("pos").collect()
    assert first.name == "Hook Board & Rail" and first.url == BASE
    assert float(first.price) == 6.4 and first.stock_total == 3 and first.currency == "USD"
    assert (first.price_short, first.promo_short, first.compare_short) == ("$7", "$6", "$7")
    assert first.crumbs == ["Workshop"] and first.size_option_name == "Rail Length"
    assert first.description == "long" and first.variants == []
    assert (float(second.min_price), float(second.max_price)) == (1000, 2500)
    assert second.price_short == "$1.000" and not second.available and second.crumbs == []


def product_page(variants, product="", tail=""):
    return (
        "<script>LS.product = {\n id : 55, x: '}' };</script>"
        '<script>a={"id":55,"name":"Box &amp; co","price":8410000'
        + product
        + "}; LS.variants = "
        + variants
        + ";</script>"
        + tail
    )


def test_embedded_page(spark):
    html = product_page(
        '[{"option0":"M","stock":3,"available":true,"price_number":84100,'
        '"price_short":"$84.100,00","image_url":"//c/a.jpg"},'
        '{"option0":null,"stock":null,"available":false,"price_number":90300}]',
        ',"sold_qty":0,"canonical_url":"https://shop.example.com/productos/box/"',
        '<meta name="description" content="short">'
        '<div class="product-description"><div>a much longer</div> text</div>',
    )
    row = embedded_products(page(spark, html)).first()
    assert (row.id, row.name, row.url) == ("55", "Box & co", BASE + "/productos/box/")
    assert (float(row.price), float(row.max_price)) == (84100, 90300)
    assert row.stock_total == 3 and row.sold_qty == 0 and row.available
    assert row.price_short == "$84.100" and row.main_image == "https://c/a.jpg"
    assert [(v.size, v.stock) for v in row.variants] == [("M", 3), ("—", None)]
    assert row.description == "a much longer text" and row.size_option_name == "Talle"


def test_crumbs_are_the_names_of_the_list(spark):
    items = '{"@type":"ListItem","item":["x"],"name":"Luces"},{"name":"Faroles"},{"name":"Farol"}'
    block = '{"@type":"BreadcrumbList","itemListElement" : [%s],"@id":"b"},{"@type":"Organization","name":"Taller"}'
    script = '<script type="application/ld+json">[%s]</script><p>"name":"outside"</p>'
    pages = page(
        spark,
        product_page("[]", tail=script % (block % items)),
        product_page("[]", tail='<script>{"@type":"BreadcrumbList","name":"A"},{"name":"B"}</script>'),
        product_page("[]"),
    )
    assert [r.crumbs for r in embedded_products(pages).collect()] == [["Luces", "Faroles"], ["A"], []]


def test_embedded_page_without_variants_uses_cents(spark):
    row = embedded_products(page(spark, product_page("[]"))).first()
    assert float(row.price) == 84100 and row.price_short == "$84.100"
    assert row.stock_total == 0 and not row.available and row.sold_qty is None


def test_unreadable_product_pages_drop_out(spark):
    pages = page(
        spark,
        "<html>no product</html>",
        product_page("[{broken]"),
        "LS.product = { id: 9 }; nothing else",
        "LS.product = { unclosed",
        product_page("[]"),
    )
    assert [r.id for r in embedded_products(pages).collect()] == ["55"]


def test_bracket_scan():
    text = """x = {"a":{"b":"has } brace"},"c":[1,{"d":"y \\" esc"}], 'e': '{'}; rest"""
    block = bracketed(text, text.index("{"))
    assert block.endswith("'{'}") and bracketed("{ [ }", 0) is None
    assert bracketed('{"open', 0) is None and bracketed("abc", -1) is None
    assert description_block('<div class="product-description"><div>x</div>y</div>z') == "<div>x</div>y"
    assert description_block('<div class="product-description"><div>x</div>') is None


def ld(*nodes):
    return "".join(f'<script type="application/ld+json">{json.dumps(n)}</script>' for n in nodes)


def test_structured_page(spark):
    html = "<title>Farol de mano</title>" + ld(
        {
            "@type": "Product",
            "image": [["https://i/nested.jpg"]],
            "sku": "F-0417",
            "brand": {"@type": "Brand", "name": "Taller Norte"},
            "description": "",
            "offers": [{"price": 31250, "priceCurrency": "ARS", "availability": "InStock"}],
            "name": "Farol de mano",
        }
    ) + '<meta property="og:description" content="About &eacute;l">'
    row = structured_products(page(spark, html)).first()
    assert (row.id, row.name, row.brand) == ("F-0417", "Farol de mano", "Taller Norte")
    assert float(row.price) == 31250 and row.currency == "ARS" and row.available
    assert row.main_image is None and row.stock_total is None
    assert row.description == "About él" and row.price_short == "$31.250"


def test_pages_without_a_priced_product_drop_out(spark):
    pages = page(
        spark,
        "<html><body>a blog</body></html>",
        '<meta property="og:type" content="product">',
        ld({"@type": "Product", "name": "unpriced"}),
    )
    assert structured_products(pages).count() == 0


def test_page_product_among_related_ones(spark):
    nodes = [
        {"@type": "Product", "name": "Other", "offers": {"price": "5"}},
        {"@type": "Product", "name": "The Long Named Product Itself", "offers": {"price": "1.234,5"}},
    ]
    html = ld(nodes) + '<meta property="og:title" content="the long named product it…">'
    row = structured_products(page(spark, html)).first()
    assert row.name == "The Long Named Product Itself" and float(row.price) == 1234.5
    assert row.id == "thing-1"
    untitled = structured_products(page(spark, ld(nodes))).first()
    assert untitled.name == "Other"


@pytest.mark.parametrize(
    "offers, text, available",
    [
        ({"price": 1, "availability": "https://schema.org/OutOfStock"}, "", False),
        ([{"price": 1, "availability": "OutOfStock"}, {"availability": "preorder"}], "", True),
        ({"price": 1}, "<b>AGOTADO</b>", False),
        ({"price": 1}, "", True),
    ],
)
def test_availability(spark, offers, text, available):
    html = ld({"@type": "Product", "name": "x", "offers": offers}) + text
    assert structured_products(page(spark, html)).first().available is available


def test_every_adapter_has_the_same_columns(spark):
    feeds, pages = feed(spark, []), page(spark, "")
    made = [
        shopify_products(feeds),
        woocommerce_products(feeds),
        embedded_products(pages),
        structured_products(pages),
    ]
    assert len({tuple((f.name, f.dataType) for f in df.schema.fields) for df in made}) == 1
    assert catalog.union_catalogs(made).count() == 0


def test_majority_brand_needs_votes_and_a_shorter_name(spark):
    def vote(brands, name):
        stores = spark.createDataFrame([("s", name)], "store_id string, brand string")
        products = spark.createDataFrame(
            [("s", b, i, f"u{i:02d}") for i, b in enumerate(brands)],
            "store_id string, brand string, pos bigint, url string",
        )
        return catalog.store_brands(stores, products).first().brand

    assert vote(["A"] * 5 + ["B"] * 5, "Long name") == "A"  # tie: first seen
    assert vote(["A"] * 4, "Long name") == "Long name"  # too few
    assert vote(["A"] * 5 + ["B"] * 6, "Long name") == "B"
    assert vote([f"{i}" for i in range(6)] + ["A"] * 5, "Long name") == "Long name"
    assert vote(["A much longer brand"] * 9, "Long name") == "Long name"
    assert vote(["", None, ""] + ["A"] * 5, "Long name") == "A"
