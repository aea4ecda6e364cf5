"""The build of catalog snapshots from captures."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from vitrina.operators import ordering
from vitrina.operators.catalog import catalog_summary
from vitrina.operators.ordering import block_count, rank_within
from vitrina.plans.catalog import Captures, build_snapshot, chosen_pages, detect_stores
from vitrina.session import written_table
from vitrina.sources import export
from vitrina.sources.snapshots import load_snapshots

AT = dt.datetime(2026, 3, 9, 8, 5)


def product_page(name, price, brand="Propia"):
    node = {"@type": "Product", "name": name, "brand": brand, "offers": {"price": price, "priceCurrency": "UYU"}}
    return f'<script type="application/ld+json">{json.dumps(node)}</script>'


def site(*urls):
    return "<urlset>" + "".join(f"<loc>{u}</loc>" for u in urls) + "</urlset>"


@pytest.fixture
def captures(spark):
    """A shop with a feed, one that has lost its feed, one known by its feed only, and a plain one."""
    base = {name: f"https://{name}.example" for name in ("feed", "lost", "shape", "plain", "closed")}
    marks = {
        "feed": "<title>Feria: todo junto</title><script>Shopify.shop</script>",
        "lost": '<meta property="og:site_name" content="Un nombre muy largo"><link href="/wp-content/plugins/woocommerce/a.css">',
        "shape": "<title>Portada - Por su forma</title>",
        "plain": None,
        "closed": "<title>Cerrado</title>",
    }
    item = {"id": 1, "title": "Jarra", "handle": "jarra", "vendor": "Feria", "variants": [{"price": "12.50", "available": True}]}
    woo = {"id": 5, "name": "Vela", "prices": {"price": "300", "currency_code": "EUR"}, "is_in_stock": True}
    pages = [("lost", f"{base['lost']}/p/{n}", product_page(f"n{n}", n)) for n in range(1, 7)]
    pages += [("lost", f"{base['lost']}/blog/7", product_page("not listed as a product", 7))]
    pages += [("plain", f"{base['plain']}/producto/faro", product_page("Faro", 40, "Otra"))]
    pages += [("plain", f"{base['plain']}/producto/sin-mapa", product_page("unlisted", 50))]
    pages += [("feed", f"{base['feed']}/p/9", product_page("its feed counts", 9))]
    urls = {name: [u for s, u, _ in pages if s == name and not u.endswith("sin-mapa")] for name in base}
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return Captures(
        make([(n, base[n], marks[n], AT) for n in base], "store_id string, base string, html string, scraped_at timestamp"),
        make(
            [("feed", 1, json.dumps({"products": [item]})), ("shape", 1, json.dumps([woo])), ("lost", 1, "[]")],
            "store_id string, page int, body string",
        ),
        make(pages, "store_id string, url string, html string"),
        make([(n, base[n], None) for n in base], "store_id string, base string, body string"),
        make([(n, f"{base[n]}/sitemap.xml", site(*urls[n])) for n in base if urls[n]], "store_id string, url string, xml string"),
    )


def test_stores_are_detected_by_mark_then_feed(captures):
    got = {r.store_id: (r.platform, r.brand) for r in detect_stores(captures).collect()}
    assert got == {
        "feed": ("shopify", "Feria"), "lost": ("woocommerce", "Un nombre muy largo"),
        "shape": ("woocommerce", "Por su forma"), "plain": ("generic", "plain"), "closed": ("generic", "Cerrado"),
    }


def test_only_listed_product_pages_are_read(captures):
    pages = chosen_pages(captures, detect_stores(captures)).collect()
    assert sorted(r.url.split(".example")[1] for r in pages) == [*(f"/p/{n}" for n in range(1, 7)), "/producto/faro"]


def test_the_build_up_to_documents(spark, captures, tmp_path):
    built = build_snapshot(captures)
    names = {(r.store_id, r.name) for r in built.products.collect()}
    assert names == {("feed", "Jarra"), ("shape", "Vela"), ("plain", "Faro"), *(("lost", f"n{n}") for n in range(1, 7))}
    # six of six products carry the shorter brand; one of one is too few
    assert {r.store_id: r.brand for r in built.stores.collect()} == {
        "feed": "Feria", "lost": "Propia", "shape": "Por su forma", "plain": "plain",
    }
    export.write_documents(built.documents, str(tmp_path / "documents"))
    stored = spark.read.parquet(str(tmp_path / "documents"))
    assert {str(r.snapshot_date) for r in stored.collect()} == {"2026-03-09"}
    loaded = load_snapshots(stored)
    heads = {r.store_id: r for r in loaded.snapshots.collect()}
    lost = heads["lost"]
    assert (lost.snapshot_id, lost.platform, lost.source) == ("Catalog_Propia_2026-03-09_0805.json", "woocommerce", "https://lost.example")
    assert (lost.currency, lost.n_products, lost.stock_total, lost.stock_known) == ("UYU", 6, None, 0)
    assert (float(lost.min_price), float(lost.max_price)) == (1, 6) and lost.scraped_at == AT
    assert float(heads["shape"].min_price) == 3 and heads["feed"].currency is None
    direct = built.observations.select("store_id", "product_id", "price").collect()
    assert sorted(map(tuple, direct)) == sorted(
        map(tuple, loaded.observations.select("store_id", "product_id", "price").collect())
    )
    summary = catalog_summary(built.products, built.stores).where("store_id = 'lost'").first()
    assert summary.source == "https://lost.example" and summary.products == 6


def test_documents_rank_a_catalog_once(captures, monkeypatch):
    built = build_snapshot(captures)
    calls = []
    real = export.rank_within
    monkeypatch.setattr(export, "rank_within", lambda *a, **k: calls.append(1) or real(*a, **k))
    documents = export.snapshot_documents(built.stores, built.products, max_products=2)
    shown = documents._jdf.queryExecution().executedPlan().toString()
    assert calls == [1] and shown.count("Scan ExistingRDD") <= 2
    assert sorted(r.source_file for r in documents.where("store_id = 'lost'").collect()) == [
        "Catalog_Propia_2026-03-09_0805.json",
        "Catalog_Propia_2026-03-09_0805.part00001.json",
        "Catalog_Propia_2026-03-09_0805.part00002.json",
    ]


def test_blocks_follow_the_size_of_the_table(spark, monkeypatch):
    sizes = []
    for n in (1_000, 100_000):
        stored = written_table(spark.range(n).select("id", F.md5(F.col("id").cast("string")).alias("v")), "sized")
        monkeypatch.setattr(ordering, "BLOCK_BYTES", 100_000)
        sizes.append(block_count(stored))
        rows = [r["rank"] for r in rank_within(stored, [], [F.col("v")]).orderBy("v").collect()]
        assert rows == list(range(1, n + 1))
    assert sizes[0] == 2 and 30 < sizes[1] < 70
