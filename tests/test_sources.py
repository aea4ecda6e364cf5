"""Snapshot documents, stored tables, sitemaps and arrivals."""

import datetime as dt
import json

from pyspark.sql import functions as F

from vitrina.plans import sales
from vitrina.sources import export, sitemaps, tables
from vitrina.sources.snapshots import load_snapshots, read_documents
from vitrina.streaming.arrivals import append_arrivals, arriving_documents, stored_snapshots


def dataset(day, stock, sold=None, **more):
    return {
        "brand": "Marca", "platform": "tiendanube", "currency": "ARS",
        "scrapedAt": f"2026-08-{day:02d}T12:00:00Z",
        "products": [{"id": 7, "name": "P", "price": 2000, "stock": stock, "soldQty": sold,
                      "available": stock > 0}],
        **more,
    }


def report(data):
    return (
        '<!doctype html><html><head><script type="application/json" id="scrap-data">'
        + json.dumps(data)
        + "</script><style></style></head></html>"
    )


def save(folder, files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, content in files.items():
        text = content if isinstance(content, str) else json.dumps(content)
        (folder / name).write_text(text, encoding="utf-8")


def sold(loaded):
    return {
        r.store_id: float(r.sold)
        for r in sales.store_kpis(loaded.observations, loaded.snapshots).collect()
    }


def test_json_and_html_documents_mix_and_bad_ones_are_reported(spark, tmp_path):
    save(
        tmp_path / "shop",
        {
            "a.json": dataset(1, 10, 30),
            "b.html": report(dataset(8, 4, 37)),
            "c.json": "{{{corrupt",
            "d.html": "<html>hello</html>",
            "e.json": {"products": [{"name": "no id"}, None]},
            "f.json": dataset(3, 1) | {"scrapedAt": "yesterday", "products": []},
            "g.json": json.dumps(dataset(4, 1)) + " trailing",
            "h.txt": "  <div>",
            "j.json": dataset(3, 1) | {"scrapedAt": "12:30"},
            "i.json": {"scrapedAt": "2026-08-01", "products": {"id": 1}},
        },
    )
    loaded = load_snapshots(read_documents(spark, str(tmp_path / "shop")))
    assert sold(loaded) == {"shop": 7}
    rejected = {r.source_file: "; ".join(r.errors) for r in loaded.rejects.collect()}
    assert rejected == {
        "c.json": "not valid JSON",
        "d.html": "HTML without an embedded dataset",
        "e.json": 'no "scrapedAt"; 2 product(s) without "id"',
        "f.json": '"scrapedAt" is not a date: yesterday; "products" is empty',
        "g.json": "not valid JSON",
        "h.txt": "HTML without an embedded dataset",
        "i.json": 'no "products" list',
        "j.json": '"scrapedAt" is not a date: 12:30',
    }


def test_defaults_id_types_and_epoch_times(spark, tmp_path):
    first = {"scrapedAt": 1785585600000, "products": [{"id": "1", "price": 1.5, "stock": 2.5}]}
    second = {"scrapedAt": "2026-08-02T12:00:00Z", "products": [{"id": 1, "price": 1, "stock": 1}]}
    save(tmp_path / "shop", {"x.json": first, "y.json": second})
    loaded = load_snapshots(read_documents(spark, str(tmp_path / "shop")))
    heads = loaded.snapshots.orderBy("snap_ord").collect()
    assert [h.brand for h in heads] == ["Marca", "Marca"] and heads[0].platform is None
    assert heads[0].scraped_at == dt.datetime(2026, 8, 1, 12)
    row = sales.store_kpis(loaded.observations, loaded.snapshots).first()
    assert float(row.sold) == 1.5 and float(row.revenue) == 2.25


def test_a_bad_part_rejects_its_snapshot(spark, tmp_path):
    save(
        tmp_path / "shop",
        {
            "a.json": dataset(1, 10),
            "a.part00001.json": dataset(1, 9, products=[{"id": 8, "stock": 3}]),
            "b.json": dataset(2, 5),
            "b.part00001.json": "broken",
            "c.json": dataset(3, 5),
            "c.part00001.json": dataset(4, 5),
        },
    )
    loaded = load_snapshots(read_documents(spark, str(tmp_path / "shop")))
    assert [(r.snapshot_id, r.n_products) for r in loaded.snapshots.collect()] == [("a.json", 2)]
    assert loaded.observations.count() == 2
    assert {r.source_file for r in loaded.rejects.collect()} == {"b.part00001.json", "c.json"}


def catalog(spark, size):
    variants = "array<struct<size:string,sku:string,stock:decimal(18,4),available:boolean>>"
    rows = spark.range(size).selectExpr(
        "'s' AS store_id", "id AS pos", "string(id) AS id", "concat('n', id % 5) AS name",
        "'b' AS brand", "'u' AS url", "CAST(id AS DECIMAL(18,4)) AS price",
        "CAST(id AS DECIMAL(18,4)) AS min_price", "CAST(id AS DECIMAL(18,4)) AS max_price",
        "CAST(if(id % 3 = 0, NULL, id) AS DECIMAL(18,4)) AS stock_total",
        "CAST(NULL AS DECIMAL(18,4)) AS sold_qty", "id % 2 = 0 AS available", "'ARS' AS currency",
    )
    one = F.array(
        F.struct(F.lit("M").alias("size"), F.lit("k").alias("sku"), F.lit(1).alias("stock"),
                 F.lit(True).alias("available"))
    )
    return rows.withColumn("variants", one.cast(variants))


def stores(spark):
    return spark.createDataFrame(
        [("s", "Ñandú", None, "https://s", dt.datetime(2026, 6, 10, 12, 34))],
        "store_id string, brand string, platform string, source string, scraped_at timestamp",
    )


def test_documents_written_in_parts_read_back_in_order(spark):
    products = catalog(spark, 25)
    written = export.snapshot_documents(stores(spark), products, max_products=10).cache()
    names = sorted(r.source_file for r in written.collect())
    stem = "Catalog_Nandu_2026-06-10_1234"
    assert names == [f"{stem}.json", f"{stem}.part00001.json", f"{stem}.part00002.json"]
    head = json.loads(written.where(F.col("source_file") == f"{stem}.json").first().body)
    assert head["platform"] == "tiendanube" and head["summary"]["stockKnown"] == 16
    assert head["scrapedAt"].startswith("2026-06-10T12:34:00.000")
    assert set(head["products"][0]) == {
        "id", "name", "brand", "price", "stock", "soldQty", "available", "variants",
    }
    loaded = load_snapshots(written)
    got = [r.product_id for r in loaded.observations.orderBy("pos").collect()]
    want = sorted(range(25), key=lambda i: (i % 2, f"n{i % 5}", i))
    assert got == [str(i) for i in want]
    assert loaded.snapshots.first().n_products == 25


def test_small_stores_are_one_document_that_files_carry(spark, tmp_path):
    written = export.snapshot_documents(stores(spark), catalog(spark, 7))
    export.write_document_files(written, str(tmp_path / "files"))
    export.write_documents(written, str(tmp_path / "rows"))
    read = read_documents(spark, str(tmp_path / "files"))
    assert [(r.store_id, r.source_file) for r in read.collect()] == [
        ("s", "Catalog_Nandu_2026-06-10_1234.json")
    ]
    for documents in (read, spark.read.parquet(str(tmp_path / "rows"))):
        assert load_snapshots(documents).observations.count() == 7


def test_file_names_with_spaces_and_signs(spark, tmp_path):
    save(tmp_path / "my shop+1", {"a b+c.json": dataset(1, 1)})
    row = read_documents(spark, str(tmp_path / "my shop+1")).first()
    assert (row.store_id, row.source_file) == ("my shop+1", "a b+c.json")


def test_stored_observations_round_trip(spark, tmp_path, shop):
    observations, _ = shop((0, [{"id": 1, "stock": 2}]), (1, [{"id": 1, "stock": 1}]), store="007")
    rows = observations.withColumn("scraped_at", F.lit("2026-08-01 10:00:00").cast("timestamp"))
    path = str(tmp_path / "observations")
    tables.write_observations(rows, path)
    back = tables.read_observations(spark, path)
    assert {r.store_id for r in back.collect()} == {"007"}
    assert back.count() == 2
    assert [str(r.snapshot_date) for r in back.collect()] == ["2026-08-01"] * 2


def sitemap(kind, *locs):
    return f"<{kind}>" + "".join(f"<url><loc> {l} </loc></url>" for l in locs) + f"</{kind}>"


def test_sitemap_walk_is_breadth_first_and_survives_cycles(spark):
    base = "https://s"
    robots = spark.createDataFrame(
        [("s", base, "x\nSITEMAP: https://s/r.xml\n")], "store_id string, base string, body string"
    )
    saved = spark.createDataFrame(
        [
            ("s", f"{base}/r.xml", sitemap("sitemapindex", f"{base}/a.xml", f"{base}/b.xml?x", f"{base}/no")),
            ("s", f"{base}/a.xml", sitemap("sitemapindex", f"{base}/r.xml", f"{base}/c.xml")),
            ("s", f"{base}/b.xml?x", sitemap("urlset", f"{base}/p/2", f"{base}/p/1")),
            ("s", f"{base}/c.xml", sitemap("urlset", f"{base}/p/1", f"{base}/about")),
            ("s", f"{base}/sitemap.xml", sitemap("urlset", f"{base}/producto/9")),
            ("s", f"{base}/unlinked.xml", sitemap("urlset", f"{base}/p/5")),
        ],
        "store_id string, url string, xml string",
    )
    found = sitemaps.reachable_sitemaps(robots, saved)
    order = [r.url[len(base):] for r in found.orderBy(F.size("path"), "path").collect()]
    assert order == ["/r.xml", "/sitemap.xml", "/a.xml", "/b.xml?x", "/c.xml"]
    few = sitemaps.reachable_sitemaps(robots, saved, max_documents=3)
    assert {r.url[len(base):] for r in few.collect()} == {"/r.xml", "/sitemap.xml", "/a.xml"}

    listed = sitemaps.listed_urls(found, saved)
    urls = [r.url[len(base):] for r in listed.orderBy("listed_at").collect()]
    assert urls == ["/producto/9", "/p/2", "/p/1", "/about"]
    bases = robots.select("store_id", "base")
    chosen = sitemaps.product_urls(listed, bases).collect()
    assert {(r.url[len(base):], r.sampled) for r in chosen} == {
        ("/producto/9", False), ("/p/2", False), ("/p/1", False),
    }
    unclear = listed.where(F.col("url").endswith("about")).unionByName(
        listed.select("store_id", F.lit("https://elsewhere/x").alias("url"), "listed_at").limit(1)
    )
    sample = sitemaps.product_urls(unclear, bases).collect()
    assert [(r.url[len(base):], r.sampled) for r in sample] == [("/about", True)]


def test_local_product_urls(spark):
    base = "https://t"
    bases = spark.createDataFrame([("t", base)], "store_id string, base string")
    saved = spark.createDataFrame(
        [
            ("t", f"{base}/sitemap.xml", sitemap("sitemapindex", f"{base}/m.xml")),
            ("t", f"{base}/m.xml", sitemap("urlset", f"{base}/productos/a/", f"{base}/productos/a/",
                                            f"{base}/mx/productos/a/", f"{base}/productos/")),
        ],
        "store_id string, url string, xml string",
    )
    got = sitemaps.local_product_urls(bases, saved).collect()
    assert [r.url for r in got] == [f"{base}/productos/a/"]


def test_sitemaps_are_searched_once(spark, tmp_path, monkeypatch):
    base, path = "https://t", str(tmp_path / "maps")
    bases = spark.createDataFrame([("t", base, None)], "store_id string, base string, body string")
    spark.createDataFrame(
        [
            ("t", f"{base}/sitemap.xml", sitemap("sitemapindex", f"{base}/m.xml", f"{base}/m.xml")),
            ("t", f"{base}/m.xml", sitemap("urlset", f"{base}/productos/a/")),
            ("t", f"{base}/empty.xml", ""),
        ],
        "store_id string, url string, xml string",
    ).write.parquet(path)
    searched = []
    real = sitemaps.read_locations
    monkeypatch.setattr(sitemaps, "read_locations", lambda saved: searched.append(1) or real(saved))
    saved = spark.read.parquet(path)
    local = sitemaps.local_product_urls(bases.select("store_id", "base"), saved)
    assert searched == [1] and [r.url for r in local.collect()] == [f"{base}/productos/a/"]
    locations = sitemaps.location_table(saved)
    listed = sitemaps.listed_urls(sitemaps.reachable_sitemaps(bases, locations), locations)
    chosen = sitemaps.product_urls(listed, bases.select("store_id", "base"))
    assert searched == [1, 1] and chosen.count() == 1
    for df in (local, chosen):
        shown = df._jdf.queryExecution().executedPlan().toString()
        assert "regexp_extract_all" not in shown and path not in shown


def test_indexes_that_name_each_other_are_walked_once(spark):
    base = "https://s"
    urls = [f"{base}/sitemap.xml", *(f"{base}/i{n}.xml" for n in range(9))]
    saved = spark.createDataFrame(
        [("s", url, sitemap("sitemapindex", *urls)) for url in urls], "store_id string, url string, xml string"
    )
    robots = spark.createDataFrame([("s", base, None)], "store_id string, base string, body string")
    found = sitemaps.reachable_sitemaps(robots, saved)
    assert sorted(r.url for r in found.collect()) == sorted(urls)


def test_arriving_files_are_appended_once(spark, tmp_path):
    inbox, store, marks = tmp_path / "inbox", str(tmp_path / "t"), str(tmp_path / "marks")

    def run():
        assert append_arrivals(arriving_documents(spark, str(inbox)), store, marks).awaitTermination(120)
        return stored_snapshots(spark, store)

    save(inbox / "shop", {"b.json": dataset(4, 6), "bad.json": "{"})
    assert run().observations.count() == 1
    # the earlier capture arrives later
    save(inbox / "shop", {"a.html": report(dataset(2, 9))})
    save(inbox / "other", {"b.json": dataset(2, 9)})
    loaded = run()
    assert loaded.observations.count() == 3 and loaded.rejects.count() == 1
    assert run().observations.count() == 3
    assert sold(loaded) == {"shop": 3, "other": 0}
