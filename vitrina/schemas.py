"""Column types and fixed schemas shared by the sources, operators and plans."""

from pyspark.sql import types as T

# Money is exact so that sums do not depend on the order Spark adds them in. Prices go up to
# 10^20, for currencies of small value; with UNITS they multiply to decimal(38,6).
PRICE = T.DecimalType(24, 4)
# Stock and counters read from documents may carry a fraction (goods by weight).
UNITS = T.DecimalType(18, 4)


# One product as every adapter emits it, in this column order.
PRODUCT_COLUMNS = [
    "store_id",
    "platform",
    "pos",
    "id",
    "name",
    "brand",
    "url",
    "crumbs",
    "seo_title",
    "meta_description",
    "description",
    "main_image",
    "price_short",
    "price",
    "min_price",
    "max_price",
    "compare_short",
    "promo_short",
    "pay_discount",
    "stock_total",
    "sold_qty",
    "available",
    "size_option_name",
    "variants",
    "currency",
]

VARIANTS_TYPE = (
    "array<struct<size:string,sku:string,stock:decimal(18,4),available:boolean,"
    "price_short:string,promo_short:string,compare_short:string,"
    "pay_discount_short:string,image:string>>"
)

# A saved snapshot document. `id` is text so that 1 and "1" are one product, and
# `scrapedAt` is text because documents carry either ISO-8601 or epoch millis. `price` is text
# so that one that cannot be read is told from one that is missing.
SNAPSHOT_DOCUMENT = (
    "platform string, brand string, source string, currency string, scrapedAt string, "
    "summary struct<stockTotal:decimal(18,4),stockKnown:bigint,"
    "minPrice:decimal(24,4),maxPrice:decimal(24,4)>, "
    "products array<struct<id:string,name:string,brand:string,price:string,"
    "stock:decimal(18,4),soldQty:decimal(18,4),available:boolean,"
    "variants:array<struct<size:string,stock:decimal(18,4),sku:string>>>>"
)

# Public feed of one platform: {"products": [...]}. Prices stay VARIANT so a JSON
# number and a localised string can be told apart.
SHOPIFY_FEED = (
    "products array<struct<id:string,title:string,handle:string,body_html:string,"
    "vendor:string,product_type:string,"
    "variants:array<struct<option1:string,option2:string,option3:string,sku:string,"
    "available:boolean,price:variant,compare_at_price:variant,"
    "featured_image:struct<src:string>>>,"
    "images:array<struct<src:string>>,options:array<struct<name:string>>>>"
)

# The other platform's feed is a bare top-level array.
WOOCOMMERCE_FEED = (
    "array<struct<id:string,name:string,permalink:string,short_description:string,"
    "description:string,on_sale:boolean,is_in_stock:boolean,low_stock_remaining:double,"
    "prices:struct<price:string,regular_price:string,sale_price:string,"
    "price_range:struct<min_amount:string,max_amount:string>,"
    "currency_code:string,currency_minor_unit:double>,"
    "images:array<struct<src:string>>,categories:array<struct<name:string>>,"
    "brands:array<struct<name:string>>,attributes:array<struct<name:string>>>>"
)

# JSON embedded in a Tienda Nube product page.
EMBEDDED_PRODUCT = (
    "id string, name string, brand string, canonical_url string, seo_title string, "
    "stock double, price double, sold_qty double, featured_image string, "
    "default_options array<struct<name:string>>"
)
EMBEDDED_VARIANTS = (
    "array<struct<option0:string,sku:string,stock:string,available:string,"
    "price_number:double,price_short:string,has_promotional_price:string,"
    "promotional_price_short:string,compare_at_price_short:string,"
    "price_with_payment_discount_short:string,image_url:string>>"
)
