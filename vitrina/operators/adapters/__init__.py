"""One module per platform, each turning captured pages or feeds into products.

An adapter is a function from a DataFrame of captures to a DataFrame with the
columns of `vitrina.schemas.PRODUCT_COLUMNS`. Adding a platform means adding its
function to `ADAPTERS`.
"""

from vitrina.operators.adapters.embedded import embedded_products
from vitrina.operators.adapters.shopify import shopify_products
from vitrina.operators.adapters.structured import structured_products
from vitrina.operators.adapters.woocommerce import woocommerce_products

ADAPTERS = {
    "tiendanube": embedded_products,
    "shopify": shopify_products,
    "woocommerce": woocommerce_products,
    "generic": structured_products,
}
