from stayline.sources.customers import (  # noqa: F401
    customers, keep_table, read_customers, requests,
)
from stayline.sources.exports import export_csv  # noqa: F401
from stayline.sources.staging import stage  # noqa: F401
from stayline.sources.star import (  # noqa: F401
    customer_view, partner_base, partner_upload, star_tables,
)
