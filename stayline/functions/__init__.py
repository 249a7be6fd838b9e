from stayline.functions.columns import (  # noqa: F401
    at_least, at_most, churn_class, churn_status, clamp, percent, risk_band, round_even,
)
from stayline.functions.display import (  # noqa: F401
    long_date, lakh, money, percent_text, rupee_thousands, signed_percent_text, stars,
)
