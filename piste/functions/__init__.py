from piste.functions.core import (  # noqa: F401
    NULL_KEY_TOKEN,
    date_key,
    dow0,
    fround,
    hour_boundary_diff,
    round_doubles,
    safe_div,
    surrogate_key,
    ts_text,
    year_boundary_diff,
)
