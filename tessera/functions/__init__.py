"""Column-expression builders shared by the operators (JVM-side, codegen'd)."""

from tessera.functions.exprs import (  # noqa: F401
    money,
    money_sum,
    pct_change,
    safe_div,
    severity_from_z,
    cosine_similarity,
    numeric_columns,
    string_columns,
    is_missing,
    round4,
    hour_start,
    day_start,
)
