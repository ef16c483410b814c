"""Column-expression helpers shared by the operators (all JVM-side built-ins)."""

from tessera.functions.core import (  # noqa: F401
    col_or,
    fround,
    epoch_ms,
    md5_bucket,
    regex,
    safe_div,
    truthy,
    word_count,
    words,
)
