"""Column -> Column functions (all built from Spark SQL expressions)."""

from credline.functions.text import (  # noqa: F401
    append_joined, clean_ocr, dedupe_key, na_to_null, split_lines_stripped,
    strip_ws, tag_all_o, tokens, untag, verbatim_ok,
)
