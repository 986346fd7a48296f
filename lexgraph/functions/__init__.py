"""Column expressions shared by the operators (all JVM-side, codegen'd)."""

from lexgraph.functions.text import (  # noqa: F401
    SENTENCE_RE, TOKEN_RE, WS, sentences, strip_ws, words, word_count, tokens, count_char,
)
from lexgraph.functions.vector import dot, norm, cosine, angle, l2, rbf, normalize  # noqa: F401
from lexgraph.functions.rand import order_key, draw_index, hash_bucket  # noqa: F401
