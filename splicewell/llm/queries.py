"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from .hnsw import op5_hnsw
from .imatch import op6_imatch
from .langid import op7_language
from .nbest import op9_nbest
from .packing import op3_packing
from .pii import op1_pii
from .simhash import op4_simhash
from .tokens import op10_tokens
from .toxicity import op2_toxicity
from .trie import OP13_SQL, op13_trie
from .urls import OP8_SQL, op8_urls
from .warc import OP12_SQL, op12_warc
from .whitening import op11_whitening

QUERIES = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_simhash": op4_simhash,
    "op5_hnsw": op5_hnsw,
    "op6_imatch": op6_imatch,
    "op7_language": op7_language,
    "op8_urls": op8_urls,
    "op9_nbest": op9_nbest,
    "op10_tokens": op10_tokens,
    "op11_whitening": op11_whitening,
    "op12_warc": op12_warc,
    "op13_trie": op13_trie,
}
ORACLES: dict[str, str] = {"op8_urls": OP8_SQL, "op12_warc": OP12_SQL, "op13_trie": OP13_SQL}
