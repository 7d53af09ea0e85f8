"""The registered queries of this subpackage."""

from __future__ import annotations

from . import ann, byte_bpe, chat_format, html_text, language_id, mixing, ngram_join, packing, quality, ranked_search, revisit, substring_dedup, whitening

_MODULES = [ngram_join, mixing, packing, revisit, substring_dedup, ann, quality, language_id, html_text, chat_format, whitening, byte_bpe, ranked_search]

QUERIES = {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
