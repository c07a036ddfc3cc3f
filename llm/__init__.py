"""Corpus operators over page texts: fingerprints, quality, de-duplication, mixing, packing, extraction, search, URL verdicts.

A *page text* is the visible text of one page: `page_id` and `data`, the text nodes of the page in order.  Operators take
the key and text column by these names, read no other column, and return only the columns they name, so extra columns of
any name do no harm.
"""
