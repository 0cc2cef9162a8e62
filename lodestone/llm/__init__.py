"""Training-data operators (URL filters, secret scans, language ID, near and
exact dedup, chat formatting, mixing, decontamination, token output, quality
classification, vector codes, periodic runs).

Nothing outside this subpackage imports it.
"""
