"""Operators for preparing training text: quality, near copies, language, packing, scoring."""
