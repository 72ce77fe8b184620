"""Operators for preparing training data: counting, deduplication, search, cleaning, classification, packing.

Every operator is ``DataFrame -> DataFrame``. It takes the names of the columns it reads, renames them at once, and never touches the
others, so extra columns of any name do no harm. Nothing else in the library imports this subpackage.
"""
