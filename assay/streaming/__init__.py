"""No streaming operators: everything here answers questions about whole tables.

The row-level expressions (``cleaning.tidy``, ``title_case``, ``money_to_number``, ``yes_no``,
``clean_strings``, ``coerce_numeric``, ``parse_dates``, ``date_parts``, ``predicates.filter_eq``,
``text.tag_text``, ``text.tokens``, ``text.extract_thresholds``) keep no state and therefore work
on streaming DataFrames as they are.
"""
