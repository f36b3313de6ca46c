"""Training-data operators: packing, id files, search, scans, language, quality, copies.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
``opN_*`` queries; every other module is one operator with a general interface.
"""
