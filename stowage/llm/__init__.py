"""Training-data operators: extraction, filtering, tokenising, matching and deduplication of text tables.

Every operator takes DataFrames and returns a DataFrame. ``queries`` holds the thin
``opN_<name>`` queries over the driver tables and their SQL, where SQL can say the same.
"""
