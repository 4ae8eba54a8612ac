"""Operators for preparing language-model training data.

Each module holds one operator with its general interface; `queries.py` applies them to the given
tables. All operators take any frame that has the named id and text columns. Other columns are
ignored, or passed through where the operator filters or edits documents. A null text is treated as
an empty one unless the operator says otherwise; null ids and repeated rows are allowed everywhere.
"""
