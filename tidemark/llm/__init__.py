"""Training-data operators: each module holds one operator, its query and (where SQL can say it) its oracle.

Nothing outside this package imports it. ``catalog`` lists the queries.
"""
