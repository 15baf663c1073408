"""Training-data operators: filtering, deduplication, search and mixing of text corpora.

Nothing else in the library imports this subpackage. Each module holds one operator; ``registry``
holds the thin ``opN_<name>`` queries and, where SQL can express them, their oracle SQL.
"""
