"""Operators over the registry: identity, mentions, scores, statistics, search, fuzzy matching, batches, layout."""
